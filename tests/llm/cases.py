"""Small tables with the cases every operator must handle."""

LONG = ("lorem ipsum dolor sit amet consectetur " * 3000).strip()

TEXTS = [
    None, "", " ", "\n\n", "word", "two words", "The same text, with several words in it.",
    "The same text, with several words in it.", "THE SAME TEXT, with several words in it.",
    "Été à Paris\u00a0! Ça va ?  Oui.\t\r\nNon\x1cpas", "12 345\n\n6", "日本語 テキスト 😀 e\u0301", "a\x00b <|endoftext|> 's don't",
    "...,,. ( x ) .\n.", LONG, LONG + " end",
]
DOCUMENTS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
CLASHING = DOCUMENTS + ", fp BIGINT, place STRING, count BIGINT, key STRING, share STRING, vector STRING, node STRING, `text.x` STRING"


def documents(spark, rows=None, schema=CLASHING):
    """Documents with null ids and languages, a repeated row, and columns that operators use inside."""
    if rows is None:
        rows = [(i * 3, t, ("en", "fr", None)[i % 3], None if i % 4 == 0 else "s", len(t or "")) for i, t in enumerate(TEXTS)]
        rows += [rows[6], (None, "a text without id", "en", "s", 17), (None, None, None, None, None)]
    extra = len(schema.split(",")) - 5
    return spark.createDataFrame([r + (None,) * extra for r in rows], schema).repartition(3)


def embeddings(spark, rows, schema="vec_id BIGINT, embedding ARRAY<FLOAT>, label INT, id STRING, keys STRING, copies STRING, v STRING"):
    return spark.createDataFrame([(i, v, 0, None, None, None, None) for i, v in rows], schema).repartition(3)


def by_id(df, key="doc_id"):
    found = {}
    for row in df.collect():
        found.setdefault(row[key], []).append(row.asDict())
    return found
