"""Differences of configuration documents of any shape, without Python in the tasks.

A document is opened level by level: every object on a row is replaced by one row for each of its
entries, several levels in one pass, until no row holds an object. What is left are options, rows of
(path, value), and two documents are compared by grouping the options of both by their path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchgauge.operators.slicing import left_join_known, stored_small
from batchgauge.session import materialise

LEVELS_AT_ONCE = 3
"""Levels opened before the rows are stored and looked at again."""

_OBJECT = "schema_of_variant(e.`2`) LIKE 'OBJECT<%'"

# A value as text that is equal exactly if the values are: numbers and booleans by value (1 equals 1.0
# and true), whole numbers with all their digits; lists as JSON.
_SAME = """CASE
  WHEN schema_of_variant(e.`2`) = 'VOID' THEN 'null'
  WHEN schema_of_variant(e.`2`) = 'STRING' THEN concat('s', e.`1`)
  WHEN schema_of_variant(e.`2`) LIKE 'ARRAY<%' THEN concat('a', to_json(try_parse_json(e.`1`)))
  WHEN schema_of_variant(e.`2`) = 'BOOLEAN' THEN if(e.`1` = 'true', 'n1', 'n0')
  WHEN schema_of_variant(e.`2`) = 'BIGINT' OR schema_of_variant(e.`2`) LIKE 'DECIMAL(%,0)' THEN concat('n', to_json(e.`2`))
  WHEN abs(variant_get(e.`2`, '$', 'double')) < 1e37
       AND variant_get(e.`2`, '$', 'double') = rint(variant_get(e.`2`, '$', 'double'))
    THEN concat('n', string(cast(variant_get(e.`2`, '$', 'double') AS DECIMAL(38, 0))))
  ELSE concat('n', string(variant_get(e.`2`, '$', 'double')))
END"""

_SHOWN = """CASE
  WHEN schema_of_variant(e.`2`) = 'VOID' THEN NULL
  WHEN schema_of_variant(e.`2`) LIKE 'ARRAY<%' THEN to_json(e.`2`)
  ELSE e.`1`
END"""

_ENTRIES = f"""transform(arrays_zip(map_keys(texts), map_values(texts), map_values(values)), (e, i) -> named_struct(
  'path', if(path = '', e.`0`, concat(path, '.', e.`0`)), 'place', concat(place, lpad(string(i), 9, '0')), 'depth', depth + 1,
  'object', if({_OBJECT}, e.`1`, NULL), 'same', if({_OBJECT}, NULL, {_SAME}), 'shown', if({_OBJECT}, NULL, {_SHOWN}),
  'readable', true))"""

# An object that cannot be read (no valid JSON, a name twice in an inner object, nested beyond the
# parser's limit of 1000) stays as it is: a row of its own, never equal to anything but the same text.
_AS_IT_IS = """array(named_struct('path', path, 'place', place, 'depth', depth, 'object', string(NULL),
  'same', if(object IS NULL, same, concat('u', object)), 'shown', if(object IS NULL, shown, object),
  'readable', if(object IS NULL, readable, false)))"""


def _opened(rows: DataFrame, kept: list[str]) -> DataFrame:
    """Rows that hold an object become one row for every entry; the others stay."""
    parsed = rows.withColumns({
        "texts": F.from_json("object", "map<string,string>"), "values": F.from_json("object", "map<string,variant>")})
    entries = F.when(F.expr("texts IS NOT NULL AND values IS NOT NULL"), F.expr(_ENTRIES)).otherwise(F.expr(_AS_IT_IS))
    return parsed.select(*kept, F.explode(entries).alias("entry")).select(*kept, "entry.*")


def options(documents: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """The options of JSON documents: ``keys, path, place, depth, same, shown, readable``.

    ``path`` joins the names by dots, ``place`` sorts as the document does, ``same`` is equal for equal
    values. Empty objects have no options; neither have NULL and text that does not begin an object.
    """
    rows = documents.where(F.col(text).rlike(r"^\s*\{")).select(
        *keys, F.lit("").alias("path"), F.lit("").alias("place"), F.lit(0).alias("depth"), F.col(text).alias("object"),
        F.lit(None).cast("string").alias("same"), F.lit(None).cast("string").alias("shown"), F.lit(True).alias("readable"))
    while True:
        for _ in range(LEVELS_AT_ONCE):
            rows = _opened(rows, keys)
        rows = materialise(rows)
        if rows.where("object IS NOT NULL").isEmpty():
            return rows.drop("object")


def changed_options(pairs: DataFrame, key: str) -> DataFrame:
    """Options that differ between ``old_json`` and ``new_json``: ``key, rank, path, change, old_value,
    new_value``. ``change`` is added, removed, modified, or unreadable for an object that cannot be
    opened. Of equal paths the one nested more deeply counts, then the later one."""
    sides = pairs.select(key, F.explode(F.array(
        F.struct(F.lit("old").alias("side"), F.col("old_json").alias("text")),
        F.struct(F.lit("new").alias("side"), F.col("new_json").alias("text")))).alias("s")).select(key, "s.*")
    value = F.struct("depth", "place", "same", "shown", "readable")
    found = options(sides, "text", [key, "side"]).groupBy(key, "path").agg(*[
        F.max(F.when(F.col("side") == side, value)).alias(side) for side in ("old", "new")])
    old, new = F.col("old"), F.col("new")
    change = (
        F.when(~F.coalesce(F.col("old.readable"), F.lit(True)) | ~F.coalesce(F.col("new.readable"), F.lit(True)), "unreadable")
        .when(old.isNull(), "added").when(new.isNull(), "removed").otherwise("modified"))
    return found.where(~F.col("old.same").eqNullSafe(F.col("new.same"))).select(
        key, F.struct(old.isNull().alias("late"), F.coalesce("old.place", "new.place").alias("place")).alias("rank"),
        "path", change.alias("change"), F.col("old.shown").alias("old_value"), F.col("new.shown").alias("new_value"))


_CHANGE = "ARRAY<STRUCT<path: STRING, change: STRING, old_value: STRING, new_value: STRING>>"


def _paired(pairs: DataFrame) -> DataFrame:
    """Pairs of different texts with a digest of both; equal texts need no comparison."""
    old, new = F.col("old_json"), F.col("new_json")
    size = F.coalesce(F.length(old).cast("string"), F.lit("none"))
    both = F.concat_ws(":", size, F.coalesce(old, F.lit("")), new.isNull().cast("string"), F.coalesce(new, F.lit("")))
    return pairs.withColumn("_texts", F.when(~old.eqNullSafe(new), F.sha2(both, 256)))


def _distinct(paired: DataFrame) -> DataFrame:
    """Every pair of texts once, however many rows hold it."""
    return paired.where("_texts IS NOT NULL").groupBy("_texts").agg(
        F.first("old_json").alias("old_json"), F.first("new_json").alias("new_json"))


def with_changes(pairs: DataFrame, name: str = "config_diff") -> DataFrame:
    """Add the array of ``path, change, old_value, new_value`` between ``old_json`` and
    ``new_json``, in the order of the documents; empty where nothing differs.

    Nested options of any depth appear under dotted paths; values compare by type and value: 1 equals
    1.0 and true, "1" does not equal 1. Equal pairs of texts are compared once.
    """
    paired = _paired(pairs)
    entry = F.struct("rank", "path", "change", "old_value", "new_value")
    arrays = changed_options(_distinct(paired), "_texts").groupBy("_texts").agg(F.array_sort(F.collect_list(entry)).alias("_found"))
    found = stored_small(arrays.select("_texts", F.transform("_found", lambda c: F.struct(
        *[c[n].alias(n) for n in ("path", "change", "old_value", "new_value")])).alias(name)))
    joined = left_join_known(paired, found, "_texts", "old_json")
    return joined.withColumn(name, F.coalesce(F.col(name), F.array().cast(_CHANGE))).drop("_texts")


def config_diff(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """One row per changed option of each pair (``old_json``, ``new_json``)."""
    paired = _paired(pairs)
    found = stored_small(changed_options(_distinct(paired), "_texts").drop("rank"))
    return paired.select(*keys, "_texts").join(found, "_texts").drop("_texts")
