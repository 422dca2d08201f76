"""URL filter by association rules.

Spark's FP-growth mines combinations of URL tokens (domain, host, scheme, path segments, suffix, query
keys, subdomain) that come with a verdict. Labels for learning are the verdicts that fixed host and path rules
give to the URLs they fit. Mined rules are kept if confident and frequent enough and if no shorter
rule says the same as surely. An inverted index from token to rules finds the rules whose tokens a
URL has all of; the surest one decides the URLs that no fixed rule fits.

Everything here is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchgauge.session import materialise

# Fixed values: (host, path, verdict).
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.7
DEFAULT = "allow"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    rest = F.coalesce(_after_scheme(url), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, upper, lower), path


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fixed rule that fits, as a struct of ``rule`` and ``verdict``; null if none does."""
    ordered = sorted(rules, key=lambda r: len(r[0] + r[1]), reverse=True)
    fits = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p),
               F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for h, p, v in ordered
    ]
    return F.coalesce(*fits)


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a URL that can occur in other URLs too: no pure numbers."""
    labels = F.split(host, r"\.")
    segments = F.filter(F.split(path, "/"), lambda s: (s != "") & ~s.rlike(r"^[0-9]"))
    query = F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"(?s)\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda p: F.split(p, "=")[0]), lambda k: k != "")
    suffix = F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)
    named = [
        F.array(F.concat(F.lit("domain="), F.concat_ws(".", F.slice(F.reverse(labels), 1, 2)))),
        F.array(F.concat(F.lit("host="), host)),
        F.array(F.concat(F.lit("scheme="), F.lower(F.split(F.coalesce(url, F.lit("")), "://")[0]))),
        F.transform(segments, lambda s: F.concat(F.lit("path="), s)),
        F.when(suffix != "", F.array(F.concat(F.lit("suffix="), suffix))).otherwise(F.array().cast("array<string>")),
        F.transform(keys, lambda k: F.concat(F.lit("key="), k)),
        F.when(F.size(labels) > 3, F.array(F.concat(F.lit("sub="), labels[0]))).otherwise(F.array().cast("array<string>")),
    ]
    return F.when(host != "", F.array_distinct(F.concat(*named))).otherwise(F.array().cast("array<string>"))


def learned_tokens(labelled: DataFrame, min_support: float = MIN_SUPPORT, most: int | None = None) -> DataFrame:
    """``tokens``, ``verdict`` rows with only the tokens rules can be made of.

    A token below the minimum support is in no frequent itemset. Their number is below that of the
    tokens of a URL over the support, so they are one short constant; the more frequent a token
    is, the earlier it comes (ties by name). ``most`` keeps only so many of a URL.
    """
    counted = labelled.select(F.explode("tokens").alias("t")).groupBy("t").count()
    frequent = counted.where(F.col("count") >= labelled.count() * min_support)
    ranked = frequent.agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "t"))).alias("r"))
    names = F.from_json(F.lit(ranked.select(F.to_json("r.t")).first()[0]), "array<string>")
    found = F.array_intersect(names, "tokens")
    return labelled.select((found if most is None else F.slice(found, 1, most)).alias("tokens"), "verdict")


def stand_ins(learned: DataFrame) -> tuple[Column, Column]:
    """Map from tokens to the first by name of those that always come together in ``learned``, and
    the tokens that every row has.

    Tokens that always come together have the same counts with any others, so one can be mined
    for all of them; a token of every row says nothing. Both leave the rules as sure as they are.
    """
    sets = learned.groupBy("tokens").count()
    # each distinct set of frequent tokens once, so the pairs are few
    pairs = sets.select(F.explode("tokens").alias("a"), "tokens", "count").select("a", F.explode("tokens").alias("b"), "count")
    pairs = pairs.groupBy("a", "b").agg(F.sum("count").alias("n"))
    # those that come with a token each time it comes; both ways round they are alike
    always = pairs.groupBy("a").agg(
        F.max(F.when(F.col("a") == F.col("b"), F.col("n"))).alias("n"), F.collect_list(F.struct("b", "n")).alias("beside"))
    always = always.select("a", "n", F.transform(F.filter("beside", lambda p: p["n"] == F.col("n")), lambda p: p["b"]).alias("beside"))
    one = always.select("a", "n", F.explode("beside").alias("b")).alias("x")
    both = one.join(always.alias("y"), F.col("x.b") == F.col("y.a")).where(F.col("x.n") == F.col("y.n"))
    first = both.groupBy("x.a").agg(F.min("x.b").alias("b"), F.max("x.n").alias("n"))
    found = first.agg(
        F.collect_list(F.when(F.col("a") != F.col("b"), F.struct("a", "b"))).alias("alike"),
        F.collect_list(F.when(F.col("n") == learned.count(), F.col("a"))).alias("common"))
    alike, common = found.select(F.to_json(F.map_from_entries("alike")), F.to_json("common")).first()
    return F.from_json(F.lit(alike), "map<string,string>"), F.from_json(F.lit(common), "array<string>")


def standing(found_tokens: Column, alike: Column) -> Column:
    """The tokens that stand for those found."""
    return F.array_distinct(F.transform(found_tokens, lambda t: F.coalesce(F.try_element_at(alike, t), t)))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules ``tokens`` -> ``verdict`` with ``confidence`` and ``support`` from ``tokens``, ``verdict`` rows.

    A rule is dropped if another one with fewer tokens, all among its own, gives the same verdict
    at least as surely. ``alike`` maps tokens to the one of the rule that stands for them: see
    :func:`stand_ins`. All tokens that reach the support are mined, however many a URL has; the
    itemsets double with each further token that the same share of URLs has.
    """
    verdict = F.concat(F.lit("verdict="), F.col("verdict"))
    learned = learned_tokens(labelled, min_support)
    alike, common = stand_ins(learned)
    mined = standing(F.array_except("tokens", common), alike)
    items = learned.select(F.concat(mined, F.array(verdict)).alias("items"))
    # Lift compares a rule with the share its verdict has anyway: a rule no better says nothing.
    rules = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items).associationRules
    rules = rules.where(F.col("consequent")[0].startswith("verdict=") & (F.col("lift") > 1)).select(
        F.array_sort("antecedent").alias("tokens"), F.substring_index(F.col("consequent")[0], "=", -1).alias("verdict"),
        "confidence", "support",
    ).where(F.size("tokens") > 0)
    # First against the rules with one token less, by equality, which leaves few for the join below.
    less = rules.select("tokens", "verdict", "confidence", F.explode("tokens").alias("t")).select(
        F.col("tokens").alias("longer"), "verdict", F.col("confidence").alias("c"), F.array_remove("tokens", F.col("t")).alias("tokens"))
    weaker = less.join(rules, ["tokens", "verdict"]).where(F.col("confidence") >= F.col("c"))
    rules = materialise(rules.join(weaker.select(F.col("longer").alias("tokens"), "verdict").distinct(), ["tokens", "verdict"], "left_anti"))
    a, b = rules.alias("a"), rules.alias("b")
    # The shorter rule shares a token with the longer one, so the join is on tokens, not on all pairs.
    shared = a.withColumn("t", F.explode("a.tokens")).join(b.withColumn("t", F.explode("b.tokens")), "t")
    covered = shared.where(
        (F.col("a.verdict") == F.col("b.verdict"))
        & (F.size("b.tokens") < F.size("a.tokens"))
        & (F.size(F.array_except("b.tokens", "a.tokens")) == 0)
        & (F.col("b.confidence") >= F.col("a.confidence"))
    ).select(F.col("a.tokens").alias("tokens"), F.col("a.verdict").alias("verdict")).distinct()
    own = F.map_filter(alike, lambda token, name: F.array_contains("tokens", name))
    return rules.join(covered, ["tokens", "verdict"], "left_anti").withColumn("alike", own)


def inverted_index(rules: DataFrame) -> DataFrame:
    """One row: ``index`` from token to the numbers of the rules that need it, ``rules`` by number, and
    ``alike`` from tokens to those that stand for them."""
    ranked = rules.select(F.struct(
        (-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), F.size("tokens").alias("n"), "tokens", "verdict"
    ).alias("r"), "alike")
    names = F.map_from_entries(F.array_distinct(F.flatten(F.collect_list(F.map_entries("alike")))))
    ordered = ranked.agg(F.array_sort(F.collect_list("r")).alias("rules"), names.alias("alike"))  # few: see mine()
    numbered = F.transform("rules", lambda r, i: F.struct(i.alias("i"), r["tokens"].alias("tokens")))
    every = F.array_distinct(F.flatten(F.transform("rules", lambda r: r["tokens"])))
    needing = F.transform("every", lambda t: F.transform(
        F.filter("numbered", lambda r: F.array_contains(r["tokens"], t)), lambda r: r["i"]))
    return ordered.withColumn("numbered", numbered).withColumn("every", every).select(
        F.map_from_arrays("every", needing).alias("index"), "rules", "alike")


def decide(found_tokens: Column, index: Column, rules: Column) -> Column:
    """The surest rule all of whose tokens are among the URL's; null if there is none.

    Rules are numbered from the surest on, so it is the smallest number that is hit once per token.
    """
    hits = F.flatten(F.transform(found_tokens, lambda t: F.coalesce(F.try_element_at(index, t), F.array().cast("array<int>"))))
    whole = F.filter(F.array_distinct(hits), lambda n: F.size(F.filter(hits, lambda h: h == n)) == F.get(rules, n)["n"])
    return F.get(rules, F.array_min(whole))


def judge(pages: DataFrame, rules=RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``source`` (rule, mined or default), ``confidence``.

    A URL that no fixed and no mined rule fits is allowed; so are null URLs and such without
    ``://``. The index goes to every task as one value; its size is bounded by the minimum support.
    """
    url = F.col("url")
    host, path = host_and_path(url)
    cut = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    cut = cut.select("page_id", "url", host.alias("host"), path.alias("path"))
    cut = cut.withColumn("fixed", matched_rule(F.col("host"), F.col("path"), rules))
    cut = cut.withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path")))
    labelled = cut.where("fixed IS NOT NULL").select("tokens", F.col("fixed.verdict").alias("verdict"))
    index = inverted_index(mine(labelled, min_support, min_confidence))
    # One small document, which the optimizer turns back into a constant of the plan.
    document = index.select(F.to_json(F.struct("index", "rules", "alike"))).first()[0]
    mined = F.from_json(F.lit(document), index.schema.simpleString())
    judged = cut.withColumn(
        "mined", F.when(F.col("fixed").isNull(), decide(
            standing(F.col("tokens"), mined["alike"]), mined["index"], mined["rules"])))
    return judged.select(
        "page_id", "host", "path", F.col("fixed.rule").alias("rule"),
        F.coalesce("fixed.verdict", "mined.verdict", F.lit(DEFAULT)).alias("verdict"),
        F.when(F.col("fixed").isNotNull(), "rule").when(F.col("mined").isNotNull(), "mined").otherwise("default").alias("source"),
        (-F.col("mined.c")).alias("confidence"),
    )
