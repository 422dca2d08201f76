"""Ordered work inside groups that may be far larger than one task.

A window over ``partitionBy(key)`` puts a whole group into one task. That is the
right plan while the largest group fits a task, so each function here first measures
the groups (one pre-aggregated pass over the key columns) and takes the plain window
if it can. Otherwise the group is cut into *slices*: ranges of the sort key holding
about ``rows_per_slice`` rows each. Windows then run per slice, and one small row per
slice carries counts and border values across slices.

Slice borders come from exact counts, minima and maxima, never from samples or
sketches, so a recomputed task cuts the group in exactly the same places.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchgauge.session import materialise

ROWS_PER_SLICE = 2_000_000
"""Largest group one task handles; a larger one is cut into slices of about this size."""

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024
"""Largest side, counted and by the size of its stored files or rows, that gets a broadcast hint."""


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Rows in the largest group: one scan of the key columns, combined on the map side."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a side whose counted size allows it; otherwise leave the join to AQE."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _wide(df: DataFrame) -> list[str]:
    fixed = {"long", "integer", "double", "boolean", "short", "byte", "float", "date", "timestamp", "timestamp_ntz"}
    return [f.name for f in df.schema.fields if f.dataType.typeName() not in fixed]


def stored_small(df: DataFrame) -> DataFrame:
    """Store a table that is expected to be small, measure it, and broadcast it if it is.

    Rows are counted, and the texts, lists and the like in them are added up (lists as JSON), since
    a million rows may hold anything.
    """
    stored = materialise(df)
    plain = {f.name for f in stored.schema.fields if f.dataType.typeName() in ("string", "binary")}
    held = {c: F.col(f"`{c}`") if c in plain else F.to_json(F.struct(F.col(f"`{c}`"))) for c in _wide(stored)}
    texts = [F.coalesce(F.octet_length(text), F.lit(0)) for text in held.values()]
    width = sum(texts, F.lit(16 * len(stored.columns)))
    rows, size = stored.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return small_side(stored, rows) if size <= BROADCAST_BYTES else stored


def left_join_known(left: DataFrame, right: DataFrame, key: str, spread: str) -> DataFrame:
    """A left join on ``key`` that does not gather the rows whose key is NULL in one task.

    Such rows get a number of their own beside the key; it decides where they go, not what they
    meet. The pair is one join key, so the optimizer cannot take it apart again.
    """
    number = F.when(F.col(key).isNotNull(), F.lit(0).cast("bigint")).otherwise(F.xxhash64(spread))
    keyed = left.withColumn("_pair", F.struct(F.col(key).alias("key"), number.alias("number")))
    found = right.where(F.col(key).isNotNull()).withColumn(
        "_found", F.struct(F.col(key).alias("key"), F.lit(0).cast("bigint").alias("number"))).drop(key)
    return keyed.join(found, keyed["_pair"] == found["_found"], "left").drop("_pair", "_found")


@dataclass(frozen=True)
class Sliced:
    """Rows with slice columns; ``rows`` bounds the number of slices of cut groups."""

    df: DataFrame
    keys: list[str]
    slices: list[str]
    rows: int


def _piece(position: Column, low: Column, high: Column, pieces: Column) -> Column:
    share = F.floor((position - low) / F.nullif(high - low, F.lit(0.0)) * pieces)
    return F.coalesce(F.least(share, pieces - 1), F.lit(0))


def sort_number(df: DataFrame, name: str) -> Column:
    """A sort column as a double that rises with it (microseconds for timestamps)."""
    kind, col = df.schema[name].dataType.typeName(), F.col(name)
    if kind == "timestamp":
        return F.unix_micros(col).cast("double")
    if kind == "timestamp_ntz":
        minutes = F.unix_date(col.cast("date")) * 1440 + F.hour(col) * 60 + F.minute(col)
        return minutes * 60e6 + F.extract(F.lit("SECOND"), col).cast("double") * 1e6
    return col.cast("double")


def slice_groups(
    df: DataFrame,
    keys: list[str],
    order: str,
    tie: str,
    rows_per_slice: int = ROWS_PER_SLICE,
    profile: DataFrame | None = None,
    largest: int | None = None,
) -> Sliced | None:
    """Add slice columns, or return None when every group fits one task.

    ``order`` is a numeric or timestamp column (NULL sorts last), ``tie`` a numeric tie
    breaker. ``profile`` may name a cheaper superset of the rows to measure (for instance
    the scanned table while ``df`` is its de-duplicated form), ``largest`` the size of the
    largest group if it is known already.

    The first cut is by equal steps of the sort key; pieces that still hold too many rows
    (bursts) are cut again inside their own range, and rows that share one sort key by the
    tie breaker, until every slice is small. Usually the first cut is enough.
    """
    measured = df if profile is None else profile
    if largest is None:
        largest = largest_group(measured, keys)
    if largest <= rows_per_slice:
        return None

    names: list[str] = []

    def number(rows: DataFrame) -> DataFrame:
        return rows.withColumns({"_pos": sort_number(rows, order), "_tie": sort_number(rows, tie)})

    def oversized(rows: DataFrame) -> DataFrame:
        # a piece somewhat above the target is not worth another pass
        limit = rows_per_slice * (2 if names else 1)
        return (
            rows.groupBy(*keys, *names)
            .agg(
                F.count(F.lit(1)).alias("_n"),
                F.min("_pos").alias("_lo"),
                F.max("_pos").alias("_hi"),
                F.min("_tie").alias("_tlo"),
                F.max("_tie").alias("_thi"),
            )
            .where(F.col("_n") > limit)
            .where((F.col("_lo") < F.col("_hi")) | (F.col("_tlo") < F.col("_thi")))
            .withColumn("_k", F.ceil(F.col("_n") / rows_per_slice))
            .drop("_n")
        )

    def assign(rows: DataFrame, borders: DataFrame, count: int, name: str) -> DataFrame:
        by_key = _piece(F.col("_pos"), F.col("_lo"), F.col("_hi"), F.col("_k"))
        by_tie = _piece(F.col("_tie"), F.col("_tlo"), F.col("_thi"), F.col("_k"))
        piece = (
            F.when(F.col("_k").isNull(), 0)
            .when(~F.coalesce(F.col("_lo") < F.col("_hi"), F.lit(False)), by_tie)
            .when(F.col("_pos").isNull(), F.col("_k"))
            .otherwise(by_key)
        )
        joined = rows.join(small_side(borders, count), keys + names, "left")
        marks = {name: piece.cast("int")}
        if not names:
            marks["_cut"] = F.col("_k").isNotNull()
        return joined.withColumns(marks).drop("_k", "_lo", "_hi", "_tlo", "_thi")

    rows, measured = number(df), number(measured.select(*dict.fromkeys([*keys, order, tie])))
    bound = 0
    while True:
        borders = materialise(oversized(measured.where("_cut") if names else measured))
        count, pieces = borders.agg(F.count(F.lit(1)), F.sum(F.col("_k") + 1)).first()
        if count == 0:
            break
        bound += pieces
        name = f"_slice{len(names)}"
        rows = assign(rows, borders, count, name)
        measured = assign(measured, borders, count, name)
        names.append(name)
    if not names:
        return None
    return Sliced(rows.drop("_pos", "_tie"), keys, names, bound)


def _ordering(order: str, tie: str) -> list[Column]:
    return [F.col(order).asc_nulls_last(), F.col(tie).asc_nulls_last()]


def _attach(rows: DataFrame, per_slice: DataFrame, sliced: Sliced) -> DataFrame:
    """Join one row per slice to the rows of cut groups.

    The condition is there for the plan. With plain equality the optimizer would add
    not-null filters below ``per_slice`` only, and without ``_cut`` it would drop that
    column from the rows; either way the two shuffles would differ and the rows would be
    computed and shuffled twice instead of once.
    """
    parts = sliced.keys + sliced.slices
    other = per_slice.withColumnsRenamed({p: f"_of_{p}" for p in parts})
    same = reduce(and_, [F.col(p).eqNullSafe(F.col(f"_of_{p}")) for p in parts], F.col("_cut"))
    return rows.join(small_side(other, sliced.rows), same, "left").drop(*[f"_of_{p}" for p in parts])


def _earlier(keys: list[str], slices: list[str]):
    return (
        Window.partitionBy(*keys).orderBy(*slices).rowsBetween(Window.unboundedPreceding, -1)
    )


def _later(keys: list[str], slices: list[str]):
    backwards = [F.col(s).desc() for s in slices]
    return (
        Window.partitionBy(*keys).orderBy(*backwards).rowsBetween(Window.unboundedPreceding, -1)
    )


def with_positions(
    df: DataFrame,
    keys: list[str],
    order: str,
    tie: str,
    name: str = "pos",
    rows_per_slice: int = ROWS_PER_SLICE,
    profile: DataFrame | None = None,
    largest: int | None = None,
) -> DataFrame:
    """1-based position of each row inside its group, by ``(order nulls last, tie)``."""
    sliced = slice_groups(df, keys, order, tie, rows_per_slice, profile, largest)
    if sliced is None:
        window = Window.partitionBy(*keys).orderBy(*_ordering(order, tie))
        return df.withColumn(name, F.row_number().over(window).cast("bigint"))

    parts = keys + sliced.slices
    offsets = (
        sliced.df.where("_cut")
        .groupBy(*parts)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*parts, F.sum("_n").over(_earlier(keys, sliced.slices)).alias("_before"))
    )
    local = F.row_number().over(Window.partitionBy(*parts).orderBy(*_ordering(order, tie)))
    return (
        sliced.df.withColumn("_local", local)
        .transform(_attach, offsets, sliced)
        .withColumn(name, (F.col("_local") + F.coalesce(F.col("_before"), F.lit(0))).cast("bigint"))
        .select(*df.columns, name)
    )


NUMBERED_ROWS = 100_000
"""Rows of a range that new numbers are given out in, and how many ranges there are at least."""
NUMBERED_RANGES = 8


def with_numbers(df: DataFrame, order: str, tie: str, name: str = "pos", rows_per_range: int = NUMBERED_ROWS) -> DataFrame:
    """1-based number of each row among all rows, by ``(order nulls last, tie)``, without a window
    over all of them: rows are numbered inside ranges of the sort key, and the counts of the ranges
    before, one row a range, say where a range begins."""
    df = materialise(df.withColumn("_all", F.lit(0)))
    rows = df.count()
    size = max(1, min(rows_per_range, -(-rows // NUMBERED_RANGES)))
    return with_positions(df, ["_all"], order, tie, name, size, largest=rows).drop("_all")


def _skipping_nulls(function: str, value: str, parts: list[str], order: str, tie: str) -> Column:
    # lag / lead take IGNORE NULLS in SQL only
    names = ", ".join(f"`{p}`" for p in parts)
    return F.expr(
        f"{function}({value}) IGNORE NULLS OVER (PARTITION BY {names} "
        f"ORDER BY `{order}` ASC NULLS LAST, `{tie}` ASC NULLS LAST)"
    )


def with_neighbours(
    df: DataFrame,
    keys: list[str],
    order: str,
    tie: str,
    value: str,
    rows_per_slice: int = ROWS_PER_SLICE,
    profile: DataFrame | None = None,
    largest: int | None = None,
) -> DataFrame:
    """Position plus the nearest non-NULL ``value`` strictly before and after each row.

    Adds ``pos``, ``prev_value``, ``prev_pos``, ``next_value``, ``next_pos``. Looking
    ahead uses ``lead IGNORE NULLS`` on the same sort: a frame unbounded to the right
    would be evaluated again for every row, in quadratic time.
    """
    sliced = slice_groups(df, keys, order, tie, rows_per_slice, profile, largest)
    parts = keys if sliced is None else keys + sliced.slices
    local = F.row_number().over(Window.partitionBy(*parts).orderBy(*_ordering(order, tie)))
    known = F.struct(F.col(value).alias("v"), F.col("pos").alias("p"))
    rows = (
        (df if sliced is None else sliced.df)
        .withColumn("pos", local.cast("bigint"))
        .withColumn("_known", F.when(F.col(value).isNotNull(), known))
        .withColumns({
            "_prev": _skipping_nulls("lag", "_known", parts, order, tie),
            "_next": _skipping_nulls("lead", "_known", parts, order, tie),
        })
    )
    if sliced is not None:
        rows = _across_slices(rows, sliced, value)
    return rows.select(
        *df.columns,
        "pos",
        F.col("_prev.v").alias("prev_value"),
        F.col("_prev.p").alias("prev_pos"),
        F.col("_next.v").alias("next_value"),
        F.col("_next.p").alias("next_pos"),
    )


def _across_slices(rows: DataFrame, sliced: Sliced, value: str) -> DataFrame:
    """Shift local positions and fill borders from the neighbouring slices."""
    keys, slices = sliced.keys, sliced.slices
    parts = keys + slices
    earlier, later = _earlier(keys, slices), _later(keys, slices)

    def shifted(entry: str) -> Column:
        moved = F.struct(F.col(f"{entry}.v").alias("v"), (F.col(f"{entry}.p") + F.col("_before")).alias("p"))
        return F.when(F.col(entry).isNotNull(), moved)

    has = F.col(value).isNotNull()
    carry = (
        rows.where("_cut")
        .groupBy(*parts)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.min(F.when(has, F.col("pos"))).alias("_fp"),
            F.max(F.when(has, F.col("pos"))).alias("_lp"),
            F.min_by(value, F.when(has, F.col("pos"))).alias("_fv"),
            F.max_by(value, F.when(has, F.col("pos"))).alias("_lv"),
        )
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .withColumns({
            "_first": F.when(
                F.col("_fp").isNotNull(),
                F.struct(F.col("_fv").alias("v"), (F.col("_fp") + F.col("_before")).alias("p")),
            ),
            "_last": F.when(
                F.col("_lp").isNotNull(),
                F.struct(F.col("_lv").alias("v"), (F.col("_lp") + F.col("_before")).alias("p")),
            ),
        })
        .select(
            *parts,
            "_before",
            F.last("_last", ignorenulls=True).over(earlier).alias("_carry_prev"),
            F.last("_first", ignorenulls=True).over(later).alias("_carry_next"),
        )
    )
    return (
        _attach(rows, carry, sliced)
        .withColumn("_before", F.coalesce(F.col("_before"), F.lit(0)))
        .withColumns({
            "_prev": F.coalesce(shifted("_prev"), F.col("_carry_prev")),
            "_next": F.coalesce(shifted("_next"), F.col("_carry_next")),
            "pos": F.col("pos") + F.col("_before"),
        })
    )
