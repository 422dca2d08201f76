"""Exact top-k inner products by dual-tree search over cover trees.

Vectors are dealt to cells by their nearest pivot; pivots come from a bounded sample by
farthest-first choice. A cell is cut into candidate blocks, queries into chunks of neighbouring
cells. Every query first scores the sample, whose k-th score no answer can fall below. A chunk visits
the cells whose ball could hold a better candidate; a task builds a cover tree over its block and one
over its queries and descends both together, leaving out pairs of nodes whose covering balls
cannot beat the worst k-th score of the query group. Only scores that may still rank leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchgauge.llm.batches import arrow_schema
from batchgauge.llm.crosspolytope import matrix
from batchgauge.session import materialise

SAMPLE = 2048
PIVOTS = 16
BLOCK = 8192
"""Candidates per block, about."""
CHUNK = 4096
"""Queries per chunk, about."""
FAN_OUT = 8
LEAF = 192
"""Rows below which a node is not divided any more."""
ROWS_SCORED = 2048
"""Candidates scored together for a query leaf, about."""
LOWEST = np.iinfo(np.int64).min + 1


def integer_vector(vector: Column, scale: int = 64) -> Column:
    """``floor(scale * x)`` per component; null for vectors that take no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    return F.when(~bad & (F.size(vector) > 0), whole)


@dataclass
class Node:
    center: np.ndarray
    radius: float
    norm: float
    rows: np.ndarray
    children: list


def cover_tree(x: np.ndarray, rows: np.ndarray | None = None) -> Node:
    """Nodes with covering radii; children are centred on points far apart (farthest-first)."""
    rows = np.arange(len(x)) if rows is None else rows
    points = x[rows]
    middle = points[np.argmin(((points - points.mean(0)) ** 2).sum(1))]
    away = np.sqrt(((points - middle) ** 2).sum(1))
    node = Node(middle, float(away.max()), float(np.sqrt((middle * middle).sum())), rows, [])
    if len(rows) <= LEAF or node.radius == 0:
        return node
    nearest, owner = np.full(len(rows), np.inf), np.zeros(len(rows), int)
    at = int(np.argmax(away))
    for child in range(FAN_OUT):
        distance = ((points - points[at]) ** 2).sum(1)
        closer = distance < nearest
        nearest[closer], owner[closer] = distance[closer], child
        at = int(np.argmax(nearest))
        if np.sqrt(nearest[at]) <= node.radius / 2:  # the cover condition of the next level
            break
    node.children = [cover_tree(x, rows[owner == c]) for c in np.unique(owner)]
    return node


class Best:
    """The k best (score, id) per query so far; ties go to the smaller id."""

    def __init__(self, ids: np.ndarray, floors: np.ndarray, k: int):
        self.ids, self.floors, self.k = ids, floors, k
        self.scores = np.full((len(ids), k), LOWEST)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def worst(self, rows: np.ndarray) -> int:
        return int(np.maximum(self.scores[rows, -1], self.floors[rows]).min())

    def offer(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        scores[ids == self.ids[rows][:, None]] = LOWEST
        useful = (scores >= np.maximum(self.floors[rows], self.scores[rows, -1])[:, None]).any(0)
        if not useful.any():
            return
        scores = np.concatenate([self.scores[rows], scores[:, useful]], 1)
        all_ids = np.concatenate([self.found[rows], np.broadcast_to(ids[useful], (len(rows), int(useful.sum())))], 1)
        order = np.lexsort((all_ids, -scores), axis=1)[:, : self.k]
        self.scores[rows] = np.take_along_axis(scores, order, 1)
        self.found[rows] = np.take_along_axis(all_ids, order, 1)


def exact_in_doubles(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether doubles hold every inner product of rows of ``a`` and ``b``."""
    return a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 2.0**53


def products(a: np.ndarray, b: np.ndarray, doubles: bool) -> np.ndarray:
    """Integer inner products of all rows; doubles do the work where they are exact."""
    return (a @ b.T).astype(np.int64) if doubles else a.astype(np.int64) @ b.astype(np.int64).T


def dual_search(queries: np.ndarray, candidates: np.ndarray, ids: np.ndarray, best: Best) -> None:
    """Improve ``best`` by all candidates, leaving out node pairs that cannot matter."""
    doubles = exact_in_doubles(queries, candidates)

    def bound(q: Node, nodes: list[Node]) -> np.ndarray:
        centers = np.array([n.center for n in nodes])
        radius, norm = np.array([n.radius for n in nodes]), np.array([n.norm for n in nodes])
        reach = centers @ q.center + q.radius * norm + q.norm * radius + q.radius * radius
        return reach + 1e-9 * np.abs(reach) + 1e-6

    def visit(q: Node, nodes: list[Node]) -> None:
        worst = best.worst(q.rows)
        nodes = [n for n, b in zip(nodes, bound(q, nodes)) if b >= worst]
        if not nodes:
            return
        if q.children:
            # the larger of the two sides is opened, so both trees go down together
            opened = [c for n in nodes for c in (n.children if n.children and n.radius >= q.radius else [n])]
            for child in q.children:
                visit(child, opened)
            return
        leaves: list[Node] = []
        while nodes:
            leaves += [n for n in nodes if not n.children]
            nodes = [c for n in nodes for c in n.children]
            if nodes:
                nodes = [n for n, b in zip(nodes, bound(q, nodes)) if b >= worst]
        if not leaves:
            return
        reach = bound(q, leaves)
        order = np.argsort(-reach, kind="stable")
        filled = np.cumsum([len(leaves[i].rows) for i in order])
        starts = np.flatnonzero(np.diff(filled // ROWS_SCORED, prepend=-1))
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(order)]):
            if reach[order[start]] < best.worst(q.rows):
                break
            rows = np.concatenate([leaves[i].rows for i in order[start:end]])
            best.offer(q.rows, ids[rows], products(queries[q.rows], candidates[rows], doubles))

    visit(cover_tree(queries), [cover_tree(candidates)])


# --- Spark --------------------------------------------------------------------------


def farthest_first(x: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` rows of ``x`` that lie far apart."""
    chosen, away = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(x)) and away.max() > 0:
        chosen.append(int(np.argmax(away)))
        away = np.minimum(away, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def top_k(embeddings: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` best candidates of every query.

    Queries are the rows whose ``vec_id`` is divisible by ``every``. Rows without id, and vectors
    that are null, empty or hold null or non-finite components, take no part; vectors of different lengths
    are never compared. Every row is a candidate of the queries with another id, rows that share an id and
    repeated rows too; queries that share an id share the ``k`` best of all of them. Fewer than ``k``
    candidates give fewer rows, an empty table none.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), integer_vector(F.col("embedding"), scale).alias("v"))
    rows = materialise(rows.where("vec_id IS NOT NULL AND v IS NOT NULL").withColumn("d", F.size("v")))
    # The sample bounds what the driver sees: vectors by a hash of their id.
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    samples, pivots = {}, {}
    for d in sorted({r["d"] for r in sample}):
        own = [r for r in sample if r["d"] == d]
        samples[d] = np.array([r["vec_id"] for r in own], np.int64), np.array([r["v"] for r in own], np.float64)
        pivots[d] = farthest_first(samples[d][1], PIVOTS)
    held = rows.sparkSession.sparkContext.broadcast((samples, pivots))
    placed_ddl = "vec_id BIGINT, v ARRAY<BIGINT>, cell BIGINT, away DOUBLE, norm DOUBLE, floor BIGINT"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples, pivots = held.value
        schema = arrow_schema(placed_ddl)
        for whole in batches:
            lengths = whole.column("d").to_numpy(zero_copy_only=False)
            for d in np.unique(lengths).tolist():
                batch = whole.filter(pa.array(lengths == d))
                x, ids = matrix(batch.column("v")), batch.column("vec_id").to_numpy()
                centers = pivots.get(d, np.zeros((1, d)))
                apart = np.sqrt(((x[:, None, :] - centers[None]) ** 2).sum(2))
                cell = apart.argmin(1)
                floors = np.full(len(x), LOWEST)
                asks = np.flatnonzero(ids % every == 0)
                if len(asks) and d in samples and len(samples[d][0]) > k:
                    scores = products(x[asks], samples[d][1], exact_in_doubles(x[asks], samples[d][1]))
                    scores[ids[asks][:, None] == samples[d][0][None]] = LOWEST
                    floors[asks] = np.partition(scores, -k, axis=1)[:, -k]
                arrays = [batch.column("vec_id"), batch.column("v"), pa.array(cell + d * PIVOTS), pa.array(apart[np.arange(len(x)), cell]),
                          pa.array(np.sqrt((x * x).sum(1))), pa.array(floors)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    placed = materialise(rows.mapInArrow(place, placed_ddl))
    # One row per cell; their number is bounded by PIVOTS per length of vectors.
    cells = placed.groupBy("cell").agg(
        F.count("*").alias("n"), F.max("away").alias("radius"),
        F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("queries"),
        F.max(F.when(F.col("vec_id") % every == 0, F.col("away"))).alias("query_radius"),
        F.min(F.when(F.col("vec_id") % every == 0, F.col("floor"))).alias("floor"),
    ).collect()
    at = {c["cell"]: pivots.get(c["cell"] // PIVOTS, np.zeros((PIVOTS, c["cell"] // PIVOTS)))[c["cell"] % PIVOTS] for c in cells}
    salts = {c["cell"]: -(-c["n"] // BLOCK) for c in cells}
    # Small cells share a chunk of queries, so a candidate block is read by few chunks.
    chunk_of, spread, number, filled, dimension = {}, {}, 0, 0, None
    for c in sorted((c for c in cells if c["queries"]), key=lambda c: c["cell"]):
        if filled and (filled + c["queries"] > CHUNK or c["cell"] // PIVOTS != dimension):
            number, filled = number + 1, 0
        dimension, filled = c["cell"] // PIVOTS, filled + c["queries"]
        chunk_of[c["cell"]], spread[c["cell"]] = number, -(-c["queries"] // CHUNK)
    visits: dict[int, set[int]] = {}
    for q in (c for c in cells if c["queries"]):
        for c in cells:
            if q["cell"] // PIVOTS == c["cell"] // PIVOTS:
                a, b = at[q["cell"]], at[c["cell"]]
                norms = float(np.sqrt((a * a).sum())), float(np.sqrt((b * b).sum()))
                reach = float(a @ b) + q["query_radius"] * norms[1] + norms[0] * c["radius"] + q["query_radius"] * c["radius"]
                if reach + 1e-9 * abs(reach) + 1e-6 >= q["floor"]:
                    visits.setdefault(c["cell"], set()).add(q["cell"])
    if not visits:
        return rows.where("false").select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.col("vec_id").alias("score"))
    # (candidate cell, salt) x (chunk, part of the chunk): the tasks of the search.
    meetings = [(c, s, chunk, part) for c, qs in visits.items() for s in range(salts[c])
                for chunk, part in sorted({(chunk_of[q], p) for q in qs for p in range(spread[q])})]
    wanted = [(q, chunk_of[q], c, s) for c, qs in visits.items() for q in qs for s in range(salts[c])]
    spark = rows.sparkSession
    met = spark.createDataFrame(meetings, "cell BIGINT, salt INT, chunk INT, part INT")
    asked = spark.createDataFrame(wanted, "cell BIGINT, chunk INT, block BIGINT, salt INT")
    salt_of = F.create_map(*[F.lit(x) for c, n in salts.items() for x in (c, n)])
    part_of = F.create_map(*[F.lit(x) for c, n in spread.items() for x in (c, n)])
    candidates = placed.withColumn("salt", F.pmod(F.xxhash64("vec_id"), salt_of[F.col("cell")]).cast("int"))
    candidates = candidates.join(met, ["cell", "salt"]).select("chunk", "part", F.col("cell").alias("block"), "salt", "vec_id", "v")
    queries = placed.where(F.col("vec_id") % every == 0).withColumn("part", F.pmod(F.xxhash64("vec_id"), part_of[F.col("cell")]).cast("int"))
    queries = queries.join(asked, "cell").select(
        "chunk", "part", "block", "salt", F.col("vec_id").alias("query_id"), F.col("v").alias("asked"), "floor")
    keys, ddl = ["chunk", "part", "block", "salt"], "query_id BIGINT, vec_id BIGINT, score BIGINT"

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = arrow_schema(ddl)
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        asking, ids = left.column("query_id").to_numpy(), right.column("vec_id").to_numpy()
        best = Best(asking, left.column("floor").to_numpy(), k)
        dual_search(matrix(left.column("asked")), matrix(right.column("v")), ids, best)
        q, r = np.nonzero((best.found < np.iinfo(np.int64).max) & (best.scores > LOWEST) & (best.scores >= best.floors[:, None]))
        return pa.Table.from_arrays([pa.array(asking[q]), pa.array(best.found[q, r]), pa.array(best.scores[q, r])], schema=schema)

    found = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(search, ddl)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
