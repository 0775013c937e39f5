"""A stored vector index with exact bounds: rows in cells around centroids, and searches that read the cells which can hold a result.

Centroids are fitted on a bounded sample, every row is assigned. For unit vectors, cosine order is the order of distances, so by the triangle
inequality a row at distance d from its centroid is no nearer to a query than the difference of d and the query's own distance from
it. A search scores the nearest cells whole, which bounds the distance of each query's last result, then the cells that reach within it,
and of those the rows that do. Nothing is approximate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .retrieval import DEPTH, ROWS, Nearest, matrix, normalized, ranked, small

#: Rows that centroids are fitted on, and rounds of fitting.
SAMPLE, ROUNDS = 20_000, 10
#: Rows that a cell shall have, and cells at most.
CELL_ROWS, MOST_CELLS = 2_000, 4_096
#: Numbers that the driver and each task hold of the queries, of their distances from the centroids, and of their results.
HELD = 8_000_000
EDGE = 1e-6


@dataclass
class VectorIndex:
    """``rows``: (cell, id, vector: unit, apart: distance from the centroid); ``cells``: (cell, centroid, nearest, farthest, n)."""

    rows: DataFrame
    cells: DataFrame


def fit(vectors: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Centroids, unit vectors, by rounds of assignment and mean."""
    rng = np.random.default_rng(seed)
    found = vectors[rng.choice(len(vectors), min(cells, len(vectors)), replace=False)].copy()
    for _ in range(ROUNDS):
        own = np.argmax(vectors @ found.T, axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, own, vectors)
        n = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(n > 0, sums / np.where(n > 0, n, 1), found)
    return found


def build(vectors: DataFrame, id_: str, vector: str, dim: int, cells: int | None = None) -> VectorIndex:
    """The index of the vectors of ``dim`` numbers. The sample is of those whose id has the least hashes, so it is the same each time."""
    held = vectors.select(F.col(id_).alias("id"), normalized(F.col(vector)).alias("vector")).where(F.size("vector") == dim)
    n = held.count()
    cells = cells or max(1, min(MOST_CELLS, n // CELL_ROWS, SAMPLE // 4))
    sample = np.array([r["vector"] for r in held.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").collect()], np.float64).reshape(-1, dim)
    centroids = fit(sample, cells) if len(sample) else np.zeros((1, dim))
    sent = vectors.sparkSession.sparkContext.broadcast(centroids)  # at most MOST_CELLS vectors
    kind = dict(held.dtypes)["id"]

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for batch in batches:
            v = matrix(batch.column("vector"), dim)
            s = v @ c.T
            own = np.argmax(s, axis=1).astype(np.int32)
            apart = np.linalg.norm(v - c[own], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(own), batch.column("id"), batch.column("vector"), pa.array(apart)], names=["cell", "id", "vector", "apart"])

    rows = written(held.mapInArrow(assigned, f"cell int, id {kind}, vector array<double>, apart double"), "assigned")
    where = vectors.sparkSession.createDataFrame([(i, x.tolist()) for i, x in enumerate(centroids)], "cell int, centroid array<double>")
    spans = rows.groupBy("cell").agg(F.min("apart").alias("nearest"), F.max("apart").alias("farthest"), F.count("*").alias("n"))
    return VectorIndex(rows, spans.join(F.broadcast(where), "cell").select("cell", "centroid", "nearest", "farthest", "n"))


def stored(index: VectorIndex, replace: Callable[..., DataFrame], name: str) -> VectorIndex:
    """``index`` written by ``replace``, rows in a folder a cell; a large cell is many files."""
    return VectorIndex(replace(f"{name}_rows", index.rows.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))), ("cell",)), replace(f"{name}_cells", index.cells))


def topk(index: VectorIndex, queries: DataFrame, query_id: str, query_vector: str, depth: int = DEPTH, group: str | None = None, allowed: DataFrame | None = None, report: dict | None = None) -> DataFrame:
    """(query, doc, score, rank): the ``depth`` nearest by cosine, scores rounded to nine digits, ties by id. With ``allowed`` (group, id), a query
    whose column ``group`` is not null meets the ids of its group alone. The queries are broadcast as one matrix of at most ``HELD`` numbers;
    more are dealt by the hash of their ids into blocks. ``report`` gets the numbers of pairs of query and row: all, and those scored."""
    cells = index.cells.orderBy("cell").collect()  # at most MOST_CELLS
    each = depth + len(cells) + (len(cells[0]["centroid"]) if cells else 0)
    blocks = 1 + queries.count() * each // HELD
    out = None
    for b in range(blocks):
        own = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(F.col(query_id)), F.lit(blocks)) == b)
        found = _block(index, cells, own, query_id, query_vector, depth, group, allowed, report)
        out = found if out is None else out.unionByName(found)
    return out


def _block(index: VectorIndex, cells: list, queries: DataFrame, query_id: str, query_vector: str, depth: int, group: str | None, allowed: DataFrame | None, report: dict | None) -> DataFrame:
    spark = index.rows.sparkSession
    kind, doc_kind = dict(queries.select(query_id).dtypes)[query_id], dict(index.rows.dtypes)["id"]
    named = queries.select(F.col(query_id).alias("q"), F.col(query_vector).cast("array<double>").alias("v"), (F.col(group) if group else F.lit(None)).cast("string").alias("g")).where("v is not null").orderBy("q").collect()
    if not named or not cells:
        return spark.createDataFrame([], f"query {kind}, doc {doc_kind}, score double, rank int")
    dim = len(cells[0]["centroid"])
    m = np.array([r["v"] for r in named], np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    m /= np.where(n == 0, 1, n)
    zero = n[:, 0] == 0  # a query of no direction is as near to every row
    groups = sorted({r["g"] for r in named if r["g"] is not None})
    own_group = np.array([groups.index(r["g"]) if r["g"] is not None else -1 for r in named])
    centroids = np.array([c["centroid"] for c in cells], np.float64)
    ids = np.array([c["cell"] for c in cells])
    far = np.linalg.norm(m, axis=1) ** 2
    apart = np.sqrt(np.maximum(0, far[:, None] + np.linalg.norm(centroids, axis=1)[None, :] ** 2 - 2 * m @ centroids.T))
    # The least distance that a row of a cell can have.
    least = np.maximum(0, np.maximum(apart - np.array([c["farthest"] for c in cells])[None, :], np.array([c["nearest"] for c in cells])[None, :] - apart))
    rows = index.rows
    if allowed is not None:
        numbers = spark.createDataFrame(list(enumerate(groups)), "gi int, g string")
        sets = allowed.select(F.col("group").cast("string").alias("g"), F.col("id").alias("a_id")).join(small(numbers), "g") if groups else None
        marks = None if sets is None else sets.groupBy("a_id").agg(F.collect_set("gi").alias("gs"))
        rows = rows.withColumn("gs", F.lit(None).cast("array<int>")) if marks is None else rows.join(small(marks), F.col("id") == F.col("a_id"), "left").drop("a_id")
    else:
        rows = rows.withColumn("gs", F.lit(None).cast("array<int>"))
    sent = spark.sparkContext.broadcast((m, apart, own_group, {int(c): i for i, c in enumerate(ids)}))

    def scored(wanted: np.ndarray, reach: np.ndarray) -> DataFrame:
        """Rows of the cells that a query wants, and of those the ones that can be within its ``reach``."""
        plan = spark.sparkContext.broadcast((wanted, reach))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vectors, apart_, own_group_, at = sent.value
            wanted_, reach_ = plan.value
            best = Nearest(len(vectors), depth)
            for whole in batches:
                for first_ in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(first_, ROWS)
                    v, c, d = matrix(batch.column("vector"), dim), np.array([at[x] for x in batch.column("cell").to_pylist()], np.int64), batch.column("apart").to_numpy()
                    gs = batch.column("gs")
                    of_group, of_row = gs.flatten().to_numpy(zero_copy_only=False).astype(np.int64), pc.list_parent_indices(gs).to_numpy(zero_copy_only=False)
                    for a, b in best.tiles(ROWS):
                        can = wanted_[a:b][:, c] & (np.abs(apart_[a:b][:, c] - d[None, :]) <= reach_[a:b, None] + EDGE)
                        if groups:
                            own, local = np.unique(own_group_[a:b], return_inverse=True)
                            marks_ = np.zeros((len(own), batch.num_rows), bool)
                            marks_[own == -1] = True  # queries of no group
                            i = np.minimum(np.searchsorted(own, of_group), len(own) - 1)
                            met_ = own[i] == of_group
                            marks_[i[met_], of_row[met_]] = True
                            can &= marks_[local]
                        if can.any():
                            best.add(a, batch.column("id"), np.where(can, vectors[a:b] @ v.T, -np.inf))
                        if report is not None:
                            met.add(int(can.sum()))
            yield from best.batches()

        touched = [int(x) for x in ids[wanted.any(axis=0)]]
        few = rows.where(F.col("cell").isin(touched)) if len(touched) < len(ids) else rows
        return written(few.mapInArrow(run, f"query int, doc {doc_kind}, score double"), "cell-scores")

    met = spark.sparkContext.accumulator(0)
    sizes = np.array([c["n"] for c in cells])
    order = np.argsort(apart, axis=1)
    enough = np.cumsum(sizes[order], axis=1) - sizes[order] < 2 * depth
    near = np.zeros_like(apart, bool)
    np.put_along_axis(near, order, enough, axis=1)
    near[zero] = True
    first = scored(near, np.full(len(named), np.inf))
    last = {r["query"]: r["score"] for r in ranked(first, depth).where(F.col("rank") == depth).select("query", "score").collect()}  # a number a query
    reach = np.array([np.sqrt(max(0.0, 2 - 2 * (last[i] - 1e-8))) if i in last else np.inf for i in range(len(named))])
    more = ~near & (least <= reach[:, None] + EDGE)
    both = first.unionByName(scored(more, reach)) if more.any() else first
    if report is not None:
        report["pairs"] = report.get("pairs", 0) + len(named) * int(sizes.sum())
        report["scored"] = report.get("scored", 0) + met.value
    by = spark.createDataFrame([(i, r["q"]) for i, r in enumerate(named)], f"qi int, q {kind}")
    return ranked(both, depth).join(F.broadcast(by), F.col("query") == F.col("qi")).select(F.col("q").alias("query"), "doc", "score", "rank")
