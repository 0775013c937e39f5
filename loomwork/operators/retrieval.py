"""BM25 and dense scoring, rank fusion and collapse. Query sides are small tables; corpora stay distributed.

Filters come before ranking: give ``allowed`` and the corpus is semi-joined before it is scored. Corpus statistics always cover the whole
index, as a mask must not change a row's score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import tokenize
from ..sources.scratch import written

# Fixed values of the ranking functions.
K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K, DEPTH, POOL, RULES_POOL, LOGGED = 60, 200, 100, 40, 50

#: Bytes of a table up to which it is broadcast, and what a row counts at least.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 16
#: Query vectors that meet the corpus at once.
QUERY_BLOCK = 20_000
#: Pairs of query and row that a task scores at once, and rows of a result that it passes on at once.
TILE, PASSED = 1_000_000, 50_000
#: Rows of a tile.
ROWS = 4_000


def row_bytes(df: DataFrame) -> Column:
    """About the bytes that a row has in memory."""
    out = F.lit(ROW_BYTES)
    for f in df.schema.fields:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        if kind in ("string", "binary"):
            out = out + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind == "array<string>":
            out = out + F.coalesce(F.octet_length(F.array_join(c, "")) + 8 * F.size(c), F.lit(0))
        elif kind.startswith("array<") and "<" not in kind[6:]:
            out = out + 8 * F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
        elif "<" in kind:
            out = out + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        else:
            out = out + 8
    return out


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows are known to have at most ``limit`` bytes together; beyond, Spark shuffles both sides."""
    most = limit // ROW_BYTES
    rows, size = df.select(row_bytes(df).cast("long").alias("b")).limit(most + 1).agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0))).head()
    return F.broadcast(df) if rows <= most and size <= limit else df


def idf(df: DataFrame, n_docs: int, *also: str) -> DataFrame:
    """(token, df, idf, and the columns ``also``) of ``df`` (token, df): Okapi's, negative values replaced by ``EPSILON`` times the mean over the vocabulary."""
    raw = df.withColumn("raw", F.log(F.lit(float(n_docs)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("token", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"), *also)  # one row


def bm25(docs: DataFrame, id_: str, text: str, queries: DataFrame, query_id: str, query_text: str, allowed: DataFrame | None = None) -> DataFrame:
    """(query, doc, score) with score > 0. A token that a query has twice counts twice. One pass over the corpus writes the postings of the
    queries' tokens, with a row a document for the totals; a second one is made only where some of them are in more than half of all
    documents, whose weight is a share of the vocabulary's mean. ``inverted`` stores an index once, for many sets of queries."""
    wanted = queries.select(F.col(query_id).alias("query"), F.explode(tokenize(F.col(query_text))).alias("token")).groupBy("query", "token").agg(F.count("*").alias("qtf"))
    tokens = docs.select(F.col(id_).alias("doc"), F.coalesce(tokenize(F.col(text)), F.array().cast("array<string>")).alias("tokens")).select("doc", "tokens", F.size("tokens").alias("dl"))
    asked = small(wanted.select(F.col("token").alias("a")).distinct())
    # Null stands for the document itself.
    each = tokens.select("doc", "dl", F.explode(F.concat(F.array(F.lit(None).cast("string")), "tokens")).alias("token"))
    met = each.join(asked, F.col("token") == F.col("a"), "left").where("token is null or a is not null")
    posts = written(met.groupBy("doc", "dl", "token").agg(F.count("*").alias("tf")), "postings")
    n, total = posts.where("token is null").agg(F.sum("tf"), F.sum(F.col("dl") * F.col("tf"))).head()
    posts = posts.where("token is not null")
    df = written(posts.groupBy("token").agg(F.count("*").alias("df")), "document-frequencies")

    def vocabulary() -> DataFrame:
        return tokens.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))

    return _scored(posts, df, vocabulary, n or 0, total or 0, wanted, allowed)


def _scored(posts: DataFrame, df: DataFrame, vocabulary: Callable[[], DataFrame], n: int, total: int, wanted: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """``bm25`` of ``posts`` (doc, dl, token, tf) and ``df`` (token, df), which may hold the queries' tokens alone. ``vocabulary`` makes all."""
    if df.where(F.col("df") > n / 2).isEmpty():
        weighted = df.select("token", (F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    else:
        weighted = idf(vocabulary(), n).join(small(df.select("token")), "token", "left_semi").select("token", "idf")
    weights = small(wanted.join(weighted, "token"))
    if allowed is not None:
        posts = posts.join(small(allowed.select(F.col(allowed.columns[0]).alias("doc")).distinct()), "doc", "left_semi")
    tf, dl, avgdl = F.col("tf"), F.col("dl"), total / max(1, n)
    part = F.col("qtf") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
    return posts.join(weights, "token").groupBy("query", "doc").agg(F.sum(part).alias("score")).where("score > 0")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Length of a vector; 1 for the zero vector, so that it stays zero when divided."""
    n = F.sqrt(F.aggregate(a.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))
    return F.when(n == 0, 1.0).otherwise(n)


def normalized(a: Column) -> Column:
    n = norm(a)
    return F.transform(a.cast("array<double>"), lambda x: x / n)


def rounded(x: np.ndarray, digits: int = 9) -> np.ndarray:
    """``x`` to so many digits, halves away from zero; no negative zero."""
    return np.copysign(np.floor(np.abs(x) * 10.0**digits + 0.5), x) / 10.0**digits + 0.0


class Nearest:
    """The best ``depth`` rows of each of ``n`` queries among those that one task has met, by the score to nine digits, then by id: what a task
    holds and passes on is bounded by queries and depth, however many rows it reads and however many tie. Scores are given in tiles of
    at most ``TILE`` pairs."""

    def __init__(self, n: int, depth: int) -> None:
        self.depth, self.last, self.held = depth, np.full(n, -np.inf), {}

    def tiles(self, rows: int) -> Iterator[tuple[int, int]]:
        """First and last query of tiles with so many rows; the same queries each time, so that tiles have states of their own."""
        step = max(1, TILE // max(1, rows))
        for start in range(0, len(self.last), step):
            yield start, min(len(self.last), start + step)

    def add(self, start: int, docs: pa.Array, s: np.ndarray) -> None:
        """``s``: a row a query from ``start`` on, a column a doc; -inf and NaN are no result."""
        stop, n = start + len(s), s.shape[1]
        floor = self.last[start:stop]
        if n > self.depth:
            kth = -np.partition(-s, self.depth - 1, axis=1)[:, self.depth - 1]  # NaN goes last
            floor = np.fmax(floor, kth)
        # Wider than what rounding can move.
        q, r = np.nonzero((s >= floor[:, None] - 2e-9) & (s > -np.inf))
        if not len(q):
            return
        new = pa.table({"query": pa.array((q + start).astype(np.int32)), "doc": docs.take(pa.array(r)), "score": pa.array(rounded(s[q, r]))})
        rows = pa.concat_tables([self.held[start], new]) if start in self.held else new
        order = pc.sort_indices(rows, sort_keys=[("query", "ascending"), ("score", "descending"), ("doc", "ascending")], null_placement="at_start")
        rows = rows.take(order)
        at = rows["query"].to_numpy()
        place = np.arange(len(at)) - np.searchsorted(at, at)
        full = place == self.depth - 1
        self.last[at[full]] = rows["score"].to_numpy()[full]
        self.held[start] = rows.filter(pa.array(place < self.depth)).combine_chunks()

    def batches(self) -> Iterator[pa.RecordBatch]:
        """(query, doc, score) of all that is held."""
        for rows in self.held.values():
            yield from rows.to_batches(max_chunksize=PASSED)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def dense(vectors: DataFrame, id_: str, vector: str, queries: DataFrame, query_id: str, query_vector: str, depth: int = DEPTH, allowed: DataFrame | None = None) -> DataFrame:
    """(query, doc, score, rank): cosine similarity of each query with each vector, the best ``depth``. ``queries`` meets the vectors in
    tiles by matrix product; a task passes on its best ``depth`` a query only. The driver holds at most about ``QUERY_BLOCK``
    queries: more are dealt by the hashes of their ids into blocks, each of which is a job that is written before the next begins."""
    blocks = 1 + queries.count() // QUERY_BLOCK
    if blocks > 1:
        out = None
        for b in range(blocks):
            own = queries.where(F.pmod(F.xxhash64(F.col(query_id)), F.lit(blocks)) == b)
            found = written(_dense_block(vectors, id_, vector, own, query_id, query_vector, depth, allowed), "dense")
            out = found if out is None else out.union(found)
        return out
    return _dense_block(vectors, id_, vector, queries, query_id, query_vector, depth, allowed)


def _dense_block(vectors: DataFrame, id_: str, vector: str, queries: DataFrame, query_id: str, query_vector: str, depth: int, allowed: DataFrame | None) -> DataFrame:
    named = queries.select(F.col(query_id).alias("q"), F.col(query_vector).cast("array<double>").alias("v")).where("v is not null").orderBy("q").collect()
    kind = dict(queries.select(F.col(query_id).alias("q")).dtypes)["q"]
    doc_kind = dict(vectors.select(F.col(id_).alias("d")).dtypes)["d"]
    if not named:
        return vectors.sparkSession.createDataFrame([], f"query {kind}, doc {doc_kind}, score double, rank int")
    ids = [r["q"] for r in named]
    m = np.array([r["v"] for r in named], np.float64)
    lengths = np.linalg.norm(m, axis=1, keepdims=True)
    m /= np.where(lengths == 0, 1, lengths)
    dim = m.shape[1]
    sent = vectors.sparkSession.sparkContext.broadcast(m)  # at most about QUERY_BLOCK vectors

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        best = Nearest(len(asked), depth)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                v = matrix(batch.column("v"), dim)
                n = np.linalg.norm(v, axis=1, keepdims=True)
                v = v / np.where(n == 0, 1, n)
                for a, b in best.tiles(ROWS):
                    best.add(a, batch.column("doc"), asked[a:b] @ v.T)
        for rows in best.batches():
            yield pa.RecordBatch.from_arrays(rows.columns, names=["qi", "doc", "score"])

    rows = vectors.select(F.col(id_).alias("doc"), F.col(vector).cast("array<double>").alias("v")).where(F.size("v") == dim)
    if allowed is not None:
        rows = rows.join(small(allowed.select(F.col(allowed.columns[0]).alias("doc")).distinct()), "doc", "left_semi")
    found = rows.mapInArrow(scored, f"qi int, doc {doc_kind}, score double")
    by = vectors.sparkSession.createDataFrame(list(enumerate(ids)), f"qi int, query {kind}")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("qi").orderBy(F.desc("score"), "doc"))).where(F.col("rank") <= depth)
    return ranked.join(small(by), "qi").select("query", "doc", "score", "rank")


def ranked(scores: DataFrame, depth: int = DEPTH, by: tuple[str, ...] = ("query",), id_: str = "doc") -> DataFrame:
    """Adds rank 1.. by score, then id; the best ``depth``. Spark keeps the best of each partition before the shuffle."""
    return scores.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), id_))).where(F.col("rank") <= depth)


def fuse(lists: DataFrame, k: int = RRF_K, weight: str | None = None) -> DataFrame:
    """Weighted reciprocal rank fusion of ``lists`` (query, list, entity, row, rank[, weight]): an entity counts once a list, with its
    best row's rank among all rows. (query, entity, score, lists, best_row)."""
    w = F.col(weight) if weight else F.lit(1.0)
    best = lists.groupBy("query", "list", "entity").agg(F.min(F.struct("rank", F.col("row").alias("row"), w.cast("double").alias("w"))).alias("b"))
    return best.groupBy("query", "entity").agg(F.sum(F.col("b.w") / (k + F.col("b.rank"))).alias("score"), F.count("*").alias("lists"), F.min_by("b.row", F.struct("b.rank", "b.row")).alias("best_row"))


def collapse(scores: DataFrame, group: str, by: tuple[str, ...] = ("query",), id_: str = "entity") -> DataFrame:
    """The best row of each group, ties to the least id."""
    return scores.withColumn("_k", F.row_number().over(W.partitionBy(*by, group).orderBy(F.desc("score"), id_))).where("_k = 1").drop("_k")


def located(fused: DataFrame, chunks: DataFrame, row: str = "row") -> DataFrame:
    """``fused`` with where its best row stands: matched_row, matched_face_index, matched_ordinal and matched_kind. ``chunks``: (row, face_index,
    ordinal, kind)."""
    at = chunks.select(F.col(row).alias("matched_row"), *(F.col(c).alias(f"matched_{c}") for c in ("face_index", "ordinal", "kind")))
    return fused.join(at, F.col("best_row") == F.col("matched_row"), "left")


def pool(scores: DataFrame, size: int = POOL, by: tuple[str, ...] = ("query",), id_: str = "entity") -> DataFrame:
    return ranked(scores, size, by, id_)


def mean_vectors(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, vector): the mean of a group's unit vectors, normalised."""
    at = rows.select(group, F.posexplode(normalized(F.col(vector))).alias("i", "x")).groupBy(group, "i").agg(F.avg("x").alias("x"))
    means = at.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))
    return means.select(group, normalized(F.col("vector")).alias("vector"))


def contributions(lists: DataFrame, k: int = RRF_K, weight: str | None = None) -> DataFrame:
    """(query, method, entity, score, layer): what each method alone gives an entity, and the layer of the best row that it found for it.
    ``lists``: as for ``fuse``, with method and layer. Rows of equal rank go by the order of the lists."""
    w = F.col(weight) if weight else F.lit(1.0)
    best = lists.groupBy("query", "method", "list", "entity").agg(F.min(F.struct("rank", F.col("row").alias("row"), "layer", w.cast("double").alias("w"))).alias("b"))
    return best.groupBy("query", "method", "entity").agg(F.sum(F.col("b.w") / (k + F.col("b.rank"))).alias("score"), F.min_by("b.layer", F.struct("b.rank", "list")).alias("layer"))


def logged(lists: DataFrame, fused: DataFrame, weight: str | None = None, start: int = 1, digits: int = 12) -> DataFrame:
    """(query, id, rank, score, method, layer), rows of the retrieval log: the ``LOGGED`` entities that each method alone gives most, with the
    layer that gave it, and the pool of the fused list. ``start``: the rank of the pool's first, where a wider pool goes on from an earlier one.
    Scores are compared when rounded, so that sums in another order do not change the log."""
    rounded = F.round("score", digits).alias("score")
    own = contributions(lists, weight=weight).select("query", "method", "entity", rounded, "layer")
    first = ranked(own, LOGGED, ("query", "method"), "entity")
    joint = ranked(fused.select("query", "entity", rounded), POOL, ("query",), "entity")
    rows = first.select("query", F.col("entity").alias("id"), "rank", "score", "method", "layer")
    return rows.union(joint.select("query", F.col("entity").alias("id"), F.col("rank") + (start - 1), "score", F.lit("rrf"), F.lit("fused")))


def built(props: DataFrame, embeddings: DataFrame, key: str, vector: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """(index rows with unit vectors, counters): props joined with their vectors. Vectors of another length are left out and counted, and
    so are props without one."""
    joined = props.join(embeddings.select(F.col(key).alias("_k"), F.col(vector).alias("_v")), F.col(key) == F.col("_k"), "left")
    kept = joined.where(F.size("_v") == dim).withColumn("vector", normalized(F.col("_v"))).drop("_k", "_v")
    flags = joined.agg(
        F.sum((F.size("_v") == dim).cast("long")).alias("rows"), F.sum(F.col("_v").isNull().cast("long")).alias("missing"), F.sum((F.col("_v").isNotNull() & (F.size("_v") != dim)).cast("long")).alias("wrong_length")
    )
    return kept, flags


def nested(parents: DataFrame, children: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """``parents`` with ``children``, an array of structs in order; empty where there is none."""
    own = children.groupBy(F.col(key).alias("_k")).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("children"))
    return parents.join(own, F.col(key) == F.col("_k"), "left").drop("_k").withColumn("children", F.coalesce("children", F.array().cast(own.schema["children"].dataType)))
