"""What several operators of this subpackage use: tables, the shared folder, hashing of words."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.scratch import root


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until ``df`` has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def saved(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: this cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{root(spark)}/loomwork/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomwork_path = path
    return out


#: A side of a join is broadcast up to so many bytes (Spark's own default); beyond, both sides are shuffled.
BROADCAST_BYTES = 10 << 20
#: Of rows with one key in a join, more than one in so many are hot. There are at most so many hot keys, whatever the input.
HOT_SHARE = 10_000


def bounded(df: DataFrame, row_bytes: Column | int = 100, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows, of ``row_bytes`` each, add up to at most ``limit`` bytes. The caller has ``df`` saved, or
    cheap to make twice. Without the hint Spark plans a shuffle join and splits what is skewed."""
    if isinstance(row_bytes, int):
        small = df.limit(limit // row_bytes + 1).count() <= limit // row_bytes
    else:
        small = (df.agg(F.sum(row_bytes)).head()[0] or 0) <= limit
    return F.broadcast(df) if small else df


def split_join(left: DataFrame, right: DataFrame, on: list[Column] | Column, hot: Column, how: str = "inner", row_bytes: Column | int = 100) -> DataFrame:
    """``left`` joined to ``right``, one row a key, without sending a hot key's rows to one task: rows of ``right`` that are ``hot``, of which
    the caller knows that there are at most ``HOT_SHARE``, are broadcast; the others are too if they are few. Both sides are saved or cheap."""
    common = F.broadcast(right.where(hot))
    return left.join(common, on).union(left.join(common, on, "left_anti").join(bounded(right.where(~hot), row_bytes), on, how))


def hot(count: Column, total: int) -> Column:
    """Whether a key's ``count`` rows are more than one in ``HOT_SHARE`` of ``total``: true of at most ``HOT_SHARE`` keys."""
    return count > F.lit(max(1, total // HOT_SHARE))


#: Rows that one row is blown up to in one go.
UNFOLDED_TOGETHER = 10_000


def unfolded(df: DataFrame, n: str, most: int) -> DataFrame:
    """Each row of ``df`` as often as its column ``n``, at most ``most``, says; instead of that column ``at`` counts from 0. What large numbers
    make is dealt to many tasks."""
    zero, end = F.lit(0).cast("long"), F.col(n) - 1
    if most <= UNFOLDED_TOGETHER:
        return df.withColumn("at", F.explode(F.sequence(zero, end))).drop(n)
    df = saved(df, "folded")
    few = df.where(F.col(n) <= UNFOLDED_TOGETHER).withColumn("at", F.explode(F.sequence(zero, end)))
    blocks = df.where(F.col(n) > UNFOLDED_TOGETHER).withColumn("at", F.explode(F.sequence(zero, end, F.lit(UNFOLDED_TOGETHER).cast("long")))).repartition("at")
    return few.union(blocks.withColumn("at", F.explode(F.sequence(F.col("at"), F.least(F.col("at") + UNFOLDED_TOGETHER - 1, end))))).drop(n)


def numbered(rows: DataFrame, by: str, order: list[str], together: int, most_deals: int) -> DataFrame:
    """``rows`` with ``number``, gapless from 0 within each value of ``by``, and without an order that means anything. Equal rows are one with a
    count, and get their numbers by arithmetic. Groups of about ``together`` rows are dealt by the hash of ``order``, which tells rows of one
    ``by`` apart and on which nothing else depends: a task that runs again deals alike. About ``most_deals`` sums are broadcast, no more."""
    folded = saved(rows.groupBy(*rows.columns).agg(F.count("*").alias("copies")), "distinct")
    sizes = {r[by]: r["n"] for r in folded.groupBy(by).agg(F.count("*").alias("n")).collect()}  # by has as few values as its callers say
    most = folded.agg(F.max("copies")).head()[0] or 1
    together = max(together, sum(sizes.values()) // most_deals)
    kind = rows.schema[by].dataType.simpleString()
    deals = rows.sparkSession.createDataFrame([(v, 1 + n // together) for v, n in sizes.items()], f"d_by {kind}, deals long")
    dealt = folded.join(F.broadcast(deals), F.col(by) == F.col("d_by")).withColumn("deal", F.pmod(F.xxhash64(*order), F.col("deals"))).drop("d_by", "deals")
    counts = dealt.groupBy(F.col(by).alias("b_by"), F.col("deal").alias("b_deal")).agg(F.sum("copies").alias("n"))
    before = counts.select("b_by", "b_deal", (F.sum("n").over(W.partitionBy("b_by").orderBy("b_deal")) - F.col("n")).alias("before"))
    upto = F.sum("copies").over(W.partitionBy(by, "deal").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    ranked = dealt.withColumn("own", upto - F.col("copies")).join(F.broadcast(before), (F.col(by) == F.col("b_by")) & (F.col("deal") == F.col("b_deal")))
    placed = ranked.withColumn("first", F.col("before") + F.col("own")).select(*rows.columns, "first", "copies")
    return unfolded(placed, "copies", most).withColumn("number", F.col("first") + F.col("at")).drop("first", "at")


def in_order(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``rows``, which are saved, with ``place``: gapless from 0 within each value of ``by``, in ``order`` (nulls first), which tells rows apart.
    Rows are dealt by ranges of all these columns, so that a hot value is many ranges; the ranges are written, so that a task that runs again
    finds the same. Sums are sent only of values that span ranges: no more than there are ranges."""
    range_, own, before, b_by, b_range = unused(rows, "range", "own", "before", "b_by", "b_range")
    dealt = saved(rows.repartitionByRange(by, *order).withColumn(range_, F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(F.col(by).alias(b_by), F.col(range_).alias(b_range)).agg(F.count("*").alias("n"))
    sums = counts.select(b_by, b_range, (F.sum("n").over(W.partitionBy(b_by).orderBy(b_range)) - F.col("n")).alias(before)).where(F.col(before) > 0)
    placed = dealt.withColumn(own, F.row_number().over(W.partitionBy(by, range_).orderBy(*order)) - 1)
    joined = placed.join(F.broadcast(sums), (F.col(by) == F.col(b_by)) & (F.col(range_) == F.col(b_range)), "left")
    return joined.select(*rows.columns, (F.col(own) + F.coalesce(before, F.lit(0))).cast("long").alias("place"))


#: Bytes of an Arrow batch between Spark and Python, where the session has no setting of its own. Texts may be very long, so rows are no bound.
BATCH_BYTES = 8_000_000


def modest_batches(df: DataFrame) -> DataFrame:
    """``df``; its session's Arrow batches are bounded by bytes, unless the session was set to other than Spark's default of 64 MB."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key).rstrip("b") == str(64 << 20):
        conf.set(key, str(BATCH_BYTES))
    return df


def dropped(df: DataFrame) -> None:
    """Delete what ``saved`` wrote for ``df``. Only for tables that no later plan reads."""
    spark, path = df.sparkSession, df._loomwork_path
    spark.catalog.refreshByPath(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def tidily(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run``, and at its end unused memory goes back to the system: a worker lives on, beside those of other stages."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for memory in WordHashes.made:
                memory.clear()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return tidied


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, cut further so that long texts (the column ``text``) do not pile up."""
    for batch in batches:
        lengths = np.diff(np.asarray(_offsets(batch.column("text")), dtype=np.int64))
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if i > start and (i - start >= rows or held + n > size):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(lengths):
            yield batch.slice(start)


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(1, kind)
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1]


class WordHashes(dict):
    """64-bit hash of each word (bytes), remembered for up to ``limit`` words, within a task."""

    made: ClassVar[list[WordHashes]] = []

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit = limit
        self.made.append(self)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive entries of ``h``; empty when there are fewer."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = mixed(h[: len(h) - n + 1])
    for i in range(1, n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return out
