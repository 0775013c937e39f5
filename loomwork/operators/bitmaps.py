"""Sets of entities as bitmaps over dense numbers: unions and intersections are Spark's bitmap aggregates, counts are of bits.

A set is rows (bucket, bits) of 4 KB for 32,768 entities; buckets without a member have no row. What a request wants is clauses, each a union
of values of one attribute, some of them negated; a request's set is the intersection of its clauses. Nothing is listed entity by
entity before it is asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..sources.scratch import written
from .filters import kept_filters

BYTES = 4096
#: Soft filters of a request at most; their conjunctions are counted together.
MOST_FILTERS = 10
#: The set of all entities.
ALL = "*"


def numbered(rows: DataFrame, id_: str) -> DataFrame:
    """(id, n): a gapless number from 1 for each distinct id, in order. Ids are dealt by ranges, which are written; the ranges' sizes are moved."""
    dealt = written(rows.select(F.col(id_).alias("id")).where("id is not null").distinct().repartitionByRange("id").withColumn("range", F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy(F.col("range").alias("b_range")).agg(F.count("*").alias("c"))
    before = sizes.select("b_range", (F.sum("c").over(W.orderBy("b_range")) - F.col("c")).alias("before"))  # a row a partition
    own = F.row_number().over(W.partitionBy("range").orderBy("id"))
    return dealt.withColumn("own", own).join(F.broadcast(before), F.col("range") == F.col("b_range")).select("id", (F.col("own") + F.col("before")).alias("n"))


def bitmaps(members: DataFrame, numbers: DataFrame) -> DataFrame:
    """(attribute, value, bucket, bits) of ``members`` (id, attribute, value), and of all numbers as ``ALL``."""
    held = members.select("id", "attribute", F.col("value").cast("string").alias("value")).join(numbers, "id").select("attribute", "value", "n")
    every = numbers.select(F.lit(ALL).alias("attribute"), F.lit(ALL).alias("value"), "n")
    return held.unionByName(every).groupBy("attribute", "value", F.bitmap_bucket_number("n").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("bits"))


@F.pandas_udf(T.BinaryType())
def without(bits: pd.Series, others: pd.Series) -> pd.Series:
    """``bits`` that are not in ``others``; null is the empty set."""
    return pd.Series([a if b is None else (np.frombuffer(a, np.uint8) & ~np.frombuffer(b, np.uint8)).tobytes() for a, b in zip(bits, others, strict=True)])


@F.pandas_udf(T.ArrayType(T.LongType()))
def _numbers(bucket: pd.Series, bits: pd.Series) -> pd.Series:
    """The numbers that are in a bucket's bits, the lowest bit of a byte first."""
    return pd.Series([np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little")) + (b - 1) * BYTES * 8 + 1 for b, x in zip(bucket, bits, strict=True)])


def chosen(maps: DataFrame, clauses: DataFrame) -> DataFrame:
    """(query, bucket, bits) of ``clauses`` (query, clause, attribute, value, negated): what has, for each clause of a query, any of its values,
    or none of them where it is negated. A clause of a value that nothing has is the empty set."""
    clauses = clauses.select("query", "clause", "attribute", F.col("value").cast("string").alias("value"), "negated")
    positive = clauses.where("not negated")
    # What is only negated is taken from all.
    bare = clauses.groupBy("query").agg(F.min("negated").alias("bare")).where("bare").select("query", F.lit(ALL).alias("clause"), F.lit(ALL).alias("attribute"), F.lit(ALL).alias("value"))
    wanted = positive.select("query", F.col("clause").cast("string").alias("clause"), "attribute", "value").unionByName(bare)
    need = wanted.groupBy("query").agg(F.count_distinct("clause").alias("need"))
    each = wanted.join(maps, ["attribute", "value"]).groupBy("query", "clause", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    both = each.groupBy("query", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n")).join(need, "query").where("n = need")
    barred = clauses.where("negated").join(maps, ["attribute", "value"]).groupBy("query", "bucket").agg(F.bitmap_or_agg("bits").alias("barred"))
    return both.join(barred, ["query", "bucket"], "left").select("query", "bucket", without("bits", "barred").alias("bits")).where(F.bitmap_count("bits") > 0)


def sizes(sets: DataFrame) -> DataFrame:
    """(query, n): members of each set that has any."""
    return sets.groupBy("query").agg(F.sum(F.bitmap_count("bits")).alias("n"))


def listed(sets: DataFrame, numbers: DataFrame) -> DataFrame:
    """(query, id): the members of sets, entity by entity."""
    return sets.select("query", F.explode(_numbers("bucket", "bits")).alias("n")).join(numbers, "n").select("query", "id")


def soft(sets: DataFrame, filters: DataFrame, floor: int = 0, drop_empty: bool = True) -> tuple[DataFrame, DataFrame]:
    """``sets`` (query, bucket, bits) under as many of each query's ``filters`` (query, position, name, bucket, bits) as ``filters.soft`` would
    keep, and (query, kept, notes). ``filters`` has a row without bucket for each filter, so that one that nothing matches is known. All
    conjunctions of a query's filters are counted in one pass over its bitmaps."""
    names = filters.groupBy("query").agg(F.array_sort(F.collect_set(F.struct("position", "name"))).alias("names"))
    own = filters.where("bucket is not null").groupBy("query", "bucket").agg(F.array_sort(F.collect_list(F.struct("position", "bits"))).alias("own"))
    held = sets.join(names, "query").join(own, ["query", "bucket"], "left")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for query, bits, names_, own_ in zip(batch["query"], batch["bits"], batch["names"], batch["own"], strict=True):
                places = {x["position"]: i for i, x in enumerate(names_)}
                if len(places) > MOST_FILTERS:
                    raise ValueError(f"a request has more than {MOST_FILTERS} soft filters")
                have = {places[x["position"]]: np.frombuffer(x["bits"], np.uint8) for x in (own_ if own_ is not None else [])}
                sets_ = [np.frombuffer(bits, np.uint8)]  # by the mask of filters
                for i in range(len(places)):
                    sets_ += [s & have[i] if i in have else np.zeros(BYTES, np.uint8) for s in sets_]
                out += [(query, m, int(np.unpackbits(s).sum())) for m, s in enumerate(sets_)]
            yield pd.DataFrame(out, columns=["query", "mask", "n"])

    kind = dict(sets.dtypes)["query"]
    counts = held.select("query", "bits", "names", "own").mapInPandas(counted, f"query {kind}, mask int, n long").groupBy("query", "mask").agg(F.sum("n").alias("n"))

    def decided(group: pd.DataFrame) -> pd.DataFrame:
        names_ = [x["name"] for x in group["names"].iloc[0]]
        n = dict(zip(group["mask"], group["n"], strict=True))
        notes: list[str] = []
        kept = kept_filters(names_, lambda chosen_: int(n[sum(1 << i for i in chosen_)]), floor, drop_empty, notes)
        return pd.DataFrame({"query": [group["query"].iloc[0]], "kept": [kept], "notes": [notes]})

    choice = written(counts.join(names, "query").groupBy("query").applyInPandas(decided, f"query {kind}, kept array<string>, notes array<string>"), "soft-choice")
    want = choice.select("query", F.explode("kept").alias("name"))
    need = want.groupBy("query").agg(F.count("*").alias("need"))
    both = filters.where("bucket is not null").join(want, ["query", "name"]).select("query", "bucket", "bits").unionByName(sets.join(need, "query").select("query", "bucket", "bits"))
    under = both.groupBy("query", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n")).join(need, "query").where("n = need + 1").select("query", "bucket", "bits")
    return sets.join(need, "query", "left_anti").select("query", "bucket", "bits").unionByName(under).where(F.bitmap_count("bits") > 0), choice
