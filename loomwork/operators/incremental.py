"""Incremental work over snapshots: pending rows, orphans, changes, upserts. Keys are not null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def pending(rows: DataFrame, done: DataFrame, key: str, text: str | None = None) -> DataFrame:
    """Rows without a result yet, with text if a text column is named."""
    out = rows.join(done.select(key).distinct(), key, "left_anti")
    return out if text is None else out.where(F.length(F.trim(text)) > 0)


def pruned(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is there."""
    return children.join(parents.select(key).distinct(), key, "left_semi")


def changes(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """(key, change): new, changed, same or removed."""
    o, n = old.select(F.col(key).alias("_o"), F.col(text).alias("_ot")), new.select(F.col(key).alias("_n"), F.col(text).alias("_nt"))
    kind = F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "removed").when(F.col("_ot").eqNullSafe(F.col("_nt")), "same").otherwise("changed")
    return o.join(n, F.col("_o") == F.col("_n"), "full_outer").select(F.coalesce("_n", "_o").alias(key), kind.alias("change"))


def first_wins(existing: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """``existing`` and what it lacks of ``incoming``, of that the first of each key."""
    own = incoming.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(order))).where("_k = 1").drop("_k")
    return existing.unionByName(own.join(existing.select(key).distinct(), key, "left_anti"))


def last_wins(existing: DataFrame, incoming: DataFrame, key: list[str], order: str) -> DataFrame:
    """``existing`` with rows of the same key replaced by the last of ``incoming``."""
    own = incoming.withColumn("_k", F.row_number().over(W.partitionBy(*key).orderBy(F.desc(order)))).where("_k = 1").drop("_k")
    return existing.join(own.select(*key), key, "left_anti").unionByName(own)


def replaced_children(children: DataFrame, fresh: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children of surviving parents, with those of the parents in ``fresh`` replaced."""
    return pruned(children.join(fresh.select(key).distinct(), key, "left_anti"), parents, key).unionByName(fresh)


def cascaded(children: DataFrame, dependents: DataFrame, child: str) -> DataFrame:
    """Dependents of children that are there, such as the vectors of chunks."""
    return pruned(dependents, children, child)


def rechunked(parents: DataFrame, chunks: DataFrame, changed: DataFrame, key: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``chunks`` of the parents that are left, with those of parents that never had any, or changed, made anew by ``make``."""
    ids = to_rechunk(parents.select(key), chunks, changed, key)
    stale = chunks.join(ids, key, "left_anti")
    return pruned(stale, parents, key).unionByName(make(parents.join(ids, key, "left_semi")))


def to_rechunk(parents: DataFrame, chunks: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Parents that were never chunked, or changed."""
    never = parents.join(chunks.select(key).distinct(), key, "left_anti")
    return never.union(parents.join(changed.select(key).distinct(), key, "left_semi")).distinct()


def with_default(rows: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """``is_default`` made anew from the chosen rows; a flag of before does not survive."""
    return rows.drop("is_default").join(chosen.select(key).distinct().withColumn("_d", F.lit(True)), key, "left").withColumn("is_default", F.coalesce("_d", F.lit(False))).drop("_d")


def promoted(rows: DataFrame, group: str, id_: str) -> DataFrame:
    """Groups without a default row get one: the least id."""
    none = rows.where("is_default").select(group).distinct()
    least = rows.join(none, group, "left_anti").groupBy(group).agg(F.min(id_).alias(id_)).select(id_).withColumn("_p", F.lit(True))
    return rows.join(least, id_, "left").withColumn("is_default", F.col("is_default") | F.coalesce("_p", F.lit(False))).drop("_p")


def fingerprint(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(name, rows, last): what a change of any table shows in."""
    parts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.max(key).cast("string").alias("last")) for name, (df, key) in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
