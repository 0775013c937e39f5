"""The final choice: caps, diversity, fill-up, ordering."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

LAMBDA, CAP, DIVERSITY_POOL, PASS_FIT = 0.7, 2, 15, 0.5


def capped(rows: DataFrame, group: str, order: list, by: tuple[str, ...] = (), cap: int = CAP) -> DataFrame:
    """At most ``cap`` rows of a group, the first by ``order``."""
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(*by, group).orderBy(*order))).where(F.col("_k") <= cap).drop("_k")


def mmr_order(relevance: np.ndarray, vectors: np.ndarray, k: int, lam: float = LAMBDA) -> list[int]:
    """Positions by maximal marginal relevance, greedily; ties to the first. As they are if there are no more than ``k``."""
    n = len(relevance)
    if n <= k:
        return list(range(n))
    closest, chosen = np.full(n, -np.inf), []
    for _ in range(k):
        score = lam * relevance - (1 - lam) * (closest if chosen else np.zeros(n))
        score[chosen] = -np.inf
        best = int(np.argmax(score))
        chosen.append(best)
        closest = np.maximum(closest, vectors @ vectors[best])
    return chosen


def mmr(rows: DataFrame, by: str, id_: str, position: str, fit: str, vector: str, k: int | str, lam: float = LAMBDA, most: int = DIVERSITY_POOL) -> DataFrame:
    """(by, id, place): of each query's first ``most`` rows by position, k (a number, or the column that has it) by maximal marginal relevance. A
    group has at most ``most`` rows."""
    few = rows.withColumn("_k", F.row_number().over(W.partitionBy(by).orderBy(position, id_))).where(F.col("_k") <= most)
    kinds = dict(few.dtypes)

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_k")
        vectors = np.array(group[vector].tolist(), np.float64)
        order = mmr_order(group[fit].fillna(0.0).to_numpy(np.float64), vectors, int(group["_wanted"].iloc[0]), lam)
        out = group.iloc[order][[by, id_]]
        return out.assign(place=np.arange(1, len(out) + 1, dtype=np.int32))

    wanted = (F.col(k) if isinstance(k, str) else F.lit(k)).alias("_wanted")
    return few.select(by, id_, "_k", wanted, F.col(fit).cast("double").alias(fit), F.col(vector).cast("array<double>").alias(vector)).groupBy(by).applyInPandas(pick, f"{by} {kinds[by]}, {id_} {kinds[id_]}, place int")


def diversified(rows: DataFrame, by: str, id_: str, group: str, position: str, fit: str, vector: str, k: int | str) -> DataFrame:
    """Colour cap, first fifteen, then maximal marginal relevance."""
    return mmr(capped(rows, group, [F.col(position), F.col(id_)], (by,)), by, id_, position, fit, vector, k)


def by_fit(rows: DataFrame, fit: str, id_: str, by: tuple[str, ...], k: int) -> DataFrame:
    """The k of the best fit, those without one last."""
    order = W.partitionBy(*by).orderBy(F.col(fit).desc_nulls_last(), id_)
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def filled(rows: DataFrame, chosen: DataFrame, by: str, id_: str, group: str, fit: str, k: int) -> DataFrame:
    """``chosen`` (by, id, place), then stretches by fit under a cap of their own, up to k. Rows that a column ``rejected`` marks are none."""
    if "rejected" in rows.columns:
        rows = rows.where(~F.coalesce("rejected", F.lit(False)))
    rest = rows.join(chosen.select(by, id_), [by, id_], "left_anti")
    rest = capped(rest, group, [F.coalesce(F.col(fit), F.lit(-1.0)).desc(), F.col(id_)], (by,))
    both = chosen.select(by, id_, F.lit(0).alias("stretch"), F.col("place").cast("double").alias("key")).union(rest.select(by, id_, F.lit(1), -F.coalesce(F.col(fit), F.lit(-1.0))))
    return both.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy("stretch", "key", id_))).where(F.col("place") <= k).select(by, id_, "stretch", "place")


def pick_default(rows: DataFrame, group: str, digital: str | None, released: str, id_: str) -> DataFrame:
    """The newest row of each group among those that are not digital, else among all; ties to the largest id."""
    order = ([F.col(digital).cast("int")] if digital else []) + [F.desc(released), F.desc(id_)]
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(group).orderBy(*order))).where("_k = 1").drop("_k")


def passing_first(results: DataFrame, by: str, place: str = "place") -> DataFrame:
    """``results`` numbered anew: those that pass, then stretches, otherwise in the order they have."""
    order = W.partitionBy(by).orderBy(F.coalesce(F.col("stretch").cast("int"), F.lit(0)), place)
    return results.withColumn(place, F.row_number().over(order))
