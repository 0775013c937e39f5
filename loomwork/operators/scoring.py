"""Composite scores, percentiles and quantile bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.scratch import written

# Weights of the composite score.
WEIGHTS = {"popularity": 0.4, "price": 0.25, "cost": 0.2, "competitive": 0.15}
EDGES = (0.2, 0.4, 0.6, 0.8)


def minmax(rows: DataFrame, column: str, out: str) -> DataFrame:
    """Scaled to 0..1; a flat or single-valued column gives 0. The two bounds are one aggregated row."""
    bounds = rows.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    scaled = F.when(F.col("_hi") <= F.col("_lo"), 0.0).otherwise((F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return rows.crossJoin(F.broadcast(bounds)).withColumn(out, scaled).drop("_lo", "_hi")


def midrank(rows: DataFrame, column: str, out: str) -> DataFrame:
    """Mid-rank percentile among present values, 0 where there is none: ties share the middle of their ranks. Ranks come from a count by
    value and a running sum over partitions of the values' range, so no task sorts all rows."""
    counts = written(rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n")), "values")
    below = running_sum(counts, "_v", "_n", "_upto")
    total = counts.agg(F.sum("_n").alias("_all"))
    pct = below.crossJoin(F.broadcast(total)).select("_v", ((2 * F.col("_upto") - F.col("_n")) / (2.0 * F.col("_all"))).alias("_p"))
    return rows.join(pct, F.col(column) == F.col("_v"), "left").withColumn(out, F.coalesce("_p", F.lit(0.0))).drop("_v", "_p")


def running_sum(rows: DataFrame, order: str, value: str, out: str, ranges: int = 64) -> DataFrame:
    """Sum of ``value`` over all rows up to each by ``order``, a number (ties share). The values are cut into ranges at approximate
    quantiles (one action, ``ranges`` numbers); ranges are summed by themselves, then moved by the sums of those before, a row each."""
    cuts = rows.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 1000)).collect()[0][0]
    points = F.array(*(F.lit(float(c)) for c in sorted(set(cuts or [])))).cast("array<double>")
    parted = rows.withColumn("_part", F.size(F.filter(points, lambda c: c < F.col(order))))
    sums = parted.groupBy("_part").agg(F.sum(value).alias("_s"))
    before = sums.select(F.col("_part").alias("_p2"), F.coalesce(F.sum("_s").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = F.sum(value).over(W.partitionBy("_part").orderBy(order))
    return parted.withColumn("_in", inner).join(F.broadcast(before), F.col("_part") == F.col("_p2")).withColumn(out, F.col("_in") + F.col("_before")).drop("_part", "_p2", "_in", "_before")


def quantiles(rows: DataFrame, column: str, at: tuple[float, ...] = EDGES) -> list[float]:
    """Exact quantiles, interpolated between the two nearest ranks, by counts of values and running sums over ranges: no task sorts all
    values, and the driver gets two rows a quantile. Empty where there is no value."""
    counts = written(rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("_v")).agg(F.count("*").alias("_n")), "values")
    upto = running_sum(counts, "_v", "_n", "_upto")
    n = counts.agg(F.sum("_n")).head()[0]
    if not n:
        return []
    ranks = sorted({int(r) for q in at for r in (q * (n - 1) // 1, -(-q * (n - 1) // 1))})
    covers = F.lit(False)
    for r in ranks:
        covers = covers | ((F.col("_upto") > r) & (F.col("_upto") - F.col("_n") <= r))
    held = upto.where(covers).select("_v", "_n", "_upto").collect()
    value = {r: next(h["_v"] for h in held if h["_upto"] - h["_n"] <= r < h["_upto"]) for r in ranks}
    return [value[int(q * (n - 1) // 1)] + (q * (n - 1) % 1) * (value[int(-(-q * (n - 1) // 1))] - value[int(q * (n - 1) // 1)]) for q in at]


def bands(rows: DataFrame, score: str, out: str = "band") -> DataFrame:
    """1 + the number of quantile edges at or below the score, null for null. Equal scores share a band."""
    band = F.lit(1)
    for e in quantiles(rows, score):
        band = band + F.when(F.col(score) >= e, 1).otherwise(0)
    return rows.withColumn(out, F.when(F.col(score).isNotNull(), band))


def composite(rows: DataFrame, popularity: str, price: str, cost: str, competitive: Column, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Adds score and components: scaled log of popularity, percentile of price, inverse scaled cost, and a flag. ``rows`` are written once, as
    bounds, percentiles and the result each read them."""
    r = written(rows.withColumn("_flag", competitive.cast("double")), "scored").withColumn("_pop", F.log1p(F.coalesce(F.col(popularity).cast("double"), F.lit(0.0)))).withColumn("_cost", F.coalesce(F.col(cost).cast("double"), F.lit(0.0)))
    r = minmax(minmax(r, "_pop", "c_popularity"), "_cost", "_scaled").withColumn("c_cost", 1 - F.col("_scaled"))
    r = midrank(r, price, "c_price").withColumn("c_competitive", F.col("_flag"))
    score = sum((F.lit(w) * F.col(f"c_{n}") for n, w in weights.items()), F.lit(0.0))
    return r.withColumn("score", score).drop("_pop", "_cost", "_scaled", "_flag")


def rolling_median(rows: DataFrame, value: str, order: list[Column], by: list[str], window: int = 20) -> DataFrame:
    """Median of the last ``window`` rows of each group; nulls are left out after the window is cut."""
    last = rows.withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= window)
    return last.groupBy(*by).agg(F.median(value).alias("median"), F.count(value).alias("n"))


def tagged_count(themes: Column, slug: str) -> Column:
    """The count of the first of ``themes``, JSON text of objects with slug and count, that has the slug; 0 where there is none, or no number."""
    parsed = F.from_json(themes, "array<struct<slug: string, count: string>>")
    return _whole(F.get(F.filter(parsed, lambda t: t["slug"] == slug), F.lit(0))["count"])


def bracket_count(brackets: Column, bracket: str) -> Column:
    """The count of a bracket in JSON text that maps brackets to counts; 0 where there is none, or no number."""
    return _whole(F.from_json(brackets, "map<string,string>")[bracket])


def _whole(text: Column) -> Column:
    number = F.when(text.rlike(r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$"), text).cast("double")
    return F.coalesce(F.floor(number).cast("long"), F.lit(0).cast("long"))
