"""Training sets from labels: provenance, negatives, balance, splits, weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import split_of, squeeze

# Fixed values of the export.
PRIORITY = {"human": 3, "discord": 3, "judge": 2, "distill": 1}
LITERAL_REGISTERS = ("literal", "compositional")
POSITIVE, NEGATIVE, ACCEPT, MOST_NEGATIVES, STATEMENTS, CHARACTERS, HUMAN_WEIGHT = 0.7, 0.3, 0.5, 8, 4, 700, 3


def priority(source: Column) -> Column:
    out = F.lit(0)
    for name, p in PRIORITY.items():
        out = F.when(source == name, p).otherwise(out)
    return out


def folded_labels(labels: DataFrame, text: str, id_: str, source: str, seq: str) -> DataFrame:
    """One label of each (text, id): the best source, then the latest row; the text spelled as seen first."""
    keyed = labels.withColumn("norm_text", squeeze(F.col(text))).withColumn("_p", priority(F.col(source)))
    first = F.first(text).over(W.partitionBy("norm_text").orderBy(seq))
    best = F.row_number().over(W.partitionBy("norm_text", id_).orderBy(F.desc("_p"), F.desc(seq)))
    return keyed.withColumn("spelled", first).withColumn("_k", best).where("_k = 1").drop("_k", "_p")


def hard_negatives(labels: DataFrame, query: str, id_: str, fit: str, text: str, most: int = MOST_NEGATIVES) -> DataFrame:
    """(query, negatives): texts of misses, nearest first, each text once, at most ``most``."""
    low = labels.where(F.col(fit) <= NEGATIVE)
    once = low.withColumn("_d", F.row_number().over(W.partitionBy(query, text).orderBy(F.desc(fit), id_))).where("_d = 1")
    kept = once.withColumn("_k", F.row_number().over(W.partitionBy(query).orderBy(F.desc(fit), id_))).where(F.col("_k") <= most)
    return kept.groupBy(query).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", text))), lambda s: s[text]).alias("negatives"))


def balanced(rows: DataFrame, label: str, weight: str, key: Column) -> DataFrame:
    """Rows of two classes cut to about the lighter class's weight: heavy rows first, then by ``key``; a row stays while the weight before
    it is below the target. Weights are summed by weight class and key range, so that no task sorts a class."""
    totals = rows.groupBy(label).agg(F.sum(weight).alias("w"))
    target = totals.agg(F.min("w").alias("_t"), F.count("*").alias("_n"))
    dealt = rows.withColumn("_key", key).withColumn("_b", F.conv(F.substring("_key", 1, 2), 16, 10).cast("int"))
    sums = dealt.groupBy(label, weight, "_b").agg(F.sum(weight).alias("_s"))  # 256 rows a class and weight
    order = W.partitionBy(label).orderBy(F.desc(weight), "_b")
    before = sums.select(F.col(label).alias("_l"), F.col(weight).alias("_w"), F.col("_b").alias("_b2"), (F.sum("_s").over(order) - F.col("_s")).alias("_before"))
    own = F.sum(weight).over(W.partitionBy(label, weight, "_b").orderBy("_key").rowsBetween(W.unboundedPreceding, -1))
    summed = dealt.withColumn("_own", F.coalesce(own, F.lit(0))).join(F.broadcast(before), (F.col(label) == F.col("_l")) & (F.col(weight) == F.col("_w")) & (F.col("_b") == F.col("_b2")))
    kept = summed.crossJoin(F.broadcast(target)).where((F.col("_n") < 2) | (F.col("_own") + F.col("_before") < F.col("_t")))
    return kept.select(*rows.columns)


def evidence(props: DataFrame, id_: str, position: str, text: str, most: int = STATEMENTS, characters: int = CHARACTERS) -> DataFrame:
    """(id, evidence): the first statements of each entity, joined and clipped."""
    first = props.withColumn("_k", F.row_number().over(W.partitionBy(id_).orderBy(position))).where(F.col("_k") <= most)
    return first.groupBy(id_).agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", text))), lambda s: s[text]), " "), 1, characters).alias("evidence"))


def text_for(labels: DataFrame, props: DataFrame, id_: str, cited: str, register: str, most: int = STATEMENTS, characters: int = CHARACTERS) -> DataFrame:
    """Adds ``positive``: the entity's side of a training pair. The cited statements that it has, in the order cited; else those of the layer
    that the register asks for; else all. ``props``: (id, prop, layer, text)."""
    own = props.groupBy(F.col(id_).alias("_id")).agg(F.array_sort(F.collect_list(F.struct("prop", "layer", "text"))).alias("_props"))
    rows = labels.join(own, F.col(id_) == F.col("_id"), "left").drop("_id")
    held = F.coalesce("_props", F.array().cast(own.schema["_props"].dataType))
    texts = lambda a: F.filter(F.transform(a, lambda p: p["text"]), lambda t: F.coalesce(t, F.lit("")) != "")
    named = texts(F.filter(F.transform(F.coalesce(cited, F.array().cast("array<bigint>")), lambda n: F.get(F.filter(held, lambda p: p["prop"] == n), F.lit(0))), lambda p: p.isNotNull()))
    layer = F.when(F.coalesce(register, F.lit("")).isin(*LITERAL_REGISTERS), "literal").otherwise("interpretive")
    of_layer = texts(F.filter(held, lambda p: p["layer"] == layer))
    chosen = F.when(F.size(named) > 0, named).when(F.size(of_layer) > 0, of_layer).otherwise(texts(held))
    return rows.withColumn("positive", F.trim(F.substring(F.array_join(F.slice(chosen, 1, most), " "), 1, characters))).drop("_props")


def weighted(rows: DataFrame, weight: Column) -> DataFrame:
    """Each row as often as its weight says."""
    return rows.withColumn("_w", F.explode(F.array_repeat(F.lit(1), weight.cast("int")))).drop("_w")


def split(rows: DataFrame, text: str) -> DataFrame:
    return rows.withColumn("split", split_of(squeeze(F.col(text))))


# Fields of a routing decision, by any of the names that logs have for them.
ROUTE_FIELDS = {"literal_weight": ("literal_weight",), "interpretive_weight": ("interpretive_weight",), "slot_filters": ("slot_filters", "slot_filter", "slots"), "mechanical_terms": ("mechanical_terms", "mechanical_filter", "mechanical")}
# Names of the two lists of expansions.
DIRECT = ("direct", "direct_expansions", "interpretive_expansions", "interpretive")
DECOMPOSED = ("decomposed", "decomposed_expansions", "literal_expansions", "literal")


def _logged(params: str, *names: str) -> Column:
    """The first of the names that the plan has, as JSON text; the plan is under ``plan`` or the whole."""
    return F.coalesce(*(F.get_json_object(params, f"$.plan.{n}") for n in names), *(F.get_json_object(params, f"$.{n}") for n in names))


def routing_records(queries: DataFrame, id_: str, text: str, params: str) -> DataFrame:
    """(id, text, literal_weight, interpretive_weight, slot_filters, mechanical_terms) of logged plans: the routing fields alone, under any of
    their names; without plans that a fallback made, and without terms that only echo the request."""
    terms = F.from_json(F.coalesce(_logged(params, *ROUTE_FIELDS["mechanical_terms"]), F.lit("[]")), "array<string>")
    failed = _logged(params, "router_ok").eqNullSafe("false") | F.lower(F.coalesce(F.col(params), F.lit(""))).contains("router failed")
    own = queries.where(~F.coalesce(failed, F.lit(False)))
    return own.select(
        id_, text, *(_logged(params, *ROUTE_FIELDS[n]).cast("double").alias(n) for n in ("literal_weight", "interpretive_weight")), _logged(params, *ROUTE_FIELDS["slot_filters"]).alias("slot_filters"),
        F.filter(terms, lambda x: squeeze(x) != squeeze(F.col(text))).alias("mechanical_terms"),
    ).where("literal_weight is not null or interpretive_weight is not null")


def expansion_records(queries: DataFrame, id_: str, text: str, params: str) -> DataFrame:
    """(id, text, direct, decomposed): the expansions of logged plans, of either list the first name that holds any, without blank ones and
    without the request itself."""
    def listed(names: tuple[str, ...]) -> Column:
        lists = [F.from_json(_logged(params, at), "array<string>") for at in (*names, *(f"expansions.{n}" for n in names))]
        clean = [F.filter(x, lambda v: (F.trim(v) != "") & (squeeze(v) != squeeze(F.col(text)))) for x in lists]
        return F.coalesce(*(F.when(F.size(x) > 0, x) for x in clean), F.array().cast("array<string>"))

    return queries.select(id_, text, listed(DIRECT).alias("direct"), listed(DECOMPOSED).alias("decomposed")).where((F.size("direct") > 0) | (F.size("decomposed") > 0))


def own_citations(rows: DataFrame, cited: str, valid: str) -> DataFrame:
    """``cited`` cut down to what the entity has."""
    return rows.withColumn(cited, F.array_intersect(cited, valid))


def done_ids(queries: DataFrame, params: str, path: str = "$.illustration_id") -> DataFrame:
    """Ids that earlier runs noted in their parameters."""
    return queries.select(F.get_json_object(params, path).alias("id")).where("id is not null").distinct()


def histogram(rows: DataFrame, column: str, spread: float = 0.6) -> DataFrame:
    """(value, n, share, dominant): counts of a column, with values flagged that hold more than ``spread``."""
    n = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("_t"))
    return n.crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("_t")).alias("share"), (F.col("n") / F.col("_t") > spread).alias("dominant"))
