"""Relevance measures over ranked lists and marks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import name_keys
from ..sources.scratch import written


def ranks(retrievals: DataFrame, entity: str = "id") -> DataFrame:
    """(query, id, rank): the least rank of each entity among fused rows, or among all rows of a query that has no fused one."""
    marked = retrievals.withColumn("_fused", F.max(F.col("method") == "rrf").over(W.partitionBy("query")))
    return marked.where(~F.col("_fused") | (F.col("method") == "rrf")).groupBy("query", entity).agg(F.min("rank").alias("rank"))


def positions(ranked: DataFrame, entity: str = "id") -> DataFrame:
    """Adds the dense position, from 0."""
    return ranked.withColumn("position", F.row_number().over(W.partitionBy("query").orderBy("rank", entity)) - 1)


def recall(ranked: DataFrame, gold: DataFrame, entity: str = "id", depth: int | None = None) -> DataFrame:
    """(query, found, n, recall) for every query with gold."""
    top = ranked if depth is None else ranked.where(F.col("rank") <= depth)
    wanted = gold.select("query", entity).distinct()
    hit = wanted.join(top.select("query", entity).distinct().withColumn("_h", F.lit(1)), ["query", entity], "left")
    return hit.groupBy("query").agg(F.count("_h").alias("found"), F.count("*").alias("n")).withColumn("recall", F.col("found") / F.col("n"))


def macro(measure: DataFrame, column: str, out: str) -> DataFrame:
    return measure.agg(F.avg(column).alias(out), F.count("*").alias("queries"))


def marks(judgments: DataFrame, seq: str) -> DataFrame:
    """(query, id, fit): the last mark of each pair."""
    return judgments.groupBy("query", "id").agg(F.max_by("fit", seq).alias("fit"))


#: Sources whose marks are a person's.
HUMAN = ("human", "discord")


def stored_marks(judgments: DataFrame, queries: DataFrame, seq: str, sources: tuple[str, ...] = HUMAN) -> DataFrame:
    """(text, id, fit): the last human mark of each entity under each query text, of whichever run. ``judgments``: (query_id, id, fit, source,
    seq), ``queries``: (query_id, text)."""
    own = judgments.where(F.col("source").isin(*sources) & F.col("id").isNotNull()).join(queries.select("query_id", "text"), "query_id")
    return marks(own.withColumnRenamed("text", "query"), seq).withColumnRenamed("query", "text")


def stored_preferences(preferences: DataFrame, queries: DataFrame) -> DataFrame:
    """(text, a, b, winner) of ``preferences`` (query_id, a, b, winner)."""
    return preferences.join(queries.select("query_id", "text"), "query_id").select("text", "a", "b", "winner")


def pool_names(retrievals: DataFrame, owners: DataFrame, cards: DataFrame, limit: int | None = None) -> DataFrame:
    """(query, card, name, rank): each query's cards by the least rank of any of their entities in the pool. ``retrievals``: (query, id, rank,
    method), ``owners``: (id, card), ``cards``: (card, name)."""
    best = ranks(retrievals).join(owners, "id").groupBy("query", "card").agg(F.min("rank").alias("rank")).join(cards, "card").where("name <> ''")
    named = best.select("query", "card", "name", "rank")
    return named if limit is None else named.withColumn("_k", F.row_number().over(W.partitionBy("query").orderBy("rank", "card"))).where(F.col("_k") <= limit).drop("_k")


def described(descriptions: DataFrame, arts: DataFrame, text: str, id_: str = "id") -> DataFrame:
    """Descriptions with a text, and whether theirs is a default one (no, where the art is not known)."""
    flags = arts.select(F.col(id_).alias("_id"), "is_default")
    rows = descriptions.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "").join(flags, F.col(id_) == F.col("_id"), "left").drop("_id")
    return rows.withColumn("is_default", F.coalesce("is_default", F.lit(False)))


def precision(ranked: DataFrame, marked: DataFrame, depth: int = 5, passing: float = 0.5) -> DataFrame:
    """(query, good, marked, precision): good marks among the marks given within ``depth``."""
    j = ranked.where(F.col("rank") <= depth).join(marked.where("fit is not null"), ["query", "id"])
    return j.groupBy("query").agg(F.sum((F.col("fit") >= passing).cast("long")).alias("good"), F.count("*").alias("marked")).withColumn("precision", F.col("good") / F.col("marked"))


def micro_macro(by_query: DataFrame) -> DataFrame:
    return by_query.agg((F.sum("good") / F.sum("marked")).alias("micro"), F.avg("precision").alias("macro"))


def pairwise(preferences: DataFrame, ranked: DataFrame) -> DataFrame:
    """(agree, compared, agreement): of preferences (query, a, b, winner) whose two entities are both ranked, how many ranks agree."""
    a = ranked.select("query", F.col("id").alias("a"), F.col("rank").alias("ra"))
    b = ranked.select("query", F.col("id").alias("b"), F.col("rank").alias("rb"))
    j = preferences.join(a, ["query", "a"]).join(b, ["query", "b"]).where("ra <> rb and (winner = a or winner = b)")
    better = F.when(F.col("ra") < F.col("rb"), F.col("a")).otherwise(F.col("b"))
    return j.agg(F.coalesce(F.sum((better == F.col("winner")).cast("long")), F.lit(0)).alias("agree"), F.count("*").alias("compared")).withColumn("agreement", F.when(F.col("compared") > 0, F.col("agree") / F.col("compared")))


def scored(judged: DataFrame, pool: DataFrame, results: DataFrame, marked: DataFrame, preferences: DataFrame, depth: int = 5, passing: float = 0.5) -> DataFrame:
    """A row for each query of ``judged`` (query, kind, gold: names): recall of its gold among the names of ``pool`` (query, id, name, rank), or of
    its results where it has no pool, and among its first results (query, id, name, place); its first results' marks (query, id, fit); and how
    far the order, results first, then the pool, agrees with ``preferences`` (query, a, b, winner). A name is found by any of its keys."""
    first = results.where(F.col("place") <= depth)
    found = pool.select("query", "name").withColumn("source", F.lit("retrievals"))
    found = found.unionByName(results.select("query", "name").join(found.select("query").distinct(), "query", "left_anti").withColumn("source", F.lit("results")))
    gold = judged.select("query", F.posexplode("gold").alias("at", "g")).where("g <> ''").select("query", "at", F.explode(name_keys(F.col("g"))).alias("key"))

    def hits(names: DataFrame, out: str) -> DataFrame:
        keys = names.select("query", F.explode(name_keys(F.col("name"))).alias("key")).distinct()
        return gold.join(keys, ["query", "key"]).groupBy("query").agg(F.count_distinct("at").alias(out))

    size = gold.groupBy("query").agg(F.count_distinct("at").alias("gold_size"))
    sources = found.groupBy("query").agg(F.max("source").alias("pool_source"))
    given = first.select("query", "id").join(marked.select("query", "id", "fit"), ["query", "id"], "left").groupBy("query").agg(
        F.count("fit").alias("n_marked"), (F.count("*") - F.count("fit")).alias("n_pending"), F.sum((F.col("fit") >= passing).cast("long")).alias("n_accepted")
    )
    shown = results.groupBy("query", "id").agg(F.min("place").alias("place")).withColumn("at", F.row_number().over(W.partitionBy("query").orderBy("place", "id")))
    behind = pool.groupBy("query", "id").agg(F.min("rank").alias("rank")).join(shown.select("query", "id"), ["query", "id"], "left_anti").join(shown.groupBy("query").agg(F.max("at").alias("offset")), "query", "left")
    order = shown.select("query", "id", "at").unionByName(behind.select("query", "id", (F.coalesce("offset", F.lit(0)) + F.col("rank") + 1).alias("at")))
    side = lambda x: order.select("query", F.col("id").alias(x), F.col("at").alias(f"at_{x}"))
    better = F.when(F.col("at_a") < F.col("at_b"), F.col("a")).otherwise(F.col("b")) == F.col("winner")
    both = F.col("at_a").isNotNull() & F.col("at_b").isNotNull() & ((F.col("winner") == F.col("a")) | (F.col("winner") == F.col("b")))
    pairs = preferences.join(side("a"), ["query", "a"], "left").join(side("b"), ["query", "b"], "left").groupBy("query").agg(
        F.count("*").alias("stored"), F.sum(F.coalesce(both, F.lit(False)).cast("long")).alias("comparable"), F.sum(F.coalesce(both & better, F.lit(False)).cast("long")).alias("agree")
    )
    out = judged.select("query", "kind")
    for part in (size, hits(found, "hits_pool"), hits(first, "hits_first"), sources, given, pairs):
        out = out.join(part, "query", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gold_size", "hits_pool", "hits_first", "n_marked", "n_pending", "n_accepted", "stored", "comparable", "agree")]
    out = out.select("query", "kind", "pool_source", *zero)
    literal, n = F.col("kind") == "literal", F.greatest(F.col("gold_size"), F.lit(1))
    rates = {"recall_pool": F.when(literal, F.col("hits_pool") / n), "recall_at_5": F.when(literal, F.col("hits_first") / n), "p_at_5": F.when(~literal & (F.col("n_marked") > 0), F.col("n_accepted") / F.col("n_marked"))}
    return out.withColumns(rates)


def summary(by_query: DataFrame) -> DataFrame:
    """A row a kind of ``scored``: recall by the mean over queries, precision over marks and over queries, agreement over comparable pairs."""
    sums = [F.sum(c).alias(out) for c, out in (("gold_size", "gold_names"), ("n_accepted", "accepted"), ("n_marked", "marked"), ("n_pending", "pending"), ("stored", "stored"), ("comparable", "comparable"), ("agree", "agree"))]
    rows = by_query.groupBy("kind").agg(F.count("*").alias("n_queries"), F.avg("recall_pool").alias("recall_pool"), F.avg("recall_at_5").alias("recall_at_5"), F.avg("p_at_5").alias("p_at_5_macro"), *sums)
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    literal = F.col("kind") == "literal"
    return rows.withColumn("p_at_5", F.when(~literal, share("accepted", "marked"))).withColumn("agreement", share("agree", "comparable"))


def latency(timings: DataFrame, column: str, *by: str) -> DataFrame:
    """(mean, median, max) of each group. The median is of counts of values, with running counts over ranges of them, so that a group that has most
    rows is many ranges."""
    counts = written(timings.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("_v")).agg(F.count("*").alias("_n")), "timings")
    dealt = written(counts.repartitionByRange(*by, "_v").withColumn("_range", F.spark_partition_id()), "timings")
    sums = dealt.groupBy(*by, "_range").agg(F.sum("_n").alias("_s"))
    before = sums.select(*by, "_range", (F.sum("_s").over(W.partitionBy(*by).orderBy("_range")) - F.col("_s")).alias("_before"))  # at most a row a range more than groups
    upto = F.sum("_n").over(W.partitionBy(*by, "_range").orderBy("_v"))
    placed = dealt.withColumn("_in", upto).join(before, [*by, "_range"]).withColumn("_upto", F.col("_in") + F.col("_before"))
    totals = counts.groupBy(*by).agg((F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("mean"), F.max("_v").alias("max"), F.sum("_n").alias("_all"))
    placed = placed.join(totals, list(by)) if by else placed.crossJoin(totals)  # one row
    low, high = F.floor((F.col("_all") - 1) / 2), F.ceil((F.col("_all") - 1) / 2)
    at = lambda r: F.max(F.when((F.col("_upto") - F.col("_n") <= r) & (r < F.col("_upto")), F.col("_v")))
    return placed.groupBy(*by).agg(F.first("mean").alias("mean"), ((at(low) + at(high)) / 2).alias("median"), F.first("max").alias("max"))


def citations(judged: DataFrame, known: DataFrame) -> DataFrame:
    """(cited, invented, misattributed) over rows (id, cited: array) and known citations (cite, id)."""
    each = judged.select(F.col("id").alias("j_id"), F.explode("cited").alias("cite"))
    owner = each.join(known.select("cite", F.col("id").alias("k_id")), "cite", "left")
    return owner.agg(F.count("*").alias("cited"), F.sum(F.col("k_id").isNull().cast("long")).alias("invented"), F.coalesce(F.sum((F.col("k_id") != F.col("j_id")).cast("long")), F.lit(0)).alias("misattributed"))
