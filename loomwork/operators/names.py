"""Names resolved through six layers: exact, folded, part, prefix, all words, and near by edits. A layer counts only where all above are empty.

Each layer runs on the queries that are still open, so the costlier ones meet few; it is written before the next one begins, so that no
plan holds more than its own layer. The fuzzy layer joins on a query's rarest bigrams, as many as any name of enough similarity must share
one of, within the length band; keeps pairs of a Dice similarity of 0.4 or more; and measures all of those within the budget.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import bigrams, edit_budget, fold
from ..sources.scratch import written
from .retrieval import small

DICE_FLOOR, CANDIDATES, BUDGET = 0.4, 10, 3
#: Queries up to which their prefixes are named to the scan of a sorted table.
NAMED_PREFIXES = 100


def index(entities: DataFrame, id_: str, name: str, rank: str | None = None, parts: DataFrame | None = None) -> DataFrame:
    """(id, name, folded, rank, part): a row an entity, and with ``parts`` (id, name) a row a part that is not an entity's whole name."""
    whole = entities.select(F.col(id_).alias("id"), F.col(name).alias("name"), fold(F.col(name)).alias("folded"), (F.col(rank) if rank else F.lit(None)).cast("double").alias("rank"), F.lit(False).alias("part"))
    if parts is None:
        return whole
    shown = whole.select("id", "name", "rank")
    own = parts.select(F.col(parts.columns[0]).alias("id"), fold(F.col(parts.columns[1])).alias("folded")).where("folded <> ''").join(shown, "id")
    return whole.unionByName(own.select("id", "name", "folded", "rank", F.lit(True).alias("part")))


def stored(names: DataFrame, replace: Callable[..., DataFrame], name: str) -> DataFrame:
    """``names`` written by ``replace`` in ranges of folded names, sorted within, so that a prefix is a range: scans skip files and row groups."""
    return replace(name, names.repartitionByRange("folded").sortWithinPartitions("folded", "id"))


def under_prefixes(names: DataFrame, prefixes: list[str]) -> DataFrame:
    """Rows of ``names`` whose folded name begins with any of the prefixes, as ranges that reach the scan."""
    found = F.lit(False)
    for p in prefixes:
        found = found | ((F.col("folded") >= p) & (F.col("folded") < p + "\U0010ffff"))
    return names.where(found)


def prefixed(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query, id) of names that begin with a query's folded text. Few queries are named to the scan; names meet the prefixes of the lengths that
    are asked for, so each row of the join is a hit and no key holds more."""
    asked = queries.select("query", "folded", F.length("folded").alias("n"))
    few = [r["folded"] for r in asked.select("folded").distinct().limit(NAMED_PREFIXES + 1).collect()]
    held = under_prefixes(names, few) if len(few) <= NAMED_PREFIXES else names
    lengths = sorted(r["n"] for r in asked.select("n").distinct().collect())  # no more than a name's length
    each = held.select("id", F.explode(F.array(*(F.when(F.length("folded") >= n, F.struct(F.lit(n).alias("n"), F.substring("folded", 1, n).alias("head"))) for n in lengths))).alias("x")) if lengths else held.select("id", F.lit(None).cast("struct<n: int, head: string>").alias("x"))
    heads = each.where("x is not null").select("id", "x.head")
    return heads.join(small(asked.select("query", "folded")), F.col("head") == F.col("folded")).select("query", "id")


def with_all_words(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query, id) of names that have all words of a query: looked up by each query's rarest word, then held against the others."""
    want = queries.select("query", F.array_distinct(F.filter(F.split("folded", " "), lambda w: w != "")).alias("w")).where(F.size("w") > 0)
    have = names.select("id", F.col("folded").alias("f")).distinct().select("id", F.array_distinct(F.split("f", " ")).alias("own"))
    words = have.select("id", "own", F.explode("own").alias("t"))
    asked = want.select("query", "w", F.explode("w").alias("t"))
    often = words.join(small(asked.select("t").distinct()), "t", "left_semi").groupBy("t").agg(F.count("*").alias("often"))
    # A word that no name has makes the query's answer empty, and is its rarest.
    rarest = asked.join(often, "t", "left").groupBy("query", "w").agg(F.min_by(F.struct("t", "often"), F.struct(F.coalesce("often", F.lit(0)), "t")).alias("r")).where("r.often is not null")
    hits = words.join(small(rarest.select("query", "w", F.col("r.t").alias("t"))), "t")
    return hits.where(F.size(F.array_except("w", "own")) == 0).select("query", "id")


def fuzzy(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query, id, distance): the nearest names within the budget, all that tie. ``queries`` has query and folded."""
    q = queries.select("query", F.col("folded").alias("qf"), edit_budget(F.col("folded"), BUDGET).alias("budget"), F.length("folded").alias("qn"), bigrams(F.col("folded")).alias("qg"))
    distinct = names.select(F.col("folded").alias("nf")).distinct().select("nf", F.length("nf").alias("nn"), bigrams(F.col("nf")).alias("ng"))
    held = distinct.select("nf", "nn", "ng", F.explode("ng").alias("gram"))
    often = held.groupBy(F.col("gram").alias("o_gram")).agg(F.count("*").alias("often"))
    # Dice = 2 shared / (grams + length - 1), and no name is shorter than the band allows: so many bigrams have to be shared.
    need = F.greatest(F.lit(1), F.ceil(F.lit(DICE_FLOOR / 2) * (F.size("qg") + F.greatest(F.lit(1), F.col("qn") - F.col("budget") - 1)) - 1e-9))
    asked = q.withColumn("need", need.cast("int")).select("*", F.explode("qg").alias("gram")).join(often, F.col("gram") == F.col("o_gram"), "left")
    rarest = F.row_number().over(W.partitionBy("query").orderBy(F.coalesce("often", F.lit(0)), "gram"))
    asked = asked.withColumn("k", rarest).where((F.col("k") <= F.size("qg") - F.col("need") + 1) & (F.col("often") > 0)).drop("o_gram", "often", "k", "need")
    near = asked.join(held.withColumnRenamed("gram", "h_gram"), (F.col("gram") == F.col("h_gram")) & F.col("nn").between(F.col("qn") - F.col("budget"), F.col("qn") + F.col("budget")))
    pairs = near.select("query", "qf", "budget", "qg", "nf", "nn", "ng").dropDuplicates(["query", "nf"]).withColumn("shared", F.size(F.array_intersect("qg", "ng")))
    kept = pairs.where(2 * F.col("shared") / (F.size("qg") + F.greatest(F.lit(1), F.col("nn") - 1)) >= DICE_FLOOR)
    distance = F.levenshtein("qf", "nf", BUDGET)  # -1 beyond the greatest budget, where the count stops
    best = kept.withColumn("distance", distance).where((F.col("distance") >= 0) & (F.col("distance") <= F.col("budget")))
    best = best.withColumn("least", F.min("distance").over(W.partitionBy("query"))).where("distance = least")
    owners = names.select("id", F.col("folded").alias("of"))
    return best.join(owners, F.col("nf") == F.col("of")).select("query", "id", "distance").distinct()


def similar(names: DataFrame, name: str, floor: float = DICE_FLOOR) -> DataFrame:
    """(a, b, shared, dice): pairs of different names of a Dice similarity of ``floor`` or more, which is twice the shared bigrams through those
    of a and the length of b less one. Each side is joined on its rarest bigrams alone, as many as such a pair has to share one of."""
    n = names.select(F.col(name).alias("f")).where("f <> ''").distinct().select("f", F.length("f").alias("n"), bigrams(F.col("f")).alias("g"))
    each = n.select("f", "n", "g", F.explode("g").alias("gram"))
    often = each.groupBy(F.col("gram").alias("o_gram")).agg(F.count("*").alias("often"))
    place = F.row_number().over(W.partitionBy("f").orderBy("often", "gram"))
    ranked = written(each.join(often, F.col("gram") == F.col("o_gram")).select("f", "n", "g", "gram", place.alias("k")), "bigrams")
    # shared >= floor / 2 * (grams + length - 1), and neither grams nor length - 1 is below shared.
    least = lambda size: F.greatest(F.lit(1), F.ceil(size * F.lit(floor / (2 - floor)) - 1e-9))
    a = ranked.where(F.col("k") <= F.size("g") - least(F.size("g")) + 1).select(F.col("f").alias("a"), F.col("g").alias("ga"), "gram")
    b = ranked.where(F.col("k") <= F.size("g") - least(F.greatest(F.lit(1), F.col("n") - 1)) + 1).select(F.col("f").alias("b"), F.col("g").alias("gb"), F.col("n").alias("nb"), F.col("gram").alias("b_gram"))
    pairs = a.join(b, (F.col("gram") == F.col("b_gram")) & (F.col("a") != F.col("b"))).dropDuplicates(["a", "b"]).withColumn("shared", F.size(F.array_intersect("ga", "gb")).cast("long"))
    dice = 2.0 * F.col("shared") / (F.size("ga") + F.greatest(F.lit(1), F.col("nb") - 1))
    return pairs.withColumn("dice", dice).where(F.col("dice") >= floor).select("a", "b", "shared", "dice")


def resolve(queries: DataFrame, names: DataFrame, max_layer: int = 5, kept: bool = False) -> DataFrame:
    """(query, layer, id, place, total, distance): up to ten ids a query, by rank, unranked last, then name; total counts all. An action a
    layer: each is written. ``kept``: ``names`` is a table, such as ``stored`` makes, and is read as it is."""
    asked = queries.select(F.trim(F.col(queries.columns[0])).alias("query")).where("query <> ''").distinct().withColumn("folded", fold(F.col("query")))
    asked, names = written(asked, "asked"), names if kept else written(names, "names")
    wholes, open_, found = names.where("not part"), asked, None

    def layer(n: int, hits: DataFrame) -> None:
        nonlocal found, open_
        if n > max_layer:
            return
        distance = F.col("distance") if "distance" in hits.columns else F.lit(None)
        own = written(hits.select("query", "id", F.lit(f"L{n}").alias("layer"), distance.cast("int").alias("distance")).distinct(), f"layer-{n}")
        found = own if found is None else found.unionByName(own)
        open_ = asked.join(found.select("query").distinct(), "query", "left_anti").where("folded <> ''")

    layer(0, open_.join(wholes.select("id", F.col("name").alias("n")), F.col("query") == F.col("n")))
    layer(1, open_.join(wholes.select("id", F.col("folded").alias("f")), F.col("folded") == F.col("f")))
    layer(2, open_.join(names.where("part").select("id", F.col("folded").alias("f")), F.col("folded") == F.col("f")))
    if max_layer >= 3:
        layer(3, prefixed(open_, names))
    if max_layer >= 4:
        layer(4, with_all_words(open_, names))
    if max_layer >= 5:
        layer(5, fuzzy(open_, names))
    shown = wholes.select("id", "name", "rank").distinct()
    totals = found.groupBy("query").agg(F.count("*").alias("total"))
    order = W.partitionBy("query").orderBy(F.col("rank").asc_nulls_last(), "name", "id")
    placed = found.join(shown, "id").withColumn("place", F.row_number().over(order)).where(F.col("place") <= CANDIDATES)  # cut before the shuffle
    return placed.join(totals, "query").select("query", "layer", "id", "place", "total", "distance")
