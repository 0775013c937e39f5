"""Many requests as one plan: routing, filters, retrieval, fusion, judging and choice with a column for the request.

Filters are bitmaps, one set a request; retrieval reads the stored word and vector indexes under those sets; nothing is done request by request
on the driver. The answers are those of ``plans.search`` for each request by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bitmaps, filters, inverted, names, retrieval, selection, vectors, vocabulary
from ..sources.scratch import written
from .models import ModelClient, StandIn, cited, embedded, expansions, judged, routed, verified, weights
from .search import RULES_PREFIXES, Request

FILTERS = {"types": "array<string>", "formats": "array<string>", "colors": "string", "mv_min": "int", "mv_max": "int", "band_min": "int", "band_max": "int"}
REQUEST = "query string, text string, k int, " + ", ".join(f"{c} {kind}" for c, kind in FILTERS.items())
_PLAN = (
    "query string, intent string, types array<string>, formats array<string>, colors string, mv_min int, mv_max int, slots array<struct<path: string, op: string, value: string>>, mechanical array<string>,"
    "wanted array<struct<layer: string, text: string, w: double>>, notes array<string>"
)
#: Between the parts of a compound key.
_MARK = "\x01"


@dataclass
class Corpus:
    """What searches read, all stored: ``rows`` (row, entity, layer), the word index of all rows, a vector index a layer, ``entities``, and for
    filters the numbers and bitmaps of entities."""

    rows: DataFrame
    words: inverted.WordIndex
    near: dict[str, vectors.VectorIndex]
    entities: DataFrame
    numbers: DataFrame
    maps: DataFrame


@dataclass
class Answers:
    """``results`` (query, entity, place, ...), ``pool`` (query, entity, rank, score, fit, ...), ``log``, the rows of the retrieval log, and
    ``notes`` (query, note)."""

    results: DataFrame
    pool: DataFrame
    log: DataFrame
    notes: DataFrame
    named: DataFrame | None = field(default=None)


def requests(spark: SparkSession, asked: list[tuple[str, Request]]) -> DataFrame:
    rows = [(q, r.text, r.k, r.types, r.formats, r.colors, *r.mv, *(r.band or (None, None))) for q, r in asked]
    return spark.createDataFrame(rows, REQUEST)


def planned(asked: DataFrame, client: ModelClient, art: bool) -> DataFrame:
    """What the router makes of each request, in tasks; written, so that each is asked once."""

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for query, text in zip(batch["query"], batch["text"], strict=True):
                p = routed(client, text)
                notes = list(p.get("notes", []))
                wanted = p.get("filters") or {}
                intent = text if art else (p.get("semantic_intent") or "").strip()
                by_layer = weights(p) if art else {"literal": 1.0}
                asked_ = [(layer if art else "any", t, by_layer[layer]) for layer, t in expansions(client, intent, by_layer)] if intent else []
                slots = [(s["path"], s["op"], s["value"]) for s in filters.clean_slots(p.get("slot_filters"), notes)] if art else []
                terms = [t for t in p.get("mechanical_terms") or [] if t] if art else []
                out.append((query, intent, wanted.get("types"), wanted.get("formats"), wanted.get("colors"), wanted.get("mv_min"), wanted.get("mv_max"), slots, terms, asked_, notes))
            frame = pd.DataFrame(out, columns=["query", "intent", "types", "formats", "colors", "mv_min", "mv_max", "slots", "mechanical", "wanted", "notes"])
            yield frame.astype({"mv_min": "Int32", "mv_max": "Int32"})

    return written(asked.select("query", "text").mapInPandas(plan, _PLAN), "plans")


# --- filters


def corpus_sets(cards: DataFrame, types: DataFrame, legalities: DataFrame) -> DataFrame:
    """(id, attribute, value): what the filters on cards ask for."""
    letters = cards.select(F.col("entity").alias("id"), F.explode(F.array_distinct(F.filter(F.split(F.upper("color_identity"), ""), lambda c: c != ""))).alias("value"))
    return (
        types.select(F.col("entity").alias("id"), F.lit("type").alias("attribute"), F.lower("value").alias("value"))
        .union(legalities.where("status = 'legal'").select("entity", F.lit("format"), "format"))
        .union(letters.select("id", F.lit("color"), "value"))
        .union(cards.where("cmc is not null").select("entity", F.lit("mv"), F.col("cmc").cast("double").cast("string")))
    )


def clauses(asked: DataFrame, maps: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of ``asked`` (query, types, formats, colors, mv_min, mv_max): (query, clause, attribute, value, negated), the bitmaps of their phrases
    beside ``maps``, and (query, note). Rules of single requests hold: an unknown word drops its phrase, a bound out of range itself, and a
    reversed range is the empty set."""
    known = written(maps.select("attribute", "value").distinct(), "values")
    phrases = asked.select("query", F.explode("types").alias("phrase")).withColumn("words", F.array_distinct(F.filter(F.split(F.lower(F.trim("phrase")), r"\s+"), lambda w: w != "")))
    words = phrases.select("phrase", "words").distinct().select("phrase", F.explode_outer("words").alias("value"))
    have = words.join(known.where("attribute = 'type'").select("value", F.lit(1).alias("have")), "value", "left").groupBy("phrase").agg(F.count("value").alias("n"), F.count("have").alias("have"), F.array_sort(F.collect_set(F.when(F.col("have").isNull(), F.col("value")))).alias("unknown"))
    good = have.where("n > 0 and n = have").select("phrase")
    sets = bitmaps.chosen(maps, words.join(good, "phrase").select(F.col("phrase").alias("query"), F.col("value").alias("clause"), F.lit("type").alias("attribute"), "value", F.lit(False).alias("negated")))
    both = maps.select("attribute", "value", "bucket", "bits").unionByName(sets.select(F.lit("phrase").alias("attribute"), F.col("query").alias("value"), "bucket", "bits"))

    row = lambda df, clause, attribute, value, negated=False: df.select("query", F.lit(clause).alias("clause"), attribute.alias("attribute"), value.cast("string").alias("value"), F.lit(negated).alias("negated"))
    by_type = row(phrases.join(good, "phrase"), "types", F.lit("phrase"), F.col("phrase"))
    by_format = row(asked.select("query", F.explode("formats").alias("f")), "formats", F.lit("format"), F.col("f"))
    wanted = asked.select("query", F.filter(F.split(F.upper(F.coalesce("colors", F.lit(""))), ""), lambda c: c.rlike("^[A-Z]$")).alias("letters")).where(F.size("letters") > 0)
    letters = F.broadcast(known.where("attribute = 'color'").agg(F.collect_set("value").alias("all")))  # one row of letters
    barred = wanted.crossJoin(letters).select("query", F.explode(F.array_append(F.array_except("all", "letters"), F.lit("none"))).alias("l"))
    by_color = row(barred, "colours", F.lit("color"), F.col("l"), True)
    lowest, highest = filters.NUMBER_LIMITS
    ok = lambda c: F.when(F.col(c).between(lowest, highest), F.col(c))
    ranges = asked.select("query", ok("mv_min").alias("low"), ok("mv_max").alias("high")).where("low is not null or high is not null")
    values = known.where("attribute = 'mv'").select("value", F.col("value").cast("double").alias("x"))
    within = ranges.join(retrieval.small(values), (F.coalesce("low", F.lit(lowest - 1)) <= F.col("x")) & (F.col("x") <= F.coalesce("high", F.lit(1e9))), "left")
    by_value = row(within, "mana value", F.lit("mv"), F.coalesce("value", F.lit("none")))
    dropped = phrases.join(have, "phrase").where("n = 0 or n > have").select("query", F.concat(F.lit("type '"), "phrase", F.lit("': unknown "), F.when(F.size("unknown") > 0, F.array_join("unknown", ", ")).otherwise("value"), F.lit("; dropped")).alias("note"))
    for name, c in (("minimum", "mv_min"), ("maximum", "mv_max")):
        out = asked.where(~F.col(c).between(lowest, highest))
        dropped = dropped.union(out.select("query", F.concat(F.lit(f"{name} "), F.col(c).cast("string"), F.lit(f" is outside {lowest}-{highest}; ignored"))))
    return written(by_type.union(by_format).union(by_color).union(by_value), "clauses"), written(both, "request-bitmaps"), dropped


def _each(name: Column) -> Column:
    return F.concat("query", F.lit(_MARK), name)


def allowed(asked: DataFrame, plans: DataFrame, maps: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(query, filtered), (query, bucket, bits) of those that are, and (query, note): the hard filters of ``asked``, and among what they leave the
    soft ones of ``plans``. A filtered request without bits may have nothing."""
    hard, both, notes = clauses(asked, maps)
    soft, own, more = clauses(plans, maps)
    # What only the router filters is taken from all.
    bare = soft.select("query").distinct().join(hard.select("query").distinct(), "query", "left_anti")
    every = bare.select("query", *(F.lit(bitmaps.ALL).alias(c) for c in ("clause", "attribute", "value")), F.lit(False).alias("negated"))
    sets = written(bitmaps.chosen(both, hard.unionByName(every)), "hard-sets")
    position = F.array_position(F.array(*map(F.lit, ("mana value", "colours", "types", "formats"))), F.col("name"))
    each = soft.select(F.concat("query", F.lit(_MARK), "clause").alias("query"), "clause", "attribute", "value", "negated")
    part = lambda i: F.split_part("query", F.lit(_MARK), F.lit(i))
    found = bitmaps.chosen(own, each).select(part(1).alias("name_of"), part(2).alias("name"), "bucket", "bits").withColumnRenamed("name_of", "query")
    known = soft.select("query", F.col("clause").alias("name"), F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("bits")).distinct()
    under, choice = bitmaps.soft(sets, written(found.unionByName(known).withColumn("position", position), "soft-sets"))
    filtered = written(hard.select("query").union(choice.where(F.size("kept") > 0).select("query")).distinct(), "filtered")
    flags = asked.select("query").join(filtered.withColumn("filtered", F.lit(True)), "query", "left").select("query", F.coalesce("filtered", F.lit(False)).alias("filtered"))
    notes = notes.unionByName(more).unionByName(choice.select("query", F.explode("notes").alias("note")))
    return flags, written(under.join(filtered, "query", "left_semi"), "sets"), notes


# --- retrieval


def retrieve(asked: DataFrame, corpus: Corpus, client: ModelClient, dim: int, groups: DataFrame | None = None) -> DataFrame:
    """(query, list, method, layer, entity, row, rank, w), written: the ranked lists of ``asked`` (query, position, layer, text, w), of each text by
    each method over the rows of its layer. ``groups``: (query, entity), the sets of those requests that have ``filtered`` true in ``asked``."""
    own = written(asked.withColumn("ask", F.concat("query", F.lit(_MARK), F.lpad(F.col("position").cast("string"), 3, "0"))), "asked")
    by_row = corpus.rows.select("row", "entity", F.col("layer").alias("of"))
    about = own.select(F.col("ask").alias("a"), F.col("query").alias("request"), F.col("layer").alias("wants"), "filtered", "w")

    def keep(scores: DataFrame) -> DataFrame:
        met = scores.join(by_row, F.col("doc") == F.col("row")).join(retrieval.small(about), F.col("query") == F.col("a")).where(F.col("of") == F.col("wants"))
        if groups is not None:
            may = groups.select(F.col("query").alias("g_query"), F.col("entity").alias("g_entity"), F.lit(True).alias("may"))
            met = met.join(may, (F.col("request") == F.col("g_query")) & (F.col("entity") == F.col("g_entity")), "left").where(~F.col("filtered") | F.col("may"))
        return met.select(F.col("a").alias("query"), "doc", "score")

    found = inverted.topk(corpus.words, own, "ask", "text", keep=keep).withColumn("method", F.lit("bm25"))
    made = written(embedded(own, "ask", "text", client, dim).join(own.select("ask", "query", "layer", "filtered"), "ask").withColumn("group", F.when(F.col("filtered"), F.col("query"))), "embedded")
    rows_of = None if groups is None else groups.select(F.col("query").alias("group"), "entity").join(by_row, "entity").select("group", F.col("row").alias("id"))
    for layer, index in sorted(corpus.near.items()):
        near = vectors.topk(index, made.where(F.col("layer") == layer), "ask", "vector", group="group", allowed=rows_of)
        found = found.unionByName(near.withColumn("method", F.lit("dense")))
    lists = found.select(F.col("query").alias("ask"), "doc", "rank", "method").join(about, F.col("ask") == F.col("a")).join(by_row.select("row", "entity"), F.col("doc") == F.col("row"))
    return written(lists.select(F.col("request").alias("query"), F.concat_ws("/", "ask", "method").alias("list"), "method", F.col("wants").alias("layer"), "entity", "row", "rank", "w"), "lists")


def _expanded(plans: DataFrame, flags: DataFrame) -> DataFrame:
    return plans.select("query", F.posexplode("wanted").alias("position", "x")).select("query", "position", "x.*").join(flags, "query")


def _notes(*parts: DataFrame) -> DataFrame:
    out = parts[0].select("query", "note")
    for p in parts[1:]:
        out = out.union(p.select("query", "note"))
    return written(out, "notes")


def text_searches(asked: DataFrame, corpus: Corpus, name_index: DataFrame, client: ModelClient | None = None, dim: int = 64) -> Answers:
    """``search.text_search`` of many requests (``REQUEST``). ``corpus.entities``: (entity, name, cmc, color_identity, edhrec_rank, evidence)."""
    client = client or StandIn(dim)
    asked = written(asked, "requests")
    cards = corpus.entities
    proper = F.length(F.trim("text")).between(1, 300)
    one = names.resolve(asked.where(proper).select("text"), name_index, max_layer=2, kept=True).where("total = 1").select(F.col("query").alias("name_asked"), F.col("id").alias("entity"))
    named = written(asked.join(one, F.trim("text") == F.col("name_asked")).select("query", "entity"), "named")
    starts = F.lit(False)
    for p in RULES_PREFIXES:
        starts = starts | F.startswith(F.regexp_replace(F.lower(F.trim("text")), r"\s+", " "), F.lit(p))
    rest = asked.where(proper).join(named.select("query"), "query", "left_anti")
    open_ = written(rest.where(~starts), "open-requests")
    plans = planned(open_, client, art=False)
    flags, sets, said = allowed(open_, plans, corpus.maps)
    flags = written(flags, "flags")
    groups = written(bitmaps.listed(sets, corpus.numbers).withColumnRenamed("id", "entity"), "allowed")
    lists = retrieve(_expanded(plans, flags), corpus, client, dim, groups)
    fused = written(retrieval.fuse(lists, weight="w"), "fused")
    pool = retrieval.pool(fused, retrieval.RULES_POOL).join(cards, "entity").join(open_.select("query", F.col("text").alias("text_asked")), "query")
    pool = written(pool, "pool")
    fit = judged(pool, "query", "text_asked", "entity", "rank", "evidence", client).select("query", "entity", "fit")
    pool = written(pool.drop("text_asked").join(fit, ["query", "entity"], "left"), "pool")

    # Requests that say nothing but filters are answered by popularity.
    wide = plans.where("intent = ''").select("query").join(flags, "query")
    order = [F.col("edhrec_rank").asc_nulls_last(), F.col("entity")]
    within = wide.where("filtered").join(groups, "query").select("query", "entity").join(cards, "entity")
    known = cards.orderBy(*order).limit(5)  # the same for all requests without filters
    popular = _placed(within.unionByName(wide.where("not filtered").select("query").crossJoin(F.broadcast(known)).select("query", *cards.columns)), order)
    k = asked.select("query", "k")
    chosen = selection.by_fit(pool, "fit", "entity", ("query",), 5).unionByName(popular, allowMissingColumns=True)
    whole = named.join(cards, "entity").withColumn("place", F.lit(1))
    results = chosen.join(k, "query").where(F.col("place") <= F.col("k")).drop("k").unionByName(whole, allowMissingColumns=True)
    empty = flags.where("filtered").join(sets.select("query").distinct(), "query", "left_anti")
    notes = _notes(
        said, plans.select("query", F.explode("notes").alias("note")), named.select("query", F.lit("that is a card's name").alias("note")).distinct(),
        rest.where(starts).select("query", F.lit("rules questions are not answered").alias("note")), empty.select("query", F.lit("nothing passes the filters").alias("note")),
        wide.select("query", F.lit("ordered by popularity").alias("note")), asked.where(~proper).select("query", F.lit("the text must have 1 to 300 characters").alias("note")),
    )
    return Answers(written(results, "results"), pool, retrieval.logged(lists, fused, weight="w"), notes, named)


def _placed(rows: DataFrame, order: list[Column], most: int = 5) -> DataFrame:
    from pyspark.sql.window import Window

    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("place") <= most)


def art_searches(asked: DataFrame, corpus: Corpus, client: ModelClient | None = None, dim: int = 64, phrases: DataFrame | None = None, mined: DataFrame | None = None, statements: DataFrame | None = None) -> Answers:
    """``search.art_search`` of many requests. ``corpus.entities``: (entity, card, color_identity, band, evidence, vector). Slot filters differ from
    request to request in what they mean, so each distinct set of them is matched by itself, against the phrases; all else is one plan."""
    client = client or StandIn(dim)
    asked = written(asked, "requests")
    plans = planned(asked, client, art=True)
    slots = plans.where(F.size("slots") > 0).select("slots").distinct().collect() if phrases is not None else []  # a row a distinct set of slots
    groups, used, extra = None, None, None
    for r in slots:
        own: list[str] = []
        ids = vocabulary.allowed(phrases, "entity", [s.asDict() for s in r["slots"]], own, mined)
        of = plans.where(F.col("slots") == F.array(*(F.struct(F.lit(s["path"]).alias("path"), F.lit(s["op"]).alias("op"), F.lit(s["value"]).alias("value")) for s in r["slots"]))).select("query")
        noted = of.crossJoin(plans.sparkSession.createDataFrame([(n,) for n in own], "note string"))  # some notes
        extra = noted if extra is None else extra.union(noted)
        if ids is not None:
            pairs = ids.crossJoin(retrieval.small(of))  # the requests of one set of slots
            pairs = pairs.select("query", "entity")
            groups = pairs if groups is None else groups.unionByName(pairs)
            used = of if used is None else used.union(of)
    flags = asked.select("query").join(used.withColumn("filtered", F.lit(True)), "query", "left").select("query", F.coalesce("filtered", F.lit(False)).alias("filtered")) if used is not None else asked.select("query", F.lit(False).alias("filtered"))
    lists = retrieve(_expanded(plans, written(flags, "flags")), corpus, client, dim, None if groups is None else written(groups, "allowed"))
    fused = written(retrieval.fuse(lists, weight="w"), "fused")
    about = asked.select("query", F.col("text").alias("text_asked"), "k", "colors", "band_min", "band_max").join(plans.select("query", "mechanical"), "query")
    best = retrieval.collapse(fused.join(corpus.entities, "entity"), "card").join(about, "query")
    # Mechanical terms hold where any candidate of the request has one, colours always.
    text = F.lower(F.concat_ws("\n", *([c for c in ("oracle_text", "type_line", "themes", "archetypes") if c in best.columns] or ["evidence"])))
    has = F.exists("mechanical", lambda t: text.contains(F.lower(t)))
    best = written(best.withColumn("has", has), "collapsed")
    some = best.groupBy("query").agg(F.max("has").alias("some"), F.max(F.col("band").isNotNull()).alias("banded"))
    inside = F.size(F.array_except(F.filter(F.split(F.upper("color_identity"), ""), lambda c: c != ""), F.split(F.upper("colors"), ""))) == 0
    best = best.join(some, "query").where(F.col("has") | ~F.col("some") | (F.size("mechanical") == 0)).where(F.col("colors").isNull() | (F.col("colors") == "") | inside)
    lost = some.join(plans.where(F.size("mechanical") > 0), "query").where("not some").select("query", F.concat(F.lit("terms "), F.array_join("mechanical", ", "), F.lit(" matched nothing; dropped")).alias("note"))
    best = written(best.drop("has", "some"), "candidates")

    def within(rows: DataFrame, more: int) -> DataFrame:
        low, high = F.greatest(F.lit(1), F.col("band_min") - more), F.least(F.lit(5), F.col("band_max") + more)
        return rows.where(F.col("band_min").isNull() | ~F.col("banded") | F.col("band").between(low, high))

    def judge(pool: DataFrame) -> DataFrame:
        if statements is None:
            found = judged(pool, "query", "text_asked", "entity", "rank", "evidence", client).select("query", "entity", "fit")
        else:
            said = statements.join(pool.select("entity").distinct(), "entity", "left_semi").groupBy("entity").agg(F.array_sort(F.collect_list(F.struct(F.col("prop").cast("long").alias("prop"), "text"))).alias("said"))
            found = cited(pool.join(said, "entity", "left"), "query", "text_asked", "entity", "rank", "said", client).select("query", "entity", "fit", "rationale", "prop_ids")
        return written(pool.join(found, ["query", "entity"], "left"), "judged")

    def verify(pool: DataFrame) -> DataFrame:
        first = pool.where("fit is not null").select("query", "entity", (-F.col("fit")).alias("order"), "text_asked", "evidence")
        found = verified(first, "query", "entity", "order", "text_asked", "evidence", client)
        return written(pool.join(found.select("query", "entity", (~F.col("holds")).alias("rejected"), F.col("holds").alias("verified")), ["query", "entity"], "left"), "verified")

    good = (F.col("fit") >= selection.PASS_FIT) & ~F.coalesce("rejected", F.lit(False))
    pool = judge(written(retrieval.pool(within(best, 0)), "pool"))
    checked = verify(pool)
    # Where a banded request has too few that pass, its bands are widened once, and the newcomers are judged.
    passing = checked.where(good).groupBy("query").agg(F.count("*").alias("n"))
    thin = asked.where("band_min is not null and (band_min > 1 or band_max < 5)").join(passing, "query", "left").where(F.coalesce("n", F.lit(0)) < F.col("k")).select("query")
    more = written(retrieval.pool(within(best.join(thin, "query", "left_semi"), 1)).join(pool.select("query", "entity"), ["query", "entity"], "left_anti"), "wider-pool")
    widened = more.select("query").distinct()
    if not more.isEmpty():
        again = verify(pool.join(widened, "query", "left_semi").unionByName(judge(more)))
        checked = written(checked.join(widened, "query", "left_anti").unionByName(again), "verified")
    ordered = checked.where(good).withColumn("key", -F.col("fit"))
    chosen = selection.diversified(ordered, "query", "entity", "color_identity", "key", "fit", "vector", "k")
    final = selection.filled(checked, chosen, "query", "entity", "color_identity", "fit", 5)
    results = final.join(asked.select("query", "k"), "query").where(F.col("place") <= F.col("k")).drop("k").join(checked, ["query", "entity"])
    bands = widened.join(asked, "query").select("query", F.concat(F.lit("bands widened to "), F.greatest(F.lit(1), F.col("band_min") - 1).cast("string"), F.lit("-"), F.least(F.lit(5), F.col("band_max") + 1).cast("string")).alias("note"))
    parts = [plans.select("query", F.explode("notes").alias("note")), lost, bands] + ([] if extra is None else [extra])
    return Answers(written(results, "results"), checked, retrieval.logged(lists, fused, weight="w"), _notes(*parts))
