"""The two searches, as plans over built indexes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters, inverted, names, retrieval, selection, vocabulary
from ..sources.scratch import written
from .models import ModelClient, StandIn, cited, embedded, expansions, judged, routed, verified, weights


@dataclass
class Request:
    text: str
    k: int = 5
    band: tuple[int, int] | None = None
    colors: str | None = None
    mv: tuple[int | None, int | None] = (None, None)
    types: list[str] = field(default_factory=list)
    formats: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        """Refuse what the service refuses."""
        if not 1 <= len(self.text.strip()) <= 300:
            raise ValueError("the text must have 1 to 300 characters")
        if not 1 <= self.k <= 5:
            raise ValueError("k must be 1 to 5")
        if self.band and not 1 <= self.band[0] <= self.band[1] <= 5:
            raise ValueError("bands are 1 to 5, in order")
        if self.colors is not None and set(self.colors.upper()) - set("WUBRG"):
            raise ValueError("colours are letters of WUBRG")
        low, high = self.mv
        if any(v is not None and not 0 <= v <= 30 for v in self.mv) or (low is not None and high is not None and low > high):
            raise ValueError("mana values are 0 to 30, in order")

    def echo(self) -> tuple[str, str]:
        """The filters as a line to show, and as a query of the public card search."""
        asked = {"types": self.types, "colors": self.colors, "mv": self.mv, "formats": self.formats}
        return filters.echo(**asked), filters.external_query(**asked)


@dataclass
class Answer:
    results: DataFrame
    pool: DataFrame
    notes: list[str]
    seconds: float | None = None
    log: DataFrame | None = None


def retrieve(spark: SparkSession, rows: DataFrame, wanted: list[tuple[str, str]], layer_weight: dict[str, float], client: ModelClient, dim: int, allowed: DataFrame | None = None, words_of: inverted.WordIndex | None = None) -> tuple[DataFrame, DataFrame]:
    """(query=0, entity, score, lists, best_row), and the rows of the retrieval log, of an index ``rows`` (row, entity, layer, text, vector). A list is one expansion by one
    method, over the rows of its layer; statistics of words cover all layers. ``words_of``: the word index of the rows,
    without which their texts are read."""
    asked = spark.createDataFrame([(i, layer, text, layer_weight.get(layer, 1.0)) for i, (layer, text) in enumerate(wanted)], "q int, want string, text string, w double")
    layers = rows.select("row", "entity", "layer")
    if allowed is not None:
        layers = layers.join(retrieval.small(allowed.select(F.col(allowed.columns[0]).alias("entity")).distinct()), "entity", "left_semi")
    ids = layers.select("row")
    own_layer = asked.select(F.col("q").alias("of"), "want")

    def keep(scores: DataFrame) -> DataFrame:
        met = scores.join(layers, F.col("doc") == F.col("row")).join(F.broadcast(own_layer), F.col("query") == F.col("of")).where(F.col("want") == F.col("layer"))
        return met.select("query", "doc", "score")

    met = retrieval.bm25(rows, "row", "text", asked, "q", "text", ids) if words_of is None else inverted.topk(words_of, asked, "q", "text", keep=keep)
    words = met.select(F.col("query").alias("q"), F.col("doc").alias("row"), "score")
    vectors = embedded(asked, "q", "text", client, dim)
    near = None
    for layer in sorted({layer for layer, _ in wanted}):  # a layer's rows meet its own expansions only
        own_rows, own_asked = rows.where(F.col("layer") == layer), vectors.join(F.broadcast(asked.where(F.col("want") == layer).select("q")), "q")
        found = retrieval.dense(own_rows, "row", "vector", own_asked, "q", "vector", allowed=ids).select(F.col("query").alias("q"), F.col("doc").alias("row"), "score")
        near = found if near is None else near.unionByName(found)
    scored = words.withColumn("method", F.lit("bm25")).unionByName(near.withColumn("method", F.lit("dense")))
    own = scored.join(layers, "row").join(F.broadcast(asked.select("q", "want", "w")), "q").where(F.col("want") == F.col("layer"))
    ranked = retrieval.ranked(own, retrieval.DEPTH, ("q", "method"), "row")
    lists = ranked.select(F.lit(0).alias("query"), F.concat_ws("/", F.lpad(F.col("q").cast("string"), 3, "0"), "method").alias("list"), "method", "layer", "entity", "row", "rank", "w")
    lists = written(lists, "lists")
    fused = retrieval.fuse(lists, weight="w")
    return fused, retrieval.logged(lists, fused, weight="w")


#: Columns of a card that mechanical terms are looked for in, those that are there.
MECHANICAL = ("oracle_text", "type_line", "themes", "archetypes")


def art_search(spark: SparkSession, request: Request, index: DataFrame, entities: DataFrame, client: ModelClient | None = None, dim: int = 64, phrases: DataFrame | None = None, mined: DataFrame | None = None, statements: DataFrame | None = None, words_of: inverted.WordIndex | None = None) -> Answer:
    """``index`` (row, entity, layer, text, vector), ``entities`` (entity, card, color_identity, band, evidence, vector, and columns of
    ``MECHANICAL``). ``phrases`` (entity, path, phrase) and ``mined``, the associations of their vocabulary, serve the plan's slot filters.
    With ``statements`` (entity, prop, text) judgments cite those that they rest on. A finalist that verification rejects stays in the pool,
    marked, and is never chosen."""
    client, notes = client or StandIn(dim), []
    plan = routed(client, request.text)
    notes += plan.get("notes", [])
    layer_weight = weights(plan)
    if index.isEmpty():
        return Answer(entities.limit(0), entities.limit(0), [*notes, "the index is empty"])
    slots = filters.clean_slots(plan.get("slot_filters"), notes)
    ids = vocabulary.allowed(phrases, "entity", slots, notes, mined) if phrases is not None else None
    fused, log = retrieve(spark, index, expansions(client, request.text, layer_weight), layer_weight, client, dim, ids, words_of)
    rows = retrieval.collapse(fused.join(entities, "entity"), "card")
    rows = filters.mechanical(rows, [t for t in plan.get("mechanical_terms") or [] if t], [c for c in MECHANICAL if c in rows.columns] or ["evidence"], notes)
    if request.colors:
        p = filters.subset_of(F.col("color_identity"), request.colors)
        rows = rows if p is None else rows.where(p)

    def judge(pool: DataFrame) -> DataFrame:
        asked = pool.withColumn("text_asked", F.lit(request.text))
        if statements is None:
            found = judged(asked, "query", "text_asked", "entity", "rank", "evidence", client).select("entity", "fit")
        else:
            own = statements.join(pool.select("entity"), "entity", "left_semi").groupBy("entity").agg(F.array_sort(F.collect_list(F.struct(F.col("prop").cast("long").alias("prop"), "text"))).alias("said"))
            found = cited(asked.join(own, "entity", "left"), "query", "text_asked", "entity", "rank", "said", client).select("entity", "fit", "rationale", "prop_ids")
        return written(pool.join(found, "entity", "left"), "judged")

    def verify(pool: DataFrame) -> DataFrame:
        """The best of the pool once more, one by one."""
        best = pool.where("fit is not null").select("query", "entity", (-F.col("fit")).alias("order"), F.lit(request.text).alias("asked"), "evidence")
        found = verified(best, "query", "entity", "order", "asked", "evidence", client)
        return pool.join(found.select("entity", (~F.col("holds")).alias("rejected"), F.col("holds").alias("verified")), "entity", "left")

    banded = rows if request.band is None else filters.in_bands(rows, *request.band)
    pool = judge(retrieval.pool(banded))
    final_pool = written(verify(pool), "verified")
    passing = final_pool.where((F.col("fit") >= selection.PASS_FIT) & ~F.coalesce("rejected", F.lit(False)))
    if request.band is not None and passing.count() < request.k:
        wider = filters.relaxed(*request.band)
        if wider != request.band:
            more = retrieval.pool(filters.in_bands(rows, *wider)).join(pool.select("entity"), "entity", "left_anti")
            if not more.isEmpty():
                notes.append(f"bands widened to {wider[0]}-{wider[1]}")
                final_pool = written(verify(pool.unionByName(judge(more))), "verified")
                passing = final_pool.where((F.col("fit") >= selection.PASS_FIT) & ~F.coalesce("rejected", F.lit(False)))
    if final_pool.where("verified is not null").isEmpty() and not final_pool.isEmpty():
        notes.append("nothing could be verified; the order is the judge's")
    ordered = passing.withColumn("key", -F.col("fit"))
    chosen = selection.diversified(ordered, "query", "entity", "color_identity", "key", "fit", "vector", request.k)
    final = selection.filled(final_pool, chosen, "query", "entity", "color_identity", "fit", request.k)
    shown = selection.passing_first(final, "query").join(final_pool.drop("query"), "entity").orderBy("place")
    return Answer(shown, final_pool, notes, log=log)


# How questions about the rules begin.
RULES_PREFIXES = (
    "can i", "can you", "does", "do i", "do you", "how does", "how do", "what happens if", "what happens when", "when do i", "when does", "am i allowed to", "is it legal to", "am i able to",
)


def rules_question(text: str) -> bool:
    return " ".join(text.lower().split()).startswith(RULES_PREFIXES)


def _soft(rows: DataFrame, plan: dict, types: DataFrame, legalities: DataFrame, notes: list[str]) -> DataFrame:
    """``rows`` under the routed filters (mv_min, mv_max, colors, types, formats), each of which is dropped where it would leave nothing."""
    wanted, own = plan.get("filters") or {}, {}
    own["mana value"] = filters.between_bounds(F.col("cmc"), wanted.get("mv_min"), wanted.get("mv_max"), notes)
    own["colours"] = filters.subset_of(F.col("color_identity"), wanted.get("colors"))
    marks = []
    if wanted.get("types"):
        ids = filters.typed(types, "entity", "value", wanted["types"], notes)
        marks += [] if ids is None else [("types", ids)]
    if wanted.get("formats"):
        marks.append(("formats", filters.legal_in(legalities, "entity", wanted["formats"])))
    for name, ids in marks:
        rows = rows.join(ids.select("entity", F.lit(True).alias(f"_{name}")), "entity", "left")
        own[name] = F.col(f"_{name}")
    return filters.soft(rows, own, notes=notes)[0].drop(*(f"_{name}" for name, _ in marks))


def text_search(spark: SparkSession, request: Request, index: DataFrame, cards: DataFrame, types: DataFrame, legalities: DataFrame, name_index: DataFrame, client: ModelClient | None = None, dim: int = 64, words_of: inverted.WordIndex | None = None) -> Answer:
    """Hard filters, the plan's soft ones among what they leave, then retrieval within. ``index`` as above with the layer ``any``; ``cards``
    (entity, name, cmc, color_identity, edhrec_rank, evidence). A text that names exactly one card is answered as such; a rules question is
    declined. ``best_row`` of a result is the matched row of the index."""
    client, notes = client or StandIn(dim), []
    asked = spark.createDataFrame([(request.text,)], "query string")
    named = names.resolve(asked, name_index, max_layer=2, kept=True).where("total = 1")
    if not named.isEmpty():
        hit = cards.join(named.select(F.col("id").alias("entity"), "place"), "entity").orderBy("place")
        return Answer(hit, hit, ["that is a card's name"])
    if rules_question(request.text):
        return Answer(cards.limit(0), cards.limit(0), ["rules questions are not answered"])
    rows = filters.hard(cards, {"mv": filters.between_bounds(F.col("cmc"), *request.mv, notes), "colors": filters.subset_of(F.col("color_identity"), request.colors)})
    if request.types:
        ids = filters.typed(types, "entity", "value", request.types, notes)
        rows = rows if ids is None else rows.join(ids, "entity", "left_semi")
    if request.formats:
        rows = rows.join(filters.legal_in(legalities, "entity", request.formats), "entity", "left_semi")
    if rows.isEmpty():
        return Answer(rows, rows, [*notes, "nothing passes the filters"])
    plan = routed(client, request.text)
    notes += plan.get("notes", [])
    rows = _soft(rows, plan, types, legalities, notes)
    intent = (plan.get("semantic_intent") or "").strip()
    if not intent:
        best = filters.structural(rows, "edhrec_rank", "entity", request.k)
        return Answer(best, best, [*notes, "ordered by popularity"])
    fused, log = retrieve(spark, index, [("any", t) for _, t in expansions(client, intent, {"literal": 1.0})], {"any": 1.0}, client, dim, rows.select("entity"), words_of)
    pool = retrieval.pool(fused.join(rows, "entity"), retrieval.RULES_POOL)
    fit = judged(pool.withColumn("text_asked", F.lit(request.text)), "query", "text_asked", "entity", "rank", "evidence", client).select("entity", "fit")
    pool = pool.join(fit, "entity", "left")
    return Answer(selection.by_fit(pool, "fit", "entity", ("query",), request.k).orderBy("place"), pool, notes, log=log)
