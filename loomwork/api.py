"""One object for all that the service offers."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import bitmaps, incremental, inverted, names, retrieval, scoring, vectors, vocabulary
from .plans import batch
from .plans.models import ModelClient, StandIn, told
from .plans.search import Answer, Request, art_search, text_search
from .sources.store import Store


class Engine:
    """Searches over a store's tables. Indexes are kept until the corpus changes."""

    def __init__(self, spark: SparkSession, root: str, client: ModelClient | None = None, dim: int = 64):
        self.spark, self.store, self.client, self.dim = spark, Store(spark, root), client or StandIn(dim), dim
        self._built: tuple[tuple, dict[str, DataFrame]] | None = None
        self._told: dict[str, ModelClient] = {}

    def _tables(self) -> dict[str, DataFrame]:
        names_ = ("art_index", "art_entities", "text_index", "cards", "types", "legalities", "names", "chunks", "phrases", "mined", "statements", "numbers", "maps", *(f"{i}_{t}" for i in ("art", "text") for t in ("blocks", "terms", "totals")), *(f"{i}_near_{t}" for i in ("art_literal", "art_interpretive", "text_any") for t in ("rows", "cells")))
        version = tuple(self.store.current(n) for n in names_)
        if self._built is None or self._built[0] != version:
            self.refresh()
            self._built = (version, {n: df for n in names_ if (df := self.store.read(n)) is not None})
        return self._built[1]

    def refresh(self) -> None:
        """Forget what was read; the next request reads the current snapshots."""
        self._built, self._told = None, {}

    def _router(self, which: str) -> ModelClient:
        """The client, told what words the corpus has; asked for once as long as the tables stay."""
        t = self._tables()
        if which not in self._told:
            words = None
            if which == "art" and "phrases" in t:
                kinds = t["mined"].select(F.col("category").alias("value")) if "mined" in t else t["phrases"].limit(0).select(F.col("phrase").alias("value"))
                words = vocabulary.router_hint(t["phrases"], "primary_subject.species", kinds)
            elif which == "text":
                words = vocabulary.type_vocabulary(t["types"])
            self._told[which] = self.client if words is None else told(self.client, words)
        return self._told[which]

    def search(self, request: Request) -> Answer:
        t = self._tables()
        return self._timed(lambda: art_search(self.spark, request, t["art_index"], t["art_entities"], self._router("art"), self.dim, t.get("phrases"), t.get("mined"), t.get("statements"), self._words(t, "art")))

    def text_search(self, request: Request) -> Answer:
        t = self._tables()
        answer = self._timed(lambda: text_search(self.spark, request, t["text_index"], t["cards"], t["types"], t["legalities"], t["names"], self._router("text"), self.dim, self._words(t, "text")))
        if "chunks" in t and "best_row" in answer.results.columns:
            answer.results = retrieval.located(answer.results, t["chunks"])
        return answer

    def build_words(self, which: str) -> None:
        """The word index of the index ``which`` (art or text), which searches read instead of its texts."""
        inverted.stored(inverted.build(self.store.read(f"{which}_index"), "row", "text"), self.store.replace, which)

    def build_near(self, which: str) -> None:
        """Its vector indexes, one a layer, and for rules texts the bitmaps of filters; ``searches`` reads them."""
        index = self.store.read(f"{which}_index")
        for layer in ("literal", "interpretive") if which == "art" else ("any",):
            vectors.stored(vectors.build(index.where(F.col("layer") == layer), "row", "vector", self.dim), self.store.replace, f"{which}_{layer}_near")
        if which == "text":
            cards = self.store.read("cards")
            numbers = self.store.replace("numbers", bitmaps.numbered(cards, "entity"))
            self.store.replace("maps", bitmaps.bitmaps(batch.corpus_sets(cards, self.store.read("types"), self.store.read("legalities")), numbers))

    def _words(self, tables: dict[str, DataFrame], which: str) -> inverted.WordIndex | None:
        held = [tables.get(f"{which}_{name}") for name in ("blocks", "terms", "totals")]
        return None if None in held else inverted.WordIndex(*held)

    def _corpus(self, which: str) -> batch.Corpus:
        t = self._tables()
        words = self._words(t, which)
        layers = ("literal", "interpretive") if which == "art" else ("any",)
        if words is None or any(f"{which}_{x}_near_rows" not in t for x in layers):
            raise ValueError(f"the {which} index has no word or vector index yet: build_words, build_near")
        near = {x: vectors.VectorIndex(t[f"{which}_{x}_near_rows"], t[f"{which}_{x}_near_cells"]) for x in layers}
        return batch.Corpus(t[f"{which}_index"].select("row", "entity", "layer"), words, near, t["art_entities" if which == "art" else "cards"], t.get("numbers"), t.get("maps"))

    def searches(self, requests: DataFrame) -> batch.Answers:
        """Art searches of many requests (``batch.REQUEST``), as one plan."""
        t = self._tables()
        return batch.art_searches(requests, self._corpus("art"), self._router("art"), self.dim, t.get("phrases"), t.get("mined"), t.get("statements"))

    def text_searches(self, requests: DataFrame) -> batch.Answers:
        """Searches of rules texts of many requests, as one plan."""
        return batch.text_searches(requests, self._corpus("text"), self._tables()["names"], self._router("text"), self.dim)

    def _timed(self, run: Callable[[], Answer]) -> Answer:
        began = time.perf_counter()
        answer = run()
        answer.seconds = time.perf_counter() - began
        return answer

    def typical_seconds(self) -> DataFrame | None:
        """Median of the last twenty logged searches."""
        log = self.store.log("timings")
        return None if log is None else scoring.rolling_median(log.withColumn("all", F.lit(1)), "seconds", [F.desc("created_at")], ["all"]).drop("all")

    def resolve(self, queries: DataFrame, max_layer: int = 5) -> DataFrame:
        return names.resolve(queries, self._tables()["names"], max_layer, kept=True)

    def feedback(self, votes: DataFrame) -> DataFrame:
        """Votes (query_id, id, fit, seq) on known queries replace earlier ones, and take over the citations of the judge's own last judgment of
        that pair; returned are those of unknown queries, which are not written."""
        known = self.store.log("queries")
        if known is None:
            return votes
        ids = known.select("query_id").distinct()
        good = votes.join(ids, "query_id", "left_semi")
        if not good.isEmpty():
            judged = self.store.log("judgments")
            if judged is not None:
                last = judged.groupBy("query_id", F.col("entity").alias("id")).agg(F.max_by("prop_ids", "created_at").alias("prop_ids"))
                good = good.withColumn("id", F.col("id").cast("string")).join(last, ["query_id", "id"], "left")
            else:
                good = good.withColumn("prop_ids", F.lit(None).cast("array<bigint>"))
            self.store.upsert("votes", good, ["query_id", "id"], "seq")
        return votes.join(ids, "query_id", "left_anti")

    def log(self, query_id: str, request: Request, answer: Answer) -> None:
        self.store.append("queries", self.spark.createDataFrame([(query_id, request.text)], "query_id string, text string").withColumn("created_at", F.current_timestamp()))
        if answer.log is not None:
            self.store.append("retrievals", answer.log.select(F.lit(query_id).alias("query_id"), F.col("id").cast("string").alias("entity"), "rank", "score", "method", "layer"))
        if "fit" in answer.pool.columns:
            cited = F.col("prop_ids") if "prop_ids" in answer.pool.columns else F.lit(None).cast("array<bigint>")
            judged = answer.pool.where("fit is not null").select(F.lit(query_id).alias("query_id"), F.col("entity").cast("string").alias("entity"), "fit", cited.alias("prop_ids"), F.lit("judge").alias("source"), F.current_timestamp().alias("created_at"))
            self.store.append("judgments", judged)
        if answer.seconds is not None:
            self.store.append("timings", self.spark.createDataFrame([(query_id, answer.seconds)], "query_id string, seconds double").withColumn("created_at", F.current_timestamp()))

    def log_all(self, requests: DataFrame, answers: batch.Answers, seconds: float) -> None:
        """Logs of a batch: its requests, what each method found for them, and their judgments; ``seconds`` is each request's share of the time."""
        now = F.current_timestamp().alias("created_at")
        self.store.append("queries", requests.select(F.col("query").alias("query_id"), "text", now))
        self.store.append("retrievals", answers.log.select(F.col("query").alias("query_id"), F.col("id").cast("string").alias("entity"), "rank", "score", "method", "layer"))
        cited = F.col("prop_ids") if "prop_ids" in answers.pool.columns else F.lit(None).cast("array<bigint>")
        judged = answers.pool.where("fit is not null").select(F.col("query").alias("query_id"), F.col("entity").cast("string").alias("entity"), "fit", cited.alias("prop_ids"), F.lit("judge").alias("source"), now)
        self.store.append("judgments", judged)
        self.store.append("timings", requests.select(F.col("query").alias("query_id"), F.lit(float(seconds)).alias("seconds"), now))

    def status(self) -> DataFrame:
        return incremental.fingerprint({n: (df, df.columns[0]) for n, df in self._tables().items()})
