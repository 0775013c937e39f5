"""Command line: ``python -m loomwork COMMAND``. Tables are in a store under ``--root``; see ``loomwork.sources.store``."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import Engine
from .operators import chunks, evaluation, export, incremental, ingest, names, vocabulary
from .plans import batch, models, resumable
from .plans.models import StandIn, embedded
from .plans.search import Request
from .session import session
from .sources.records import read_judged_set, read_records
from .sources.scratch import written
from .sources.store import Store, Transaction, write_jsonl, write_report


def _chunked(cards: DataFrame) -> DataFrame:
    return chunks.chunks(cards, "oracle_id", "name", "type_line", "oracle_text").withColumn("row", F.concat_ws("/", "oracle_id", "face_index", "ordinal"))


def build(spark: SparkSession, root: str, path: str, dim: int = 64) -> None:
    """Cards, types, legalities, names, arts and the rules-text index from raw records, in one commit."""
    every = read_records(spark, path, ingest.CARD).where(ingest.is_paper())
    with Store(spark, root).transaction() as t:
        raw = ingest.default_printings(every)
        chosen = raw.select("oracle_id", F.col("id").alias("printing"))
        arts = ingest.arts(every)
        flagged = incremental.with_default(arts, arts.join(chosen, ["oracle_id", "printing"], "left_semi").select("illustration_id"), "illustration_id")
        # A card whose chosen printing has no art of its own gets the least of the others.
        t.replace("arts", incremental.promoted(flagged, "oracle_id", "illustration_id"))
        cards = _carded(t, raw)
        embed(t, t.replace("chunks", _chunked(cards)), dim)


def _carded(t: Transaction, raw: DataFrame) -> DataFrame:
    """Cards and what hangs on them, replaced."""
    cards = t.replace("cards", ingest.cards(raw).withColumn("entity", F.col("oracle_id")).withColumn("evidence", F.concat_ws("\n", "type_line", "oracle_text")))
    t.replace("types", ingest.types(cards).select(F.col("oracle_id").alias("entity"), "kind", "value"))
    t.replace("legalities", ingest.legalities(raw).select(F.col("oracle_id").alias("entity"), "format", "status"))
    names.stored(names.index(cards, "entity", "name", "edhrec_rank", ingest.faces(raw).select("oracle_id", "name")), t.replace, "names")
    return cards


def embed(t: Transaction, rows: DataFrame, dim: int) -> None:
    """Vectors of the chunks that have none for their text; those of departed chunks go."""
    old = t.read("text_index")
    held = rows.select("row", F.col("oracle_id").alias("entity"), F.lit("any").alias("layer"), F.col("text_embedded").alias("text"))
    if old is None:
        t.replace("text_index", held.join(embedded(rows, "row", "text_embedded", StandIn(dim), dim), "row"))
        return
    known = incremental.cascaded(held, old, "row").join(held.select("row", "text"), ["row", "text"], "left_semi")
    new = held.join(known.select("row"), "row", "left_anti")
    t.replace("text_index", known.select("row", "entity", "layer", "text", "vector").unionByName(new.join(embedded(new, "row", "text", StandIn(dim), dim), "row").select("row", "entity", "layer", "text", "vector")))


def refresh(spark: SparkSession, root: str, path: str, dim: int = 64) -> None:
    """What changed since the last build, in one commit: texts are chunked and embedded anew where they differ; what is gone takes its chunks and
    vectors along."""
    store = Store(spark, root)
    old, had = store.read("cards"), store.read("chunks")
    if old is None or had is None:
        build(spark, root, path, dim)
        return
    before = old.select("oracle_id", "oracle_text")
    with store.transaction() as t:
        cards = _carded(t, ingest.default_printings(read_records(spark, path, ingest.CARD).where(ingest.is_paper())))
        changed = incremental.changes(before, cards, "oracle_id", "oracle_text").where("change = 'changed'")
        embed(t, t.replace("chunks", incremental.rechunked(cards, had, changed, "oracle_id", _chunked)), dim)


def describe(spark: SparkSession, root: str, client: models.ModelClient | None = None) -> None:
    """Descriptions, statements, phrases and mined vocabulary of the arts that have none yet."""
    store = Store(spark, root)
    arts = store.read("arts")
    todo = arts.select(F.col("illustration_id").alias("entity"), F.col("art_crop_url").alias("reference")).dropDuplicates(["entity"])
    resumable.worked(store, "descriptions", todo.where(F.length(F.trim("reference")) > 0), "entity", lambda rows: models.described(rows, "entity", "reference", client))
    rows = store.read("descriptions")
    store.replace("statements", chunks.statements(rows, "entity", F.col("literal_propositions"), F.col("slots"), F.col("interpretive_propositions")).withColumnRenamed("position", "prop"))
    subject = [f"primary_subject.{x}" for x in ("species", "facial_hair", "clothing", "pose", "held_objects")]
    phrases = store.replace("phrases", chunks.slot_phrases(rows, "entity", {p: F.col(f"slots.{p}") for p in (*subject, "other_figures", "palette", "setting", "time_of_day", "art_style", "composition", "figure_count")}))
    kinds = arts.join(store.read("cards").select("oracle_id", "type_line"), "oracle_id").select(F.col("illustration_id").alias("entity"), F.explode(vocabulary.subtypes(F.col("type_line"))).alias("category"))
    species = phrases.where("path = 'primary_subject.species'").select("entity", "phrase")
    store.replace("mined", vocabulary.associations(species, kinds, "entity", rows.select("entity")))


def synth(spark: SparkSession, root: str, client: models.ModelClient | None = None) -> None:
    """Themes and near misses of described arts that have none."""
    store = Store(spark, root)
    props = store.read("statements").groupBy("entity").agg(F.array_sort(F.collect_list(F.struct(F.col("prop").cast("long").alias("prop"), "text"))).alias("statements"))
    rows = store.read("descriptions").select("entity", "literal").join(props, "entity", "left").where("statements is not null")
    log = store.log("synth")
    if log is not None:  # of a store of before
        rows = rows.join(log.select("entity").distinct(), "entity", "left_anti")
    make = lambda part: models.synthesised(part, "entity", "literal", client, "statements").withColumns({"source": F.lit("distill"), "failed": F.lit(None).cast("string")})
    resumable.worked(store, "synth", rows, "entity", make)


def evaluate(spark: SparkSession, root: str, path: str, engine: Engine, which: str = "text") -> dict:
    """A judged set searched as one plan and scored: recall of names, precision of a person's marks, agreement with stored preferences, and
    latency; written as a report, and the searches are logged. A judged set is some dozens of queries, so is what the report says of each."""
    gold = written(read_judged_set(spark, path), "judged")
    asked = gold.select(F.col("id").alias("query"), "text", F.lit(5).alias("k"), *(F.lit(None).cast(kind).alias(c) for c, kind in batch.FILTERS.items()))
    began = time.perf_counter()
    answers = (engine.text_searches if which == "text" else engine.searches)(asked)
    seconds = (time.perf_counter() - began) / max(1, gold.count())
    engine.log_all(asked, answers, seconds)
    shown = lambda df, at: df.select("query", F.col("entity").cast("string").alias("id"), "name", at)
    named = engine.store.read("cards").select(F.col("entity").alias("card"), "name") if which == "art" else None
    pool, results = (df if named is None else df.join(named, "card") for df in (answers.pool, answers.results))
    votes, queries, preferences = engine.store.read("votes"), engine.store.log("queries"), engine.store.log("preferences")
    texts = queries.select("query_id", "text").distinct()
    marks = spark.createDataFrame([], "text string, id string, fit double") if votes is None else evaluation.stored_marks(votes.withColumn("source", F.lit("human")), texts, "seq")
    prefs = spark.createDataFrame([], "text string, a string, b string, winner string") if preferences is None else evaluation.stored_preferences(preferences, texts)
    of_text = gold.select(F.col("id").alias("query"), "text")
    judged = gold.select(F.col("id").alias("query"), "kind", "gold")
    by_query = written(evaluation.scored(judged, shown(pool, "rank"), shown(results, "place"), marks.join(of_text, "text").drop("text"), prefs.join(of_text, "text").drop("text")), "scored")
    kinds = {r["kind"]: r.asDict() for r in evaluation.summary(by_query).collect()}
    pairs = {c: sum(r[c] for r in kinds.values()) for c in ("stored", "comparable", "agree")}
    failed = [r.asDict() for r in answers.notes.where(F.col("note").contains("failed")).collect()]
    timings = engine.store.log("timings").join(of_text.select(F.col("query").alias("query_id")), "query_id", "left_semi")
    took = evaluation.latency(timings, "seconds").head().asDict() | {"n": timings.count()}
    each = {r["query"]: r.asDict() for r in by_query.collect()}
    found = [r["hits_pool"] / r["gold_size"] for r in each.values() if r["gold_size"]]
    report = {"queries": len(each), "recall": sum(found) / len(found) if found else None, "kinds": kinds, "pairwise": pairs | {"agreement": pairs["agree"] / pairs["comparable"] if pairs["comparable"] else None}, "latency": took, "errors": failed, "by_query": each}
    write_report(spark, f"{root}/reports/eval", report)
    return report


def export_training(spark: SparkSession, root: str, out: str) -> None:
    """Labels of the logs as pairs of a query and an art's statements, by split."""
    store = Store(spark, root)
    made = store.read("synth").select(F.col("theme").alias("text"), F.col("entity").alias("id"), "fit", "source", "prop_ids", "register", F.monotonically_increasing_id().alias("seq"))
    labels = export.folded_labels(made, "text", "id", "source", "seq").withColumnRenamed("id", "entity")
    pairs = export.text_for(labels, store.read("statements"), "entity", "prop_ids", "register").where("positive <> ''")
    write_jsonl(export.split(pairs.select("text", "entity", "fit", "positive"), "text"), out)


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="loomwork")
    p.add_argument("--root", default="data")
    sub = p.add_subparsers(dest="command", required=True)
    for name, help_ in (("build", "tables and indexes from raw records"), ("refresh", "the same, where records changed")):
        sub.add_parser(name, help=help_).add_argument("records")
    for name, help_ in (("search", "search rules texts"), ("art", "search art")):
        s = sub.add_parser(name, help=help_)
        s.add_argument("text")
        s.add_argument("-k", type=int, default=5)
    sub.add_parser("resolve", help="resolve names").add_argument("names", nargs="+")
    sub.add_parser("describe", help="descriptions of arts")
    sub.add_parser("synth", help="themes and near misses of described arts")
    sub.add_parser("eval", help="recall for a judged set").add_argument("judged")
    sub.add_parser("export", help="training pairs").add_argument("out")
    for name, help_ in (("status", "tables, rows and last keys"), ("report", "data quality of the cards")):
        sub.add_parser(name, help=help_)
    a = p.parse_args(arguments)
    spark = session()
    engine = Engine(spark, a.root)
    if a.command in ("build", "refresh"):
        (build if a.command == "build" else refresh)(spark, a.root, a.records)
        engine.build_words("text")
        engine.build_near("text")
    elif a.command in ("search", "art"):
        answer = engine.text_search(Request(a.text, a.k)) if a.command == "search" else engine.search(Request(a.text, a.k))
        shown = answer.results
        if {"matched_face_index", "oracle_text"} <= set(shown.columns):
            shown = shown.withColumn("text", chunks.marked_line(F.col("oracle_text"), F.col("matched_face_index"), F.col("matched_ordinal")))
        shown.select(*(c for c in ("entity", "name", "card", "fit", "stretch", "rationale", "text") if c in shown.columns)).show(truncate=False)
        print(*answer.notes, sep="\n")
    elif a.command == "resolve":
        engine.resolve(spark.createDataFrame([(n,) for n in a.names], "query string")).show(truncate=False)
    elif a.command in ("describe", "synth"):
        (describe if a.command == "describe" else synth)(spark, a.root)
    elif a.command == "eval":
        print(json.dumps(evaluate(spark, a.root, a.judged, engine), sort_keys=True))
    elif a.command == "export":
        export_training(spark, a.root, a.out)
    elif a.command == "report":
        ingest.quality_report(engine.store.read("cards")).show(100, truncate=False)
    else:
        engine.status().show(truncate=False)


if __name__ == "__main__":
    main()
