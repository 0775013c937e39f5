"""Batched searches give what single searches give."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loomwork.api import Engine
from loomwork.operators import names
from loomwork.plans import batch
from loomwork.plans.models import StandIn, embedded
from loomwork.plans.search import Request

WORDS = "draw card flies fights creature tap mana token counter spell exile grave haste guard land beast spirit dragon storm".split()


@pytest.fixture(scope="module")
def client():
    class Router(StandIn):
        """Routes some requests to filters of its own."""

        def route(self, text):
            plan = super().route(text)
            if "beast" in text:
                plan["filters"] = {"types": ["beast", "no-such"], "mv_min": 2, "formats": ["nowhere"]}
                plan["mechanical_terms"] = ["dragon"]
            if "nothing" in text:
                plan["filters"] = {"colors": "G"}
                plan["semantic_intent"] = ""
            if "slots" in text:
                plan["slot_filters"] = [{"path": "setting", "op": "contains", "value": "storm"}, {"path": "nope", "op": "equals", "value": "x"}]
            return plan

    return Router(16)


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory, client):
    e = Engine(spark, str(tmp_path_factory.mktemp("engine")), client, dim=16)
    rng = random.Random(2)
    rows = [(f"c{i:02d}", f"Name {i}", float(rng.randrange(7)), "".join(sorted(rng.sample("WUBRG", rng.randrange(3)))), float(i) if i % 3 else None, " ".join(rng.choices(WORDS, k=rng.randint(3, 9)))) for i in range(60)]
    cards = e.store.replace("cards", spark.createDataFrame(rows, "entity string, name string, cmc double, color_identity string, edhrec_rank double, evidence string"))
    kinds = ["Creature", "Beast", "Spirit", "Land"]
    e.store.replace("types", spark.createDataFrame([(r[0], "type", k) for r in rows for k in rng.sample(kinds, 2)], "entity string, kind string, value string"))
    e.store.replace("legalities", spark.createDataFrame([(r[0], f, rng.choice(["legal", "banned"])) for r in rows for f in ("modern", "legacy")], "entity string, format string, status string"))
    e.store.replace("names", names.index(cards, "entity", "name", "edhrec_rank"))
    index = cards.select(F.concat("entity", F.lit("/0")).alias("row"), "entity", F.lit("any").alias("layer"), F.col("evidence").alias("text"))
    e.store.replace("text_index", index.join(embedded(index, "row", "text", client, 16), "row"))
    art = cards.select("entity", F.concat(F.lit("k"), F.substring("entity", 2, 2).cast("int") % 40).alias("card"), "color_identity", (F.substring("entity", 2, 2).cast("int") % 5 + 1).alias("band"), "evidence")
    e.store.replace("art_entities", art.join(embedded(art, "entity", "evidence", client, 16), "entity"))
    both = index.withColumn("layer", F.lit("literal")).unionByName(index.withColumn("row", F.concat("entity", F.lit("/1"))).withColumn("layer", F.lit("interpretive")).withColumn("text", F.reverse("text")))
    e.store.replace("art_index", both.join(embedded(both, "row", "text", client, 16), "row"))
    e.store.replace("phrases", spark.createDataFrame([(r[0], "setting", "a storm at sea" if i % 2 else "a quiet land") for i, r in enumerate(rows)], "entity string, path string, phrase string"))
    for which in ("text", "art"):
        e.build_words(which)
        e.build_near(which)
    return e


TEXT = {
    "typed": Request("tap for mana", types=["creature beast", "unheard"], formats=["modern"]), "all unknown": Request("tap", types=["unheard"]), "cheap": Request("haste guard", k=3, mv=(None, 2), colors="WU"),
    "none pass": Request("haste", types=["land"], formats=["nowhere"]), "routed": Request("a beast in a storm", k=2), "popular": Request("nothing else"), "popular too": Request("nothing", types=["spirit"]), "named": Request("name 7"), "rules": Request("Can  I draw a card?"),
}


def test_text_searches_are_single_searches(spark, engine):
    answers = engine.text_searches(batch.requests(spark, list(TEXT.items())))
    got, pools, notes = {}, {}, {}
    for r in answers.results.collect():
        got.setdefault(r["query"], []).append((r["place"], r["entity"]))
    for r in answers.pool.collect():
        pools.setdefault(r["query"], set()).add((r["rank"], r["entity"], round(r["score"], 9)))
    for r in answers.notes.collect():
        notes.setdefault(r["query"], set()).add(r["note"])
    for q, request in TEXT.items():
        one = engine.text_search(request)
        rows = one.results.collect()
        assert [e for _, e in sorted(got.get(q, []))] == [r["entity"] for r in rows], q
        if "rank" in one.pool.columns and "score" in one.pool.columns:
            assert pools.get(q, set()) == {(r["rank"], r["entity"], round(r["score"], 9)) for r in one.pool.collect()}, q
        assert notes.get(q, set()) == set(one.notes), q


ART = {"banded": Request("storm dragon", k=3, band=(2, 3)), "thin": Request("storm dragon haste", k=5, band=(5, 5)), "terms": Request("a beast", k=5, colors="WGU"), "slots": Request("slots of a token", k=5)}


def test_art_searches_are_single_searches(spark, engine):
    answers = engine.searches(batch.requests(spark, list(ART.items())))
    got, notes = {}, {}
    for r in answers.results.collect():
        got.setdefault(r["query"], []).append((r["place"], r["entity"], r["stretch"]))
    for r in answers.notes.collect():
        notes.setdefault(r["query"], set()).add(r["note"])
    for q, request in ART.items():
        one = engine.search(request)
        assert sorted(got.get(q, [])) == [(r["place"], r["entity"], r["stretch"]) for r in one.results.collect()], q
        assert notes.get(q, set()) == set(one.notes), q
    log = answers.log.groupBy("query", "method").agg(F.min("rank").alias("first"), F.count("*").alias("n"), F.collect_set("layer").alias("layers")).collect()
    assert {(r["query"], r["method"]) for r in log} >= {(q, "rrf") for q in ART} and all(r["first"] == 1 and r["n"] <= 100 for r in log)
    assert {x for r in log if r["method"] != "rrf" for x in r["layers"]} == {"literal", "interpretive"}


def test_evaluation_of_a_judged_set_is_one_plan(spark, engine, tmp_path):
    from loomwork.__main__ import evaluate

    rows = [{"id": "q1", "kind": "literal", "text": "draw card flies", "gold": ["name 3", "Nobody"]}, {"id": "q2", "text": "storm"}, {"id": "q3", "kind": "adversarial", "text": "haste guard"}]
    (tmp_path / "judged.jsonl").write_text("\n".join(map(json.dumps, rows)))
    found = engine.text_searches(batch.requests(spark, [("q2", Request("storm"))])).results.orderBy("place").collect()
    engine.store.append("queries", spark.createDataFrame([("old", "storm")], "query_id string, text string").withColumn("created_at", F.current_timestamp()))
    votes = spark.createDataFrame([("old", found[0]["entity"], 1.0, 1), ("old", found[1]["entity"], 0.0, 2)], "query_id string, id string, fit double, seq int")
    assert engine.feedback(votes).isEmpty()
    engine.store.append("preferences", spark.createDataFrame([("old", found[0]["entity"], found[1]["entity"], found[0]["entity"]), ("old", found[0]["entity"], "gone", "gone")], "query_id string, a string, b string, winner string"))
    report = evaluate(spark, str(tmp_path), str(tmp_path / "judged.jsonl"), engine)
    assert report["kinds"]["abstract"]["marked"] == 2 and report["kinds"]["abstract"]["p_at_5"] == 0.5
    assert report["pairwise"] == {"stored": 2, "comparable": 1, "agree": 1, "agreement": 1.0}
    assert report["kinds"]["literal"]["gold_names"] == 2 and report["kinds"]["literal"]["recall_pool"] in (0.0, 0.5) and report["errors"] == []
    assert report["latency"]["n"] == 3 and report["latency"]["mean"] > 0
    stored = json.loads(spark.read.text(f"{tmp_path}/reports/eval").head()[0])
    assert stored["by_query"]["q1"]["gold_size"] == 2
