"""Operators on small tables of invented values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomwork.functions import text as X
from loomwork.operators import chunks, evaluation, export, filters, incremental, ingest, names, retrieval, scoring, selection, vocabulary


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column).head()[0]


def test_tokenize_keeps_accents(spark):
    assert one(spark, X.tokenize(F.col("t")), t="Une Étude_1 of 3.5!") == ["une", "étude_1", "of", "3", "5"]


def test_singular(spark):
    df = spark.createDataFrame([(w,) for w in ("wolves", "ponies", "glass", "status", "axis", "cats", "dies", "gas")], "t string")
    assert [r[0] for r in df.select(X.singular(F.col("t"))).collect()] == ["wolve", "pony", "glass", "status", "axis", "cat", "die", "gas"]


@pytest.mark.parametrize(("name", "folded"), [("Tél-Orô's Gate", "tel oros gate"), ("Ærath // Ice", "aerath ice"), ("Straße", "strasse"), ("  ", "")])
def test_fold(name, folded):
    assert X.fold_name(name) == folded


def test_edit_budget(spark):
    df = spark.createDataFrame([("a" * n,) for n in (1, 6, 7, 9, 10, 30)], "t string")
    assert [r[0] for r in df.select(X.edit_budget(F.col("t"))).collect()] == [1, 1, 2, 2, 3, 3]


def test_bounded_distance_is_levenshtein(spark):
    rng = random.Random(1)
    words = ["", "a", "ab", *("".join(rng.choices("abc", k=rng.randint(1, 7))) for _ in range(12))]

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    df = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    for budget in range(6):
        for r in df.select("a", "b", X.bounded_distance(F.col("a"), F.col("b"), budget).alias("d")).collect():
            assert r["d"] == (lev(r["a"], r["b"]) if lev(r["a"], r["b"]) <= budget else None)


def test_numeric(spark):
    df = spark.createDataFrame([(t,) for t in ("3", " 7 ", "*", "1+*", "2.5", "X", None)], "t string")
    assert [r[0] for r in df.select(X.numeric(F.col("t"))).collect()] == [3.0, 7.0, None, None, None, None, None]


def test_bm25_against_plain_python(spark):
    texts = ["the cat sat on the mat", "a dog and a cat", "birds fly", "", "the the the mat"]
    asked = ["cat mat", "the the bird", "zebra"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {(r["query"], r["doc"]): r["score"] for r in retrieval.bm25(docs, "id", "text", spark.createDataFrame(list(enumerate(asked)), "q long, text string"), "q", "text").collect()}
    toks = [t.split() for t in texts]
    n, avg = len(toks), sum(map(len, toks)) / len(toks)
    vocab = {w for t in toks for w in t}
    raw = {w: math.log(n - sum(w in t for t in toks) + 0.5) - math.log(sum(w in t for t in toks) + 0.5) for w in vocab}
    mean = sum(raw.values()) / len(raw)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in raw.items()}
    want = {}
    for q, text in enumerate(asked):
        for d, t in enumerate(toks):
            s = sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in text.split() if w in t)
            if s > 0:
                want[q, d] = s
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_bm25_mask_keeps_scores(spark):
    docs = spark.createDataFrame([(0, "cat mat"), (1, "cat"), (2, "dog"), (3, "cow"), (4, "cat cow")], "id long, text string")
    asked = spark.createDataFrame([(0, "cat")], "q long, text string")
    every = {r["doc"]: r["score"] for r in retrieval.bm25(docs, "id", "text", asked, "q", "text").collect()}
    some = {r["doc"]: r["score"] for r in retrieval.bm25(docs, "id", "text", asked, "q", "text", docs.where("id = 1").select("id")).collect()}
    assert some == {1: every[1]}


def test_fusion_counts_an_entity_once_a_list(spark):
    lists = spark.createDataFrame([(0, "a", "x", 1, 1, 1.0), (0, "a", "x", 2, 2, 1.0), (0, "a", "y", 3, 3, 1.0)], "query int, list string, entity string, row int, rank int, w double")
    got = {r["entity"]: r["score"] for r in retrieval.fuse(lists, weight="w").collect()}
    assert got == {"x": pytest.approx(1 / 61), "y": pytest.approx(1 / 63)}


def test_dense_breaks_ties_by_id_and_skips_wrong_lengths(spark):
    v = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (9, [1.0])], "id long, v array<float>")
    got = [(r["doc"], r["rank"]) for r in retrieval.dense(v, "id", "v", v.where("id = 3"), "id", "v", depth=2).orderBy("rank").collect()]
    assert got == [(1, 1), (3, 2)]


def test_filters(spark):
    cards = spark.createDataFrame([("a", 0.0, ""), ("b", 3.0, "WU"), ("c", 7.0, "WUB"), ("d", None, None)], "id string, cmc double, colors string")
    ids = lambda p: sorted(r[0] for r in cards.where(p).select("id").collect())
    assert ids(filters.between_bounds(F.col("cmc"), 3, 3)) == ["b"]
    assert ids(filters.between_bounds(F.col("cmc"), 5, 3)) == []
    notes = []
    assert filters.between_bounds(F.col("cmc"), 99, None, notes) is None and notes
    for op, want in (("<", ["a"]), ("<=", ["a", "b"]), ("=", ["b"]), (">=", ["b", "c"]), (">", ["c"])):
        assert ids(filters.compare(F.col("cmc"), op, 3)) == want
    assert ids(filters.compare(F.col("cmc"), "between", low=7, high=3)) == ["b", "c"]
    assert ids(filters.subset_of(F.col("colors"), "uw")) == ["a", "b"]
    assert filters.subset_of(F.col("colors"), "") is None
    kept, used = filters.soft(cards, {"low": F.col("cmc") < 5, "none": F.col("cmc") > 50, "mono": F.col("colors") == "WUB"})
    assert used == ["low"] and kept.count() == 2


def test_typed_drops_unknown(spark):
    t = spark.createDataFrame([("a", "elf"), ("a", "druid"), ("b", "elf"), ("c", "angel")], "id string, value string")
    notes = []
    assert sorted(r[0] for r in filters.typed(t, "id", "value", ["elf druid", "Angel", "elf gizmo"], notes).collect()) == ["a", "c"]
    assert len(notes) == 1
    assert filters.typed(t, "id", "value", ["gizmo"]) is None


def test_scores(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 9.0), (4, None), (5, 1.0)], "id int, v double")
    assert {r["id"]: r["p"] for r in scoring.midrank(df, "v", "p").collect()} == {1: 0.5, 2: 0.5, 3: 0.875, 4: 0.0, 5: 0.125}
    assert {r["id"]: r["m"] for r in scoring.minmax(df.where("v = 5"), "v", "m").collect()} == {1: 0.0, 2: 0.0}
    b = {r["id"]: r["band"] for r in scoring.bands(df, "v").collect()}
    assert b[1] == b[2] and b[4] is None and b[3] == 5 and b[5] == 1


def test_chunks(spark):
    df = spark.createDataFrame([("x", "Mara, the Bold", "Creature", "Mara flies.\n\n  Draw. \n//\nMara, the Bold sings")], "id string, name string, type string, text string")
    got = [(r["face_index"], r["ordinal"], r["kind"], r["text_embedded"]) for r in chunks.chunks(df, "id", "name", "type", "text").orderBy("face_index", "ordinal").collect()]
    assert got[1:] == [(0, 0, "ability", "this card flies."), (0, 1, "ability", "Draw."), (1, 0, "ability", "this card sings")]
    assert got[0][:3] == (0, -1, "whole") and got[0][3].startswith("Creature\nthis card flies.")


def test_types(spark):
    got = one(spark, chunks.parsed_types(F.col("t")), t="Legendary Creature — Elf Druid // Land")
    assert [(x["kind"], x["value"]) for x in got] == [("supertype", "legendary"), ("type", "creature"), ("subtype", "elf"), ("subtype", "druid"), ("type", "land")]


def test_statements(spark):
    df = spark.createDataFrame([(1, ["- A dog.", "* a  DOG.", "x", "2) Rain"])], "id int, s array<string>")
    assert [(r["position"], r["text"]) for r in chunks.distinct_statements(df, "id", "s").orderBy("position").collect()] == [(0, "A dog."), (3, "Rain")]


def test_slots(spark):
    schema = "slots struct<primary_subject: struct<species: string, facial_hair: string, clothing: string, pose: string, held_objects: array<struct<object: string, is_weapon: boolean>>>, other_figures: array<struct<species: string, role: string>>, figure_count: int, setting: string, time_of_day: string, art_style: string, composition: string, palette: array<string>>"
    df = spark.createDataFrame([((("elf", "none", "a robe", "standing", [("staff", False), ("none", False)]), [("owl", "pet")], 2, "a wood", "obscured (fog)", None, "", ["green", "gold"]),)], schema)
    got = df.select(chunks.folded_slots(F.col("slots"))).head()[0]
    assert got == [
        "primary subject species: elf", "primary subject clothing: a robe", "primary subject pose: standing", "primary subject holds a non-weapon object: staff", "other figure: owl (pet)",
        "figure count: 2 (two figures)", "setting: a wood", "time of day: obscured (fog)", "palette: green, gold",
    ]
    phrases = {(r["path"], r["phrase"]) for r in chunks.slot_phrases(df.withColumn("id", F.lit(1)), "id", {"palette": F.col("slots.palette"), "setting": F.col("slots.setting")}).collect()}
    assert phrases == {("palette", '["green","gold"]'), ("palette", "green"), ("palette", "gold"), ("setting", "a wood")}


def test_statements_of_a_row_need_no_shuffle(spark):
    slots = F.from_json(F.lit('{"setting": "a wood", "art_style": "oil"}'), "primary_subject struct<species: string, facial_hair: string, clothing: string, pose: string, held_objects: array<struct<object: string, is_weapon: boolean>>>, other_figures array<struct<species: string, role: string>>, figure_count int, setting string, time_of_day string, art_style string, composition string, palette array<string>")
    made = lambda rows: chunks.statements(spark.createDataFrame(rows, "id int, a array<string>, b array<string>").withColumn("slots", slots), "id", F.col("a"), F.col("slots"), F.col("b"))
    said = [(1, "literal", "figure count: 0 (no figures)"), (2, "literal", "setting: a wood"), (3, "literal", "art style: oil")]
    one = made([(1, ["x"], ["ART  style: OIL", "X ", "calm", None, " "]), (2, None, None)])
    assert sorted(tuple(r)[1:] for r in one.where("id = 1").collect()) == [(0, "literal", "x"), *said, (6, "interpretive", "calm")]
    assert one.where("id = 2").count() == 3
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    two = made([(1, ["x"], []), (1, ["X", "y"], ["calm"]), (None, ["z"], None), (None, ["Z"], None), (3, ["x"], None)])
    got = sorted((r["id"] or 0, r["text"].lower()) for r in two.collect())
    every = [t for _, _, t in said]
    assert got == sorted([(0, t) for t in ["z", *every]] + [(1, t) for t in ["x", "y", "calm", *every]] + [(3, t) for t in ["x", *every]])


@pytest.mark.parametrize("absent", ["none", "N/A", " Not  Visible ", "unknown", "unspecified", "nil", "not present", ""])
def test_absent_values(spark, absent):
    df = spark.createDataFrame([(absent, "no"), (absent, "obscured by fog")], "t string, other string")
    assert [tuple(r) for r in df.select(chunks.present(F.col("t")), chunks.present(F.col("other"))).collect()] == [(None, "no"), (None, "obscured by fog")]


def test_repaired(spark):
    df = spark.createDataFrame([(1, 'Sure: {"props": ["a", "b", "c"]} ok'), (2, '{"props": ["a"]}'), (3, "no")], "id int, raw string")
    good, bad = chunks.repaired(df, "raw", "props array<string>", {"props": (2, 2)})
    r = good.collect()
    assert [(x["id"], x["data"]["props"], x["repairs"]) for x in r] == [(1, ["a", "b"], ["props cut to 2"])]
    assert sorted(x["id"] for x in bad.collect()) == [2, 3]


NAMES = [("1", "Mara, the Bold", 5.0), ("2", "Æther Gate", None), ("3", "Gate of Embers // Ash", 2.0), ("4", "Mara, the Old", 9.0), ("5", "Ember Wolf", 1.0)]


@pytest.mark.parametrize(
    ("query", "layer", "ids"),
    [("Æther Gate", "L0", ["2"]), ("aether gate", "L1", ["2"]), ("ash", "L2", ["3"]), ("mara", "L3", ["1", "4"]), ("bold mara", "L4", ["1"]), ("embr wolf", "L5", ["5"]), ("zzzzzz", None, [])],
)
def test_names(spark, query, layer, ids):
    cards = spark.createDataFrame(NAMES, "id string, name string, rank double")
    parts = spark.createDataFrame([("3", "Gate of Embers"), ("3", "Ash")], "id string, name string")
    got = names.resolve(spark.createDataFrame([(query,)], "q string"), names.index(cards, "id", "name", "rank", parts)).orderBy("place").collect()
    assert [r["id"] for r in got] == ids
    assert all(r["layer"] == layer and r["total"] == len(ids) for r in got)


def test_similar_names_against_all_pairs(spark):
    rng = random.Random(8)
    held = sorted({"".join(rng.choices("abcd", k=rng.randint(1, 9))) for _ in range(120)})
    grams = {n: {n[i : i + 2] for i in range(max(1, len(n) - 1))} for n in held}
    for floor in (0.4, 0.7):
        dice = {(a, b): 2 * len(grams[a] & grams[b]) / (len(grams[a]) + max(1, len(b) - 1)) for a in held for b in held if a != b}
        got = {(r["a"], r["b"]): r["dice"] for r in names.similar(spark.createDataFrame([(n,) for n in held], "n string"), "n", floor).collect()}
        assert got == pytest.approx({k: v for k, v in dice.items() if v >= floor}) and got


def test_fuzzy_names_against_all_pairs(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcde", k=rng.randint(2, 8)))
    held = sorted({f"{word()} {word()}" for _ in range(150)})
    asked = sorted({n[:k] + rng.choice("abz") + n[k + 1 :] for n in held[::3] for k in [rng.randrange(len(n))]} - set(held))
    grams = lambda n: {n[i : i + 2] for i in range(max(1, len(n) - 1))}

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    want = {}
    for q in asked:
        budget = max(1, min(3, len(q) * 3 // 10))
        near = {n: lev(q, n) for n in held if abs(len(n) - len(q)) <= budget and 2 * len(grams(q) & grams(n)) / (len(grams(q)) + max(1, len(n) - 1)) >= names.DICE_FLOOR}
        near = {n: d for n, d in near.items() if d <= budget}
        want |= {(q, n): d for n, d in near.items() if d == min(near.values())}
    cards = spark.createDataFrame([(n, n, None) for n in held], "id string, name string, rank double")
    q = spark.createDataFrame([(x, x) for x in asked], "query string, folded string")
    assert {(r["query"], r["id"]): r["distance"] for r in names.fuzzy(q, names.index(cards, "id", "name", "rank")).collect()} == want and len(want) > 20


def test_names_stop_at_max_layer(spark):
    cards = spark.createDataFrame(NAMES, "id string, name string, rank double")
    assert names.resolve(spark.createDataFrame([("mara",)], "q string"), names.index(cards, "id", "name", "rank"), max_layer=2).isEmpty()


def test_mining(spark):
    phrases = spark.createDataFrame([(i, "pointed ears" if i < 4 else "plain") for i in range(40)], "id int, phrase string")
    cats = spark.createDataFrame([(i, "elf") for i in range(3)] + [(i, "human") for i in range(3, 40)], "id int, category string")
    got = [(r["category"], r["phrase"], r["support"]) for r in vocabulary.associations(phrases, cats, "id").collect()]
    assert got == [("elf", "pointed ears", 3)]


PHRASES = [
    (1, "primary_subject.species", "winged elf"), (2, "primary_subject.species", "elfin child"), (3, "figure_count", "4"), (4, "figure_count", "2"), (5, "primary_subject.species", "humanoid with long ears"),
    (6, "primary_subject.held_objects", '[{"object":"lamp","is_weapon":false}]'), (7, "composition", "full figure shot, low angle looking up at it"),
    (8, "composition", "wide shot with the figure low in the frame, camera at eye level, a bright angle of light from the left"), (9, "primary_subject.pose", "standing, facing away"), (10, "other_figures", "dog"),
    (11, "primary_subject.species", "long ears"),
]


def test_matching(spark):
    p = spark.createDataFrame(PHRASES, "id int, path string, phrase string")
    ids = lambda *a, **k: sorted(r[0] for r in vocabulary.matching(p, "id", *a, **k).collect())
    species = "primary_subject.species"
    assert ids(species, "contains", "elf") == [1, 2] and ids(species, "equals", "elf") == [1]
    assert ids(species, "equals", "Winged Elves") == [] and ids(species, "equals", "elf winged") == [1]
    assert ids(species, "not_contains", "elf") == [3, 4, 5, 6, 7, 8, 9, 10, 11]
    assert ids("figure_count", "gte", "3") == [3] and ids("figure_count", "equals", "2") == [4] and ids("figure_count", "not_contains", "2") == [3] and ids("figure_count", "lte", "few") == []
    assert ids(species, "gte", "elf") == [1, 2]
    assert ids("primary_subject.held_objects", "contains", '"is_weapon":false') == [6] and ids("primary_subject.held_objects", "contains", '"is_weapon":true') == []
    assert ids("other_figures", "contains", '"species":"dog"') == [10]
    assert ids("composition", "equals", "low_angle_shot") == [7] and ids("composition", "contains", "low angle") == [7]
    assert ids("primary_subject.pose", "contains", "seen from behind") == [9]
    known = {"elf": ["long ears"]}
    assert ids(species, "equals", "elf", known=known) == [1, 11]  # a mined phrase as a whole
    assert ids(species, "not_contains", "elf", known=known) == [3, 4, 5, 6, 7, 8, 9, 10, 11]


def test_slot_filters_leave_a_floor(spark):
    rows = [(i, "setting", "a wood" if i < 30 else "a town") for i in range(60)] + [(i, "palette", "green" if i < 3 else "grey") for i in range(60)]
    p = spark.createDataFrame(rows, "entity int, path string, phrase string")
    slots = [{"path": "setting", "op": "contains", "value": "wood"}, {"path": "palette", "op": "equals", "value": "green"}, {"path": "art_style", "op": "equals", "value": "oil"}]
    notes = []
    assert sorted(r[0] for r in vocabulary.allowed(p, "entity", slots, notes).collect()) == list(range(30))
    assert len(notes) == 2 and "green" in " ".join(notes) and "oil" in " ".join(notes)
    assert vocabulary.allowed(p, "entity", [], notes) is None and vocabulary.allowed(p, "entity", slots[1:], notes) is None
    assert sorted(r[0] for r in vocabulary.allowed(p, "entity", slots, notes, floor=2).collect()) == [0, 1, 2]


def test_terms():
    assert vocabulary.variants('{"species":"dog","role":" "}') == ['{"species":"dog","role":" "}', "dog"]
    assert ("contains", "facing away") in vocabulary.terms("back turned", "composition", "equals", {}) and vocabulary.terms("turned", "composition", "equals", {}) == [("equals", "turned")]
    assert ("exact", "long ears") in vocabulary.terms("elf", "other_figures", "equals", {"elf": ["long ears"]}) and vocabulary.terms("elf", "setting", "equals", {"elf": ["long ears"]}) == [("equals", "elf")]


def test_subtypes(spark):
    df = spark.createDataFrame([("Legendary Creature — Elf Knight // Land",), ("Creature -- Owl's // Legendary Creature – Bat",), ("Artifact",), (None,)], "t string")
    assert [r[0] for r in df.select(vocabulary.subtypes(F.col("t"))).collect()] == [["elf"], ["bat", "owl's"], [], []]


def test_selection(spark):
    rows = spark.createDataFrame([(0, i, "W" if i < 4 else "U", i, 1.0 - i / 10, [1.0, float(i % 2)]) for i in range(8)], "query int, id int, ci string, pos int, fit double, v array<double>")
    assert sorted(r["id"] for r in selection.capped(rows, "ci", [F.col("pos")], ("query",)).collect()) == [0, 1, 4, 5]
    assert [r["id"] for r in selection.diversified(rows, "query", "id", "ci", "pos", "fit", "v", 3).orderBy("place").collect()][0] == 0
    assert selection.mmr_order(__import__("numpy").array([1.0, 0.9, 0.5]), __import__("numpy").array([[1.0, 0], [1.0, 0], [0, 1.0]]), 2) == [0, 2]


def test_incremental(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, t string")
    new = spark.createDataFrame([(2, "b"), (3, "x"), (4, "d")], "id int, t string")
    assert {r["id"]: r["change"] for r in incremental.changes(old, new, "id", "t").collect()} == {1: "removed", 2: "same", 3: "changed", 4: "new"}
    assert {tuple(r) for r in incremental.first_wins(old, new, "id", "t").collect()} == {(1, "a"), (2, "b"), (3, "c"), (4, "d")}
    assert {tuple(r) for r in incremental.last_wins(old, new, ["id"], "t").collect()} == {(1, "a"), (2, "b"), (3, "x"), (4, "d")}
    assert sorted(r[0] for r in incremental.pending(new, old, "id").select("id").collect()) == [4]


def test_evaluation(spark):
    r = spark.createDataFrame([(0, "a", 1, "bm25"), (0, "a", 3, "rrf"), (0, "b", 1, "rrf"), (1, "c", 2, "dense")], "query int, id string, rank int, method string")
    ranks = {(x["query"], x["id"]): x["rank"] for x in evaluation.ranks(r).collect()}
    assert ranks == {(0, "a"): 3, (0, "b"): 1, (1, "c"): 2}
    gold = spark.createDataFrame([(0, "a"), (0, "z"), (1, "c")], "query int, id string")
    assert {x["query"]: x["recall"] for x in evaluation.recall(evaluation.ranks(r), gold).collect()} == {0: 0.5, 1: 1.0}
    prefs = spark.createDataFrame([(0, "a", "b", "b"), (0, "a", "z", "a")], "query int, a string, b string, winner string")
    assert tuple(evaluation.pairwise(prefs, evaluation.ranks(r)).head()) == (1, 1, 1.0)


def test_provenance(spark):
    rows = [("A  cat", "x", "distill", 0.1, 1), ("a cat", "x", "human", 1.0, 2), ("a cat", "x", "judge", 0.2, 3), ("a cat", "y", "judge", 0.3, 4), ("a cat", "y", "judge", 0.4, 5)]
    df = spark.createDataFrame(rows, "text string, id string, source string, fit double, seq int")
    got = {r["id"]: (r["fit"], r["spelled"]) for r in export.folded_labels(df, "text", "id", "source", "seq").collect()}
    assert got == {"x": (1.0, "A  cat"), "y": (0.4, "A  cat")}


def test_balance_keeps_heavy_rows(spark):
    df = spark.createDataFrame([(i, 1, 3 if i < 2 else 1) for i in range(20)] + [(100 + i, 0, 1) for i in range(5)], "id int, label int, w int")
    kept = export.balanced(df, "label", "w", F.md5(F.col("id").cast("string").cast("binary"))).collect()
    assert sum(r["label"] == 0 for r in kept) == 5
    assert {0, 1} <= {r["id"] for r in kept} and sum(r["w"] for r in kept if r["label"] == 1) == 6


def test_ingest(spark, tmp_path):
    import json

    two = {"id": "p2", "oracle_id": "o2", "name": "Day // Night", "layout": "transform", "games": ["mtgo"], "color_identity": ["G", "W"], "legalities": {"commander": "legal"}, "released_at": "2020-01-01", "prices": {"usd": "n/a"}, "card_faces": [{"name": "Day", "type_line": "Legendary Creature — Cat", "oracle_text": "Shine.", "mana_cost": "{W}", "power": "2", "toughness": "*", "colors": ["W"], "illustration_id": "i1", "image_uris": {"normal": "n1", "art_crop": "a1"}}, {"name": "Night", "type_line": "Creature — Cat", "oracle_text": "Hide.", "illustration_id": "i2", "image_uris": {"art_crop": "a2"}}]}
    one_ = {"id": "p1", "oracle_id": "o1", "name": "Stone", "layout": "normal", "games": ["arena"], "type_line": "Artifact", "oracle_text": "Tap.", "image_uris": {"normal": "n", "art_crop": "a"}, "illustration_id": "i3", "cmc": 1.0, "prices": {"usd": "1.50"}}
    (tmp_path / "r.json").write_text(json.dumps([two, one_]))
    from loomwork.sources.records import read_records

    raw = read_records(spark, str(tmp_path / "r.json"), ingest.CARD)
    assert [r[0] for r in raw.where(ingest.is_paper()).select("oracle_id").collect()] == ["o2"]
    assert [r[0] for r in raw.where(ingest.is_commander()).select("oracle_id").collect()] == ["o2"]
    c = {r["oracle_id"]: r for r in ingest.cards(raw).collect()}
    d = c["o2"]
    assert (d["oracle_text"], d["mana_cost"], d["colors"], d["color_identity"], d["power_num"], d["toughness_num"], d["image_normal"], d["usd"]) == ("Shine.\n//\nHide.", "{W}", "W", "WG", 2.0, None, "n1", None)
    assert c["o1"]["usd"] == 1.5
    assert {(r["oracle_id"], r["face_index"], r["illustration_id"]) for r in ingest.arts(raw).collect()} == {("o2", 0, "i1"), ("o2", 1, "i2"), ("o1", 0, "i3")}
    assert [r["name"] for r in ingest.faces(raw).orderBy("face_index").collect()] == ["Day", "Night"]


def test_store_and_engine(spark, tmp_path):
    from loomwork.api import Engine
    from loomwork.plans.models import StandIn, embedded
    from loomwork.plans.search import Request

    e = Engine(spark, str(tmp_path), dim=16)
    cards = spark.createDataFrame([("a", "Mara", 2.0, "W", 1.0, "draw a card when it flies"), ("b", "Wolf", 4.0, "G", 2.0, "fights a creature"), ("c", "Stone", 1.0, "", None, "tap for mana")], "entity string, name string, cmc double, color_identity string, edhrec_rank double, evidence string")
    e.store.replace("cards", cards)
    e.store.replace("types", spark.createDataFrame([("a", "type", "creature"), ("b", "type", "creature")], "entity string, kind string, value string"))
    e.store.replace("legalities", spark.createDataFrame([("a", "modern", "legal"), ("b", "modern", "banned")], "entity string, format string, status string"))
    e.store.replace("names", names.index(cards, "entity", "name", "edhrec_rank"))
    rows = cards.select(F.concat("entity", F.lit("/0")).alias("row"), "entity", F.lit("any").alias("layer"), F.col("evidence").alias("text"))
    e.store.replace("text_index", rows.join(embedded(rows, "row", "text", StandIn(16), 16), "row"))
    entities = cards.select("entity", F.col("entity").alias("card"), "color_identity", F.lit(3).alias("band"), "evidence").join(embedded(cards, "entity", "evidence", StandIn(16), 16), "entity")
    e.store.replace("art_entities", entities)
    e.store.replace("art_index", rows.withColumn("layer", F.lit("literal")).join(embedded(rows, "row", "text", StandIn(16), 16), "row"))
    assert [r["entity"] for r in e.text_search(Request("draw card flies")).results.collect()][0] == "a"
    assert e.text_search(Request("mara")).notes == ["that is a card's name"]
    assert e.text_search(Request("draw", mv=(9, 30))).results.isEmpty()
    assert {r["entity"] for r in e.text_search(Request("creature", types=["creature"], formats=["modern"])).results.collect()} == {"a"}
    assert [r["entity"] for r in e.search(Request("fights a creature", k=1)).results.collect()] == ["b"]
    before = {r["entity"]: r["score"] for r in e.text_search(Request("draw card flies")).pool.collect()}
    e.build_words("text")
    e.build_words("art")
    assert {r["entity"]: r["score"] for r in e.text_search(Request("draw card flies")).pool.collect()} == before
    e.store.replace("statements", cards.select("entity", F.lit(7).alias("prop"), F.col("evidence").alias("text")))
    found = e.search(Request("fights a creature", k=1))
    assert [(r["entity"], r["prop_ids"]) for r in found.results.collect()] == [("b", [7])]
    e.log("q1", Request("x"), found)
    assert e.typical_seconds().head()["n"] == 1
    votes = spark.createDataFrame([("q1", "a", 1.0, 1), ("q1", "a", 0.0, 2), ("nope", "a", 1.0, 3)], "query_id string, id string, fit double, seq int")
    assert [r["query_id"] for r in e.feedback(votes).collect()] == ["nope"]
    assert [r["fit"] for r in e.store.read("votes").collect()] == [0.0]
    e.feedback(spark.createDataFrame([("q1", "b", 1.0, 3)], "query_id string, id string, fit double, seq int"))
    assert {(r["id"], tuple(r["prop_ids"] or ())) for r in e.store.read("votes").collect()} == {("a", (7,)), ("b", (7,))}  # both share a word with the request
    with pytest.raises(ValueError):
        Request("x", band=(5, 1))


def test_streaming(spark, tmp_path):
    from loomwork.streaming import feeds

    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id long, t string").write.parquet(str(tmp_path / "in"))
    seen = []
    q = feeds.each_batch(feeds.landed(spark, str(tmp_path / "in"), "id long, t string"), lambda df, i: seen.append(df.count()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sum(seen) == 3


def test_scan_is_pruned(spark):
    """Filters and columns reach the scan."""
    from loomwork.plans.catalog import QUERIES

    plan = QUERIES["filter_hard"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(p_size,5)" in plan and "p_name" not in plan


def test_small_parts(spark):
    from loomwork.plans.models import StandIn, expansions, routed, synthesised, verified, weights

    assert weights({"literal_weight": 0, "interpretive_weight": 0}) == {"literal": 0.5, "interpretive": 0.5}
    w = weights({"literal_weight": 1.0, "interpretive_weight": 0.0})
    assert sum(w.values()) == pytest.approx(1) and w["interpretive"] == pytest.approx(0.05 / 1.05)

    class Broken(StandIn):
        def route(self, text):
            raise ValueError("no")

        def judge(self, text, evidence):
            raise OSError("down")

    assert routed(Broken(), "x")["literal_weight"] == 0.5
    assert expansions(StandIn(), "a cat", {"literal": 0.5, "interpretive": 0.5}) == [("literal", "a cat"), ("interpretive", "a cat")]
    rows = spark.createDataFrame([(0, i, i, "a cat", "a cat sat" if i % 2 else "dog") for i in range(10)], "q int, id int, pos int, text string, ev string")
    got = {r["id"]: r["holds"] for r in verified(rows, "q", "id", "pos", "text", "ev", StandIn()).collect()}
    assert got == {i: bool(i % 2) for i in range(8)}
    assert all(r["holds"] is None for r in verified(rows, "q", "id", "pos", "text", "ev", Broken()).collect())
    made = synthesised(rows.limit(1).withColumn("s", F.expr("array(named_struct('prop', 7L, 'text', 'a dog'))")), "id", "ev", None, "s").collect()
    assert {(r["theme"], r["fit"], tuple(r["prop_ids"])) for r in made} == {("dog", 1.0, (7,)), ("without dog", 0.0, (7,))}
    notes = []
    assert filters.clean_slots([{"path": "species", "op": "contains", "value": "elf"}, {"path": "x", "op": "is", "value": ""}], notes, {"species"}) == [{"path": "species", "op": "contains", "value": "elf"}] and len(notes) == 1
    assert filters.echo(["elf"], "wu", (3, 3), ["modern"]) == "type elf; colours within WU; mana value = 3; legal in modern"
    assert filters.external_query(None, None, (5, 3)) == "" and filters.external_query(["elf druid"], "wu", (1, 4)) == "(t:elf t:druid) id<=wu cmc>=1 cmc<=4"
    logs = spark.createDataFrame([(1, "a cat", '{"literal_weight": 0.7, "interpretive_weight": 0.3, "mechanical_terms": ["A  cat", "draw"], "illustration_id": "i1"}'), (2, "b", '{"literal_weight": 0.5, "notes": ["router failed"]}')], "id int, text string, params string")
    assert [(r["id"], r["literal_weight"], r["mechanical_terms"]) for r in export.routing_records(logs, "id", "text", "params").collect()] == [(1, 0.7, ["draw"])]
    assert [r["id"] for r in export.done_ids(logs, "params").collect()] == ["i1"]


def test_citations_are_checked(spark):
    from loomwork.plans.models import StandIn, cited, clean_items

    class Odd(StandIn):
        def cite(self, text, numbered):
            return [{"candidate": 0, "fit": "2.5", "rationale": " so  it ", "prop_ids": [1, 3, 99, "x"]}, {"candidate": 1, "fit": "much", "prop_ids": [3]}, {"candidate": 9}, "no"]

    s = lambda *props: [(p, f"text {p}") for p in props]
    rows = spark.createDataFrame([(0, "a", 1, "?", s(10, 11)), (0, "b", 2, "?", s(20)), (0, "c", 3, "?", s())], "q int, id string, pos int, text string, s array<struct<prop: bigint, text: string>>")
    got = {r["id"]: (r["fit"], r["rationale"], r["prop_ids"], r["cited"], r["invented"], r["misattributed"]) for r in cited(rows, "q", "text", "id", "pos", "s", Odd()).collect()}
    assert got == {"a": (1.0, "so it", [10], 4, 2, 1), "b": (0.0, "(no rationale)", [20], 1, 0, 0), "c": (None, "", [], 0, 0, 0)}
    plain = {r["id"]: r["prop_ids"] for r in cited(rows.withColumn("text", F.lit("text 11")), "q", "text", "id", "pos", "s", StandIn()).collect()}
    assert plain == {"a": [10, 11], "b": [20], "c": []}
    items = [{"theme": ' "A  theme" ', "register": "LITERAL", "prop_ids": [1, "2", 5, None]}, {"theme": "a THEME"}, {"theme": "ab"}, 3, {"theme": "other", "register": "odd"}]
    assert [(x["theme"], x["register"], x["prop_ids"]) for x in clean_items(items, {1, 2})] == [("A theme", "literal", [1, 2]), ("other", "abstract", [])]


@pytest.mark.parametrize(("text", "is_"), [("Can I respond to this", True), ("how  does a card work?", True), ("what happens if it dies", True), ("draw cards", False), ("what happens", False)])
def test_rules_questions(text, is_):
    from loomwork.plans.search import rules_question

    assert rules_question(text) is is_


def test_page_stats(spark):
    rows = [("a", 3, {"scg": (2.0,), "tcgplayer": (0.0,), "other": (9.0,)}, ["x"], []), ("b", 1, {}, ["y"], ["z"])]
    df = spark.createDataFrame(rows, "slug string, num_decks int, prices map<string, struct<price: double>>, themes array<string>, taglinks array<string>")
    assert [(r["avg_price"], r["archetypes"]) for r in ingest.page_stats(df).orderBy("slug").collect()] == [(2.0, ["x"]), (None, ["z"])]


@pytest.mark.parametrize(("name", "slugs"), [("Æra, the Bold's // Nâme!", ["aera-the-bolds", "aera-the-bolds-name"]), ("Plain", ["plain"]), ("!! // x", ["x"])])
def test_slug_candidates(spark, name, slugs):
    assert one(spark, X.slug_candidates(F.col("t")), t=name) == slugs


def test_quantiles_are_exact(spark):
    import numpy as np

    rng = random.Random(4)
    for values in ([rng.choice((1.0, 2.0, 2.5, 9.0)) for _ in range(37)], [rng.random() for _ in range(200)], [3.0]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        assert scoring.quantiles(df, "v") == pytest.approx(np.quantile(values, scoring.EDGES).tolist())
    assert scoring.quantiles(df.where("v is null"), "v") == []


def test_dense_in_blocks(spark, monkeypatch):
    rng = random.Random(6)
    v = spark.createDataFrame([(i, [rng.random() - 0.5 for _ in range(8)]) for i in range(60)], "id long, v array<double>").cache()
    whole = sorted(map(tuple, retrieval.dense(v, "id", "v", v, "id", "v", depth=3).collect()))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    assert sorted(map(tuple, retrieval.dense(v, "id", "v", v, "id", "v", depth=3).collect())) == whole and len(whole) == 180


def test_commits_of_several_tables(spark, tmp_path, monkeypatch):
    from loomwork.sources import store as st

    store = st.Store(spark, str(tmp_path))
    cards = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, text string")
    vectors = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 0.3)], "id int, v double")
    with store.transaction() as t:
        t.replace("cards", cards)
        t.replace("vectors", vectors)
    before = store.current("cards"), store.current("vectors")
    with pytest.raises(RuntimeError), store.transaction() as t:  # noqa: PT012
        left = t.delete("cards", spark.createDataFrame([(2,)], "id int"), ["id"])
        assert left.count() == 2 and store.read("cards").count() == 3  # it reads its own change, others do not
        t.replace("vectors", vectors.where("id <> 2"))
        raise RuntimeError("in between")
    assert (store.current("cards"), store.current("vectors")) == before and store.read("vectors").count() == 3 and store.current("none") is None
    with store.transaction() as t:
        gone = t.delete("cards", spark.createDataFrame([(2,)], "id int"), ["id"])
        t.replace("vectors", incremental.cascaded(gone, t.read("vectors"), "id"))
    rows = lambda name: sorted(map(tuple, store.read(name).collect()))
    assert rows("cards") == [(1, "a"), (3, "c")] and [r[0] for r in rows("vectors")] == [1, 3]
    # Two writers: of one table one fails, of different tables none does.
    one, two, three = store.transaction(), store.transaction(), store.transaction()
    with one as t:
        t.replace("cards", cards)
    with three as t:
        t.replace("vectors", vectors)
    with pytest.raises(OSError, match="cards"), two as t:
        t.upsert("cards", cards, ["id"], "text")
    assert len(rows("cards")) == len(rows("vectors")) == 3


def test_changes_are_merged_when_read(spark, tmp_path, monkeypatch):
    from loomwork.sources import store as st

    store = st.Store(spark, str(tmp_path))
    df = lambda *rows: spark.createDataFrame(list(rows), "id int, text string, seq int")
    store.upsert("t", df((1, "a", 1), (2, "b", 1), (2, "c", 2)), ["id"], "seq")
    base = store.head()[1]["tables"]["t"]["base"]
    store.upsert("t", df((2, "d", 3), (3, "e", 1)), ["id"], "seq")
    with store.transaction() as t:
        t.delete("t", df((1, "", 0)), ["id"])
    store.upsert("t", df((3, "f", 2)), ["id"], "seq")
    rows = lambda: sorted((r["id"], r["text"]) for r in store.read("t").collect())
    assert rows() == [(2, "d"), (3, "f")] and store.head()[1]["tables"]["t"]["base"] == base  # the table was not written again
    store.insert_new("t", df((3, "no", 1), (4, "g", 1), (4, "h", 2)), "id", "seq")
    assert rows() == [(2, "d"), (3, "f"), (4, "g")]
    monkeypatch.setattr(st, "COMPACTED", 2)
    store.upsert("t", df((5, "i", 1)), ["id"], "seq")
    entry = store.head()[1]["tables"]["t"]
    assert entry["base"] != base and len(entry["deltas"]) == 1 and rows() == [(2, "d"), (3, "f"), (4, "g"), (5, "i")]
    assert store.vacuum(1) > 0 and len(store._numbers()) == 1 and rows() == [(2, "d"), (3, "f"), (4, "g"), (5, "i")]
    # A batch of a stream that comes again changes nothing.
    for batch, text in ((0, "x"), (0, "again"), (1, "y")):
        with store.transaction() as t:
            if t.once("votes", batch):
                t.upsert("t", df((9, text, batch)), ["id"], "seq")
    assert rows()[-1] == (9, "y")
    with store.transaction() as t:
        assert not t.once("votes", 1)


def test_containing_documents_of_short_items(spark):
    from loomwork.plans import catalog

    docs = [(1, "one two three four five six seven eight"), (2, "two three fourth and more"), (3, "x one two three four fivefold")]
    items = [(1, "two"), (2, "two three four"), (3, "one two three four"), (4, "one two three four five"), (5, "one two three four five si"), (6, "three four five six seven eight"), (7, None)]
    tables = {"documents": spark.createDataFrame(docs, "doc_id long, text string"), "benchmark": spark.createDataFrame(items, "item_id long, text string")}
    got = {(r["query"], r["id"]) for r in catalog._gold(tables.__getitem__).collect()}
    assert got == {(i, d) for i, b in items for d, t in docs if b is not None and b in t}


def test_containing_documents_are_found_without_shuffling_texts(spark, tmp_path):
    from loomwork.plans import catalog

    docs = [(i, f"word{i % 9} lies between these many others and word{i % 7} too") for i in range(200)]
    items = [(1, "between these many others and word3"), (2, "ord5 lies between"), (3, "word2"), (4, "nothing like this is there")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the documents are large
    try:
        out = catalog._gold(lambda name: spark.read.parquet(f"{tmp_path}/{name}"))
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert sorted((r["query"], r["id"]) for r in out.collect()) == [(i, d) for i, b in items for d, t in docs if b in t]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_described_and_checked(spark):
    import json

    from loomwork.plans.models import StandIn, checked, described

    good = json.loads(StandIn().describe("a grey owl", None))
    data, repairs = checked("Sure: " + json.dumps(good))
    assert repairs == [] and data["slots"]["other_figures"] == [{"species": "none", "role": "none"}]
    odd = {**good, "literal_propositions": [f"- {i} things" for i in range(25)], "slots": {**good["slots"], "figure_count": "about 3", "palette": "Green, none", "setting": "", "other_figures": ["wolf", {"species": ""}]}}
    data, repairs = checked(json.dumps(odd))
    assert len(data["literal_propositions"]) == 20 and data["literal_propositions"][0] == "0 things"
    assert (data["slots"]["figure_count"], data["slots"]["palette"], data["slots"]["setting"], data["slots"]["other_figures"]) == (3, ["Green"], "none", [{"species": "wolf", "role": "none"}])
    assert len(repairs) == 5
    assert checked(json.dumps({**good, "slots": {**good["slots"], "figure_count": None, "other_figures": ["wolf"]}}))[0]["slots"]["figure_count"] == 2
    for bad in ("no", "{", json.dumps({**good, "literal": " "}), json.dumps({k: v for k, v in good.items() if k != "slots"}), json.dumps({**good, "interpretive_propositions": ["one two"] * 9}), json.dumps({**good, "literal_propositions": "text"})):
        with pytest.raises(ValueError):
            checked(bad)

    class Second(StandIn):
        def describe(self, reference, reason):
            return super().describe(reference, reason) if reason and reference != "bad" else "nothing"

    class Down(StandIn):
        def describe(self, reference, reason):
            raise OSError("down")

    rows = spark.createDataFrame([(1, "a grey owl"), (2, "bad")], "id int, ref string").coalesce(1)
    got = {r["id"]: r for r in described(rows, "id", "ref", Second()).collect()}
    assert got[1]["failed"] is None and got[1]["slots"]["primary_subject"]["species"] == "a" and got[2]["failed"] == "no JSON object"
    many = spark.range(8).select(F.col("id").cast("int").alias("id"), F.lit("x").alias("ref")).coalesce(1)
    assert [r["failed"] for r in described(many, "id", "ref", Down()).orderBy("id").collect()] == ["down"] * 5 + ["stopped after failures in a row"] * 3


def test_marked_line(spark):
    text = "Fly\n\nDraw\n//\nDraw\nDraw"
    marked = lambda face, ordinal: spark.createDataFrame([(text, face, ordinal)], "t string, f int, o int").select(chunks.marked_line(F.col("t"), F.col("f"), F.col("o"))).head()[0]
    assert marked(0, 1) == "  Fly\n\n▸ Draw\n//\nDraw\nDraw" and marked(1, 1) == "Fly\n\nDraw\n//\n  Draw\n▸ Draw" and marked(0, -1) == marked(None, None) == text


def test_counts_out_of_json(spark):
    df = spark.createDataFrame([('[{"slug":"x","count":1},{"slug":"cedh","count":57}]', '{"5": 3.0}'), ("no", '{"5": "many"}'), (None, None)], "t string, b string")
    assert [tuple(r) for r in df.select(scoring.tagged_count(F.col("t"), "cedh"), scoring.bracket_count(F.col("b"), "5")).collect()] == [(57, 3), (0, 0), (0, 0)]


def test_passing_first_and_located(spark):
    df = spark.createDataFrame([("q", "a", 1, 1), ("q", "b", 0, 2), ("q", "c", 0, 3)], "query string, id string, stretch int, place int")
    assert [r["id"] for r in selection.passing_first(df, "query").orderBy("place").collect()] == ["b", "c", "a"]
    at = spark.createDataFrame([("a/0/1", 0, 1, "ability")], "row string, face_index int, ordinal int, kind string")
    fused = spark.createDataFrame([("a", "a/0/1"), ("b", None)], "entity string, best_row string")
    assert {r["entity"]: (r["matched_face_index"], r["matched_ordinal"], r["matched_kind"]) for r in retrieval.located(fused, at).collect()} == {"a": (0, 1, "ability"), "b": (None, None, None)}


def test_children_follow_their_parents(spark):
    parents = spark.createDataFrame([(1, "one"), (2, "two"), (4, "four")], "id int, t string")
    children = spark.createDataFrame([(1, "old one"), (2, "old two"), (3, "gone")], "id int, c string")
    changed = spark.createDataFrame([(2,)], "id int")
    made = incremental.rechunked(parents, children, changed, "id", lambda p: p.select("id", F.concat(F.lit("new "), "t").alias("c")))
    assert {tuple(r) for r in made.collect()} == {(1, "old one"), (2, "new two"), (4, "new four")}
    vectors = spark.createDataFrame([("old one", 1.0), ("old two", 2.0)], "c string, v double")
    assert [r["c"] for r in incremental.cascaded(made, vectors, "c").collect()] == ["old one"]
    fresh = spark.createDataFrame([(2, "x"), (2, "y")], "id int, c string")
    assert {tuple(r) for r in incremental.replaced_children(children, fresh, parents, "id").collect()} == {(1, "old one"), (2, "x"), (2, "y")}
    flags = spark.createDataFrame([(1, 10, False), (1, 11, False), (2, 12, True)], "g int, a int, is_default boolean")
    assert {r["a"] for r in incremental.promoted(flags, "g", "a").where("is_default").collect()} == {10, 12}


def test_expansion_records(spark):
    logs = [(1, "A cat", '{"plan": {"interpretive": ["a  CAT", "feline"], "expansions": {"literal": ["whiskers", " "]}, "literal_weight": 1}, "notes": []}'), (2, "b", '{"direct": ["b"]}'), (3, "c", '{"plan": {"literal_weight": 0.5, "router_ok": false}}')]
    df = spark.createDataFrame(logs, "id int, text string, params string")
    assert [(r["id"], r["direct"], r["decomposed"]) for r in export.expansion_records(df, "id", "text", "params").collect()] == [(1, ["feline"], ["whiskers"])]
    assert [r["id"] for r in export.routing_records(df, "id", "text", "params").collect()] == [1]


def test_links(spark):
    rows = [("s", [("Elves", "elves", 3), ("Big Tokens", "big-tokens", 9)], ["x", "elves"], "u1", None, "a1"), ("t", [], None, None, "u2", "")]
    df = spark.createDataFrame(rows, "slug string, records array<struct<name: string, slug: string, count: int>>, matched_terms array<string>, scryfall_uri string, tcgplayer_uri string, art_crop_url string")
    got = [r["links"] for r in ingest.links(df, "http://x").orderBy("slug").collect()]
    assert got == [{"edhrec": "http://x/s", "edhrec_theme": "http://x/s/elves", "scryfall": "u1", "art_crop": "a1"}, {"edhrec": "http://x/t", "tcgplayer": "u2"}]
    most = ingest.links(df.withColumn("matched_terms", F.array(F.lit("none of them"))), "http://x").where("slug = 's'").head()["links"]
    assert most["edhrec_theme"] == "http://x/s/big-tokens"


def test_quality_report(spark):
    cards = spark.createDataFrame([("A", "a", "normal", "u", "t"), ("Á", "a", "normal", "", ""), ("B", "b", None, None, "t")], "name string, name_norm string, layout string, image_normal string, oracle_text string")
    got = {(r["check"], r["value"]): r["n"] for r in ingest.quality_report(cards).collect()}
    assert got == {("cards", None): 3, ("without_image", None): 2, ("without_text", None): 1, ("name_collisions", None): 1, ("layout", "normal"): 2, ("layout", "?"): 1, ("collision", "A | Á"): 2}


def test_art_search_follows_its_plan(spark):
    from loomwork.plans.models import StandIn, embedded
    from loomwork.plans.search import Request, art_search

    class Planned(StandIn):
        def route(self, text):
            return {"literal_weight": 1.0, "interpretive_weight": 0.0, "slot_filters": [{"path": "setting", "op": "contains", "value": "wood"}, {"path": "nowhere", "op": "is", "value": "x"}], "mechanical_terms": ["draw"], "semantic_intent": text}

        def judge(self, text, evidence):
            return [0.0 if len(evidence) == 1 and "second" in e else 0.9 for e in evidence]  # one by one, the second is rejected

    names_ = ["first", "second", "third"] + [f"n{i}" for i in range(40)]
    rows = spark.createDataFrame([(i, f"a wolf, {n}", "draw a card" if i < 20 else "fight") for i, n in enumerate(names_)], "entity int, evidence string, oracle_text string")
    vectors = embedded(rows, "entity", "evidence", StandIn(16), 16)
    entities = rows.join(vectors, "entity").withColumn("card", F.col("entity")).withColumn("color_identity", F.concat(F.lit("W"), F.col("entity").cast("string"))).withColumn("band", F.lit(3))
    index = rows.select(F.col("entity").alias("row"), "entity", F.lit("literal").alias("layer"), F.col("evidence").alias("text")).join(vectors, "entity")
    phrases = spark.createDataFrame([(i, "setting", "a wood" if i < 30 else "a town") for i in range(43)], "entity int, path string, phrase string")
    answer = art_search(spark, Request("a wolf", 5), index, entities, Planned(16), 16, phrases)
    pool = {r["entity"]: (r["fit"], r["rejected"]) for r in answer.pool.collect()}
    assert set(pool) == set(range(20)) and pool[1] in ((0.9, True), (0.9, None)) and any("nowhere" in n for n in answer.notes)
    picked = [r["entity"] for r in answer.results.collect()]
    assert len(picked) == 5 and (pool[1][1] is None or 1 not in picked)
    unfiltered = art_search(spark, Request("a wolf", 5), index, entities, StandIn(16), 16)
    assert unfiltered.pool.count() == 43


def test_text_search_soft_filters_and_guards(spark):
    from loomwork.plans.models import StandIn, embedded
    from loomwork.plans.search import Request, text_search

    class Soft(StandIn):
        def route(self, text):
            return {"filters": {"colors": "W", "types": ["elf"], "mv_min": 9, "formats": ["modern"]}, "semantic_intent": ""}

    cards = spark.createDataFrame([("a", "Mara", 2.0, "W", 1.0, "x"), ("b", "Wolf", 4.0, "G", 2.0, "y"), ("c", "Stone", 1.0, "", None, "z"), ("d", "Mara", 3.0, "W", 3.0, "x")], "entity string, name string, cmc double, color_identity string, edhrec_rank double, evidence string")
    types = spark.createDataFrame([("a", "type", "elf"), ("c", "type", "elf"), ("b", "type", "elf")], "entity string, kind string, value string")
    legal = spark.createDataFrame([("c", "modern", "legal")], "entity string, format string, status string")
    index = cards.select(F.col("entity").alias("row"), "entity", F.lit("any").alias("layer"), F.col("evidence").alias("text")).join(embedded(cards, "entity", "evidence", StandIn(16), 16), "entity")
    search = lambda text, client: text_search(spark, Request(text), index, cards, types, legal, names.index(cards, "entity", "name", "edhrec_rank"), client, 16)
    answer = search("something", Soft(16))
    assert [r["entity"] for r in answer.results.collect()] == ["c"] and any("mana value" in n for n in answer.notes)
    assert search("wolf", StandIn(16)).notes == ["that is a card's name"]
    assert search("mara", StandIn(16)).notes != ["that is a card's name"]  # two cards have it
    assert search("can you do that", StandIn(16)).notes == ["rules questions are not answered"]


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    import json

    from loomwork import __main__ as cli
    from loomwork.sources.store import Store

    monkeypatch.setattr(cli, "session", lambda: spark)
    card = lambda i, name, text: {"id": f"p{i}", "oracle_id": f"o{i}", "name": name, "layout": "normal", "games": ["paper"], "type_line": "Creature — Elf", "oracle_text": text, "image_uris": {"normal": "n", "art_crop": f"art of {name}"}, "illustration_id": f"i{i}", "cmc": 1.0, "legalities": {"commander": "legal"}}
    records, judged, root = tmp_path / "r.json", tmp_path / "j.jsonl", str(tmp_path / "data")
    records.write_text(json.dumps([card(1, "Mara", "Draw a card."), card(2, "Wolf", "Fight a bear.")]))
    run = lambda *a: cli.main(["--root", root, *a])
    run("build", str(records))
    store = Store(spark, root)
    assert store.read("cards").count() == 2 and store.read("text_index").count() == 4
    records.write_text(json.dumps([card(1, "Mara", "Draw two cards."), card(3, "Bear", "Sleep.")]))
    run("refresh", str(records))
    assert {r["text"] for r in store.read("chunks").where("kind = 'ability'").collect()} == {"Draw two cards.", "Sleep."} == {r["text"] for r in store.read("text_index").where("not text like '%Elf%'").collect()}
    run("describe")
    run("synth")
    run("synth")
    assert store.read("descriptions").count() == 2 and store.read("phrases").where("path = 'primary_subject.species'").count() == 2
    assert store.read("synth").groupBy("entity", "theme", "fit").count().where("count > 1").isEmpty() and not store.read("synth").isEmpty()
    run("export", str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).where("fit = 1.0").count() > 0
    judged.write_text(json.dumps({"id": "q1", "text": "draw cards", "gold": ["Mara"]}) + "\n")
    run("eval", str(judged))
    run("search", "draw cards")
    run("report")
    run("status")
    out = capsys.readouterr().out
    assert '"recall": 1.0' in out and "without_image" in out and "text_index" in out
