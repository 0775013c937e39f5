"""Stored indexes, bitmaps and batched searches against the plain forms."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.operators import bitmaps, filters, inverted, retrieval, vectors
from loomwork.sources.scratch import once, replaced, sweep, written

WORDS = [f"w{i}" for i in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(WORDS, [1 / (k + 1) for k in range(60)], k=rng.choice((1, 5, 40, 300))))) for i in range(600)]
    rows += [(600, None), (601, ""), (602, "w59 w59 w59"), (603, "W59, w3")]
    return written(spark.createDataFrame(rows, "id long, text string"), "docs")


@pytest.fixture(scope="module")
def asked(spark):
    rng = random.Random(5)
    return spark.createDataFrame([(q, " ".join(rng.choices(WORDS, k=rng.randint(1, 6)))) for q in range(25)] + [(25, "w59 w59"), (26, "nothing"), (27, None)], "q long, text string")


def found(df):
    return sorted((r["query"], r["rank"], r["doc"], round(r["score"], 6)) for r in df.collect())


@pytest.mark.parametrize(("depth", "block_docs"), [(3, 16), (50, 64), (1000, 256)])
def test_word_index_is_bm25(docs, asked, depth, block_docs):
    index = inverted.stored(inverted.build(docs, "id", "text", buckets=8, block_docs=block_docs), replaced, "words")
    plain = retrieval.ranked(retrieval.bm25(docs, "id", "text", asked, "q", "text").withColumn("score", F.round("score", 6)), depth)
    assert found(inverted.topk(index, asked, "q", "text", depth, digits=6)) == found(plain)


def test_word_index_filters_before_the_cut(docs, asked):
    index = inverted.build(docs, "id", "text", block_docs=32)
    even = docs.where("id % 2 = 0").select("id")
    plain = retrieval.ranked(retrieval.bm25(docs, "id", "text", asked, "q", "text", even).withColumn("score", F.round("score", 6)), 5)
    assert found(inverted.topk(index, asked, "q", "text", 5, keep=lambda s: s.where("doc % 2 = 0"), digits=6)) == found(plain)


def test_search_leaves_blocks_folders_and_texts_unread(spark, docs):
    index = inverted.stored(inverted.build(docs, "id", "text", buckets=8, block_docs=16), replaced, "words")
    one, report = spark.createDataFrame([(0, "w59 w1")], "q long, text string"), {}
    plan = inverted.topk(index, one, "q", "text", 2, report=report)
    assert 0 < report["read"] < report["pairs"] / 2
    words = inverted.asked(index, one, "q", "text")
    few = inverted._named(index, words)
    assert few.count() < index.blocks.count()
    text = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in text and "bucket" in text.split("PartitionFilters: [")[1].split("]")[0] and "In(token" in text.replace(" ", "")
    scan = plan._jdf.queryExecution().executedPlan().toString()
    assert "text" not in scan.split("ReadSchema")[-1]


def test_index_of_nothing(spark, asked):
    none = written(spark.createDataFrame([], "id long, text string"), "none")
    assert inverted.topk(inverted.build(none, "id", "text"), asked, "q", "text").count() == 0


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8)) * 3
    rows = [(i, (centres[i % 12] + rng.normal(size=8) * 0.4).tolist()) for i in range(900)] + [(900, [0.0] * 8), (901, None), (902, [1.0, 2.0]), (903, [float(x) for x in centres[0]]), (904, [float(x) for x in centres[0]])]
    return written(spark.createDataFrame(rows, "id long, v array<double>"), "vectors")


def test_vector_index_is_exact(clustered):
    queries = clustered.where("id % 40 = 0 or id >= 900")
    index = vectors.stored(vectors.build(clustered, "id", "v", 8, cells=12), replaced, "near")
    whole = retrieval.dense(clustered.where("id <> 901"), "id", "v", queries.where("id not in (901, 902)"), "id", "v", depth=7)
    report = {}
    got = vectors.topk(index, queries.where("id not in (901, 902)"), "id", "v", 7, report=report)
    assert found(got) == found(whole)
    assert report["scored"] < report["pairs"] / 2


def test_vector_index_under_sets_and_in_blocks(spark, clustered, monkeypatch):
    queries = clustered.where("id in (0, 1, 2, 3)").withColumn("g", F.when(F.col("id") > 0, F.col("id") % 2))
    index = vectors.build(clustered, "id", "v", 8, cells=12)
    sets = clustered.where("id % 3 = 0").select((F.col("id") % 2).alias("group"), "id")
    want = []
    for q in range(4):
        held = clustered.where("id <> 901") if q == 0 else clustered.where(f"id % 3 = 0 and id % 2 = {q % 2}")
        want += found(retrieval.dense(held, "id", "v", queries.where(f"id = {q}"), "id", "v", depth=5))
    assert found(vectors.topk(index, queries, "id", "v", 5, "g", sets)) == sorted(want)
    monkeypatch.setattr(vectors, "HELD", 25)
    assert found(vectors.topk(index, queries, "id", "v", 5, "g", sets)) == sorted(want)


def test_bitmaps_are_sets(spark):
    rng = random.Random(8)
    have = {f"e{i:05d}": {("a", str(rng.randrange(4))), ("b", str(rng.randrange(3))), *([("c", "x")] if i % 7 == 0 else [])} for i in range(40_000)}
    ids = spark.createDataFrame([(e,) for e in have], "id string")
    numbers = written(bitmaps.numbered(ids, "id"), "numbers")
    assert sorted(r["n"] for r in numbers.collect()) == list(range(1, 40_001))
    members = spark.createDataFrame([(e, a, v) for e, s in have.items() for a, v in s], "id string, attribute string, value string")
    maps = written(bitmaps.bitmaps(members, numbers), "maps")
    asked = {
        "both": [("1", "a", "1", False), ("1", "a", "2", False), ("2", "b", "0", False)], "not": [("1", "a", "1", False), ("2", "c", "x", True), ("3", "b", "2", True)],
        "only not": [("1", "c", "x", True)], "none": [("1", "a", "1", False), ("2", "b", "nine", False)], "not what is not": [("1", "b", "1", False), ("2", "b", "nine", True)],
    }

    def plain(clauses):
        out = set()
        for e, s in have.items():
            ok = True
            for c in {x[0] for x in clauses}:
                own = [x for x in clauses if x[0] == c]
                ok &= any((a, v) in s for _, a, v, _ in own) != own[0][3]
            out |= {e} if ok else set()
        return out

    clauses = spark.createDataFrame([(q, *c) for q, cs in asked.items() for c in cs], "query string, clause string, attribute string, value string, negated boolean")
    got = {}
    for r in bitmaps.listed(bitmaps.chosen(maps, clauses), numbers).collect():
        got.setdefault(r["query"], set()).add(r["id"])
    assert got == {q: want for q, cs in asked.items() if (want := plain(cs))}
    assert {r["query"]: r["n"] for r in bitmaps.sizes(bitmaps.chosen(maps, clauses)).collect()} == {q: len(s) for q, s in got.items()}


@pytest.mark.parametrize("floor", [0, 25])
def test_soft_filters_of_bitmaps(spark, floor):
    rng = random.Random(9)
    rows = [(i, rng.randrange(6), rng.randrange(40), rng.random()) for i in range(500)]
    df = written(spark.createDataFrame(rows, "id long, a int, b int, x double"), "rows")
    numbers = written(bitmaps.numbered(df, "id"), "numbers")
    maps = bitmaps.bitmaps(df.select("id", F.lit("a").alias("attribute"), F.col("a").cast("string").alias("value")).union(df.select("id", F.lit("b"), F.col("b").cast("string"))), numbers)
    wanted = {q: {"a": (rng.randrange(7),), "b": tuple(rng.sample(range(45), 5)), "b2": (rng.randrange(45),)} for q in range(12)}
    clauses = spark.createDataFrame([(f"{q}/{n}", n, n[0], str(v), False) for q, w in wanted.items() for n, vs in w.items() for v in vs], "query string, clause string, attribute string, value string, negated boolean")
    sets = bitmaps.chosen(maps, clauses).select(F.split_part("query", F.lit("/"), F.lit(1)).cast("int").alias("query"), F.split_part("query", F.lit("/"), F.lit(2)).alias("name"), "bucket", "bits")
    known = spark.createDataFrame([(q, i, n, None, None) for q, w in wanted.items() for i, n in enumerate(w)], "query int, position int, name string, bucket long, bits binary")
    own = sets.join(known.select("query", "position", "name"), ["query", "name"]).select("query", "position", "name", "bucket", "bits").unionByName(known)
    every = spark.range(12).select(F.col("id").cast("int").alias("query")).crossJoin(maps.where("attribute = '*'").select("bucket", "bits"))
    under, choice = bitmaps.soft(every, own, floor)
    got, kept = {}, {r["query"]: r["kept"] for r in choice.collect()}
    for r in bitmaps.listed(under, numbers).collect():
        got.setdefault(r["query"], set()).add(r["id"])
    for q, w in wanted.items():
        plain, names = filters.soft(df, {n: F.col(n[0]).isin(list(vs)) for n, vs in w.items()}, floor)
        assert kept[q] == names
        assert got.get(q, set()) == {r["id"] for r in plain.collect()}


def test_tables_made_once_and_swept(spark, tmp_path, monkeypatch):
    made = []
    df = spark.range(5)
    df.write.parquet(f"{tmp_path}/t")
    make = lambda: made.append(1) or len(made)
    assert once(spark.read.parquet(f"{tmp_path}/t"), "x", make) == once(spark.read.parquet(f"{tmp_path}/t"), "x", make) == 1
    df.write.mode("overwrite").parquet(f"{tmp_path}/t")
    assert once(spark.read.parquet(f"{tmp_path}/t"), "x", make) == 2
    from loomwork.sources import scratch

    monkeypatch.setattr(scratch, "root", lambda s: f"file://{tmp_path}")
    (tmp_path / "loomwork" / "tables" / "other-app").mkdir(parents=True)
    assert sweep(spark, 1) == 0 and sweep(spark, -1) == 1 and not (tmp_path / "loomwork" / "tables" / "other-app").exists()


def test_names_are_looked_up_in_ranges(spark, tmp_path):
    from loomwork.operators import names

    rng = random.Random(11)
    parts = ["stone", "storm", "star", "sea", "wolf", "wind", "moon", "sun", "ember", "ash"]
    rows = [(i, " ".join(rng.choice(parts) + str(rng.randrange(40)) for _ in range(rng.randint(1, 3))), float(i)) for i in range(400)] + [(900, "Dawn // Dusk", 1.0)]
    df = spark.createDataFrame(rows, "id int, name string, rank double")
    faces = spark.createDataFrame([(900, "Dawn"), (900, "Dusk")], "id int, name string")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    table = names.stored(names.index(df, "id", "name", "rank", faces), lambda n, d: replaced(n, d), "names")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    some = names.under_prefixes(table, ["wolf1"])
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(folded,wolf1)" in plan and "LessThan(folded,wolf1" in plan
    files = {tuple(r) for r in table.groupBy(F.input_file_name()).agg(F.min("folded"), F.max("folded")).collect()}
    assert len(files) > 3 and sum(lo <= "wolf1\U0010ffff" and hi >= "wolf1" for _, lo, hi in files) <= 2  # other files are skipped by their bounds
    for few in (names.NAMED_PREFIXES, 0):
        names.NAMED_PREFIXES = few
        asked = spark.createDataFrame([("st",), ("wolf1",), ("s",), ("storm2 ",), ("zzz",)], "query string").withColumn("folded", F.trim("query"))
        want = {(q, i) for q in ("st", "wolf1", "s", "storm2 ", "zzz") for i, n, _ in rows if n.lower().startswith(q.strip())}
        assert {tuple(r) for r in names.prefixed(asked, table).collect()} == want and want
    names.NAMED_PREFIXES = 100
    asked = spark.createDataFrame([(" ".join(reversed(n.split())),) for _, n, _ in rows[:40]] + [("wolf1 nosuch",), ("moon3",)], "query string").withColumn("folded", F.col("query"))
    want = {(q, i) for (q,) in asked.select("query").collect() for i, n, _ in rows if set(q.split()) <= set(n.lower().split())}
    assert {tuple(r) for r in names.with_all_words(asked, table).distinct().collect()} == want
    got = {r["query"]: (r["layer"], r["id"], r["total"]) for r in names.resolve(spark.createDataFrame([("dusk",), ("DAWN // dusk",), ("Dawn // Dusk",), (rows[7][1][:-1] + "x",)], "query string"), table, kept=True).where("place = 1").collect()}
    assert got["dusk"] == ("L2", 900, 1) and got["DAWN // dusk"][:2] == ("L1", 900) and got["Dawn // Dusk"][:2] == ("L0", 900) and got[rows[7][1][:-1] + "x"][0] == "L5"


def test_nearest_holds_the_best_however_many_rows_tie():
    """What a task holds and passes on is its best rows of each query, not those of every batch; tiles have a bound."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    m, v = rng.integers(-2, 3, (3_000, 4)).astype(float), rng.integers(-2, 3, (20_000, 4)).astype(float)
    ids = rng.permutation(20_000)
    best = retrieval.Nearest(len(m), 7)
    tracemalloc.start()
    for at in range(0, len(v), retrieval.ROWS):
        for a, b in best.tiles(retrieval.ROWS):
            best.add(a, pa.array(ids[at : at + retrieval.ROWS]), m[a:b] @ v[at : at + retrieval.ROWS].T)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = [x for b in best.batches() for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert len(got) == 7 * len(m) and peak < 100 << 20  # all products at once are 480 MB
    for q in (0, 1, 1_499, 2_999):
        s = retrieval.rounded(m[q] @ v.T)
        assert [x[1] for x in got if x[0] == q] == ids[np.lexsort((ids, -s))[:7]].tolist()


def test_word_search_shuffles_no_pairs_of_query_and_document(spark, tmp_path):
    """Postings are dealt by block; scores of a query and a document are summed without another shuffle."""
    plans = []
    docs = spark.range(3_000).select(F.col("id"), F.concat_ws(" ", F.concat(F.lit("w"), F.col("id") % 7), F.concat(F.lit("v"), F.col("id") % 5), F.lit("all")).alias("text"))
    queries = spark.createDataFrame([(i, f"w{i % 7} v{i % 5}") for i in range(40)], "q int, text string")
    index = inverted.stored(inverted.build(docs, "id", "text", 4, 128), replaced, "pairs")

    def keep(scores):
        plans.append(scores._jdf.queryExecution().executedPlan().toString())
        return scores

    got = inverted.topk(index, queries, "q", "text", 5, keep=keep, digits=6)
    want = retrieval.ranked(retrieval.bm25(docs, "id", "text", queries, "q", "text").withColumn("score", F.round("score", 6)), 5)
    assert sorted(map(tuple, got.select("query", "doc", "score", "rank").collect())) == sorted(map(tuple, want.select("query", "doc", "score", "rank").collect()))
    assert plans and not any("Exchange" in line and "query" in line and "doc" in line for plan in plans for line in plan.splitlines())


def test_requests_of_one_filter_share_a_set(spark, monkeypatch):
    """Entities are listed for each distinct filter, not for each request."""
    from loomwork.plans import catalog

    seen, real = [], bitmaps.listed
    monkeypatch.setattr(bitmaps, "listed", lambda sets, numbers: seen.append(sets.select("query").distinct().count()) or real(sets, numbers))
    catalog.QUERIES["batched_hybrid"](spark, "/root/testdata/sf0.001")
    assert seen == [2]


def test_index_is_built_in_tasks_of_like_size(spark, docs, asked, monkeypatch):
    """How many postings a task groups depends neither on the corpus, nor on the session's partitions, nor on how long documents are."""
    monkeypatch.setattr(inverted, "TASK_POSTS", 500, raising=False)
    monkeypatch.setattr(inverted, "LEAST_POSTS", 50, raising=False)
    for copies in (1, 3):
        more = written(docs.crossJoin(spark.range(copies).select(F.col("id").alias("k"))).select((F.col("id") + 1_000 * F.col("k")).alias("id"), "text"), "more")
        index = inverted.build(more, "id", "text", buckets=4, block_docs=16)
        plan = index.blocks._jdf.queryExecution().executedPlan().toString()
        assert plan.split("Initial Plan")[-1].count("Exchange") == 1
        tasks = [r["n"] for r in index.blocks.groupBy(F.spark_partition_id().alias("task")).agg(F.sum("n").alias("n")).collect()]
        assert sum(tasks) > 10_000 * copies and max(tasks) <= 3 * 500
        plain = retrieval.ranked(retrieval.bm25(more, "id", "text", asked, "q", "text").withColumn("score", F.round("score", 6)), 5)
        assert found(inverted.topk(index, asked, "q", "text", 5, digits=6)) == found(plain)


def test_a_task_sums_scores_of_few_blocks(spark, monkeypatch):
    monkeypatch.setattr(inverted, "BLOCK_DOCS", 16)
    monkeypatch.setattr(inverted, "PART_SCORES", 640)
    docs = spark.range(1_280).select("id", F.concat(F.lit("v"), F.col("id") % 5).alias("text"))
    queries = spark.createDataFrame([(q, f"v0 v1 v2 v3 v4 v{q % 5}") for q in range(20)], "q int, text string")
    index, most = inverted.stored(inverted.build(docs, "id", "text", 4, 16), replaced, "dealt"), []

    def keep(scores):
        most.append([r["n"] for r in scores.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()])
        return scores

    assert inverted.topk(index, queries, "q", "text", 100, keep=keep, digits=6).count() == 20 * 100
    # Each document meets each query. One block beyond: chance makes some of more than 16 documents.
    assert sum(map(sum, most)) > 10_000 and max(map(max, most)) <= 640 + 20 * 28, most
