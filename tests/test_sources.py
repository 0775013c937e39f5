"""Array files by byte ranges, resumed work and stateful streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loomwork.sources.arrays import array_records
from loomwork.sources.records import read_records

SCHEMA = "id int, text string, deep struct<a: array<int>, b: map<string, string>>"


def odd_records(n=400):
    rng = random.Random(1)
    bits = ['"', "\\", "}", "{", "[", "]", "\n", "é", "\U0001f600", "x", ", ", '\\"', "}{", '"}', "\\\\"]
    return [{"id": i, "text": "".join(rng.choice(bits) for _ in range(rng.randrange(30))), "deep": {"a": [1] * rng.randrange(4), "b": {"k}": "{v"} if i % 3 else {}}} for i in range(n)]


@pytest.fixture()
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("style", ["line", "pretty", "one a line", "not escaped", "no array"])
def test_array_files_are_read_by_ranges(spark, tmp_path, small_ranges, style):
    rows = odd_records()
    text = {"line": json.dumps(rows), "pretty": json.dumps(rows, indent=2), "one a line": "[\n" + ",\n".join(map(json.dumps, rows)) + "\n]\n", "not escaped": json.dumps(rows, ensure_ascii=False), "no array": "\n".join(map(json.dumps, rows))}[style]
    (tmp_path / "a.json").write_text(text, encoding="utf-8")
    (tmp_path / "b.json").write_text("[]")
    found = array_records(spark, str(tmp_path))
    assert sorted((json.loads(r["value"]) for r in found.collect()), key=lambda r: r["id"]) == rows
    assert spark.read.text(str(tmp_path), lineSep="}").rdd.getNumPartitions() > 20
    got = read_records(spark, str(tmp_path / "a.json"), SCHEMA).orderBy("id").collect()
    assert [(r["id"], r["text"], r["deep"]["a"], r["deep"]["b"]) for r in got] == [(r["id"], r["text"], r["deep"]["a"], r["deep"]["b"]) for r in rows]


def test_records_longer_than_ranges(spark, tmp_path, small_ranges):
    rows = [{"id": 0, "text": "a"}, {"id": 1, "text": "}\"{" * 1500}, {"id": 2, "text": "b"}]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    assert sorted((json.loads(r["value"]) for r in array_records(spark, str(tmp_path)).collect()), key=lambda r: r["id"]) == rows


@pytest.mark.parametrize("cut", [1, 2, 3, 6, 40])
def test_broken_tails_fail(spark, tmp_path, small_ranges, cut):
    text = json.dumps([{"id": i, "text": "t" * 60} for i in range(60)])
    (tmp_path / "a.json").write_text(text[:-cut])
    with pytest.raises(Exception, match="ends early"):
        array_records(spark, str(tmp_path)).collect()


def test_model_calls_are_kept_batch_by_batch(spark, tmp_path):
    """A client that fails in the middle: what was answered is kept, and a rerun asks for the rest alone."""
    from loomwork.plans import models, resumable
    from loomwork.sources.store import Store

    asked = tmp_path / "asked"
    asked.mkdir()

    class Counting(models.StandIn):
        def describe(self, reference, reason):
            (asked / f"{reference}-{random.randrange(10**9)}").write_text("")
            if self.down and reference in self.down:
                raise OSError("down")
            return super().describe(reference, reason)

    client = Counting()
    todo = spark.createDataFrame([(i, f"ref{i}") for i in range(20)], "entity int, reference string")
    store = Store(spark, f"{tmp_path}/store")
    make = lambda rows: models.described(rows, "entity", "reference", client)
    client.down = {f"ref{i}" for i in range(0, 20, 3)}
    first = resumable.worked(store, "descriptions", todo, "entity", make, batch=4, failures=3)
    assert first.stopped and first.failed >= 3 and 0 < first.done < 17
    assert store.read("descriptions").count() == first.done == len(store.head()[1]["tables"]["descriptions"]["deltas"] and store.read("descriptions").select("entity").distinct().collect())
    before = {r["entity"] for r in store.read("descriptions").collect()}
    for f in asked.iterdir():
        f.unlink()
    client.down = set()
    second = resumable.worked(store, "descriptions", todo, "entity", make, batch=4)
    assert (second.done, second.failed, second.stopped) == (20 - first.done, 0, False)
    assert {int(f.name.split("-")[0][3:]) for f in asked.iterdir()} == set(range(20)) - before
    assert resumable.worked(store, "descriptions", todo, "entity", make) == resumable.Progress(0, 0, False)


@pytest.fixture()
def rocksdb(spark):
    from loomwork.streaming import feeds

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", feeds.ROCKSDB)
    yield feeds
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_votes_of_a_stream_that_is_stopped_in_between(spark, tmp_path, rocksdb):
    from loomwork.operators import incremental
    from loomwork.sources.store import Store

    rng = random.Random(3)
    rows = [(f"q{rng.randrange(3)}", f"e{rng.randrange(4)}", float(rng.randrange(2)), i) for i in range(120)]
    rng.shuffle(rows)
    store, schema, folder = Store(spark, f"{tmp_path}/store"), "query_id string, id string, fit double, seq long", f"{tmp_path}/in"
    for k in range(4):  # a restart after each two files
        spark.createDataFrame(rows[k * 30 : k * 30 + 30], schema).coalesce(1).write.mode("append").parquet(folder)
        if k % 2:
            q = rocksdb.stored(rocksdb.latest_votes(rocksdb.landed(spark, folder, schema, files=1)), store, "votes", ["query_id", "id"], "seq", f"{tmp_path}/cp")
            assert q.awaitTermination(120)
    df = spark.createDataFrame(rows, schema)
    want = incremental.last_wins(df.limit(0), df, ["query_id", "id"], "seq")
    order = lambda d: sorted(tuple(r) for r in d.select("query_id", "id", "fit", "seq").collect())
    assert order(store.read("votes")) == order(want)
    number = store.head()[0]
    stream = f"votes@{tmp_path}/cp"
    with store.transaction() as t:  # the last batch once more
        assert not t.once(stream, store.head()[1]["batches"][stream])
    assert store.head()[0] == number


def test_live_medians_are_those_of_the_batch(spark, tmp_path, rocksdb):
    from loomwork.operators import scoring
    from loomwork.sources.store import Store

    rng = random.Random(4)
    rows = [(f"k{rng.randrange(3)}", None if i % 11 == 0 else rng.random(), f"2024-01-01 00:{i // 2 % 60:02d}:00", i) for i in range(150)]
    schema, folder, store = "key string, seconds double, at string, number long", f"{tmp_path}/in", Store(spark, f"{tmp_path}/store")
    for k in range(3):
        spark.createDataFrame(rows[k * 50 : k * 50 + 50], schema).coalesce(1).write.mode("append").parquet(folder)
        live = rocksdb.medians(rocksdb.landed(spark, folder, schema, files=1), "key", "seconds", "at", "number")
        q = rocksdb.stored(live.withColumn("seq", F.current_timestamp()), store, "medians", ["key"], "seq", f"{tmp_path}/cp")
        assert q.awaitTermination(120)
    want = scoring.rolling_median(spark.createDataFrame(rows, schema), "seconds", [F.desc("at"), F.desc("number")], ["key"])
    assert {r["key"]: (round(r["median"], 9), r["n"]) for r in store.read("medians").collect()} == {r["key"]: (round(r["median"], 9), r["n"]) for r in want.collect()}
