"""Chat formatting, turn repair and the manifest, against plain models and on odd tables."""

import hashlib
import json
import random
from functools import cache

import pytest
from pyspark.sql import functions as F

from loomwork.llm import chat_format, merkle_manifest, queries, shared, turn_repair

from .helpers import corpus, frame

CONVERSATIONS = "conv_id long, turn long, role string, text string, key string, place long, block long, layout string, turns string, row long, node string"


def conversations(rows):
    return [(*r, *("clash", 7, 7, "clash", "clash", 7, "clash")) for r in rows]


# --- 11: formatting

RECORDS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a", "weight": 1}], "id": 3}, "messages", [("user", "q"), ("assistant", "a")]),
    ({"messages": [{"role": "user", "content": None}], "prompt": "q", "system": "s"}, "messages", [("system", "s"), ("user", "")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}, {"from": "tool", "value": "t"}]}, "exchange", [("user", "q"), ("assistant", "a"), ("tool", "t")]),
    ({"prompt": "q", "completion": "a", "score": {"of": [1, 2]}}, "prompt", [("user", "q"), ("assistant", "a")]),
    ({"prompt": "q", "response": "a", "system": "s"}, "response", [("system", "s"), ("user", "q"), ("assistant", "a")]),
    ({"instruction": "do", "input": "this", "output": "done", "history": [["a", "b"], ["c"]]}, "instruction", [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", ""), ("user", "do\n\nthis"), ("assistant", "done")]),
    ({"question": "q", "answer": "a", "we ird": {"a`b": None}}, "question", [("user", "q"), ("assistant", "a")]),
    ({"role": "user", "text": "t", "turn": 3}, "turn", [("user", "t")]),
    ({"something": "else"}, None, []),
    ({}, None, []),
]


def test_layouts_of_json(spark):
    texts = [json.dumps(r) for r, _, _ in RECORDS] + ["no json", None, "[1]"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, layout string")
    got = {r["i"]: (r["layout"], [tuple(t) for t in r["turns"]]) for r in chat_format.of_json(df, "layout", "i").collect()}
    assert got == {i: (x[1], x[2]) for i, x in enumerate(RECORDS)} | {len(RECORDS) + k: (None, []) for k in range(3)}


def test_paths_of_nested_records(spark):
    text = '{"a": {"b": [{"c": 1, "d": {}}, {"c": [2]}], "e f": null}, "g": [[1.5]], "h": [], "`": 1}'
    got = spark.createDataFrame([(text,)], "r string").select(chat_format.shape(F.parse_json("r"))).head()[0]
    assert sorted(got) == ["``", "a.b[].c", "a.e f", "g[][]", "h[]"]


def test_layouts_of_rows(spark):
    schema = "id int, role string, text string, prompt string, completion string, conversations array<struct<from: string, value: string>>, turn int, more string"
    rows = [(1, "user", "t", None, None, None, 4, "x"), (2, None, None, "q", "a", None, None, "x"), (3, None, None, None, None, [("human", "h"), ("gpt", None)], None, None), (4, None, None, None, None, None, None, "x"), (5, "user", "t", "q", "a", None, None, None)]
    got = {r["id"]: (r["layout"], [tuple(t) for t in r["turns"]]) for r in chat_format.of_rows(spark.createDataFrame(rows, schema), "id").collect()}
    assert got == {1: ("turn", [("user", "t")]), 2: ("prompt", [("user", "q"), ("assistant", "a")]), 3: ("exchange", [("user", "h"), ("assistant", "")]), 4: (None, []), 5: (None, [])}


MARKS = ["<|im_start|>", "<|im_end|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "\\l", "\\e", "\\n", "\n", "<", "|", "[", "<|", "x", "é", "\U0001f600", "<|im_start|>user\nhi<|im_end|>\n", "[[INST]", "<<s>"]


def test_escapes_can_be_undone_and_leave_no_marks(spark):
    rng = random.Random(5)
    texts = ["", *MARKS, *("".join(rng.choice(MARKS) for _ in range(rng.randint(1, 12))) for _ in range(300))]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_format.escaped(F.col("t")).alias("e"), chat_format.unescaped(chat_format.escaped(F.col("t"))).alias("u")).collect():
        assert r["u"] == r["t"]
        assert not any(m in r["e"] for m in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def test_formatted_is_read_back(spark):
    rng = random.Random(6)
    turns = [[(rng.choice(["user", "assistant", "system", "as\nsist<|im_end|>", ""]), "".join(rng.choice(MARKS) for _ in range(rng.randint(0, 9)))) for _ in range(rng.randint(0, 7))] for _ in range(100)]
    df = chat_format.formatted(spark.createDataFrame(list(enumerate(turns)), f"i int, turns {chat_format.TURNS}"))
    for r in df.select("i", chat_format.read(F.col("formatted")).alias("read"), chat_format.under_loss(F.col("pieces")).alias("loss"), "formatted", "pieces").collect():
        assert [tuple(t) for t in r["read"]] == turns[r["i"]]
        assert r["loss"] == "".join(t for role, t in turns[r["i"]] if role == "assistant")
        assert r["formatted"] == "".join(p["text"] for p in r["pieces"])


# --- 13: repair


def plain_repair(turns):
    """(cost, audit) by trying all edits."""
    n = len(turns)

    @cache
    def best(i, state, inserted):
        out = [(0, "")] if i == n and state in (0, 3) else []
        if inserted < 2:
            c, a = best(i, {0: 2, 1: 2, 2: 3, 3: 2}[state], inserted + 1)
            out.append((c + 5, "I" + a))
        if i < n:
            c, a = best(i + 1, state, 0)
            out.append((c + 2, "D" + a))
            if not turns[i].isdigit():
                cut = 5 if turns[i].isupper() else 0
                c, a = best(i + 1, {0: 2, 1: 2, 2: 3, 3: 2}[state], 0)
                out.append((c + 1 + cut, "R" + a))
                to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((state, turns[i].lower()))
                if to:
                    c, a = best(i + 1, to, 0)
                    out.append((c + cut, "K" + a))
        return min(out, default=(10**6, ""))

    return best(0, 0, 0)


@pytest.mark.parametrize("block", [1, 3, 32])
def test_layers_against_all_edits(monkeypatch, block):
    monkeypatch.setattr(turn_repair, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(1500):
        turns = "".join(rng.choice("suuaaaxSUAX012") for _ in range(rng.randint(0, 12)))
        cost, audit, edits, last = turn_repair.repaired(turns)
        assert (cost, audit) == plain_repair(turns), turns
        assert sum(map(len, edits)) == len(turns)


def test_layers_of_a_long_conversation():
    turns = "sua" + "uauxaUs2" * 5000
    cost, audit, _, _ = turn_repair.repaired(turns)
    assert len(audit) >= len(turns) and cost < 2 * len(turns)
    short = "sua" + "uauxaUs2" * 10
    assert turn_repair.repaired(short)[:2] == plain_repair(short)


ODD = [(1, 0, "user", "one."), (1, 1, "assistant", "two."), (1, 1, "assistant", "two."), (1, None, None, None), (2, 0, None, "x"), (None, 0, "user", "a."), (None, None, "", ""), (3, 5, "sys", "s"), (3, 5, "bot", "s"), (4, 0, "user", " \n\t"), (None, None, None, None)]
ODD += [(5 + i // 6, i % 6, ("user", "assistant")[i % 2], f"turn {i}" + ".!?,"[i % 4]) for i in range(240)] + [(99, i, ("user", "assistant")[i % 3 % 2], "again." if i % 5 else f"text {i}") for i in range(90)] + [(99, 1000, "assistant", "word " * 200_000 + ".")]


@pytest.fixture(scope="module")
def odd_conversations(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("conversations")
    spark.createDataFrame(conversations(ODD), CONVERSATIONS).repartition(3).write.parquet(f"{at}/conversations.parquet")
    frame(spark, corpus()).write.parquet(f"{at}/documents.parquet")
    return str(at)


def test_repair_reads_back_as_its_audit_says(spark, odd_conversations):
    """The repaired turns, made in plain Python of the damaged rows and the audit, have the hash and fit the grammar."""
    damaged = turn_repair.damaged(spark.read.parquet(f"{odd_conversations}/conversations.parquet")).collect()
    for r in queries.op13_turn_repair(spark, odd_conversations).collect():
        key = "n" if r["conv_id"] is None else f"c{r['conv_id']}"
        rows = sorted(((d["turn"] is not None, d["turn"] or 0, d["role"], hashlib.md5(d["text"].encode()).hexdigest(), d["text"]) for d in damaged if d["key"] == key))
        out, state, i = [], 0, 0
        for edit in r["audit"]:
            to = {0: 2, 1: 2, 2: 3, 3: 2}[state]
            if edit == "I":
                out.append(("user" if to == 2 else "assistant", ""))
            elif edit == "R":
                out.append(("user" if to == 2 else "assistant", rows[i][4]))
            elif edit == "K":
                out.append((rows[i][2], rows[i][4]))
                to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}[state, rows[i][2][:1]]
            state, i = to if edit != "D" else state, i + (edit != "I")
        assert i == len(rows) and state in (0, 3)
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_schema_fingerprint", "op12_merkle_manifest", "op13_turn_repair"])
def test_empty_tables(spark, tmp_path, name):
    spark.createDataFrame([], CONVERSATIONS).write.parquet(f"{tmp_path}/conversations.parquet")
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES[name](spark, str(tmp_path)).collect()
    assert [r["conv_id"] for r in got] == ([-1] if "11" in name else [])


# --- 12: the manifest


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 81, 82, 100])
def test_trees_of_blocks_are_those_of_levels(spark, monkeypatch, n):
    monkeypatch.setattr(merkle_manifest, "LAYER", 2)
    monkeypatch.setattr(merkle_manifest, "BLOCK", 9)
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    df = shared.saved(spark.createDataFrame([(7, i, bytearray(x)) for i, x in enumerate(leaves)], "tree long, at long, node binary"), "leaves")
    levels = [[x.hex() for x in leaves]]
    while len(levels[-1]) > 1:
        levels.append([hashlib.sha256("".join(levels[-1][i : i + 3]).encode()).hexdigest() for i in range(0, len(levels[-1]), 3)])
    forest = merkle_manifest.grown(df)
    assert [(r["tree"], r["n"], r["root"].hex()) for r in forest.trees.collect()] == [(7, n, levels[-1][0])]
    for r in merkle_manifest.proofs(df, forest).collect():
        at, want = r["at"], []
        for k, level in enumerate(levels[:-1]):
            want += [(k, i, level[i]) for i in range(at // 3 * 3, min(at // 3 * 3 + 3, len(level))) if i != at]
            at //= 3
        assert [(s["level"], s["at"], s["node"].hex()) for s in r["siblings"]] == want


def test_tampering_shows(spark):
    docs = frame(spark)
    shown = merkle_manifest.verified(docs, F.col("doc_id") == 5, F.concat("text", F.lit(" "))).collect()
    assert {r["doc_id"] for r in shown if not r["verified"]} == {5} and len(shown) == len(corpus())


def test_places_of_hot_and_equal_rows(spark):
    df = shared.saved(spark.createDataFrame([("hot" if i % 3 else f"k{i}", i // 50, i) for i in range(900)], "by string, own long, row long").repartition(5), "rows")
    got = {}
    for r in shared.in_order(df, "by", ["own", "row"]).collect():
        got.setdefault(r["by"], []).append((r["place"], r["own"], r["row"]))
    assert all([x[0] for x in sorted(v)] == list(range(len(v))) and [x[1:] for x in sorted(v)] == sorted(x[1:] for x in v) for v in got.values())
