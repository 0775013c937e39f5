"""Conversation structure repair: the cheapest edits that make roles alternate, after Wu and Manber.

Layers of cost: for cost 0, 1, 2, ... a set of grammar states (four bits) before each turn, from which the rest can be ended at exactly that
cost. The first layer with the start state before the first turn gives the cost; the trace goes forward and takes, at each turn, the least
letter whose state has its bit in the layer that is left. Turns are dealt in blocks of ``BLOCK``: the layers of a block begin with the
costs behind it, four numbers that differ by little, so work grows with the number of turns and not with its square.

Edits: Keep (0), Rerole to what the grammar wants next (1), Delete (2, the only one for blank and repeated turns), Insert (5); turns that
stay though they are truncated cost 5 more. Roles go by their first letter, others than s, u and a cannot be kept.

Nulls: a null role or text is one space, also in the crc32 that damages; rows without an id are one conversation; turns without a number come
first. Ties of turn are ordered by role, then by md5 of the text, so equal rows stand together and all but the first are duplicates. Empty texts
are blank. A conversation of which no row is left has zeros, an empty audit and the hash of nothing; an empty table gives no rows. Other
columns are ignored, whatever their names. A conversation that is a large share of all rows is dealt by ranges and blocks; one task holds of it
a letter a turn, as its audit in the result does, and streams its text through one hash, which no split can share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import hot, in_order, modest_batches, saved, split_join, tidily

SPACE = " \t\n\x0b\x0c\r"
BLOCK = 32
#: States: at the start, after s, after u, after a. What each letter, and a turn of the role that is wanted next, leads to.
KEEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "x": {}}
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
#: What it costs to end in each state, and the edits for it.
END_COST, END = (0, 10, 5, 0), ("", "II", "I", "")
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5


def _back(step: dict[int, int]) -> bytes:
    """For each set of states, those that ``step`` leads into it."""
    return bytes(sum(1 << s for s, t in step.items() if bits >> t & 1) for bits in range(16))


BACK, BACK_NEXT = {k: _back(v) for k, v in KEEP.items()}, _back(NEXT)


def layers(turns: str, after: tuple[int, ...], wanted: int) -> list[bytearray]:
    """A layer for each cost until all states of ``wanted`` have been seen before the first turn. ``turns``: a letter of s, u, a and x each,
    upper case if truncated, a digit if it must go. ``after``: what each state costs behind them."""
    n, out, seen = len(turns), [], 0
    none = bytearray(n + 1)
    rules = [(BACK.get(t.lower()), TRUNCATED * t.isupper()) for t in turns]
    while seen & wanted != wanted:
        c = len(out)
        before = lambda k: out[c - k] if c >= k else none  # noqa: E731, B023
        deleted, inserted, rerole, keep_cut, rerole_cut = (before(k) for k in (DELETE, INSERT, REROLE, TRUNCATED, REROLE + TRUNCATED))
        row = bytearray(n + 1)
        bits = row[n] = sum(1 << s for s in range(4) if after[s] == c)
        for i in range(n - 1, -1, -1):
            back, cut = rules[i]
            new = deleted[i + 1] | BACK_NEXT[inserted[i]]
            if back is not None:
                new |= back[keep_cut[i + 1]] | BACK_NEXT[rerole_cut[i + 1]] if cut else back[bits] | BACK_NEXT[rerole[i + 1]]
            bits = row[i] = new
        out.append(row)
        seen |= row[0]
    return out


def costs(found: list[bytearray]) -> tuple[int, ...]:
    return tuple(next(c for c, row in enumerate(found) if row[0] >> s & 1) for s in range(4))


def traced(turns: str, found: list[bytearray], state: int, left: int) -> tuple[list[str], int, int]:
    """The least edits a turn, those before it included, with the state and the cost that are left. Letters: I of role u or a (``U``, ``A``), D, K,
    R to u or a (``u``, ``a``)."""
    out, role = [], {2: "u", 3: "a"}
    for i, t in enumerate(turns):
        edits, stays, cut = "", not t.isdigit(), TRUNCATED * t.isupper()

        def fits(s: int, cost: int, at: int) -> bool:
            return cost >= 0 and found[cost][at] >> s & 1 == 1  # noqa: B023

        while True:
            kept, to = KEEP.get(t.lower(), {}).get(state), NEXT[state]
            if fits(state, left - DELETE, i + 1):
                edits, left = edits + "D", left - DELETE
            elif fits(to, left - INSERT, i):
                edits, state, left = edits + role[to].upper(), to, left - INSERT
                continue
            elif stays and kept is not None and fits(kept, left - cut, i + 1):
                edits, state, left = edits + "K", kept, left - cut
            else:
                edits, state, left = edits + role[to], to, left - REROLE - cut
            break
        out.append(edits)
    return out, state, left


def repaired(turns: str) -> tuple[int, str, list[list[str]], str]:
    """(cost, audit, edits by block and turn, roles inserted at the end)."""
    if not turns:
        return 0, "", [], ""
    blocks = [turns[i : i + BLOCK] for i in range(0, len(turns), BLOCK)]
    behind = [END_COST]
    for block in reversed(blocks[1:]):
        least = min(behind[-1])
        behind.append(tuple(least + c for c in costs(layers(block, tuple(x - least for x in behind[-1]), 15))))
    behind.reverse()
    state, cost, left, edits = 0, None, 0, []
    for block, after in zip(blocks, behind, strict=True):
        least = min(after)
        found = layers(block, tuple(x - least for x in after), 1 << state)
        own = len(found) - 1
        cost = own + least if cost is None else cost
        own_edits, state, left = traced(block, found, state, own)
        edits.append(own_edits)
    inserted = {1: "UA", 2: "A"}.get(state, "")
    letters = {"U": "I", "A": "I", "D": "D", "K": "K", "u": "R", "a": "R"}
    return cost or 0, "".join(letters[x] for block in edits for turn in block for x in turn) + END[state], edits, inserted


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a block: (key, block, edits), and in a conversation's first (illegal, cost, audit, inserted at the end)."""
    legal = {"su", "ua", "au"}
    plain = str.maketrans("SUAX0123", "suaxsuax")
    schema = pa.schema([("key", pa.string()), ("block", pa.int64()), ("edits", pa.list_(pa.string())), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("last", pa.string())])
    for batch in batches:
        rows = []
        for key, turns in zip(batch.column("key").to_pylist(), batch.column("turns").to_pylist(), strict=True):
            cost, audit, edits, last = repaired(turns)
            roles = turns.translate(plain)
            illegal = sum(roles[i : i + 2] not in legal for i in range(len(roles) - 1))
            rows += [(key, b, own, *((illegal, cost, audit) if b == 0 else (None,) * 3), last if b == len(edits) - 1 else "") for b, own in enumerate(edits)]
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, sha256) of the texts of each key, which stand together in order, with line ends between."""
    at, h = None, None
    for batch in batches:
        out = []
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if key != at:
                if at is not None:
                    out.append((at, h.hexdigest()))
                at, h = key, hashlib.sha256()
            else:
                h.update(b"\n")
            h.update(text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(2)], names=["key", "sha"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([h.hexdigest()])], names=["key", "sha"])


def damaged(rows: DataFrame) -> DataFrame:
    """(key, turn, role, text) of ``rows`` (conv_id, turn, role, text), by crc32 of conversation and turn."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n"))
    how = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    kept = rows.select(key.alias("key"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), how.alias("how")).where("how <> 0")
    other = F.when(F.col("how") == 1, F.lit("")).when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    done = kept.select("key", "turn", F.when(F.col("how") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), other.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("how") == 3, 2).otherwise(1))).alias("copy"))
    return done.drop("copy")


def faults(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` (key, turn, role, text) as (key, turn, role, row) with ``place`` in their conversation, ``fault`` (blank, duplicate, truncated or
    none) and ``letter``; and their texts (row, text), saved."""
    trimmed = F.rtrim("text", F.lit(SPACE))
    fault = F.when(trimmed == "", "blank").when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("none")
    marked = rows.select("*", F.md5("text").alias("digest"), fault.alias("own")).withColumn("row", F.monotonically_increasing_id())
    marked = saved(modest_batches(marked), "repair-rows")
    placed = saved(in_order(marked.drop("text"), "key", ["turn", "role", "digest", "row"]), "repair-places")
    same = placed.groupBy("key", "role", "digest").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    same = saved(same.select(F.col("key").alias("s_key"), F.col("role").alias("s_role"), F.col("digest").alias("s_digest"), "first", "n"), "repair-repeats")
    on = (F.col("key") == F.col("s_key")) & (F.col("role") == F.col("s_role")) & (F.col("digest") == F.col("s_digest"))
    joined = split_join(placed, same, on, hot(F.col("n"), placed.count()), "left")
    found = F.when((F.col("own") != "blank") & (F.col("place") > F.coalesce("first", "place")), "duplicate").otherwise(F.col("own"))
    initial = F.when(F.left("role", F.lit(1)).isin("s", "u", "a"), F.left("role", F.lit(1))).otherwise("x")
    letter = F.when(F.col("fault") == "truncated", F.upper(initial)).when(F.col("fault") == "none", initial).otherwise(F.translate(initial, "suax", "0123"))
    return joined.select("key", "turn", "role", "place", "row", found.alias("fault")).withColumn("letter", letter), marked.select("row", "text")


def repair(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row for each conv_id of ``conversations``; ``rows``: (key, turn, role, text), where key is ``damaged``'s."""
    found, texts = faults(rows)
    found = saved(found.withColumn("block", F.floor(F.col("place") / BLOCK)), "repair-faults")
    blocks = found.groupBy("key", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "letter"))), lambda x: x["letter"]), "").alias("letters"), *(F.sum((F.col("fault") == f).cast("long")).alias(f) for f in ("blank", "duplicate", "truncated")))
    whole = blocks.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "letters"))), lambda x: x["letters"]), "").alias("turns"), *(F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")))
    whole = saved(whole, "repair-turns")
    audits = saved(whole.select("key", "turns").mapInArrow(tidily(_audits), "key string, block long, edits array<string>, illegal long, cost long, audit string, last string"), "repair-audits")
    spans = found.where("turn is not null").groupBy("key", "turn").agg(F.lit(1).alias("one")).groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))

    letters = F.split(F.element_at("edits", (F.col("place") - F.col("block") * BLOCK + 1).cast("int")), "")
    role = F.create_map(F.lit("u"), F.lit("user"), F.lit("a"), F.lit("assistant"))
    line = lambda x: F.when(x == "K", F.concat("role", F.lit(":"), "text")).when(x == "D", F.lit(None).cast("string")).when(x == F.upper(x), F.concat(F.element_at(role, F.lower(x)), F.lit(":"))).otherwise(F.concat(F.element_at(role, x), F.lit(":"), "text"))
    said = found.select("key", "block", "place", "role", "row").join(texts, "row").join(audits.select("key", "block", "edits"), ["key", "block"])
    lines = said.select("key", "block", "place", F.array_join(F.filter(F.transform(letters, line), lambda x: x.isNotNull()), "\n").alias("line"), F.exists(letters, lambda x: x != "D").alias("stays")).where("stays")
    last = audits.where("last <> ''").select("key", "block", F.lit((1 << 62)).alias("place"), F.when(F.col("last") == "A", F.lit("assistant:")).otherwise(F.lit("user:\nassistant:")).alias("line"))
    chunks = lines.drop("stays").unionByName(last).groupBy("key", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("text"))
    shas = chunks.repartition("key").sortWithinPartitions("key", "block").select("key", "text").mapInArrow(tidily(_hashed), "key string, sha string")

    ids = conversations.select("conv_id").distinct().withColumn("key", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n")))
    firsts = audits.where("block = 0").select("key", "illegal", "cost", "audit")
    out = ids.join(whole.drop("turns"), "key", "left").join(spans, "key", "left").join(firsts, "key", "left").join(shas, "key", "left")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
