"""Log10 probabilities of texts under a bigram model whose counts lie in a log-frequency Bloom filter (op 5).

Tokens are words (A-Z lower-cased, split at ASCII white space) and one end a text. Texts become blocks of numbered tokens, which are written.
A block asks each segment of the key space for its distinct bigrams and tokens, with their counts in training texts; a segment adds up what
all blocks send. Bigrams are dealt by the hash of the pair, so that a frequent word's do not meet in one segment. A segment then becomes a
Bloom filter: a bigram of quantised count q (1 + floor(log2 count)) is entered q times, as (key, 1) to (key, q). Each bigram asked for is
probed as (key, 1), (key, 2), ... until a probe misses; an unseen one passes with probability f = 2 ** -PROBES. The levels, and the tokens'
exact counts, go back to the blocks, where texts are scored. The smoothed probability is

    P(w | u) = (m + MU * P(w)) / (c(u) + MU + f * (V + 1)),    P(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1))

with m the least count of level q, but no more than c(u) or c(w), and c the exact token counts. So no
probability is above 1, and those of all words after u add up to 1 at most: the m of bigrams that occur are no more than their counts, which
add up to c(u), and f * (V + 1) is what others are expected to add.

The filter grows with the corpus, about 30 bits a distinct bigram. So segments are of a fixed size, and their number grows; a task holds the
filter of one segment, or the tokens of one block, at a time. Both ways are shuffles: nothing is broadcast, and the driver gets no more
than sums.

Null text counts as empty text: one end token. No training text: every probability is that of P(w) with c = N = V = 0. Repeated rows: each
is learned from and scored. Ties: equal texts score equally. Long texts: a block of their own. Empty table: no rows. Only doc_id, text and
the two flags are read, so other columns cannot clash. Tokens are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BATCH_BYTES, mixed, modest_batches, saved, slices, tidily

PROBES = 16
MU = 40.0
#: Bytes of keys and counts (12 a bigram of a block) that a segment is planned for; its filter is smaller.
SEGMENT_BYTES = 24_000_000
#: Tokens that a task holds at once.
BLOCK_TOKENS = 2_000_000

END = b"\n"  # no word has white space
_END_HASH = np.uint64(xxhash.xxh3_64_intdigest(END))


def pair_keys(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return mixed(before * np.uint64(0x9E3779B97F4A7C15) + after + np.uint64(1))


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    """The segment of a bigram's key or of a token's hash."""
    return (mixed(keys) % np.uint64(segments)).astype(np.int32)


def _packed(values: np.ndarray) -> bytes:
    """Compressed, the first bytes of all values before the second ones: numbers that ascend or are small have some that are alike."""
    return len(values).to_bytes(8, "little") + pa.compress(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(blob: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(blob[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(blob[8:], decompressed_size=n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).reshape(n)


def _rows(rows: list[tuple], **kinds: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


class Block:
    """Tokens of some documents by local number, of which 0 is the end."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {END: 0}
        self.parts: list[np.ndarray] = []
        self.lengths: list[int] = []
        self.ids: list[int | None] = []
        self.flags: list[bool | None] = []
        self.tokens = 0

    def add(self, id_: int | None, flag: bool | None, text: bytes | None) -> None:
        words = (text or b"").lower().split()
        numbers = self.numbers
        words.append(END)
        self.parts.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int32, len(words)))
        self.lengths.append(len(words))
        self.ids.append(id_)
        self.flags.append(flag)
        self.tokens += len(words)

    def row(self, number: int) -> pa.RecordBatch:
        words = b" ".join(list(self.numbers)[1:])
        row = (number, self.ids, self.flags, self.lengths, _packed(np.concatenate(self.parts)), _packed(np.frombuffer(words, np.uint8)))
        return _rows([row], block=pa.int64(), ids=pa.list_(pa.int64()), flags=pa.list_(pa.bool_()), lengths=pa.list_(pa.int64()), numbers=pa.binary(), words=pa.binary())


_BLOCK = "block long, ids array<long>, flags array<boolean>, lengths array<long>, numbers binary, words binary"


class Read:
    """A written block: numbers of its tokens, hashes of its words, its distinct bigrams, and the place of each token's among these."""

    def __init__(self, numbers: bytes, words: bytes, lengths: list[int]):
        self.after = _unpacked(numbers, np.int32)
        self.before = np.empty_like(self.after)
        self.before[1:] = self.after[:-1]  # before a text's first token stands the end of another
        self.before[0] = 0
        known = _unpacked(words, np.uint8).tobytes().split()
        self.hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in (END, *known)), np.uint64, 1 + len(known))
        pairs, place = np.unique((self.before.astype(np.int64) << 32) | self.after, return_inverse=True)
        self.place = place.astype(np.int32)
        self.keys = pair_keys(self.hashes[pairs >> 32], self.hashes[pairs & 0xFFFFFFFF])
        self.lengths = np.array(lengths, np.int64)

    def orders(self, segments: int) -> tuple[np.ndarray, np.ndarray]:
        """Of bigrams and of words: by segment, and by key within it."""
        return tuple(np.lexsort((x, segment_of(x, segments))) for x in (self.keys, self.hashes))


def _read(block_tokens: int):
    """A row a block, whose number tells it from those of other tasks. It is written, so that a block asks for what it scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, first, made = Block(), TaskContext.get().partitionId() << 32, 0
        for batch in slices(batches):
            for id_, flag, text in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                block.add(id_, flag, text)
            if block.tokens >= block_tokens:
                yield block.row(first + made)
                block, made = Block(), made + 1
        if block.tokens:
            yield block.row(first + made)

    return run


def _asked(segments: int):
    """What blocks ask of segments: keys in order, each with its count in training texts, which may be 0."""
    kinds = {"block": pa.int64(), "segment": pa.int32(), "pairs": pa.binary(), "pair_counts": pa.binary(), "tokens": pa.binary(), "token_counts": pa.binary()}

    def of(number: int, block: Read, flags: list[bool | None]) -> Iterator[pa.RecordBatch]:
        learned = np.repeat(np.array([f is False for f in flags]), block.lengths)
        counts = [np.bincount(x[learned], minlength=n).astype(np.uint32) for x, n in ((block.place, len(block.keys)), (block.after, len(block.hashes)))]
        keys, (of_pair, of_token) = (block.keys, block.hashes), block.orders(segments)
        cuts = [np.searchsorted(segment_of(k[at], segments), np.arange(segments + 1)) for k, at in zip(keys, (of_pair, of_token), strict=True)]
        rows, held = [], 0
        for s in range(segments):
            i, j = (at[c[s] : c[s + 1]] for at, c in zip((of_pair, of_token), cuts, strict=True))
            if len(i) or len(j):
                rows.append((number, s, _packed(keys[0][i]), _packed(counts[0][i]), _packed(keys[1][j]), _packed(counts[1][j])))
                held += sum(map(len, rows[-1][2:]))
            if rows and (held > BATCH_BYTES or s == segments - 1):
                yield _rows(rows, **kinds)
                rows, held = [], 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = {c: batch.column(c)[i].as_py() for c in ("block", "flags", "lengths", "numbers", "words")}
                yield from of(own["block"], Read(own["numbers"], own["words"], own["lengths"]), own["flags"])

    return run


def _filter(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Bits of the log-frequency Bloom filter of these bigrams."""
    levels = 1 + np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64)
    bits = max(64, math.ceil(levels.sum() * PROBES / math.log(2) / 8) * 8)
    table = np.zeros(bits, bool)
    for q in range(1, int(levels.max(initial=0)) + 1):
        own = keys[levels >= q]
        for i in range(PROBES):
            table[_place(own, q, i, bits)] = True
    return np.packbits(table, bitorder="little").tobytes()


def _place(keys: np.ndarray, level: int, probe: int, bits: int) -> np.ndarray:
    step = np.uint64((level * 64 + probe) * 0xD6E8FEB86659FD93 % (1 << 64))
    return (mixed(keys + step) % np.uint64(bits)).astype(np.int64)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, their counts, the place of each given key among them)."""
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(place, np.concatenate(counts), len(distinct)).astype(np.int64), place


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What segments answer to blocks, in the order asked: levels of bigrams by the segment's filter, counts of tokens. A segment's first row
    has the number of its distinct tokens in training texts and what they add up to."""
    held: dict[int, list[tuple]] = {}
    kinds = {"block": pa.int64(), "segment": pa.int32(), "levels": pa.binary(), "counts": pa.binary(), "distinct": pa.int64(), "total": pa.int64()}
    for batch in batches:
        for block, s, *blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.setdefault(s, []).append((block, *blobs))
    for s in sorted(held):
        asked = held.pop(s)
        pairs, tokens = [_unpacked(r[1], np.uint64) for r in asked], [_unpacked(r[3], np.uint64) for r in asked]
        keys, counts, place = _summed(pairs, [_unpacked(r[2], np.uint32) for r in asked])
        seen = counts > 0
        level = levels(np.frombuffer(_filter(keys[seen], counts[seen]), np.uint8), keys)[place]
        del keys, counts, seen, place
        _, n, place = _summed(tokens, [_unpacked(r[4], np.uint32) for r in asked])
        count, distinct, total = n[place], int((n > 0).sum()), int(n.sum())
        of_pair, of_token = (np.cumsum([0, *map(len, x)]) for x in (pairs, tokens))
        rows, size = [], 0
        for k, (block, *_) in enumerate(asked):
            rows.append((block, s, _packed(level[of_pair[k] : of_pair[k + 1]]), _packed(count[of_token[k] : of_token[k + 1]]), 0 if k else distinct, 0 if k else total))
            size += len(rows[-1][2]) + len(rows[-1][3])
            if size > BATCH_BYTES or k == len(asked) - 1:
                yield _rows(rows, **kinds)
                rows, size = [], 0


def levels(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Quantised count of each key: how many levels in a row pass all their probes."""
    n = len(bits) * 8
    out = np.zeros(len(keys), np.uint8)
    at, level = np.arange(len(keys)), 1
    while len(at):
        own = keys[at]
        for i in range(PROBES):
            p = _place(own, level, i, n)
            hit = (bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
            at, own = at[hit], own[hit]
        out[at] = level
        level += 1
    return out


def least(level: np.ndarray) -> np.ndarray:
    """The least count of a level, 0 for none."""
    return np.where(level == 0, 0.0, np.exp2(level.astype(np.float64) - 1))


def probabilities(level: np.ndarray, before: np.ndarray, after: np.ndarray, total: int, distinct: int) -> np.ndarray:
    """P(w | u) by the level of each bigram and the counts of its two tokens."""
    p = (after + 0.1) / (total + 0.1 * (distinct + 1))
    m = np.minimum(least(level), np.minimum(before, after))
    return (m + MU * p) / (before + MU + (distinct + 1) / 2.0**PROBES)


def _score(segments: int, total: int, distinct: int):
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    floor = total + 0.1 * (distinct + 1)

    def done(own: dict, answers: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        block = Read(own["numbers"], own["words"], own["lengths"])
        level, counts = np.empty(len(block.keys), np.uint8), np.empty(len(block.hashes), np.int64)
        of_pair, of_token = block.orders(segments)
        answers.sort()
        level[of_pair] = np.concatenate([_unpacked(a[1], np.uint8) for a in answers])
        counts[of_token] = np.concatenate([_unpacked(a[2], np.int64) for a in answers])
        found = level[block.place]
        c, u = counts[block.after].astype(np.float64), counts[block.before].astype(np.float64)
        starts = np.concatenate(([0], np.cumsum(block.lengths)[:-1]))
        base = np.add.reduceat(np.log10((c + 0.1) / floor), starts)
        score = np.add.reduceat(np.log10(probabilities(found, u, c, total, distinct)), starts)
        n_known = np.add.reduceat((c > 0).astype(np.int64), starts)
        columns = (own["ids"], own["flags"], block.lengths, n_known, [total] * len(starts), base, score)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, dict] = {}
        answers: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["numbers"] is None:
                    answers.setdefault(r["block"], []).append((r["segment"], r["levels"], r["counts"]))
                else:
                    blocks[r["block"]] = r
        for number in sorted(blocks):
            yield done(blocks.pop(number), answers.pop(number))

    return run


def score(docs: DataFrame, held_out: Column, segment_bytes: int = SEGMENT_BYTES, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learned from rows not held out. It acts: blocks
    and answers are written, and sums read."""
    rows = modest_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held_out"))
    # A token has at least two bytes with the white space after it, mostly six; a counted bigram takes 12 bytes.
    size = rows.where(~F.col("held_out")).agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    segments = 1 + 2 * size // segment_bytes
    blocks = saved(rows.mapInArrow(tidily(_read(block_tokens)), _BLOCK), "lm-blocks")
    number = max(1, blocks.count())
    asked = blocks.mapInArrow(tidily(_asked(segments)), "block long, segment int, pairs binary, pair_counts binary, tokens binary, token_counts binary")
    answers = saved(asked.repartition(4 * segments, "segment").mapInArrow(tidily(_answered), "block long, segment int, levels binary, counts binary, distinct long, total long"), "lm-answers")
    total, distinct = (int(x or 0) for x in answers.agg(F.sum("total"), F.sum("distinct")).collect()[0])
    met = blocks.unionByName(answers.drop("distinct", "total"), allowMissingColumns=True).repartition(number, "block")
    return met.mapInArrow(tidily(_score(segments, total, distinct)), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
