"""Best-fit packing of tokenised documents into sequences of fixed capacity (op 9).

Every document becomes its token ids followed by an end id. Longer ones are cut into pieces of ``capacity`` ids, of which the last may
be shorter. Only the histogram of piece lengths, at most ``capacity`` rows, reaches the driver. There best-fit decreasing runs over
counts: a group of equal bins takes many pieces of one length at once. The plan is a list of (length, rank range) -> (sequence range,
offset); a piece takes its slot by its rank within its length. Ranks are counted inside groups of bounded size, so that a length which
a third of all pieces share is spread over many tasks.

Null or empty text: a piece of the end id alone. Repeated rows: each is packed; equal pieces are one row with a count until they get their
slots. Ties: pieces of one length are ranked by id, piece and content. Long texts: encoded whole, then cut. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import modest_batches, numbered, saved, slices, tidily

CAPACITY = 2048
#: Pieces of one length that are ranked together in a task, as long as that makes no more than so many sets.
RANKED_TOGETHER, MOST_DEALS = 250, 100_000
#: Entries of a task's memory of words.
REMEMBERED = 400_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Texts that tokenizers of other rules (case, splitting, white space, marks of words) encode otherwise.
PROBE = ("Hello, WORLD!! |x| a1b2 3.14", "it's 'S don't I'LL x'sy", "½²³ ªº µß ſ ŉ é á", "tab\tand\nline  two spaces ", "", " ", "under_score e-mail http://a.b/c?d=1", "Éèê çà ñandú übergroß naïve", "aaaaaaaaaaaaaaaaaaaa zzzz 1234567890", "(a)[b]{c}<d>;:'\"#$%^&*+=~`")


class Encoder:
    """Token ids of whole texts, as packed little-endian unsigned 32-bit integers.

    The tokenizer encodes each stretch that its pre-tokenizer splits off by itself, and no stretch crosses white space. For texts of
    characters whose splitting is plain (below U+0250, without control characters, special tokens or U+0130), words and stretches are
    found here and each new word is encoded once; other texts go through the tokenizer whole. At the start both ways are compared on
    ``PROBE``: a tokenizer of other rules is used whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: The same vocabulary for stretches that are lower-cased, composed and split already.
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        #: Whether a token ends a stretch.
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for w, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if w.endswith(self.tokenizer.model.end_of_word_suffix)]] = True
        self.words: dict[str, bytes] = {}
        self.plain = regex.compile(r"[\n\r\t\x20-\x7E\xA1-\u012F\u0131-\u024F]*+")
        self.alike = True
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        try:
            self.alike = self.encode(list(PROBE)) == [self.whole(t) for t in PROBE]
        except (IndexError, KeyError, ValueError):
            self.alike = False
        self.words.clear()

    def _learn(self, new: set[str]) -> None:
        # Most words are letters alone, or letters and one other character, which are two stretches.
        ended = [w for w in new if w[-1] in ".,!|" and w[:-1].isalpha()]
        odd = [w for w in new.difference(ended) if not w.isalpha()]
        stems = new.difference(ended, odd)
        stems.update(w[:-1] for w in ended)
        stems.update(".,!|")
        stems = stems.difference(self.words)
        apart = [self.split(w) for w in odd]
        self._encode([*stems, *odd], [*stems, *map(" ".join, apart)], [1] * len(stems) + [len(x) for x in apart])
        get = self.words.__getitem__
        self.words.update([(w, get(w[:-1]) + get(w[-1])) for w in ended])

    def _encode(self, words: list[str], apart: list[str], stretches: list[int]) -> None:
        """``apart``: the words with spaces between their stretches."""
        cuts = range(0, len(words), 1000)
        for i, e in zip(cuts, self.bare.encode_batch_fast([" ".join(apart[i : i + 1000]) for i in cuts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self.last[ids])[np.cumsum(stretches[i : i + 1000]) - 1]
            at = [0, *(4 * ends + 4).tolist()]
            ids = ids.tobytes()
            self.words.update([(w, ids[a:b]) for w, a, b in zip(words[i : i + 1000], at, at[1:], strict=False)])

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > REMEMBERED:
            self.words.clear()
        if not self.alike:
            return [self.whole(t) for t in texts]
        found = [t.lower().split() if "<|" not in t and self.plain.fullmatch(t) else None for t in texts]
        self._learn(set().union(*filter(None, found)).difference(self.words))
        get = self.words.__getitem__
        return [b"".join(map(get, words)) if words is not None else self.whole(t) for t, words in zip(texts, found, strict=True)]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_ENCODERS: dict[str, Encoder] = {}


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gc
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(path))
        end = end_id.to_bytes(4, "little")
        gc.disable()  # the memory of words has no cycles, and is large to search for them
        try:
            for batch in slices(batches, 500, 2_000_000):
                rows = []
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        finally:
            gc.enable()
            encoder.words.clear()  # most words are met once; the worker may serve other stages next

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    return modest_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidily(_pieces(tokenizer, capacity, end_id)), PIECES)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts. Rows (length, first rank, end rank, first sequence, offset, pieces a bin): the piece of rank r
    goes to sequence ``first sequence + (r - first rank) // pieces a bin``, at ``offset + (r - first rank) % pieces a bin * length``.

    Of the bins with room, one with the least room is filled as far as it takes this length, as best-fit does piece by piece. The work
    and the plan depend on the number of lengths, not of pieces.
    """
    rows, sequences = [], 0
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> (first sequence, bins)
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        for r in sorted(k for k in room if k >= length):
            groups, q = room.pop(r), r // length
            kept = []
            for first, bins in groups:
                full = min(bins, left // q)
                if full:
                    rows.append((length, rank, rank + full * q, first, capacity - r, q))
                    room.setdefault(r - q * length, []).append((first, full))
                    rank, left = rank + full * q, left - full * q
                if full < bins and 0 < left < q:
                    rows.append((length, rank, rank + left, first + full, capacity - r, q))
                    room.setdefault(r - left * length, []).append((first + full, 1))
                    full, rank, left = full + 1, rank + left, 0
                if full < bins:
                    kept.append((first + full, bins - full))
            if kept:
                room.setdefault(r, []).extend(kept)
            if not left:
                break
        if left:
            q = capacity // length
            full = left // q
            if full:
                rows.append((length, rank, rank + full * q, sequences, 0, q))
                room.setdefault(capacity - q * length, []).append((sequences, full))
                rank, left, sequences = rank + full * q, left - full * q, sequences + full
            if left:
                rows.append((length, rank, rank + left, sequences, 0, q))
                room.setdefault(capacity - left * length, []).append((sequences, 1))
                sequences += 1
        room.pop(0, None)
    return rows


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, ranked_together: int = RANKED_TOGETHER) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = saved(pieces(docs, tokenizer, capacity, end_id), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    planned = spark.createDataFrame(
        plan(histogram, capacity),
        T.StructType([T.StructField(n, T.LongType()) for n in ("p_length", "first_rank", "end_rank", "first_sequence", "first_offset", "per_bin")]),
    )
    ranked = numbered(cut, "length", ["doc_id", "piece", "ids_crc32", "start"], ranked_together, MOST_DEALS).withColumnRenamed("number", "rank")
    placed = ranked.join(F.broadcast(planned), (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank"))).withColumn("k", F.col("rank") - F.col("first_rank"))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.floor(F.col("k") / F.col("per_bin"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + (F.col("k") % F.col("per_bin")) * F.col("length")).cast("long").alias("offset"),
    )
