"""Removal of repeated multi-line passages (op 10).

Lines are cut into chunks: a hash rolls over the last ``window`` line hashes and ends a chunk wherever it is 0 modulo ``divisor``, so that
insertions shift boundaries no further than the next one. ``repeated_chunks`` takes them alone, and misses passages that hold no two
boundaries. ``repeated_passages`` finds every stretch of two or more adjacent lines, and every long line, that an earlier place has: chunks
of the densest kind, where each two adjacent lines that are not blank (with blank ones between) are one, and so is each line of
``LONG_WORDS`` words or more. A passage of k lines repeats just where its k - 1 windows do. Of the sparser chunks it adds those that begin
or end with a blank line; all others are unions of such windows.

What has a 128-bit digest that occurs elsewhere is read again and compared by its bytes: a task compares its own, and ships what it has met
once a digest; of a digest whose bytes differ, the bytes themselves are grouped. The earliest occurrence stays (smallest doc_id, null first,
then the text's digest, then start), the rest go; spans of one text may overlap.

Null and empty texts have no chunks; chunks of white space are left. Of repeated rows (same id and text) the first is the earliest, the
others lose all passages they have. Ties cannot be: places differ. Long texts are one Arrow batch each. Empty table: no rows. Only doc_id
and text are read; further columns of ``without_passages`` are renamed meanwhile, so that none can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .repeats import folded, kept, keyed, merged, occurrences, with_spans
from .shared import bounded, dropped, mixed, saved, slices, tidily

WINDOW = 2
DIVISOR = 3
MIN_LINES = 2
#: A line of so many words is a passage of its own.
LONG_WORDS = 50

#: Bytes of chunks that a task remembers at once, to compare others with.
REMEMBERED = 32_000_000
#: A base of the rolling hash: odd, so that no bit of an older line is lost but by rolling out.
BASE = 0x9E3779B97F4A7C15

_CHUNKS = "doc_id long, text_md5 string, start long, end long, digest binary"

Cut = Callable[[str], Iterator[tuple[int, int, int]]]


def boundaries(lines: list[str], window: int = WINDOW, divisor: int = DIVISOR) -> list[int]:
    """Line numbers after which a chunk ends; the last line always ends one. The first ``window - 1`` lines see a shorter window."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(x.encode()) for x in lines), np.uint64, len(lines))
    # A polynomial in BASE: a step multiplies by it, adds the next line's hash and takes off the one that leaves the window.
    leaving = np.uint64(pow(BASE, window, 1 << 64))
    rolled, now = np.empty(len(h), np.uint64), 0
    gone = np.concatenate((np.zeros(min(window, len(h)), np.uint64), h[: max(0, len(h) - window)] * leaving))
    for k, (new, old) in enumerate(zip(h.tolist(), gone.tolist(), strict=True)):
        now = (now * BASE + new - old) & 0xFFFFFFFFFFFFFFFF
        rolled[k] = now
    ends = np.flatnonzero(mixed(rolled) % np.uint64(divisor) == 0).tolist()
    return ends if ends and ends[-1] == len(lines) - 1 else [*ends, len(lines) - 1]


def chunks(text: str, window: int, divisor: int, min_lines: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, lines) of a text's multi-line chunks, in code points; the last line's end is not part of it."""
    lines = text.split("\n")
    at, first = 0, 0
    for last in boundaries(lines, window, divisor):
        size = sum(map(len, lines[first : last + 1])) + last - first
        if last - first + 1 >= min_lines and text[at : at + size].strip():
            yield at, at + size, last - first + 1
        at, first = at + size + 1, last + 1


def passages(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, lines) of a text's windows of two lines that are not blank, its long lines, and its chunks with a blank line first or last."""
    lines = text.split("\n")
    at, before = 0, None  # start and number of the last line that is not blank
    for k, line in enumerate(lines):
        if line.strip():
            if before:
                yield before[0], at + len(line), k - before[1] + 1
            if len(line) >= 2 * LONG_WORDS - 1 and len(line.split()) >= LONG_WORDS:
                yield at, at + len(line), 1
            before = at, k
        at += len(line) + 1
    for a, b, n in chunks(text, WINDOW, DIVISOR, MIN_LINES) if any(not x.strip() for x in lines) else ():
        if not (text[a:b].split("\n", 1)[0].strip() and text[a:b].rsplit("\n", 1)[-1].strip()):
            yield a, b, n


def _digest(chunk: str) -> bytes:
    return hashlib.md5(chunk.encode()).digest()


def _digests(cut: Cut, digest: Callable[[str], bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc_id, text, key in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "text_md5")), strict=True):
                rows += [(doc_id, key, a, b, digest(text[a:b])) for a, b, _ in cut(text or "")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "text_md5", "start", "end", "digest"])

    return run


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, chunk): each chunk of the spans, but for those that the task knows and finds equal."""
    known, held = {}, 0
    for batch in slices(batches):
        new = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            for s in spans:
                chunk = text[s["start"] : s["end"]].encode()
                if known.get(s["digest"]) != chunk:
                    new.append((s["digest"], chunk))
                    if s["digest"] not in known:
                        known[s["digest"]] = chunk
                        held += len(chunk)
        if held > REMEMBERED:
            known, held = {}, 0
        if new:
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in new], pa.binary()), pa.array([c for _, c in new], pa.binary())], names=["digest", "chunk"])


def _places(digests: set[bytes]):
    """(doc_id, text_md5, start, end, digest, chunk) of the spans with one of the digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc_id, key, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_md5", "text", "spans")), strict=True):
                rows += [(doc_id, key, s["start"], s["end"], s["digest"], text[s["start"] : s["end"]].encode()) for s in spans if s["digest"] in digests]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["doc_id", "text_md5", "start", "end", "digest", "chunk"])

    return run


#: Digests of differing bytes that are known to workers by value. There are none but by design: md5 has to be attacked for one.
FORGED = 1_000


def with_repeats(rows: DataFrame, cut: Cut, digest: Callable[[str], bytes] = _digest) -> DataFrame:
    """``rows`` (doc_id, text_md5, text, others; one a key) with ``spans``: their chunks that occur twice or more, ``again`` where an earlier
    place has the same bytes. Rows are shuffled once and saved."""
    scratch = [chunks_ := saved(rows.select("doc_id", "text", "text_md5").mapInArrow(tidily(_digests(cut, digest)), _CHUNKS), "chunks")]
    out = saved(with_spans(rows, occurrences(chunks_, scratch=scratch).select("doc_id", "text_md5", "start", "end", "digest", "again")), "with-spans", "zstd")
    for t in scratch:
        dropped(t)
    met = out.where("spans is not null")
    differ = met.select("text", "spans").mapInArrow(tidily(_bytes), "digest binary, chunk binary").groupBy("digest").agg(F.min("chunk").alias("least"), F.max("chunk").alias("most")).where("least <> most")
    forged = saved(differ.select("digest"), "forged")
    if forged.isEmpty():
        return out
    if forged.count() <= FORGED:
        digests = {bytes(r["digest"]) for r in forged.collect()}
        places = met.select("doc_id", "text_md5", "text", "spans").mapInArrow(tidily(_places(digests)), f"{_CHUNKS}, chunk binary")
    else:
        every = met.select("doc_id", "text_md5", "text", F.explode("spans").alias("s")).join(bounded(forged.withColumnRenamed("digest", "f_digest")), F.col("s.digest") == F.col("f_digest"), "left_semi")
        places = every.select("doc_id", "text_md5", "s.start", "s.end", "s.digest", F.encode(F.expr("substring(text, int(s.start) + 1, int(s.end - s.start))"), "utf-8").alias("chunk"))
    exact = occurrences(saved(places, "places"), ("digest", "chunk")).where("again").select("doc_id", "text_md5", "start", "end", "digest", "again")
    others = met.select("doc_id", "text_md5", F.explode("spans").alias("s")).select("doc_id", "text_md5", "s.*").where("again")
    others = others.join(bounded(forged.withColumnRenamed("digest", "f_digest")), F.col("digest") == F.col("f_digest"), "left_anti")
    return with_spans(out.drop("spans"), others.union(exact))


def _removed(docs: DataFrame, cut: Cut, digest: Callable[[str], bytes] = _digest) -> DataFrame:
    rows = keyed(docs).dropDuplicates(["doc_id", "text_md5"])
    return with_repeats(rows, cut, digest).select("doc_id", "text_md5", F.explode("spans").alias("s")).where("s.again").select("doc_id", "text_md5", "s.start", "s.end", "s.digest")


def repeated_chunks(docs: DataFrame, window: int = WINDOW, divisor: int = DIVISOR, min_lines: int = MIN_LINES) -> DataFrame:
    """One row per chunk that goes: doc_id, text_md5, start, end (code points, end exclusive), digest. Repeated rows are one here."""
    return _removed(docs, lambda text: chunks(text, window, divisor, min_lines))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """As ``repeated_chunks``, of all ``passages``: one row per window, long line or chunk that an earlier place has. Their union goes."""
    return _removed(docs, passages)


def lines(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for line in text.split("\n"):
        yield at, at + len(line)
        at += len(line) + 1


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, what stays (text, kept_spans) and what goes (removed_spans), as ``repeats.kept`` has them; its pieces are
    lines."""
    rows, most = folded(docs)
    return kept(with_repeats(rows, passages), most, lines, lambda text: merged((a, b) for a, b, _ in passages(text)))


def passages_or_all(text: str) -> Iterator[tuple[int, int, int]]:
    """``passages``, or all of a text that has none."""
    found = False
    for found in passages(text):
        yield found
    if not found and text.strip():
        yield 0, len(text), text.count("\n") + 1


def without_passages(docs: DataFrame, whole: Fraction = Fraction(1)) -> DataFrame:
    """``docs`` without their repeated passages; of repeated rows one stays. With ``whole`` below 1 documents are judged as a whole too: those
    without passages go where they equal an earlier one, and those that would lose that share of their words or more, but not all, stay as
    they are."""
    return repeats.without(docs, lambda rows: with_repeats(rows, passages if whole >= 1 else passages_or_all), whole)
