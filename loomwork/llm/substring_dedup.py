"""Removal of repeated lines or paragraphs (op 1).

A text is cut into units: its lines, or its paragraphs (stretches between blank lines). Since a repeated passage may begin and end within
lines, the text's clauses, whatever the lines, are cut into chunks that are units besides lines: a chunk ends with each clause of
``CLAUSE_WORDS`` words or more, and with shorter ones whose hash is even, so that equal passages are cut alike from their first such clause on.
Chunks of fewer than ``CHUNK_WORDS`` words repeat by chance, and are none. A clause ends at a line's end, or at a space after one of
``.!?,;:``. Each unit is normalised (A-Z lower-cased, white space squeezed) and hashed; digests are grouped over the whole corpus. Of each
group the earliest occurrence stays (smallest doc_id, null first, then the text's digest, then start); the clauses of the others are
removed. What goes has stood earlier, so the first occurrence of every clause stays.

Null and empty texts have no units. Of repeated rows (same id and text) the first is the earliest, the others lose all they have. Ties
cannot be: places differ. Long texts are one Arrow batch each. Empty table: no rows. Only doc_id and text are read, so other columns cannot
clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import folded, kept, occurrences, with_spans
from .shared import dropped, saved, slices, tidily

MIN_WORDS = 1
CLAUSE_WORDS, CHUNK_WORDS = 6, 5

_PARAGRAPH = re.compile(r"[^\n]+(?:\n(?![\x20\x09-\x0D]*(?:\n|\Z))[^\n]+)*")
_UNITS = "doc_id long, text_md5 string, start long, end long, digest binary"


def _pieces(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the clauses of each line, one after another; some are white space."""
    at = 0
    for mark in ".!?,;:":
        text = text.replace(mark + " ", mark + "\n")
    for part in text.split("\n"):
        yield at, at + len(part)
        at += len(part) + 1


def _paragraphs(text: str) -> Iterator[tuple[int, int]]:
    return (m.span() for m in _PARAGRAPH.finditer(text))


def pieces(unit: str):
    """The smallest units of a text, which do not overlap."""
    return _paragraphs if unit == "paragraph" else _pieces


def units(text: str, unit: str = "line", min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, normalised text) of each unit."""
    if unit == "paragraph":
        for a, b in _paragraphs(text):
            words = text[a:b].encode().lower().split()
            if len(words) >= min_words:
                yield a, b, b" ".join(words)
        return
    held, sizes, at, ranges = [], [], 0, set()  # (start, end, words) of the clauses, from all lines
    for line in text.split("\n"):
        first = len(held)
        for a, b in _pieces(line):
            if words := line[a:b].encode().lower().split():
                held.append((at + a, at + b, b" ".join(words)))
                sizes.append(len(words))
        if len(held) > first and sum(sizes[first:]) >= min_words:
            ranges.add((first, len(held) - 1))
        at += len(line) + 1
    first = 0
    for i, n in enumerate(sizes):
        if i == len(sizes) - 1 or n >= CLAUSE_WORDS or not hashlib.md5(held[i][2]).digest()[0] % 2:
            if sum(sizes[first : i + 1]) >= CHUNK_WORDS:
                ranges.add((first, i))
            first = i + 1
    for i, j in sorted(ranges):
        yield held[i][0], held[j][1], held[i][2] if i == j else b" ".join([x[2] for x in held[i : j + 1]])


def _units(unit: str, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc_id, text, key in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "text_md5")), strict=True):
                rows += [(doc_id, key, a, b, hashlib.md5(w).digest()) for a, b, w in units(text or "", unit, min_words)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "text_md5", "start", "end", "digest"])

    return run


def deduplicated(docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: doc_id, what stays (text, kept_spans) and what goes (removed_spans), as ``repeats.kept`` has them. The spans
    are of the original text. Digests are shuffled, and texts once, to meet the spans that go."""
    rows, most = folded(docs)
    scratch = [all_ := saved(rows.select("doc_id", "text", "text_md5").mapInArrow(tidily(_units(unit, min_words)), _UNITS), "units")]
    again = saved(occurrences(all_, scratch=scratch).where("again").select("doc_id", "text_md5", "start", "end", "digest", "again"), "repeated-units")
    for t in scratch:
        dropped(t)
    return kept(with_spans(rows, again), most, pieces(unit), lambda text: ((a, b) for a, b, _ in units(text, unit, min_words)))
