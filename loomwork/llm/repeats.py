"""What substring dedup and line dedup share: spans of texts that occur again elsewhere, and texts without them.

Rows of one id and one text cannot be told apart: they are one document with a number of copies, of which the first is the earliest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bounded, hot, modest_batches, saved, slices, split_join, tidily, unfolded, unused

Spans = Callable[[str], Iterable[tuple[int, int]]]


def md5_of(text: str = "text") -> Column:
    return F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, text_md5), text null as null."""
    return modest_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), md5_of().alias("text_md5"))


def folded(docs: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, text, text_md5, copies), one row for all rows of an id and a text, and the greatest number of copies. Only ids and digests are
    shuffled, and the texts of rows that are repeated."""
    rows = keyed(docs)
    twice = saved(rows.groupBy(F.col("doc_id").alias("t_id"), F.col("text_md5").alias("t_md5")).agg(F.count("*").alias("n")).where("n > 1"), "repeated-rows")
    most = twice.agg(F.max("n")).head()[0]
    if most is None:
        return rows.withColumn("copies", F.lit(1).cast("long")), 1
    twice = bounded(twice.drop("n"))
    same = F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("text_md5") == F.col("t_md5"))
    again = rows.join(twice, same, "left_semi").groupBy("doc_id", "text_md5").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    return rows.join(twice, same, "left_anti").withColumn("copies", F.lit(1).cast("long")).union(again.select("doc_id", "text", "text_md5", "copies")), most


def occurrences(units: DataFrame, by: tuple[str, ...] = ("digest",), scratch: list[DataFrame] | None = None) -> DataFrame:
    """Rows of ``units`` (doc_id, text_md5, start, ``by``..., others) whose ``by`` occurs twice or more, with first_doc_id, first_start,
    copies and ``again``: whether the first occurrence is another one (smallest doc_id, null first, then text_md5, then start). ``units`` is
    saved. Partial aggregation meets hot groups before the shuffle; their first places are broadcast. ``scratch`` gets the tables written."""
    own = F.struct("doc_id", "text_md5", "start")
    first = units.groupBy(*by).agg(F.min(own).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    first = saved(first.select(*(F.col(c).alias(f"f_{c}") for c in by), "first", "copies"), "firsts")
    scratch is None or scratch.append(first)
    same = [F.col(c) == F.col(f"f_{c}") for c in by]
    held = split_join(units, first, same, hot(F.col("copies"), units.count()), row_bytes=200)
    return held.select(*units.columns, F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start"), "copies", (~own.eqNullSafe(F.col("first"))).alias("again"))


def with_spans(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text_md5, others) and ``spans``: the places of ``found`` (doc_id, text_md5, start, end, digest, again), null where
    there are none. Spans grow with the corpus, so both sides are shuffled at any size. A row of ``rows`` an id and digest: no key is hot."""
    by_doc = found.groupBy(F.col("doc_id").alias("s_id"), F.col("text_md5").alias("s_md5")).agg(F.collect_list(F.struct("start", "end", "digest", "again")).alias("spans"))
    return rows.join(by_doc.hint("merge"), F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("text_md5") == F.col("s_md5")), "left").drop("s_id", "s_md5")


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


KEPT = "doc_id long, n_units long, n_removed long, n_words long, removed_words long, longest_run_words long, kept_spans string, removed_spans string, text string"


def summary(text: str | None, gone: list[tuple[int, int]], pieces: Spans) -> tuple:
    """The columns of ``KEPT`` after doc_id, of a text whose pieces within the spans ``gone`` go, each with the white space after it."""
    if text is None:
        return 0, 0, 0, 0, 0, "", "", None
    all_ = [(a, b, n) for a, b in pieces(text) if (n := len(text[a:b].encode().split()))]
    if not all_:
        return 0, 0, 0, 0, 0, "", "", text
    k, runs, parts = 0, [], [text[: all_[0][0]]]  # runs: removed or not, start, end, words
    gone = merged(gone)
    for i, (a, b, n) in enumerate(all_):
        while k < len(gone) and gone[k][1] <= a:
            k += 1
        removed = k < len(gone) and gone[k][0] <= a
        if runs and runs[-1][0] == removed:
            runs[-1] = (removed, runs[-1][1], b, runs[-1][3] + n, runs[-1][4] + 1)
        else:
            runs.append((removed, a, b, n, 1))
        if not removed:
            parts.append(text[a : all_[i + 1][0] if i + 1 < len(all_) else len(text)])
    out = [r for r in runs if r[0]]
    spans = [",".join(f"{r[1]}:{r[2]}" for r in runs if r[0] == which) for which in (False, True)]
    return len(all_), sum(r[4] for r in out), sum(r[3] for r in runs), sum(r[3] for r in out), max((r[3] for r in out), default=0), *spans, "".join(parts)


def _kept(pieces: Spans, all_spans: Spans):
    kinds = [pa.int64()] * 6 + [pa.string()] * 3 + [pa.int64()]
    names = [f.split()[0] for f in KEPT.split(", ")] + ["times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc_id, text, copies, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "copies", "spans")), strict=True):
                rows.append((doc_id, *summary(text, [(s["start"], s["end"]) for s in spans or () if s["again"]], pieces), 1))
                if copies > 1:
                    rows.append((doc_id, *summary(text, list(all_spans(text or "")), pieces), copies - 1))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def kept(rows: DataFrame, most: int, pieces: Spans, all_spans: Spans) -> DataFrame:
    """One row per document, of ``rows`` (doc_id, text, copies, spans) with at most ``most`` copies: the columns of ``KEPT``. A further copy of a row loses
    ``all_spans`` of its text. n_units and n_removed count pieces with a word; kept_spans and removed_spans are the stretches of adjacent
    pieces that stay or go, as start:end in code points of the original text, comma-joined; text is what stays."""
    out = rows.select("doc_id", "text", "copies", "spans").mapInArrow(tidily(_kept(pieces, all_spans)), f"{KEPT}, times long")
    return unfolded(out, "times", most).drop("at")


def _cut(names: list[str], whole: Fraction):
    def places(text: str, spans: list | None) -> list[tuple[int, int]]:
        gone = merged((s["start"], s["end"]) for s in spans or () if s["again"])
        if not gone or whole >= 1:
            return gone
        lost, all_ = (sum(len(x.encode().split()) for x in xs) for xs in ((text[a:b] for a, b in gone), (text,)))
        return [] if whole * all_ <= lost < all_ else gone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, sizes, cut = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                gone = places(text or "", spans)
                left, at = [], 0
                for a, b in gone:
                    left.append(text[at:a])
                    at = b + (text[b : b + 1] == "\n")
                text = "".join(left) + text[at:] if gone else text
                cut.append(bool(gone) and not text.strip(" \n\r\t\x0b\x0c"))
                texts.append(text)
                sizes.append(len(text) if gone else None)
            own = {"text": pa.array(texts, pa.string()), "n_chars": pa.array(sizes, pa.int64()), "cut": pa.array(cut, pa.bool_())}
            yield pa.RecordBatch.from_arrays([own.get(n, batch.column(n) if n in batch.schema.names else None) for n in names], names=names)

    return run


def _once(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text, text_md5, others), one of those with an id and a text that is not blank. Only ids and digests are shuffled, and
    rows that are repeated."""
    keys = rows.where(F.col("text").rlike(r"\S")).groupBy(F.col("doc_id").alias("t_id"), F.col("text_md5").alias("t_md5"))
    twice = saved(keys.agg(F.count("*").alias("n")).where("n > 1").drop("n"), "repeated-rows")
    if twice.isEmpty():
        return rows
    twice = bounded(twice)
    same = F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("text_md5") == F.col("t_md5"))
    return rows.join(twice, same, "left_anti").union(rows.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text_md5"]))


def without(docs: DataFrame, marked: Callable[[DataFrame], DataFrame], whole: Fraction = Fraction(1)) -> DataFrame:
    """``docs`` with the spans cut out of their texts that ``marked`` adds to rows (doc_id, text_md5, text, others), each with the line end
    after it. n_chars, where there is one, follows a text that is cut. Documents of which nothing but white space is left by the cuts go. Those
    that would lose the share ``whole`` of their words or more, but not all, stay as they are: they are copies as a whole, if anything. Of
    repeated rows (same id and text, not blank) one stays."""
    columns = docs.columns
    hidden = ["text" if c == "text" else f"_{i}" for i, c in enumerate(columns)]
    rows = modest_batches(docs).withColumn("text", F.col("text").cast("string"))
    rows = rows.select(*(F.col(c).alias(h) for c, h in zip(columns, hidden, strict=True)), F.col("doc_id").cast("long").alias("doc_id"), md5_of().alias("text_md5"))
    rows = marked(_once(rows)).drop("doc_id", "text_md5")
    any_ = F.exists(F.coalesce("spans", F.array().cast(rows.schema["spans"].dataType)), lambda s: s["again"])
    kinds = {f.name: f for f in rows.schema.fields}
    names = [*hidden, "n_chars", "cut"]
    schema = T.StructType([T.StructField(n, T.LongType() if n == "n_chars" else T.BooleanType()) if n in ("n_chars", "cut") else kinds[n] for n in names])
    changed = rows.where(any_).mapInArrow(tidily(_cut(names, whole)), schema).where(~F.col("cut"))
    own = [F.coalesce(F.col("n_chars").cast(kinds[h].dataType), F.col(h)).alias(h) if c == "n_chars" else F.col(h) for c, h in zip(columns, hidden, strict=True)]
    return rows.where(~any_).select(*hidden).union(changed.select(*own)).toDF(*columns)


