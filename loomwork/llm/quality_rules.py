"""Quality rules for whole texts (op 8): a few counting rules, and a log-likelihood ratio of hashed n-grams.

Two multinomials over hashed word unigrams and bigrams are estimated from whole tables: one from the trusted documents, one from the raw
corpus. A document's value is the mean over its n-grams of log P(trusted) - log P(raw). Trusted documents whose id has an even crc32 are
left out of training, and so look like any other clean document; the threshold is set at run time such that ``KEEP`` of them are kept, at
any size of the tables. Nothing is drawn at random, so equal texts get equal verdicts.

Null text: no words, which fails the base rules. Repeated rows: each is judged (and counted in the corpus). Ties at the threshold are kept.
Long texts: one array of word hashes. Empty table: no rows. No trusted document left to train on, or none to set the threshold by: the base rules alone decide. Columns are read by name and renamed before any
join, so others cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WordHashes, mixed, modest_batches, slices, tidily, windows

BUCKETS = 1 << 16
#: Pseudo-counts shared among the buckets, as a share of the trusted counts: a bucket's trusted probability is drawn to its raw one by so much.
PRIOR = 0.25
#: Share of the trusted documents left out of training that the threshold keeps.
KEEP = 0.99
#: Up to so many trusted ids are broadcast (8 bytes each); beyond, ids and documents are joined by a shuffle.
BROADCAST_IDS = 4_000_000

_SPACE = b" \t\n\x0b\x0c\r"
_CONTINUED = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_HASHES = WordHashes()


def buckets(h: np.ndarray) -> np.ndarray:
    """Buckets of the unigrams and bigrams of a text's word hashes."""
    pairs = mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] + np.uint64(1))
    return (np.concatenate((mixed(h), pairs)) % np.uint64(BUCKETS)).astype(np.int64)


def repeated_words(h: np.ndarray, n: int = 5) -> int:
    """Words inside runs of ``n`` words that the text has twice or more."""
    w = windows(h, n)
    if len(w) < 2:
        return 0
    order = np.argsort(w, kind="stable")
    same = w[order][1:] == w[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(h) + 1, np.int64)
    at = np.unique(np.concatenate((order[1:][same], order[:-1][same])))
    np.add.at(twice, at, 1)
    np.add.at(twice, at + n, -1)
    return int((np.cumsum(twice) > 0).sum())


def repeated_lines(text: bytes) -> int:
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line.strip(_SPACE):
            if line in seen:
                n += 1
            seen.add(line)
    return n


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = np.zeros((2, BUCKETS), np.int64)
    for batch in slices(batches):
        for text, trusted in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("trusted").to_pylist(), strict=True):
            if text and (words := text.split()):
                n = np.bincount(buckets(_HASHES.of(words)), minlength=BUCKETS)
                held[0] += n
                if trusted:
                    held[1] += n
    at = np.flatnonzero(held[0])
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[0][at]), pa.array(held[1][at])], names=["bucket", "raw", "target"])


def trusted_flag(docs: DataFrame, trusted: DataFrame, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """(text, trusted, held_out) of ``docs``; ``trusted`` has the ids in a column doc_id, in any number of rows. ``held_out`` are those
    trusted documents that ``threshold`` is to be set by."""
    ids = trusted.select(F.col("doc_id").cast("long").alias("t_id")).where("t_id is not null").distinct()
    small = ids.limit(broadcast_ids + 1).count() <= broadcast_ids
    rows = modest_batches(docs).select(F.col("doc_id").cast("long").alias("d_id"), F.col("text").cast("string").alias("text"))
    found = F.col("t_id").isNotNull()
    return rows.join(F.broadcast(ids) if small else ids, F.col("d_id") == F.col("t_id"), "left").select("text", found.alias("trusted"), (found & (F.crc32(F.col("t_id").cast("string")) % 2 == 0)).alias("held_out"))


def train(flagged: DataFrame) -> np.ndarray:
    """log P(trusted) - log P(raw) by bucket, from all rows of (text, trusted). At most ``BUCKETS`` rows reach the driver."""
    flagged = flagged.select("text", "trusted")
    n = flagged.mapInArrow(tidily(_counts), "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.ones(BUCKETS), np.zeros(BUCKETS)
    at = n["bucket"].to_numpy(np.int64)
    raw[at] += n["raw"].to_numpy(np.float64)
    target[at] += n["target"].to_numpy(np.float64)
    p = raw / raw.sum()
    if not target.any():
        return np.zeros(BUCKETS, np.float32)
    prior = PRIOR * target.sum()
    return (np.log((target + prior * p) / (target.sum() + prior)) - np.log(p)).astype(np.float32)


def _judge(weights: np.ndarray, threshold: float):
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio")
    types = (pa.int64(), *[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                text = text or b""
                words = text.split()
                h = _HASHES.of(words)
                chars = len(text.translate(None, _SPACE + _CONTINUED))
                repeats = repeated_words(h)
                failed = len(words) < 10 or 100 * repeats > 20 * len(words)
                ratio = float(weights[buckets(h)].mean(dtype=np.float64)) if words else 0.0
                rows.append((doc_id, len(words), chars, len(text) - len(text.translate(None, _SYMBOLS)), repeated_lines(text), repeats, failed, not failed and ratio >= threshold, ratio))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))

    return run


def judge(docs: DataFrame, weights: np.ndarray, threshold: float = 0.0) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ratio. Kept is what passes the
    base rules and has a mean log-likelihood ratio an n-gram of ``threshold`` or more."""
    rows = modest_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidily(_judge(weights, threshold)), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double")


def threshold(held_out: DataFrame, weights: np.ndarray) -> float:
    """The ratio from which on ``KEEP`` of the rows of (text) that pass the base rules are kept; minus infinity where there are none. The
    rows' ratios are summed up by a histogram of 0.001, cut downwards, of which at most some ten thousand rows reach the driver."""
    judged = judge(held_out.select(F.lit(None).cast("long").alias("doc_id"), "text"), weights)
    n = judged.where("not base_failed").groupBy(F.floor(F.col("ratio") * 1000).alias("at")).count().orderBy("at").collect()
    spare = sum(r["count"] for r in n) * (1 - KEEP)
    for r in n:
        spare -= r["count"]
        if spare < 0:
            return r["at"] / 1000
    return -np.inf


def verdicts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """``judge`` of ``docs`` with weights from the trusted documents in training and the threshold from those left out."""
    flagged = trusted_flag(docs, trusted)
    weights = train(flagged.withColumn("trusted", F.col("trusted") & ~F.col("held_out")))
    return judge(docs, weights, threshold(flagged.where("held_out"), weights))
