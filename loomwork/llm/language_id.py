"""Language proportions of whole texts by expectation-maximisation (op 3).

A language is a distribution over hashed character trigrams, estimated from all labelled training documents. A document is a mixture: each
of its words (runs of letters) comes from one language, and expectation-maximisation over the words' n-gram likelihoods gives the
languages' proportions. The language set is chosen by penalised likelihood: languages enter in the order of their proportions, each must
raise the log-likelihood by more than half the logarithm of the number of words, plus a constant. The predicted language is the one of the
largest proportion within the set, and that proportion is the score. ``fit`` is the mean log-likelihood of a used character under that
language; that under the whole mixture is what ``in_known_language`` tells texts in none of the languages by, so a text of two known languages
is not one of none.

A text that is null or has no letter, or any text when nothing was learned: ``und``, score 0, fit null. Ties go to the language that sorts first.
Training rows with null text or language are left out. Repeated rows: each is predicted (and counted in training). Empty table: no rows.
Long texts are worked through in blocks of bounded size. The columns read are passed by position, so others cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import mixed, modest_batches, saved, slices, tidily

UNKNOWN = "und"
BUCKETS = 1 << 15
#: Rounds of expectation-maximisation at most, and the change of a proportion below which it has converged.
ROUNDS, STILL = 50, 1e-3
#: What a further language must add to the log-likelihood, besides half the logarithm of the number of words.
ENTRY_COST = 2.0
#: Texts fit worse than this share of the labelled ones, by as much again as those do than the middle one, are in no known language.
OUTLYING = 0.001
#: What the fit of a text of n characters may be worse for being short, times the square root of n.
SHORT = 10.0
#: Characters whose likelihoods are held at once.
BLOCK = 500_000

_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each used position, its word, document of each word) of lower-cased ``texts``.

    Used positions are those of letters and the one after each word; a word's first characters are seen after a word start.
    """
    a = np.frombuffer(("\n".join(t.lower() for t in texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t.lower()) + 1 for t in texts])
    c = np.where(letters()[a], a, 0).astype(np.uint64)
    before = np.concatenate((np.zeros(1, np.uint64), c[:-1]))
    before2 = np.concatenate((np.zeros(2, np.uint64), c[:-2]))[: len(c)]
    before2[before == 0] = 0
    used = np.flatnonzero((c != 0) | (before != 0))
    h = mixed(c[used] | (before[used] << np.uint64(21)) | (before2[used] << np.uint64(42)))
    starts = before[used] == 0
    word = np.cumsum(starts) - 1
    return (h % np.uint64(BUCKETS)).astype(np.int64), word, np.searchsorted(ends, used[starts], side="right")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    for batch in slices(batches, size=BLOCK):
        by: dict[str, list[str]] = {}
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            for part in _blocks(texts):
                held[lang] = held.get(lang, 0) + np.bincount(features(part)[0], minlength=BUCKETS)
    for lang, n in held.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], names=["lang", "bucket", "n"])


def _blocks(texts: list[str]) -> Iterator[list[str]]:
    """Lists of texts of about ``BLOCK`` characters; a longer text is cut at white space or, failing that, anywhere."""
    part, size = [], 0
    for t in texts:
        while len(t) > BLOCK:
            at = max(t.rfind(" ", 0, BLOCK), t.rfind("\n", 0, BLOCK)) + 1 or BLOCK
            yield [t[:at]]
            t = t[at:]
        if part and size + len(t) > BLOCK:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


@dataclass
class Model:
    langs: list[str]
    logs: np.ndarray  # buckets x languages, log probabilities

    def word_logs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words x languages log-likelihoods, document of each word, characters of each word). Texts over ``BLOCK`` characters are worked
        through in parts."""
        parts = []
        step = max(1, BLOCK * 4 // max(4, len(self.langs)))
        for i, t in enumerate(texts):  # one list entry a document when a text is long, else all at once
            if len(t) > BLOCK:
                for part in _blocks([t]):
                    w, d, n = self._few(part, step)
                    parts.append((w, np.full(len(d), i), n))
        if not parts:
            return self._few(texts, step)
        short = [i for i, t in enumerate(texts) if len(t) <= BLOCK]
        w, d, n = self._few([texts[i] for i in short], step)
        parts.append((w, np.array(short, np.int64)[d], n))
        w, d, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(d, kind="stable")
        return w[order], d[order], n[order]

    def _few(self, texts: list[str], step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not texts:
            return np.empty((0, len(self.langs)), np.float32), np.empty(0, np.int64), np.empty(0, np.int64)
        bucket, word, doc = features(texts)
        out = np.zeros((len(doc), len(self.langs)), np.float32)
        for at in range(0, len(bucket), step):
            w = word[at : at + step]
            if len(w):
                first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
                out[w[first]] += np.add.reduceat(self.logs[bucket[at : at + step]], first)
        return out, doc, np.bincount(word, minlength=len(doc))

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[float | None], list[int]]:
        """Language, score, fit and used characters of each text."""
        return self.predicted(texts)[:4]

    def predicted(self, texts: list[str]) -> tuple[list[str], list[float], list[float | None], list[int], list[float | None]]:
        """``predict``, and the fit of each text to the mixture of its languages: that of its language where it has one."""
        langs, scores, fits, sizes, mixed = [UNKNOWN] * len(texts), [0.0] * len(texts), [None] * len(texts), [0] * len(texts), [None] * len(texts)
        if not self.langs:
            return langs, scores, fits, sizes, mixed
        w, doc, n = self.word_logs(texts)
        if not len(w):
            return langs, scores, fits, sizes, mixed
        first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        ids, n_words = doc[first], np.diff(np.append(first, len(w)))
        shares = proportions(w, first)
        best = shares.argmax(1)
        of_word = w[np.arange(len(w)), np.repeat(best, n_words)].astype(np.float64)
        likely = np.add.reduceat(of_word, first)
        several = np.repeat(shares.max(1) < 1, n_words)
        if several.any():
            own, most = w[several].astype(np.float64), w[several].max(1).astype(np.float64)
            joint = (np.exp(own - most[:, None]) * np.repeat(shares, n_words, 0)[several]).sum(1)
            of_word[several] = np.log(np.maximum(joint, 1e-30)) + most
        together, used = np.add.reduceat(of_word, first), np.add.reduceat(n, first)
        for j, (i, k, s) in enumerate(zip(ids, best, shares[np.arange(len(ids)), best], strict=True)):
            langs[i], scores[i], fits[i], sizes[i], mixed[i] = self.langs[k], float(min(1.0, max(0.0, s))), float(likely[j] / used[j]), int(used[j]), float(together[j] / used[j])
        return langs, scores, fits, sizes, mixed


def _mixture(p: np.ndarray, first: np.ndarray, n: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions by expectation-maximisation among the allowed languages, and the log-likelihood (but for each word's constant)."""
    pi = allowed / allowed.sum(1, keepdims=True)
    words, starts, open_ = p, first, np.arange(len(n))
    for _ in range(ROUNDS):
        sizes = n[open_]
        r = words * np.repeat(pi[open_], sizes, 0)
        r /= np.maximum(r.sum(1, keepdims=True), 1e-30)
        new = np.add.reduceat(r, starts) / sizes[:, None]
        moved = np.abs(new - pi[open_]).max(1) > STILL
        pi[open_] = new
        if not moved.any():
            break
        if moved.mean() < 0.5:  # documents that stand still leave, once that is worth the copying
            words, open_ = words[np.repeat(moved, sizes)], open_[moved]
            starts = np.concatenate(([0], np.cumsum(n[open_])[:-1]))
    total = np.log(np.maximum((p * np.repeat(pi, n, 0)).sum(1), 1e-30))
    return pi, np.add.reduceat(total.astype(np.float64), first)


def proportions(w: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Documents x languages. ``w``: words x languages log-likelihoods; ``first``: the first word of each document."""
    n = np.diff(np.append(first, len(w)))
    p = np.exp(w - w.max(1, keepdims=True), dtype=np.float32)
    k = w.shape[1]
    full, most = _mixture(p, first, n, np.ones((len(n), k), np.float32))
    order = np.argsort(-full, 1, kind="stable")
    rank = np.argsort(order, 1, kind="stable")
    chosen = (rank < 1).astype(np.float32)
    alone = p[np.arange(len(w)), np.repeat(order[:, 0], n)]
    value = np.add.reduceat(np.log(np.maximum(alone, 1e-30)).astype(np.float64), first)
    open_ = np.flatnonzero(most - value > 0.5 * np.log(n) + ENTRY_COST)  # no language set explains more than all languages do
    for m in range(2, k + 1):
        if not len(open_):
            break
        words = np.repeat(np.isin(np.arange(len(n)), open_), n)
        own = n[open_]
        at = np.concatenate(([0], np.cumsum(own)[:-1]))
        pi, v = _mixture(p[words], at, own, (rank[open_] < m).astype(np.float32))
        better = v - value[open_] > 0.5 * np.log(own) + ENTRY_COST
        chosen[open_[better]], value[open_[better]] = pi[better], v[better]
        open_ = open_[better]
    return chosen


def train(labelled: DataFrame) -> Model:
    """From all rows of ``labelled`` (text, lang) with neither null. Counts are summed in each task before the shuffle; what reaches the
    driver has at most ``BUCKETS`` rows a language."""
    rows = modest_batches(labelled).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = rows.mapInArrow(tidily(_counts), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    logs = np.empty((BUCKETS, len(langs)), np.float32)
    for k, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        n = np.full(BUCKETS, 0.05)
        n[own["bucket"].to_numpy()] += own["n"].to_numpy()
        logs[:, k] = np.log(n / n.sum())
    return Model(list(langs), logs)


_FOUND = ("lang_pred", "score", "fit", "used", "mixture")


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=BLOCK):
            langs, scores, fits, sizes, mixed = model.predicted([t or "" for t in batch.column("text").to_pylist()])
            rest = [batch.column(i) for i in range(1, batch.num_columns)]
            found = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(fits, pa.float64()), pa.array(sizes, pa.int64()), pa.array(mixed, pa.float64())]
            yield pa.RecordBatch.from_arrays([*rest, *found], names=[*batch.schema.names[1:], *_FOUND])

    return run


def _identified(docs: DataFrame, model: Model, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep`` by the names _0, _1, ..., then ``_FOUND``."""
    held = modest_batches(docs).select(F.col("text").cast("string").alias("text"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(keep)))
    kinds = {f.name: f for f in held.schema.fields}
    found = [T.StructField(n, t) for n, t in zip(_FOUND, (T.StringType(), T.DoubleType(), T.DoubleType(), T.LongType(), T.DoubleType()), strict=True)]
    return held.mapInArrow(tidily(_predict(model)), T.StructType([*(kinds[f"_{i}"] for i in range(len(keep))), *found]))


def identify(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns ``keep`` of ``docs``, then lang_pred, score and fit."""
    out = _identified(docs, model, keep)
    return out.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(keep)), "lang_pred", "score", "fit")


def floors(labelled: DataFrame) -> dict[str, float]:
    """The fit below which a text is in no known language, by predicted language, from all labelled rows (lang_pred, fit). Counts by
    hundredths reach the driver."""
    n: dict[str, list[tuple[float, int]]] = {}
    for r in labelled.where("fit is not null").groupBy("lang_pred", F.round("fit", 2).alias("at")).count().orderBy("at").collect():
        n.setdefault(r["lang_pred"], []).append((r["at"], r["count"]))
    out = {}
    for lang, counts in n.items():
        total, upto, low, middle = sum(c for _, c in counts), 0, None, None
        for at, c in counts:
            upto += c
            low = at if low is None and upto > OUTLYING * total else low
            middle = at if middle is None and upto > total / 2 else middle
        out[lang] = low - (middle - low)
    return out


def in_known_language(docs: DataFrame, model: Model, wanted: tuple[str, ...] | None = None, least: float = 0.0) -> DataFrame:
    """``docs``, whatever the names of their columns, without the rows that are ``und``; those whose text fits the mixture of its languages worse
    than texts of a known language do; and, if languages are ``wanted``, those of another one or with a score below ``least``. Docs have a column lang."""
    rows = saved(_identified(docs, model, tuple(docs.columns)), "identified")
    lang = F.col(f"_{docs.columns.index('lang')}")
    limit = F.lit(float("-inf"))
    for name, floor in sorted(floors(rows.where(lang.isNotNull()).select("lang_pred", F.col("mixture").alias("fit"))).items()):
        limit = F.when(F.col("lang_pred") == name, F.lit(floor)).otherwise(limit)
    kept = (F.col("lang_pred") != UNKNOWN) & (F.col("mixture") >= limit - SHORT / F.sqrt(F.col("used")))
    if wanted is not None:
        kept = kept & F.col("lang_pred").isin(*wanted) & (F.col("score") >= least)
    return rows.where(kept).select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)))
