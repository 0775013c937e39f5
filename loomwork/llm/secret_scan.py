"""Secrets in whole texts (op 7): three pattern kinds, and runs of characters that a pair of Markov models takes for random strings.

Two second-order character Markov models, one of random strings (keys, digests, tokens) and one of ordinary identifiers and words, are
trained from labelled samples. Of each run of ``LEAST`` or more characters, what no pattern span covers is scored in pieces of that many
or more. A piece is a secret of the kind ``markov`` when its log-likelihood ratio, a character, exceeds a threshold. Otherwise its maximal
scoring segments are whose sum exceeds ``MARGIN``, out to the separators around; so a path before a key does not outvote it. They are found
in one pass, whatever the run holds.

The samples are seeded ones made here (random strings over common alphabets against composed identifiers) and, as ordinary strings, the
long words of a bounded sample of the corpus: the ``sample_docs`` rows with the smallest hashes of id and text, of which each gives at most
``sample_words`` words of 12 to ``LONGEST_WORD`` letters. All else covers every row. Keys of fewer than ``LEAST`` characters, a
parameter, are left to the patterns.

Null or empty text: no span. Offsets are code points, ends exclusive. Repeated rows: each is reported. Ties: spans that begin together are
in the order of ``KINDS``. Long texts are scanned whole, run by run. Empty table: no rows. Only doc_id
and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import modest_batches, slices, tidily

# The pattern kinds in their listed order.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Characters that a run has at least, and from which on its mean alone decides.
LEAST = FULL = 20
THRESHOLD = 0.0
#: Sum of the log-likelihood ratio from which on a stretch within a run is a secret, above what ordinary runs reach by chance.
MARGIN = 10.0
SAMPLE_DOCS = 2_000
SAMPLE_WORDS = 100
LONGEST_WORD = 200



@cache
def run_pattern(least: int) -> re.Pattern:
    return re.compile(rf"[A-Za-z0-9+/_=-]{{{least},}}")


_SYMBOLS = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_=-"
_CODE = np.full(128, len(_SYMBOLS), np.int64)
_CODE[[ord(c) for c in _SYMBOLS]] = np.arange(len(_SYMBOLS))
_N = len(_SYMBOLS) + 2  # one for other characters, one for the start

_PARTS = "get set user name list item file path index count value page table query load save read write open close node tree data base line text word time date first last next test main core util http json error parse token state event handler config default manager service request response buffer stream".split()


def seeded_samples(n: int = 4_000, seed: int = 7) -> list[tuple[int, str]]:
    """(1, random string) and (0, composed identifier), ``n`` of each."""
    rng = random.Random(seed)
    alphabets = ("0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits)
    out = []
    for i in range(n):
        out.append((1, "".join(rng.choices(alphabets[i % len(alphabets)], k=rng.randint(20, 64)))))
        parts = rng.choices(_PARTS, k=rng.randint(3, 7))
        style = i % 5
        text = ("_".join(parts), "-".join(parts), "".join(p.capitalize() for p in parts), "_".join(parts).upper(), "/".join(parts))[style]
        out.append((0, text + (str(rng.randint(0, 2030)) if rng.random() < 0.3 else "")))
    return out


def _codes(text: str) -> np.ndarray:
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.concatenate(([_N - 1, _N - 1], _CODE[np.minimum(a, 127)]))


def train(samples: Iterable[tuple[int, str]]) -> np.ndarray:
    """log P(c | two characters before, random) - log P(c | ..., ordinary) as one table of ``_N`` ** 3 entries.

    Each model interpolates its trigram counts with its bigram model, and that with the uniform distribution, so that characters after
    rare contexts fall back.
    """
    logs = []
    by_label: dict[int, list[np.ndarray]] = {0: [], 1: []}
    for label, text in samples:
        by_label[label].append(_codes(text))
    for label in (1, 0):
        three, two = np.zeros(_N**3), np.zeros(_N**2)
        for c in by_label[label]:
            np.add.at(three, (c[:-2] * _N + c[1:-1]) * _N + c[2:], 1)
            np.add.at(two, c[1:-1] * _N + c[2:], 1)
        two = two.reshape(_N, _N)
        p2 = (two + 2.0 / _N) / (two.sum(1, keepdims=True) + 2.0)
        three = three.reshape(_N, _N, _N)
        logs.append(np.log((three + 4.0 * p2[None]) / (three.sum(2, keepdims=True) + 4.0)))
    return (logs[0] - logs[1]).astype(np.float32).ravel()


def ratio(model: np.ndarray, text: str) -> float:
    """Log-likelihood ratio a character: above 0, the random model explains ``text`` better."""
    c = _codes(text)
    return float(model[(c[:-2] * _N + c[1:-1]) * _N + c[2:]].mean())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the three pattern kinds, each leftmost and non-overlapping, failing matches dropped."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def segments(scores: np.ndarray) -> list[tuple[int, int]]:
    """The maximal scoring segments of ``scores`` (Ruzzo and Tompa): the one of the greatest sum, and so on left and right of it. One pass; a
    candidate knows the last one before it that begins lower, so what it passes over is not looked at again."""
    total = np.concatenate(([0.0], np.cumsum(scores, dtype=np.float64))).tolist()
    held: list[tuple[float, float, int, int, int]] = []  # sums before and after, start, end, the last that begins lower
    for i in np.flatnonzero(np.asarray(scores) > 0).tolist():
        low, start = total[i], i
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][0] >= low:
                j = held[j][4]
            if j < 0 or held[j][1] >= total[i + 1]:
                held.append((low, total[i + 1], start, i + 1, j))
                break
            low, start = held[j][0], held[j][2]
            del held[j:]
    return [(x[2], x[3]) for x in held]


def stretches(model: np.ndarray, text: str, threshold: float = THRESHOLD, margin: float = MARGIN, least: int = LEAST) -> Iterator[tuple[int, int]]:
    """(start, end) of the secrets in a run or what is left of one: the whole, or else its best stretches. A run of fewer than ``FULL`` characters
    says little by its mean, so its sum has to exceed ``margin`` too."""
    if len(text) < least:
        return
    c = _codes(text)
    scores = model[(c[:-2] * _N + c[1:-1]) * _N + c[2:]] - threshold
    total = np.concatenate(([0.0], np.cumsum(scores, dtype=np.float64)))
    if total[-1] > (0 if len(text) >= FULL else margin):
        yield 0, len(text)
        return
    if (total - np.minimum.accumulate(total)).max() <= margin:
        return
    last = 0
    for start, end in segments(scores):
        if end <= last or total[end] - total[start] <= margin:
            continue
        while start > last and text[start - 1] not in "/_=-":
            start -= 1
        start = max(start, last)
        while end < len(text) and text[end] not in "/_=-":
            end += 1
        if end - start >= least and total[end] - total[start] > margin:
            yield start, end
            last = end


def model_spans(model: np.ndarray, text: str, base: list[tuple[int, int, int]], threshold: float, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Spans of the kind ``markov`` in what ``base``, sorted, leaves of the text's runs."""
    found, k, near = [], 0, []
    for m in run_pattern(least).finditer(text):
        near = [x for x in near if x[2] > m.start()]
        while k < len(base) and base[k][0] < m.end():
            if base[k][2] > m.start():
                near.append(base[k])
            k += 1
        at = m.start()
        for s, _, e in [*near, (m.end(), 0, m.end())]:
            if s > at:
                found += [(at + a, 3, at + b) for a, b in stretches(model, text[at:s], threshold, least=least)]
            at = max(at, e)
    return found


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _words(limit: int):
    word = re.compile(rf"(?<![^\W\d_])[^\W\d_]{{12,{LONGEST_WORD}}}(?![^\W\d_])")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for text in batch.column("text").to_pylist():
                for n, m in enumerate(word.finditer(text or "")):
                    if n == limit:
                        break
                    out.append(m[0])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["word"])

    return run


def labelled_samples(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS) -> list[tuple[int, str]]:
    """At most ``sample_docs * sample_words`` ordinary words of the corpus, and the seeded samples. Rows beyond ``sample_docs`` are of an id and a
    text that the sample has already, and add no word."""
    keyed = docs.select(F.xxhash64(F.col("doc_id"), F.col("text").cast("string")).alias("key"), F.col("text").cast("string").alias("text"))
    last = keyed.select("key").orderBy("key").limit(sample_docs).agg(F.max("key")).head()[0]
    if last is None:
        return seeded_samples()
    sample = keyed.where(F.col("key") <= last).select("text")
    words = sorted(r[0] for r in sample.mapInArrow(tidily(_words(sample_words)), "word string").distinct().collect())
    return seeded_samples() + [(0, w) for w in words]


def _scan(model: np.ndarray, threshold: float, least: int):
    names = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov")
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = text or ""
                base = base_spans(text)
                more = model_spans(model, text, base, threshold, least)
                n = [sum(k == i for _, k, _ in base) for i in range(3)]
                rows.append((doc_id, *n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(sorted(base + more)), len(more)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))

    return run


def scan(docs: DataFrame, samples: list[tuple[int, str]] | None = None, threshold: float = THRESHOLD, least: int = LEAST) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov. ``least``: characters of the shortest key."""
    model = train(labelled_samples(docs) if samples is None else samples)
    rows = modest_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidily(_scan(model, threshold, least)), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long")
