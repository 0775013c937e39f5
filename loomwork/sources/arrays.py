"""Records of JSON array files, each file read by many tasks.

A file is read as text cut at closing braces, which Spark splits by byte ranges in any store that it reads. What a range begins in, a string or not,
is not known to its task: a first pass works out, for both, how it ends and how much deeper; a row a range is put together for each file; a
second pass then cuts out the records, and those that reach over ranges are joined of their parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_REST = re.compile(r'(?:[^"\\]|\\.)*"', re.S)
_STATES = "file string, block long, inside boolean, depth long, level long"


def _scanned(piece: str, inside: bool) -> tuple[bool, str]:
    """Whether a piece ends within a string, and the piece without what is in strings."""
    if inside:
        m = _REST.match(piece)
        if m is None:
            return True, ""
        piece = piece[m.end() :]
    plain = _STRING.sub("", piece)
    at = plain.find('"')
    return (True, plain[:at]) if at >= 0 else (False, plain)


def _deeper(plain: str) -> int:
    return plain.count("{") + plain.count("[") - plain.count("]")


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a range: for a beginning outside and inside of a string, whether it ends inside and by how much deeper; its bytes; its first sign."""
    held: dict[tuple[str, int], list] = {}
    for batch in batches:
        for piece, file, block, size in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "block", "size")), strict=True):
            own = held.setdefault((file, block), [[False, 0], [True, 0], 0, None, size])
            for state in own[:2]:
                state[0], plain = _scanned(piece, state[0])
                state[1] += _deeper(plain) - (not state[0])  # the brace that ends the piece
            own[2] += len(piece.encode()) + 1
            own[3] = own[3] or piece.strip()[:1] or None
    rows = [(file, block, *outside, *inside, size, first, whole) for (file, block), (outside, inside, size, first, whole) in held.items()]
    names = ["file", "block", "out_ends", "out_deeper", "in_ends", "in_deeper", "bytes", "first", "size"]
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def _begun(group: pd.DataFrame) -> pd.DataFrame:
    """How each range of a file begins; ``level``: the depth that records stand at. Fails if the file ends within a record or its array."""
    group = group.sort_values("block")
    inside, depth, out = False, 0, []
    level = 1 if next((x for x in group["first"] if x), None) == "[" else 0
    open_end = int(group["bytes"].sum()) - int(group["size"].iloc[0]) == 1
    for r in group.itertuples(index=False):
        out.append((r.file, r.block, inside, depth, level))
        ends, deeper = (r.in_ends, r.in_deeper) if inside else (r.out_ends, r.out_deeper)
        inside, depth = bool(ends), depth + int(deeper)
    if inside or depth + open_end:  # a brace was counted where none ends the file
        raise ValueError(f"the array ends early in {group['file'].iloc[0]}")
    return pd.DataFrame(out, columns=["file", "block", "inside", "depth", "level"])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, part, text): 1 a whole record; 0 the end of one begun earlier, or a range within one; 2 the beginning of one that goes on."""
    at, own = None, None

    def end() -> list[tuple]:
        """What is left open where a range ends."""
        text = "".join(own["text"])
        return [(*at, 2 if own["begun"] else 0, text)] if text.strip() and own["open"] else []

    for batch in batches:
        out = []
        for piece, file, block, inside, depth, level in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "block", "inside", "depth", "level")), strict=True):
            if (file, block) != at:
                out += end() if at else []
                at, own = (file, block), {"text": [], "inside": inside, "depth": depth, "open": depth > level or inside, "begun": False}
            start = 0
            if not own["open"]:  # up to the brace that begins a record
                start = piece.find("{")
                if start < 0:
                    plain = _scanned(piece, False)[1]
                    own["depth"] += _deeper(plain) - 1
                    continue
                own["open"] = own["begun"] = True
                own["depth"] += _deeper(_scanned(piece[:start], False)[1])
            own["inside"], plain = _scanned(piece[start:], own["inside"])
            own["depth"] += _deeper(plain) - (not own["inside"])
            own["text"].append(piece[start:] + "}")
            if not own["inside"] and own["depth"] == level:
                out.append((file, block, 1 if own["begun"] else 0, "".join(own["text"])))
                own |= {"text": [], "open": False, "begun": False}
        if out:
            yield _rows(out)
    if at and (out := end()):
        yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["file", "block", "part", "text"])


def array_records(spark: SparkSession, path: str) -> DataFrame:
    """(value): the text of each object of the arrays in the files at ``path``, of UTF-8; or of objects one after the other. A file that ends within
    an object or its array fails. A row for each range of a file is sent to all tasks."""
    text = spark.read.text(path, lineSep="}")
    pieces = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"))
    found = pieces.mapInArrow(_summaries, "file string, block long, out_ends boolean, out_deeper long, in_ends boolean, in_deeper long, bytes long, first string, size long")
    states = found.groupBy("file").applyInPandas(_begun, _STATES)
    begun = pieces.drop("size").join(F.broadcast(states), ["file", "block"])  # the order of pieces in a task stays
    parts = begun.select("value", "file", "block", "inside", "depth", "level").mapInArrow(_records, "file string, block long, part int, text string")
    # A record over ranges: its beginning, ranges within it, its end. At most two parts a range are left for this.
    cut = parts.where("part <> 1").withColumn("of", F.sum((F.col("part") == 2).cast("long")).over(W.partitionBy("file").orderBy("block", "part")))
    joined = cut.groupBy("file", "of").agg(F.array_sort(F.collect_list(F.struct("block", "part", "text"))).alias("parts"))
    whole = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    return parts.where("part = 1").select(F.col("text").alias("value")).unionByName(joined.select(whole.alias("value")))
