"""Shards of near-equal size from ordered atomic groups (op 6).

Documents of equal text form a group that is never divided. Groups are ordered by 60 bits of the digest of their text, and the order is cut
into contiguous shards so that the largest is as small as can be: the smallest capacity is found by binary search, each step of which fills
shard after shard greedily, forwards and backwards. That bounds each cut on either side; within the bounds it goes next to the even share.

The search sees the groups through a histogram over ranges of the order. From it follow a lower and an upper bound of the capacity, and so
a stretch of the order for each cut; only the ranges there are divided further, until each of them is one group. At most some ten thousand
rows reach the driver a round, however many groups there are, and the result is that of the search over all groups.

Null text counts as empty text. Repeated rows: each takes a slot, by a count. Ties: slots have no order that means anything, and rows of one
text and id get adjoining ones. Long texts: only their digests are held. A group larger than an even share is a shard to itself or nearly so,
and shards without a group stay empty. Empty table: no rows. Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import numbered, saved

BITS = 60
FIRST_BITS, MORE_BITS = 12, 8
#: Rows that are numbered together in a task, as long as that makes no more than so many sets.
NUMBERED_TOGETHER, MOST_DEALS = 10_000, 32_768


@dataclass(frozen=True)
class Range:
    """Groups whose keys are from ``first`` on, ``width`` keys wide."""

    first: int
    width: int
    size: int
    groups: int

    @property
    def whole(self) -> bool:
        return self.groups == 1 or self.width == 1


class Line:
    """Ranges in order, with their ends as running sizes."""

    def __init__(self, ranges: list[Range]):
        self.ranges = ranges
        self.ends = []
        total = 0
        for r in ranges:
            total += r.size
            self.ends.append(total)
        self.total = total

    def cuts(self, capacity: int, shards: int, inside: bool) -> list[int]:
        """Where greedy filling ends each shard. ``inside``: ranges of several groups may be cut anywhere, else nowhere."""
        at, out = 0, []
        for _ in range(shards):
            goal = at + capacity
            if goal >= self.total:
                at = self.total
            else:
                i = bisect_right(self.ends, goal)  # the range that the goal lies in
                at = goal if inside and not self.ranges[i].whole else self.ends[i] - self.ranges[i].size
            out.append(at)
        return out

    def least(self, shards: int, inside: bool) -> int:
        low, high = -(-self.total // shards), self.total
        while low < high:
            middle = (low + high) // 2
            if self.cuts(middle, shards, inside)[-1] >= self.total:
                high = middle
            else:
                low = middle + 1
        return low

    def backwards(self) -> Line:
        return Line(self.ranges[::-1])

    def _stretched(self, shards: int, low: int, high: int) -> set[Range]:
        """Ranges of several groups that greedy cuts of a capacity from ``low`` to ``high`` can fall in."""
        stretches = list(zip(self.cuts(low, shards, False), self.cuts(high, shards, True), strict=True))[: shards - 1]
        return {r for r, end in zip(self.ranges, self.ends, strict=True) if not r.whole and any(end > a and end - r.size < b for a, b in stretches)}

    def open(self, shards: int) -> list[Range]:
        """Ranges that must be divided before the least capacity and the cuts are known."""
        low, high = self.least(shards, True), self.least(shards, False)
        found = self._stretched(shards, low, high) | self.backwards()._stretched(shards, low, high)
        even = [self.total * i / shards for i in range(1, shards)]
        found |= {r for r, end in zip(self.ranges, self.ends, strict=True) if not r.whole and any(end - r.size < e < end for e in even)}
        return sorted(found, key=lambda r: r.first)

    def even_cuts(self, capacity: int, shards: int) -> list[int]:
        """The ends of all shards but the last, each as near to an even share as the capacity allows: not so late that a shard before is
        over it, not so early that those after cannot hold the rest."""
        latest, back = self.cuts(capacity, shards, False), self.backwards().cuts(capacity, shards, False)
        # A group larger than an even share counts as one share, and the others share evenly what is left.
        large, share = 0, self.total / shards
        while (now := [r.size for r in self.ranges if r.groups == 1 and r.size > share]) and len(now) != large and len(now) < shards:
            large, share = len(now), (self.total - sum(now)) / (shards - len(now))
        counted = list(accumulate(min(r.size, share) if r.groups == 1 else r.size for r in self.ranges))
        at, out = 0, []
        for i in range(1, shards):
            earliest = self.total - back[shards - i - 1]
            goal = counted[-1] * i / shards
            k = min(bisect_right(counted, goal), len(counted) - 1)
            near = (self.ends[k - 1] if k else 0) if goal - (counted[k - 1] if k else 0) <= counted[k] - goal else self.ends[k]
            reach = bisect_right(self.ends, at + capacity)
            last = max(earliest, min(latest[i - 1], self.ends[reach - 1] if reach else 0))
            at = min(max(near, earliest), last)
            out.append(at)
        return out


def capacity_and_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """(least capacity, first key of each further shard) of ``groups`` (key, size), one row a key."""

    def histogram(of: DataFrame, width: int) -> list[Range]:
        rows = of.groupBy((F.col("key") - F.col("key") % width).alias("first")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
        return [Range(r["first"], width, r["size"], r["n"]) for r in rows]

    ranges = sorted(histogram(groups, 1 << (BITS - FIRST_BITS)), key=lambda r: r.first)
    while True:
        line = Line(ranges)
        open_ = line.open(shards) if ranges else []
        if not open_:
            break
        finer = []
        for width in sorted({r.width for r in open_}):
            firsts = [r.first for r in open_ if r.width == width]
            finer += histogram(groups.where((F.col("key") - F.col("key") % width).isin(firsts)), max(1, width >> MORE_BITS))
        done = set(open_)
        ranges = sorted([r for r in ranges if r not in done] + finer, key=lambda r: r.first)
    if not ranges:
        return 0, []
    capacity = line.least(shards, False)
    firsts = []
    for at in line.even_cuts(capacity, shards):
        i = bisect_right(line.ends, at)
        firsts.append(line.ranges[i].first if i < len(line.ranges) else 1 << BITS)
    return capacity, firsts


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = saved(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(raw) + 1).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            F.conv(F.substring(F.sha2(raw, 256), 1, BITS // 4), 16, 10).cast("long").alias("key"),
        ),
        "sizes",
    )
    groups = saved(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    _, firsts = capacity_and_cuts(groups, shards)
    number = F.lit(0)
    for first in firsts:
        number = number + (F.col("key") >= first).cast("int")
    return numbered(rows.withColumn("shard", number), "shard", ["key", "doc_id"], NUMBERED_TOGETHER, MOST_DEALS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("number").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
