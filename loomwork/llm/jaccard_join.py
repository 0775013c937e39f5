"""Documents whose sets of word 5-grams have a Jaccard similarity of 0.8 or more (op 2), by a MinHash LSH forest.

1. A text's words (lower-cased, split at white space) give a set of hashed 5-grams; a shorter text gives one gram of all its words. Texts
   of equal sets are one node, so copies are not compared with one another.
2. A node has a label in each of ``TREES`` trees: ``LONGEST`` minima, folded into a 64-bit number such that a prefix of the label is one of
   its bits, and numeric order is that of the trie (``levels``). A matched prefix is shortened, a level at a time, for as long as its nodes stay few
   (``CROWDED``); crowded ones stay long, so that templates which many texts share do not chain them together. A node at depths d meets a neighbour at the threshold with probability 1 - prod(1 - 0.8 ** d) over its trees.
   Where crowded trees leave that below ``RECALL``, the prefixes of that node are shortened all the same, down to the depth ``depth()`` at
   which the target is reached whatever the crowd. Nodes of one prefix are joined to the least of them.
3. Within the connected components of those joins, which hold every candidate pair, sets are compared exactly, in blocks. A component
   larger than a block is dealt by set size and hash into blocks; only pairs of blocks whose sizes can reach the threshold meet, each
   once. A task returns a row for each node: its number of links and the least node that it is connected to in the task. So no table of
   pairs is made, and no group is gathered in one task.
4. The connected components of the links are the classes.

Null and empty texts have no gram: each document is a class of its own. Repeated rows: copies. Null ids are carried; a class of them alone
has a null id. Ties: the least id, then digest, stands for a class. Long texts: their grams are a row, and a block of their own beyond its
size. Empty table: no rows. Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .components import components
from .repeats import keyed
from .shared import WordHashes, bounded, dropped, hot, mixed, saved, slices, split_join, tidily, unused, windows

WORDS = 5
THRESHOLD = Fraction(4, 5)
TREES, LONGEST = 32, 8
RECALL = 0.9999
#: Low bits of a label that are not of its shortest, its middle and its longest prefix.
SHIFTS = (20, 10, 0)
#: A prefix of more nodes is not shortened but for recall.
CROWDED = 64
#: A block has at most so many nodes, and about so many grams.
BLOCK_NODES, BLOCK_GRAMS = 256, 2_000_000

_HASHES = WordHashes()
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(0, 1 << 63, TREES * LONGEST, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, TREES * LONGEST, np.uint64)

_SIGNED = "doc_id long, text_md5 string, node string, nid long, n int, labels array<long>"


def grams(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``n`` words; of all words if there are fewer."""
    words = (text or "").lower().encode().split() if text and text.isascii() else [w.encode() for w in (text or "").lower().split()]
    return np.unique(windows(_HASHES.of(words), min(n, len(words)))) if words else np.empty(0, np.uint64)


def met(depths: list[int] | np.ndarray, similarity: float = float(THRESHOLD)) -> float:
    """The probability that a pair meets in some tree, given the prefix length that is matched in each."""
    return 1 - float(np.prod(1 - similarity ** np.asarray(depths, float)))


def depth(threshold: float = float(THRESHOLD), trees: int = TREES, longest: int = LONGEST, recall: float = RECALL) -> int:
    """The longest prefix that, matched in every tree, is enough for ``recall`` at the threshold."""
    return max((d for d in range(1, longest + 1) if met([d] * trees, threshold) >= recall), default=1)


def levels(threshold: float = float(THRESHOLD)) -> tuple[int, int, int]:
    """Prefix lengths: one less than is enough, enough in every tree, and the whole label."""
    d = min(max(2, depth(threshold)), LONGEST - 1)
    return d - 1, d, LONGEST


def labels(g: np.ndarray, lengths: tuple[int, int, int]) -> np.ndarray:
    """The label of a set in each tree: the upper bits hash its first minima, lower ones the minima that longer prefixes add."""
    least = np.full(TREES * LONGEST, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(g), 512):
        least = np.minimum(least, (g[at : at + 512, None] * _A + _B).min(0))
    minima = least.reshape(TREES, LONGEST)
    h = np.arange(1, TREES + 1).astype(np.uint64)
    out, done, above = np.zeros(TREES, np.uint64), 0, 64
    for d, shift in zip(lengths, SHIFTS, strict=True):
        for i in range(done, d):
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + minima[:, i])
        out |= (h >> np.uint64(64 - above + shift)) << np.uint64(shift)
        done, above = d, shift
    return out.view(np.int64)


def _sign(lengths: tuple[int, int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            nodes, ids, sizes, keys = [], [], [], []
            for text in batch.column("text").to_pylist():
                g = grams(text)
                digest = hashlib.md5(g.tobytes()).digest() if len(g) else None
                nodes.append(digest and digest.hex())
                ids.append(digest and int.from_bytes(digest[:8], "little", signed=True))
                sizes.append(len(g))
                keys.append(labels(g, lengths) if len(g) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_md5"), pa.array(nodes, pa.string()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "text_md5", "node", "nid", "n", "labels"],
            )

    return run


def _matched(rows: DataFrame, shift: int, total: int) -> DataFrame:
    """``rows`` (nid, label) whose prefix above ``shift`` bits is another node's too, with prefix, size (its nodes) and root (the least)."""
    rows = rows.withColumn("prefix", F.shiftright("label", shift))
    sizes = saved(rows.groupBy(F.col("prefix").alias("p_prefix")).agg(F.count("*").alias("size"), F.min("nid").alias("root")).where("size > 1"), "prefixes")
    out = saved(split_join(rows, sizes, F.col("prefix") == F.col("p_prefix"), hot(F.col("size"), total), row_bytes=64).drop("p_prefix"), "matched")
    dropped(sizes)
    return out


def candidates(labelled: DataFrame, threshold: float = float(THRESHOLD)) -> DataFrame:
    """Edges (a, b) from the least node of a prefix to the others that it joins; of ``labelled`` (nid, label), saved, a row a node and tree.
    The depth of a prefix is one for all its nodes, so that two nodes meet in a tree if their labels agree up to the depth of either there."""
    total = labelled.count()
    few, edge = F.col("size") <= CROWDED, (F.col("root").alias("a"), F.col("nid").alias("b"))
    short = _matched(labelled, SHIFTS[0], total)
    edges = short.where(few).select(*edge)
    crowd = short.where(~few).select("nid", "label")
    if crowd.isEmpty():
        return edges
    middle = _matched(crowd, SHIFTS[1], total)
    edges = edges.union(middle.where(few).select(*edge))
    long = middle.where(~few)
    # The logarithm of a miss at the threshold, by how many of a node's trees have which depth; 1e-9: what sums lose by rounding.
    miss = [float(np.log1p(-(threshold**d))) for d in levels(threshold)]
    depths = crowd.select("nid", F.lit(miss[1] - miss[0]).alias("x")).union(long.select("nid", F.lit(miss[2] - miss[1]).alias("x")))
    lost = depths.groupBy(F.col("nid").alias("l_nid")).agg(F.sum("x").alias("x")).where(F.col("x") + TREES * miss[0] > float(np.log(1 - RECALL)) + 1e-9)
    wanted = long.join(lost, F.col("nid") == F.col("l_nid"), "left_semi").groupBy(F.col("prefix").alias("w_prefix")).agg(F.max("size").alias("w_size"))
    wanted = saved(wanted, "shortened")
    same = F.col("prefix") == F.col("w_prefix")
    edges = edges.union(split_join(long, wanted, same, hot(F.col("w_size"), total), row_bytes=64).select(*edge))
    kept = split_join(long, wanted, same, hot(F.col("w_size"), total), "left", 64).where("w_prefix is null").select("nid", "label")
    return edges.union(_matched(kept, SHIFTS[2], total).select(*edge))


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = [grams(t).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "grams"])


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """len(left) x len(right) sizes of intersections."""
    if len(left) * len(right) <= 16:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in right] for a in left], np.int64).reshape(len(left), len(right))
    values, inverse = np.unique(np.concatenate(left + right), return_inverse=True)
    rows = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in left + right])
    often = np.bincount(inverse) > 1
    column = np.where(often, np.cumsum(often) - 1, -1)[inverse]
    rows, column = rows[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int(often.sum()), 4096):
        a, b = np.searchsorted(column, (first, first + 4096))
        x = np.zeros((len(left) + len(right), 4096), np.float32)
        x[rows[a:b], column[a:b] - first] = 1
        out += x[: len(left)] @ x[len(left) :].T
    return out.astype(np.int64)


def linked(left: list[np.ndarray], right: list[np.ndarray], threshold: Fraction) -> np.ndarray:
    shared = shared_counts(left, right)
    union = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None] - shared
    return shared * threshold.denominator >= union * threshold.numerator


def _compare(threshold: Fraction):
    def task(nodes: list[str], sides: list[int], texts: list[int], sets: list[np.ndarray]) -> list[tuple[str, int, str]]:
        left, right = [i for i, s in enumerate(sides) if s != 2], [i for i, s in enumerate(sides) if s == 2]
        if 0 not in sides:  # two blocks, of which one may be empty
            if not left or not right:
                return []
            m = linked([sets[i] for i in left], [sets[i] for i in right], threshold)
        else:
            right = left
            m = linked([sets[i] for i in left], [sets[i] for i in left], threshold)
            np.fill_diagonal(m, False)
        parent = list(range(len(nodes)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        weight = np.array(texts, np.int64)
        links = np.zeros(len(nodes), np.int64)
        links[left] += m @ weight[right]
        if right is not left:
            links[right] += m.T @ weight[left]
        for i, j in zip(*np.nonzero(m), strict=True):
            a, b = root(left[i]), root(right[j])
            if a != b:
                a, b = (a, b) if nodes[a] < nodes[b] else (b, a)
                parent[b] = a
        return [(nodes[i], int(links[i]), nodes[root(i)]) for i in range(len(nodes)) if links[i]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("task", "node", "side", "n_texts", "grams")), strict=True):
                if row[0] != key:
                    if len(held) > 1:
                        out += task(*_columns(held))
                    key, held = row[0], []
                held.append(row[1:])
            if len(out) > 5000:
                yield _rows(out)
                out = []
        if len(held) > 1:
            out += task(*_columns(held))
        yield _rows(out)

    def _columns(rows: list[tuple]) -> tuple[list, list, list, list]:
        nodes, sides, texts, sets = (list(x) for x in zip(*rows, strict=True))
        return nodes, sides, texts, [np.frombuffer(s, np.uint64) for s in sets]

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["node", "links", "root"])

    return run


def _dealt(sized: DataFrame) -> DataFrame:
    """(task, side, node, n_texts) of ``sized`` (comp, node, n, n_texts, members, grams_in_comp). Side 1 and 2 meet; side 0 meets itself."""
    alone = (F.col("members") <= BLOCK_NODES) & (F.col("grams_in_comp") <= BLOCK_GRAMS)
    small = sized.where(alone).select(F.col("comp").cast("string").alias("task"), F.lit(0).alias("side"), "node", "n_texts")
    # Sets whose sizes differ by more than a factor of 5/4 cannot be linked: of two linked ones the size classes are equal or neighbours.
    large = sized.where(~alone).withColumn("k", F.floor(F.log("n") / F.log(F.lit(float(1 / THRESHOLD)))).cast("int"))
    classes = large.groupBy(F.col("comp").alias("c_comp"), F.col("k").alias("c_k")).agg(F.count("*").alias("c_nodes"), F.greatest(F.ceil(F.count("*") / F.lit(BLOCK_NODES)), F.ceil(F.sum(F.col("n").cast("long")) / F.lit(BLOCK_GRAMS))).cast("int").alias("blocks"))
    near = W.partitionBy("c_comp").orderBy("c_k")  # at most some hundred classes a component
    beside = lambda which, step: F.when(which("c_k").over(near) == F.col("c_k") + step, which("blocks").over(near)).otherwise(0)
    classes = saved(classes.withColumn("u_blocks", beside(F.lead, 1)).withColumn("l_blocks", beside(F.lag, -1)), "classes")
    placed = split_join(large, classes, (F.col("comp") == F.col("c_comp")) & (F.col("k") == F.col("c_k")), hot(F.col("c_nodes"), sized.count())).withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def name(k, b, k2, b2):
        return F.concat_ws("/", "comp", k, b, k2, b2)

    k, b = F.col("k"), F.col("b")
    own = F.transform(upto(F.col("blocks")), lambda x: F.struct(name(k, F.least(b, x), k, F.greatest(b, x)).alias("task"), F.when(x == b, 0).when(b < x, 1).otherwise(2).alias("side")))
    up = F.transform(upto(F.col("u_blocks")), lambda x: F.struct(name(k, b, k + 1, x).alias("task"), F.lit(1).alias("side")))
    down = F.transform(upto(F.col("l_blocks")), lambda x: F.struct(name(k - 1, x, k, b).alias("task"), F.lit(2).alias("side")))
    return small.union(placed.select("node", "n_texts", F.explode_outer(F.concat(own, up, down)).alias("x")).select("x.task", "x.side", "node", "n_texts"))


def join(docs: DataFrame, threshold: Fraction = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, text_md5, node, class_id (least doc_id of the class), n_links (other texts that it is linked to),
    n_copies (further documents of the same text), keeper (whether this document stands for its class)."""
    rows = keyed(docs)
    signed = saved(rows.mapInArrow(tidily(_sign(levels(float(threshold)))), _SIGNED), "signatures")
    total = signed.count()
    with_grams = signed.where("node is not null")
    texts = with_grams.groupBy("node", "nid", "text_md5").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("docs"), F.max("n").alias("n"))
    nodes = saved(texts.groupBy("node", "nid").agg(F.min(F.struct("doc_id", "text_md5")).alias("rep"), F.count("*").alias("n_texts"), F.sum("docs").alias("docs"), F.max("n").alias("n")), "nodes")

    # Candidates, and their components.
    labelled = saved(with_grams.groupBy("nid").agg(F.first("labels").alias("labels")).select("nid", F.explode("labels").alias("label")), "labels")
    comps = saved(components(candidates(labelled, float(threshold))).select(F.col("node").alias("c_nid"), F.col("root").alias("comp")), "candidates")
    dropped(labelled)

    # Their sets, compared in blocks.
    sized = saved(nodes.join(comps, F.col("nid") == F.col("c_nid")).select("node", "comp", "n", "n_texts", F.col("rep.doc_id").alias("r_id"), F.col("rep.text_md5").alias("r_md5")), "members")
    totals = saved(sized.groupBy(F.col("comp").alias("t_comp")).agg(F.count("*").alias("members"), F.sum(F.col("n").cast("long")).alias("grams_in_comp")), "totals")
    sized = saved(split_join(sized, totals, F.col("comp") == F.col("t_comp"), hot(F.col("members"), total)).drop("t_comp"), "sized")
    wanted = bounded(sized.select("node", "r_id", "r_md5"))
    texts_of = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("text_md5") == F.col("r_md5"))).select("node", "text")
    sets = texts_of.mapInArrow(tidily(_grams), "node string, grams binary").withColumnRenamed("node", "s_node")
    sets = saved(sets.dropDuplicates(["s_node"]) if _repeated(signed) else sets, "grams")
    tasks = _dealt(sized).join(sets, F.col("node") == F.col("s_node")).select("task", "node", "side", "n_texts", "grams")
    compared = saved(tasks.repartition("task").sortWithinPartitions("task").mapInArrow(tidily(_compare(threshold)), "node string, links long, root string"), "links")
    dropped(sets)
    links = compared.groupBy(F.col("node").alias("l_node")).agg(F.sum("links").alias("links"))
    classes = components(compared.select(F.col("root").alias("a"), F.col("node").alias("b")))

    # Back to documents. A third of them may be one text's, one node's or one class's.
    labelled = nodes.join(classes.withColumnRenamed("node", "c_node"), F.col("node") == F.col("c_node"), "left").join(links, F.col("node") == F.col("l_node"), "left")
    labelled = saved(labelled.select(F.col("node").alias("n_node"), "rep", "docs", F.coalesce("root", "node").alias("label"), "n_texts", F.coalesce("links", F.lit(0)).alias("links")), "labelled")
    firsts = saved(labelled.groupBy(F.col("label").alias("f_label")).agg(F.min("rep").alias("first"), F.count("*").alias("f_nodes")), "class-firsts")
    by_node = saved(split_join(labelled, firsts, F.col("label") == F.col("f_label"), hot(F.col("f_nodes"), total)).select("n_node", "first", "n_texts", "links", F.col("docs").alias("n_docs")), "by-node")
    copies = saved(signed.groupBy(F.col("text_md5").alias("c_md5")).agg(F.count("*").alias("docs")).where("docs > 1"), "copies")
    out = split_join(signed.select("doc_id", "text_md5", "node"), by_node, F.col("node") == F.col("n_node"), hot(F.col("n_docs"), total), "left")
    out = split_join(saved(out, "placed"), copies, F.col("text_md5") == F.col("c_md5"), hot(F.col("docs"), total), "left")
    alone = F.col("node").isNull()
    return out.select(
        "doc_id", "text_md5", "node",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.when(alone, 0).otherwise(F.col("links") + F.col("n_texts") - 1).cast("long").alias("n_links"),
        F.when(alone, 0).otherwise(F.coalesce("docs", F.lit(1)) - 1).cast("long").alias("n_copies"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_md5") == F.col("first.text_md5")))).alias("keeper"),
    )


def _repeated(signed: DataFrame) -> bool:
    return not signed.groupBy("doc_id", "text_md5").count().where("count > 1").isEmpty()


def one_of_each(docs: DataFrame, threshold: Fraction = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that another of their class stands for; of repeated rows one stays. Texts without words stay."""
    columns = docs.columns
    g_id, g_md5 = unused(docs, "g_id", "g_md5")
    found = saved(join(docs, threshold).groupBy("doc_id", "text_md5").agg(F.max("keeper").alias("keeper"), F.first("node").alias("node"), F.count("*").alias("rows")), "kept")
    md5 = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    gone = bounded(found.where("not keeper").select(F.col("doc_id").alias(g_id), F.col("text_md5").alias(g_md5)))
    kept = docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(g_id)) & (md5 == F.col(g_md5)), "left_anti")
    again = found.where("keeper and rows > 1 and node is not null").select(F.col("doc_id").alias(g_id), F.col("text_md5").alias(g_md5))
    if again.isEmpty():
        return kept
    again = bounded(again)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(g_id)) & (md5 == F.col(g_md5))
    return kept.join(again, same, "left_anti").union(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]).select(*columns))
