"""Merkle manifest of a dataset: a leaf a row, a tree a source, a tree over the sources' roots; proofs by lookup of coordinates.

A node has coordinates (tree, level, at). A tree's shape follows from its number of leaves alone, so a leaf knows from its index which
siblings it needs: it explodes their coordinates, joins the stored table of nodes, orders what it found, concatenates it, and folds it with
itself to the root. Trees are built, and looked up, ``LAYER`` levels at a time: a block of 3^``LAYER`` nodes is what one task holds of a
tree, and a node is asked for by the leaves of its own block only, so that no node near a root is a hot key; what stands above a block is
looked up once for the block and handed to its leaves.

Nulls: a null field is written ``-``; rows without a source are a source of their own, before all others; rows without an id come first in
their source, and the crc32 of no id is that of empty text. Ties: rows of one source and id are ordered by their leaves, so equal rows are
leaves beside each other, with a proof each. Empty texts are fields of no bytes, very long ones are hashed by the scan. An empty table gives
no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import bounded, hot, in_order, saved, split_join

RUN = 3
#: Levels that are built and looked up together, and the leaves of such a block.
LAYER = 6
BLOCK = RUN**LAYER
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def _power(level: Column) -> Column:
    return F.pow(F.lit(float(RUN)), level).cast("long")


def height(n: Column) -> Column:
    """Levels above the leaves of a tree of ``n`` leaves."""
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(38)), lambda level: _power(level) < n))


def leaf(text: Column) -> Column:
    """The leaf of a row whose text is ``text``."""
    fields = (F.col(c).cast("string") if c != "text" else text.cast("string") for c in FIELDS)
    return digest(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in fields))


@dataclass
class Forest:
    """``nodes``: a table for each layer, (tree, level, at, node) with the nodes of its lowest level as far as its highest but one;
    ``trees``: (tree, n, root)."""

    nodes: list[DataFrame]
    trees: DataFrame


def _above(nodes: Column) -> Column:
    """The next level of a block's ``nodes``."""
    runs = F.sequence(F.lit(1), F.ceil(F.size(nodes) / RUN).cast("int"))
    return F.transform(runs, lambda i: F.unhex(F.sha2(F.array_join(F.transform(F.slice(nodes, i * RUN - (RUN - 1), F.lit(RUN)), lambda x: F.lower(F.hex(x))), ""), 256)))


def grown(leaves: DataFrame) -> Forest:
    """The trees over ``leaves`` (tree, at, node), where ``at`` is gapless from 0 in each tree. ``leaves`` is saved."""
    sizes = saved(leaves.groupBy("tree").agg((F.max("at") + 1).alias("n")).withColumn("height", height(F.col("n"))), "tree-sizes")
    top = sizes.agg(F.max("height")).head()[0] or 0
    layers, roots = [], [leaves.join(bounded(sizes.where("height = 0").select("tree", "n")), "tree").select("tree", "n", F.col("node").alias("root"))]
    below = leaves
    for first in range(0, max(top, 1), LAYER):
        sized = split_join(below, sizes.select(F.col("tree").alias("s_tree"), "n", "height"), F.col("tree") == F.col("s_tree"), hot(F.col("n"), sizes.agg(F.sum("n")).head()[0] or 0)).drop("s_tree")
        blocks = sized.where(F.col("height") > first).groupBy("tree", _div(F.col("at"), BLOCK).alias("block"), "n", "height").agg(F.array_sort(F.collect_list(F.struct("at", "node"))).alias("level_0"))
        blocks = blocks.withColumn("level_0", F.transform("level_0", lambda x: x["node"]))
        for k in range(1, LAYER + 1):
            blocks = blocks.withColumn(f"level_{k}", F.when(F.col("height") >= first + k, _above(F.col(f"level_{k - 1}"))).otherwise(F.array().cast("array<binary>")))

        def placed(k: int, first: int = first) -> Column:
            start = F.col("block") * RUN ** (LAYER - k)
            return F.transform(f"level_{k}", lambda x, i: F.struct(F.lit(first + k).alias("level"), (start + i).alias("at"), x.alias("node")))

        made = blocks.select("tree", "n", "height", F.inline(F.flatten(F.array(*(placed(k) for k in range(LAYER + 1))))))
        made = saved(made, "merkle-nodes")
        layers.append(made.where(F.col("level") < first + LAYER).select("tree", "level", "at", "node"))
        roots.append(made.where((F.col("level") == F.col("height")) & (F.col("level") > first)).select("tree", "n", F.col("node").alias("root")))
        below = made.where((F.col("level") == first + LAYER) & (F.col("height") > first + LAYER)).select("tree", "at", "node")
    trees = roots[0]
    for r in roots[1:]:
        trees = trees.unionByName(r)
    return Forest(layers, saved(trees, "merkle-roots"))


def _siblings(first: int, at: Column, n: Column, height_: Column) -> Column:
    """Coordinates (level, at) of what a node of level ``first``, at ``at``, needs of its own layer."""
    last = F.least(height_, F.lit(first + LAYER)) - 1

    def of(level: Column) -> Column:
        own = _div(at, _power(level - first))
        count = _div(n + _power(level) - 1, _power(level))
        run = F.sequence(_div(own, RUN) * RUN, F.least(_div(own, RUN) * RUN + RUN, count) - 1)
        return F.transform(F.filter(run, lambda x: x != own), lambda x: F.struct(level.alias("level"), x.alias("at")))

    return F.when(last >= first, F.flatten(F.transform(F.sequence(F.lit(first), last), of)))


def proofs(leaves: DataFrame, forest: Forest) -> DataFrame:
    """(tree, at, siblings) for each of ``leaves`` (tree, at): its siblings (level, at, node) in order, from its own run to the root's."""
    total = forest.trees.agg(F.sum("n")).head()[0] or 0
    trees = forest.trees.select(F.col("tree").alias("s_tree"), "n", height(F.col("n")).alias("height"))
    tails = None
    for k in reversed(range(len(forest.nodes))):
        first, nodes = k * LAYER, forest.nodes[k]
        asking = leaves.select("tree", "at") if k == 0 else nodes.where(F.col("level") == first).select("tree", "at")
        asking = split_join(asking, trees, F.col("tree") == F.col("s_tree"), hot(F.col("n"), total)).drop("s_tree")
        asked = asking.select("tree", F.col("at").alias("asker"), F.explode_outer(_siblings(first, F.col("at"), F.col("n"), F.col("height"))).alias("c"))
        asked = asked.select("tree", "asker", F.col("c.level").alias("level"), F.col("c.at").alias("at"))
        found = asked.join(nodes, ["tree", "level", "at"], "left").groupBy("tree", "asker").agg(F.array_sort(F.collect_list(F.when(F.col("node").isNotNull(), F.struct("level", "at", "node")))).alias("own"))
        if tails is not None:
            found = found.join(tails, (F.col("tree") == F.col("t_tree")) & (_div(F.col("asker"), BLOCK) == F.col("t_at")), "left").withColumn("own", F.concat("own", F.coalesce("tail", F.array().cast(found.schema["own"].dataType))))
        if k:
            tails = saved(found.select(F.col("tree").alias("t_tree"), F.col("asker").alias("t_at"), F.col("own").alias("tail")), "merkle-tails")
    return found.select("tree", F.col("asker").alias("at"), F.col("own").alias("siblings"))


def folded(value: Column, siblings: Column, at: Column, height_: Column) -> Column:
    """The root that ``value``, a digest's hex text at the leaf ``at``, gives with its ``siblings``."""

    def joined(level: Column, before: bool) -> Column:
        own = _div(at, _power(level))
        return F.array_join(F.transform(F.filter(siblings, lambda x: (x["level"] == level) & ((x["at"] < own) if before else (x["at"] > own))), lambda x: F.lower(F.hex(x["node"]))), "")

    levels = F.when(height_ > 0, F.sequence(F.lit(0), height_ - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(levels, value, lambda v, level: digest(joined(level, True), v, joined(level, False)))


def verified(docs: DataFrame, tampered: Column, tampered_text: Column) -> DataFrame:
    """Per row of ``docs``: its leaf, the roots, a digest of its proof, and whether the row, with ``tampered_text`` where ``tampered``, still
    folds to the root."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))  # null first, else bytewise
    rows = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(leaf(F.col("text"))).alias("node"), F.unhex(F.when(tampered, leaf(tampered_text))).alias("shown"))
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()), "merkle-leaves")
    placed = saved(in_order(rows, "key", ["doc_id", "node", "row"]).drop("row"), "merkle-leaves")
    sources = saved(placed.groupBy("key").agg(F.count("*").alias("size")).withColumn("all", F.lit(0)), "merkle-sources")
    trees = saved(in_order(sources, "all", ["key"]).select("key", "size", F.col("place").alias("tree")), "merkle-sources")
    total = trees.agg(F.sum("size")).head()[0] or 0
    numbered = split_join(placed.withColumnRenamed("key", "l_key"), trees, F.col("l_key") == F.col("key"), hot(F.col("size"), total))
    leaves = saved(numbered.select("tree", F.col("place").alias("at"), "node", "doc_id", "shown"), "merkle-leaves")
    own = grown(leaves.select("tree", "at", "node"))
    subroots = saved(own.trees.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.col("root").alias("node"), "n"), "merkle-subroots")
    over = grown(subroots.select("tree", "at", "node"))
    root = over.trees.select("root", F.col("n").alias("top_n"))
    tops = subroots.join(proofs(subroots, over).select("at", F.col("siblings").alias("top")), "at").crossJoin(F.broadcast(root))  # one row
    tops = saved(tops.select(F.col("at").alias("t_tree"), "n", height(F.col("n")).alias("height"), height(F.col("top_n")).alias("top_height"), F.col("node").alias("subroot"), "root", "top"), "merkle-tops")
    found = leaves.join(proofs(leaves, own), ["tree", "at"])
    found = split_join(found, tops, F.col("tree") == F.col("t_tree"), hot(F.col("n"), total), row_bytes=1000)
    text = {c: F.lower(F.hex(c)) for c in ("node", "shown", "subroot", "root")}
    found = found.select("*", folded(F.coalesce(text["shown"], text["node"]), F.col("siblings"), F.col("at"), F.col("height")).alias("folded_subroot"))
    found = found.select("*", folded(F.col("folded_subroot"), F.col("top"), F.col("tree"), F.col("top_height")).alias("folded_root"))
    proof = F.sha2(F.array_join(F.transform(F.concat("siblings", "top"), lambda x: F.lower(F.hex(x["node"]))), ""), 256)
    return found.select("doc_id", text["node"].alias("leaf"), text["subroot"].alias("subroot"), text["root"].alias("root"), proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == text["root"]).alias("verified"))
