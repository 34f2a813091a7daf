"""Merkle manifest of a dataset, with checkpoint-and-recompute proofs.

Rows are leaves; ``FAN_OUT`` consecutive nodes become the digest of their digests until one is
left, first within each source (its subroot), then over the subroots (the root). Only every
``STEP``-th level is stored, as one row per aligned subtree: up to ``FAN_OUT ** STEP`` nodes of a
stored level in order, and the digest they come to. A proof is made from the top down. A
stored subtree meets the proof of the node above it, computes its missing interior digests from
the stored nodes below them, hands each node its siblings, and lets the interior digests go; so what
is written is the leaves and a 256th of them, and proofs exist only inside the task that uses them.

Leaves are numbered by prefix sums over range partitions of (source, id, digest, row), so a
source with most of the rows, or rows repeated many times, spread over many tasks; every later
group has at most ``FAN_OUT ** STEP`` nodes. Only the root, one digest, reaches the driver.

Defined results: a NULL value is hashed as ``-``; rows with a NULL id come first in their source and
rows of one id stand in the order of their digests; a NULL source is a source of its own, before
all others; a lone leaf is its source's subroot, a lone subroot is the root, and a proof without
siblings is the digest of the empty string; an empty table gives no rows. Columns other than the five
hashed ones are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surety.functions.columns import let
from surety.plans.ranking import prefix_sums
from surety.session import materialise

FAN_OUT = 16
STEP = 2
#: A row is tampered with where this divides the unsigned crc32 of its id.
TAMPERED = 5
PATH = "array<struct<left: string, right: string>>"


def field(value: Column) -> Column:
    """``-`` for NULL, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """Digest of one row."""
    return F.sha2(F.concat(*map(field, (doc_id, source, lang, n_chars, text))), 256)


def joined(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings come to."""
    return F.aggregate(path, leaf, lambda node, at: F.sha2(F.concat(at["left"], node, at["right"]), 256))


def siblings(path: Column) -> Column:
    """All siblings of a proof, level by level and left to right, as one string."""
    return F.array_join(F.transform(path, lambda at: F.concat(at["left"], at["right"])), "")


def _children(nodes: Column, height: int) -> Column:
    """Blocks of nodes below the children of a block of ``height`` levels."""
    width = FAN_OUT ** (height - 1)
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / width).cast("int")),
                       lambda c: F.slice(nodes, c * width + 1, F.lit(width)))


def _top(nodes: Column, n: Column, height: int) -> Column:
    """Digest of a block of ``height`` levels over stored nodes, in a level of ``n`` nodes.

    A level that is one node already has no level above it.
    """
    if not height:
        return nodes[0]["digest"]
    here = let(_children(nodes, height), lambda c: joined(F.transform(c, lambda b: _top(b, n, height - 1))))
    return F.when(n > FAN_OUT ** (height - 1), here).otherwise(_top(nodes, n, height - 1))


def _beside(digests: Column, at: Column) -> Column:
    """What stands left and right of a node in its run."""
    return F.struct(F.array_join(F.slice(digests, F.lit(1), at), "").alias("left"),
                    F.array_join(F.slice(digests, at + 2, F.lit(FAN_OUT)), "").alias("right"))


def _handed_down(nodes: Column, n: Column, path: Column, height: int, each: Callable[[Column, Column], Column]) -> Column:
    """``each(block, its path)`` for the children of a block."""
    def with_digests(children: Column, digests: Column) -> Column:
        def child(block: Column, at: Column) -> Column:
            below = F.when(n > FAN_OUT ** (height - 1), F.concat(F.array(_beside(digests, at)), path)).otherwise(path)
            return let(below, lambda whole: each(block, whole))
        return F.transform(children, child)

    return let(_children(nodes, height), lambda children: let(
        F.transform(children, lambda b: _top(b, n, height - 1)), lambda digests: with_digests(children, digests)))


def _subtrees(nodes: DataFrame, step: int) -> DataFrame:
    """Store the aligned subtrees of ``nodes(tree, i, n, digest, ...)`` with the digests they come to.

    ``n`` is the number of nodes of the tree at this level.
    """
    width = FAN_OUT ** step
    extra = [c for c in nodes.columns if c not in ("tree", "i", "n")]
    grouped = nodes.groupBy("tree", F.floor(F.col("i") / width).alias("at")).agg(
        F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", *extra))).alias("nodes"))
    return materialise(grouped.withColumn("digest", _top(F.col("nodes"), F.col("n"), step)))


@dataclass
class Tree:
    """Stored levels of a forest, lowest first, and ``tops(tree, digest)``."""

    levels: list[DataFrame]
    tops: DataFrame
    step: int

    @classmethod
    def of(cls, nodes: DataFrame, step: int = STEP) -> Tree:
        width, levels, tops = FAN_OUT ** step, [], None
        while True:
            levels.append(_subtrees(nodes, step))
            above = levels[-1].select("tree", F.col("at").alias("i"), F.ceil(F.col("n") / width).alias("n"), "digest")
            done = above.where("n = 1").select("tree", "digest")
            tops = done if tops is None else tops.union(done)
            nodes = above.where("n > 1")
            if nodes.isEmpty():
                return cls(levels, tops, step)

    def proofs(self, above: DataFrame, each: Callable[[Column, Column, Column], Column]) -> DataFrame:
        """``each(leaf, top, path)`` of every leaf, a struct whose fields become the columns.

        ``above(tree, top, path)`` continues the proof of a tree's top.
        """
        width = FAN_OUT ** self.step
        paths = None
        for level, stored in reversed(list(enumerate(self.levels))):
            met = stored.where(F.col("n") <= width).join(above, "tree").select("tree", "n", "nodes", "top", "path")
            if paths is not None:
                met = met.union(stored.where(F.col("n") > width).join(paths, ["tree", "at"]).select("tree", "n", "nodes", "top", "path"))
            nodes = met
            for height in range(self.step, 1, -1):
                parts = _handed_down(F.col("nodes"), F.col("n"), F.col("path"), height,
                                     lambda block, path: F.struct(block.alias("nodes"), path.alias("path")))
                nodes = nodes.select("tree", "n", "top", F.explode(parts).alias("_")).select("tree", "n", "top", "_.nodes", "_.path")
            top = F.col("top")
            if level:
                one = _handed_down(F.col("nodes"), F.col("n"), F.col("path"), 1,
                                   lambda block, path: F.struct(block[0]["i"].alias("at"), path.alias("path")))
                paths = materialise(nodes.select("tree", "top", F.explode(one).alias("_")).select("tree", "top", "_.at", "_.path"))
            else:
                one = _handed_down(F.col("nodes"), F.col("n"), F.col("path"), 1, lambda block, path: each(block[0], top, path))
        return nodes.select(F.explode(one).alias("_")).select("_.*")


@dataclass
class Manifest:
    """The stored levels of all sources, and the root."""

    sources: Tree
    tops: DataFrame
    root: str | None

    def proofs(self, each: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
        """``doc_id, leaf, subroot, path`` of every row, or the struct ``each(leaf, subroot, path)``.

        A path lists what stands left and right of the node at every level, from the leaf up. What
        ``each`` makes of it is computed where the path is, so the path itself is written nowhere.
        """
        return self.sources.proofs(self.tops, each or (lambda leaf, subroot, path: F.struct(
            leaf["doc_id"].alias("doc_id"), leaf["digest"].alias("leaf"), subroot.alias("subroot"), path.alias("path"))))


def _numbered(nodes: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Add ``i``, the place in the group, and ``n``, the size of the group."""
    ranked = prefix_sums(nodes.withColumn("_one", F.lit(1)), group, order, ["_one"])
    return ranked.withColumnsRenamed({"_one_before": "i", "_one_total": "n"}).drop("_one")


def build(docs: DataFrame, step: int = STEP) -> Manifest:
    """Store the tree over ``docs(doc_id, source, lang, n_chars, text)``.

    Each stored leaf also has the digest of the row as :func:`tampered` would leave it, NULL where
    that is the same.
    """
    leaf, changed = digests(docs)
    hashed = F.col("leaf")
    rows = materialise(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf.alias("leaf"), changed.alias("changed"),
        F.monotonically_increasing_id().alias("row")))
    ordered = _numbered(rows, ["source"], ["doc_id", "leaf", "row"])
    nodes = ordered.select(field(F.col("source")).alias("tree"), "i", "n", hashed.alias("digest"), "doc_id", F.nullif("changed", "leaf").alias("changed"), "source")
    names = materialise(nodes.where("i = 0").select("tree", "source"))
    sources = Tree.of(nodes.drop("source"), step)

    # The subroots are the leaves of one more tree.
    subroots = materialise(sources.tops).join(names, "tree").withColumn("all", F.lit(0))
    ordered = _numbered(subroots, ["all"], ["source"]).withColumnRenamed("tree", "name").withColumnRenamed("all", "tree")
    upper = Tree.of(ordered.select("tree", "i", "n", "digest", "name"), step)
    top = upper.tops.first()
    whole = docs.sparkSession.createDataFrame([(0, top["digest"], [])] if top else [], f"tree int, top string, path {PATH}")
    tops = upper.proofs(whole, lambda node, root, path: F.struct(node["name"].alias("tree"), node["digest"].alias("top"), path.alias("path")))
    return Manifest(sources, materialise(tops), top["digest"] if top else None)


def tampered(doc_id: Column) -> Column:
    """Rows whose text is lower-cased."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % TAMPERED == 0, F.lit(False))


def lower_cased(text: Column) -> Column:
    """A-Z in lower case."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def digests(docs: DataFrame) -> tuple[Column, Column]:
    """Digest of each row, and its digest after tampering."""
    doc_id, source, lang, n_chars, text = (F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    text = text.cast("string")
    leaf = leaf_of(doc_id, source, lang, n_chars, text)
    return leaf, F.when(tampered(doc_id), leaf_of(doc_id, source, lang, n_chars, lower_cased(text)))


def verify(docs: DataFrame, step: int = STEP) -> DataFrame:
    """Every row's proof, and whether the row, tampered with or not, still comes to the root."""
    manifest = build(docs, step)
    root = F.lit(manifest.root)

    def each(leaf: Column, subroot: Column, path: Column) -> Column:
        return F.struct(leaf["doc_id"].alias("doc_id"), leaf["digest"].alias("leaf"), subroot.alias("subroot"),
                        F.sha2(siblings(path), 256).alias("proof_sha256"), fold(F.coalesce(leaf["changed"], leaf["digest"]), path).alias("folded_root"))

    rows = manifest.proofs(each)
    return rows.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
