"""Merkle manifest of a table: a tree for each group of rows, one over the groups, and proofs of every row.

Rows are laid out in one order (group, id, digest) and cut into blocks of ``BLOCK`` leaves. A block proves all its rows at once by
an octopus multiproof: from the range of leaves it holds in each tree follow, level by level, the fewest node coordinates
it can't derive; these are fetched once, the shared interior nodes are worked out in the block, and each row's own proof
is read off them.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import Scratch
from tidemill.operators.ordered import dense_index

BITS = 4
RUN = 1 << BITS  # nodes under one node
BLOCK = 2048  # leaves that are proven together
TOP = -1  # number of the tree over the groups


class Manifest(NamedTuple):
    leaves: DataFrame  # tree, pos, n (leaves of the tree), block, at (place in the order), leaf, and the kept columns
    nodes: DataFrame  # tree, level (from 1; from 0 in the tree over the groups), idx, digest
    groups: DataFrame  # tree, the group's column, n
    n_groups: int


def digest(parts: list[Column]) -> Column:
    """Lowercase SHA-256 hex of the parts, concatenated."""
    return F.sha2(F.concat_ws("", *parts), 256)


def leaf_digest(columns: list[str | Column]) -> Column:
    """Digest of a row: each column's UTF-8 byte count, ``:`` and value; ``-`` for null."""
    return digest([_field(F.col(c) if isinstance(c, str) else c) for c in columns])


def _field(column: Column) -> Column:
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def _height(n: Column) -> Column:
    """Levels above the leaves of a tree of ``n`` leaves."""
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(60 // BITS)), lambda i: F.pow(F.lit(RUN), i).cast("long") < n))


def _levels(n: int) -> int:
    """The same of a number."""
    count = 0
    while n > 1:
        n, count = -(-n // RUN), count + 1
    return count


def _count(n: Column, level: Column) -> Column:
    """Nodes of a level."""
    width = F.pow(F.lit(RUN), level).cast("long")
    return F.ceil(n / width).cast("long")


def _grow(leaves: DataFrame, n: int, scratch: Scratch) -> list[DataFrame]:
    """(tree, n, level, idx, digest) of each level above ``leaves`` (tree, n, idx, digest); n: nodes of the level's tree.

    ``n``: leaves of the largest tree. A run has at most 16 nodes, so nothing grows with a tree's size.
    """
    out, level = [], leaves
    for k in range(1, _levels(n) + 1):
        run = F.array_sort(F.collect_list(F.struct("idx", "digest")))
        grown = level.where("n > 1").groupBy("tree", "n", F.expr(f"idx div {RUN}").alias("up")).agg(
            digest([F.transform(run, lambda x: x["digest"])]).alias("digest"))
        level = scratch.write(grown.select(
            "tree", F.expr(f"(n + {RUN - 1}) div {RUN}").alias("n"), F.lit(k).alias("level"), F.col("up").alias("idx"), "digest"), "merkle-nodes")
        out.append(level)
    return out


def build(docs: DataFrame, group: str, id_column: str, columns: list[str], more: dict[str, Column] | None = None) -> Manifest:
    """The trees of all rows: ``columns`` make a row's leaf, rows of one ``group`` a tree, in order of ``id_column``.

    ``more`` are columns to carry along with the leaves. A group of any size is spread: order, nodes and proofs go by ranges and runs.

    Nulls: a null group is a group of its own and the first, null ids come first in their group. Rows that share an id are
    ordered by their digest. Other columns are not read. An empty table has no trees.
    """
    scratch = Scratch(docs.sparkSession)
    given = {"group": F.col(group), "id": F.col(id_column), "leaf": leaf_digest(columns), **(more or {})}
    rows = docs.select(*[c.alias(k) for k, c in given.items()])
    order = [F.col("group").asc_nulls_first(), F.col("id").asc_nulls_first(), "leaf"]
    placed = scratch.write(dense_index(rows, order, out="at"), "merkle-order")
    groups = placed.groupBy("group").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    groups = scratch.write(dense_index(groups, ["first"], out="tree", unique=True), "merkle-groups")
    n_groups, largest = groups.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    leaves = placed.alias("p").join(groups.alias("g"), F.col("p.group").eqNullSafe(F.col("g.group"))).select(
        "g.tree", (F.col("at") - F.col("first")).alias("pos"), "n", F.expr(f"at div {BLOCK}").alias("block"), "at",
        F.col("p.group").alias("group"), *[c for c in placed.columns if c not in ("at", "group")])
    leaves = scratch.write(leaves, "merkle-leaves")
    ground = leaves.select("tree", "n", F.lit(0).alias("level"), F.col("pos").alias("idx"), F.col("leaf").alias("digest"))
    levels = _grow(ground, largest, scratch)
    subroots = ground.where("n = 1")
    for level in levels:
        subroots = subroots.unionByName(level.where("n = 1"))
    top = scratch.write(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(n_groups).cast("long").alias("n"), F.lit(0).alias("level"),
                                        F.col("tree").alias("idx"), "digest"), "merkle-subroots")
    nodes = top
    for level in [*levels, *_grow(top, n_groups, scratch)]:
        nodes = nodes.unionByName(level)
    return Manifest(leaves, nodes.select("tree", "level", "idx", "digest"), groups.select("tree", "group", "n"), n_groups)


def multiproof(manifest: Manifest) -> DataFrame:
    """(block, tree, level, idx, digest): for each block, every node that proves its leaves and can't be derived from them.

    A block holds a range of each of its trees, and a range of the trees themselves. On each level the range's first and last run may
    lack nodes on the outside, nothing else; with these, the next level's range is known whole.
    """
    spans = manifest.leaves.groupBy("block", "tree", "n").agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
    over = manifest.leaves.groupBy("block").agg(F.min("tree").alias("a"), F.max("tree").alias("b")).select(
        "block", F.lit(TOP).cast("long").alias("tree"), F.lit(manifest.n_groups).cast("long").alias("n"), "a", "b")
    each = spans.unionByName(over).withColumn("h", _height(F.col("n"))).where("h > 0")
    each = each.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("h") - 1)))
    width = F.pow(F.lit(RUN), F.col("level")).cast("long")
    each = each.select("block", "tree", "level", F.floor(F.col("a") / width).alias("lo"), F.floor(F.col("b") / width).alias("hi"),
                       (_count(F.col("n"), F.col("level")) - 1).alias("last"))
    before = F.sequence(F.col("lo") - F.col("lo") % RUN, F.col("lo"))
    after = F.sequence(F.col("hi"), F.least(F.col("hi") - F.col("hi") % RUN + RUN - 1, "last"))
    outside = F.filter(F.concat(before, after), lambda i: (i < F.col("lo")) | (i > F.col("hi")))
    missing = each.select("block", "tree", "level", F.explode(outside).alias("idx"))
    # leaves that another block lacks lie within a run of a block's ends
    edge = (F.col("at") % BLOCK < RUN - 1) | (F.col("at") % BLOCK > BLOCK - RUN)
    edges = manifest.leaves.where(edge).select("tree", F.lit(0).alias("level"), F.col("pos").alias("idx"), F.col("leaf").alias("digest"))
    return missing.join(manifest.nodes.unionByName(edges), ["tree", "level", "idx"]).select("block", "tree", "level", "idx", "digest")


def _hash(parts: str) -> str:
    return hashlib.sha256(parts.encode()).hexdigest()


class _Block:
    """What a block knows: its trees' leaves, the fetched nodes, and from both the nodes around the way of each leaf to the root."""

    def __init__(self, n_groups: int, leaves: dict[int, tuple[int, dict[int, str]]], fetched: dict[tuple[int, int], dict[int, str]]):
        self.fetched, self.sides, self.proofs, self.folds = fetched, {}, {}, {}
        self.heights = {tree: _levels(n) for tree, (n, _) in leaves.items()}
        self.subroots = {tree: self._climb(tree, n, known) for tree, (n, known) in leaves.items()}
        self.root = self._climb(TOP, n_groups, self.subroots)

    def _climb(self, tree: int, n: int, known: dict[int, str]) -> str:
        """The top of a tree, from the nodes known on its lowest level; notes each node's siblings, left and right, place and run."""
        level = 0
        while n > 1:
            whole, above = known | self.fetched.get((tree, level), {}), {}
            for up in {i // RUN for i in known}:
                run = [whole[i] for i in range(up * RUN, min(up * RUN + RUN, n))]
                above[up] = _hash("".join(run))
                for k in range(len(run)):
                    if up * RUN + k in known:
                        self.sides[tree, level, up * RUN + k] = "".join(run[:k]), "".join(run[k + 1:]), k, len(run)
            known, n, level = above, -(-n // RUN), level + 1
        return next(iter(known.values()))

    def leaf(self, tree: int, pos: int) -> tuple[int, int, int]:
        """Coordinates of a leaf; a tree's only leaf is its subroot, a leaf of the tree over the groups."""
        return (tree, 0, pos) if self.heights[tree] else (TOP, 0, tree)

    def _up(self, tree: int, level: int, idx: int) -> tuple[int, int, int]:
        return (TOP, 0, tree) if tree != TOP and level + 1 == self.heights[tree] else (tree, level + 1, idx // RUN)

    def proof(self, node) -> tuple[str, tuple, tuple]:
        if node not in self.sides:
            return "", (), ()
        if node not in self.proofs:
            left, right, place, width = self.sides[node]
            siblings, places, widths = self.proof(self._up(*node))
            self.proofs[node] = left + right + siblings, (place, *places), (width, *widths)
        return self.proofs[node]

    def fold(self, node, given: str) -> str:
        """The root, if ``given`` stood in the node's place."""
        if node not in self.sides:
            return given
        if (node, given) not in self.folds:
            left, right, *_ = self.sides[node]
            self.folds[node, given] = self.fold(self._up(*node), _hash(left + given + right))
        return self.folds[node, given]


def prove(manifest: Manifest, claimed: str | None = None) -> DataFrame:
    """Every leaf with its proof: kept columns, ``leaf``, ``subroot``, ``root``, ``proof``, ``places``, ``widths``, ``folded_root``.

    ``proof``: the siblings' digests as one text, level by level up to the root, left to right; ``places`` and ``widths``: on each level the node's
    place in its run and the run's size. ``folded_root``: the root that follows from the proof and the column ``claimed``, a digest put in
    the place of the leaf (null, or no such column: the leaf itself).
    """
    kept = [f for f in manifest.leaves.schema.fields if f.name not in ("tree", "pos", "n", "block", "at", "leaf", "group", claimed)]
    names = [f.name for f in kept]
    made = ["leaf string", "subroot string", "root string", "proof string", "places array<int>", "widths array<int>", "folded_root string"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + made)
    n_groups = manifest.n_groups

    def expand(rows: pa.Table, nodes: pa.Table) -> pa.Table:
        leaves, fetched = {}, {}
        read = [rows.column(c).to_pylist() for c in ("tree", "pos", "n", "leaf", claimed or "leaf")]
        for tree, pos, n, leaf, _ in zip(*read):
            leaves.setdefault(tree, (n, {}))[1][pos] = leaf
        for tree, level, idx, found in zip(*[nodes.column(c).to_pylist() for c in ("tree", "level", "idx", "digest")]):
            fetched.setdefault((tree, level), {})[idx] = found
        block = _Block(n_groups, leaves, fetched)
        out = []
        for tree, pos, _, leaf, given in zip(*read):
            node = block.leaf(tree, pos)
            out.append((block.subroots[tree], block.root, *block.proof(node), block.fold(node, given or leaf)))
        types = [pa.string(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string()]
        columns = [rows.column(c) for c in [*names, "leaf"]] + [pa.array(c, t) for c, t in zip(zip(*out), types)]
        return pa.Table.from_arrays(columns, names=[*names, *[m.split()[0] for m in made]])

    nodes = multiproof(manifest).toDF("block", "tree", "level", "idx", "digest")  # columns of its own: both sides read the leaves
    return manifest.leaves.groupBy("block").cogroup(nodes.groupBy("block")).applyInArrow(expand, schema)
