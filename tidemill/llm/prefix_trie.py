"""Trie of the turns that conversations have in common, and sums over its subtrees by centroid decomposition.

A node is a sequence of turns that at least one conversation begins with, named by the smallest of these conversations and the
depth; its edges to parents make a tree. A subtree's sums come from splitting: the centroid of a component is its deepest
node that still holds half of the component's weight. What lies below the centroid is summed up once and added along the
path from the centroid to the component's top; then the component falls apart into the parts below the centroid and the
rest above. Every part has at most half of the weight, so the rounds grow with the logarithm of the weight and not with the
trie's depth. The weight of a node is the number of its members, because the sum of that over a subtree is known beforehand:
each member adds the turns that it has from there on. Components of many nodes are split by joins and aggregations, all of a
round at once; the others, each whole in one task, by the same rule in numpy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import Scratch
from tidemill.operators.ordered import dense_index, running

WHOLE = 65_536  # nodes of a component that one task may take
CHUNK = 8192  # conversation ids that are joined into one text
_SUMS = ("s0", "s1", "s2", "s3")
_HASHES = ("h0", "h1", "h2", "h3")
_NODE = ["conv", "depth"]


class Trie(NamedTuple):
    members: DataFrame  # conv, depth, length of the conversation, s0 to s3: a row for each conversation and node it passes
    nodes: DataFrame  # conv (smallest member), depth, parent_conv, n_convs, n_ends, n_children, size, weight, s0 to s3


def numbered(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, pos, d0, d1, size): each conversation's turns in order, 128 bits of their SHA-256, and their texts' UTF-8 bytes.

    Texts are not shuffled, their digests are. Positions come from ranges of one order, so a conversation of any length is spread. Null
    turns come first; equal turns are ordered by their digest. A null role or text is empty. Rows without a conversation are left out.
    """
    who, said = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    whole = F.sha2(F.concat(F.length(who).cast("string"), F.lit(":"), who, said), 256)  # the length parts role and text
    rows = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("conv"), F.col(turn).alias("turn"), whole.alias("whole"), F.octet_length(said).cast("long").alias("size"))
    bits = [F.conv(F.substring("whole", a, 16), 16, -10).cast("long").alias(d) for a, d in ((1, "d0"), (17, "d1"))]
    rows = rows.select("conv", "turn", *bits, "size")
    return dense_index(rows, [F.col("turn").asc_nulls_first(), "d0", "d1"], ["conv"], out="pos", unique=True).drop("turn")


def build(turns: DataFrame, lengths: DataFrame, scratch: Scratch) -> Trie:
    """The trie of ``turns`` (conv, pos from 0, d0, d1, size), for all conversations of ``lengths`` (conv, length).

    A prefix is known by the sum of hashes of its turns with their positions, in four numbers of 32 bits, so that prefixes of a
    conversation of any length are running sums over ranges. A conversation without turns is a member of the root only.
    No conversation, no node.
    """
    pieces = [F.shiftrightunsigned(F.xxhash64("pos", "d0", "d1"), 32), F.xxhash64("pos", "d0", "d1").bitwiseAND(0xFFFFFFFF),
              F.shiftrightunsigned(F.xxhash64("d1", F.lit(1), "pos", "d0"), 32), F.xxhash64("d1", F.lit(1), "pos", "d0").bitwiseAND(0xFFFFFFFF)]
    hashed = turns.select("conv", "pos", "length", "size", *[p.alias(h) for p, h in zip(pieces, _HASHES)])
    summed = running(hashed, ["pos"], {s: ("sum", F.col(h)) for s, h in zip(_SUMS, _HASHES)}, ["conv"], unique=True)
    zero = F.lit(0).cast("long")
    starts = lengths.select("conv", zero.alias("depth"), "length", zero.alias("size"), *[zero.alias(c) for c in (*_HASHES, *_SUMS)])
    members = scratch.write(summed.select(
        "conv", (F.col("pos") + 1).alias("depth"), "length", "size", *_HASHES, *_SUMS).unionByName(starts), "trie-members")
    ends = F.col("depth") == F.col("length")
    nodes = members.groupBy("depth", *_SUMS).agg(
        F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.sum(F.col("length") - F.col("depth") + 1).alias("weight"),
        F.max("size").alias("size"), F.sum(ends.cast("long")).alias("n_ends"), *[F.max(h).alias(h) for h in _HASHES])
    nodes = scratch.write(nodes, "trie-nodes")
    over = nodes.select(F.col("conv").alias("parent_conv"), (F.col("depth") + 1).alias("depth"), *[F.col(s).alias(f"p{s}") for s in _SUMS])
    before = [(F.col(s) - F.col(h)).alias(f"p{s}") for s, h in zip(_SUMS, _HASHES)]
    linked = nodes.select("*", *before).join(over, ["depth", *[f"p{s}" for s in _SUMS]], "left")
    linked = scratch.write(linked.select("conv", "depth", "parent_conv", "n_convs", "n_ends", "size", "weight", *_SUMS), "trie-links")
    children = linked.where("depth > 0").groupBy(F.col("parent_conv").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = scratch.write(linked.join(children, _NODE, "left").fillna(0, "n_children"), "trie-nodes")
    return Trie(members.select("conv", "depth", "length", *_SUMS), nodes)


def subtree_sums(parent: np.ndarray, depth: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (nodes, columns) over the subtree of every node of a forest, by centroid decomposition.

    ``parent``: each node's, a top's is itself; ``weight``: sum over the subtree of positive weights.
    """
    n = len(parent)
    link, weight, out = parent.copy(), weight.copy(), np.zeros_like(values)
    open_nodes = np.ones(n, dtype=bool)

    def tops():
        at = link
        while not np.array_equal(up := at[at], at):
            at = up
        return at

    while open_nodes.any():
        top = tops()
        path = np.flatnonzero(open_nodes & (2 * weight >= weight[top]))  # from every component's top to its centroid
        path = path[np.argsort(depth[path], kind="stable")]
        centroid = np.full(n, -1)
        centroid[top[path]] = path  # the deepest one is put last
        centroid = centroid[top]
        chosen = np.unique(centroid[path])
        link[chosen] = chosen
        below = tops()
        inside = np.flatnonzero(open_nodes & (below == centroid))
        total = np.zeros_like(values)
        np.add.at(total, below[inside], values[inside])
        out[path] += total[centroid[path]]
        above = path[path != centroid[path]]
        weight[above] -= weight[centroid[above]]
        open_nodes[chosen] = False
        is_chosen = np.zeros(n, dtype=bool)
        is_chosen[chosen] = True
        cut = np.flatnonzero(open_nodes & is_chosen[parent])
        link[cut] = cut
    return out


def _split(state: DataFrame, big: DataFrame, values: list[str], passed: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """One round for the components of ``big`` (comp, comp_depth, top): (rows still open, centroids, which are done)."""
    comp = ["comp", "comp_depth"]
    mine = state.join(big, comp).withColumn("path", F.col("weight") * 2 >= F.col("top"))
    centroid = scratch.write(mine.where("path").groupBy(*comp).agg(
        F.max("depth").alias("c_depth"), F.max_by("conv", "depth").alias("c_conv"), F.max_by("weight", "depth").alias("c_weight")), "trie-centroids")
    mine = mine.join(centroid, comp)
    child = F.col("depth") > F.col("c_depth")
    # which node a node's smallest member passes just below the centroid's depth
    deeper = mine.where(child).withColumn("look", F.col("c_depth") + 1).join(
        passed.select(F.col("conv"), F.col("depth").alias("look"), F.col("node").alias("a_conv"), F.col("parent").alias("a_parent")), ["conv", "look"])
    deeper = deeper.withColumn("below", F.col("a_parent") == F.col("c_conv")).drop("look", "a_parent")
    upper = mine.where(~child).withColumn("a_conv", F.col("conv")).withColumn("below", (F.col("depth") == F.col("c_depth")) & (F.col("conv") == F.col("c_conv")))
    marked = scratch.write(deeper.unionByName(upper), "trie-marked")
    totals = marked.where("below").groupBy(*comp).agg(*[F.sum(v).alias(f"t_{v}") for v in values])
    found = marked.join(scratch.write(totals, "trie-totals"), comp)
    is_centroid = F.col("below") & (F.col("depth") == F.col("c_depth"))
    moved = F.col("below") & ~is_centroid
    added = {f"sum_{v}": F.when(F.col("path"), F.col(f"sum_{v}") + F.col(f"t_{v}")).otherwise(F.col(f"sum_{v}")) for v in values}
    found = found.withColumns({
        **added, "weight": F.when(F.col("path") & ~is_centroid, F.col("weight") - F.col("c_weight")).otherwise(F.col("weight")),
        "__done": is_centroid, "__moved": moved})
    found = found.withColumns({"comp": F.when(F.col("__moved"), F.col("a_conv")).otherwise(F.col("comp")),
                               "comp_depth": F.when(F.col("__moved"), F.col("c_depth") + 1).otherwise(F.col("comp_depth"))})
    rest = state.join(big, comp, "left_anti").withColumn("__done", F.lit(False))
    after = scratch.write(found.select(*state.columns, "__done").unionByName(rest), "trie-state")
    return after.where("NOT __done").drop("__done"), after.where("__done").drop("__done")


def rollup(trie: Trie, values: dict[str, Column], keep: list[str], scratch: Scratch) -> DataFrame:
    """conv, depth, ``keep`` and ``sum_<name>`` of every node: the sum of each value (a long of the node's columns) over its subtree."""
    names = list(values)
    root = trie.nodes.where("depth = 0").select(F.col("conv").alias("comp"), F.col("depth").alias("comp_depth"))
    first = root.first()
    zero = F.lit(0).cast("long")
    state = trie.nodes.select(
        *_NODE, "parent_conv", "weight", *[k for k in keep if k != "parent_conv"], *[v.cast("long").alias(n) for n, v in values.items()],
        *[zero.alias(f"sum_{n}") for n in names],
        F.lit(first.comp if first else None).cast("long").alias("comp"), zero.alias("comp_depth"))
    done, passed = [], None
    while True:
        sizes = state.groupBy("comp", "comp_depth").agg(F.count("*").alias("n"), F.max("weight").alias("top"))
        big = scratch.write(sizes.where(F.col("n") > WHOLE).drop("n"), "trie-components")
        if big.isEmpty():
            break
        if passed is None:
            found = trie.members.join(trie.nodes.select(F.col("conv").alias("node"), F.col("parent_conv").alias("parent"), "depth", *_SUMS), ["depth", *_SUMS])
            smallest = trie.nodes.select("conv").distinct()  # only these are asked for
            passed = scratch.write(found.select("conv", "depth", "node", "parent").join(smallest, "conv", "left_semi"), "trie-paths")
        state, finished = _split(state, big, names, passed, scratch)
        done.append(finished)

    columns = state.columns

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(rows: pa.Table) -> pa.RecordBatch:
            conv, depth, up, comp, comp_depth, weight = (
                rows.column(c).fill_null(0).to_numpy() for c in ("conv", "depth", "parent_conv", "comp", "comp_depth", "weight"))
            is_top = (conv == comp) & (depth == comp_depth)
            up = np.where(is_top, conv, up)
            ids = np.unique(conv)
            place = depth * len(ids) + np.searchsorted(ids, conv)
            order = np.argsort(place)
            wanted = np.where(is_top, place, (depth - 1) * len(ids) + np.searchsorted(ids, up))
            parent = order[np.searchsorted(place, wanted, sorter=order)]
            given = np.stack([rows.column(n).to_numpy() for n in names], axis=1) if names else np.zeros((len(conv), 0), np.int64)
            sums = subtree_sums(parent, depth, weight, given)
            for k, n in enumerate(names):
                at = rows.schema.get_field_index(f"sum_{n}")
                rows = rows.set_column(at, f"sum_{n}", pa.array(rows.column(at).to_numpy() + sums[:, k]))
            return rows.combine_chunks().to_batches()

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
            if held.num_rows > WHOLE:  # all but the last component are whole
                comp = np.stack([held.column(c).to_numpy() for c in ("comp", "comp_depth")])
                begin = int(np.flatnonzero((comp != comp[:, -1:]).any(axis=0))[-1]) + 1 if (comp != comp[:, -1:]).any() else 0
                if begin:
                    yield from solved(held.slice(0, begin))
                    held = held.slice(begin)
        if held is not None and held.num_rows:
            yield from solved(held)

    together = state.repartition("comp", "comp_depth").sortWithinPartitions("comp", "comp_depth")
    out = together.mapInArrow(finish, state.schema)
    for finished in done:
        out = out.unionByName(finished)
    return out.select(*[c for c in columns if c not in ("comp", "comp_depth", "weight", *names)])


def end_digests(trie: Trie) -> DataFrame:
    """conv, depth and ``ends_sha256`` of every node: SHA-256 of the ids of the conversations that end there, ascending, comma-joined.

    Ids of nodes where many end are sorted by ranges and joined to texts of ``CHUNK`` ids there; one task then feeds a node's texts to the hash in their
    order, one at a time, as that hash can't be split.
    """
    single = trie.nodes.where("n_ends < 2")
    node = trie.nodes.where("n_ends > 1").select(F.col("conv").alias("node"), "depth", *_SUMS)
    enders = trie.members.where("depth = length")
    only = single.where("n_ends = 1").select(F.col("conv").alias("node"), "depth", *_SUMS).join(
        enders.select(F.col("conv").alias("id"), "depth", *_SUMS), ["depth", *_SUMS], "inner").select("node", "depth", F.sha2(F.col("id").cast("string"), 256).alias("ends_sha256"))
    none = single.where("n_ends = 0").select(F.col("conv").alias("node"), "depth", F.sha2(F.lit(""), 256).alias("ends_sha256"))
    many = enders.select(F.col("conv").alias("id"), "depth", *_SUMS).join(node, ["depth", *_SUMS]).select("node", "depth", "id")
    in_order = many.repartitionByRange("node", "depth", "id").sortWithinPartitions("node", "depth", "id")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, depth, ids = (c.to_numpy() for c in batch.columns)
            new = np.flatnonzero((np.diff(node) != 0) | (np.diff(depth) != 0)) + 1
            cuts = sorted({0, len(ids), *new.tolist(), *range(0, len(ids), CHUNK)})
            if len(ids):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[cuts[:-1]]), pa.array(depth[cuts[:-1]]), pa.array(ids[cuts[:-1]]),
                     pa.array([",".join(map(str, ids[a:b].tolist())) for a, b in zip(cuts, cuts[1:])])], names=["node", "depth", "id", "text"])

    chunks = in_order.mapInArrow(join, "node long, depth long, id long, text string")

    def feed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def row():
            return pa.RecordBatch.from_pylist([{"node": now[0], "depth": now[1], "ends_sha256": state.hexdigest()}])

        for batch in batches:
            for n, d, text in zip(*[batch.column(c).to_pylist() for c in (0, 1, 3)]):
                if (n, d) != now:
                    if now:
                        yield row()
                    now, state = (n, d), hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
        if now:
            yield row()

    hashed = chunks.repartition("node", "depth").sortWithinPartitions("node", "depth", "id").mapInArrow(feed, "node long, depth long, ends_sha256 string")
    return none.unionByName(only).unionByName(hashed).withColumnRenamed("node", "conv")
