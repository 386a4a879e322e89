"""Near-copies by SimHash: fingerprints, links between near fingerprints by anchor points, groups."""

from __future__ import annotations

from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import Scratch, components, map_text

SEED = 42
BLOCK = 1 << 16  # shingles whose bits are counted at once
GOLAY = 0xAE3  # fixed value: generator polynomial of the binary Golay code of length 23
PIECE = 4096  # members of an anchor that are compared in one group
WIDE = 32  # groups beyond this size are searched breadth first


def fingerprint(text: bytes | None, shingle: int) -> int:
    """64-bit SimHash of the words of ``text``; a bit is set if over half the shingles have it. No words: 0."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    n = max(1, len(words) - shingle + 1)
    starts = [0, *ends[: n - 1]]
    stops = ends[shingle - 1:] if len(words) >= shingle else ends[-1:]
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, n, BLOCK):
        hashes = [xxhash.xxh64_digest(joined[a:b - 1], SEED) for a, b in zip(starts[i:i + BLOCK], stops[i:i + BLOCK])]
        bits = np.unpackbits(np.frombuffer(b"".join(hashes), dtype=np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", shingle: int = 4) -> DataFrame:
    """``keep`` columns and ``fp`` (bigint, the fingerprint's bits) of every row; null text has no words."""
    def make():
        return lambda texts: [pa.array([fingerprint(t, shingle) for t in texts], pa.int64())]

    return map_text(docs, keep, F.col(text), make, [T.StructField("fp", T.LongType())])


class Code(NamedTuple):
    """Golay code of length 23: each word has exactly one codeword within 3 bits."""

    syndrome: np.ndarray  # of each of the 2**23 words
    patterns: list[tuple[np.ndarray, np.ndarray]]  # by excess over 3 bits: error patterns by syndrome, and where each begins


def golay(excess: int) -> Code:
    """Syndromes, and all error patterns by how far their weight exceeds the covering radius."""
    words = np.arange(1 << 23, dtype=np.int32)
    left = words.copy()
    for bit in range(22, 10, -1):  # remainder by the generator polynomial
        left ^= np.where(left >> bit & 1, GOLAY << bit - 11, 0).astype(np.int32)
    weight = np.bitwise_count(words)
    patterns = []
    for e in range(excess + 1):
        chosen = words[weight <= 3] if e == 0 else words[weight == 3 + e]
        order = np.argsort(left[chosen], kind="stable")
        patterns.append((chosen[order].astype(np.int64), np.searchsorted(left[chosen][order], np.arange(2049))))
    return Code(left, patterns)


def _spread(code: Code, word: np.ndarray, e: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word the codewords at excess ``e``: (index of the word, codeword)."""
    errors, begin = code.patterns[e]
    s = code.syndrome[word]
    first, n = begin[s], begin[s + 1] - begin[s]
    index = np.repeat(np.arange(len(word)), n)
    at = np.arange(len(index)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    return index, word[index] ^ errors[at]


def anchors(fps: np.ndarray, code: Code, excess: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, anchor) for all anchors that the fingerprints are sent to. See ``near_links``."""
    bits = fps.view(np.uint64)
    low, high = (bits & 0x7FFFFF).astype(np.int64), (bits >> np.uint64(23) & np.uint64(0x7FFFFF)).astype(np.int64)
    found = []
    for e in range(excess + 1):
        i, a = _spread(code, low, e)
        for f in range(excess + 1 - e):
            j, b = _spread(code, high[i], f)
            found.append((fps[i[j]], a[j] << 23 | b))
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _near(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= bits


def _search(members: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links among ``members``: one link for each member that is reached."""
    left, found = np.unique(members), []
    while len(left):
        todo, left = [left[:1]], left[1:]
        while todo and len(left):
            for x in todo.pop():
                hit = _near(left, np.broadcast_to(x, left.shape).copy(), bits)
                if hit.any():
                    found.append((left[hit], np.full(int(hit.sum()), x)))
                    todo.append(left[hit])
                    left = left[~hit]
                if not len(left):
                    break
    return found


def _compare(keys: list[np.ndarray], fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys; rows come sorted by key."""
    change = np.zeros(len(fps), dtype=bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    begin = np.flatnonzero(change)
    size = np.diff(np.append(begin, len(fps)))
    found = []
    for b, n in zip(begin[size > WIDE], size[size > WIDE]):
        found += _search(fps[b:b + n], bits)
    group, small = np.cumsum(change) - 1, np.repeat(size <= WIDE, size)
    for step in range(1, int(size[size <= WIDE].max(initial=1))):
        hit = (group[step:] == group[:-step]) & small[step:] & _near(fps[step:], fps[:-step], bits)
        found.append((fps[step:][hit], fps[:-step][hit]))
    return (np.concatenate([x for x, _ in found] or [fps[:0]]), np.concatenate([y for _, y in found] or [fps[:0]]))


def near_links(fps: DataFrame, scratch: Scratch, bits: int = 4, piece: int = PIECE) -> DataFrame:
    """Links (a, b) between different fingerprints (column fp, each once) that differ in ``bits`` bits or fewer.

    Anchor points: the anchors are the pairs of codewords of two Golay codes, laid over bits 0-22 and 23-45. Each code
    covers its 23 bits with radius 3 and no overlap. If x and y differ in at most ``bits`` bits, some z between
    them differs from each in half of these, rounded up, and the anchor of z lies within the covering radius plus
    that half of both. So a fingerprint goes to all anchors within the radius plus half the threshold (excess summed over
    both codes), and x and y surely meet; 61 anchors a fingerprint for 4 bits, among 2**24. All 64 bits are compared there.

    Links are complete up to connection: a group of over ``WIDE`` members gives a spanning forest of its links, not all of them.
    Anchors with more than ``piece`` members are cut by hash into pieces; each two pieces make a group of their
    own, so that a task never holds more than two pieces of an anchor, and no pair is lost.
    """
    spark = fps.sparkSession
    excess = (bits + 1) // 2
    pairs = T.StructType([T.StructField("fp", T.LongType()), T.StructField("anchor", T.LongType())])

    def spread(batches):
        code = golay(excess)
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(values), 4096):
                fp, anchor = anchors(values[i:i + 4096], code, excess)
                yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(anchor)], names=["fp", "anchor"])

    sent = fps.select("fp").mapInArrow(spread, pairs)
    hot = scratch.write(sent.groupBy("anchor").count().where(F.col("count") > piece).select(
        "anchor", F.ceil(F.col("count") / piece).cast("int").alias("pieces")), "hot-anchors")
    mine = F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int")
    groups = F.when(F.col("pieces").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("pieces") - 1),
                    lambda p: F.struct(F.least(p, mine).alias("i"), F.greatest(p, mine).alias("j"))))
    placed = sent.join(F.broadcast(hot) if hot.count() <= 100_000 else hot, "anchor", "left").select(
        "fp", "anchor", F.explode(groups).alias("g")).select("fp", "anchor", "g.i", "g.j")
    placed = placed.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")

    def compare(batches):
        carry = None
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if carry is not None:
                now = [np.concatenate(x) for x in zip(carry, now)]
            if not len(now[0]):
                continue
            same = (now[1] == now[1][-1]) & (now[2] == now[2][-1]) & (now[3] == now[3][-1])
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0  # the last run may go on
            carry = [x[cut:] for x in now]
            a, b = _compare([x[:cut] for x in now[1:]], now[0][:cut], bits)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        if carry is not None:
            a, b = _compare(carry[1:], carry[0], bits)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    found = placed.mapInArrow(compare, schema)
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def near_groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 4, bits: int = 4) -> DataFrame:
    """Every row's id, ``fp``, ``root`` (the group's key) and ``component_id`` (smallest id of the group).

    Null and wordless texts have fingerprint zero and are linked like any other; equal fingerprints are always one group.
    Repeated rows come out as often as they came in; null ids take part, but are never the smallest id unless alone.
    Other columns are not read. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.write(fingerprints(docs, [id_column], text, shingle), "fingerprints")
    nodes = scratch.write(rows.groupBy("fp").agg(F.min(id_column).alias("least_id")), "nodes")
    links = scratch.write(near_links(nodes, scratch, bits), "near-links")
    roots = components(links, scratch)
    scratch.drop(links)
    by_node = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "least_id")
    least = by_node.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = scratch.write(by_node.join(least, "root").select("fp", "root", "component_id"), "near-groups")
    return rows.join(named, "fp").select(id_column, "fp", "root", "component_id")


def as_hex(column: str):
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))
