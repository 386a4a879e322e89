"""Repeated byte strings across all texts: sampled suffixes are sorted first, all others are induced from them."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import bound_batches, releasing, Scratch

LENGTH = 200
REACH = 128  # positions among which a suffix finds its sample
NAMED = LENGTH - REACH + 1  # bytes that every string of LENGTH shares with its sample's suffix
BLOCK = 1 << 19  # suffixes hashed at once, under 2**24; longer texts are taken in pieces
PART = 16  # induced suffixes that travel together

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def _mix(x: np.ndarray, k: int) -> np.ndarray:
    x = x * _M[k]
    x ^= x >> np.uint64(32)
    return x * _M[(k + 1) % len(_M)]


def _join(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    return _mix(a * _M[(k + 2) % len(_M)] + (b ^ b >> np.uint64(29)), k)


class Names:
    """64-bit names of the strings of 8, 16, ... 128 bytes at each position of a block; longer ones are put together."""

    def __init__(self, block: np.ndarray):
        n = len(block)
        raw = np.ndarray((max(0, n - 7),), dtype="<u8", buffer=np.ascontiguousarray(block).data, strides=(1,)) if n >= 8 else np.zeros(0, dtype=np.uint64)
        self.by = {8: _mix(raw, 0)}
        size = 8
        while size < 128:
            h = self.by[size]
            self.by[2 * size] = _join(h[:max(0, len(h) - size)], h[size:], size.bit_length() % len(_M))
            size *= 2

    def whole(self, at: np.ndarray) -> np.ndarray:
        """Of the LENGTH bytes at each position."""
        return _join(_join(self.by[128][at], self.by[64][at + 128], 1), self.by[8][at + 192], 2)

    def sample(self, at: np.ndarray) -> np.ndarray:
        """Of the NAMED bytes at each position."""
        return _join(self.by[64][at], self.by[8][at + NAMED - 8], 3)


def _blocks(texts: list[bytes | None], limit: int):
    """(block of bytes, for each text in it: its row, where it begins there, offset of that place in the text, number of suffixes)."""
    parts, meta, size = [], [], 0

    def flush():
        return np.frombuffer(b"".join(parts), dtype=np.uint8), np.array(meta, dtype=np.int64).reshape(-1, 4)

    for row, t in enumerate(texts):
        suffixes = len(t or b"") - LENGTH + 1
        for offset in range(0, max(0, suffixes), limit):
            n = min(limit, suffixes - offset)
            piece = t[offset:offset + n + LENGTH - 1]
            if size + len(piece) > limit and parts:
                yield flush()
                parts, meta, size = [], [], 0
            meta.append((row, size, offset, n))
            parts.append(piece)
            size += len(piece)
    if parts:
        yield flush()


def samples(texts: list[bytes | None], limit: int = BLOCK):
    """(row, first suffix, last suffix, sample, its name, name of all they cover) for each sample.

    A suffix belongs to the position among its next ``REACH`` whose 8 bytes have the least hash, the leftmost of equals. This
    depends on nothing but the first bytes of the suffix, so equal strings of ``LENGTH`` belong to samples at the same distance, and
    the suffixes of a sample are consecutive.
    """
    for block, meta in _blocks(texts, limit):
        names = Names(block)
        key = (names.by[8] & ~np.uint64(0xFFFFFF)) | np.arange(len(names.by[8]), dtype=np.uint64)
        step = 1
        while step < REACH:
            key = np.minimum(key[:-step], key[step:])
            step *= 2
        begin, n = meta[:, 1], meta[:, 3]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
        own = (key[at] & np.uint64(0xFFFFFF)).astype(np.int64)
        piece = np.repeat(np.arange(len(meta)), n)
        first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (piece[1:] != piece[:-1])]))
        last = np.append(first[1:], len(at)) - 1
        low, high, sample, p = at[first], at[last], own[first], piece[first]
        shift = meta[p, 2] - begin[p]
        whole = _join(names.whole(low), names.whole(high), 4) + (high - low).astype(np.uint64)
        yield meta[p, 0], low + shift, high + shift, sample + shift, names.sample(sample).view(np.int64), whole.view(np.int64)


def _pack(low, high, sample, known):
    return low << 16 | (high - low) << 9 | (sample - low) << 1 | known


def _unpack(packed):
    return packed >> 16, (packed >> 16) + (packed >> 9 & 0x7F), (packed >> 16) + (packed >> 1 & 0xFF)


def _sampled(docs: DataFrame, kind, limit: int) -> DataFrame:
    schema = T.StructType([T.StructField("id", kind), T.StructField("hash", T.LongType()), T.StructField("name", T.LongType()),
                           T.StructField("covered", T.LongType()), T.StructField("place", T.LongType())])

    def run(batches):
        for batch in batches:
            for row, low, high, sample, name, covered in samples(batch.column(2).to_pylist(), limit):
                # what occurs twice here is known to repeat: one of these speaks for all to the other tasks
                order = np.lexsort((covered, name))
                same = (name[order][1:] == name[order][:-1]) & (covered[order][1:] == covered[order][:-1])
                known, follower = np.zeros(len(name), dtype=np.int64), np.zeros(len(name), dtype=bool)
                known[order[1:][same]] = 1
                known[order[:-1][same]] = 1
                follower[order[1:][same]] = True
                place = _pack(low, high, sample, known)
                name = np.where(follower, (place * 0x9E3779B1) ^ covered ^ row, name)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(name), pa.array(covered), pa.array(place)],
                                                 names=schema.names)

    return docs.mapInArrow(releasing(run), schema)


def _squeezed(docs: DataFrame, kind) -> DataFrame:
    """The texts compressed, for exchanges."""
    schema = T.StructType([T.StructField("id", kind), T.StructField("hash", T.LongType()), T.StructField("z", T.BinaryType())])

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([squeeze(t) for t in batch.column(2).to_pylist()], pa.binary())],
                                             names=schema.names)

    return docs.mapInArrow(releasing(run), schema)


def _induced(docs: DataFrame, kind, limit: int) -> DataFrame:
    """From texts with undecided samples: names of all their suffixes, ``PART`` at a time."""
    schema = T.StructType([T.StructField("id", kind), T.StructField("hash", T.LongType()), T.StructField("name", T.LongType()),
                           T.StructField("part", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("names", T.ArrayType(T.LongType()))])

    def run(batches):
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            texts = [open_(z) for z in batch.column(2).to_pylist()]
            undecided = [([x["name"] for x in u], *_unpack(np.array([x["place"] for x in u], dtype=np.int64))) for u in batch.column(3).to_pylist()]
            for block, meta in _blocks(texts, limit):
                names, out = Names(block), []
                for row, begin, offset, n in meta.tolist():
                    whole = names.whole(np.arange(begin, begin + n)).view(np.int64)
                    for name, low, high, sample in zip(*(x if isinstance(x, list) else x.tolist() for x in undecided[row])):
                        if low < offset + n and high >= offset:
                            for part in range((sample - high) // PART, (sample - low) // PART + 1):
                                a, b = max(low, offset, sample - PART * part - PART + 1), min(high, offset + n - 1, sample - PART * part)
                                if a <= b:
                                    out.append((row, name, part, a, whole[a - offset:b + 1 - offset]))
                for i in range(0, len(out), 20_000):
                    row, name, part, first, lists = zip(*out[i:i + 20_000])
                    at = pa.array(row)
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(at), batch.column(1).take(at), pa.array(name, pa.int64()), pa.array(part, pa.int32()), pa.array(first, pa.int64()),
                         pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists)))], names=schema.names)

    return docs.mapInArrow(releasing(run), schema)


def _cut(docs: DataFrame, kind, with_kept: bool) -> DataFrame:
    longs = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    kept_bytes = [T.StructField("kept", T.BinaryType())] if with_kept else []
    schema = T.StructType([T.StructField("id", kind), *longs, *kept_bytes, T.StructField("kept_sha256", T.StringType())])

    def run(batches):
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for z, places, points in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                text = open_(z)
                low, high, _ = _unpack(np.array(places or [], dtype=np.int64))
                points = np.array(points or [], dtype=np.int64)
                change = np.zeros(len(text) + 1, dtype=np.int64)
                np.add.at(change, np.concatenate([low, points]), 1)
                np.add.at(change, np.concatenate([high, points]) + LENGTH, -1)
                gone = np.cumsum(change[:-1]) > 0
                kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                rows.append((len(text), int(gone.sum()), spans, *([kept] if with_kept else []), hashlib.sha256(kept).hexdigest()))
            types = [pa.int64()] * 3 + [pa.binary()] * with_kept + [pa.string()]
            cols = list(zip(*rows)) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=schema.names)

    return docs.mapInArrow(releasing(run), schema)


def dedup_bytes(docs: DataFrame, id_column: str = "doc_id", text: str = "text", limit: int = BLOCK, with_kept: bool = True) -> DataFrame:
    """A row per document: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (the remaining bytes, if wanted) and ``kept_sha256``.

    Removed is each byte covered by a string of 200 bytes that starts at another place, too, in any document.

    Suffixes are compared to a depth of 200. In a first round only sampled suffixes are sorted, by the name of their first 73 bytes,
    which every string of 200 shares with its sample, and then by the name of all that the sample's own suffixes cover.
    The neighbours in this order decide: no neighbour with that prefix, and none of these suffixes can repeat; an equal neighbour, and all do.
    Only samples beside a different one of the same prefix go on, which are the ends of repeated passages and one witness of each
    passage: the suffixes before such a sample are induced from it, as tuples of the sample's name, the distance and their own name, and a
    second sort puts equal ones beside each other. Both sorts are Spark's external
    ones, which spill to disk. Names have 64 bits, and two are compared (128 bits) wherever a repeat is stated.

    Null texts are empty; texts under 200 bytes lose nothing. Repeated rows are places of their own, so all their bytes from 200 on go.
    Null ids are ids like any other. Other columns are not read. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_column].dataType
    plain = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    plain = plain.select("id", F.xxhash64("t").alias("hash"), F.encode("t", "UTF-8").alias("bytes"))

    order = Window.partitionBy("name").orderBy("covered")
    before, after = F.lag("covered").over(order), F.lead("covered").over(order)
    sure = (F.col("place").bitwiseAND(F.lit(1)) == 1) | F.coalesce(before == F.col("covered"), F.lit(False)) | F.coalesce(after == F.col("covered"), F.lit(False))
    # beside a different neighbour of the same prefix: undecided, or needed to decide that one
    mixed = F.coalesce(before != F.col("covered"), F.lit(False)) | F.coalesce(after != F.col("covered"), F.lit(False))
    near = _sampled(plain, kind, limit).select("id", "hash", "name", "place", sure.alias("sure"), mixed.alias("mixed")).where("sure OR mixed")
    decided = near.groupBy("id", "hash").agg(
        F.collect_list(F.when(F.col("sure"), F.col("place"))).alias("places"),
        F.collect_list(F.when(F.col("mixed"), F.struct("name", "place"))).alias("undecided"))
    decided = scratch.write(decided, "suffix-samples")

    texts = scratch.write(_squeezed(plain, kind), "suffix-texts")
    open_ones = decided.where(F.size("undecided") > 0).select(F.col("id").alias("i"), F.col("hash").alias("h"), "undecided")
    met = texts.join(open_ones.hint("merge"), F.col("id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h"))).select("id", "hash", "z", "undecided")
    tuples = _induced(met, kind, limit).repartition("name", "part").select("id", "hash", "name", "part", "first", F.posexplode("names").alias("nth", "own"))
    equal = Window.partitionBy("name", "part", "own").orderBy("hash")
    repeated = tuples.select("id", "hash", (F.col("first") + F.col("nth")).alias("at"), (
        F.lag("own").over(equal).isNotNull() | F.lead("own").over(equal).isNotNull()).alias("again")).where("again")
    points = scratch.write(repeated.groupBy("id", "hash").agg(F.collect_set("at").alias("points")), "suffix-points")

    a = decided.where(F.size("places") > 0).select(F.col("id").alias("i"), F.col("hash").alias("h"), "places")
    b = points.select(F.col("id").alias("j"), F.col("hash").alias("g"), "points")
    joined = texts.join(a.hint("merge"), F.col("id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h")), "left").join(
        b.hint("merge"), F.col("id").eqNullSafe(F.col("j")) & (F.col("hash") == F.col("g")), "left")
    return _cut(joined.select("id", "hash", "z", "places", "points"), kind, with_kept).withColumnRenamed("id", id_column)
