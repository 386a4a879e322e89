"""Packing token pieces into sequences: dominance reduction, then best fit, on the counts of each length."""

from __future__ import annotations

import zlib
from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import Scratch, map_text
from tidemill.llm.encoding import encoder, in_bounds

CAPACITY = 2048
END = 0
LAST = np.array([END], dtype="<u4").tobytes()
SPLITS = 64  # parts of a length whose pieces are numbered apart from each other


def pieces(docs: DataFrame, keep: list[str], tokenizer: str, text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """``keep`` columns with ``piece``, ``start``, ``length`` and ``ids_crc32``, a row for each piece of at most ``capacity`` ids.

    A document's ids are its whole text's, then id 0; null text is empty, so each document has a piece.
    """
    def make():
        encode = encoder(tokenizer)

        def cut(texts):
            rows = []
            for run in in_bounds(texts):
                for ids in encode(run):
                    ids += LAST
                    n = len(ids) // 4
                    rows.append([{"piece": k, "start": s, "length": min(capacity, n - s), "ids_crc32": zlib.crc32(ids[4 * s:4 * (s + capacity)])}
                                 for k, s in enumerate(range(0, n, capacity))])
            return [pa.array(rows, pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])))]

        return cut

    item = T.StructType([T.StructField("piece", T.IntegerType())] + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")])
    got = map_text(docs, keep, F.col(text), make, [T.StructField("__pieces", T.ArrayType(item))])
    return got.select(*keep, F.explode("__pieces").alias("p")).select(*keep, "p.*")


class Placed(NamedTuple):
    """``count`` pieces of one length, numbered from ``first``, go to sequences from ``sequence`` on at ``offset``; ``each`` to a sequence."""

    length: int
    first: int
    count: int
    sequence: int
    offset: int
    each: int


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Placed]:
    """Where the pieces of each length go. Works on counts, so its cost depends on the number of lengths only.

    Dominance reduction: the longest piece left is fixed together with others if their set dominates every other set
    that could hold it. That is proven in three cases: nothing fits beside it, so it stands alone; one piece fills the rest exactly;
    or no two pieces fit beside it, so the longest one that does is best. The rule is used for as long as it fixes
    pieces, longest first, and skips lengths it does not settle. What remains goes by best fit, longest first: into the
    fullest sequence that still has room.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    used, out, sequences = defaultdict(int), [], 0
    open_groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first sequence, how many)

    def put(length, count, sequence, offset, each=1):
        out.append(Placed(length, used[length], count, sequence, offset, each))
        used[length] += count
        left[length] -= count
        if not left[length]:
            del left[length]

    changed = True
    while changed:
        changed = False
        for big in sorted(left, reverse=True):
            while big in left:
                room = capacity - big
                fits = [k for k in left if k <= room and (k != big or left[k] > 1)]
                if not fits:
                    n, mate = left[big], None
                else:
                    mate = max(fits)
                    small = min(fits)
                    two = 2 * small if left[small] > (2 if small == big else 1) else small + min((k for k in fits if k != small), default=capacity)
                    if mate != room and two <= room:
                        break
                    n = left[big] // 2 if mate == big else min(left[big], left[mate])
                put(big, n, sequences, 0)
                if mate is not None:
                    put(mate, n, sequences, big)
                sequences += n
                changed = True

    for length in sorted(left, reverse=True):
        while length in left:
            n = left[length]
            room = min((r for r, groups in open_groups.items() if r >= length and groups), default=None)
            if room is None:
                each = capacity // length
                whole = n // each
                if whole:
                    put(length, whole * each, sequences, 0, each)
                    open_groups[capacity - each * length].append((sequences, whole))
                    sequences += whole
                if n % each:
                    put(length, n % each, sequences, 0, n % each)
                    open_groups[capacity - n % each * length].append((sequences, 1))
                    sequences += 1
                continue
            first, many = open_groups[room].pop()
            each = room // length
            take = min(many, n // each)
            if take:
                put(length, take * each, first, capacity - room, each)
                open_groups[room - each * length].append((first, take))
                if take < many:
                    open_groups[room].append((first + take, many - take))
            else:
                put(length, n, first, capacity - room, n)
                open_groups[room - n * length].append((first, 1))
                if many > 1:
                    open_groups[room].append((first + 1, many - 1))
    return out


def pack(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """A row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id`` and ``offset``.

    Only the number of pieces of each length (at most ``capacity`` numbers) reaches the driver, where it is planned how many
    pieces of each length go where; pieces are then numbered within their length, in parts, and looked up in the plan. Pieces of
    one length are interchangeable, so any numbering will do.

    Null and empty texts are a piece of one id. Repeated rows and null ids are packed like any other row. Other columns are not read. An
    empty table gives no rows.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    cut = scratch.write(pieces(docs, [id_column], tokenizer, text, capacity).withColumn(
        "__part", F.pmod(F.xxhash64(id_column, "piece", "ids_crc32"), F.lit(SPLITS)).cast("int")), "pieces")
    sizes = cut.groupBy("length", "__part").agg(F.count("*").alias("n")).collect()
    before, total = [], defaultdict(int)
    for length, part, n in sorted(sizes):
        before.append((length, part, total[length]))
        total[length] += n
    begins = spark.createDataFrame(before, "length long, __part int, __before long")
    numbered = cut.withColumn("__n", F.row_number().over(Window.partitionBy("length", "__part").orderBy(id_column, "piece", "ids_crc32")) - 1)
    numbered = numbered.join(F.broadcast(begins), ["length", "__part"]).withColumn("__n", F.col("__n") + F.col("__before"))
    rows = plan(dict(total), capacity)
    where: dict[int, list] = defaultdict(list)
    for r in rows:
        where[r.length].append((r.first, r.count, r.sequence, r.offset, r.each))
    table = spark.createDataFrame(
        sorted(where.items()), "length long, __at array<struct<first: long, count: long, sequence: long, offset: long, each: long>>")
    fit = F.filter("__at", lambda r: (r["first"] <= F.col("__n")) & (F.col("__n") < r["first"] + r["count"]))[0]
    placed = numbered.join(F.broadcast(table), "length").withColumn("__r", fit)
    within = F.col("__n") - F.col("__r.first")
    return placed.select(
        id_column, "piece", "start", "length", "ids_crc32",
        (F.col("__r.sequence") + F.floor(within / F.col("__r.each"))).cast("long").alias("sequence_id"),
        (F.col("__r.offset") + (within % F.col("__r.each")) * F.col("length")).cast("long").alias("offset"))
