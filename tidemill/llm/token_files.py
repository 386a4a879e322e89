"""Token ids in files of fixed-width numbers: as many bits for each id as the vocabulary needs.

A shard is one file: a header, the ids of its documents one after the other, packed in blocks of ``BLOCK`` ids, a table with
offset and crc32 of each block, the documents' ids and ends, and a footer that says where these are. All numbers are
little-endian. An id's place follows from its number, so any range of ids is read by the blocks that hold it.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import bound_batches
from tidemill.llm.encoding import encoder, in_bounds
from tidemill.session import materialize

MAGIC = b"TIDEBITS"
BLOCK = 8192  # ids in a block
TEXT_MB = 128  # text of a task that writes
SHARD_MB = 64  # ids of a file
READ_DOCS = 2048  # documents that are read at once
_HEADER = struct.Struct("<8sHHI")  # magic, version, bits, ids in a block
_FOOTER = struct.Struct("<5Q8s")  # ids, documents, blocks, offset of the block table, offset of the document table, magic
_BLOCKS = np.dtype([("offset", "<u8"), ("crc32", "<u4")])
_DOCS = np.dtype([("doc_id", "<i8"), ("named", "u1"), ("end", "<u8")])  # end: ids of the shard up to here
_OUT_MB = 4
_MANIFEST = "part int, shard int, path string, n_docs long, n_ids long, n_bytes long"


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below ``vocabulary``, at least one."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` as numbers of ``bits`` bits each, lowest bit first; the last byte is filled with zeros."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, bits: int, count: int, first: int = 0) -> np.ndarray:
    """``count`` ids of ``pack_bits`` data, from number ``first`` on, without a loop over ids."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count, first * bits // 8).astype("<u4")
    raw = np.frombuffer(data + bytes(4), np.uint8)
    place = np.arange(first, first + count, dtype=np.int64) * bits
    at, shift = place >> 3, (place & 7).astype(np.uint64)
    word = np.zeros(count, dtype=np.uint64)
    for k in range((bits + 14) // 8):  # the bytes that an id can touch
        word |= raw[at + k].astype(np.uint64) << np.uint64(8 * k)
    return ((word >> shift) & np.uint64((1 << bits) - 1)).astype("<u4")


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, on any machine: a plain path, or a URI (file, hdfs, s3, s3a, gs, abfs)."""
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


class ShardWriter:
    """Writes one file, block by block; only the document table is held until the end."""

    def __init__(self, path: str, bits: int):
        fs, inner = _open(path)
        self.path, self.bits = path, bits
        self.out = fs.open_output_stream(inner)
        self.out.write(_HEADER.pack(MAGIC, 1, bits, BLOCK))
        self.written, self.n_ids, self.pending, self.waiting = _HEADER.size, 0, [], 0
        self.blocks: list[tuple[int, int]] = []
        self.docs: list[tuple[int, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.pending.append(ids)
        self.waiting += len(ids)
        self.n_ids += len(ids)
        self.docs.append((doc_id or 0, doc_id is not None, self.n_ids))
        if self.waiting >= 32 * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, "<u4")
        until = len(ids) if last else len(ids) // BLOCK * BLOCK
        for begin in range(0, until, BLOCK):
            data = pack_bits(ids[begin:min(begin + BLOCK, until)], self.bits)
            self.blocks.append((self.written, zlib.crc32(data)))
            self.out.write(data)
            self.written += len(data)
        self.pending, self.waiting = [ids[until:]], len(ids) - until

    def close(self) -> tuple[int, int, int]:
        """(documents, ids, bytes) of the finished file."""
        self._flush(True)
        blocks, docs = np.array(self.blocks, _BLOCKS).tobytes(), np.array(self.docs, _DOCS).tobytes()
        at = self.written
        footer = _FOOTER.pack(self.n_ids, len(self.docs), len(self.blocks), at, at + len(blocks), MAGIC)
        self.out.write(blocks + docs + footer)
        self.out.close()
        return len(self.docs), self.n_ids, at + len(blocks) + len(docs) + len(footer)


class Shard:
    """Random access to one file: of the ids only the asked blocks are read."""

    def __init__(self, path: str):
        fs, inner = _open(path)
        self.path, self.file = path, fs.open_input_file(inner)
        magic, version, self.bits, self.block = _HEADER.unpack(self.file.read_at(_HEADER.size, 0))
        size = self.file.size()
        self.n_ids, self.n_docs, n_blocks, table, docs, end = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if (magic, version, end) != (MAGIC, 1, MAGIC):
            raise ValueError(f"{path} is no token file of this format")
        self.blocks = np.frombuffer(self.file.read_at(n_blocks * _BLOCKS.itemsize, table), _BLOCKS)
        self.docs_at, self.end = docs, table

    def documents(self, first: int, until: int) -> tuple[np.ndarray, np.ndarray]:
        """(the table's rows of documents ``first`` to ``until``, without the latter; where the first one's ids begin)."""
        one = 1 if first else 0
        rows = np.frombuffer(self.file.read_at((until - first + one) * _DOCS.itemsize, self.docs_at + (first - one) * _DOCS.itemsize), _DOCS)
        return rows[one:], int(rows["end"][0]) if one else 0

    def ids(self, first: int, until: int) -> np.ndarray:
        """Ids number ``first`` to ``until`` of the shard, without the latter."""
        if until <= first:
            return np.zeros(0, "<u4")
        low, high = first // self.block, (until - 1) // self.block + 1
        begin = int(self.blocks["offset"][low])
        end = int(self.blocks["offset"][high]) if high < len(self.blocks) else self.end
        data, out = self.file.read_at(end - begin, begin), []
        for b in range(low, high):
            here = int(self.blocks["offset"][b]) - begin
            after = int(self.blocks["offset"][b + 1]) - begin if b + 1 < high else len(data)
            if zlib.crc32(data[here:after]) != self.blocks["crc32"][b]:
                raise ValueError(f"block {b} of {self.path} is damaged")
            a, z = max(first - b * self.block, 0), min(until - b * self.block, self.block)
            out.append(unpack_bits(data[here:after], self.bits, z - a, a))
        return np.concatenate(out)


def write_tokens(
    docs: DataFrame, tokenizer: str, folder: str, end: int, id_column: str = "doc_id", text: str = "text", shard_mb: int = SHARD_MB,
) -> DataFrame:
    """Encode whole texts, add id ``end`` to each, and write them in ascending order of id. Gives the files' table.

    The table (``part``, ``shard``, ``path``, ``n_docs``, ``n_ids``, ``n_bytes``, ``first``: ids in all files before) has a
    row for each file and is what counts: a task that is run again writes files of another name, and those of the lost
    one are not listed. Rows are sorted by Spark, by ranges whose number follows from the bytes of text, and a task begins another file
    after ``shard_mb``, so neither memory nor files grow with the input.

    Null text is empty, and an empty text is the end id alone. Null ids come first. Rows that share an id are all written, ordered by the
    hash of their text and then by the text. Other columns are not read. An empty table gives no files.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    if end < 0:
        raise ValueError("the end id is below 0")
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), body.alias("body"))
    size = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (TEXT_MB << 20)))
    order = ["doc_id", F.xxhash64("body")]
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, "body")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        bits, last = bits_for(max(encode.size, end + 1)), struct.pack("<I", end)
        part, shard, made = TaskContext.get().partitionId(), None, 0

        def finish():
            return pa.RecordBatch.from_pylist([dict(zip(("part", "shard", "path", "n_docs", "n_ids", "n_bytes"), (part, made, shard.path, *shard.close())))],
                                              schema=pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()),
                                                                ("n_ids", pa.int64()), ("n_bytes", pa.int64())]))

        for batch in batches:
            names, at = batch.column(0).to_pylist(), 0
            for run in in_bounds(batch.column(1).to_pylist()):
                for ids in encode(run):
                    if shard is None:
                        shard = ShardWriter(f"{folder}/{part:06d}-{made:04d}-{uuid.uuid4().hex}.tokens", bits)
                    shard.add(names[at], np.frombuffer(ids + last, "<u4"))
                    at += 1
                    if shard.written >= shard_mb << 20:
                        yield finish()
                        shard, made = None, made + 1
        if shard is not None:
            yield finish()
        pa.default_memory_pool().release_unused()

    fs, inner = _open(folder)
    fs.create_dir(inner)
    files = materialize(ordered.mapInArrow(write, _MANIFEST), "token-files")
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)  # over files, not documents
    return files.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(files: DataFrame) -> DataFrame:
    """``doc_id``, ``start`` (ids before it in all files), ``n_tokens`` and ``ids`` (unsigned 32-bit numbers) of every document.

    Files are read in runs of ``READ_DOCS`` documents, spread over the cluster, each by the blocks it needs.
    """
    run = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, F.lit(READ_DOCS).cast("long")))
    runs = files.where("n_docs > 0").select("path", "first", "n_docs", run.alias("low"))
    runs = runs.select("path", "first", "low", F.least(F.col("low") + READ_DOCS, "n_docs").alias("high"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard_of = lru_cache(4)(Shard)
        for batch in batches:
            for row in batch.to_pylist():
                shard = shard_of(row["path"])
                docs, begin = shard.documents(row["low"], row["high"])
                ends = docs["end"].astype(np.int64)
                starts = np.concatenate([[begin], ends[:-1]])
                at = 0
                while at < len(docs):  # rows of a few MB, or one long document
                    z = max(at + 1, int(np.searchsorted(ends, starts[at] + (_OUT_MB << 18), "right")))
                    ids = shard.ids(int(starts[at]), int(ends[z - 1]))
                    cut = starts[at:z] - starts[at]
                    data = [ids[a:b].tobytes() for a, b in zip(cut, ends[at:z] - starts[at])]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(docs["doc_id"][at:z], pa.int64(), mask=docs["named"][at:z] == 0),
                        pa.array(row["first"] + starts[at:z]), pa.array(ends[at:z] - starts[at:z]), pa.array(data, pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"])
                    at = z
        pa.default_memory_pool().release_unused()

    spread = runs.repartition(F.col("path"), F.col("low"))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
