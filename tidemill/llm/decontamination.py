"""Benchmark passages in documents: shared q-grams counted in diagonal bands, then banded alignment."""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import map_text

Q = 8
SEGMENT, STEP = 100, 50  # characters of a benchmark segment, and from one to the next
RATE = 0.1  # edits allowed per character of a segment
SHORTEST = 25  # characters; shorter items are found where they stand word for word
PACKED = 1 << 31  # documents times segments that one search can number
BLOCK_BYTES = 4 << 20  # benchmark text that is searched for at once
HITS = 1 << 20  # shared q-grams expanded at once
BATCH = 1 << 22  # characters of documents searched at once
TABLE_BITS = 22

_GAP = re.compile(r"[\W_]+")


def normalize(text: str) -> str:
    """Lower case; everything but letters and digits is one space."""
    return _GAP.sub(" ", text.lower()).strip()


def codes(text: str) -> np.ndarray:
    """One byte per character; different characters may share one, equal ones never differ."""
    c = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    return ((c ^ c >> np.uint32(7)) & np.uint32(0xFF)).astype(np.uint8)


def grams(c: np.ndarray) -> np.ndarray:
    """The q-gram that begins at each position, as a number."""
    n = max(0, len(c) - Q + 1)
    return np.ndarray((n,), dtype="<u8", buffer=np.ascontiguousarray(c).data, strides=(1,)).copy() if n else np.zeros(0, dtype=np.uint64)


def _slot(g: np.ndarray) -> np.ndarray:
    return (g * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


class Segments(NamedTuple):
    """What is searched for: segments, and where each of their q-grams stands."""

    item: list[int]  # index of the segment's item
    text: list[str]
    budget: np.ndarray  # edits allowed
    needed: np.ndarray  # q-grams that any match within the budget shares
    gram: np.ndarray  # sorted
    segment: np.ndarray
    at: np.ndarray
    width: int  # step between bands; each band is twice as wide
    table: np.ndarray  # q-gram present, by hash
    short: dict[str, list[int]]  # items too short for an edit budget, by text
    words: list[int]  # how many words these have


def segments(texts: list[str | None]) -> Segments:
    item, parts, short = [], [], {}
    for i, t in enumerate(texts):
        t = normalize(t or "")
        if 0 < len(t) < SHORTEST:
            short.setdefault(t, []).append(i)
        elif t:
            begins = [*range(0, max(1, len(t) - SEGMENT), STEP), max(0, len(t) - SEGMENT)]
            for b in sorted(set(begins)):
                item.append(i)
                parts.append(t[b:b + SEGMENT])
    length = np.array([len(p) for p in parts], dtype=np.int64)
    # the q-gram lemma: a match with k edits shares length - q + 1 - k q of them; short segments get the budget that leaves one
    budget = np.minimum((length * RATE).astype(np.int64), np.maximum(0, (length - Q) // Q))
    all_grams = [grams(codes(p)) for p in parts]
    gram = np.concatenate(all_grams or [np.zeros(0, dtype=np.uint64)])
    segment = np.repeat(np.arange(len(parts)), [len(g) for g in all_grams])
    at = np.concatenate([np.arange(len(g)) for g in all_grams] or [np.zeros(0, dtype=np.int64)])
    order = np.argsort(gram, kind="stable")
    table = np.zeros(1 << TABLE_BITS, dtype=bool)
    table[_slot(gram)] = True
    return Segments(item, parts, budget, length - Q + 1 - budget * Q, gram[order], segment[order], at[order],
                    int(budget.max(initial=0)) + 1, table, short, sorted({t.count(" ") + 1 for t in short}))


def whole_words(text: str, s: Segments) -> dict[int, tuple[int, int, int, int]]:
    """Short items that are whole words of a normalised text: item -> (1, 0, begin of the first place, end of the last one)."""
    words, found = text.split(" "), {}
    begin = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])]).tolist()
    for k in s.words:
        for j in range(len(words) - k + 1):
            # a run too long for a short item is not put together
            if begin[j + k] - 1 - begin[j] < SHORTEST:
                for i in s.short.get(text[begin[j]:begin[j + k] - 1], ()):
                    found[i] = (1, 0, found[i][2] if i in found else begin[j], begin[j + k] - 1)
    return found


def bands(text: np.ndarray, owner: np.ndarray, s: Segments) -> np.ndarray:
    """(owner, segment, band) rows of the bands that share enough q-grams; ``owner`` is the document at each position."""
    g = grams(text)
    at = np.flatnonzero(s.table[_slot(g)])
    first, last = np.searchsorted(s.gram, g[at], "left"), np.searchsorted(s.gram, g[at], "right")
    at, first, n = at[last > first], first[last > first], (last - first)[last > first]
    keys, found, spent = [], [], np.cumsum(n)
    for part in np.split(np.arange(len(at)), np.searchsorted(spent, np.arange(HITS, spent[-1] if len(spent) else 0, HITS))):
        if len(part):
            where = np.repeat(at[part], n[part])
            k = np.arange(len(where)) - np.repeat(np.cumsum(n[part]) - n[part], n[part]) + np.repeat(first[part], n[part])
            band = (where - s.at[k] + SEGMENT) // s.width  # never negative
            both = np.concatenate([band, band - 1])
            key = (np.tile(owner[where], 2) * len(s.text) + np.tile(s.segment[k], 2)) * (1 << 32) + both + 1
            u, c = np.unique(key, return_counts=True)
            keys.append(u)
            found.append(c)
    if not keys:
        return np.zeros((0, 3), dtype=np.int64)
    u, back = np.unique(np.concatenate(keys), return_inverse=True)
    c = np.bincount(back, weights=np.concatenate(found))
    pair = u >> 32
    seg = pair % len(s.text)
    ok = c >= np.maximum(1, s.needed[seg])
    return np.stack([pair[ok] // len(s.text), seg[ok], (u[ok] & 0xFFFFFFFF) - 1], axis=1)


def align(pattern: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of ``pattern`` against any part of each window along its diagonals, and the diagonal where it ends.

    ``windows`` has a row for each candidate, as long as the pattern and the band's width together.
    """
    width = windows.shape[1] - len(pattern) + 1
    step = np.arange(width)
    row = np.zeros((len(windows), width), dtype=np.int64)
    for i, c in enumerate(pattern):
        now = row + (windows[:, i:i + width] != c)
        now[:, :-1] = np.minimum(now[:, :-1], row[:, 1:] + 1)
        row = np.minimum.accumulate(now - step, axis=1) + step
    return row.min(axis=1), row.argmin(axis=1)


def search(texts: list[str], s: Segments) -> list[dict[int, tuple[int, int, int, int]]]:
    """For each normalised text: item -> (segments found, least edits, begin, end) in characters of the text."""
    exact = [whole_words(t, s) if s.short else {} for t in texts]
    if not s.text:
        return exact
    if len(texts) * len(s.text) >= PACKED:
        half = len(texts) // 2
        if not half:
            raise ValueError(f"{len(s.text)} segments in one block")
        return search(texts[:half], s) + search(texts[half:], s)
    result: list[dict[int, tuple[int, int, int, int]]] = [{} for _ in texts]
    points = [np.frombuffer(t.encode("utf-32-le", "replace"), dtype=np.uint32) for t in texts]
    gap = np.zeros(Q, dtype=np.uint8)
    joined = np.concatenate([x for t in texts for x in (codes(t), gap)] or [gap])
    size = np.array([len(p) + Q for p in points], dtype=np.int64)
    begin = np.cumsum(size) - size
    hits = bands(joined, np.repeat(np.arange(len(texts)), size), s)
    order = np.argsort(hits[:, 1], kind="stable")
    hits = hits[order]
    for seg, rows in ((r[0, 1], r) for r in np.split(hits, np.flatnonzero(np.diff(hits[:, 1])) + 1) if len(r)):
        pattern = np.frombuffer(s.text[seg].encode("utf-32-le", "replace"), dtype=np.uint32)
        span = len(pattern) + 2 * s.width - 1
        for part in np.array_split(rows, len(rows) // 2048 + 1):
            windows = np.full((len(part), span), 0xFFFFFFFF, dtype=np.uint32)
            starts = part[:, 2] * s.width - SEGMENT - begin[part[:, 0]]
            for k, (doc, b) in enumerate(zip(part[:, 0], starts)):
                piece = points[doc][max(0, b):max(0, b + span)]
                windows[k, max(0, -b):max(0, -b) + len(piece)] = piece
            edits, end = align(pattern, windows)
            for (doc, _, _), e, d, b in zip(part, edits, end, starts):
                if e <= s.budget[seg]:
                    lo = int(max(0, b + d))
                    old = result[doc].get(s.item[seg])
                    new = (seg, int(e), lo, min(lo + len(pattern), len(points[doc])))
                    seen = ({seg}, *new[1:]) if old is None else (old[0] | {seg}, min(old[1], new[1]), min(old[2], lo), max(old[3], new[3]))
                    result[doc][s.item[seg]] = seen
    return [{i: (len(v[0]), *v[1:]) for i, v in r.items()} | e for r, e in zip(result, exact)]


HIT = ("row", "n_segments", "edits", "begin", "end")
HITS_FIELD = T.StructField("__hits", T.ArrayType(T.StructType(
    [T.StructField(HIT[0], T.IntegerType())] + [T.StructField(c, T.LongType()) for c in HIT[1:]])))


def _blocks(benchmark: DataFrame, item: str, passage: str):
    """Item ids and search function of each block: the benchmark's rows by hash, about ``BLOCK_BYTES`` of text each."""
    listed = benchmark.select(F.col(item).alias(item), F.col(passage).alias("__passage"))
    volume = listed.agg(F.sum(F.octet_length("__passage"))).first()[0] or 0
    n = int(volume // BLOCK_BYTES) + 1
    for block in range(n):
        rows = listed.where(F.pmod(F.xxhash64("__passage", item), F.lit(n)) == block).collect()
        shared = benchmark.sparkSession.sparkContext.broadcast([r[1] for r in rows])

        def make(shared=shared):
            s = segments(shared.value)
            kind = pa.list_(pa.struct([(HIT[0], pa.int32())] + [(c, pa.int64()) for c in HIT[1:]]))

            def run(texts):
                clean = [normalize((t or b"").decode("utf-8", "replace")) for t in texts]
                hits, begin, size = [], 0, 0
                for i, t in enumerate(clean):
                    size += len(t)
                    if size >= BATCH or i == len(clean) - 1:
                        hits += search(clean[begin:i + 1], s)
                        begin, size = i + 1, 0
                return [pa.array([[dict(zip(HIT, (i, *v))) for i, v in sorted(h.items())] for h in hits], kind)]

            return run

        yield [r[0] for r in rows], make


def contaminated(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item: str = "item_id",
                 passage: str = "text") -> DataFrame:
    """A row for each document row and benchmark item of which it holds a segment: ``keep`` columns, ``item``,
    ``n_segments`` found, ``edits`` (fewest of a segment), ``begin`` and ``end`` (characters of the normalised text).

    Both sides are compared in lower case with every run of other characters than letters and digits as one space. Items are
    cut into overlapping segments of 100 characters (the whole item if shorter), and a segment is found within one edit per ten
    characters. An item under 25 characters is found where it stands word for word. By the q-gram lemma a match keeps a known number of 8-grams within
    one of the overlapping diagonal bands; bands that reach it are aligned exactly.

    Null texts on either side are empty, and rows of null item id are compared like any other. Repeated documents give repeated rows,
    repeated benchmark rows one result each. Either table may be empty. Whole texts are searched.

    The benchmark is searched in blocks of about ``BLOCK_BYTES``, assigned by hash; one block is all a task gets.
    """
    spark, found = docs.sparkSession, None
    kept = [c for c in keep if c not in (item, *HIT)]
    for names, make in _blocks(benchmark, item, passage):
        hit = map_text(docs, kept, F.col(text), make, [HITS_FIELD]).where(F.size("__hits") > 0).select(*kept, F.explode("__hits").alias("h"))
        kind = benchmark.schema[item].dataType
        named = spark.createDataFrame(list(enumerate(names)), T.StructType([T.StructField("__row", T.IntegerType()), T.StructField(item, kind)]))
        hit = hit.join(F.broadcast(named), F.col("h.row") == F.col("__row")).select(
            *kept, item, "h.n_segments", "h.edits", "h.begin", "h.end")
        found = hit if found is None else found.union(hit)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", passage: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no segment of any benchmark item; see ``contaminated``. No shuffle."""
    columns = docs.columns
    for _, make in _blocks(benchmark, item, passage):
        docs = map_text(docs, columns, F.col(text), make, [HITS_FIELD]).where(F.size("__hits") == 0).select(*columns)
    return docs
