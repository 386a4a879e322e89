"""Exact inner-product search: a cover tree over queries and one over data, searched together."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE = 1024
LEAF = 96  # vectors of a node that is not split further
CENTERS = 48  # children of a node at most
SHRINK = 0.6  # a child's radius aims at this share of its parent's
QUERIES = 2048  # queries searched for in one pass over the data
ROWS = 16384  # data vectors indexed together
SAMPLE = 4096  # data vectors that give each query a first floor
EXACT = 2.0 ** 53


class Node(NamedTuple):
    """Vectors ``begin`` to ``end`` of the tree's order, all within ``radius`` of the center."""

    begin: int
    end: int
    center: np.ndarray
    norm: float
    radius: float
    children: list


def cover_tree(vectors: np.ndarray) -> tuple[np.ndarray, Node]:
    """(order, root). Children's centers are chosen farthest first until they cover the node with a smaller radius; a center keeps its own
    place among its children, and stored radii are the true ones."""
    order = np.arange(len(vectors))

    def build(begin: int, end: int, center: np.ndarray) -> Node:
        here = order[begin:end]
        away = np.linalg.norm(vectors[here] - center, axis=1)
        radius = float(away.max())
        children: list[Node] = []
        if end - begin > LEAF and radius > 0:
            nearest, owner, centers = away.copy(), np.zeros(len(here), dtype=int), [center]
            while nearest.max() > SHRINK * radius and len(centers) < CENTERS:
                far = vectors[here[int(nearest.argmax())]]
                d = np.linalg.norm(vectors[here] - far, axis=1)
                owner[d < nearest] = len(centers)
                nearest = np.minimum(nearest, d)
                centers.append(far)
            if len(centers) > 1:
                by = np.argsort(owner, kind="stable")
                order[begin:end] = here[by]
                ends = begin + np.cumsum(np.bincount(owner, minlength=len(centers)))
                starts = np.concatenate([[begin], ends[:-1]])
                children = [build(int(a), int(b), c) for a, b, c in zip(starts, ends, centers) if b > a]
        return Node(begin, end, center, float(np.linalg.norm(center)), radius, children)

    return order, build(0, len(vectors), vectors[0])


class Best:
    """The k best (score, id) of each query so far; ties go to the smaller id."""

    def __init__(self, ids: np.ndarray, k: int, floor: np.ndarray):
        self.ids, self.k, self.floor = ids, k, floor.copy()
        self.scores = [np.zeros(0, dtype=np.int64)] * len(ids)
        self.found = [np.zeros(0, dtype=np.int64)] * len(ids)

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.scores[q], scores]), np.concatenate([self.found[q], ids])
        top = np.lexsort((i, -s))[:self.k]
        self.scores[q], self.found[q] = s[top], i[top]
        if len(top) == self.k:
            self.floor[q] = max(self.floor[q], s[top][-1])


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if len(a) and len(b) and a.shape[1] * float(np.abs(a).max()) * float(np.abs(b).max()) < EXACT:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T  # exact as long as scores fit 64 bits


def dual_search(queries: np.ndarray, query_tree: tuple[np.ndarray, Node], data: np.ndarray, ids: np.ndarray, best: Best) -> None:
    """Add the data to ``best``. A pair of nodes is left out if even its best possible score is below the worst k-th score
    of the node's queries: center product plus what both radii can add. Pairs with the highest bound come first."""
    q_order, q_root = query_tree
    d_order, d_root = cover_tree(data.astype(float))

    def bound(q: Node, d: Node) -> float:
        return float(q.center @ d.center) + q.radius * d.norm + d.radius * q.norm + q.radius * d.radius

    stack = [(bound(q_root, d_root), q_root, d_root)]
    while stack:
        top, q, d = stack.pop()
        group = q_order[q.begin:q.end]
        if top * (1 + 1e-9 * np.sign(top)) + 1e-6 < best.floor[group].min():
            continue
        if not q.children and not d.children:
            rows = d_order[d.begin:d.end]
            scores = _product(queries[group], data[rows])
            wanted = (scores >= best.floor[group][:, None]) & (best.ids[group][:, None] != ids[rows][None, :])
            for i in np.flatnonzero(wanted.any(axis=1)):
                best.add(int(group[i]), scores[i][wanted[i]], ids[rows][wanted[i]])
            continue
        split_query = q.children and (not d.children or q.radius * d.norm > d.radius * q.norm)
        pairs = [(c, d) for c in q.children] if split_query else [(q, c) for c in d.children]
        stack += sorted(((bound(a, b), a, b) for a, b in pairs), key=lambda x: x[0])


def _integers(column: pa.Array, width: int) -> np.ndarray:
    return np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(float) * SCALE).astype(np.int64).reshape(-1, width)


def usable(vector: Column) -> Column:
    """Neither null nor empty, and without null or non-finite components."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double"))), F.lit(False))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score``: for each row with ``is_query``, the ``k`` rows of another id with the highest integer inner
    product of floor(1024 x); ties go to the smaller id. All rows are searched.

    Queries are searched for in blocks of about ``QUERIES`` by hash, so a task holds one block and ``ROWS`` vectors, whatever the
    input's size. A bounded sample gives each query a floor under its k-th score first; tasks hand on only what reaches it.

    Unusable vectors and rows without id take no part; vectors of different lengths have no product. A repeated row of
    a query is a query of its own with the same answer, which is given once; repeated candidates each count. Fewer rows than ``k`` give all there are.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector).alias("v"), is_query.alias("q")).where(
        usable(F.col("v")) & F.col("id").isNotNull()).select("id", "v", F.size("v").alias("width"), "q")
    asked = rows.where("q").select("id", "v", "width").distinct()
    sizes = asked.groupBy("width").count().collect()
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("query_id", "vec_id", "score")])
    found = spark.createDataFrame([], schema)
    for width, count in sorted((r[0], r[1]) for r in sizes):
        data = rows.where(F.col("width") == width).select("id", "v")
        sample = data.orderBy(F.xxhash64("id", "v")).limit(SAMPLE).toArrow().combine_chunks()
        blocks = -(-count // QUERIES)
        for b in range(blocks):
            block = asked.where((F.col("width") == width) & (F.pmod(F.xxhash64("id", "v"), F.lit(blocks)) == b)).select("id", "v").toArrow().combine_chunks()
            if not block.num_rows:
                continue
            q_ids, q = block.column(0).to_numpy(), _integers(block.column(1).combine_chunks(), width)
            tree = cover_tree(q.astype(float))
            first = Best(q_ids, k, np.full(len(q), np.iinfo(np.int64).min))
            dual_search(q, tree, _integers(sample.column(1).combine_chunks(), width), sample.column(0).to_numpy(), first)
            shared = spark.sparkContext.broadcast((q_ids, q, tree, first.floor))

            def search(batches, shared=shared, width=width):
                q_ids, q, tree, floor = shared.value
                best, ids, parts, n = Best(q_ids, k, floor), [], [], 0

                def index():
                    dual_search(q, tree, np.concatenate(parts), np.concatenate(ids), best)

                for batch in batches:
                    ids.append(batch.column(0).to_numpy())
                    parts.append(_integers(batch.column(1), width))
                    n += batch.num_rows
                    if n >= ROWS:
                        index()
                        ids, parts, n = [], [], 0
                if n:
                    index()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, [len(s) for s in best.scores])), pa.array(np.concatenate(best.found)),
                                                  pa.array(np.concatenate(best.scores))], names=schema.names)

            found = found.union(data.mapInArrow(search, schema))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    ranked = found.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
    return ranked


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""
