"""Exact k nearest neighbours, pruned by pivots.

References go to the nearest of some pivots, and the references of a pivot to chunks by their distance from it, so a chunk is a ring
around its pivot; queries are put into chunks in the same way. A query looks into one chunk of its own pivot to learn how far its k-th neighbour
can be at most. By the triangle inequality a ring can hold something nearer only if its radii, as seen from the query, reach within that
bound, and a pivot's whole cell only if the query is near enough to the plane between the two pivots. (After Lu, Shen, Chen and Ooi:
Efficient processing of k nearest neighbor joins using MapReduce, 2012.)

What is noted of all this is which chunks of queries meet which chunks of references, in narrow rows without vectors. Vectors move in slabs of
many chunks (at most ``SLAB_BYTES`` and one chunk): a slab of queries meets a slab of references in one task, which compares the chunks
that meet as matrices, and narrows each query's bound as it goes. So where nothing can be left out the work is that of all pairs, but each
vector is copied once for a slab of the other side, not once for each query or chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.arrays import mode_first_seen
from tidemill.operators.ordered import dense_index, running
from tidemill.session import materialize

MAX_PIVOTS = 1024
PIVOT_BYTES = 16 << 20  # of all pivots together: they travel with the tasks
SLAB_BYTES = 8 << 20  # vectors of either side that a task holds at once
TILE = 1 << 21  # distances worked out at once
_SLACK = 1e-9  # relative; what rounding may do to a bound
_BEST = "qid bigint, rid bigint, distance double, label int"


class Cells(NamedTuple):
    pivots: np.ndarray
    low: np.ndarray  # smallest and largest distance from the pivot in each cell
    high: np.ndarray
    near: np.ndarray  # the k smallest distances in each cell, infinite where there are fewer


def usable(vector: str) -> Column:
    """Whether a vector has components, and all are numbers."""
    v = F.col(vector)
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double"))), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances, worked out directly: a product of matrices would lose digits that bounds rely on."""
    out = np.empty((len(a), len(b)))
    for begin in range(0, len(a), step := max(1, TILE // max(1, b.size))):
        out[begin:begin + step] = np.sqrt(((a[begin:begin + step, None, :] - b[None]) ** 2).sum(axis=2))
    return out


def _pieces(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a matrix of ``columns`` numbers a row stays small."""
    for batch in batches:
        for begin in range(0, batch.num_rows, step := max(1, TILE // columns)):
            yield batch.slice(begin, step)


def _pivots(references: DataFrame, rows: int) -> np.ndarray:
    """About the square root of the references' number, drawn by a hash of the id; bounded in number and in bytes."""
    width = references.select(F.size("v")).first()[0]
    n = max(1, min(int(rows ** 0.5), MAX_PIVOTS, PIVOT_BYTES // (8 * width)))
    return np.unique(np.array([r.v for r in references.orderBy(F.xxhash64("id"), "id").limit(n).select("v").collect()]), axis=0)


def _to_cells(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add ``cell`` (nearest pivot) and ``dist`` (from it)."""
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, len(pivots)):
            d = _distances(_matrix(batch.column("v")), pivots)
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype("int32")), pa.array(d[np.arange(len(d)), cell])], names=[*batch.schema.names, "cell", "dist"])

    return df.mapInArrow(assign, ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in df.schema], "cell int", "dist double"]))


def _slab_rows(width: int) -> int:
    return max(1, SLAB_BYTES // (8 * width))


def _chunked(df: DataFrame, pivots: np.ndarray, block_rows: int, name: str) -> DataFrame:
    """Add ``cell``, ``dist``, ``chunk`` (rings of at most ``block_rows`` rows, from the pivot outwards) and ``slab`` (successive chunks)."""
    celled = materialize(_to_cells(df, pivots), "neighbour-cells")  # the sort reads it twice
    placed = dense_index(celled, ["dist", "id"], ["cell"], out="place")
    placed = materialize(placed.withColumn("chunk", F.expr(f"int(place div {block_rows})")).drop("place"), f"neighbour-{name}")
    sizes = running(placed.groupBy("cell", "chunk").agg(F.count("*").alias("n")), ["cell", "chunk"], {"upto": ("sum", F.col("n"))}, unique=True)
    slabs = sizes.select("cell", "chunk", F.expr(f"int((upto - n) div {_slab_rows(pivots.shape[1])})").alias("slab"))
    return placed.join(materialize(slabs, "neighbour-slabs"), ["cell", "chunk"])


class _Found:
    """The k best references met so far by each of some queries, of those within the queries' bounds."""

    def __init__(self, queries: np.ndarray, bound: np.ndarray, k: int):
        self.queries, self.bound, self.k = queries, bound.copy(), k
        self.norm = (queries ** 2).sum(axis=1)
        self.wide = np.hstack([queries, np.ones((len(queries), 1))])
        self.distance = np.full((len(queries), k), np.inf)
        self.rank = np.full((len(queries), k), np.iinfo(np.int64).max)  # of the reference among all by id
        self.row = np.full((len(queries), k), -1)

    def meet(self, asked: np.ndarray, refs: np.ndarray, rank: np.ndarray, first: int) -> None:
        """Compare the queries numbered ``asked`` with references; ``first`` is the row of the first one."""
        norm = (refs ** 2).sum(axis=1)
        other = np.vstack([-2 * refs.T, norm])
        for begin in range(0, len(asked), step := max(1, TILE // len(refs))):
            some = asked[begin:begin + step]
            whole = len(some) == len(self.wide)
            near = (self.wide if whole else self.wide[some]) @ other  # squared distance, less the query's own square
            slack = _SLACK * (1 + self.norm[some] + norm.max())
            # whatever rounding of the product may hide stays a candidate; its distance is then worked out directly
            within = near <= (self.bound[some] ** 2 - self.norm[some] + slack)[:, None]
            many = np.flatnonzero(np.count_nonzero(within, axis=1) > self.k)
            if len(many):
                limit = np.partition(near[many], self.k - 1, axis=1)[:, self.k - 1] + slack[many]
                within[many] &= near[many] <= limit[:, None]
            q, r = np.nonzero(within)
            for at in range(0, len(q), pairs := max(1, TILE // refs.shape[1])):
                self._add(some[q[at:at + pairs]], r[at:at + pairs], refs, rank, first)

    def _add(self, q: np.ndarray, r: np.ndarray, refs: np.ndarray, rank: np.ndarray, first: int) -> None:
        d = np.sqrt(((refs[r] - self.queries[q]) ** 2).sum(axis=1))
        seen = np.unique(q)
        asked = np.concatenate([q, np.repeat(seen, self.k)])
        distance = np.concatenate([d, self.distance[seen].ravel()])
        ranks, rows = np.concatenate([rank[r], self.rank[seen].ravel()]), np.concatenate([first + r, self.row[seen].ravel()])
        order = np.lexsort((ranks, distance, asked))
        begin = np.searchsorted(asked[order], seen)
        best = order[begin[:, None] + np.arange(self.k)]  # each query has at least k entries
        self.distance[seen], self.rank[seen], self.row[seen] = distance[best], ranks[best], rows[best]
        self.bound[seen] = np.minimum(self.bound[seen], self.distance[seen, -1])


def _compare(k: int):
    """Function of (queries, references) of a pair of slabs: the k best references of each query, of the chunks that it meets."""
    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.table({"qid": pa.array([], pa.int64()), "rid": pa.array([], pa.int64()), "distance": pa.array([], pa.float64()),
                             "label": pa.array([], pa.int32())})
        a, b = a.sort_by("block"), b.sort_by([("cell", "ascending"), ("chunk", "ascending")]).combine_chunks()
        asked, refs = (_matrix(x.column("v").combine_chunks()) for x in (a, b))
        ids = b.column("id").combine_chunks()
        rank = np.empty(len(b), dtype=np.int64)
        rank[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(b))
        found = _Found(asked, a.column("bound").fill_null(np.inf).to_numpy(), k)
        blocks = a.column("block").to_numpy()
        cell, chunk = (b.column(c).to_numpy() for c in ("cell", "chunk"))
        edges = [0, *(np.flatnonzero((np.diff(cell) != 0) | (np.diff(chunk) != 0)) + 1), len(b)]
        for begin, end in zip(edges, edges[1:]):
            met = b.column("blocks")[begin].values.to_numpy()
            rows = np.flatnonzero(np.isin(blocks, met))
            if len(rows):
                found.meet(rows, refs[begin:end], rank[begin:end], begin)
        q, place = np.nonzero(found.row >= 0)
        row = pa.array(found.row[q, place])
        return pa.table({"qid": a.column("id").take(pa.array(q)), "rid": ids.take(row), "distance": pa.array(found.distance[q, place]),
                         "label": b.column("label").take(row)})

    return compare


def _meet(asked: DataFrame, references: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """The k best of each query in each slab of references, of the chunks that ``visits`` names.

    ``visits``: (qslab, block, cell, chunk, slab); a block is a chunk of queries. A chunk of references is copied for each slab of queries that
    visits it, a slab of queries for each slab of references.
    """
    at = ["qslab", "slab"]
    met = materialize(visits.groupBy(*at, "cell", "chunk").agg(F.collect_set("block").alias("blocks")), "neighbour-meetings")
    copies = references.select("cell", "chunk", "id", "v", "label").join(met, ["cell", "chunk"])
    copies = copies.toDF(*copies.columns)  # columns of its own: both sides read the meetings
    pairs = asked.select("qslab", "block", "id", "v", "bound").join(met.select(*at).distinct(), "qslab")
    return pairs.groupBy(*at).cogroup(copies.groupBy(*at)).applyInArrow(_compare(k), _BEST)


def _best(found: DataFrame, k: int) -> DataFrame:
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("distance", "rid")))
    return ranked.filter(F.col("rank") <= k)


def _cells(references: DataFrame, pivots: np.ndarray, k: int) -> Cells:
    """Bounds of every cell: at most ``MAX_PIVOTS`` rows."""
    n = len(pivots)
    low, high, near = np.full(n, np.inf), np.full(n, -np.inf), np.full((n, k), np.inf)
    first = Window.partitionBy("cell").orderBy("dist")
    nearest_ = references.where("chunk = 0").withColumn("r", F.row_number().over(first)).where(F.col("r") <= k).groupBy("cell").agg(
        F.sort_array(F.collect_list("dist")).alias("near"))
    for r in references.groupBy("cell").agg(F.min("dist").alias("low"), F.max("dist").alias("high")).collect():
        low[r.cell], high[r.cell] = r.low, r.high
    for r in nearest_.collect():
        near[r.cell, :len(r.near)] = r.near
    return Cells(pivots, low, high, near)


def _bounded(queries: DataFrame, cells: Cells, k: int) -> DataFrame:
    """The queries with ``bound`` narrowed by the k smallest radii around all pivots."""
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, cells.near.size):
            d = _distances(_matrix(batch.column("v")), cells.pivots)
            bound = batch.column("bound").fill_null(np.inf).to_numpy()
            if cells.near.size >= k:
                reach = (d[:, :, None] + cells.near[None]).reshape(len(d), -1)
                bound = np.minimum(bound, np.partition(reach, k - 1, axis=1)[:, k - 1])
            bound = bound + _SLACK * (1 + d.max(axis=1))
            yield batch.set_column(batch.schema.get_field_index("bound"), "bound", pa.array(bound))

    return queries.mapInArrow(look, queries.schema)


def _candidates(queries: DataFrame, cells: Cells) -> DataFrame:
    """(qslab, block, cell, low, high): the cells that may hold one of the k nearest of a block's queries, and between which radii."""
    between = _distances(cells.pivots, cells.pivots)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, len(cells.pivots)):
            d = _distances(_matrix(batch.column("v")), cells.pivots)
            own, block, slab = (batch.column(c).to_numpy() for c in ("cell", "block", "qslab"))
            some = batch.column("bound").to_numpy()[:, None]
            low, high = d - some, d + some
            kept = np.isfinite(cells.low) & (low <= cells.high) & (high >= cells.low)
            gap = between[own]  # plane between the query's pivot and another: everything there is at least this far
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = np.where(gap > 0, (d ** 2 - d[np.arange(len(d)), own][:, None] ** 2) / (2 * gap), 0)
            kept &= plane <= some
            low[~kept], high[~kept] = np.inf, -np.inf
            order = np.argsort(block, kind="stable")
            begin = np.flatnonzero(np.diff(block[order], prepend=-1))
            low, high = np.minimum.reduceat(low[order], begin), np.maximum.reduceat(high[order], begin)
            q, c = np.nonzero(low <= high)
            at = order[begin][q]
            yield pa.RecordBatch.from_arrays(
                [pa.array(slab[at]), pa.array(block[at]), pa.array(c.astype("int32")), pa.array(low[q, c]), pa.array(high[q, c])],
                names=["qslab", "block", "cell", "low", "high"])

    found = queries.select("id", "v", "qslab", "block", "cell", "bound").mapInArrow(
        look, "qslab int, block bigint, cell int, low double, high double")
    return found.groupBy("qslab", "block", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def _prepared(queries: DataFrame, references: DataFrame, k: int, block_rows: int, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(visits, references in chunks, queries in blocks with their bounds)."""
    block_rows = min(block_rows, _slab_rows(width))
    pivots = _pivots(references, references.count())
    placed = materialize(_chunked(references, pivots, block_rows, "chunks"), "neighbour-references")
    asked = _chunked(queries, pivots, block_rows, "queries").withColumn("block", F.shiftleft(F.col("cell").cast("bigint"), 32) + F.col("chunk"))
    asked = materialize(asked.select("id", "v", "cell", "block", F.col("slab").alias("qslab"), F.lit(None).cast("double").alias("bound"),
                                     F.monotonically_increasing_id().alias("row")), "neighbour-queries")
    cells = _cells(placed, pivots, k)
    rings = materialize(placed.groupBy("cell", "chunk", "slab").agg(F.min("dist").alias("from"), F.max("dist").alias("to")), "neighbour-rings")
    own = asked.select("qslab", "block", "cell").distinct().join(rings.where("chunk = 0"), "cell")
    first = _meet(asked.withColumn("id", F.col("row")), placed, own, k)
    bound = first.groupBy("qid").agg(F.when(F.count("*") == k, F.max("distance")).alias("first")).withColumnRenamed("qid", "row")
    asked = asked.join(materialize(bound, "neighbour-bounds"), "row", "left").withColumn("bound", F.col("first")).drop("first", "row")
    asked = materialize(_bounded(asked, cells, k), "neighbour-asked")
    meets = (F.col("low") <= F.col("to")) & (F.col("high") >= F.col("from"))
    seen = _candidates(asked, cells).join(rings, "cell").where(meets).select("qslab", "block", "cell", "chunk", "slab")
    return materialize(seen, "neighbour-visits"), placed, asked


def visits(queries: DataFrame, references: DataFrame, k: int, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """(visits, references in chunks): which chunks each query must be compared with. Both inputs have ``id`` and ``v``."""
    seen, placed, asked = _prepared(queries, references, k, block_rows, references.select(F.size("v")).first()[0])
    return asked.select("id", "block").join(seen, "block"), placed


def nearest(
    queries: DataFrame, references: DataFrame, sample: str, vector: str, label: str, k: int, block_rows: int = 4096
) -> DataFrame:
    """(qid, rank, rid, distance, label): Euclidean distance, ties by reference id.

    Rows whose vector is null or empty, or holds a null or NaN, neither ask nor answer; vectors of unequal lengths are refused. Query ids
    are unique. Chunks, the unit of pruning, have at most ``block_rows`` rows. References that fit one block are compared as they are, there
    being nothing to prune.
    """
    v = F.col(vector).cast("array<double>").alias("v")
    asked = queries.filter(usable(vector)).select(F.col(sample).cast("bigint").alias("id"), v)
    answers = references.filter(usable(vector)).select(F.col(sample).cast("bigint").alias("id"), v, F.col(label).cast("int").alias("label"))
    (n_asked, *a), (n_answers, *b) = [df.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first() for df in (asked, answers)]
    widths = {w for w in (*a, *b) if w is not None}
    if len(widths) > 1:
        raise ValueError(f"vectors differ in length: {sorted(widths)}")
    width = max(widths, default=1)
    if n_answers <= min(block_rows, _slab_rows(width)):
        blocks = -(-n_asked // _slab_rows(width)) or 1
        alone = {"cell": F.lit(0), "chunk": F.lit(0)}
        asked = asked.withColumns({"qslab": F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), "block": F.lit(0).cast("bigint"),
                                   "bound": F.lit(None).cast("double")})
        placed = answers.withColumns(alone)
        seen = queries.sparkSession.range(blocks).select(F.col("id").cast("int").alias("qslab"), F.lit(0).cast("bigint").alias("block"),
                                                         *[c.alias(n) for n, c in alone.items()], F.lit(0).alias("slab"))
    else:
        seen, placed, asked = _prepared(asked, answers, k, block_rows, width)
    return _best(_meet(asked, placed, seen, k), k).select("qid", "rank", "rid", "distance", "label")


def vote(neighbours: DataFrame) -> DataFrame:
    """Majority label of each query's neighbours; on a tie the smallest label."""
    labels = F.array_sort(F.collect_list("label"))
    return neighbours.groupBy("qid").agg(mode_first_seen(labels).alias("pred"))
