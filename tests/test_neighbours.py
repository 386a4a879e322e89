"""Pruned nearest neighbours against brute force, and how much they leave out."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemill.operators import neighbours as NB


def clustered(n, dims, clusters, seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(clusters, dims)) * 10
    return centres[r.integers(0, clusters, n)] + r.normal(size=(n, dims)) * 0.3


def frame(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, v if v is None else [None if x is None else float(x) for x in v], i % 5) for i, v in enumerate(vectors)],
                                 "sample_id bigint, series array<double>, label int")


def brute(queries, references, k, first):
    out = {}
    for i, q in enumerate(queries):
        d = np.sqrt(((references - q) ** 2).sum(axis=1))
        order = np.lexsort((np.arange(len(d)), d))[:k]
        out[first + i] = [(int(j), round(float(d[j]), 9)) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append((r.rid, round(r.distance, 9)))
    return out


@pytest.mark.parametrize("k, block, kind", [(5, 60, "clustered"), (1, 37, "spread"), (40, 25, "clustered"), (3, 20, "copies")])
def test_same_as_brute_force(spark, k, block, kind):
    refs = {"clustered": clustered(600, 6, 12, 1), "spread": np.random.default_rng(2).normal(size=(400, 3)),
            "copies": np.vstack([np.ones((200, 4)), clustered(100, 4, 5, 3)])}[kind]
    asked = np.vstack([refs[::9], refs[:20] + 0.01, np.full((1, refs.shape[1]), 500.0)])
    got = NB.nearest(frame(spark, asked, 10_000), frame(spark, refs), "sample_id", "series", "label", k, block_rows=block)
    assert found(got) == brute(asked, refs, k, 10_000)


def test_few_pairs_are_compared(spark):
    """With clusters apart, a query meets the chunks of its own cluster and little else."""
    refs, asked = clustered(3000, 8, 30, 4), clustered(300, 8, 30, 4)
    valid = [frame(spark, x).select(F.col("sample_id").alias("id"), F.col("series").alias("v"), "label") for x in (asked, refs)]
    seen, placed = NB.visits(valid[0], valid[1], 5, 64)
    pairs = seen.join(placed.groupBy("cell", "chunk").agg(F.count("*").alias("n")), ["cell", "chunk"]).agg(F.sum("n")).first()[0]
    assert pairs < 0.15 * 3000 * 300
    assert placed.groupBy("cell", "chunk").count().agg(F.max("count")).first()[0] <= 64


def test_rows_without_a_vector_take_no_part(spark):
    refs = [[0.0, 1.0], None, [], [None, 1.0], [float("nan"), 0.0], [2.0, 2.0]]
    df = frame(spark, refs)
    for block in (1, 4096):
        got = found(NB.nearest(df, df, "sample_id", "series", "label", 3, block_rows=block))
        assert {q: [r for r, _ in v] for q, v in got.items()} == {0: [0, 5], 5: [5, 0]}
    none = NB.nearest(df, df.limit(0), "sample_id", "series", "label", 3)
    assert none.count() == 0 and NB.nearest(df.limit(0), df, "sample_id", "series", "label", 3, block_rows=1).count() == 0


def test_unequal_lengths_are_refused(spark):
    df = frame(spark, [[0.0, 1.0], [1.0], [2.0, 3.0]])
    for block in (1, 4096):
        with pytest.raises(ValueError, match="differ in length"):
            NB.nearest(df, df, "sample_id", "series", "label", 1, block_rows=block)


def test_vectors_move_once_for_a_slab(spark, monkeypatch):
    """Where nothing can be left out, neither visits nor queries nor references carry a vector for each (query, chunk)."""
    refs, asked = (np.random.default_rng(s).normal(size=(n, 24)) for s, n in ((7, 900), (8, 150)))
    ids = [frame(spark, x).select(F.col("sample_id").alias("id"), F.col("series").alias("v"), "label") for x in (asked, refs)]
    seen, placed, queries = NB._prepared(ids[0], ids[1], 3, 20, 24)
    assert "v" not in seen.columns
    assert seen.count() <= queries.select("block").distinct().count() * placed.select("cell", "chunk").distinct().count()
    copies = seen.select("qslab", "cell", "chunk").distinct().join(placed, ["cell", "chunk"]).count()
    assert copies <= 900 and seen.select("qslab", "slab").distinct().count() == 1
    monkeypatch.setattr(NB, "SLAB_BYTES", 100 * 8 * 24)  # 100 rows
    seen, placed, queries = NB._prepared(ids[0], ids[1], 3, 20, 24)
    assert placed.groupBy("slab").count().agg(F.max("count")).first()[0] <= 120 and queries.select("qslab").distinct().count() == 2
    got = NB.nearest(frame(spark, asked, 10_000), frame(spark, refs), "sample_id", "series", "label", 3, block_rows=20)
    assert found(got) == brute(asked, refs, 3, 10_000)


def test_a_batch_of_queries_is_looked_at_in_pieces():
    batch = pa.record_batch({"x": pa.array(range(10_000))})
    cut = list(NB._pieces(iter([batch]), 1024))
    assert max(len(c) for c in cut) * 1024 <= NB.TILE and sum(len(c) for c in cut) == 10_000
