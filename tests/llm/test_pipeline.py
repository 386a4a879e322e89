"""Each stage of the corpus pipeline on awkward rows, and the whole of it against plain versions."""

import re

import corpus_pipeline as cp
import pytest
from fixtures import prose
from pyspark.sql import functions as F

from tidemill.llm import simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
GERMAN = "der die das und nicht haus strasse wasser garten kirche himmel zeit leben arbeit mutter vater bruder".split()


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows], SCHEMA)


def german(seed, n):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(GERMAN) for _ in range(n))


def two_languages():
    return [(i, prose(i, 60), "en") for i in range(40)] + [(100 + i, german(i, 60), "de") for i in range(40)]


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_language_stage_keeps_sure_documents_and_columns(spark, sf):
    rows = two_languages() + [(500, None, "en"), (501, "", None), (502, "12 34 !!", "en"), (None, prose(900, 80), "en"), (3, prose(901, 80), None), (3, prose(901, 80), None)]
    df = docs_of(spark, rows).withColumn("lang_pred", F.lit("x")).withColumn("score", F.lit(0.0))
    out = cp.keep_known_language(spark, df, sf)
    assert out.columns == df.columns
    kept = pairs(out)
    assert not {500, 501, 502} & {i for i, _ in kept}
    assert (None, prose(900, 80)) in kept and kept.count((3, prose(901, 80))) == 2
    assert len(kept) >= 78


def test_line_stage_keeps_all_documents_and_counts_characters(spark, sf):
    rows = [(1, "a\nb\nc\nd", None), (2, "x\na\nb\nc", None), (None, "a\nb\nc", None), (4, None, None), (5, "", None), (2, "q", None)]
    df = docs_of(spark, rows).withColumn("n_removed", F.lit("mine"))
    out = cp.drop_repeated_lines(spark, df, sf)
    assert out.columns == df.columns and out.count() == 6
    for r in out.collect():
        assert r.n_chars == (None if r.text is None else len(r.text)) or r.text is None
    assert sum("a\nb\nc" in (r.text or "") for r in out.collect()) == 1
    assert cp.drop_repeated_lines(spark, df.limit(0), sf).count() == 0


def plain_stage(spark, rows):
    """One document of each group: by brute force over all pairs of fingerprints."""
    prints = {(r.doc_id, r.text): r.fp for r in simhash.fingerprints(docs_of(spark, rows), ["doc_id", "text"]).collect()}
    fps = sorted(set(prints.values()))
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in fps:
        for b in fps:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
                root[find(a)] = find(b)
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(find(prints[i, t]), []).append((i, t))
    best = [min(g, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")) for g in groups.values()]
    return sorted(best, key=str)


def test_one_document_of_each_group_stays(spark, sf):
    a, b, c = prose(1, 200), prose(2, 200), prose(3, 200)
    for rows in (
        [(1, a, None), (5, a, None), (5, b, None)],  # an id in two groups: its copy goes, its own text stays
        [(None, a, None), (7, a, None), (None, b, None), (None, b, None), (9, c, None), (9, c, None), (9, c + " tail", None)],
        [(4, None, None), (2, "", None), (None, "  ", None), (8, prose(4, 40), None)],
        [(None, a, None)],
    ):
        assert pairs(cp.one_of_each_group(spark, docs_of(spark, rows), sf)) == plain_stage(spark, rows)


def test_group_stage_with_clashing_columns_and_no_rows(spark, sf):
    df = docs_of(spark, [(1, prose(1, 90), None), (2, prose(1, 90), None)])
    for c in ("fp", "root", "component_id", "__root", "__0", "node"):
        df = df.withColumn(c, F.lit("mine"))
    out = cp.one_of_each_group(spark, df, sf)
    assert out.columns == df.columns and [(r.doc_id, r.fp) for r in out.collect()] == [(1, "mine")]
    assert cp.one_of_each_group(spark, df.limit(0), sf).count() == 0


def test_benchmark_stage_drops_leaks_only(spark, sf):
    item = next(t for t in (r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").collect()) if len(t) > 60)
    rows = [(1, prose(5, 50) + " " + item + " " + prose(6, 50), None), (None, item, None), (3, prose(7, 100), None), (3, prose(7, 100), None), (4, None, None), (5, "", None)]
    df = docs_of(spark, rows).withColumn("item_id", F.lit("mine"))
    out = cp.drop_benchmark_passages(spark, df, sf)
    assert out.columns == df.columns
    assert pairs(out) == sorted([(3, prose(7, 100))] * 2 + [(4, None), (5, "")], key=str)
    assert cp.drop_benchmark_passages(spark, df.limit(0), sf).count() == 0


def test_packing_stage_places_every_piece_once(spark, sf):
    rows = [(1, prose(8, 4000), None), (None, "x", None), (2, None, None), (2, "", None), (2, "", None)]
    out = cp.pack_sequences(spark, docs_of(spark, rows).withColumn("length", F.lit("mine")), sf).collect()
    assert sorted(str(r.doc_id) for r in out if r.piece == 0) == ["1", "2", "2", "2", "None"]
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert cp.pack_sequences(spark, docs_of(spark, []), sf).count() == 0


def test_stages_in_order(spark, sf):
    assert [re.sub(" .*", "", n) for n, _ in cp.STAGES] == ["language", "line", "simhash", "benchmark", "best-fit"]
    assert cp.ORACLE_SQL is None
    out = cp.run(spark, sf)
    ids = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    assert 0 < len(ids) < spark.read.parquet(f"{sf}/documents.parquet").count()


@pytest.mark.parametrize("stage", [s for _, s in cp.STAGES[:-1]])
def test_stages_do_not_depend_on_partitions(spark, sf, stage):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one, other = (sorted(map(str, stage(spark, d, sf).collect())) for d in (docs, docs.repartition(7)))
    assert one == other
