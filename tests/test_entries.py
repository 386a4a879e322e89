"""The loaders that go from files to samples in one call."""

import pytest

from tidemill.sources import datasets as D


@pytest.fixture
def archive(tmp_path):
    head = "@problemName x\n@timeStamps false\n@univariate false\n@classLabel true b a\n@data\n"
    (tmp_path / "one.ts").write_text(head + "1,?,3,4:5,6,7,8:b\n?,2,3:?,?,9:a\n")
    (tmp_path / "two.ts").write_text(head + "1,2,3,4,5,6:1,2,3:a\n")
    return str(tmp_path)


def test_archive_entry(spark, archive):
    cases, lengths, classes = D.load_archive(spark, archive, longest=4)
    got = {r.sample_id: (r.dims, r.label, r.code) for r in cases.collect()}
    assert got == {0: ([[1, 2, 3, 4], [5, 6, 7, 8]], "b", 1), 1: ([[2, 2, 3], [9, 9, 9]], "a", 0), 2: ([[1, 3, 5], [1, 2, 3]], "a", 0)}
    assert {r.sample_id: r.max_len for r in lengths.collect()} == {0: 4, 1: 3, 2: 3}
    assert [tuple(r) for r in classes.orderBy("code").collect()] == [("a", 0), ("b", 1)]


def test_archive_limit_and_thinning(spark, archive):
    cases, _, _ = D.load_dataset(spark, "archive", archive, limit=2, thin=2)
    assert {r.sample_id: r.dims for r in cases.collect()} == {0: [[1, 3], [5, 7]], 1: [[3, 3], [9, 9]]}


def test_regression_has_targets_and_no_classes(spark, tmp_path):
    (tmp_path / "r.ts").write_text("@problemName x\n@timeStamps false\n@univariate true\n@targetLabel true\n@data\n1,2:0.5\n3,4:1.5\n")
    cases, _, classes = D.load_archive(spark, str(tmp_path), task="regression")
    assert classes is None and sorted(r.target for r in cases.collect()) == [0.5, 1.5]


def test_length_resolution():
    assert [D.resolve_length(12, "weld", 70), D.resolve_length(None, "weld", 70), D.resolve_length(None, "wafer", 7), D.resolve_length(None, None, 70)] == [12, 66, 130, 70]
