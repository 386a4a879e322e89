"""File manifests and CSV files of mixed headers."""

import pytest
from pyspark.sql import types as T

from tidemill.sources import datasets as D
from tidemill.sources import manifest as F


@pytest.fixture
def folder(tmp_path):
    files = {"a/one.csv": b"id,price\n1,2.5\n2,\n", "a/two.csv": b"\xef\xbb\xbfprice,id,note\r\n7,3,\"a, b\"\r\n8,4,x\r\n", "b/three.csv": b"id,when\n5,2020-01-02 03:04:05\n",
             "b/empty.csv": b"", "b/bare.csv": b"id,price", "b/long.csv": b"id," + b"c" * 200_000 + b"\n6,z\n", "b/other.txt": b"id\n9\n"}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    return tmp_path


def test_heads_of_files(spark, folder):
    listed = F.files(spark, str(folder), ".csv")
    assert listed.count() == 5 and listed.filter("size = 8").count() == 1
    got = {r.file.rsplit("/", 1)[1]: r.head for r in F.heads(listed).collect()}
    assert got["one.csv"] == "id,price" == got["bare.csv"] and got["two.csv"] == "price,id,note"
    assert len(got["long.csv"]) == 200_003
    assert F.files(spark, str(folder), ".csv", "/a/").count() == 2


def test_columns_follow_each_files_header(spark, folder):
    df = D.read_csv_mixed(spark, str(folder), r"/(one|two|three|empty|bare)\.csv")
    assert df.drop("_file", "_at", "_row").dtypes == [("id", "bigint"), ("note", "string"), ("price", "double"), ("when", "timestamp")]
    got = {r.id: (r.price, r.note, str(r.when) if r.when else None) for r in df.collect()}
    assert got == {1: (2.5, None, None), 2: (None, None, None), 3: (7.0, "a, b", None), 4: (8.0, "x", None), 5: (None, None, "2020-01-02 03:04:05")}


def test_a_given_schema_and_named_files(spark, folder):
    schema = T.StructType().add("id", T.IntegerType()).add("price", T.StringType()).add("absent", T.DoubleType())
    got = D.read_csv_mixed(spark, str(folder), names=["one.csv", "two.csv"], schema=schema)
    assert sorted((r.id, r.price, r.absent) for r in got.collect()) == [(1, "2.5", None), (2, None, None), (3, "7", None), (4, "8", None)]
    with pytest.raises(ValueError, match="no csv file"):
        D.read_csv_mixed(spark, str(folder), "nothing like it")


def test_too_many_headers_are_refused(spark, folder, monkeypatch):
    monkeypatch.setattr(D, "MAX_LAYOUTS", 2)
    with pytest.raises(ValueError, match="different headers"):
        D.read_csv_mixed(spark, str(folder))
