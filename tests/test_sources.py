import pytest
from pyspark.sql import functions as F

from tidemill.sources import archive as A
from tidemill.sources import datasets as D
from tidemill.sources.lines import read_lines

HEAD = "@problemName x\n@timeStamps false\n@univariate false\n@classLabel true a b\n@data\n"


def put(folder, name, text):
    (folder / name).write_text(text)
    return str(folder)


def test_ts_plain(spark, tmp_path):
    path = put(tmp_path, "one.ts", HEAD + "1,2,?:4,5,6:A\n\n7,8:9:b\n")
    rows = A.read_ts(spark, path).orderBy("case_no").collect()
    assert rows[0].dims == [[1.0, 2.0, None], [4.0, 5.0, 6.0]] and rows[0].label == "a"
    assert rows[1].dims == [[7.0, 8.0], [9.0]] and rows[1].label == "b" and rows[1].times is None


def test_ts_timestamped_ints_and_dates(spark, tmp_path):
    head = HEAD.replace("@timeStamps false", "@timeStamps true")
    put(tmp_path, "a.ts", head + "(0,1.5),(1,2.5):(0,3),(1,4):a\n")
    put(tmp_path, "b.ts", head + "(2024-01-01 00:00:01,1),(2024-01-01 00:00:02,?):(2024-01-01 00:00:01,5):b\n")
    rows = {r.label: r for r in A.read_ts(spark, str(tmp_path)).collect()}
    assert rows["a"].dims == [[1.5, 2.5], [3.0, 4.0]] and rows["a"].times == [[0, 1], [0, 1]]
    assert rows["b"].dims == [[1.0, None], [5.0]]
    assert rows["b"].times[0][1] - rows["b"].times[0][0] == 1_000_000


def test_ts_regression(spark, tmp_path):
    path = put(tmp_path, "r.ts", "@problemName x\n@timeStamps false\n@univariate true\n@targetLabel true\n@data\n1,2:3.5\n")
    r = A.read_ts(spark, path, target="double").first()
    assert r.dims == [[1.0, 2.0]] and r.target == 3.5


@pytest.mark.parametrize("text,rule", [
    (HEAD + "1:2:a\n@univariate true\n", "metadata_after_data"),
    (HEAD.replace("@univariate false", "@univariate"), "tag_without_value"),
    (HEAD.replace("@timeStamps false", "@timeStamps maybe") + "1:2:a\n", "bad_boolean"),
    (HEAD + "1:2:a\n1:a\n", "inconsistent_dimensions"),
    (HEAD + "1:2:c\n", "unknown_class"),
    (HEAD + "1,x:2:a\n", "bad_value"),
    (HEAD.replace("@classLabel true a b", "@classLabel true") + "1:2:a\n", "classes_missing"),
    (HEAD.replace("@problemName x\n", "") + "1:2:a\n", "metadata_incomplete"),
    (HEAD, "no_data"),
    ("1,2:3,4:a\n", "no_metadata"),
    ("", "empty_file"),
])
def test_ts_rules(spark, tmp_path, text, rule):
    path = put(tmp_path, "bad.ts", text)
    put(tmp_path, "good.ts", HEAD + "1:2:a\n")
    found = A.validate_ts(spark, path).collect()
    assert rule in {r.rule for r in found} and all("bad.ts" in r.file for r in found)


def test_strict_reader_refuses(spark, tmp_path):
    path = put(tmp_path, "bad.ts", HEAD + "1:2:c\n")
    with pytest.raises(Exception, match="unknown_class"):
        A.read_ts(spark, path).collect()
    assert A.read_ts(spark, path, strict=False).count() == 1
    put(tmp_path, "empty.ts", HEAD)
    with pytest.raises(ValueError, match="no_data"):
        A.read_ts(spark, path)


def test_arff_and_tsv(spark, tmp_path):
    put(tmp_path, "m.arff", "@relation x\n@attribute r relational\n@end r\n@attribute class {a,b}\n@data\n'1,2\\n3,?',a\n")
    put(tmp_path, "u.arff", "@relation x\n@attribute t numeric\n@attribute class {a,b}\n@data\n1,2,3,b\n")
    rows = {r.label: r.dims for r in A.read_arff(spark, str(tmp_path)).collect()}
    assert rows == {"a": [[1.0, 2.0], [3.0, None]], "b": [[1.0, 2.0, 3.0]]}
    path = put(tmp_path, "x.tsv", "1\t0.5\t0.25\n2\t1\t2\n")
    assert [(r.label, r.dims) for r in A.read_tsv(spark, path).orderBy("case_no").collect()] == [("1", [[0.5, 0.25]]), ("2", [[1.0, 2.0]])]


def test_line_numbers_survive_file_splits(spark, tmp_path):
    put(tmp_path, "long.txt", "".join(f"line {i}\n" for i in range(20000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16KB")
    try:
        lines = read_lines(spark, str(tmp_path))
        assert lines.filter(F.concat(F.lit("line "), F.col("line_no")) != F.col("value")).count() == 0
        assert lines.count() == 20000 and lines.rdd.getNumPartitions() > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_file_pattern(spark, tmp_path):
    for n in "abc":
        put(tmp_path, f"{n}1.txt", n)
    assert {r.value for r in read_lines(spark, str(tmp_path), pattern="[ab]1").collect()} == {"a", "b"}


def test_wafer_loader_end_to_end(spark, tmp_path):
    for d in ("measurements", "catalog", "tracedata"):
        (tmp_path / d).mkdir()
    m = tmp_path / "measurements"
    put(m, "Rate_time_series_Average_1.csv", "Proc_cj_id,Wafer_id,Mea_value\nT-1,1,10.5\n")
    put(m, "mCTF_Average_1.csv", "Control_job_id,Wafer_id,Wafer_mean\nT-1,1,10.0\nT-9,2,20.0\n")
    put(m, "Rate_time_series_StdDev_1.csv", "Proc_cj_id,Wafer_id,Std_dep_thk\nT-1,1,0.5\n")
    put(m, "mCTF_StdDev_1.csv", "Control_job_id,Wafer_id,Wafer_std\nT-9,2,0.7\n")
    put(tmp_path / "catalog", "c.csv", "WaferPassID,WaferID,ToolID,PJID,ChamberID,ChamberRecipeID,TraceDataFile\n"
        "100,1,T,1.3,CH2,QUALCH2CO20,d:/x/t100.zip\n101,5,T,7.1,CH2,QUALCH2CO20,d:/x/t101.zip\n102,1,T,1.3,CH1,QUALCH2CO20,d:/x/t102.zip\n")
    put(tmp_path / "tracedata", "t100.csv", "WaferPassID,TimeStamp,p\n100,2024-01-01 00:00:02,2\n100,2024-01-01 00:00:01,1\n")
    put(tmp_path / "tracedata", "t102.csv", "WaferPassID,TimeStamp,p,q\n102,2024-01-01 00:00:01,1,1\n")
    put(tmp_path / "tracedata", "t101.csv", "WaferPassID,TimeStamp,p,q\n101,2024-01-01 00:00:01,1,1\n")
    steps, labels = D.load_dataset(spark, "wafer", str(tmp_path))
    assert [(r.sample_id, r.t, r.p, r.q) for r in steps.orderBy("t").collect()] == [(100, 0, 1, 0), (100, 1, 2, 0)]
    assert {r.sample_id: r.target for r in labels.collect()} == {100: 10.5}


def test_wafer_metadata_are_read_once(spark, tmp_path):
    """Traces and labels are worked out from what was written of the metadata, not from the measurement files again."""
    for d in ("measurements", "catalog", "tracedata"):
        (tmp_path / d).mkdir()
    m = tmp_path / "measurements"
    kinds = {"Rate_time_series_Average_1.csv": "Proc_cj_id,Wafer_id,Mea_value", "mCTF_Average_1.csv": "Control_job_id,Wafer_id,Wafer_mean",
             "Rate_time_series_StdDev_1.csv": "Proc_cj_id,Wafer_id,Std_dep_thk", "mCTF_StdDev_1.csv": "Control_job_id,Wafer_id,Wafer_std"}
    for name, head in kinds.items():
        put(m, name, head + "\nT-1,1,1.5\n")
    put(tmp_path / "catalog", "c.csv", "WaferPassID,WaferID,ToolID,PJID,ChamberID,ChamberRecipeID,TraceDataFile\n100,1,T,1.3,CH2,QUALCH2CO20,d:/x/t100.zip\n")
    put(tmp_path / "tracedata", "t100.csv", "WaferPassID,TimeStamp,p\n100,2024-01-01 00:00:02,2\n")
    steps, labels = D.load_dataset(spark, "wafer", str(tmp_path))
    for name in [*kinds, "../catalog/c.csv"]:
        (m / name).write_text("")
    assert [(r.sample_id, r.p, r.target) for r in steps.join(labels, "sample_id").collect()] == [(100, 2, 1.5)]


def test_kinds_of_columns_go_by_all_rows(spark):
    """What the first rows allow is tested on all."""
    late = {"a": "5", "b": "2.5", "c": "2024-01-01", "d": "x", "e": None}
    rows = [("1", "1", "1", "1", None)] * (D.KIND_ROWS + 50) + [tuple(late.values())]
    kinds = D._kinds(spark.createDataFrame(rows, "a string, b string, c string, d string, e string").coalesce(1), list(late))
    assert kinds == {"a": "bigint", "b": "double", "c": "string", "d": "string", "e": "string"}
    days = spark.createDataFrame([("2024-01-01",), ("2024-01-02 10:00:00",), (None,)], "a string")
    assert D._kinds(days, ["a"]) == {"a": "timestamp"} and D._kinds(days.where("a IS NULL"), ["a"]) == {"a": "string"}
    assert D._kinds(spark.createDataFrame([("x",), (None,)], "a string"), ["a"]) == {"a": "string"}


def test_pmu_by_given_ids(spark, tmp_path):
    put(tmp_path, "p.csv", "ExID,a1 x,a2 x,a3 x,b4 y\n1,1,2,,4\n1,5,6,7,8\n2,9,9,9,9\n")
    d = D.load_dataset(spark, "grid", str(tmp_path))
    assert d.columns == ["sample_id", "t", "a0 x", "a0 x", "a0 x", "b1 y"]
    assert [(r[0], r[1], r[4]) for r in d.orderBy("sample_id", "t").collect()] == [(1, 0, 0), (1, 1, 7), (2, 0, 9)]


def test_cached_parse_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert D.cached(spark, str(tmp_path / "c"), build).count() == 3
    D.cached(spark, str(tmp_path / "c"), build, overwrite=True)
    assert len(calls) == 2
