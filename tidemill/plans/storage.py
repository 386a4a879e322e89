"""Files: tables are written in the foreign formats, read back, and compared with where they came from."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import samples as P
from tidemill.operators import tracking as T
from tidemill.plans.evaluation import PRED, predictions
from tidemill.plans.registry import events, patchy_events, query, r6, table
from tidemill.plans.samples import VEC, vectors
from tidemill.plans.series import CLEAN, COLS, GAP_S, STEP_MS, mode_sql, windows_sql
from tidemill.session import fresh_path
from tidemill.sources import archive as A
from tidemill.sources import datasets as D
from tidemill.sources import render as R
from tidemill.sources.lines import read_lines

CHUNK = 100  # samples per file
TRACE_ROWS = 500_000  # about as many lines of traces per file


def numbered(spark, sf):
    """Vectors with their file (``part``), two dimensions, every 5th step missing, and a mixed-case label."""
    gaps = F.transform("dims", lambda s: F.transform(s, lambda x, i: F.when(i % 5 != 0, F.round(x, 6))))
    return vectors(spark, sf).select(
        "sample_id", F.expr(f"sample_id div {CHUNK}").alias("part"), gaps.alias("dims"), F.concat(F.lit("Cls"), "label").alias("label"), F.col("series")[0].alias("target"))


def part_of(file):
    return F.regexp_extract(file, r"part=(\d+)", 1).cast("bigint")


def restored(df, *extra):
    """Back to (sample_id, dim_id, reading_id, value): the case number counts within the file."""
    rows = df.select((part_of("file") * CHUNK + F.col("case_no")).alias("sample_id"), "dims", *extra)
    return rows


def long(df):
    return P.nested_to_long(df, "sample_id").withColumn("value", r6("value"))


GAPPY = f"""WITH {VEC} SELECT sample_id, CAST(t // 32 AS INTEGER) AS dim_id, CAST(t % 32 AS INTEGER) AS reading_id, CASE WHEN t % 32 % 5 <> 0 THEN round(x, 6) END AS value FROM v"""


def ts_files(spark, sf, target=False):
    path = fresh_path(spark, "ts")
    df = numbered(spark, sf)
    dims = F.array_join(F.transform("dims", R.series_text), ":")
    tail = F.col("target").cast("string") if target else F.col("label")
    cases = df.select("part", "sample_id", F.concat(dims, F.lit(":"), tail).alias("line"))
    classes = [f"Cls{i}" for i in range(10)]
    R.write_lines(cases, "part", "sample_id", R.ts_header("Vectors", False, None if target else classes, target=target), path)
    return path


@query("ts_plain_read", GAPPY)
def ts_plain(spark, sf):
    return long(restored(A.read_ts(spark, ts_files(spark, sf), extension=".txt")))


@query("ts_labels_lowercased", "SELECT vec_id AS sample_id, 'cls' || label AS label FROM embeddings")
def ts_labels(spark, sf):
    return restored(A.read_ts(spark, ts_files(spark, sf), extension=".txt"), "label").drop("dims")


@query("ts_regression_read", f"""WITH {VEC}, f AS (SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 9) AS target FROM embeddings)
SELECT sample_id, CAST(t // 32 AS INTEGER) AS dim_id, CAST(t % 32 AS INTEGER) AS reading_id, CASE WHEN t % 32 % 5 <> 0 THEN round(x, 6) END AS value, target FROM v JOIN f ON vec_id = sample_id""")
def ts_regression(spark, sf):
    got = A.read_ts(spark, ts_files(spark, sf, target=True), target="double", extension=".txt")
    cases = restored(got, r6("target", 9).alias("target"))
    return long(cases).join(cases.select("sample_id", "target"), "sample_id")


@query("ts_timestamped_read", f"""SELECT event_id // {CHUNK} AS block, CAST(row_number() OVER (PARTITION BY event_id // {CHUNK} ORDER BY ts, event_id) - 1 AS INTEGER) AS i, epoch_us(ts) AS us, value,
CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events""")
def ts_timestamped(spark, sf):
    """A case is a block of events, so its line is of bounded size; stamps keep their microseconds."""
    path = fresh_path(spark, "tts")
    e = events(spark, sf)
    steps = F.array_sort(F.collect_list(F.struct("us", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "value", "k")))
    blocks = e.groupBy(F.expr(f"event_id div {CHUNK}").alias("block")).agg(steps.alias("s"))

    def tuples(c):
        return F.array_join(F.transform("s", lambda x: F.concat(F.lit("("), x["at"], F.lit(","), x[c].cast("string"), F.lit(")"))), ",")

    cases = blocks.select(F.expr(f"block div {CHUNK}").alias("part"), (F.col("block") % CHUNK).alias("o"), F.concat_ws(":", tuples("value"), tuples("k"), F.lit("a")).alias("line"))
    R.write_lines(cases, "part", "o", R.ts_header("Blocks", False, ["a"], timestamps=True), path)
    got = A.read_ts(spark, path, extension=".txt")
    zipped = F.arrays_zip(F.col("times")[0].alias("us"), F.col("dims")[0].alias("value"), F.col("dims")[1].alias("k"))
    block = part_of("file") * CHUNK + F.col("case_no")
    return got.select(block.alias("block"), F.posexplode(zipped).alias("i", "z")).select("block", "i", "z.*")


@query("ts_validation", f"""WITH s AS (SELECT vec_id, vec_id // {CHUNK} AS part, vec_id % {CHUNK} AS r, label FROM embeddings)
SELECT part, CAST(r + 5 AS BIGINT) AS line_no, 'inconsistent_dimensions' AS rule FROM s WHERE r = 7 UNION ALL
SELECT part, CAST(r + 5 AS BIGINT), 'unknown_class' FROM s WHERE label = 9 UNION ALL
SELECT part, CAST(r + 5 AS BIGINT), 'bad_value' FROM s WHERE r = 11""")
def ts_validation(spark, sf):
    path = fresh_path(spark, "badts")
    r = F.col("sample_id") % CHUNK
    dims = F.transform("dims", R.series_text)
    dims = F.when(r == 7, F.slice(dims, 1, 1)).when(r == 11, F.array(F.lit("1,x"), F.lit("2,3"))).otherwise(dims)
    cases = numbered(spark, sf).select("part", "sample_id", F.concat(F.array_join(dims, ":"), F.lit(":"), "label").alias("line"))
    R.write_lines(cases, "part", "sample_id", R.ts_header("Bad", False, [f"Cls{i}" for i in range(9)]), path)
    found = A.ts_violations(read_lines(spark, path))
    return found.select(part_of("file").alias("part"), "line_no", "rule")


@query("arff_multivariate_read", GAPPY)
def arff_multi(spark, sf):
    path = fresh_path(spark, "arff")
    dims = F.array_join(F.transform("dims", R.series_text), "\\n")
    cases = numbered(spark, sf).select("part", "sample_id", F.concat(F.lit("'"), dims, F.lit("',"), "label").alias("line"))
    R.write_lines(cases, "part", "sample_id", ["@relation v", "@attribute v relational", "@attribute a numeric", "@end v", "@attribute class {a,b}", "@data"], path)
    return long(restored(A.parse_arff(read_lines(spark, path))))


@query("arff_univariate_read", f"""WITH {VEC} SELECT sample_id, 'Cls' || label AS label, CAST(t AS INTEGER) AS reading_id, CASE WHEN t % 32 % 5 <> 0 THEN round(x, 6) END AS value FROM v""")
def arff_uni(spark, sf):
    path = fresh_path(spark, "arff1")
    cases = numbered(spark, sf).select("part", "sample_id", F.concat_ws(",", R.series_text(F.flatten("dims")), "label").alias("line"))
    R.write_lines(cases, "part", "sample_id", ["@relation v", "@attribute a numeric", "@attribute class {a,b}", "@data"], path)
    got = restored(A.parse_arff(read_lines(spark, path)), "label")
    return got.select("sample_id", "label", F.posexplode(F.col("dims")[0]).alias("reading_id", "value")).withColumn("value", r6("value"))


@query("tsv_read", f"""WITH {VEC} SELECT sample_id, CAST(label AS VARCHAR) AS label, CAST(t AS INTEGER) AS reading_id, round(x, 6) AS value FROM v""")
def tsv(spark, sf):
    path = fresh_path(spark, "tsv")
    text = F.array_join(F.transform("series", lambda x: F.round(x, 6).cast("string")), "\t")
    cases = vectors(spark, sf).select(F.expr(f"sample_id div {CHUNK}").alias("part"), "sample_id", F.concat_ws("\t", F.col("label").cast("string"), text).alias("line"))
    R.write_lines(cases, "part", "sample_id", [], path)
    got = restored(A.parse_tsv(read_lines(spark, path)), "label")
    return got.select("sample_id", "label", F.posexplode(F.col("dims")[0]).alias("reading_id", "value")).withColumn("value", r6("value"))


def csv_dir(df, spark, name, part):
    """One file per value of ``part``, which is dropped from the rows; choose parts of bounded size."""
    path = fresh_path(spark, name)
    df.withColumnRenamed(part, "file").repartition("file").sortWithinPartitions("file").write.partitionBy("file").option("header", True).csv(path)
    return path


@query("disk_health_directory", """SELECT CAST(l_suppkey AS BIGINT) AS serial_number, p_type AS model, epoch_us(date_trunc('day', l_shipdate)) AS us, l_quantity > 49 AS failure, l_discount AS smart_1_raw
FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_type LIKE 'ST%'""")
def disk_health(spark, sf):
    l = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    disks = l.select(
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.col("l_suppkey").alias("serial_number"), F.col("p_type").alias("model"),
        (F.col("l_quantity") > 49).cast("int").alias("failure"), F.col("l_discount").alias("smart_1_raw"), F.col("l_tax").alias("smart_1_normalized"),
        F.lit(None).cast("double").alias("smart_9_raw"), F.concat_ws("-", F.date_format("l_shipdate", "yyyy-MM"), F.expr("l_orderkey div 500000")).alias("y"))
    df = D.load_dataset(spark, "disk_health", csv_dir(disks, spark, "disks", "y"), schema=disks.drop("y").schema)
    from tidemill.functions.scalars import epoch_us

    return df.select(F.col("serial_number").cast("bigint").alias("serial_number"), "model", epoch_us(F.col("date")).alias("us"), "failure", "smart_1_raw")


@query("weld_directory", """WITH w AS (SELECT l_orderkey AS id, l_returnflag || l_orderkey // 20000 AS file, CASE WHEN l_orderkey % 13 = 5 THEN 1e17 ELSE l_extendedprice END AS pe, CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END AS cur,
  l_quantity AS te, l_discount + 1 AS dt FROM lineitem), m AS (SELECT file, median(dt) AS md FROM w GROUP BY 1)
SELECT id AS sample_id, count(*) AS n, round(sum(coalesce(cur, 0)), 4) AS current, round(sum(CASE WHEN pe > 1e16 THEN te / md ELSE pe END), 4) AS power FROM w JOIN m USING (file) GROUP BY 1""")
def weld(spark, sf):
    w = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("weld_record_index"), F.col("l_tax").alias("wire_feed_speed"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity")).alias("current"),
        F.col("l_tax").alias("voltage"), F.col("l_tax").alias("motor_current"), F.when(F.col("l_orderkey") % 13 == 5, 1e17).otherwise(F.col("l_extendedprice")).alias("per_energy"),
        F.col("l_quantity").alias("true_energy"), (F.col("l_discount") + 1).alias("diff_time"),
        F.concat("l_returnflag", F.expr("l_orderkey div 20000").cast("string")).alias("part"))
    df = D.load_dataset(spark, "weld", csv_dir(w, spark, "welds", "part"), schema=w.drop("part").schema)
    return df.groupBy(F.col("sample_id").cast("bigint").alias("sample_id")).agg(F.count("*").alias("n"), r6(F.sum("current"), 4).alias("current"), r6(F.sum("power"), 4).alias("power"))


@query("grid_measurement_directory", """SELECT vec_id // 50 AS part, CAST(embedding[1] AS DOUBLE) < 0 AS neg, CAST(i AS INTEGER) AS dim, count(*) AS n,
round(sum(CASE WHEN (vec_id + i) % 7 <> 0 THEN CAST(embedding[i + 1] AS DOUBLE) ELSE 0 END), 6) AS total FROM embeddings, range(64) r(i) GROUP BY 1, 2, 3""")
def grid(spark, sf):
    """All 64 values of a vector are a measurement's columns, each missing in every 7th row; three phases share a position in the names."""
    series, phases = F.col("series"), "abc"
    values = [F.when((F.col("sample_id") + i) % 7 != 0, series[i]).alias(f"v{phases[i % 3]}_{i + 11}") for i in range(64)]
    # files are read in order of their names
    rows = vectors(spark, sf).select("sample_id", *values, series[0].alias("raw_99"), F.lpad(F.expr("sample_id div 50").cast("string"), 12, "0").alias("part"))
    path = fresh_path(spark, "grid")
    rows.repartition("part").sortWithinPartitions("part", "sample_id").drop("sample_id").write.partitionBy("part").option("header", True).csv(path)
    df = D.load_dataset(spark, "grid", path, window=50, schema=rows.drop("sample_id", "part").schema)
    sums = [r6(F.sum(f"v{phases[i % 3]}_{i // 3}")) for i in range(64)]
    whole = df.groupBy((F.col("raw_21") < 0).alias("neg"), "sample_id").agg(F.count("*").alias("n"), F.array(*sums).alias("sums"))
    return whole.select(F.col("sample_id").alias("part"), "neg", "n", F.posexplode("sums").alias("dim", "total"))


@query("wafer_metadata_chain", """WITH c AS (SELECT o_orderkey AS pass, o_custkey AS wafer, 'T' || o_custkey % 5 AS tool, CAST(o_custkey AS VARCHAR) || '.1' AS pj, CASE WHEN o_orderkey % 2 = 0 THEN 'CH2' ELSE 'CH1' END AS ch,
 CASE WHEN o_orderkey % 3 = 0 THEN 'QUALCH2CO20' WHEN o_orderkey % 3 = 1 THEN 'CH2_G0009' ELSE 'OTHER' END AS recipe FROM orders),
k AS (SELECT *, tool || '-' || split_part(pj, '.', 1) AS pjid FROM c WHERE ch = 'CH2' AND recipe <> 'OTHER'),
m AS (SELECT 'T' || c_custkey % 5 || '-' || c_custkey AS job, c_custkey AS wafer, c_acctbal AS th, c_acctbal * 2 AS ro FROM customer WHERE c_custkey % 4 <> 0)
SELECT pass, pjid, round(th, 2) AS mean_thickness, round(ro, 2) AS std_thickness, 'trace_' || pass || '.csv' AS trace_csv FROM k LEFT JOIN m ON m.job = k.pjid AND m.wafer = k.wafer""")
def wafer(spark, sf):
    o = table(spark, sf, "orders")
    catalog = o.select(
        F.col("o_orderkey").alias("WaferPassID"), F.col("o_custkey").alias("WaferID"), F.concat(F.lit("T"), F.col("o_custkey") % 5).alias("ToolID"), F.concat(F.col("o_custkey").cast("string"), F.lit(".1")).alias("PJID"),
        F.when(F.col("o_orderkey") % 2 == 0, "CH2").otherwise("CH1").alias("ChamberID"),
        F.when(F.col("o_orderkey") % 3 == 0, "QUALCH2CO20").when(F.col("o_orderkey") % 3 == 1, "CH2_G0009").otherwise("OTHER").alias("ChamberRecipeID"),
        F.concat(F.lit("D:/x/trace_"), F.col("o_orderkey"), F.lit(".zip")).alias("TraceDataFile"))
    c = table(spark, sf, "customer").filter("c_custkey % 4 <> 0")
    job = F.concat(F.lit("T"), F.col("c_custkey") % 5, F.lit("-"), F.col("c_custkey"))

    def kind(name, job_name, value, keep, factor=1):
        return c.filter(keep).select(job.alias(job_name), F.col("c_custkey").alias("Wafer_id"), (F.col("c_acctbal") * factor).alias(value))

    measured = D.wafer_measurements(
        kind("t1", "Proc_cj_id", "Mea_value", "true"), kind("t2", "Control_job_id", "Wafer_mean", "c_custkey % 3 = 0"),
        kind("r1", "Proc_cj_id", "Std_dep_thk", "true", 2), kind("r2", "Control_job_id", "Wafer_std", "c_custkey % 5 = 0", 2))
    meta = D.wafer_metadata(catalog, measured)
    return meta.select(F.col("WaferPassID").alias("pass"), "pjid", r6("mean_thickness", 2).alias("mean_thickness"), r6("std_thickness", 2).alias("std_thickness"), "trace_csv")


@query("cached_parse", GAPPY)
def cached(spark, sf):
    """Parsed once and written; the second call must not look at its source."""
    path = fresh_path(spark, "cache")
    source = ts_files(spark, sf)
    D.cached(spark, path, lambda: A.read_ts(spark, source, extension=".txt"))
    return long(restored(D.cached(spark, path, lambda: A.read_ts(spark, "/nowhere"))))


@query("file_selection_by_pattern", f"""SELECT vec_id // {CHUNK} AS part, count(*) + 5 AS lines FROM embeddings WHERE vec_id // {CHUNK} % 2 = 0 GROUP BY 1""")
def file_selection(spark, sf):
    """Every second file: its samples and the five lines of its header."""
    lines = read_lines(spark, ts_files(spark, sf), pattern="part=[0-9]*[02468]/")
    return lines.groupBy(part_of("file").alias("part")).agg(F.count("*").alias("lines"))


@query("predictions_round_trip", f"""WITH {PRED} SELECT event_id, truth, pred, score, CAST(c AS INTEGER) AS c, CAST((event_id * (c + 3) * 31) % 97 AS DOUBLE) / 97 AS class_score, 'r1' AS run_id, 'test' AS split
FROM pr, (SELECT unnest([0, 1, 2, 3, 4]) AS c)""")
def predictions_round_trip(spark, sf):
    path = fresh_path(spark, "pred")
    T.save_predictions(predictions(spark, sf).withColumns({"run_id": F.lit("r1"), "split": F.lit("test")}), path)
    return spark.read.parquet(path).select("event_id", "truth", "pred", "score", F.posexplode("scores").alias("c", "class_score"), "run_id", "split")


@query("durations_sheet", """SELECT 'u' || user_id AS run_id, s AS split, 0 AS epoch, 'seconds' AS metric, round(CASE WHEN s = 'train' THEN sum(value) ELSE count(*) / 8.0 END, 6) AS value
FROM events, (SELECT unnest(['train', 'test']) AS s) GROUP BY user_id, s""")
def durations_sheet(spark, sf):
    """Run times of every run, appended to the sheet and read back; a user's events stand for a run."""
    path = fresh_path(spark, "durations")
    runs = events(spark, sf).groupBy(F.concat(F.lit("u"), "user_id").alias("run_id")).agg(F.sum("value").alias("train"), (F.count("*") / 8.0).alias("test"))
    for part in ("test", "train"):
        rows = runs.select("run_id", F.lit(part).alias("split"), F.lit(0).alias("epoch"), F.lit("seconds").alias("metric"), r6(part).alias("value"))
        T.save_durations(rows, path)
    return spark.read.schema("run_id string, split string, epoch int, metric string, value double").option("header", True).csv(path)


@query("mixed_header_files", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 2 = 1 THEN CAST(o_custkey AS VARCHAR) END AS cust FROM orders""")
def mixed_headers(spark, sf):
    path = fresh_path(spark, "mixed")
    o = table(spark, sf, "orders")
    o.filter("o_orderkey % 2 = 0").selectExpr("o_orderkey AS id", "o_totalprice AS price").write.option("header", True).csv(path + "/a")
    o.filter("o_orderkey % 2 = 1").selectExpr("o_custkey AS cust", "o_orderkey AS id").write.option("header", True).csv(path + "/b")
    df = D.read_csv_mixed(spark, path)
    return df.select(F.col("id").cast("bigint").alias("id"), F.col("price").cast("double").alias("price"), F.col("cust").cast("string").alias("cust"))


@query("wafer_traces", """WITH l AS (SELECT l_orderkey AS pass, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) - 1 AS t,
 CASE WHEN l_linenumber % 3 <> 2 THEN l_quantity END AS p, CASE WHEN l_orderkey % 5 <> 0 THEN l_discount END AS q FROM lineitem),
n AS (SELECT *, last_value(p IGNORE NULLS) OVER b AS bv, last_value(CASE WHEN p IS NOT NULL THEN t END IGNORE NULLS) OVER b AS bt,
 first_value(p IGNORE NULLS) OVER a AS av, first_value(CASE WHEN p IS NOT NULL THEN t END IGNORE NULLS) OVER a AS at_ FROM l
 WINDOW b AS (PARTITION BY pass ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY pass ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT pass, t, round(coalesce(CASE WHEN at_ > bt THEN bv + (av - bv) * (t - bt) / (at_ - bt) ELSE coalesce(bv, av) END, 0), 6) AS p, round(coalesce(q, 0), 6) AS q,
 round(CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE), 2) AS target FROM n JOIN orders ON o_orderkey = pass WHERE o_orderkey % 6 = 0 AND o_orderkey // 6 % 2 = 0 AND o_custkey % 4 <> 0""")
def wafer_traces(spark, sf):
    """Traces, catalog and measurements as files, read back by the loader: passes of the trace recipe with a label.

    Line number and price give the time, which is unique within an order. Only measurements of the first kind carry the job that the catalog names.
    """
    path = fresh_path(spark, "wafers")
    o = table(spark, sf, "orders")
    l = table(spark, sf, "lineitem")
    traces = l.select(
        F.col("l_orderkey").alias("WaferPassID"), F.timestamp_seconds(F.col("l_linenumber").cast("long") * 10**9 + F.round(F.col("l_extendedprice") * 100).cast("long")).cast("string").alias("TimeStamp"),
        F.when(F.col("l_linenumber") % 3 != 2, F.col("l_quantity")).alias("p"), F.when(F.col("l_orderkey") % 5 != 0, F.col("l_discount")).alias("q"),
        F.expr("l_orderkey div 2000").alias("file"))
    n_files = 8 + l.count() // TRACE_ROWS  # all of one folder: listing many folders takes longer than reading them
    traces.repartition(n_files, "file").drop("file").write.option("header", True).csv(f"{path}/tracedata")
    written = D.read_csv(spark, f"{path}/tracedata", schema=traces.drop("file").schema).select("WaferPassID", F.element_at(F.split("_file", "/"), -1).alias("name")).distinct()
    job = F.concat(F.lit("T-"), F.col("o_orderkey"))
    catalog = o.join(written, F.col("o_orderkey") == F.col("WaferPassID")).select(
        "WaferPassID", F.col("o_custkey").alias("WaferID"), F.lit("T").alias("ToolID"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".1")).alias("PJID"),
        F.when(F.col("o_orderkey") % 2 == 0, "CH2").otherwise("CH1").alias("ChamberID"), F.when(F.col("o_orderkey") % 3 == 0, "QUALCH2CO20").otherwise("OTHER").alias("ChamberRecipeID"),
        F.concat(F.lit("D:/x/"), F.replace(F.col("name"), F.lit(".csv"), F.lit(".zip"))).alias("TraceDataFile"))
    catalog.write.option("header", True).csv(f"{path}/catalog")
    known = o.filter("o_custkey % 4 <> 0")
    for folder, job_name, value, kind in (("Rate_time_series_x_Average_", "Proc_cj_id", "Mea_value", 0), ("mCTF_x_Average_", "Control_job_id", "Wafer_mean", 1),
                                          ("Rate_time_series_x_StdDev_", "Proc_cj_id", "Std_dep_thk", 0), ("mCTF_x_StdDev_", "Control_job_id", "Wafer_std", 1)):
        known.filter(F.expr("o_orderkey div 6 % 2") == kind).select(job.alias(job_name), F.col("o_custkey").alias("Wafer_id"), F.col("o_totalprice").alias(value)).write.option(
            "header", True).csv(f"{path}/measurements/{folder}")
    steps, labels = D.load_wafers(spark, path, trace_schema=traces.drop("file").schema, catalog_schema=catalog.schema)
    return steps.join(labels, "sample_id").select(F.col("sample_id").alias("pass"), "t", r6("p").alias("p"), r6("q").alias("q"), F.round(F.col("target").cast("double"), 2).alias("target"))


@query("archive_samples", f"""WITH {VEC}, g AS (SELECT sample_id, label, t // 32 AS f, t % 32 AS t, round(x, 6) AS x FROM v),
n AS (SELECT *, lag(x) OVER w AS b, lead(x) OVER w AS a FROM g WINDOW w AS (PARTITION BY sample_id, f ORDER BY t))
SELECT sample_id, CAST(f AS INTEGER) AS dim_id, CAST(t AS INTEGER) AS reading_id, round(CASE WHEN t = 0 THEN a WHEN t % 5 = 0 THEN (a + b) / 2 ELSE x END, 7) AS value,
 CAST(label AS INTEGER) AS code, CAST(32 AS INTEGER) AS length FROM n""")
def archive_samples(spark, sf):
    """Archive files in one call: read, interpolated, labels numbered, the length that models take."""
    cases, lengths, _ = D.load_dataset(spark, "archive", ts_files(spark, sf), extension=".txt")
    observed = lengths.agg(F.max("max_len")).first()[0]
    known = cases.select((part_of("file") * CHUNK + F.col("case_no")).alias("sample_id"), "dims", "code")
    steps = P.nested_to_long(known, "sample_id").withColumn("value", r6("value", 7)).join(known.select("sample_id", "code"), "sample_id")
    return steps.withColumn("length", F.lit(D.resolve_length(None, "archive", observed)).cast("int"))


@query("continuous_samples", f"""WITH {CLEAN}, {windows_sql('clean', (-3, -2, -1, 0), 'c.pos % 2 = 0')},
m AS {mode_sql('rd', 'user_id, center', 't', 'event_type')}, s AS (SELECT user_id, center, sum(value) AS v, sum(k) AS k FROM rd GROUP BY 1, 2),
r AS (SELECT s.*, m.label, row_number() OVER (PARTITION BY m.label ORDER BY s.user_id, s.center) - 1 AS r, count(*) OVER (PARTITION BY m.label) AS n,
  dense_rank() OVER (ORDER BY m.label) - 1 AS code FROM s JOIN m ON s.user_id = m.user_id AND s.center = m.center),
c AS (SELECT *, n - 60 AS m, CASE WHEN n > 60 THEN (r * (n - 60) + n - 1) // n END AS q FROM r)
SELECT user_id, center, CAST(code AS INTEGER) AS code, round(v, 5) AS v, round(k, 5) AS k FROM c WHERE m <= 0 OR NOT (q < m AND (q * n) // m = r)""")
def continuous_samples(spark, sf):
    """A continuous frame in one call: grid, windows, most frequent label, at most 60 windows of a class, labels numbered."""
    path = fresh_path(spark, "frame")
    patchy_events(spark, sf).drop("us").write.parquet(path)
    found, _, _ = D.load_dataset(spark, "continuous_samples", path, cols=COLS, freq_ms=STEP_MS, max_gap_s=GAP_S, overlap="ignore",
                                 stamps=(-3, -2, -1, 0), label_stamps=(-3, -2, -1, 0), jump=2, max_per_class=60)

    def total(c):
        return F.aggregate("steps", F.lit(0.0), lambda a, x: a + x[c])

    return found.select("user_id", "center", "code", r6(total("value"), 5).alias("v"), r6(total("k"), 5).alias("k"))
