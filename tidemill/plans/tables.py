"""Column rules, filters, joins and aggregations of the file-based data sets, on the warehouse tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import scalars as S
from tidemill.operators import clean as C
from tidemill.operators.quantiles import quantiles
from tidemill.plans.registry import events, query, r6, table
from tidemill.plans.series import EV


# ---- projections ---------------------------------------------------------------------------------------

@query("select_features", "SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem")
def select_features(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


def lines(spark, sf):
    """Line items as sensor records: return flag is the file; every 97th power reading is broken, every 11th interval missing."""
    l = table(spark, sf, "lineitem")
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return l.select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("file"),
        F.when(key % 97 == 0, 1e17).otherwise(F.col("l_extendedprice")).alias("per_energy"),
        F.col("l_quantity").alias("true_energy"), F.when(key % 11 != 0, F.col("l_extendedprice") / 1000).alias("diff_time"),
        F.lit(None).cast("double").alias("smart_9_raw"), F.col("l_tax").alias("smart_1_normalized"))


LINES = """ln AS (SELECT l_orderkey, l_linenumber, l_returnflag AS file, CASE WHEN (l_orderkey * 8 + l_linenumber) % 97 = 0 THEN 1e17 ELSE l_extendedprice END AS per_energy,
  l_quantity AS true_energy, CASE WHEN (l_orderkey * 8 + l_linenumber) % 11 <> 0 THEN l_extendedprice / 1000 END AS diff_time, l_tax AS smart_1_normalized FROM lineitem)"""


@query("drop_empty_columns", f"WITH {LINES} SELECT l_orderkey, l_linenumber, file, per_energy, true_energy, diff_time, smart_1_normalized FROM ln")
def drop_empty(spark, sf):
    return C.drop_empty_columns(lines(spark, sf))


@query("drop_normalized_columns", f"WITH {LINES} SELECT * EXCLUDE (smart_1_normalized), CAST(NULL AS DOUBLE) AS smart_9_raw FROM ln")
def drop_normalized(spark, sf):
    return C.drop_columns_like(lines(spark, sf), "normalized")


@query("cast_columns", """SELECT o_orderkey, epoch_us(CAST(strftime(o_orderdate, '%Y-%m-%d') AS TIMESTAMP)) AS us, o_orderstatus = 'F' AS failure, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS code FROM orders""")
def cast_columns(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), (F.col("o_orderstatus") == "F").cast("int").alias("failure"), F.substring("o_orderpriority", 1, 1).alias("p"))
    return o.select("o_orderkey", S.epoch_us(F.to_timestamp("date")).alias("us"), F.col("failure").cast("boolean").alias("failure"), F.col("p").cast("int").alias("code"))


@query("power_repair", f"""WITH {LINES}, md AS (SELECT file, median(diff_time) AS m FROM ln GROUP BY 1)
SELECT l_orderkey, l_linenumber, ln.file, round(CASE WHEN per_energy > 1e16 THEN true_energy / nullif(m, 0) ELSE per_energy END, 6) AS power FROM ln JOIN md ON md.file = ln.file""")
def power_repair(spark, sf):
    df = C.repair_power(lines(spark, sf).withColumnRenamed("per_energy", "power"), "file", "power", "true_energy", "diff_time")
    return df.select("l_orderkey", "l_linenumber", "file", r6("power").alias("power"))


@query("positional_rename", "SELECT l_orderkey AS a_0, l_partkey AS b_0, l_suppkey AS c_0, l_linenumber AS d_1, l_quantity AS e_1 FROM lineitem")
def positional_rename(spark, sf):
    l = table(spark, sf, "lineitem").selectExpr("l_orderkey AS a_10", "l_partkey AS b_20", "l_suppkey AS c_30", "l_linenumber AS d_41", "l_quantity AS e_5")
    return C.rename_by_position(l)


@query("composite_pass_key", "SELECT c_custkey, c_mktsegment || '-' || split_part(CAST(c_acctbal AS VARCHAR), '.', 1) AS pass_key FROM customer")
def pass_key(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", S.pass_key(F.col("c_mktsegment"), F.col("c_acctbal").cast("string")).alias("pass_key"))


@query("path_to_flat_csv_name", r"""SELECT page_id, regexp_replace(regexp_extract(url, '([^/\\]+)$', 1), '\.[^.]*$', '') || '.csv' AS name FROM pages""")
def flat_name(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.flat_csv_name(F.col("url")).alias("name"))


@query("class_codes", """WITH d AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS code FROM (SELECT DISTINCT event_type FROM events))
SELECT event_id, e.event_type, CAST(code AS INTEGER) AS code FROM events e JOIN d ON d.event_type = e.event_type""")
def class_codes(spark, sf):
    return C.encode_classes(events(spark, sf).select("event_id", "event_type"), "event_type")[0]


@query("class_dictionary", """SELECT n_name, CAST(row_number() OVER (ORDER BY n_name) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT n_name FROM nation JOIN customer ON c_nationkey = n_nationkey)""")
def class_dictionary(spark, sf):
    named = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return C.encode_classes(named.select("n_name"), "n_name")[1]


# ---- filters -------------------------------------------------------------------------------------------

@query("model_prefix_filter", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'ST%'")
def prefix(spark, sf):
    return table(spark, sf, "part").filter(F.col("p_type").startswith("ST")).select("p_partkey", "p_type")


@query("exclude_listed_ids", "SELECT user_id, count(*) AS n FROM events WHERE user_id NOT IN (3, 5) GROUP BY 1")
def exclude(spark, sf):
    return events(spark, sf).filter(~F.col("user_id").isin(3, 5)).groupBy("user_id").agg(F.count("*").alias("n"))


@query("recipe_filters", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag IN ('A', 'R')")
def recipes(spark, sf):
    return table(spark, sf, "lineitem").filter((F.col("l_linestatus") == "F") & F.col("l_returnflag").isin("A", "R")).select("l_orderkey", "l_linenumber")


@query("drop_unlabelled_samples", """SELECT l_orderkey AS sample_id, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey % 4 <> 0) GROUP BY 1""")
def unlabelled(spark, sf):
    steps = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sample_id"))
    labels = table(spark, sf, "orders").select(F.col("o_orderkey").alias("sample_id"), F.when(F.col("o_custkey") % 4 != 0, F.col("o_totalprice")).alias("target"))
    return C.drop_unlabelled(steps, labels, "sample_id", "target")[0].groupBy("sample_id").agg(F.count("*").alias("n"))


@query("feature_health_summary", f"""WITH {EV}, l AS (SELECT 'value' AS feature, CASE WHEN event_id % 7 <> 0 THEN value END AS x FROM ev UNION ALL SELECT 'k', k FROM ev)
SELECT feature, count(*) FILTER (x IS NULL) AS missing, count(*) FILTER (abs(x) < 1e-8) AS near_zero, count(*) FILTER (abs(x) > 1e6) AS huge, min(x) AS min, median(x) AS median, max(x) AS max FROM l GROUP BY 1""")
def health(spark, sf):
    df = events(spark, sf).withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return C.health_check(df, ["value", "k"])[0]


@query("feature_histogram", f"""WITH {EV}, l AS (SELECT 'value' AS feature, value AS x FROM ev UNION ALL SELECT 'k', k FROM ev), b AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM l GROUP BY 1)
SELECT l.feature, CAST(least(floor((x - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, count(*) AS n FROM l JOIN b ON b.feature = l.feature GROUP BY 1, 2""")
def feature_histogram(spark, sf):
    return C.health_check(events(spark, sf), ["value", "k"])[1]


# ---- joins ---------------------------------------------------------------------------------------------

def measurement(spark, sf, which: int, value: str, job: str):
    """Suppliers' line totals as wafer measurements, of all lines: odd line numbers are the first kind; even ones are cut in two
    overlapping ways."""
    kinds = {1: "l_linenumber % 2 = 1", 2: "l_linenumber % 2 = 0", 3: "l_linenumber % 2 = 0 OR l_suppkey % 2 = 0"}
    l = table(spark, sf, "lineitem").filter(kinds[which])
    picked = l.groupBy(F.col("l_orderkey").alias("Wafer_id")).agg(F.max("l_suppkey").alias(job), F.round(F.sum("l_quantity"), 2).alias(value))
    return picked


MEAS = """m1 AS (SELECT l_orderkey AS w, max(l_suppkey) AS j, round(sum(l_quantity), 2) AS v FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1),
m2 AS (SELECT l_orderkey AS w, max(l_suppkey) AS j, round(sum(l_quantity), 2) AS v FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1),
m3 AS (SELECT l_orderkey AS w, max(l_suppkey) AS j, round(sum(l_quantity), 2) AS v FROM lineitem WHERE l_linenumber % 2 = 0 OR l_suppkey % 2 = 0 GROUP BY 1),
th AS (SELECT a.j AS pj, coalesce(a.w, b.w) AS w, b.j AS cj, coalesce(a.v, b.v) AS v, CASE WHEN a.w IS NULL THEN 'right_only' WHEN b.w IS NULL THEN 'left_only' ELSE 'both' END AS m
  FROM m1 a FULL OUTER JOIN m2 b ON a.j = b.j AND a.w = b.w),
ro AS (SELECT a.j AS pj, coalesce(a.w, b.w) AS w, b.j AS cj, coalesce(a.v, b.v) AS v, CASE WHEN a.w IS NULL THEN 'right_only' WHEN b.w IS NULL THEN 'left_only' ELSE 'both' END AS m
  FROM m1 a FULL OUTER JOIN m3 b ON a.j = b.j AND a.w = b.w)"""


def merged(spark, sf, second, value):
    return C.merge_measurements(measurement(spark, sf, 1, value, "Proc_cj_id"), measurement(spark, sf, second, value, "Control_job_id"), value)


def as_text(df):
    """Job ids as text: they may be null."""
    return df.withColumns({c: F.col(c).cast("string") for c in ("Proc_cj_id", "Control_job_id") if c in df.columns})


@query("outer_merge_thickness", f"""WITH {MEAS} SELECT CAST(pj AS VARCHAR) AS "Proc_cj_id", w AS "Wafer_id", CAST(cj AS VARCHAR) AS "Control_job_id", v AS mean_thickness, m AS _merge FROM th""")
def thickness(spark, sf):
    return as_text(merged(spark, sf, 2, "mean_thickness"))


@query("outer_merge_roughness", f"""WITH {MEAS} SELECT CAST(pj AS VARCHAR) AS "Proc_cj_id", w AS "Wafer_id", CAST(cj AS VARCHAR) AS "Control_job_id", v AS std_thickness, m AS _merge FROM ro""")
def roughness(spark, sf):
    return as_text(merged(spark, sf, 3, "std_thickness"))


@query("null_safe_inner_merge", f"""WITH {MEAS} SELECT CAST(t.pj AS VARCHAR) AS "Proc_cj_id", t.w AS "Wafer_id", t.v AS mean_thickness, r.v AS std_thickness FROM th t JOIN ro r ON t.pj IS NOT DISTINCT FROM r.pj AND t.w = r.w""")
def inner_merge(spark, sf):
    t = merged(spark, sf, 2, "mean_thickness").drop("_merge", "Control_job_id")
    r = merged(spark, sf, 3, "std_thickness").drop("_merge", "Control_job_id")
    return as_text(C.join_measurements(t, r))


@query("left_merge_catalog", """SELECT s_suppkey, s_name, n_name, CAST(n_regionkey AS VARCHAR) AS region FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey <> 2""")
def left_merge(spark, sf):
    n = table(spark, sf, "nation").filter("n_regionkey <> 2")
    s = table(spark, sf, "supplier")
    return s.join(n, s.s_nationkey == n.n_nationkey, "left").select("s_suppkey", "s_name", "n_name", F.col("n_regionkey").cast("string").alias("region"))


@query("semi_join_listed", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi(spark, sf):
    c = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'")
    o = table(spark, sf, "orders")
    return o.join(c, o.o_custkey == c.c_custkey, "left_semi").select("o_orderkey", "o_custkey")


@query("anti_join_failed", "SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.09) GROUP BY 1")
def anti(spark, sf):
    from tidemill.sources.datasets import healthy_disks

    l = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("serial_number"), ((F.col("l_quantity") > 49) & (F.col("l_discount") > 0.09)).alias("failure"))
    return healthy_disks(l).groupBy(F.col("serial_number").alias("l_suppkey")).agg(F.count("*").alias("n"))


# ---- aggregations and set operations -------------------------------------------------------------------

@query("median_per_file", f"WITH {LINES} SELECT file, round(median(diff_time), 6) AS median FROM ln GROUP BY 1")
def median(spark, sf):
    return C.median_per_file(lines(spark, sf), "file", "diff_time").withColumn("median", r6("median"))


@query("exact_quantiles", """SELECT l_returnflag, l_linestatus, quantile_cont(l_extendedprice, 0.01) AS p01, quantile_cont(l_extendedprice, 0.25) AS p25,
quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.99) AS p99 FROM lineitem GROUP BY 1, 2""")
def exact_quantiles(spark, sf):
    shares = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p99": 0.99}
    return quantiles(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", shares, small=1000, bins=64)


@query("null_counts", f"WITH {LINES} SELECT file, count(*) FILTER (diff_time IS NULL) AS diff_time, count(*) FILTER (per_energy IS NULL) AS per_energy, count(*) AS rows FROM ln GROUP BY 1")
def nulls(spark, sf):
    return C.null_counts(lines(spark, sf), ["diff_time", "per_energy"], ["file"])


@query("class_frequency", "SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM embeddings GROUP BY 1")
def frequency(spark, sf):
    return C.class_frequency(table(spark, sf, "embeddings"), "label").withColumn("share", r6("share"))


@query("distinct_ids_groups_labels", "SELECT count(DISTINCT event_id) AS ids, count(DISTINCT user_id) AS groups, count(DISTINCT event_type) AS labels FROM events")
def distinct(spark, sf):
    e = table(spark, sf, "events")
    return e.agg(F.countDistinct("event_id").alias("ids"), F.countDistinct("user_id").alias("groups"), F.countDistinct("event_type").alias("labels"))


@query("union_of_uneven_files", """SELECT o_orderkey AS id, o_totalprice AS price, NULL::VARCHAR AS part FROM orders UNION ALL SELECT l_orderkey, NULL, CAST(l_partkey AS VARCHAR) FROM lineitem""")
def union(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").cast("string").alias("part"))
    return C.union_tolerant(o, l)


@query("sort_by_id_and_time", f"WITH {EV} SELECT user_id, event_id, row_number() OVER (ORDER BY user_id, us, event_id) - 1 AS position FROM ev")
def sort(spark, sf):
    from tidemill.operators.ordered import dense_index

    return dense_index(events(spark, sf), ["user_id", "us", "event_id"], out="position").select("user_id", "event_id", "position")


@query("top_scores", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top(spark, sf):
    return table(spark, sf, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


# ---- expressions ---------------------------------------------------------------------------------------

@query("string_functions", r"""SELECT doc_id, length(trim(text)) AS trimmed, md5(lower(text)) AS lowered, starts_with(text, 'The') AS starts, contains(text, 'the') AS holds,
md5(replace(text, '?', 'NaN')) AS replaced, CAST(len(string_split(text, ',')) AS INTEGER) AS fields, regexp_matches(text, '[0-9]+') AS has_digits, md5(regexp_replace(text, '[0-9]+', '0', 'g')) AS digits, regexp_extract(source, '([a-z]+)', 1) AS first_word FROM documents""")
def strings(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", F.length(F.trim(t)).cast("bigint").alias("trimmed"), F.md5(F.lower(t)).alias("lowered"), t.startswith("The").alias("starts"), t.contains("the").alias("holds"),
        F.md5(F.replace(t, F.lit("?"), F.lit("NaN"))).alias("replaced"), F.size(F.split(t, ",")).alias("fields"), t.rlike("[0-9]+").alias("has_digits"),
        F.md5(F.regexp_replace(t, "[0-9]+", "0")).alias("digits"), F.regexp_extract("source", "([a-z]+)", 1).alias("first_word"))


@query("date_time_functions", """SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, epoch_us(max(ts)) - epoch_us(min(ts)) AS span_us,
CAST(len(generate_series(date_trunc('day', min(ts)), max(ts), INTERVAL 6 HOUR)) AS INTEGER) AS slots, epoch_us(min(ts) - INTERVAL 90 SECOND) AS before_us FROM events GROUP BY 1""")
def dates(spark, sf):
    ts = F.col("ts").cast("timestamp")
    g = events(spark, sf).groupBy("user_id").agg(F.min(ts).alias("a"), F.max(ts).alias("b"))
    return g.select(
        "user_id", S.epoch_us(F.col("a")).alias("first_us"), S.epoch_us(F.col("b")).alias("last_us"), (S.epoch_us(F.col("b")) - S.epoch_us(F.col("a"))).alias("span_us"),
        F.size(F.sequence(F.date_trunc("day", "a"), F.col("b"), F.expr("INTERVAL 6 HOURS"))).alias("slots"), S.epoch_us(F.col("a") - F.expr("INTERVAL 90 SECONDS")).alias("before_us"))


@query("math_functions", """SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice / 7) AS BIGINT) AS low, CAST(ceil(l_extendedprice / 7) AS BIGINT) AS high, least(greatest(l_quantity, 5), 40) AS clipped,
abs(l_discount - 0.05::DOUBLE) AS distance, round(exp(l_discount), 6) AS e, round(log2(l_extendedprice), 6) AS lg, round(pow(l_quantity, 1.5), 6) AS p, round(sqrt(l_quantity), 6) AS root FROM lineitem""")
def maths(spark, sf):
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.floor(p / 7).alias("low"), F.ceil(p / 7).alias("high"), F.least(F.greatest(q, F.lit(5.0)), F.lit(40.0)).alias("clipped"),
        F.abs(F.col("l_discount") - 0.05).alias("distance"), r6(F.exp("l_discount")).alias("e"), r6(F.log2(p)).alias("lg"), r6(F.pow(q, F.lit(1.5))).alias("p"), r6(F.sqrt(q)).alias("root"))
