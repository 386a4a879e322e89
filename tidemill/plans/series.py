"""Continuous series: clamp, resample, fill, window."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import resample as R
from tidemill.operators import windows as W
from tidemill.plans.registry import events, patchy_events, query, r6
from tidemill.schema import Columns
from tidemill.session import materialize

HOUR_MS = 3_600_000
STEP_MS = 12 * HOUR_MS
STEP_US = STEP_MS * 1000
GAP_S = 2 * 12 * 3600  # two slots
COLS = Columns("ts", "user_id", "event_type", ("value", "k"))  # no user has two events at one instant

EV = """ev AS (SELECT event_id, epoch_us(ts) AS us, user_id, event_type, value,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)"""
EVN = EV + """, evn AS (SELECT event_id, us, user_id,
  CASE WHEN event_id % 5 <> 0 THEN event_type END AS event_type,
  CASE WHEN event_id % 7 <> 0 THEN value END AS value,
  CASE WHEN event_id % 9 <> 0 THEN k END AS k FROM ev)"""
CLAMP = EVN + """, rng AS (SELECT user_id, min(us) FILTER (event_type IS NOT NULL) AS lo,
  max(us) FILTER (event_type IS NOT NULL) AS hi FROM evn GROUP BY user_id HAVING count(event_type) > 0),
cl AS (SELECT e.* FROM evn e JOIN rng r ON e.user_id = r.user_id WHERE us > lo AND us < hi)"""


def buckets_sql(source: str, step_us: int = STEP_US) -> str:
    last = ", ".join(
        f"arg_max({c}, us) FILTER ({c} IS NOT NULL) AS {c}" for c in ("event_type", "value", "k"))
    return f"bk AS (SELECT user_id, us // {step_us} AS bucket, {last}, count(*) AS n FROM {source} GROUP BY 1, 2)"


GRID = """span AS (SELECT user_id, min(bucket) AS base, max(bucket) - min(bucket) + 1 AS length, sum(n) AS n FROM bk GROUP BY 1),
slots AS (SELECT user_id, base, length, unnest(generate_series(0, length - 1)) AS pos FROM span WHERE n > 1),
gr AS (SELECT s.user_id, s.pos, s.base, s.length, b.event_type, b.value, b.k
  FROM slots s LEFT JOIN bk b ON b.user_id = s.user_id AND b.bucket = s.base + s.pos)"""


def near_sql(source: str, key: str, columns: tuple[str, ...], keep: str) -> str:
    parts = []
    for c in columns:
        parts += [
            f"last_value(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) OVER p AS {c}_pp",
            f"last_value({c} IGNORE NULLS) OVER p AS {c}_pv",
            f"first_value(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) OVER n AS {c}_np",
            f"first_value({c} IGNORE NULLS) OVER n AS {c}_nv",
        ]
    return f"""near AS (SELECT {keep}, {', '.join(columns)}, {', '.join(parts)} FROM {source}
  WINDOW p AS (PARTITION BY {key} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         n AS (PARTITION BY {key} ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def line_sql(c: str, n: int = 10**15) -> str:
    return f"""CASE WHEN {c} IS NOT NULL THEN {c}
  WHEN {c}_pp IS NOT NULL AND {c}_np IS NOT NULL THEN CASE WHEN pos - {c}_pp <= {n} OR {c}_np - pos <= {n}
    THEN {c}_pv + ({c}_nv - {c}_pv) * (pos - {c}_pp) / ({c}_np - {c}_pp) END
  WHEN {c}_pp IS NOT NULL THEN CASE WHEN pos - {c}_pp <= {n} THEN {c}_pv END
  WHEN {c}_np - pos <= {n} THEN {c}_nv END"""


def carry_sql(c: str, n: int = 10**15) -> str:
    return f"""CASE WHEN {c} IS NOT NULL THEN {c}
  WHEN {c}_pp IS NOT NULL THEN CASE WHEN pos - {c}_pp <= {n} THEN {c}_pv END
  WHEN {c}_np - pos <= {n} THEN {c}_nv END"""


NEAR = near_sql("gr", "user_id", ("event_type", "value", "k"), "user_id, pos, base, length")


def filled_sql(n: int | None) -> str:
    lim = 10**15 if n is None else n
    return f"""fl AS (SELECT user_id, pos, base, length, {carry_sql('event_type', lim)} AS event_type,
  {line_sql('value', lim)} AS value, {line_sql('k', lim)} AS k FROM near),
bad AS (SELECT DISTINCT user_id FROM fl WHERE event_type IS NULL OR value IS NULL OR k IS NULL),
clean AS (SELECT * FROM fl WHERE user_id NOT IN (SELECT user_id FROM bad))"""


CLEAN = f"{CLAMP}, {buckets_sql('cl')}, {GRID}, {NEAR}, {filled_sql(2)}"
FULL = f"{CLAMP}, {buckets_sql('cl')}, {GRID}, {NEAR}, {filled_sql(None)}"


def clean_grid(spark, sf, gap_s=GAP_S, **kw):
    return R.regularize(patchy_events(spark, sf), COLS, STEP_MS, gap_s, overlap="ignore", **kw)


def _grid_out(df):
    return df.select("user_id", "pos", "slot_us", "event_type", r6("value").alias("value"), r6("k").alias("k"))


def mode_sql(source: str, key: str, order: str, value: str) -> str:
    """Most frequent value per key, first seen wins a tie."""
    return f"""(SELECT {key}, arg_max(v, ord) AS label FROM (SELECT {key}, {value} AS v,
  {{'n': count(*), 'p': -min({order})}} AS ord FROM {source} WHERE {value} IS NOT NULL GROUP BY {key}, {value}) GROUP BY {key})"""


WINDOW_READS = """win AS (SELECT c.user_id, c.pos AS center, c.length, s.stamp, s.t,
    least(greatest(c.pos + s.stamp, 0), c.length - 1) AS src
  FROM {grid} c, (SELECT unnest([{stamps}]) AS stamp, generate_subscripts([{stamps}], 1) - 1 AS t) s
  WHERE {where}),
rd AS (SELECT w.user_id, w.center, w.t, w.stamp, w.length, g.event_type, g.value, g.k FROM win w
  JOIN {grid} g ON g.user_id = w.user_id AND g.pos = w.src)"""


def windows_sql(grid: str, stamps, where: str) -> str:
    return WINDOW_READS.format(grid=grid, stamps=", ".join(map(str, stamps)), where=where)


def flagship(spark, sf):
    """Clamp, resample, gap-limited fill, windows, mode label, per-class mean of window means."""
    grid, _ = clean_grid(spark, sf)
    stamps = (-3, -2, -1, 0)
    win = W.sample_windows(grid, "user_id", ["value", "k"], "event_type", stamps, stamps, jump=2)

    def window_mean(c):
        return F.aggregate("steps", F.lit(0.0), lambda a, s: a + s[c]) / len(stamps)

    means = win.select("label", window_mean("value").alias("v"), window_mean("k").alias("k"))
    return means.groupBy(F.col("label").alias("event_type")).agg(
        F.count("*").alias("windows"), r6(F.avg("v")).alias("mean_value"), r6(F.avg("k")).alias("mean_k"))


query("flagship_window_means", f"""WITH {CLEAN}, {windows_sql('clean', (-3, -2, -1, 0), 'c.pos % 2 = 0')},
m AS {mode_sql('rd', 'user_id, center', 't', 'event_type')},
w AS (SELECT user_id, center, sum(value ORDER BY t) / 4 AS v, sum(k ORDER BY t) / 4 AS k FROM rd GROUP BY 1, 2)
SELECT m.label AS event_type, count(*) AS windows, round(avg(v), 6) AS mean_value, round(avg(k), 6) AS mean_k
FROM w JOIN m ON w.user_id = m.user_id AND w.center = m.center GROUP BY 1""")(flagship)


@query("group_clamp_to_labels", f"""WITH {CLAMP} SELECT user_id, count(*) AS n, min(us) AS first_us, max(us) AS last_us
FROM cl GROUP BY 1""")
def clamp_groups(spark, sf):
    kept = R.clamp(patchy_events(spark, sf), COLS)
    return kept.groupBy("user_id").agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


@query("group_without_labels_skipped", f"""WITH {EVN} SELECT user_id, count(*) AS n FROM evn
WHERE user_id % 4 <> 0 AND user_id IS NOT NULL GROUP BY 1 HAVING count(CASE WHEN user_id % 3 <> 0 THEN event_type END) > 0""")
def labelless(spark, sf):
    df = patchy_events(spark, sf).withColumns({
        "event_type": F.when(F.col("user_id") % 3 != 0, F.col("event_type")),
        "user_id": F.when(F.col("user_id") % 4 != 0, F.col("user_id")),
    })
    return R.group_ranges(df, COLS).select("user_id", F.col("n_rows").alias("n"))


@query("group_too_short_audit", f"""WITH {EV}, s AS (SELECT user_id, us, CASE WHEN event_id % 37 = 0 THEN event_type END AS event_type FROM ev),
g AS (SELECT user_id, min(us) FILTER (event_type IS NOT NULL) AS lo, max(us) FILTER (event_type IS NOT NULL) AS hi FROM s GROUP BY 1 HAVING count(event_type) > 0)
SELECT CAST(g.user_id AS VARCHAR) AS "group", 'too_short' AS rule, CAST(count(CASE WHEN us > lo AND us < hi THEN 1 END) AS BIGINT) AS rows
FROM g JOIN s ON s.user_id = g.user_id GROUP BY 1 HAVING count(CASE WHEN us > lo AND us < hi THEN 1 END) < 2""")
def too_short(spark, sf):
    df = events(spark, sf).withColumn("event_type", F.when(F.col("event_id") % 37 == 0, F.col("event_type")))
    _, audit = R.regularize(df, COLS, STEP_MS, GAP_S, overlap="ignore")
    return audit.filter("rule = 'too_short'")


DAY = """dy AS (SELECT event_id, us, CASE WHEN event_id % 11 <> 0 THEN us // 86400000000 END AS day,
  CASE WHEN event_id % 5 <> 0 THEN event_type END AS event_type, value, k FROM ev),
dr AS (SELECT day, min(us) FILTER (event_type IS NOT NULL) AS lo, max(us) FILTER (event_type IS NOT NULL) AS hi
  FROM dy WHERE day IS NOT NULL GROUP BY 1)"""
DAY_COLS = Columns("ts", "day", "event_type", ("value", "k"), "event_id")


def day_groups(spark, sf):
    """Days as groups that do not overlap in time; every 11th row belongs to no group."""
    df = events(spark, sf)
    day = F.expr("us div 86400000000")
    return df.withColumns({
        "day": F.when(F.col("event_id") % 11 != 0, day),
        "event_type": F.when(F.col("event_id") % 5 != 0, F.col("event_type")),
    })


@query("interval_membership_adopts_rows", f"""WITH {EV}, {DAY}
SELECT r.day, count(*) AS n, count(*) FILTER (y.day IS NULL) AS adopted, CAST(sum(y.event_id) AS BIGINT) AS ids
FROM dr r JOIN dy y ON y.us > r.lo AND y.us < r.hi AND (y.day = r.day OR y.day IS NULL) GROUP BY 1""")
def adopted(spark, sf):
    df = day_groups(spark, sf).withColumn("own", F.col("day").isNotNull())
    rows = R.clamp(R.adopt_rows(df, DAY_COLS), DAY_COLS)
    return rows.groupBy("day").agg(
        F.count("*").alias("n"), F.count_if(~F.col("own")).alias("adopted"), F.sum("event_id").alias("ids"))


@query("overlapping_groups_rejected", f"""WITH {EVN}, r AS (SELECT user_id, min(us) FILTER (event_type IS NOT NULL) AS lo,
  max(us) FILTER (event_type IS NOT NULL) AS hi FROM evn GROUP BY 1 HAVING count(event_type) > 0)
SELECT r.user_id, count(*) AS foreign_rows FROM r JOIN evn e ON e.user_id <> r.user_id AND e.us > r.lo AND e.us < r.hi GROUP BY 1""")
def overlapping(spark, sf):
    return R.overlapping_groups(patchy_events(spark, sf), COLS)


@query("single_timeline_regularized", f"""WITH {EV}, {DAY},
cl AS (SELECT r.day AS user_id, y.us, y.event_type, y.value, y.k FROM dr r JOIN dy y
  ON y.us > r.lo AND y.us < r.hi AND (y.day = r.day OR y.day IS NULL)),
{buckets_sql('cl', 600_000_000)}, {GRID}, {NEAR}, {filled_sql(30)}
SELECT user_id AS day, count(*) AS slots, round(sum(value), 4) AS value, round(sum(k), 4) AS k, count(DISTINCT event_type) AS labels
FROM clean GROUP BY 1""")
def timeline(spark, sf):
    grid, _ = R.regularize(day_groups(spark, sf), DAY_COLS, 600_000, 18_000, overlap="reject")
    return grid.groupBy("day").agg(
        F.count("*").alias("slots"), r6(F.sum("value"), 4).alias("value"), r6(F.sum("k"), 4).alias("k"),
        F.countDistinct("event_type").alias("labels"))


@query("bucket_last_non_null", f"""WITH {CLAMP}, {buckets_sql('cl')}
SELECT user_id, bucket, event_type, value, k, n FROM bk""")
def bucket_last(spark, sf):
    b = R.bucket_last(R.clamp(patchy_events(spark, sf), COLS), COLS, STEP_MS)
    return b.select("user_id", "bucket", "event_type", "value", "k", F.col("n_rows").alias("n"))


@query("resample_regular", f"""WITH {EVN}, {buckets_sql('evn')}, {GRID}
SELECT user_id, pos, (base + pos) * {STEP_US} AS slot_us, event_type, value, k FROM gr""")
def resample(spark, sf):
    return R.resample(patchy_events(spark, sf), COLS, STEP_MS).select("user_id", "pos", "slot_us", "event_type", "value", "k")


SEVEN_H = 7 * HOUR_MS


@query("resample_first_day_anchor", f"""WITH {EVN}, a AS (SELECT user_id, min(us) - min(us) % 86400000000 AS anchor FROM evn GROUP BY 1),
bk AS (SELECT e.user_id, any_value(anchor) AS anchor, (us - anchor) // {SEVEN_H * 1000} AS bucket, arg_max(event_type, us) FILTER (event_type IS NOT NULL) AS event_type,
  arg_max(value, us) FILTER (value IS NOT NULL) AS value, arg_max(k, us) FILTER (k IS NOT NULL) AS k, count(*) AS n
  FROM evn e JOIN a ON a.user_id = e.user_id GROUP BY e.user_id, 3), {GRID}
SELECT g.user_id, pos, anchor + (base + pos) * {SEVEN_H * 1000} AS slot_us, event_type, value FROM gr g JOIN a ON a.user_id = g.user_id""")
def resample_anchor(spark, sf):
    return R.resample(patchy_events(spark, sf), COLS, SEVEN_H).select("user_id", "pos", "slot_us", "event_type", "value")


def _filled(source, columns):
    return f"""WITH {CLAMP}, {buckets_sql('cl')}, {GRID}, {NEAR} {source}"""


@query("interpolate_gap_limited", f"""WITH {CLAMP}, {buckets_sql('cl')}, {GRID}, {NEAR}
SELECT user_id, pos, round({line_sql('value', 2)}, 6) AS value, round({line_sql('k', 2)}, 6) AS k FROM near""")
def interp_limited(spark, sf):
    grid, _ = clean_grid(spark, sf, on_gap="keep")
    return grid.select("user_id", "pos", r6("value").alias("value"), r6("k").alias("k"))


@query("label_fill_limited", f"""WITH {CLAMP}, {buckets_sql('cl')}, {GRID}, {NEAR}
SELECT user_id, pos, {carry_sql('event_type', 2)} AS event_type FROM near""")
def label_fill(spark, sf):
    grid, _ = clean_grid(spark, sf, on_gap="keep")
    return grid.select("user_id", "pos", "event_type")


@query("label_back_fill_start_only", f"""WITH {CLAMP}, {buckets_sql('cl')}, {GRID}, {NEAR}
SELECT user_id, count(*) AS leading_slots, min({carry_sql('event_type', 2)}) AS event_type FROM near WHERE event_type_pp IS NULL GROUP BY 1""")
def back_fill(spark, sf):
    grid, _ = clean_grid(spark, sf, on_gap="keep")
    raw = R.resample(R.clamp(patchy_events(spark, sf), COLS), COLS, STEP_MS)
    first = raw.filter("event_type IS NOT NULL").groupBy("user_id").agg(F.min("pos").alias("__first"))
    lead = grid.join(first, "user_id").filter("pos < __first")
    return lead.groupBy("user_id").agg(F.count("*").alias("leading_slots"), F.min("event_type").alias("event_type"))


@query("fill_unlimited", f"""WITH {FULL} SELECT user_id, pos, (base + pos) * {STEP_US} AS slot_us, event_type, round(value, 6) AS value, round(k, 6) AS k FROM fl""")
def fill_unlimited(spark, sf):
    grid, _ = clean_grid(spark, sf, gap_s=-1)
    return _grid_out(grid)


@query("groups_with_gaps_rejected", f"""WITH {CLEAN} SELECT user_id, pos, (base + pos) * {STEP_US} AS slot_us, event_type,
  round(value, 6) AS value, round(k, 6) AS k FROM clean""")
def rejected(spark, sf):
    return _grid_out(clean_grid(spark, sf)[0])


@query("gap_audit", f"""WITH {CLEAN} SELECT CAST(b.user_id AS VARCHAR) AS "group", 'gap' AS rule, count(*) AS rows
FROM bk JOIN bad b ON b.user_id = bk.user_id GROUP BY 1""")
def gap_audit(spark, sf):
    return clean_grid(spark, sf)[1].filter("rule = 'gap'")


@query("zero_gap_keeps_complete_groups", f"""WITH {CLAMP}, a AS (SELECT user_id, min(us) - min(us) % 86400000000 AS anchor FROM cl GROUP BY 1),
bk AS (SELECT e.user_id, (us - anchor) // {STEP_US * 10} AS bucket, arg_max(event_type, us) FILTER (event_type IS NOT NULL) AS event_type,
  arg_max(value, us) FILTER (value IS NOT NULL) AS value, arg_max(k, us) FILTER (k IS NOT NULL) AS k, count(*) AS n
  FROM cl e JOIN a ON a.user_id = e.user_id GROUP BY e.user_id, 2), {GRID},
bad AS (SELECT DISTINCT user_id FROM gr WHERE event_type IS NULL OR value IS NULL OR k IS NULL)
SELECT user_id, pos, event_type, value, k FROM gr WHERE user_id NOT IN (SELECT user_id FROM bad)""")
def zero_gap(spark, sf):
    grid, _ = R.regularize(patchy_events(spark, sf), COLS, STEP_MS * 10, 0, overlap="ignore")
    return grid.select("user_id", "pos", "event_type", "value", "k")


SMP = """sm AS (SELECT event_id, us, user_id AS sample, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS pos,
  CASE WHEN event_id % 3 <> 0 THEN value END AS value FROM ev)"""


@query("interpolate_per_sample", f"""WITH {EV}, {SMP}, {near_sql('sm', 'sample', ('value',), 'sample, pos')}
SELECT sample, pos AS t, round({line_sql('value')}, 6) AS value FROM near""")
def interp_sample(spark, sf):
    rows = W.positioned(events(spark, sf), ["user_id"], ["us", "event_id"])
    rows = rows.select(F.col("user_id").alias("sample"), F.col("pos").alias("t"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"))
    return R.interpolate(rows, ["sample"], "t", ["value"]).select("sample", "t", r6("value").alias("value"))


# ---- windows -------------------------------------------------------------------------------------------

def _long(win):
    return W.explode_steps(win, "user_id").select("user_id", "center", "t", r6("value").alias("value"), r6("k").alias("k"))


def long_sql(where: str, stamps, extra: str = "", value: str = "value", k: str = "k") -> str:
    return f"""WITH {CLEAN}, {windows_sql('clean', stamps, where)}
SELECT user_id, center, CAST(t AS INTEGER) AS t, round({value}, 6) AS value, round({k}, 6) AS k FROM rd {extra}"""


@query("sliding_windows", long_sql("c.pos % 3 = 0", (-4, -2, 0, 1)))
def sliding(spark, sf):
    grid, _ = clean_grid(spark, sf)
    return _long(W.sample_windows(grid, "user_id", ["value", "k"], "event_type", (-4, -2, 0, 1), jump=3))


@query("sliding_windows_far_stamps", long_sql("c.pos % 5 = 0", (-20, 0, 15)))
def far_stamps(spark, sf):
    grid, _ = clean_grid(spark, sf)
    return _long(W.sample_windows(grid, "user_id", ["value", "k"], "event_type", (-20, 0, 15), jump=5))


@query("windows_extrapolate", long_sql("true", (-3, -2, -1, 0, 1, 2)))
def extrapolate(spark, sf):
    grid, _ = clean_grid(spark, sf)
    return _long(W.sample_windows(grid, "user_id", ["value", "k"], "event_type", (-3, -2, -1, 0, 1, 2), method="frame"))


@query("windows_skip", long_sql("c.pos % 2 = 0 AND c.pos >= 3 AND c.pos + 2 < c.length", (-3, -1, 0)))
def skip(spark, sf):
    grid, _ = clean_grid(spark, sf)
    return _long(W.sample_windows(grid, "user_id", ["value", "k"], "event_type", (-3, -1, 0), (0, 2), 2, "skip"))


ZERO = "CASE WHEN center + stamp < 0 OR center + stamp >= length THEN 0 ELSE {} END"


@query("windows_zero_padded", long_sql("c.pos % 2 = 0", (-3, 0, 2), "", ZERO.format("value"), ZERO.format("k")))
def zeros(spark, sf):
    grid, _ = clean_grid(spark, sf)
    return _long(W.sample_windows(grid, "user_id", ["value", "k"], "event_type", (-3, 0, 2), jump=2, padding="zeros"))


@query("windows_start_offset", long_sql("c.pos >= 5 AND (c.pos - 5) % 4 = 0", (-1, 0)))
def start_offset(spark, sf):
    grid, _ = clean_grid(spark, sf)
    return _long(W.sample_windows(grid, "user_id", ["value", "k"], "event_type", (-1, 0), jump=4, start=5))


@query("window_label_mode", f"""WITH {CLEAN}, {windows_sql('clean', (-3, -2, -1, 0), 'c.pos % 2 = 0')}
SELECT * FROM {mode_sql('rd', 'user_id, center', 't', 'event_type')}""")
def label_mode(spark, sf):
    grid, _ = clean_grid(spark, sf)
    stamps = (-3, -2, -1, 0)
    return W.sample_windows(grid, "user_id", ["value"], "event_type", (0,), stamps, 2).select("user_id", "center", "label")


@query("window_label_aggregates", f"""WITH {CLEAN}, {windows_sql('clean', (-2, -1, 0), 'c.pos % 2 = 0')}
SELECT user_id, center, round(avg(length(event_type)), 6) AS mean, CAST(max(length(event_type)) AS INTEGER) AS max, CAST(min(length(event_type)) AS INTEGER) AS min,
 CAST(sum(length(event_type)) AS DOUBLE) AS sum, string_agg(CAST(length(event_type) AS VARCHAR), ',' ORDER BY t) AS "all" FROM rd GROUP BY 1, 2""")
def label_aggs(spark, sf):
    grid, _ = clean_grid(spark, sf)
    numbered = grid.withColumn("code", F.length("event_type"))
    win = W.sample_windows(numbered, "user_id", ["value"], "code", (0,), (-2, -1, 0), 2, label_agg="all")
    from tidemill.functions.arrays import LABEL_AGGREGATES as L

    return win.select(
        "user_id", "center", r6(L["mean"](F.col("labels"))).alias("mean"), L["max"](F.col("labels")).alias("max"),
        L["min"](F.col("labels")).alias("min"), L["sum"](F.col("labels")).alias("sum"),
        F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("all"))


@query("count_windows", f"""WITH {EV}, i AS (SELECT *, row_number() OVER (ORDER BY us, event_id) - 1 AS i FROM ev)
SELECT i // 64 AS sample_id, count(*) AS n, round(avg(value), 6) AS mean_value, min(event_id) AS first_event, max(i % 64) AS last_t FROM i GROUP BY 1""")
def count_windows(spark, sf):
    w = W.count_windows(events(spark, sf), ["us", "event_id"], 64)
    return w.groupBy("sample_id").agg(
        F.count("*").alias("n"), r6(F.avg("value")).alias("mean_value"), F.min("event_id").alias("first_event"), F.max("t").alias("last_t"))


@query("class_cap_by_stride", f"""WITH {EV}, r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS r,
  count(*) OVER (PARTITION BY event_type) AS n FROM ev), m AS (SELECT *, n - 140 AS m FROM r),
k AS (SELECT *, CASE WHEN m > 0 THEN (r * m + n - 1) // n END AS k FROM m)
SELECT event_id, event_type FROM k WHERE m <= 0 OR NOT (k < m AND (k * n) // m = r)""")
def class_cap(spark, sf):
    return W.cap_per_class(events(spark, sf).select("event_id", "event_type"), "event_type", ["event_id"], 140)


@query("continuous_frame_read", f"""WITH {EV} SELECT user_id, count(*) AS n, min(us) AS first_us, round(sum(value), 4) AS value FROM ev GROUP BY 1""")
def continuous(spark, sf):
    from tidemill.session import fresh_path
    from tidemill.sources.datasets import load_dataset

    path = fresh_path(spark, "continuous")
    events(spark, sf).drop("us").write.parquet(path)
    df = load_dataset(spark, "continuous", path)
    COLS.check(df)
    from tidemill.functions.scalars import epoch_us

    return df.groupBy("user_id").agg(F.count("*").alias("n"), F.min(epoch_us(F.col("ts"))).alias("first_us"), r6(F.sum("value"), 4).alias("value"))
