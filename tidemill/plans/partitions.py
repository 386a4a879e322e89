"""Split tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import splits as X
from tidemill.operators import tracking as T
from tidemill.plans.registry import events, query, table
from tidemill.plans.samples import vectors
from tidemill.session import fresh_path

SEED = 1337


def hash_sql(*parts: str) -> str:
    text = " || '-' || ".join(parts)
    return f"CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT)"


def ratio_sql(ids: str, key: str, test: float, val: float, folds: int, strata: str = "0", first: int = 0) -> str:
    return f"""WITH src AS ({ids}),
t AS (SELECT *, row_number() OVER (PARTITION BY {strata} ORDER BY {hash_sql(f"'{SEED}-test'", f'CAST({key} AS VARCHAR)')}, {key}) <= ceil(count(*) OVER (PARTITION BY {strata}) * {test}::DOUBLE) AS is_test FROM src),
f AS (SELECT unnest(generate_series({first}, {folds - 1})) AS fold),
v AS (SELECT fold, t.*, row_number() OVER (PARTITION BY fold, {strata} ORDER BY {hash_sql(f"'{SEED}-val'", 'CAST(fold AS VARCHAR)', f'CAST({key} AS VARCHAR)')}, {key}) <= ceil(count(*) OVER (PARTITION BY fold, {strata}) * {val}::DOUBLE) AS is_val FROM t, f WHERE NOT is_test),
sp AS (SELECT fold, {key}, 'test' AS split FROM t, f WHERE is_test UNION ALL SELECT fold, {key}, CASE WHEN is_val THEN 'val' ELSE 'train' END FROM v)"""


OUT = "SELECT CAST(fold AS INTEGER) AS fold, {key}, split FROM sp"
EVENT_IDS = "SELECT event_id, event_type, user_id FROM events"


@query("random_split", ratio_sql(EVENT_IDS, "event_id", 0.15, 0.2, 1) + OUT.format(key="event_id"))
def random_split(spark, sf):
    return X.split(events(spark, sf), "random", "event_id", 0.2, 0.15)


@query("stratified_split", ratio_sql(EVENT_IDS, "event_id", 0.15, 0.2, 1, "event_type") + OUT.format(key="event_id"))
def stratified_split(spark, sf):
    return X.split(events(spark, sf), "stratified", "event_id", 0.2, 0.15, label="event_type")


@query("repeated_splits", ratio_sql("SELECT vec_id AS sample_id, label FROM embeddings", "sample_id", 0.1, 0.25, 4, "label") + OUT.format(key="sample_id"))
def repeated(spark, sf):
    return X.split(vectors(spark, sf), "stratified", "sample_id", 0.25, 0.1, folds=4, label="label")


@query("repeated_splits_resumed", ratio_sql("SELECT vec_id AS sample_id, label FROM embeddings", "sample_id", 0.0, 0.25, 4, "0", 2) + OUT.format(key="sample_id"))
def resumed(spark, sf):
    return X.ratio_split(vectors(spark, sf), "sample_id", 0.25, folds=4, first_fold=2)


def deal_sql(source: str, name: str, k: int, salt: str) -> str:
    return f"""h_{name} AS (SELECT user_id, event_type, count(*) AS c FROM {source} GROUP BY 1, 2),
g_{name} AS (SELECT user_id, arg_max(event_type, {{'c': c, 'e': event_type}}) AS dominant, sum(c) AS size FROM h_{name} GROUP BY 1),
r_{name} AS (SELECT user_id, row_number() OVER (ORDER BY dominant, size DESC, {hash_sql(f"'{SEED}-{salt}'", 'CAST(user_id AS VARCHAR)')}, user_id) - 1 AS r FROM g_{name}),
d_{name} AS (SELECT user_id, CASE WHEN (r // {k}) % 2 = 0 THEN r % {k} ELSE {k - 1} - r % {k} END AS part FROM r_{name})"""


@query("group_stratified_split", f"""WITH src AS ({EVENT_IDS}), {deal_sql('src', 't', 5, 'test')},
rest AS (SELECT s.* FROM src s JOIN d_t ON d_t.user_id = s.user_id WHERE part <> 0), {deal_sql('rest', 'v', 4, 'val')},
f AS (SELECT unnest([0, 1]) AS fold)
SELECT CAST(fold AS INTEGER) AS fold, event_id, 'test' AS split FROM src s JOIN d_t ON d_t.user_id = s.user_id, f WHERE part = 0
UNION ALL SELECT CAST(fold AS INTEGER), event_id, CASE WHEN part = fold THEN 'val' ELSE 'train' END FROM rest s JOIN d_v ON d_v.user_id = s.user_id, f""")
def group_stratified(spark, sf):
    return X.split(events(spark, sf), "group_stratified", "event_id", 0.25, 0.2, 2, label="event_type", group="user_id")


@query("group_split", ratio_sql("SELECT DISTINCT user_id FROM events", "user_id", 0.2, 0.25, 1) + "SELECT CAST(fold AS INTEGER) AS fold, event_id, split FROM sp JOIN events e ON e.user_id = sp.user_id")
def group_split(spark, sf):
    return X.split(events(spark, sf), "group", "event_id", 0.25, 0.2, group="user_id")


@query("split_by_group_list", """SELECT 0 AS fold, event_id, CASE WHEN user_id IN (1, 3) THEN 'test' WHEN user_id IN (5, 7) THEN 'val' ELSE 'train' END AS split FROM events""")
def group_list(spark, sf):
    return X.split(events(spark, sf), "by_group_list", "event_id", group="user_id", test_groups=(1, 3), val_groups=(5, 7))


@query("split_by_file_pattern", """SELECT 0 AS fold, event_id, CASE WHEN event_id % 8 < 2 THEN 'test' WHEN event_id % 8 = 2 THEN 'val' ELSE 'train' END AS split FROM events""")
def pattern(spark, sf):
    path = fresh_path(spark, "parts")
    events(spark, sf).select("event_id", (F.col("event_id") % 8).alias("part")).write.partitionBy("part").parquet(path)
    df = spark.read.parquet(path).withColumn("file", F.col("_metadata.file_path"))
    return X.pattern_split(df, "event_id", "file", r"part=[01]/", r"part=2/")


@query("split_by_id_file", """SELECT 0 AS fold, event_id, CASE WHEN event_id % 13 = 0 THEN 'test' ELSE 'train' END AS split FROM events""")
def id_file(spark, sf):
    path = fresh_path(spark, "ids")
    df = events(spark, sf)
    df.filter("event_id % 13 = 0").select(F.col("event_id").cast("string")).write.text(path)
    return X.id_file_split(df, "event_id", path)


@query("train_on_all_repeated", """SELECT CAST(fold AS INTEGER) AS fold, vec_id AS sample_id, 'train' AS split FROM embeddings, (SELECT unnest([0, 1, 2]) AS fold)""")
def train_all(spark, sf):
    return X.train_on_all(vectors(spark, sf), "sample_id", 3)


@query("split_overlap_check", """SELECT o.o_custkey AS sample_id, CAST(count(DISTINCT CASE WHEN o_orderkey % 5 = 0 THEN 'test' ELSE 'train' END) AS BIGINT) AS n, 0 AS fold FROM orders o GROUP BY 1
HAVING count(DISTINCT CASE WHEN o_orderkey % 5 = 0 THEN 'test' ELSE 'train' END) > 1""")
def overlap(spark, sf):
    o = table(spark, sf, "orders").select(
        F.lit(0).alias("fold"), F.col("o_custkey").alias("sample_id"), F.when(F.col("o_orderkey") % 5 == 0, "test").otherwise("train").alias("split"))
    return X.overlaps(o, "sample_id")


@query("split_group_and_label_counts", ratio_sql(EVENT_IDS, "event_id", 0.15, 0.2, 1) + """, j AS (SELECT sp.*, e.user_id, e.event_type FROM sp JOIN events e ON e.event_id = sp.event_id)
SELECT CAST(fold AS INTEGER) AS fold, split, 'group' AS kind, CAST(user_id AS VARCHAR) AS value, count(*) AS n FROM j GROUP BY 1, 2, 4
UNION ALL SELECT CAST(fold AS INTEGER), split, 'label', event_type, count(*) FROM j GROUP BY 1, 2, 4""")
def counts(spark, sf):
    df = events(spark, sf)
    return X.split_counts(X.split(df, "random", "event_id", 0.2, 0.15), df, "event_id", "user_id", "event_type")


@query("limit_to_first_ids", """SELECT user_id, count(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM (SELECT DISTINCT user_id FROM events) ORDER BY user_id LIMIT 10) GROUP BY 1""")
def limited(spark, sf):
    return X.limit_ids(events(spark, sf), "user_id", 10).groupBy("user_id").agg(F.count("*").alias("n"))


@query("limit_to_share_of_ids", """SELECT user_id, count(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM (SELECT user_id, row_number() OVER (ORDER BY user_id) AS r, count(*) OVER () AS c FROM (SELECT DISTINCT user_id FROM events)) WHERE r <= floor(0.4 * c)) GROUP BY 1""")
def limited_share(spark, sf):
    return X.limit_ids(events(spark, sf), "user_id", 0.4).groupBy("user_id").agg(F.count("*").alias("n"))


@query("split_table_round_trip", ratio_sql(EVENT_IDS, "event_id", 0.0, 0.2, 2) + "SELECT CAST(fold AS INTEGER) AS fold, split, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM sp GROUP BY 1, 2")
def round_trip(spark, sf):
    path = fresh_path(spark, "splits")
    T.save_splits(X.split(events(spark, sf), "random", "event_id", 0.2, folds=2), path)
    return spark.read.parquet(path).groupBy("fold", "split").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("split_indices_json", ratio_sql(EVENT_IDS, "event_id", 0.1, 0.2, 1) + OUT.format(key="event_id"))
def indices_json(spark, sf):
    path = fresh_path(spark, "indices")
    T.split_indices_json(X.split(events(spark, sf), "random", "event_id", 0.2, 0.1), "event_id", path)
    return spark.read.schema("fold int, split string, event_id bigint").json(path)


@query("id_set_operations", """WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderkey % 3 = 0), b AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderkey % 7 = 0)
SELECT 'minus' AS op, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM (SELECT id FROM a EXCEPT SELECT id FROM b) UNION ALL
SELECT 'both', count(*), CAST(sum(id) AS BIGINT) FROM (SELECT id FROM a INTERSECT SELECT id FROM b) UNION ALL
SELECT 'either', count(*), CAST(sum(id) AS BIGINT) FROM (SELECT id FROM a UNION SELECT id FROM b)""")
def set_ops(spark, sf):
    o = table(spark, sf, "orders")
    a = o.filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("id")).distinct()
    b = o.filter("o_orderkey % 7 = 0").select(F.col("o_custkey").alias("id")).distinct()
    either = a.union(b).distinct()
    parts = [(n, d.agg(F.count("*").alias("n"), F.sum("id").alias("ids"))) for n, d in
             (("minus", a.join(b, "id", "left_anti")), ("both", a.intersect(b)), ("either", either))]
    out = None
    for n, d in parts:
        d = d.select(F.lit(n).alias("op"), "n", "ids")
        out = d if out is None else out.unionByName(d)
    return out


@query("split_kind_by_task", f"""WITH src AS ({EVENT_IDS}), {deal_sql('src', 'v', 4, 'val')}
SELECT 0 AS fold, event_id, CASE WHEN part = 0 THEN 'val' ELSE 'train' END AS split FROM src s JOIN d_v ON d_v.user_id = s.user_id""")
def kinds(spark, sf):
    df = events(spark, sf)
    kind = X.choose_kind("classification", "event_type", "user_id")
    return X.split(df, kind, "event_id", 0.25, label="event_type", group="user_id")
