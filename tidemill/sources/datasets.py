"""Readers of the file-based data sets, and the registry that finds them by name."""

from __future__ import annotations

import csv
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.scalars import flat_csv_name, pass_key
from tidemill.functions import arrays
from tidemill.operators import clean, samples
from tidemill.operators.ordered import dense_index
from tidemill.operators.resample import interpolate, regularize
from tidemill.operators.splits import limit_ids
from tidemill.operators.windows import cap_per_class, count_windows, length_stats, sample_windows
from tidemill.schema import Columns
from tidemill.sources.archive import read_arff, read_ts, read_tsv
from tidemill.session import materialize
from tidemill.sources.lines import select_files
from tidemill.sources.manifest import files, heads, same_path

# fixed values of the weld data: the poisoned record, the feature columns, the fixed length
WELD_BAD_ID = 920397
WELD_FEATURES = ("wire_feed_speed", "current", "voltage", "motor_current", "power")
WELD_LENGTH = 66
# fixed values of the wafer data: chamber, recipes, the recipe whose traces are used, the fixed length
WAFER_CHAMBER = "CH2"
WAFER_RECIPES = ("QUALCH2CO20", "QUALCH2CO100", "CH2_G0009")
WAFER_TRACE_RECIPE = "QUALCH2CO20"
WAFER_LENGTH = 130


MAX_LAYOUTS = 1000  # different headers that one read may meet
KIND_ROWS = 1000  # rows that rule out most kinds of a column before all rows are tested
WANTED_FILES = 10_000  # file names handed to a scan; beyond that a semi-join picks the rows


def read_csv(spark: SparkSession, path: str | Sequence[str], pattern: str | None = None, schema=None, names: Sequence[str] | None = None) -> DataFrame:
    """CSV files of one layout, with the file, and the row's place in it for a stable order. ``names``: only files so called are opened.

    Give the ``schema``; without one, an extra pass over the files guesses it.
    """
    reader = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    raw = select_files(reader.csv(path if isinstance(path, str) else list(path)), pattern)
    if names is not None:
        raw = raw.filter(F.col("_metadata.file_name").isin(list(names)))
    return raw.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"),
        F.monotonically_increasing_id().alias("_row"),
    )


def read_csv_mixed(spark: SparkSession, path: str | Sequence[str], pattern: str | None = None, names: Sequence[str] | None = None, schema=None) -> DataFrame:
    """CSV files whose columns differ, in one scan: each file's own header says where a column is; what it lacks is null.

    A table of the files' first lines is joined to the lines, and all columns of the distinct headers, by name, make the result. Records do not
    span lines; a line that repeats its file's header is taken for one. Columns named twice in a header count once. Give the ``schema``;
    without one, a pass over the values finds each column's type (bigint, double, timestamp or string). What does not fit its type is null.
    """
    listed = files(spark, path, ".csv", pattern)
    if names is not None:
        listed = listed.filter(F.element_at(F.split("file", "/"), -1).isin(list(names)))
    first = materialize(heads(listed), "heads")
    layouts = [r.head for r in first.select("head").distinct().limit(MAX_LAYOUTS + 1).collect()]
    if not layouts:
        raise ValueError(f"no csv file under {path} matches {pattern!r}")
    if len(layouts) > MAX_LAYOUTS:
        raise ValueError(f"more than {MAX_LAYOUTS} different headers under {path}")
    split = [next(csv.reader([h])) for h in layouts]
    width = max(map(len, split))
    columns = sorted({c for h in split for c in h if c}) if schema is None else [f.name for f in schema.fields]
    cells = ", ".join(f"c{i} string" for i in range(width))

    def parsed(line):
        record = F.from_csv(line, cells)
        return F.array(*[record[f"c{i}"] for i in range(width)])

    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
    lines = select_files(reader.text(path if isinstance(path, str) else list(path)), pattern)
    if names is not None:
        lines = lines.filter(F.col("_metadata.file_name").isin(list(names)))
    lines = lines.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"),
                         F.monotonically_increasing_id().alias("_row"), same_path(F.col("_metadata.file_path")).alias("__file"))
    header = first.select(same_path(F.col("file")).alias("__file"), F.col("head").alias("__head"), parsed(F.col("head")).alias("__names"))
    rows = lines.join(header, "__file").filter((F.col("value") != "") & (F.regexp_replace("value", "^\ufeff|\r$", "") != F.col("__head")))
    rows = rows.withColumn("__cells", parsed(F.regexp_replace("value", "\r$", "")))

    def column(name: str):
        place = F.array_position("__names", F.lit(name))
        return F.when(place > 0, F.get("__cells", place.cast("int") - 1))

    text = rows.select(*[column(c).alias(c) for c in columns], "_file", "_at", "_row")
    if schema is not None:
        return text.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields], "_file", "_at", "_row")
    kinds = _kinds(text, columns)
    return text.select(*[F.col(c).try_cast(kinds[c]).alias(c) for c in columns], "_file", "_at", "_row")


def _kinds(text: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """The first of bigint, double, timestamp that all values of a column are; string otherwise and for a column of nulls.

    A few rows refute most kinds. What they leave is tested on all values, for each column the first kind left, and again only where that fails.
    """
    def refuted(rows: DataFrame, tried: dict[str, Sequence[str]]) -> tuple[set[tuple[str, str]], dict[str, int]]:
        pairs = [(c, k) for c, kinds in tried.items() for k in kinds]
        failed = [F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(k).isNull()) for c, k in pairs]
        got = rows.agg(*[x.alias(f"k{i}") for i, x in enumerate(failed)], *[F.count(F.col(c)).alias(f"n{i}") for i, c in enumerate(tried)]).first()
        return {p for i, p in enumerate(pairs) if got[f"k{i}"]}, {c: got[f"n{i}"] for i, c in enumerate(tried)}

    left = {c: ["bigint", "double", "timestamp"] for c in columns}
    wrong, _ = refuted(text.limit(KIND_ROWS), left) if columns else (set(), {})
    left = {c: [k for k in kinds if (c, k) not in wrong] for c, kinds in left.items()}
    found = {c: "string" for c, kinds in left.items() if not kinds}
    while open_ := {c: kinds[:1] for c, kinds in left.items() if c not in found}:
        wrong, values = refuted(text, open_)
        for c, [k] in open_.items():
            if not values[c]:
                found[c] = "string"
            elif (c, k) not in wrong:
                found[c] = k
            else:
                left[c] = left[c][1:]
                if not left[c]:
                    found[c] = "string"
    return found


def load_disk_health(spark, path, pattern=None, schema=None, limit=None, model_prefix: str = "ST") -> DataFrame:
    """Daily disk reports: one vendor's models, without normalised and empty columns, typed."""
    df = read_csv(spark, path, pattern, schema).filter(F.col("model").startswith(model_prefix))
    df = clean.drop_columns_like(df.drop("_file", "_at", "_row"), "normalized")
    df = clean.drop_empty_columns(df)
    df = df.withColumns({"date": F.to_timestamp(F.col("date").cast("string")), "failure": F.col("failure").cast("int").cast("boolean")})
    return df if limit is None else limit_ids(df, "serial_number", limit)


def healthy_disks(df: DataFrame) -> DataFrame:
    """Rows of disks that never failed."""
    return df.join(df.filter("failure").select("serial_number"), "serial_number", "left_anti")


def load_welds(spark, path, pattern=None, schema=None, limit=None) -> DataFrame:
    """Weld records: power repaired per file, nulls to 0, poisoned record out, explicit step ``t``."""
    df = read_csv(spark, path, pattern, schema)
    df = clean.repair_power(df.withColumnRenamed("per_energy", "power"), "_file", "power", "true_energy", "diff_time")
    df = clean.fill_zero(df, WELD_FEATURES).filter(F.col("weld_record_index") != WELD_BAD_ID)
    df = dense_index(df, ["_file", "_at", "_row"], ["weld_record_index"], "t")
    out = df.select(F.col("weld_record_index").alias("sample_id"), "t", *WELD_FEATURES)
    return out if limit is None else limit_ids(out, "sample_id", limit)


def load_grid_measurements(spark, path, pattern=None, schema=None, limit=None, window: int | None = None) -> DataFrame:
    """Grid measurements: nulls to 0; samples by ``ExID``, or by tumbling windows of ``window`` rows."""
    df = read_csv(spark, path, pattern, schema)
    plain = [c for c in df.columns if c not in ("_file", "_at", "_row", "ExID")]
    df = clean.fill_zero(df, plain)
    order = ["_file", "_at", "_row"]
    if window:
        df = count_windows(df, order, window)
    else:
        df = dense_index(df.withColumnRenamed("ExID", "sample_id"), order, ["sample_id"], "t")
    out = clean.rename_by_position(df.select("sample_id", "t", *plain), skip=("sample_id", "t"))
    return out if limit is None else limit_ids(out, "sample_id", limit)


def wafer_catalog(catalog: DataFrame) -> DataFrame:
    """Catalog rows of the chamber and recipes used, with the joined-up job key and the trace's csv name."""
    kept = catalog.filter((F.col("ChamberID") == WAFER_CHAMBER) & F.col("ChamberRecipeID").isin(*WAFER_RECIPES))
    return kept.withColumns({"pjid": pass_key(F.col("ToolID"), F.col("PJID").cast("string")), "trace_csv": flat_csv_name(F.col("TraceDataFile"))})


def wafer_metadata(catalog: DataFrame, measurements: DataFrame) -> DataFrame:
    """Left merge of catalog and measurements on job key and wafer; null keys match null keys."""
    m = measurements.withColumnsRenamed({"Proc_cj_id": "__job", "Wafer_id": "__wafer"})
    on = F.col("pjid").eqNullSafe(F.col("__job")) & F.col("WaferID").eqNullSafe(F.col("__wafer"))
    return wafer_catalog(catalog).join(m, on, "left").drop("__job", "__wafer")


def wafer_measurements(thick_1, thick_2, rough_1, rough_2) -> DataFrame:
    """Thickness and roughness, each merged over its two file kinds, then joined."""
    thickness = clean.merge_measurements(
        thick_1.withColumnRenamed("Mea_value", "mean_thickness"), thick_2.withColumnRenamed("Wafer_mean", "mean_thickness"), "mean_thickness")
    roughness = clean.merge_measurements(
        rough_1.withColumnRenamed("Std_dep_thk", "std_thickness"), rough_2.withColumnRenamed("Wafer_std", "std_thickness"), "std_thickness")
    return clean.join_measurements(thickness.drop("_merge", "Control_job_id"), roughness.drop("_merge", "Control_job_id"))


def load_wafers(spark, path, pattern=None, limit=None, features: Sequence[str] = (), label: str = "mean_thickness",
                measurements: str = "measurements", catalog: str = "catalog", traces: str = "tracedata",
                trace_schema=None, catalog_schema=None) -> tuple[DataFrame, DataFrame]:
    """(trace steps, labels). Gaps within a pass are interpolated from its own steps, what is left without a value becomes 0.

    The metadata are worked out once and written. They name the trace files. Up to ``WANTED_FILES`` names go to the scan, so that no other file is opened; a semi-join on
    the file name holds for any number. With ``trace_schema`` all traces have one layout and are not looked at beforehand.
    """
    def kind(p: str) -> DataFrame:
        return read_csv_mixed(spark, f"{path}/{measurements}", p)

    measured = wafer_measurements(
        kind("Rate_time_series.*_Average_"), kind("/mCTF.*_Average_"), kind("Rate_time_series.*_StdDev_"), kind("/mCTF.*_StdDev_"))
    meta = wafer_metadata(read_csv(spark, f"{path}/{catalog}", schema=catalog_schema), measured)
    meta = materialize(meta.select("WaferPassID", "ChamberRecipeID", "trace_csv", label), "metadata")  # read three times below
    wanted = materialize(meta.filter(F.col("ChamberRecipeID") == WAFER_TRACE_RECIPE).select("trace_csv").distinct(), "wanted")
    listed = [r[0] for r in wanted.limit(WANTED_FILES + 1).collect() if r[0] is not None]
    names = listed if len(listed) <= WANTED_FILES else None
    steps = read_csv_mixed(spark, f"{path}/{traces}", pattern, names) if trace_schema is None else read_csv(
        spark, f"{path}/{traces}", pattern, trace_schema, names)
    steps = steps.withColumn("trace_csv", F.element_at(F.split("_file", "/"), -1)).join(wanted, "trace_csv", "left_semi")
    steps, labels = clean.drop_unlabelled(steps, meta.select("WaferPassID", label), "WaferPassID", label)
    features = list(features) or [c for c in steps.columns if c not in ("WaferPassID", "TimeStamp", "trace_csv", "_file", "_at", "_row")]
    steps = steps.select("WaferPassID", "TimeStamp", "_row", *features)  # file names are long
    steps = dense_index(steps, [F.to_timestamp(F.col("TimeStamp").cast("string")), F.col("_row")], ["WaferPassID"], "t", unique=True)
    steps = steps.select(F.col("WaferPassID").alias("sample_id"), "t", *[F.col(c).cast("double").alias(c) for c in features])
    steps = clean.fill_zero(interpolate(steps, ["sample_id"], "t", features), features)
    labels = labels.select(F.col("WaferPassID").alias("sample_id"), F.col(label).cast("float").alias("target"))
    return (steps, labels) if limit is None else (limit_ids(steps, "sample_id", limit), labels)


def load_continuous(spark, path, pattern=None, format: str = "parquet", schema=None) -> DataFrame:
    """Continuous labelled frame from parquet, ORC, JSON or CSV files."""
    reader = spark.read.format(format).option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    elif format == "csv":
        reader = reader.option("inferSchema", True)
    return select_files(reader.load(path), pattern)


def load_archive(spark, path, pattern=None, task: str = "classification", extension: str = ".ts", limit: float | None = None, thin: int | None = None,
                 longest: int = 256) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(samples, lengths, classes) of archive files, ready to fit.

    Cases are read, and where a sample's dimensions differ in length, those beyond ``longest`` steps are thinned to every second; ``thin`` keeps every
    so-manieth step of all. Missing steps are interpolated within each series, and ``code`` numbers the sorted labels (``target`` for the task
    'regression', neither for others). ``limit``: a number or share of the samples, in order of their ids. ``sample_id`` counts the cases in order of file
    and line. ``lengths``: see ``length_stats``; its largest value is the length that models take.
    """
    target = {"classification": "class", "regression": "double"}.get(task, "class")
    cases = read_ts(spark, path, pattern, target=target, extension=extension)
    cases = dense_index(cases, ["file", "case_no"], out="sample_id", unique=True)
    if limit is not None:
        cases = limit_ids(cases, "sample_id", limit)
    cases = samples.repair_lengths(cases, "dims", longest)
    if thin:
        cases = cases.withColumn("dims", F.transform("dims", lambda s: arrays.decimate(s, thin, 0)))
    each = cases.select("sample_id", F.posexplode("dims").alias("d", "s")).withColumn("s", arrays.interpolate(F.col("s")))
    filled = each.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "s"))), lambda x: x["s"]).alias("dims"))
    rest = [c for c in cases.columns if c not in ("dims", "times")]
    cases = materialize(cases.select(*rest).join(filled, "sample_id"), "archive")
    classes = None
    if task == "classification":
        cases, classes = clean.encode_classes(cases, "label")
    lengths = length_stats(cases, "sample_id", [F.get("dims", F.lit(0))])
    return cases, lengths, classes


def resolve_length(parameter: int | None, name: str | None, observed: int) -> int:
    """The length that models take: what the user says, else the data set's own constant, else the longest sample."""
    return parameter or DATASET_LENGTHS.get(name or "", None) or observed


def continuous_samples(df: DataFrame, cols: Columns, freq_ms: int, max_gap_s: float, stamps: Sequence[int], label_stamps: Sequence[int] = (0,), jump: int = 1,
                       padding: str = "extrapolate", start: int = 0, max_per_class: int | None = None, **grid) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(samples, classes, audit) of a continuous labelled frame, ready to fit.

    Groups are put on a regular grid with gap-limited filling, cut into windows with the most frequent label, thinned to ``max_per_class`` at an even
    stride along (group, centre), and numbered by sorted label in ``code``. ``grid``: further arguments of ``regularize``.
    """
    regular, audit = regularize(df, cols, freq_ms, max_gap_s, **grid)
    found = sample_windows(regular, cols.group, cols.features, cols.label, stamps, label_stamps, jump, padding, start)
    if max_per_class is not None:
        found = cap_per_class(materialize(found, "windows"), "label", [cols.group, "center"], max_per_class)
    coded, classes = clean.encode_classes(found, "label")
    return coded, classes, audit


def load_continuous_samples(spark, path, cols: Columns, pattern=None, format: str = "parquet", schema=None, **params) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``continuous_samples`` of files."""
    return continuous_samples(load_continuous(spark, path, pattern, format, schema), cols, **params)


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], overwrite: bool = False) -> DataFrame:
    """The parsed table at ``path``; built and written first if missing or to be replaced."""
    if not overwrite:
        try:
            return spark.read.parquet(path)
        except Exception as e:  # only "not there yet" leads to a build
            if "PATH_NOT_FOUND" not in str(e):
                raise
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


DATASET_LENGTHS = {"weld": WELD_LENGTH, "wafer": WAFER_LENGTH}

DATASETS: dict[str, Callable] = {
    "disk_health": load_disk_health,
    "weld": load_welds,
    "grid": load_grid_measurements,
    "wafer": load_wafers,
    "continuous": load_continuous,
    "continuous_samples": load_continuous_samples,
    "archive": load_archive,
    "ts": read_ts,
    "arff": read_arff,
    "tsv": read_tsv,
}


def load_dataset(spark: SparkSession, name: str, path, **params):
    if name not in DATASETS:
        raise ValueError(f"unknown data set {name!r}; known: {sorted(DATASETS)}")
    return DATASETS[name](spark, path, **params)
