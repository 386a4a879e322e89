"""Archive text formats: `.ts` (plain, timestamped, regression), ARFF and TSV, as jobs over lines of many files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.session import materialize
from tidemill.sources.lines import empty_files, read_lines

# fixed values: the header tags of a .ts file; @data opens the data part
TS_TAGS = ("@problemname", "@timestamps", "@univariate", "@classlabel", "@data")
TS_BOOLEAN_TAGS = ("@timestamps", "@univariate", "@classlabel", "@targetlabel")


def number(text: Column) -> Column:
    """Text to double; '?', NaN and anything unreadable give null."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value), value)


def _clean(lines: DataFrame) -> DataFrame:
    return lines.withColumn("value", F.lower(F.trim("value"))).filter("value <> ''")


OUTSIDE_BRACKETS = r":(?![^(]*\))"


def ts_facts(lines: DataFrame) -> DataFrame:
    """Per file: flags, class list, where the data begin, and the shape of the first case. One pass, one row per file."""
    rows = _clean(lines)
    word = F.split("value", r"\s+")
    tag = F.col("value").startswith("@")

    def flag(name: str) -> Column:
        return F.coalesce(F.max(F.when(word[0] == name, F.get(word, F.lit(1)) == "true")), F.lit(False))

    def present(name: str) -> Column:
        return F.max(F.when(word[0] == name, 1).otherwise(0)) == 1

    def first_case(value: Column) -> Column:
        return F.min_by(value, F.when(~tag, F.col("line_no")))

    timed = F.col("timestamps")
    labelled = (F.col("class_label") | F.col("target_label")).cast("int")
    facts = rows.groupBy("file").agg(
        flag("@timestamps").alias("timestamps"), flag("@univariate").alias("univariate"),
        flag("@classlabel").alias("class_label"), flag("@targetlabel").alias("target_label"),
        F.max(F.when(word[0] == "@classlabel", F.slice(word, 3, F.size(word)))).alias("classes"),
        F.min(F.when(word[0] == "@data", F.col("line_no"))).alias("data_line"),
        F.min("line_no").alias("first_line"),
        F.count_if(tag).alias("tags"), F.count_if(~tag).alias("cases"),
        first_case(F.size(F.split("value", ":"))).alias("__plain"),
        first_case(F.size(F.split("value", OUTSIDE_BRACKETS))).alias("__timed"),
        *[present(t).alias(f"has_{t[1:]}") for t in (*TS_TAGS, "@targetlabel")],
    )
    complete = F.col("has_problemname") & F.col("has_timestamps") & F.col("has_univariate") & F.col("has_data") & (
        F.col("has_classlabel") | F.col("has_targetlabel"))
    rule = F.when(F.col("tags") == 0, "no_metadata").when(~complete, "metadata_incomplete").when(F.col("cases") == 0, "no_data")
    return facts.select(
        "file", "timestamps", "univariate", "class_label", "target_label", "classes", "data_line", "first_line",
        (F.when(timed, F.col("__timed")).otherwise(F.col("__plain")) - labelled).alias("n_dims"), rule.alias("file_rule"),
    )


def _cut(lines: DataFrame, facts: DataFrame) -> DataFrame:
    """Lines with their file's facts, cut into dimensions and label."""
    rows = _clean(lines).join(facts, "file")
    parts = F.when(F.col("timestamps"), F.split("value", OUTSIDE_BRACKETS)).otherwise(F.split("value", ":"))
    labelled = F.col("class_label") | F.col("target_label")
    return rows.withColumn("__parts", parts).withColumns({
        "__dims": F.when(labelled, F.slice("__parts", 1, F.size("__parts") - 1)).otherwise(F.col("__parts")),
        "__label": F.when(labelled, F.trim(F.element_at("__parts", -1))),
        "__tag": F.col("value").startswith("@"),
    })


def _line_rules() -> Column:
    """Names of the rules a line breaks."""
    word = F.split("value", r"\s+")
    given = F.get(word, F.lit(1))
    booleans = word[0].isin(*TS_BOOLEAN_TAGS)
    tokens = F.flatten(F.transform("__dims", lambda d: F.split(d, ",")))
    unreadable = F.exists(tokens, lambda x: (F.trim(x) != "?") & (F.trim(x) != "") & F.trim(x).try_cast("double").isNull())
    bad_tuple = F.exists("__dims", lambda d: (F.trim(d) != "") & ~F.trim(d).rlike(r"^\(.*\)$"))
    tag_rules = F.array(
        F.when((word[0].isin(*TS_TAGS, "@targetlabel")) & (F.col("line_no") > F.col("data_line")), "metadata_after_data"),
        F.when(((word[0] == "@problemname") | booleans) & given.isNull(), "tag_without_value"),
        F.when(booleans & given.isNotNull() & ~given.isin("true", "false"), "bad_boolean"),
        F.when((word[0] == "@classlabel") & (given == "true") & (F.size(word) < 3), "classes_missing"),
        F.when((word[0] == "@classlabel") & (given == "false") & (F.size(word) > 2), "classes_unexpected"),
    )
    case_rules = F.array(
        F.when(F.size("__dims") != F.col("n_dims"), "inconsistent_dimensions"),
        F.when(F.col("class_label") & ~F.array_contains("classes", F.col("__label")), "unknown_class"),
        F.when(~F.col("timestamps") & unreadable, "bad_value"),
        F.when(F.col("timestamps") & bad_tuple, "bad_tuple"),
    )
    is_case = ~F.col("__tag") & (F.col("line_no") > F.col("data_line"))
    chosen = F.when(F.col("__tag"), tag_rules).when(is_case, case_rules).otherwise(F.array().cast("array<string>"))
    return F.filter(chosen, lambda r: r.isNotNull())


def ts_violations(lines: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(file, line_no, rule) for everything a strict reader refuses."""
    facts = ts_facts(lines) if facts is None else facts
    per_line = _cut(lines, facts).select("file", "line_no", F.explode(_line_rules()).alias("rule"))
    per_file = facts.filter("file_rule IS NOT NULL").select("file", F.col("first_line").alias("line_no"), F.col("file_rule").alias("rule"))
    return per_line.unionByName(per_file)


def validate_ts(spark: SparkSession, path: str, pattern: str | None = None, extension: str = ".ts") -> DataFrame:
    lines = read_lines(spark, path, pattern, extension)
    facts = materialize(ts_facts(lines), "facts")
    found = ts_violations(lines, facts)
    empty = empty_files(spark, path, facts, extension, pattern).select(
        "file", F.lit(None).cast("bigint").alias("line_no"), F.lit("empty_file").alias("rule"))
    return found.unionByName(empty)


def parse_ts(lines: DataFrame, target: str = "class", facts: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Lines of `.ts` files to (file, case_no, dims, times, label | target).

    ``case_no`` counts lines from the start of the file's data. ``times`` holds the integer stamps, or
    microseconds for dates, of timestamped files and is null otherwise. Labels are lower-cased. With
    ``strict`` a line that breaks a rule fails the job that reads it.
    """
    rows = _cut(lines, ts_facts(lines) if facts is None else facts)
    if strict:
        rules = _line_rules()
        message = F.concat(F.lit("invalid .ts input: "), F.col("file"), F.lit(":"), F.col("line_no").cast("string"), F.lit(" "), F.array_join(rules, ","))
        rows = rows.filter(F.when(F.size(rules) > 0, F.raise_error(message).cast("boolean")).otherwise(True))
    cases = rows.filter((F.col("line_no") > F.col("data_line")) & ~F.col("__tag"))

    def plain(d: Column) -> Column:
        return F.when(F.trim(d) == "", F.array().cast("array<double>")).otherwise(
            F.transform(F.split(d, ","), lambda x: number(F.trim(x)))
        )

    def tuples(d: Column) -> Column:
        return F.regexp_extract_all(d, F.lit(r"\(([^)]*)\)"), F.lit(1))

    def stamp(x: Column) -> Column:
        text = F.trim(F.regexp_extract(x, r"^(.*),[^,]*$", 1))
        return F.coalesce(text.try_cast("bigint"), F.unix_micros(F.try_to_timestamp(text)))

    def value(x: Column) -> Column:
        return number(F.trim(F.regexp_extract(x, r",([^,]*)$", 1)))

    timed = F.col("timestamps")
    dims = F.when(timed, F.transform("__dims", lambda d: F.transform(tuples(d), value))).otherwise(F.transform("__dims", plain))
    times = F.when(timed, F.transform("__dims", lambda d: F.transform(tuples(d), stamp)))
    last = number(F.col("__label")).alias("target") if target == "double" else F.col("__label").alias("label")
    return cases.select("file", (F.col("line_no") - F.col("data_line") - 1).alias("case_no"), dims.alias("dims"), times.alias("times"), last)


def read_ts(spark: SparkSession, path: str, pattern: str | None = None, target: str = "class", strict: bool = True,
            extension: str = ".ts") -> DataFrame:
    """Read `.ts` files. ``strict`` refuses files with broken headers at once and broken lines when they are read.

    The text is scanned three times in all: split counts, file facts, cases.
    """
    lines = read_lines(spark, path, pattern, extension)
    facts = materialize(ts_facts(lines), "facts")
    if strict:
        first = facts.filter("file_rule IS NOT NULL").limit(5).collect()
        if first:
            raise ValueError("invalid .ts input: " + "; ".join(f"{r.file} {r.file_rule}" for r in first))
    return parse_ts(lines, target, facts, strict)


def parse_arff(lines: DataFrame, has_label: bool = True) -> DataFrame:
    r"""ARFF lines to (file, case_no, dims, label). A relational attribute makes the file multivariate:
    its dimensions are separated by a literal \n inside one quoted field."""
    low = F.lower("value")
    facts = lines.filter(low.contains("@data") | low.contains("@attribute")).groupBy("file").agg(
        F.coalesce(F.max(low.contains("@attribute") & low.contains("relational")), F.lit(False)).alias("multi"),
        F.min(F.when(low.contains("@data"), F.col("line_no"))).alias("data_line"),
    )
    cases = lines.filter(F.trim("value") != "").join(facts, "file").filter("line_no > data_line")
    value = F.trim("value")
    comma = F.length(value) - F.length(F.substring_index(value, ",", -1)) - 1
    last_comma = F.substring(value, F.lit(1), comma)
    quoted = F.split(value, "',")
    body = F.when(F.col("multi"), quoted[0] if has_label else value).otherwise(last_comma if has_label else value)
    body = F.replace(body, F.lit("'"), F.lit(""))
    label = F.when(F.col("multi"), F.trim(F.get(quoted, F.lit(1)))).otherwise(F.trim(F.substring_index(value, ",", -1)))
    dims = F.when(F.col("multi"), F.split(body, r"\\n")).otherwise(F.array(body))
    parsed = F.transform(dims, lambda d: F.transform(F.split(d, ","), lambda x: number(F.trim(x))))
    return cases.select(
        "file", (F.col("line_no") - F.col("data_line") - 1).alias("case_no"), parsed.alias("dims"),
        (label if has_label else F.lit(None).cast("string")).alias("label"),
    )


def read_arff(spark: SparkSession, path: str, pattern: str | None = None, has_label: bool = True) -> DataFrame:
    return parse_arff(read_lines(spark, path, pattern, ".arff"), has_label)


def parse_tsv(lines: DataFrame) -> DataFrame:
    """Label, then one series, separated by tabs."""
    fields = F.split("value", "\t")
    series = F.transform(F.slice(fields, 2, F.size(fields)), lambda x: number(F.trim(x)))
    return lines.filter(F.trim("value") != "").select(
        "file", F.col("line_no").alias("case_no"), F.array(series).alias("dims"), F.trim(fields[0]).alias("label")
    )


def read_tsv(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    return parse_tsv(read_lines(spark, path, pattern, ".tsv"))
