"""Split tables (fold, sample, split): membership decided by hashes of ids, never by lists on the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.hashing import hash32
from tidemill.functions.scalars import floor_div
from tidemill.operators.ordered import dense_index
from tidemill.schema import require
from tidemill.session import materialize

KINDS = ("random", "stratified", "group_stratified", "group", "by_group_list", "train_on_all")


def check_parameters(
    kind: str, val_ratio: float = 0, test_ratio: float = 0, test_groups=None, val_groups=None,
    test_pattern: str | None = None, val_pattern: str | None = None,
) -> None:
    """Conflicting split requests fail before any plan is built."""
    if kind not in KINDS:
        raise ValueError(f"unknown split kind {kind!r}")
    if not (0 <= val_ratio < 1 and 0 <= test_ratio < 1):
        raise ValueError("ratios lie in [0, 1)")
    if test_pattern and test_ratio:
        raise ValueError("give either a test pattern or a test ratio")
    if val_pattern and val_ratio:
        raise ValueError("give either a validation pattern or a validation ratio")
    if test_groups and test_ratio:
        raise ValueError("give either test groups or a test ratio")
    if val_groups and val_ratio:
        raise ValueError("give either validation groups or a validation ratio")
    if test_groups and val_groups and set(test_groups) & set(val_groups):
        raise ValueError("a group cannot be in both test and validation")


def _order(hashed: Column, sample: str) -> Column:
    return F.struct(hashed.alias("h"), F.col(sample).alias("t"))


def _cuts(ids: DataFrame, sample: str, val_ratio: float, test_ratio: float, numbers: Sequence[int], seed: int, buckets: int) -> DataFrame:
    """(__key, __test, __val): per stratum the last (hash, id) that is a test row, and by fold the last that is a validation row.

    One histogram of test hashes finds the bucket that holds the test cut. The next one, of all folds together, counts by bucket of
    the validation hash the rows beyond that bucket and, apart from them, those inside it: whichever of these are test rows, the fold's
    cut lies in a short range of buckets. Only the rows of these buckets, a few of each ``buckets``, are written and ordered.
    """
    width = 4294967296 // buckets
    each = F.explode(F.array(*[F.lit(n) for n in numbers])).alias("fold")
    val_hash = hash32(f"{seed}-val", F.col("fold"), F.col(sample))
    rows = ids.withColumn("__ht", hash32(f"{seed}-test", F.col(sample)))
    bucket = floor_div(F.col("__ht"), width)
    per_key = Window.partitionBy("__key")
    if test_ratio:
        seen = rows.groupBy(F.col("__stratum").alias("__key"), bucket.alias("__b")).agg(F.count("*").alias("__c"))
        upto = F.sum("__c").over(per_key.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0))
        wanted = F.ceil(F.sum("__c").over(per_key) * F.lit(test_ratio)).cast("bigint")
        first = seen.withColumns({"__upto": upto, "__n": wanted}).filter("__upto >= __n AND __upto - __c < __n").select(
            "__key", F.col("__b").alias("__at"), (F.col("__n") - F.col("__upto") + F.col("__c")).alias("__need"))
        first = materialize(first, "test-cuts")
        rows = rows.join(first, F.col("__stratum").eqNullSafe(F.col("__key"))).drop("__key")
    else:
        rows = rows.withColumns({"__at": F.lit(-1).cast("bigint"), "__need": F.lit(0).cast("bigint")})
    # rows before the cut's bucket are test rows; the open ones are in it
    rows = rows.filter(bucket >= F.col("__at")).select("*", (bucket == F.col("__at")).alias("__open"), each)
    rows = rows.withColumn("__hv", val_hash).withColumn("__bv", floor_div(F.col("__hv"), width))

    seen = rows.groupBy(F.col("__stratum").alias("__key"), "fold", "__bv").agg(
        F.count_if(~F.col("__open")).alias("__sure"), F.count("*").alias("__all"), F.max("__need").alias("__need"))
    per_fold = Window.partitionBy("__key", "fold")
    upto = per_fold.orderBy("__bv").rowsBetween(Window.unboundedPreceding, 0)
    seen = seen.withColumns({
        "__n": F.ceil((F.sum("__all").over(per_fold) - F.col("__need")) * F.lit(val_ratio)).cast("bigint"),
        "__upto_sure": F.sum("__sure").over(upto), "__upto_all": F.sum("__all").over(upto)}).filter("__n > 0")
    maybe = F.when(F.col("__upto_all") >= F.col("__n"), F.col("__bv"))
    ranges = seen.groupBy("__key", "fold").agg(
        F.min(maybe).alias("__lo"),
        F.coalesce(F.min(F.when(F.col("__upto_sure") >= F.col("__n"), F.col("__bv"))), F.lit(buckets)).alias("__hi"),
        (F.first("__n") - F.min_by(F.col("__upto_sure") - F.col("__sure"), maybe)).alias("__nth"))
    ranges = materialize(ranges.withColumnRenamed("fold", "__fold"), "val-ranges")

    near = rows.join(ranges, F.col("__stratum").eqNullSafe(F.col("__key")) & (F.col("fold") == F.col("__fold")), "left").filter(
        F.col("__open") | F.col("__bv").between(F.col("__lo"), F.col("__hi")))
    near = materialize(near.select(
        F.col("__stratum").alias("__key"), "fold", "__open", "__need", "__nth", _order(F.col("__ht"), sample).alias("__t"),
        _order(F.col("__hv"), sample).alias("__v")), "near-cuts")
    last = near.filter(F.col("__open") & (F.col("fold") == numbers[0])).withColumn(
        "__r", F.row_number().over(per_key.orderBy("__t"))).filter("__r = __need")
    last = materialize(last.select("__key", F.col("__t").alias("__test")), "test-last")
    told = last.withColumnRenamed("__key", "__k")
    rest = near.join(told, F.col("__key").eqNullSafe(F.col("__k")), "left").filter(~F.col("__open") | (F.col("__t") > F.col("__test")))
    final = rest.withColumn("__r", F.row_number().over(per_fold.orderBy("__v"))).filter("__r = __nth")
    by_fold = final.groupBy("__key").agg(F.map_from_entries(F.collect_list(F.struct("fold", "__v"))).alias("__val"))
    by_fold = by_fold.withColumnRenamed("__key", "__k")
    both = last.join(by_fold, F.col("__key").eqNullSafe(F.col("__k")), "full")
    return both.select(F.when(F.col("__test").isNotNull(), F.col("__key")).otherwise(F.col("__k")).alias("__key"), "__test", "__val")


def ratio_split(
    df: DataFrame, sample: str, val_ratio: float, test_ratio: float = 0.0, folds: int = 1, seed: int = 1337,
    strata: str | None = None, first_fold: int = 0, buckets: int = 4096,
) -> DataFrame:
    """Random split, per stratum if given: test is shared by all folds, validation is redrawn per fold.

    Exactly ceil(ratio * n) rows of each stratum are taken, in order of a hash of the id. The validation ratio applies to what is
    left after the test rows are taken out. The cuts are one table for all strata, folds and roles (see ``_cuts``: two counting passes
    and one that picks the rows next to the cuts); all rows are then marked in one scan, and only there written out once for each fold.
    """
    ids = df.select(sample, (F.col(strata) if strata else F.lit(0)).alias("__stratum"))
    numbers = list(range(first_fold, folds))
    cuts = materialize(_cuts(ids, sample, val_ratio, test_ratio, numbers, seed, buckets), "cuts")
    marked = ids.join(cuts, F.col("__stratum").eqNullSafe(F.col("__key")), "left").withColumn(
        "__is_test", _order(hash32(f"{seed}-test", F.col(sample)), sample) <= F.col("__test"))
    per_fold = marked.select("*", F.explode(F.array(*[F.lit(n) for n in numbers])).alias("fold"))
    is_val = _order(hash32(f"{seed}-val", F.col("fold"), F.col(sample)), sample) <= F.try_element_at("__val", F.col("fold"))
    role = F.when(F.col("__is_test"), "test").when(is_val, "val").otherwise("train")
    return per_fold.select("fold", sample, role.alias("split"))


def group_folds(df: DataFrame, group: str, label: str, k: int, seed: int = 1337, salt: str = "fold") -> DataFrame:
    """(group, fold of k): whole groups dealt out in snake order over (dominant label, size, hash).

    Only the group x label histogram is ever ordered; its global order is built in ranges.
    """
    histogram = df.groupBy(group, label).agg(F.count("*").alias("c"))
    table = histogram.groupBy(group).agg(
        F.max(F.struct(F.col("c"), F.col(label))).getField(label).alias("dominant"), F.sum("c").alias("size")
    )
    ranked = dense_index(
        table, [F.col("dominant"), F.col("size").desc(), hash32(f"{seed}-{salt}", F.col(group)), F.col(group)], out="__r", unique=True
    )
    lap, place = F.floor(F.col("__r") / k), F.col("__r") % k
    return ranked.select(group, F.when(lap % 2 == 0, place).otherwise(k - 1 - place).cast("int").alias("part"))


def group_stratified_split(
    df: DataFrame, sample: str, group: str, label: str, val_ratio: float, test_ratio: float = 0.0,
    folds: int = 1, seed: int = 1337,
) -> DataFrame:
    """Groups never cross splits; label shares are kept as well as whole groups allow."""
    k = int(1 / val_ratio)
    if folds > k:
        raise ValueError(f"a validation ratio of {val_ratio} gives only {k} folds")
    ids = df.select(sample, group, label)
    numbers = F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))
    parts = []
    rest = ids
    if test_ratio:
        dealt = group_folds(ids, group, label, int(1 / test_ratio), seed, "test")
        held = dealt.filter("part = 0").select(F.col(group).alias("__group"))
        same = F.col(group).eqNullSafe(F.col("__group"))  # no group is a group, too
        test = ids.join(held, same, "left_semi")
        rest = ids.join(held, same, "left_anti")
        parts.append(test.withColumn("fold", numbers).select("fold", sample, F.lit("test").alias("split")))
    dealt = group_folds(rest, group, label, k, seed, "val")
    dealt = dealt.withColumnRenamed(group, "__group")
    others = rest.join(dealt, F.col(group).eqNullSafe(F.col("__group"))).withColumn("fold", numbers)
    role = F.when(F.col("part") == F.col("fold"), F.lit("val")).otherwise(F.lit("train"))
    out = others.select("fold", sample, role.alias("split"))
    for p in parts:
        out = out.unionByName(p)
    return out


def group_split(df: DataFrame, sample: str, group: str, val_ratio: float, test_ratio: float = 0.0,
                folds: int = 1, seed: int = 1337) -> DataFrame:
    """Whole groups drawn at random, without regard to labels: exactly ceil(ratio * groups) of them."""
    groups = df.select(group).distinct()
    roles = ratio_split(groups, group, val_ratio, test_ratio, folds, seed)
    roles = roles.withColumnRenamed(group, "__group")
    return df.select(sample, group).join(roles, F.col(group).eqNullSafe(F.col("__group"))).select("fold", sample, "split")


def group_list_split(df: DataFrame, sample: str, group: str, test_groups: Sequence = (), val_groups: Sequence = (),
                     fold: int = 0) -> DataFrame:
    """Test and validation groups are named; train is the rest. Unknown group names fail."""
    if set(test_groups) & set(val_groups):
        raise ValueError("a group cannot be in both test and validation")
    named = [*test_groups, *val_groups]
    found = df.filter(F.col(group).isin(named)).select(group).distinct()  # at most len(named) rows
    missing = set(named) - {r[0] for r in found.collect()}
    if missing:
        raise ValueError(f"groups not in the data: {sorted(missing, key=str)}")
    role = (
        F.when(F.col(group).isin(list(test_groups)), F.lit("test"))
        .when(F.col(group).isin(list(val_groups)), F.lit("val"))
        .otherwise(F.lit("train"))
    )
    return df.select(F.lit(fold).alias("fold"), sample, role.alias("split"))


def pattern_split(df: DataFrame, sample: str, file: str, test_pattern: str | None = None,
                  val_pattern: str | None = None) -> DataFrame:
    """Split by unanchored patterns on the file a sample came from."""
    role = F.lit("train")
    if val_pattern:
        role = F.when(F.col(file).rlike(val_pattern), F.lit("val")).otherwise(role)
    if test_pattern:
        role = F.when(F.col(file).rlike(test_pattern), F.lit("test")).otherwise(role)
    return df.select(F.lit(0).alias("fold"), sample, role.alias("split"))


def id_file_split(df: DataFrame, sample: str, path: str, split: str = "test") -> DataFrame:
    """Ids listed one per line in a text file get ``split``, all others train."""
    kind = df.schema[sample].dataType
    text = df.sparkSession.read.text(path).select(F.trim("value").alias("v")).filter("v <> ''")
    listed = text.select(F.col("v").cast(kind).alias(sample)).distinct().withColumn("__hit", F.lit(True))
    joined = df.select(sample).join(listed, sample, "left")
    return joined.select(
        F.lit(0).alias("fold"), sample, F.when(F.col("__hit"), F.lit(split)).otherwise(F.lit("train")).alias("split")
    )


def train_on_all(df: DataFrame, sample: str, folds: int = 1) -> DataFrame:
    numbers = F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))
    return df.select(numbers.alias("fold"), sample, F.lit("train").alias("split"))


def split(
    df: DataFrame, kind: str, sample: str, val_ratio: float = 0.2, test_ratio: float = 0.0, folds: int = 1,
    seed: int = 1337, label: str | None = None, group: str | None = None, test_groups: Sequence = (),
    val_groups: Sequence = (),
) -> DataFrame:
    """Split by kind; see the functions above."""
    if kind == "by_group_list":
        return group_list_split(df, sample, group, test_groups, val_groups)
    check_parameters(kind, val_ratio, test_ratio, test_groups, val_groups)
    if kind == "random":
        return ratio_split(df, sample, val_ratio, test_ratio, folds, seed)
    if kind == "stratified":
        require(df, label or "")
        return ratio_split(df, sample, val_ratio, test_ratio, folds, seed, strata=label)
    if kind == "group_stratified":
        return group_stratified_split(df, sample, group, label, val_ratio, test_ratio, folds, seed)
    if kind == "group":
        return group_split(df, sample, group, val_ratio, test_ratio, folds, seed)
    return train_on_all(df, sample, folds)


def choose_kind(task: str, label: str | None, group: str | None) -> str:
    """Split kind that suits a task: classification keeps label shares, groups stay together."""
    if task == "classification" and label:
        return "group_stratified" if group else "stratified"
    return "group" if group else "random"


def overlaps(splits: DataFrame, sample: str) -> DataFrame:
    """Samples that are in more than one split of a fold; empty when the table is sound."""
    return splits.groupBy("fold", sample).agg(F.countDistinct("split").alias("n")).filter("n > 1")


def split_counts(splits: DataFrame, df: DataFrame, sample: str, group: str, label: str) -> DataFrame:
    """Counts per (fold, split, group) and (fold, split, label) in one pass: ``kind`` says which."""
    joined = splits.join(df.select(sample, group, label), sample)
    counted = joined.groupingSets(
        [["fold", "split", group], ["fold", "split", label]], "fold", "split", group, label
    ).agg(F.count("*").alias("n"), F.grouping(group).alias("__g"))
    return counted.select(
        "fold", "split", F.when(F.col("__g") == 0, "group").otherwise("label").alias("kind"),
        F.when(F.col("__g") == 0, F.col(group).cast("string")).otherwise(F.col(label).cast("string")).alias("value"), "n",
    )


def limit_ids(df: DataFrame, sample: str, limit: float) -> DataFrame:
    """Rows of the first ``limit`` ids in id order; a limit of at most 1 is a proportion of the ids.

    The cut id comes from a dense index over the distinct ids, so nothing is sorted in one task.
    """
    ids = df.select(sample).distinct()
    ranked = dense_index(ids, [sample], out="__i", unique=True)
    n = int(limit) if limit > 1 else int(limit * ids.count())
    return df.join(ranked.filter(F.col("__i") < n).select(sample), sample, "left_semi")
