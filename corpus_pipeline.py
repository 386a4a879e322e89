"""Corpus preparation: the text operators of ``tidemill.llm`` in a row, each stage on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import decontamination, language_id, line_dedup, packing, queries, simhash
from tidemill.session import fresh_path

SURE = 0.5  # calibrated probability of the language below which a document is rejected


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter, and those whose language is less than even odds, go."""
    named = language_id.identify(docs, queries.learned_language(docs), docs.columns)
    return named.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= SURE)).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later occurrences of three-line passages; n_chars follows the text."""
    cut = line_dedup.dedup_lines(docs)
    columns = [F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return cut.select(*columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id in each SimHash group; of the group's rows that share that id, the one of least text, then of least other columns.

    Rows of one id in different groups are each their own group's affair. A row of null id stands for its group only if no row of
    the group has an id. An empty table gives no rows.
    """
    groups = simhash.near_groups(docs).select("fp", F.col("root").alias("__root"), F.col("component_id").alias("__least")).distinct()
    names = {c: f"__{i}" for i, c in enumerate(docs.columns)}  # no column can clash with the operator's
    plain = docs.toDF(*names.values())
    rows = simhash.fingerprints(plain, plain.columns, names["text"]).join(groups, "fp").where(F.col(names["doc_id"]).eqNullSafe(F.col("__least")))
    order = F.struct(names["text"], *[n for c, n in names.items() if c != "text"])
    chosen = rows.groupBy("__root").agg(F.min(order).alias("__first"))
    return chosen.select(*[F.col("__first")[n].alias(c) for c, n in names.items()])


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item. Null and empty texts hold none; repeated rows and null ids are judged by their text."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document, with its place in sequences of 2048 tokens. Null and empty texts are a piece of one id."""
    return packing.pack(docs, queries.tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("language id", keep_known_language),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", one_of_each_group),
    ("benchmark decontamination", drop_benchmark_passages),
    ("best-fit packing", pack_sequences),
]

ORACLE_SQL = None  # SQL cannot express the learned language model, SimHash or the packing


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
