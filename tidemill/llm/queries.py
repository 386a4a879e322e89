"""The registered queries of the text operators, with their SQL where SQL can express them."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import class_lm, decontamination, language_id, licenses, line_dedup, merkle, packing, prefix_trie, simhash, suffix_dedup, token_counts, token_files, topk
from tidemill.llm.common import Scratch, bucket_of
from tidemill.session import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def learned_language(docs: DataFrame) -> language_id.Model:
    """What may be learned from: rows whose crc32 of the id, modulo 5, is not 0."""
    return language_id.fit(docs.where(bucket_of("doc_id", 5) != 0))


@query("op1_language_id")
def op1(spark, sf_dir):
    """Predicted language of every document, learned from four fifths of them."""
    docs = read(spark, sf_dir, "documents")
    named = docs.select("doc_id", "text", F.coalesce(bucket_of("doc_id", 5) == 0, F.lit(False)).alias("held_out"))
    return language_id.identify(named, learned_language(docs), ["doc_id", "held_out"])


@query("op2_benchmark_passages")
def op2(spark, sf_dir):
    """Every document that holds a passage of a benchmark item, with the item and where."""
    return decontamination.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), ["doc_id"])


@query("op3_simhash_groups")
def op3(spark, sf_dir):
    """SimHash near-copies of whole documents: 4-word shingles, links at 4 bits or fewer."""
    found = simhash.near_groups(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex("fp").alias("fingerprint"), "component_id")


@query("op4_section_tokens")
def op4(spark, sf_dir):
    """Tokens of every section of every document: its source, its language, and each line of its text."""
    docs = read(spark, sf_dir, "documents")
    return token_counts.record_sections(docs, tokenizer_file("byte_bpe_50k.tiktoken"), ["doc_id"], ["source", "lang", "text"])


@query("op5_license_scan")
def op5(spark, sf_dir):
    """Licence notices of every document: base phrases by word, and the labels of all rules that stay."""
    return licenses.summary(read(spark, sf_dir, "documents"))


@query("op6_repeated_bytes")
def op6(spark, sf_dir):
    """Bytes of every document that belong to strings of 200 bytes found elsewhere, too."""
    return suffix_dedup.dedup_bytes(read(spark, sf_dir, "documents"), with_kept=False)


@query("op7_packed_sequences")
def op7(spark, sf_dir):
    """Where each piece of each document goes in sequences of 2048 tokens."""
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


@query("op8_top_k", topk.SQL)
def op8(spark, sf_dir):
    """The 10 best integer inner products of every hundredth vector among all others."""
    vectors = read(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, F.col("vec_id") % 100 == 0)


@query("op9_line_dedup", line_dedup.SQL)
def op9(spark, sf_dir):
    """Documents without the lines of repeated three-line windows."""
    found = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", "n_lines", "n_removed")


@query("op10_class_language_model")
def op10(spark, sf_dir):
    """Class-based bigram scores of every document, learned from six sevenths of them."""
    scratch = Scratch(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(bucket_of("doc_id", 7) == 2, F.lit(False)).alias("held_out"))
    words, keep = class_lm.count_words(docs.where("NOT held_out"), scratch), ["doc_id", "held_out"]
    encoded = class_lm.encode(docs, words, keep, scratch)
    train = encoded.where("NOT held_out")
    return class_lm.score_encoded(encoded, class_lm.place(train, class_lm.cluster(train, words), scratch), keep)


def token_digests(files: DataFrame) -> DataFrame:
    return token_files.read_tokens(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op11_token_files")
def op11(spark, sf_dir):
    """Documents as they come back from bit-packed token files that hold all of them in order of their ids."""
    files = token_files.write_tokens(
        read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), fresh_path(spark, "tokens"), end=1)
    return token_digests(files)


def proof_digests(docs: DataFrame) -> DataFrame:
    """Leaves, roots and folded proofs of documents; texts are lower-cased where 5 divides the crc32 of the id."""
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    changed = F.when(bucket_of("doc_id", 5) == 0, merkle.leaf_digest([*columns[:-1], lower]))
    made = merkle.prove(merkle.build(docs, "source", "doc_id", columns, {"claimed": changed}), "claimed")
    return made.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))


@query("op13_merkle_manifest")
def op13(spark, sf_dir):
    """Every document's leaf, roots and proof in the manifest, checked against a text that may have been changed."""
    return proof_digests(read(spark, sf_dir, "documents"))


def branched(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths) of rebuilt conversations: the first turns of conversation c - c % 5, then c's own after as many; crc32(c) % 9 of them."""
    own = turns.groupBy("conv").agg(F.count("*").alias("n"))
    own = own.select("conv", "n", (F.col("conv") - F.col("conv") % 5).alias("base"), F.crc32(F.col("conv").cast("string")) % 9).toDF("conv", "n", "base", "h")
    base = own.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    own = own.join(base, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    own = own.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    rest = turns.join(own, "conv").where("pos >= h").withColumn("pos", F.col("pos") - F.col("h") + F.col("taken"))
    heads = turns.where("pos < 8").withColumnRenamed("conv", "base").join(own, "base").where("pos < h")
    columns = ["conv", "pos", "d0", "d1", "size", "length"]
    return rest.select(*columns).unionByName(heads.select(*columns)), own.select("conv", "length")


def trie_nodes(conversations: DataFrame) -> DataFrame:
    """Every node of the trie of rebuilt conversations, with sums over its subtree."""
    scratch = Scratch(conversations.sparkSession)
    turns, lengths = branched(scratch.write(prefix_trie.numbered(conversations, "conv_id", "turn", "role", "text"), "turns"))
    trie = prefix_trie.build(turns, lengths, scratch)
    childless, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("size")
    nodes = prefix_trie.rollup(trie, {"leaves": childless, "saved": saved}, ["parent_conv", "n_convs", "n_children"], scratch)
    return nodes.join(prefix_trie.end_digests(trie), ["conv", "depth"]).select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children",
        F.col("sum_leaves").alias("n_leaves"), F.col("sum_saved").alias("saved_tokens"), "ends_sha256")


@query("op12_prefix_trie")
def op12(spark, sf_dir):
    """The prefixes that conversations share, as a trie with sums over subtrees."""
    return trie_nodes(read(spark, sf_dir, "conversations"))
