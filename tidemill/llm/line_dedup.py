"""Repeated passages of lines: overlapping windows of three lines, later occurrences removed. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.arrays import bind
from tidemill.llm.common import Scratch

SIZE = 3


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """All rows and columns of ``docs``, with ``text`` reduced, and ``n_lines`` and ``n_removed`` (bigint).

    Every ``size`` consecutive lines (split at line feeds) form a window, identified by two 64-bit hashes. The first
    occurrence of a window, by (id, text hash, position), stays; the lines of every later one are removed, where
    lines covered by several windows count once. Occurrences are judged on the input. Windows of blank lines only are
    left alone.

    Null text stays null with 0 lines, texts of fewer lines than ``size`` stay as they are, and a text without any line left
    is empty. Null ids sort first. Repeated rows of the same id and text are one occurrence, so all of them stay alike.
    Input columns named n_lines or n_removed are replaced. An empty table gives no rows.

    Windows are counted with partial aggregation, and looked up by a join that Spark may split where one window is very frequent.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.drop("n_lines", "n_removed")
    lines = F.split(F.col(text), "\n", -1)
    narrow = docs.select(F.col(id_column).alias("__id"), F.xxhash64(text).alias("__th"), lines.alias("__lines")).where(
        F.size("__lines") >= size)

    def window(i):
        here = [F.col("__lines")[i + k] for k in range(size)]
        blank = ~F.concat(*here).rlike(r"[^ \t\r]")
        return F.struct(i.alias("pos"), F.xxhash64(*here).alias("h1"), F.xxhash64(F.lit(size), *here).alias("h2"), blank.alias("blank"))

    windows = narrow.select("__id", "__th", F.explode(F.transform(F.sequence(F.lit(0), F.size("__lines") - size), window)).alias("w"))
    windows = scratch.write(windows.select("__id", "__th", "w.*").where("not blank").drop("blank"), "line-windows")
    place = F.struct("__id", "__th", "pos")
    repeated = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    repeated = scratch.write(repeated.drop("n"), "repeated-windows")
    later = windows.join(repeated, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first"))).select("__id", "__th", "pos")

    in_doc = Window.partitionBy("__id", "__th").orderBy("pos")
    before = F.lag("pos").over(in_doc)
    spans = later.withColumn("new", F.when(before + size >= F.col("pos"), 0).otherwise(1)).withColumn(
        "span", F.sum("new").over(in_doc)).groupBy("__id", "__th", "span").agg(
        F.min("pos").alias("begin"), (F.max("pos") + size).alias("end"))
    spans = spans.groupBy("__id", "__th").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("__spans"))
    spans = scratch.write(spans, "line-spans").select(F.col("__id").alias("__sid"), F.col("__th").alias("__sth"), "__spans")

    joined = docs.withColumn("__th", F.xxhash64(text)).join(
        spans.hint("merge"), F.col(id_column).eqNullSafe(F.col("__sid")) & (F.col("__th") == F.col("__sth")), "left")
    cut, n = F.col("__spans"), F.size(lines)

    def rebuilt(all_lines):
        def piece(i):
            begin = F.when(i == 0, 0).otherwise(cut[i - 1]["end"])
            end = F.when(i == F.size(cut), F.size(all_lines)).otherwise(cut[i]["begin"])
            return F.slice(all_lines, begin + 1, end - begin)

        # indexes stay in range under ANSI mode because each branch is only evaluated for its own pieces
        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(cut)), piece)), "\n")

    kept = bind(lines, rebuilt)  # split once, not for each piece
    removed = F.aggregate(cut, F.lit(0), lambda a, s: a + s["end"] - s["begin"])
    order = [F.col(c) if c != text else F.when(cut.isNull(), F.col(text)).otherwise(kept).alias(text) for c in docs.columns]
    return joined.select(
        *order, F.when(F.col(text).isNull(), 0).otherwise(n).cast("bigint").alias("n_lines"),
        F.when(cut.isNull(), 0).otherwise(removed).cast("bigint").alias("n_removed"))


SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
x AS (SELECT doc_id, l, unnest(range(0, len(l))) AS pos FROM d),
w AS (SELECT doc_id, pos, l[pos + 1] AS a, l[pos + 2] AS b, l[pos + 3] AS c FROM x WHERE pos + 3 <= len(l)),
later AS (SELECT doc_id, pos FROM w WHERE regexp_matches(a || b || c, '[^ \\t\\r]')
          QUALIFY row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) > 1),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM later, (SELECT unnest([0, 1, 2]) AS k)),
kept AS (SELECT x.doc_id, string_agg(l[x.pos + 1], chr(10) ORDER BY x.pos) AS text, count(*) AS n
         FROM x LEFT JOIN gone ON x.doc_id = gone.doc_id AND x.pos = gone.pos WHERE gone.doc_id IS NULL GROUP BY x.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text,
       CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(l), 0) - coalesce(n, 0) AS BIGINT) AS n_removed
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
