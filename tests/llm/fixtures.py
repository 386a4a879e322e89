"""Small documents with every awkward case, and plain-Python versions of the operators to compare with."""

import random
import re
import zlib

WORDS = "stone river cloud amber quiet lantern meadow signal copper willow harbor ember thistle marble ocean falcon".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (r.choice(["", "", "er", "ing", "ly", "s"])) for _ in range(n))


def documents():
    """(doc_id, text) with nulls, empties, copies, near copies, repeated rows, ties and a long text."""
    base = prose(1, 120)
    rows = [(i, prose(100 + i, 20 + 7 * i)) for i in range(1, 15)]
    rows += [(20, base), (21, base), (22, base + " tail"), (23, base.replace("stone", "Stone")), (24, "one two"), (25, "one  two"), (26, ""), (27, None), (28, " \t\n"),
             (29, "ünï çôdé ßtraße 日本語 texte"), (30, base), (30, base), (31, prose(7, 9000)), (None, "no id here but words enough to count"), (None, None)]
    return rows


def frame(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema)


def clashing(spark, rows, *names):
    """The same rows with columns named like an operator's results or helpers, all null or text."""
    from pyspark.sql import functions as F

    df = frame(spark, rows)
    for n in names:
        df = df.withColumn(n, F.lit("x"))
    return df


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)
