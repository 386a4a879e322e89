"""Tokens of the fields and lines of a record: the record is encoded once, whole, and each token goes to a section by its place."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import map_text

RULES = ("start", "most", "share")


def _encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        size[rank] = len(token)
    return tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size


def token_ends(encoder, size: np.ndarray, text: str) -> np.ndarray:
    """Where each token ends, in bytes of UTF-8: the vocabulary is byte-level, so lengths add up to the text."""
    return np.cumsum(size[np.array(encoder.encode_ordinary(text), dtype=np.int64)])


def attribute(ends: np.ndarray, edges: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, tokens begun here that cross an end, fractional tokens) of the sections between ``edges``; both sides cover the same bytes.

    ``start``: a token counts where its first byte lies. ``most``: where most of its bytes lie, the earliest of equals. ``share``: as ``start`` for
    the whole number, and by bytes for the fraction, which is the share of a token's bytes in each section (otherwise equal to the whole number).
    """
    n = len(edges) - 1
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    first = np.searchsorted(edges, begins, "right") - 1
    last = np.searchsorted(edges, ends - 1, "right") - 1
    crossing = first != last
    place, share = first.copy(), np.bincount(first[~crossing], minlength=n).astype(float)
    for t in np.flatnonzero(crossing):
        a, b = int(first[t]), int(last[t])
        cut = np.minimum(edges[a + 1:b + 2], ends[t]) - np.maximum(edges[a:b + 1], begins[t])
        share[a:b + 1] += cut / (ends[t] - begins[t])
        if rule == "most":
            place[t] = a + int(cut.argmax())
    whole = np.bincount(place, minlength=n)
    return whole, np.bincount(first[crossing], minlength=n), share if rule == "share" else whole.astype(float)


def record_sections(docs: DataFrame, tokenizer: str, keep: list[str], fields: list[str], rule: str = "start", pattern: str | None = None) -> DataFrame:
    """A row per section: ``keep`` columns, ``section`` (from 0), ``field``, ``line`` (from 0 within the field), ``begin`` and ``end`` (characters of the
    record), ``n_tokens``, ``n_crossing`` (tokens that begin here and reach further) and ``share`` (see ``attribute``).

    The record is its ``fields`` as text, joined by line feeds, and is encoded whole. A section is a line of a field with its line feed. Joining
    the sorted token ends with the sorted section edges gives every token to exactly one section, so the sections of a record add
    up to its tokens.

    Null fields are empty and have one empty line, which has tokens only for its line feed. Repeated rows give repeated sections; null values in
    other columns do not matter; columns of ``keep`` named like the results are replaced. An empty table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    results = ("section", "field", "line", "begin", "end", "n_tokens", "n_crossing", "share")
    keep = [c for c in keep if c not in results]
    one = [("section", pa.int32()), ("field", pa.string()), ("line", pa.int32()), ("begin", pa.int64()), ("end", pa.int64()),
           ("n_tokens", pa.int64()), ("n_crossing", pa.int64()), ("share", pa.float64())]
    names = list(fields)

    def make():
        encoder, size = _encoder(tokenizer, pattern)

        def sections(data):
            codes = np.frombuffer(data, dtype=np.uint8)
            lines = np.flatnonzero(codes == 10)
            return np.concatenate([[0], lines + 1, [len(codes)] if not len(lines) or lines[-1] + 1 < len(codes) else []]).astype(np.int64), codes

        def run(rows):
            columns: dict[str, list] = {c: [] for c, _ in one}
            lengths = [0]
            for packed in rows:
                # the record's bytes, preceded by the number of lines of each field
                head, _, record = (packed or b"").partition(b"\x00")
                counts = np.array([int(x) for x in head.split(b",")], dtype=np.int64)
                edges, codes = sections(record)
                if len(edges) - 1 < counts.sum():  # the last line is empty
                    edges = np.append(edges, len(codes))
                whole, crossing, share = attribute(token_ends(encoder, size, record.decode("utf-8")), edges, rule)
                chars = np.concatenate([[0], np.cumsum((codes & 0xC0) != 0x80)])[edges]
                n = len(edges) - 1
                columns["section"].append(np.arange(n))
                columns["field"] += [name for name, c in zip(names, counts) for _ in range(c)]
                columns["line"].append(np.concatenate([np.arange(c) for c in counts]))
                for c, x in (("begin", chars[:-1]), ("end", chars[1:]), ("n_tokens", whole), ("n_crossing", crossing), ("share", share)):
                    columns[c].append(x)
                lengths.append(lengths[-1] + n)
            made = [pa.array(columns[c], k) if c == "field" else pa.array(np.concatenate(columns[c]) if columns[c] else [], k) for c, k in one]
            return [pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.StructArray.from_arrays(made, names=[c for c, _ in one]))]

        return run

    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]
    counts = F.concat_ws(",", *[(F.octet_length(t) - F.octet_length(F.replace(t, F.lit("\n"))) + 1).cast("string") for t in texts])
    record = F.concat(counts, F.lit("\x00"), F.concat_ws("\n", *texts))
    spark_types = {pa.int32(): T.IntegerType(), pa.int64(): T.LongType(), pa.string(): T.StringType(), pa.float64(): T.DoubleType()}
    item = T.StructType([T.StructField(c, spark_types[k]) for c, k in one])
    got = map_text(docs, keep, record, make, [T.StructField("__sections", T.ArrayType(item))])
    return got.select(*keep, F.explode("__sections").alias("s")).select(*keep, "s.*")
