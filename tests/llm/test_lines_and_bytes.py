import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from fixtures import clashing, frame, prose
from oracle import compare, connect

from tidemill.llm import line_dedup, queries, suffix_dedup


def plain_lines(rows):
    """(id, text, lines, removed) of the input rows; equal rows are one occurrence."""
    first, gone = {}, {}
    order = sorted({(i is not None, i or 0, hash(t), t) for i, t in rows if t is not None})
    for known, i, _, t in order:
        lines = t.split("\n")
        for p in range(len(lines) - 2):
            w = tuple(lines[p:p + 3])
            if any(x.strip(" \t\r") for x in w):
                place = (known, i, t, p)
                if first.setdefault(w, place) != place:
                    gone.setdefault((known, i, t), set()).update((p, p + 1, p + 2))
    out = []
    for i, t in rows:
        lines = t.split("\n") if t is not None else []
        g = gone.get((i is not None, i or 0, t), set())
        out.append((i, None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in g), len(lines), len(g)))
    return sorted(out, key=str)


def test_lines_match_plain_version(spark):
    r = random.Random(4)
    rows = [(i, "\n".join(r.choice("abcd") for _ in range(r.randint(1, 14)))) for i in range(25)]
    rows += [(40, "a\nb\nc\nd\ne"), (41, "x\na\nb\nc\nd\ny"), (42, None), (43, ""), (44, "\n\n\n\n"), (45, "\n\n\n\n"), (46, "p\nq"), (47, "same\n" * 9), (48, "é\nü\nñ"), (49, "é\nü\nñ")]
    rows += [(50, "k\nl\nm"), (50, "k\nl\nm"), (None, "k\nl\nm\nn"), (51, "\n".join(f"line {k % 400}" for k in range(5000)))]
    got = line_dedup.dedup_lines(frame(spark, rows)).collect()
    assert sorted(((x.doc_id, x.text, x.n_lines, x.n_removed) for x in got), key=str) == plain_lines(rows)


def test_lines_keep_other_columns(spark):
    rows = [(1, "a\nb\nc"), (2, "a\nb\nc\nd")]
    got = line_dedup.dedup_lines(clashing(spark, rows, "pos", "h1", "first", "begin", "n_lines", "span"))
    assert got.columns == ["doc_id", "text", "pos", "h1", "first", "begin", "span", "n_lines", "n_removed"]
    assert {x.doc_id: x.text for x in got.collect()} == {1: "a\nb\nc", 2: "d"}
    assert line_dedup.dedup_lines(frame(spark, [])).collect() == []


def plain_bytes(texts, length):
    seen = Counter(t[p:p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for p in range(len(t) - length + 1):
            if seen[t[p:p + length]] > 1:
                gone[p:p + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def passages(seed):
    r = random.Random(seed)
    shared = [prose(500 + k, n) for k, n in enumerate((18, 25, 30, 33, 34, 40, 60, 200))]
    texts = []
    for i in range(40):
        parts = [prose(1000 + 7 * i + k, r.randint(0, 50)) for k in range(3)]
        s = r.choice(shared)
        a = r.randint(0, len(s) // 3)
        texts.append(parts[0] + s[a:len(s) - r.randint(0, len(s) // 3)] + parts[1] + r.choice(shared + ["é" * 130]) + parts[2])
    return texts + ["a" * 199, "a" * 200, "b" * 201, "c" * 700, "ab" * 300, "xyz" * 150 + "q" + "xyz" * 150, "", texts[0], prose(1, 30)[:200], prose(1, 30)[:200]]


@pytest.mark.parametrize("seed,block", [(1, 1 << 22), (2, 1000), (3, 257)])
def test_bytes_match_plain_version(spark, seed, block):
    texts = passages(seed)
    rows = list(enumerate(texts)) + [(None, texts[3]), (900, None), (901, texts[5]), (901, texts[5])]
    want = plain_bytes([(t or "").encode() for _, t in rows], 200)
    got = suffix_dedup.dedup_bytes(frame(spark, rows).repartition(4), limit=block).collect()
    a = sorted((str(i), *w) for (i, _), w in zip(rows, want))
    assert sorted((str(x.doc_id), x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == a


def test_bytes_of_empty_and_clashing_tables(spark):
    assert suffix_dedup.dedup_bytes(frame(spark, [])).collect() == []
    got = suffix_dedup.dedup_bytes(clashing(spark, [(1, "x" * 300)], "id", "hash", "z", "kept")).collect()
    assert [(x.doc_id, x.n_removed) for x in got] == [(1, 300)]


def test_lines_query_matches_sql(spark, sf):
    assert compare(queries.QUERIES["op9_line_dedup"](spark, sf), queries.ORACLES["op9_line_dedup"], connect(sf)) == []
