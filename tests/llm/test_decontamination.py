import random
import re

import numpy as np
from fixtures import clashing, frame, prose

from tidemill.llm import decontamination as dc
from tidemill.llm.queries import QUERIES


def plain_edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(text, n, seed):
    r, t = random.Random(seed), list(text)
    for _ in range(n):
        i = r.randrange(len(t))
        kind = r.randrange(3)
        t[i:i + 1] = [] if kind == 0 else ["q"] if kind == 1 else [t[i], "z"]
    return "".join(t)


def test_finds_what_exhaustive_alignment_finds():
    items = [prose(i, 14)[:90] for i in range(6)] + ["short item of thirty letters x"]
    s = dc.segments(items)
    texts = []
    for k, item in enumerate(items):
        for n in range(0, 16, 2):
            texts.append(dc.normalize(prose(50 + k, 30) + " " + edited(item, n, 10 * k + n) + " " + prose(70 + n, 30)))
    got = dc.search(texts, s)
    for t, found in zip(texts, got):
        want = {s.item[i] for i in range(len(s.text)) if plain_edits(s.text[i], t) <= s.budget[i]}
        assert set(found) == want


def test_bands_respect_text_borders():
    item = prose(3, 14)[:80]
    texts = [item[:40], item[40:], item, "", item[:-3], "x" + item]
    assert [bool(x) for x in dc.search(texts, dc.segments([item]))] == [False, False, True, False, True, True]


def test_short_items_are_found_word_for_word():
    items = ["Blue, sky!", "the", "a b c d e f g h", "sky blue", "", None, "blue sky"]
    s = dc.segments(items + [prose(1, 30)])
    texts = [dc.normalize(t) for t in ("A blue sky: Blue Sky.", "bluesky theory", "x A-B-C-D-E-F-G-H", "", "the", prose(1, 30) + " the")]
    got = dc.search(texts, s)
    assert got[0] == {0: (1, 0, 2, 19), 6: (1, 0, 2, 19), 3: (1, 0, 7, 15)}
    assert [set(g) for g in got[1:]] == [set(), {2}, set(), {1}, {1, 7}]
    assert [set(g) for g in dc.search(texts, dc.segments(items))] == [set(g) - {7} for g in got]


def test_more_documents_than_one_search_can_number(monkeypatch):
    items = [prose(i, 14)[:90] for i in range(6)]
    texts = [dc.normalize(prose(90 + k, 20) + " " + items[k % 6] + " " + prose(40 + k, 5)) for k in range(11)]
    whole = dc.search(texts, dc.segments(items))
    monkeypatch.setattr(dc, "PACKED", 40)
    assert dc.search(texts, dc.segments(items)) == whole and all(whole)


def test_awkward_rows(spark):
    item = prose(5, 40)
    docs = [(1, prose(1, 50) + "\n" + item.upper().replace(" ", ",\n") + "!"), (2, None), (3, ""), (4, prose(2, 30)), (None, item), (1, item), (6, prose(9, 60000) + item)]
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "the"), (None, prose(77, 30)), (7, item)], "item_id int, text string")
    got = dc.contaminated(frame(spark, docs), bench, ["doc_id"]).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in got) == sorted([("1", 7), ("1", 7), ("None", 7), ("6", 7)] * 2)
    clean = dc.decontaminate(clashing(spark, docs, "hits", "item_id", "row", "edits"), bench)
    assert sorted(str(r.doc_id) for r in clean.collect()) == ["2", "3", "4"] and clean.columns == ["doc_id", "text", "hits", "item_id", "row", "edits"]
    assert dc.contaminated(clashing(spark, docs, "edits", "item_id"), bench, ["doc_id", "edits", "item_id"]).count() == 8
    assert dc.contaminated(frame(spark, docs), bench.limit(0), ["doc_id"]).count() == 0
    assert dc.contaminated(frame(spark, []), bench, ["doc_id"]).count() == 0


def test_blocks_of_the_benchmark_add_up(spark, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_BYTES", 200)
    items = [(i, prose(i, 25)) for i in range(12)]
    docs = frame(spark, [(i, prose(60 + i, 20) + " " + t) for i, t in items])
    bench = spark.createDataFrame(items, "item_id int, text string")
    assert sorted((r.doc_id, r.item_id) for r in dc.contaminated(docs, bench, ["doc_id"]).collect()) == [(i, i) for i in range(12)]
    assert dc.decontaminate(docs, bench).count() == 0


def test_query_finds_every_whole_item(spark, sf):
    def norm(x):
        return " ".join(re.findall(r"[^\W_]+", x.lower()))

    got = {(r.doc_id, r.item_id) for r in QUERIES["op2_benchmark_passages"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    want = {(d.doc_id, b.item_id) for d in docs for b in bench if norm(b.text) in norm(d.text)}
    assert want <= got and len(got - want) <= len(want) // 10


def test_alignment_is_exact():
    r = random.Random(2)
    for _ in range(30):
        p = "".join(r.choice("ab") for _ in range(12))
        t = "".join(r.choice("ab") for _ in range(12 + 7))
        got = dc.align(np.array([ord(c) for c in p]), np.array([[ord(c) for c in t]]))[0][0]
        assert got >= plain_edits(p, t)  # diagonals of the band only
