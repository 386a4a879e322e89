import math
import random
from collections import Counter

import numpy as np
import pytest
from fixtures import ascii_lower, clashing, crc, documents, frame
from oracle import compare, connect
from pyspark.sql import functions as F

from tidemill.llm import class_lm, queries, token_counts, topk
from tidemill.llm.common import Scratch

VECTORS = "vec_id bigint, embedding array<float>"


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def plain_top(rows, k):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and usable(v)]
    out = []
    for i, v in {(i, tuple(v)) for i, v in kept if i % 100 == 0}:
        near = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in kept if j != i and len(w) == len(v))[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("leaf,rows_held,queries_held", [(96, 16384, 2048), (4, 64, 3)])
def test_top_k_matches_brute_force(spark, monkeypatch, leaf, rows_held, queries_held):
    monkeypatch.setattr(topk, "LEAF", leaf)
    monkeypatch.setattr(topk, "ROWS", rows_held)
    monkeypatch.setattr(topk, "QUERIES", queries_held)
    monkeypatch.setattr(topk, "SAMPLE", 50)
    r = random.Random(1)
    rows = [(i, [r.choice([-0.5, 0.25, 0.1, r.random()]) for _ in range(5)]) for i in range(1100)]
    rows += [(i, [0.25] * 5) for i in range(2000, 2030)] + [(3000, None), (3001, []), (3100, [1.0, None, 2.0, 0.0, 1.0]), (3200, [float("nan")] * 5), (3300, [float("inf")] * 5)]
    rows += [(4000, [0.1, 0.2]), (4001, [0.3, 0.4]), (None, [9.0] * 5), (7, rows[7][1]), (100, rows[100][1]), (5000, [1e4] * 5), (5001, [-1e4] * 5)]
    df = spark.createDataFrame(rows, VECTORS).repartition(3).withColumn("score", F.lit("x"))
    got = topk.top_k(df, F.col("vec_id") % 100 == 0)
    assert sorted(tuple(x) for x in got.select("query_id", "rank", "vec_id", "score").collect()) == plain_top(rows, 10)


def test_top_k_of_few_rows(spark):
    assert topk.top_k(spark.createDataFrame([], VECTORS), F.col("vec_id") % 100 == 0).collect() == []
    assert topk.top_k(spark.createDataFrame([(0, [1.0])], VECTORS), F.col("vec_id") % 100 == 0).collect() == []
    got = topk.top_k(spark.createDataFrame([(0, [1.0]), (1, [0.0])], VECTORS), F.col("vec_id") % 100 == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 0)]


def test_covering_radii_hold():
    v = np.random.default_rng(0).normal(size=(700, 6))
    order, root = topk.cover_tree(v)
    assert sorted(order) == list(range(700))
    todo = [root]
    while todo:
        n = todo.pop()
        assert (np.linalg.norm(v[order[n.begin:n.end]] - n.center, axis=1) <= n.radius + 1e-9).all()
        if n.children:
            assert sorted((c.begin, c.end) for c in n.children)[0][0] == n.begin and sum(c.end - c.begin for c in n.children) == n.end - n.begin
        todo += n.children


def test_top_k_query_matches_sql(spark, sf):
    assert compare(queries.QUERIES["op8_top_k"](spark, sf), queries.ORACLES["op8_top_k"], connect(sf)) == []


RECORDS = [("s", "en", "first line\nsecond, longer line\n\nlast"), (None, None, None), ("", "", ""), ("a\nb", "x", "\n\n\n"), ("src", "fr", "é日本語\nnaïve 😀\nfin\n"), ("s", "en", "word " * 4000), ("s", "en", "x" * 700)]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections_match_token_by_token(spark, rule):
    import public_tokenizers

    path = queries.tokenizer_file("byte_bpe_50k.tiktoken")
    encoder, _ = token_counts._encoder(path, public_tokenizers.PATTERN)
    rows = [(i, *r) for i, r in enumerate(RECORDS)] + [(0, *RECORDS[0])]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, text string").withColumn("line", F.lit("x"))
    got = Counter(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in token_counts.record_sections(df, path, ["doc_id", "line"], ["source", "lang", "text"], rule).select(
        "doc_id", "section", "field", "line", "begin", "end", "n_tokens", "n_crossing", "share").collect())
    want = Counter()
    for i, *fields in rows:
        lines = [(f, k, x) for f, v in zip(("source", "lang", "text"), fields) for k, x in enumerate((v or "").split("\n"))]
        record = "\n".join(x for _, _, x in lines)
        of_byte = [s for s, (_, _, x) in enumerate(lines) for _ in range(len(x.encode()) + (s < len(lines) - 1))]
        n, cross, share, at = [0] * len(lines), [0] * len(lines), [0.0] * len(lines), 0
        for token in encoder.encode_ordinary(record):
            size = len(encoder.decode_single_token_bytes(token))
            here = Counter(of_byte[at:at + size])
            at += size
            first = min(here)
            most = min(s for s in here if here[s] == max(here.values()))
            n[most if rule == "most" else first] += 1
            cross[first] += len(here) > 1
            for s, c in here.items():
                share[s] += c / size if rule == "share" else 0
        begin = 0
        for s, (f, k, x) in enumerate(lines):
            end = begin + len(x) + (s < len(lines) - 1)
            want[i, s, f, k, begin, end, n[s], cross[s], round(share[s] if rule == "share" else float(n[s]), 9)] += 1
            begin = end
    assert got == want


def test_sections_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert token_counts.record_sections(df, queries.tokenizer_file("byte_bpe_50k.tiktoken"), ["doc_id"], ["text"]).collect() == []
    with pytest.raises(ValueError):
        token_counts.record_sections(df, "", ["doc_id"], ["text"], rule="end")


def plain_words(text):
    words, now = [], ""
    for c in ascii_lower(text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [now] if now else []
            now = ""
        else:
            now += c
    return words + [None]


@pytest.mark.parametrize("near,clustered,flush", [(200_000, 1024, 300_000), (7, 5, 10)])
def test_scores_match_plain_version(spark, near, clustered, flush):
    rows = documents()
    held = {i: i is not None and crc(i) % 7 == 2 for i, _ in rows}
    df, scratch = frame(spark, rows), Scratch(spark)
    train = spark.createDataFrame([(i, t) for i, t in rows if not held[i]], df.schema)
    model = class_lm.fit(train, scratch, sizes=class_lm.Sizes(clustered, near, flush))
    got = class_lm.score(df.withColumn("score", F.lit(1)), model, ["doc_id", "score"], scratch).collect()
    counts = Counter(w for i, t in rows if not held[i] for w in plain_words(t))
    n, v = sum(counts.values()), len(counts)
    rank = {w: k for k, (w, _) in enumerate([x for x in model.near if x[0] != b" "][:clustered])}

    def kind(w):
        return int(model.classes[class_lm.unit(b" " if w is None else w.encode(), rank, clustered)])

    size, types, moves = Counter(), Counter(), Counter()
    for w, c in counts.items():
        size[kind(w)] += c
        types[kind(w)] += 1
    for i, t in rows:
        if not held[i]:
            k = [kind(None), *map(kind, plain_words(t))]
            moves.update(zip(k, k[1:]))
    into, out = Counter(), Counter()
    for (a, b), c in moves.items():
        into[b] += c
        out[a] += c
    total = sum(moves.values())

    def logp(a, b, w):
        share = (into[b] + 1) / (total + class_lm.N_CLASSES)
        step = (moves[a, b] + class_lm.STRENGTH * share) / (out[a] + class_lm.STRENGTH)
        return math.log10(step) + math.log10((counts[w] + 1) / (size[b] + types[b] + 1))

    want = []
    for i, t in rows:
        w = plain_words(t)
        k = [kind(None), *map(kind, w)]
        want.append((str(i), len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), sum(logp(a, b, x) for a, b, x in zip(k, k[1:], w))))
    mine = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    for a, b in zip(mine, sorted(want), strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-9)


def test_exchange_raises_the_likelihood_at_each_sweep():
    r = np.random.default_rng(3)
    kind = r.integers(0, 4, 40)
    flow = r.dirichlet([0.2] * 4, 4)
    pairs = np.zeros((41, 41))
    for a in range(40):
        for b in range(40):
            pairs[a, b] = r.poisson(60 * flow[kind[a], kind[b]])

    def likelihood(of):
        m = np.zeros((5, 5))
        for a in range(40):
            for b in range(40):
                m[of[a], of[b]] += pairs[a, b]
        x = lambda t: (t * np.log(np.maximum(t, 1))).sum()
        return x(m) - x(m.sum(axis=1)) - x(m.sum(axis=0))

    found = [likelihood(class_lm.exchange(pairs, 40, 4, s)) for s in range(6)]
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(found, found[1:])) and found[-1] > found[0]
    assert found[-1] >= 1.02 * likelihood(kind)  # both negative


def class_moves(texts, of):
    moves = np.zeros((class_lm.N_CLASSES, class_lm.N_CLASSES))
    for words in texts:
        k = [of[w] for w in [None, *words]]
        np.add.at(moves, (k[:-1], k[1:]), 1)
    return moves


def class_likelihood(texts, of):
    moves = class_moves(texts, of)
    return class_lm.likelihood(moves, moves.sum(axis=0))


def seasons(n):
    """Texts in which rare words of two kinds, which end alike, follow frequent ones of their kind."""
    r = random.Random(5)
    cold, warm = [[f"{kind}{i}x" for i in range(60)] for kind in ("c", "w")]
    return [(i, " ".join(f"{r.choice(['ice', 'snow'])} {r.choice(cold)}" if r.random() < 0.5 else f"{r.choice(['sun', 'sand'])} {r.choice(warm)}" for _ in range(20))) for i in range(n)]


@pytest.mark.parametrize("near,entries,parts", [(4, 50, 3), (40, 3_000_000, 7), (500, 1, 1)])
def test_words_beyond_the_clustered_are_placed_by_exchange(spark, near, entries, parts):
    rows = seasons(40) + [(100, None), (101, ""), (None, "ice c1x c1x rest"), (3, "sun w1x"), (3, "sun w1x")]
    texts, scratch, df = [plain_words(t) for _, t in rows], Scratch(spark), frame(spark, rows).repartition(parts)
    model = class_lm.fit(df, scratch, sizes=class_lm.Sizes(4, near, 10, 300, entries))
    encoded = class_lm.encode(df, model, ["doc_id"], scratch)
    rank = {w: k for k, (w, _) in enumerate([x for x in model.near if x[0] != b" "][:4])}
    start = {w: int(model.classes[class_lm.unit(b" " if w is None else w.encode(), rank, 4)]) for t in texts for w in t}

    def classes(placed):
        ids = {r.id + class_lm._first_far(model): r.word for r in model.vocabulary.collect()}
        got = {w: int(k) for (w, _), k in zip(model.near, placed.kinds)} | {bytes(ids[r.id]): r["class"] for r in placed.placed.collect()}
        return {w: got.get(b" " if w is None else w.encode(), start[w]) for w in start}

    once = classes(class_lm.place(encoded, model, scratch, 1))
    before = class_likelihood(texts, start)
    assert once[None] == start[None] and class_likelihood(texts, once) > before
    for w in start:
        if w is None or w.encode() in rank:
            assert once[w] == start[w]
            continue
        gain = {k: class_likelihood(texts, start | {w: k}) - before for k in {*start.values(), once[w]} - {start[None]}}
        assert gain[once[w]] >= max(gain.values()) - 1e-6

    placed = class_lm.place(encoded, model, scratch, 3)
    last = classes(placed)
    assert class_likelihood(texts, last) >= class_likelihood(texts, once)
    moves, counts, mass = class_moves(texts, last), Counter(w for t in texts for w in t), Counter()
    for w, n in counts.items():
        mass[last[w]] += n + 1
    step = class_lm.transitions(moves)
    want = sorted((str(i), sum(step[last[a], last[b]] + math.log10((counts[b] + 1) / (mass[last[b]] + 1)) for a, b in zip([None, *t], t))) for (i, _), t in zip(rows, texts))
    got = sorted((str(r.doc_id), r.score) for r in class_lm.score_encoded(encoded, placed, ["doc_id"]).collect())
    assert [x for x, _ in got] == [x for x, _ in want] and [x for _, x in got] == pytest.approx([x for _, x in want], rel=1e-9)


def test_rare_words_go_by_their_neighbours_not_by_their_ending(spark):
    df, scratch = frame(spark, seasons(200)), Scratch(spark)
    model = class_lm.fit(df, scratch, sizes=class_lm.Sizes(4, 4, 100))
    encoded = class_lm.encode(df, model, ["doc_id"], scratch)
    placed = class_lm.place(encoded, model, scratch)

    def total(m):
        return sum(x.score for x in class_lm.score_encoded(encoded, m, []).collect())

    assert total(placed) > total(model) + 100


def test_sweeps_move_no_texts(spark):
    df, scratch = frame(spark, seasons(40)), Scratch(spark)
    words = class_lm.count_words(df, scratch, sizes=class_lm.Sizes(4, 4, 100))
    encoded = class_lm.encode(df, words, ["doc_id"], scratch)
    model = class_lm.cluster(encoded, words)
    links = class_lm._links(encoded, model, scratch, 3)
    chosen = links.select("part", "ids", "kinds")
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    near, far = class_lm._near_profiles(encoded, model, 3, True), class_lm._far_profiles(links, chosen, model, 3, True)
    assert "Join" not in plan(near) and "Aggregate" not in plan(near) and "Repartition" not in plan(near)
    assert "__codes" not in plan(far)
    whole = class_lm.fit(df, scratch, sizes=class_lm.Sizes(4, 4, 100))
    assert (whole.classes == model.classes).all() and (whole.transition == model.transition).all() and (whole.mass == model.mass).all()


def test_words_in_arrow_are_the_tokens():
    texts = [b"  A b\x0b\x0cC\tdd  ", None, b"", b" ", b"x\xc2\xa0Y \xc3\x89\xc2\x85z", b"Z\r\n\r\nq\x1fq z\x00 \x00"]
    many, words = class_lm._words_of(class_lm.pa.array(texts, class_lm.pa.binary()))
    want = [class_lm.tokens(t)[:-1] for t in texts]
    assert list(many) == [len(t) for t in want] and words.to_pylist() == sum(want, [])
    assert list(class_lm._endings(words)) == [class_lm.ending(w) for w in sum(want, [])]


def test_frequent_words_are_bounded_by_number_and_length(spark):
    rows = [(b"w%d" % i, 1000 - i // 2) for i in range(600)] + [(b"once%d" % i, 1) for i in range(20_000)] + [(b"x" * 65, 5000)]
    table = spark.createDataFrame(rows, "word binary, n long")
    known = sorted((r for r in rows if len(r[0]) <= class_lm.LONGEST), key=lambda r: (-r[1], r[0]))
    assert class_lm.frequent(table, 100_000) == known
    got = class_lm.frequent(table, 5600)
    assert got[:600] == known[:600] and abs(len(got) - 5600) < 250
    few = class_lm.frequent(table, 100)
    assert abs(len(few) - 100) < 10 and min(n for _, n in few) >= known[99][1] * 0.985
    assert class_lm.frequent(table.limit(0), 10) == []


def test_better_than_the_base_on_held_out_texts(spark, sf):
    got = queries.QUERIES["op10_class_language_model"](spark, sf).toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: crc(i) % 7 == 2)).all()
    assert got[got.held_out].score.sum() > got[got.held_out].base_score.sum()


def test_scores_of_nothing(spark):
    empty, scratch = frame(spark, []), Scratch(spark)
    model = class_lm.fit(empty, scratch)
    assert class_lm.score(empty, model, ["doc_id"], scratch).collect() == []
    got = class_lm.score(clashing(spark, [(1, "a b"), (2, None)], "word", "__row"), model, ["doc_id"], scratch).collect()
    assert {r.doc_id: (r.n_tokens, r.n_known, r.base_score) for r in got} == {1: (3, 0, 0.0), 2: (1, 0, 0.0)}


def test_placing_words_of_nothing(spark):
    scratch = Scratch(spark)
    for rows in ([], [(1, None), (2, " "), (None, "")]):
        df = frame(spark, rows)
        model = class_lm.fit(df, scratch)
        encoded = class_lm.encode(df, model, ["doc_id"], scratch)
        got = class_lm.score_encoded(encoded, class_lm.place(encoded, model, scratch), ["doc_id"]).collect()
        assert [r.n_tokens for r in got] == [1] * len(rows)
