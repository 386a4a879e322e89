import math
import random
from collections import Counter

import numpy as np
import pytest
from fixtures import clashing, crc, frame
from pyspark.sql import functions as F

from tidemill.llm import language_id as lid
from tidemill.llm.queries import QUERIES

SYLLABLES = {"aa": "tor men vik sal dur", "bb": "quo lia né ça ros", "cc": "wub zig pof kex yam"}


def texts(n, seed=0):
    r, rows = random.Random(seed), []
    for i in range(n):
        lang = r.choice(list(SYLLABLES))
        rows.append((i, " ".join("".join(r.choice(SYLLABLES[lang].split()) for _ in range(r.randint(1, 3))) for _ in range(r.randint(3, 40))), lang))
    return rows


SCHEMA = "doc_id bigint, text string, lang string"


def test_learns_and_is_sure(spark):
    model = lid.fit(frame(spark, texts(400), SCHEMA))
    got = lid.identify(frame(spark, texts(200, 1), SCHEMA), model, ["doc_id", "lang"]).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 198 and all(0 <= r.score <= 1 for r in got)
    assert (model.weights == 0).mean() > 0.5  # sparse


def test_awkward_rows(spark):
    rows = texts(200) + [(None, "tor men", "aa"), (901, None, "aa"), (902, "", "bb"), (903, "123 --- !?", "cc"), (904, "tor sal vik", None), (905, "TOR ", "aa"),
                         (906, "𝔘 tor", "aa"), (907, "😀 12", "aa"), (5, texts(6)[5][1], texts(6)[5][2])] + [(908, "tor men vik " * 60000, "aa")]
    docs = frame(spark, rows, SCHEMA)
    model = lid.fit(docs)
    got = lid.identify(docs, model, docs.columns).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [(by[i].lang_pred, by[i].score) for i in (901, 902, 903, 907)] == [("und", 0.0)] * 4
    assert by[908].lang_pred == by[904].lang_pred == "aa"
    assert lid.identify(clashing(spark, [(1, "tor men")], "lang_pred", "score", "held"), model, ["doc_id", "lang_pred", "held"]).columns == ["doc_id", "held", "lang_pred", "score"]


def test_nothing_to_learn_from(spark):
    empty = frame(spark, [], SCHEMA)
    model = lid.fit(empty)
    assert lid.identify(empty, model, ["doc_id"]).collect() == []
    assert [tuple(r) for r in lid.identify(frame(spark, [(1, "tor")]), model, ["doc_id"]).collect()] == [(1, "und", 0.0)]
    one = lid.fit(frame(spark, [(1, "tor men", "aa")], SCHEMA))
    assert [tuple(r) for r in lid.identify(frame(spark, [(1, "tor")]), one, ["doc_id"]).collect()] == [(1, "aa", 1.0)]


def plain_grams(text):
    """Hashed 1- to 3-grams of the letters, with one space for whatever stands between them."""
    padded = [" "]
    for c in text.lower():
        if c.isalpha():
            padded.append(c)
        elif padded[-1] != " ":
            padded.append(" ")
    padded += [" "] if padded[-1] != " " else []
    found = Counter()
    for n in (1, 2, 3):
        for i in range(len(padded) - n + 1):
            h = 0
            for c in padded[i:i + n]:
                h = (h + ord(c)) * 0x9E3779B1 % 2**32
                h ^= h >> 15
            found[h % lid.SIZE] += 1
    return found


def plain_vector(grams, idf):
    x = {f: (1 + math.log(n)) * idf(f) for f, n in grams.items()}
    norm = math.sqrt(sum(v * v for v in x.values()))
    return {f: v / norm for f, v in x.items()} | {lid.SIZE: 1.0}


def plain_chances(scores):
    e = [math.exp(v - max(scores)) for v in scores]
    return [v / sum(e) for v in e]


def test_model_and_scores_match_plain_version(spark):
    rows = texts(90, 7)
    hashed = spark.range(1000, 1200).select("id", (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)) == 0).alias("held")).collect()
    rows += [(r.id, "hop gru", "dd") for r in hashed if r.held][:2]  # a label of which all rows fall to the held-back fifth
    held = {r.doc_id: r.held for r in frame(spark, rows, SCHEMA).select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) == 0).alias("held")).collect()}
    model = lid.fit(frame(spark, rows, SCHEMA))
    labels, s = ["aa", "bb", "cc", "dd"], lid.Settings()
    assert model.labels == labels

    grams = {i: plain_grams(t) for i, t, _ in rows}
    seen = Counter(f for g in grams.values() for f in g)

    def idf(f):
        return math.log((1 + len(rows)) / (1 + seen[f])) + 1

    assert model.idf[sorted(seen)] == pytest.approx([idf(f) for f in sorted(seen)], rel=1e-12)
    x = {i: dict(sorted(plain_vector(g, idf).items())) for i, g in grams.items()}

    def place(row):
        at, v = lid.vector(np.bincount(list(grams[row[0]].elements()), minlength=lid.SIZE), model.idf)
        return labels.index(row[2]), len(at), at.tobytes(), v.tobytes()

    ordered = sorted(rows, key=place)
    train = [r for r in ordered if not held[r[0]] or r[2] == "dd"]
    kept = [r for r in ordered if held[r[0]] and r[2] != "dd"]
    assert len(kept) > 5
    z, n = Counter(), Counter()

    def weight(f, k):
        if abs(z[f, k]) <= s.l1:
            return 0.0
        return -(z[f, k] - math.copysign(s.l1, z[f, k])) / ((s.beta + math.sqrt(n[f, k])) / s.alpha + s.l2)

    def scores(v):
        return [sum(weight(f, k) * c for f, c in v.items()) for k in range(4)]

    for epoch in range(s.epochs):
        for at in np.random.default_rng(epoch).permutation(len(train)):
            i, _, lang = train[at]
            chances = plain_chances(scores(x[i]))
            for k in range(4):
                for f, c in x[i].items():
                    g, w = c * (chances[k] - (labels[k] == lang)), weight(f, k)
                    z[f, k] += g - (math.sqrt(n[f, k] + g * g) - math.sqrt(n[f, k])) / s.alpha * w
                    n[f, k] += g * g
    for k in range(4):
        assert model.weights[:, k][sorted(seen)] == pytest.approx([weight(f, k) for f in sorted(seen)], rel=1e-6, abs=1e-9)

    def loss(scale):
        wrong = 1 / (len(kept) + 2)
        total = 0.0
        for i, _, lang in kept:
            for k, p in enumerate(plain_chances([v / scale for v in scores(x[i])])):
                total -= (1 - wrong if labels[k] == lang else wrong / 3) * math.log(max(p, 1e-300))
        return total

    scales = [0.02 * 2500 ** (i / 119) for i in range(120)]
    scale = min(scales, key=loss)
    assert model.temperature == pytest.approx(scale, rel=1e-9)

    fresh = texts(60, 8) + [(700, "gru hop, HOP!", None)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in lid.identify(frame(spark, fresh, SCHEMA), model, ["doc_id"]).collect()}
    for i, t, _ in fresh:
        p = plain_chances([v / scale for v in scores(plain_vector(plain_grams(t), idf))])
        assert got[i] == (labels[p.index(max(p))], pytest.approx(max(p), rel=1e-6))
    assert got[700][0] == "dd"


def test_held_out_accuracy_of_the_query(spark, sf):
    got = QUERIES["op1_language_id"](spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas())
    assert (got.held_out == got.doc_id.map(lambda i: crc(i) % 5 == 0)).all()
    held = got[got.held_out]
    assert len(held) > 10 and (held.lang == held.lang_pred).mean() >= 0.97
