import random

import numpy as np
import pytest
import xxhash
from fixtures import ascii_lower, clashing, documents, frame

from tidemill.llm import simhash
from tidemill.llm.common import Scratch, components


def plain_fingerprint(text):
    words = [w for w in ascii_lower(text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_every_word_has_one_codeword_within_three_bits():
    code = simhash.golay(2)
    errors, begin = code.patterns[0]
    assert (np.diff(begin) == 1).all() and np.bitwise_count(errors).max() == 3


def test_groups_match_brute_force(spark):
    rows = documents()
    got = simhash.near_groups(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    fps = {plain_fingerprint(t) for _, t in rows}
    root = plain_components(fps, [(a, b) for a in fps for b in fps if (a ^ b).bit_count() <= 4])
    least = {}
    for i, t in rows:
        r = root[plain_fingerprint(t)]
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = sorted((str(i), plain_fingerprint(t), str(least.get(root[plain_fingerprint(t)]))) for i, t in rows)
    assert sorted((str(r.doc_id), r.fp % (1 << 64), str(r.component_id)) for r in got) == want


@pytest.mark.parametrize("piece,wide", [(4096, 32), (8, 4)])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, piece, wide):
    monkeypatch.setattr(simhash, "WIDE", wide)
    r = random.Random(3)
    centers = [r.getrandbits(64) for _ in range(6)]
    fps = {c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 7))) for c in centers for _ in range(60)} | {0, 15, 31, (1 << 64) - 1}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    scratch = Scratch(spark)
    links = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp bigint"), scratch, 4, piece)
    got = [(x.a, x.b) for x in links.collect()]
    assert all((a ^ b) % (1 << 64) in {(a ^ b) % (1 << 64)} and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4 for a, b in got)
    want = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4]
    assert plain_components(signed, got) == plain_components(signed, want)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(7, 7)] + [(300, 299), (299, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint"), Scratch(spark)).collect()}
    nodes = {x for p in links if p[0] != p[1] for x in p}
    want = plain_components(nodes, links)
    assert {n: got.get(n, n) for n in nodes} == want


def test_empty_and_clashing(spark):
    assert simhash.near_groups(frame(spark, [])).collect() == []
    rows = [(1, "a b c d e"), (2, "a b c d e")]
    got = simhash.near_groups(clashing(spark, rows, "fp", "root", "component_id", "anchor")).collect()
    assert {r.component_id for r in got} == {1}
