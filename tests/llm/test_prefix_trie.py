import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tidemill.llm import prefix_trie, queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def plain(rows):
    """The nodes by dictionaries of whole prefixes."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made = own.get(c - c % 5, [])[:h] + ts[h:]
        for d in range(len(made) + 1):
            members[tuple(made[:d])].append(c)
        ends[tuple(made)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own_saved = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = own_saved + sum(saved[k] for k in children[node])
    return sorted(
        (min(m), len(node), min(members[node[:-1]]) if node else -1, len(m), len(children[node]), leaves[node], saved[node],
         hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()) for node, m in members.items())


def got(spark, rows):
    out = queries.trie_nodes(spark.createDataFrame(rows, SCHEMA))
    return sorted(tuple(-1 if v is None else v for v in r) for r in out.collect())


def talk(n, seed=3, says=3):
    r, rows = random.Random(seed), []
    for c in range(n):
        for t in range(r.choice([0, 1, 2, 5, 9, 12])):
            rows.append((c, t * 3, ["user", "assistant"][t % 2], f"ü{r.randrange(says)}" * (t % 4)))
    return rows


def awkward():
    rows = talk(60)
    rows += [(100, None, "user", "x"), (100, 0, None, None), (100, 0, "user", ""), (None, 1, "user", "lost"), (101, 1, "ab", "c"), (102, 1, "a", "bc"),
             (103, 1, "user", "x"), (103, 1, "user", "x"), (-7, 1, "user", "minus"), (2**60 + 5, 5, "user", "far"), (2**60 + 6, 5, "user", "far")]
    rows += [(2000 + 5 * i, t, "user", f"same {t}") for i in range(120) for t in range(3)]  # copies
    rows += [(5000, t, "user", f"long {t % 7}") for t in range(900)]  # one long conversation
    random.Random(1).shuffle(rows)
    return rows


@pytest.mark.parametrize("whole", [8, 100, 65_536])
def test_nodes_are_those_of_plain_python(spark, monkeypatch, whole):
    monkeypatch.setattr(prefix_trie, "WHOLE", whole)
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    rows = awkward()
    if whole == 8:  # splits down to small components, round by round
        rows = [r for r in rows if r[0] != 5000] + [(5000, t, "user", f"long {t}") for t in range(60)]
    assert got(spark, rows) == plain(rows)


def test_no_rows_and_one_row(spark):
    assert got(spark, []) == []
    for rows in ([(5, 0, "user", "x")], [(7, 0, "user", "x")], [(None, 0, "user", "x")]):
        assert got(spark, rows) == plain(rows)


def test_other_columns_do_not_matter(spark):
    rows = talk(20)
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("conv", "pos", "depth", "size", "weight", "comp", "s0"):
        df = df.withColumn(c, queries.F.lit("x"))
    assert sorted(tuple(-1 if v is None else v for v in r) for r in queries.trie_nodes(df).collect()) == plain(rows)


@pytest.mark.parametrize("seed", range(6))
def test_sums_of_random_forests(seed):
    r = np.random.default_rng(seed)
    n = int(r.integers(1, 400))
    parent = np.array([i if i == 0 or r.random() < 0.02 else (i - 1 if seed % 2 else int(r.integers(0, i))) for i in range(n)])
    depth = np.zeros(n, np.int64)
    weight, values = r.integers(1, 50, n), r.integers(-5, 100, (n, 2))
    want = values.copy()
    for i in range(n):
        depth[i] = 0 if parent[i] == i else depth[parent[i]] + 1
    for i in range(n - 1, -1, -1):
        if parent[i] != i:
            weight[parent[i]] += weight[i]
            want[parent[i]] += want[i]
    assert (prefix_trie.subtree_sums(parent, depth, weight, values) == want).all()
