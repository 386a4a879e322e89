import hashlib
import random
import re
import zlib

import pytest

from tidemill.llm import merkle, queries

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return h(*["-" if v is None else f"{len(v.encode())}:{v}" for v in values])


def tree(leaves):
    """(root, siblings and places of every leaf)"""
    level, ways = leaves, [[] for _ in leaves]
    at = list(range(len(leaves)))
    while len(level) > 1:
        for i, way in enumerate(ways):
            run = at[i] // 16 * 16
            way.append((level[run:at[i]], level[at[i] + 1:run + 16]))
            at[i] //= 16
        level = [h(*level[i:i + 16]) for i in range(0, len(level), 16)]
    return level[0], ways


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    made = []
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
        made.append(tree([leaf_of(*r) for r in by[s]]))
    root, over = tree([m[0] for m in made])
    out = []
    for s, (subroot, ways), top in zip(sources, made, over):
        for r, way in zip(by[s], ways):
            leaf, way = leaf_of(*r), way + top
            folded = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                folded = leaf_of(r[0], r[1] and re.sub("[A-Z]", lambda m: m[0].lower(), r[1]), *r[2:])
            for left, right in way:
                folded = h(*left, folded, *right)
            out.append((r[0], leaf, subroot, root, h(*[x for left, right in way for x in left + right]), folded, folded == root))
    return sorted(out, key=str)


def rows_of(sizes, seed=1):
    r, rows, i = random.Random(seed), [], 0
    for source, n in sizes.items():
        for _ in range(n):
            i += 1
            rows.append((i * 7 % 100_003, r.choice(["Some Text", "plain", "", None, "ÜNÏ Ab"]), r.choice(["en", None]), source, r.choice([None, 5])))
    r.shuffle(rows)
    return rows


def got(spark, rows):
    return sorted((tuple(r) for r in queries.proof_digests(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)


@pytest.mark.parametrize("block", [3, 40, 2048])
def test_many_sources_and_one_large(spark, monkeypatch, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    rows = rows_of({"hot": 700, None: 17, "": 1, "a": 16, "B": 2, "é": 33, **{f"s{i}": 1 + i % 3 for i in range(30)}})
    rows += [(None, "No Id", "en", "hot", 1), (None, None, None, None, None), (9, "Twice", "en", "a", 5), (9, "Twice", "en", "a", 5), (9, "Other", "en", "a", 5)]
    assert got(spark, rows) == plain(rows)


def test_one_source_one_row_and_none(spark):
    for rows in (rows_of({"x": 300}), rows_of({"x": 1}), rows_of({"x": 1, "y": 1}), []):
        assert got(spark, rows) == plain(rows) if rows else got(spark, rows) == []


def test_a_block_fetches_the_least(spark, monkeypatch):
    """What a block fetches is what it lacks on each level, and never more than 15 nodes on either side of a range."""
    monkeypatch.setattr(merkle, "BLOCK", 64)
    docs = spark.createDataFrame(rows_of({"x": 1000, "y": 70}), SCHEMA)
    manifest = merkle.build(docs, "source", "doc_id", ["doc_id", "text"])
    held = {}
    for r in manifest.leaves.collect():
        held.setdefault(r.block, {}).setdefault(r.tree, []).append(r.pos)
    fetched = {}
    for r in merkle.multiproof(manifest).collect():
        fetched.setdefault(r.block, set()).add((r.tree, r.level, r.idx))
    size = {r.tree: r.n for r in manifest.groups.collect()} | {merkle.TOP: 2}
    for block, trees in held.items():
        want = set()
        for t, places in [*trees.items(), (merkle.TOP, list(trees))]:
            known, n, level = set(places), size[t], 0
            while n > 1:
                runs = {i // 16 for i in known}
                want |= {(t, level, i) for u in runs for i in range(u * 16, min(u * 16 + 16, n)) if i not in known}
                known, n, level = runs, -(-n // 16), level + 1
        assert fetched.get(block, set()) == want


def test_a_proof_verifies_by_itself(spark):
    docs = spark.createDataFrame(rows_of({"x": 300, "y": 20, "z": 1}), SCHEMA).withColumn("leaf", merkle.F.lit("mine")).withColumn("pos", merkle.F.lit(1))
    for r in merkle.prove(merkle.build(docs, "source", "doc_id", ["doc_id", "source", "lang", "n_chars", "text"])).collect():
        node, at = r.leaf, 0
        for place, width in zip(r.places, r.widths):
            run = [r.proof[64 * (at + k):64 * (at + k + 1)] for k in range(width - 1)]
            node, at = h(*run[:place], node, *run[place:]), at + width - 1
        assert 64 * at == len(r.proof) and node == r.root == r.folded_root
