import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import clashing, documents, frame

from tidemill.llm import encoding, packing
from tidemill.llm.queries import QUERIES, tokenizer_file

WORD = tokenizer_file("word_bpe_49k.json")


def check_plan(counts, capacity):
    rows = packing.plan(dict(counts), capacity)
    used, filled = Counter(), defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.length, r.first)):
        assert r.first == used[r.length]
        used[r.length] += r.count
        for i in range(r.count):
            filled[r.sequence + i // r.each].append((r.offset + i % r.each * r.length, r.length))
    assert used == Counter({k: v for k, v in counts.items() if v})
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(filled) == list(range(len(filled)))
    return len(filled)


def fewest(sizes, capacity):
    """Least number of sequences, by exhaustive search."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for r in {x for x in rooms if x >= sizes[i]}:
            rest = list(rooms)
            rest.remove(r)
            go(i + 1, rest + [r - sizes[i]])
        go(i + 1, rooms + [capacity - sizes[i]])

    go(0, [])
    return best[0]


def best_fit(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= s]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= s
        else:
            rooms.append(capacity - s)
    return len(rooms)


def test_plans_are_valid_and_near_the_optimum():
    r = random.Random(1)
    for n in range(120):
        sizes = [r.randint(1, 20) for _ in range(r.randint(1, 9))]
        got = check_plan(Counter(sizes), 20)
        assert fewest(sizes, 20) <= got <= fewest(sizes, 20) + 1
    for n in (50, 500, 5000):
        sizes = [min(200, 1 + int(r.expovariate(1 / 50))) for _ in range(n)]
        assert check_plan(Counter(sizes), 200) <= best_fit(sizes, 200) + 1


@pytest.mark.parametrize("counts,sequences", [({}, 0), ({2048: 5}, 5), ({1: 2048}, 1), ({1024: 7}, 4), ({1025: 3}, 3), ({2047: 4, 1: 9}, 5), ({700: 3, 1348: 3}, 3)])
def test_cases_with_a_known_answer(counts, sequences):
    assert check_plan(counts, 2048) == sequences


def test_dominated_sets_stay_optimal():
    """What the reduction fixes must be in some optimal packing."""
    r = random.Random(5)
    for _ in range(60):
        sizes = [r.randint(6, 20) for _ in range(r.randint(2, 9))]  # at most three to a sequence
        assert check_plan(Counter(sizes), 20) <= fewest(sizes, 20) + (1 if max(Counter(sizes).values()) > 2 else 1)


def test_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    texts = ["", "It's OK, I'LL don't!! a_b 12", "a\x1cb\x1fc", "<|endoftext|> <|ENDOFTEXT|>", "İstanbul ÀÉ ²½ x² ŉ ſ", "áé", "日本語 ㍍ 😀", "naïve—dash “q” Œuvre ẞ", "x" * 5000,
             " \x85 \xa0 ", "'s 'S s' 'll", *[t or "" for _, t in documents()]]
    encode, tok = encoding.Encoder(WORD), Tokenizer.from_file(WORD)
    for batch in (texts, texts[::-1]):
        assert [np.frombuffer(x, "<u4").tolist() for x in encode(batch)] == [tok.encode(t, add_special_tokens=False).ids for t in batch]
    limit, encoding.REMEMBERED = encoding.REMEMBERED, 3
    try:
        assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    finally:
        encoding.REMEMBERED = limit


def check_rows(rows, docs, capacity=2048):
    from tokenizers import Tokenizer

    tok, by, at = Tokenizer.from_file(WORD), defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        at[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for i, t in docs:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        want[i] += [(k, s, len(ids[s:s + capacity]), zlib.crc32(ids[s:s + capacity].tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
    assert {i: sorted((r.piece, r.start, r.length, r.ids_crc32) for r in v) for i, v in by.items()} == {i: sorted(v) for i, v in want.items()}
    for parts in at.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(at)


def test_awkward_rows(spark):
    rows = documents()
    assert check_rows(packing.pack(frame(spark, rows), WORD).collect(), rows) >= 8
    assert packing.pack(frame(spark, []), WORD).collect() == []
    clash = packing.pack(clashing(spark, rows[:3], "piece", "start", "length", "sequence_id"), WORD)
    assert len(clash.collect()) == 3


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = QUERIES["op7_packed_sequences"](spark, sf).collect()
    total = sum(r.length for r in rows)
    assert check_rows(rows, docs) <= -(-total // 2048) + 1
