import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from fixtures import clashing, documents, frame
from tokenizers import Tokenizer

from tidemill.llm import queries, token_files
from tidemill.llm.encoding import Encoder

FILE = public_tokenizers.path("word_bpe_49k.json")


def plain(rows, path=FILE, end=1):
    """The rows by the library alone: (doc_id, start, n_tokens, crc32), in order of doc_id."""
    tokenizer, out, start = Tokenizer.from_file(path), [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
        out.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def got(spark, df, folder, path=FILE, **options):
    files = token_files.write_tokens(df, path, str(folder), end=1, **options)
    return files, sorted((tuple(r) for r in queries.token_digests(files).collect()), key=lambda r: r[1])


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 23, 31, 32])
def test_numbers_come_back_from_any_place(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 5001, dtype=np.uint64).astype("<u4")
    data = token_files.pack_bits(ids, bits)
    assert len(data) == -(-5001 * bits // 8)
    assert (token_files.unpack_bits(data, bits, 5001) == ids).all()
    for first, count in ((0, 0), (1, 1), (7, 13), (4990, 11), (5000, 1)):
        assert (token_files.unpack_bits(data, bits, count, first) == ids[first:first + count]).all()


def test_fewest_bits():
    assert [token_files.bits_for(n) for n in (1, 2, 3, 49408, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


def test_a_shard_is_read_at_random(tmp_path):
    draw = np.random.default_rng(5)
    docs = [(None if i == 3 else i - 9, draw.integers(0, 50257, n).astype("<u4")) for i, n in enumerate([0, 5, 8192, 1, 300_000, 0, 77, 16384])]
    w = token_files.ShardWriter(f"{tmp_path}/x", 17)
    for doc_id, ids in docs:
        w.add(doc_id, ids)
    n_docs, n_ids, size = w.close()
    assert (n_docs, n_ids, size) == (8, sum(len(i) for _, i in docs), (tmp_path / "x").stat().st_size)
    s, all_ids = token_files.Shard(f"{tmp_path}/x"), np.concatenate([i for _, i in docs])
    for a, b in ((0, n_ids), (8191, 8193), (5, 5), (300_000, 300_001), (n_ids - 1, n_ids)):
        assert (s.ids(a, b) == all_ids[a:b]).all()
    rows, begin = s.documents(3, 5)
    assert begin == 8197 and rows["named"].tolist() == [0, 1] and rows["end"].tolist() == [8198, 308198]
    damaged = bytearray((tmp_path / "x").read_bytes())
    damaged[100] ^= 1
    (tmp_path / "x").write_bytes(damaged)
    with pytest.raises(ValueError):
        token_files.Shard(f"{tmp_path}/x").ids(0, 10)


def test_documents_come_back(spark, tmp_path):
    rows = [r for r in documents() if r[0] is not None and r != documents()[-4]]
    _, found = got(spark, clashing(spark, rows, "ids", "start", "part", "body"), tmp_path)
    assert found == plain(rows)


def test_null_ids_and_ties_are_all_written(spark, tmp_path):
    rows = [(None, "a b"), (None, None), (7, "x y z"), (7, "x y z"), (7, ""), (2, "one")]
    _, found = got(spark, frame(spark, rows), tmp_path)
    assert [r[0] for r in found] == [None, None, 2, 7, 7, 7]
    assert sorted((str(r[0]), r[2], r[3]) for r in found) == sorted((str(r[0]), r[2], r[3]) for r in plain(rows))
    assert [r[1] for r in found] == [0, *np.cumsum([r[2] for r in found])[:-1].tolist()]


def test_files_roll_over(spark, tmp_path):
    rows = [(i, " ".join(f"w{j}" for j in range(40_000))) for i in range(60)]
    df = frame(spark, rows).coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        files, found = got(spark, df, tmp_path, shard_mb=1)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert files.count() > 3 and found == plain(rows)


def test_empty_table(spark, tmp_path):
    files, found = got(spark, frame(spark, []), tmp_path)
    assert files.count() == 0 and found == []


def test_ids_of_every_file_are_the_librarys():
    texts = ["Don't STOP it's 12 3½ — “q”", "naïve <|endoftext|> x", "", " \n\t", "ŒUVRE ÅNGSTRÖM Ž ĳ ſ ŉ", "Á é ünï 日本語", "a\x1cb\x85c\xa0d", "x" * 200 + " " + "é" * 90, "a,b;c!! (x)y--z 's"]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        encode, library = Encoder(path), Tokenizer.from_file(path)
        for _ in range(2):  # the second time from memory
            assert [list(np.frombuffer(b, "<u4")) for b in encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert Encoder(FILE).parts and not Encoder(public_tokenizers.path("byte_bpe_50k.json")).parts


def test_another_vocabulary(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i, f"Text {i} of the  day, naïve") for i in range(30)]
    assert got(spark, frame(spark, rows), tmp_path, path)[1] == plain(rows, path)
