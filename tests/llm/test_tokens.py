"""Encoding, counting and token shards against the libraries themselves."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from corvina.llm import bpe, token_count, token_files
from corvina.llm._tokens import QUICK, encoder, splitter

TEXTS = ["", " ", "Hello  world\n\n it's 12 o'clock", "é日本 ½²\t\x85\xa0x", "a <|endoftext|> b<|startoftext|>", "ΑΣ İ ſK", "don'T \r\n 'S", "x" * 5000, "word " * 3000, "</s> <s> <unk> ▁ \0 é", "🙂🙂 ok  "]
ROWS = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "no id"), (3, "again"), (3, "again"), (99, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in ROWS], "doc_id long, text string, chunk string, ids int").repartition(3)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_split_and_encode_as_the_library(name):
    path, r = P.path(name), random.Random(1)
    alphabet = [*map(chr, QUICK), *"日éΣİ🙂ſ"]
    texts = TEXTS + ["".join(r.choice(alphabet if r.random() < 0.3 else "ab 'sS1\n\t .,<|") for _ in range(r.randint(0, 60))) for _ in range(3000)]
    split, encode = splitter(path), encoder(path)
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    for t, ids in zip(texts, want, strict=True):
        assert [i for x in encode(split(t)) for i in x] == ids, t


def test_bpe(spark, docs):
    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    want = []
    for d, t in ROWS:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    for size in (64, 1 << 20):
        assert sorted(map(tuple, bpe.digests(docs, path, size).collect()), key=str) == sorted(want, key=str)
    back = bpe.decode(bpe.encode(docs, path), path, "decoded").collect()
    assert sorted((str(r["doc_id"]), r["decoded"]) for r in back) == sorted((str(d), t or "") for d, t in ROWS)
    assert bpe.digests(docs.limit(0), path).count() == 0


def test_equal_chunks(spark):
    rows = spark.createDataFrame([(1, "same text here")] * 6, "doc_id long, text string").repartition(3)
    assert bpe.digests(rows, P.path("byte_bpe_50k.json"), 1).count() == 6


def test_broken_ids_decode_as_the_library():
    path, r = P.path("byte_bpe_50k.json"), random.Random(2)
    tok = Tokenizer.from_file(path)
    for _ in range(300):
        ids = [r.randrange(50257) for _ in range(8)]
        assert bpe.decoded(path, np.array(ids)) == tok.decode(ids, skip_special_tokens=False)


def test_counts(spark, docs):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp, count, r = sentencepiece.SentencePieceProcessor(model_file=path), token_count.counter(path), random.Random(3)
    for _ in range(4000):
        t = "".join(r.choice("ab 'sS1\n\t .,<s>é日▁  \0\r½" + "the of and tion " * 3) for _ in range(r.randint(0, 50)))
        assert count(t) == len(sp.encode(t)), repr(t)
    got = token_count.counts(docs, path, 1000).collect()
    want = [(d, len((t or "").encode()), n := len(sp.encode(t or "")), n > 1000) for d, t in ROWS]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_count.counts(docs.limit(0), path).count() == 0


def test_shards(spark, docs, tmp_path):
    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    folder = f"file://{tmp_path}/shards"
    manifest = token_files.write(docs, path, folder, shard_ids_bytes=2000)
    got = token_files.read(manifest, folder).collect()
    want = []
    for d, t in ROWS:
        want.append((d, [*tok.encode(t or "", add_special_tokens=False).ids, 1]))
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=str) == sorted(((d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in want), key=str)
    got.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((d for d, _ in ROWS), key=lambda d: (d is None, d or 0))
    assert [r["start"] for r in got] == np.concatenate(([0], np.cumsum([r["n_tokens"] for r in got])[:-1])).tolist()
    assert manifest.count() > 2
    asked = spark.createDataFrame([(3,), (99,), (0,), (12345,), (-1,), (None,)], "doc_id long")
    found = token_files.lookup(manifest, folder, asked.union(asked)).collect()
    assert sorted((r["doc_id"], r["ids"]) for r in found) == sorted((d, x) for d, x in want if d in (3, 99, 0))
    empty = token_files.write(docs.limit(0), path, folder + "0")
    assert token_files.read(empty, folder + "0").count() == 0 and token_files.lookup(empty, folder + "0", asked).count() == 0


def test_rows_of_one_doc_id_over_shards(spark, tmp_path):
    path = P.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(7, f"text {k} " + "a b " * 20) for k in range(40)] + [(8, "x"), (-5, "y")], "doc_id long, text string").repartition(3)
    manifest = token_files.write(docs, path, str(tmp_path), shard_ids_bytes=300)
    assert token_files.lookup(manifest, str(tmp_path), spark.createDataFrame([(7,), (-5,)], "doc_id long")).count() == 41


def test_lookup_reads_a_bounded_number_of_bytes():
    import pyarrow as pa

    class Counted:
        def __init__(self, raw):
            self.file, self.read = pa.BufferReader(raw), 0

        def read_at(self, n, at):
            self.read += n
            return self.file.read_at(n, at)

    took = []
    for n in (1000, 200_000):
        d = np.arange(n)
        file = Counted(token_files.shard_bytes(d, np.zeros(n, bool), np.zeros(n, np.int64), np.full(n, 2), np.repeat(d, 2).astype("<u4").tobytes(), 4))
        shard = token_files.Shard(file)
        file.read = 0
        for x in range(0, n, n // 100):
            (o,), (m,) = shard.find(token_files.key_of(np.array([x]), np.zeros(1, np.int64)))
            assert shard.ids(o, m).tolist() == [x, x]
        took.append(file.read / 100)
    assert max(took) < 150


def test_index():
    for n in (0, 1, 2, 1000, 20_000):
        d, zeros = np.arange(n), np.zeros(n, np.int64)
        raw = token_files.shard_bytes(d, zeros.astype(bool), zeros, np.ones(n, np.int64), d.astype("<u2").tobytes(), 2)
        import pyarrow as pa

        shard = token_files.Shard(pa.BufferReader(raw))
        offset, length = shard.find(token_files.key_of(d, zeros)) if n < 2000 else (d, 1 + zeros)
        assert offset.tolist() == d.tolist() and (length == 1).all()
        shard.load("words", "ranks", "prints", "offsets", "lengths", "ids")
        offset, _ = shard.find(token_files.key_of(d, zeros))
        assert (shard.held["ids"][offset] == d).all()
        at = token_files.slots(token_files.key_of(d, zeros), shard.head["levels"], shard.fetch)
        assert sorted(at.tolist()) == list(range(n))
    strange = token_files.key_of(np.arange(n) + 10**9, np.zeros(n, np.int64))
    assert (shard.find(strange)[1] == -1).mean() > 0.999
    with pytest.raises(ValueError):
        token_files.build_index(np.array([7, 7], np.uint64))


def test_aligned_ranges():
    for low, high in ((0, 0), (-5, 9), (3, 1000), (-(2**63), 2**63 - 1), (2**62, 2**63 - 1)):
        cells = list(token_files._aligned(low, high))
        assert cells[0][1] << cells[0][0] == low and (cells[-1][1] + 1 << cells[-1][0]) - 1 == high
        assert all((n + 1) << b == m << c for (b, n), (c, m) in zip(cells, cells[1:]))
