"""Every registered query over whole tables, against SQL, the libraries or brute force."""

import hashlib
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from corvina.llm import ann, decontaminate, quality, queries
from corvina.llm._common import LOWER, word_hashes, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return [(int(d), t or "") for d, t in pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "text"]].values]


def rows_of(spark, name, columns):
    return sorted(tuple(r[c] for c in columns) for r in queries.QUERIES[name](spark, SF).collect())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_as_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert rows_of(spark, name, columns) == sorted(want.fetchall())


def test_op1(spark, texts):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for d, t in texts:
        ids = tok.encode(t, add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert rows_of(spark, "op1_bpe", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]) == sorted(want)


def test_op2(spark, texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    assert rows_of(spark, "op2_token_count", ["doc_id", "n_bytes", "n_tokens", "over_limit"]) == sorted((d, len(t.encode()), n := len(sp.encode(t)), n > 4096) for d, t in texts)


def test_op6(spark, texts):
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want, start = [], 0
    for d, t in sorted(texts):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows_of(spark, "op6_token_files", ["doc_id", "start", "n_tokens", "ids_crc32"]) == want


def test_op7(spark, texts):
    model = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r["doc_id"]: r for r in queries.QUERIES["op7_quality"](spark, SF).collect()}
    assert len(got) == len(texts)
    for d, t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        x = np.concatenate([quality.passages(data[a : a + 512], np.array([0, len(data[a : a + 512])]))[0] for a in range(0, max(1, len(data)), 512)])
        h = np.tanh(x @ model["W"] + model["b"])
        e = (np.tanh(h @ model["V"]) / (1 + np.exp(-(h @ model["U"])))) @ model["w"]
        a = np.exp(e - e.max())
        s = 1 / (1 + np.exp(-((a / a.sum()) @ h @ model["c"] + model["d"][0])))
        assert abs(got[d]["score"] - s) < 1e-6 and got[d]["predicted"] == int(got[d]["score"] >= 0.7) and got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2)


def test_op9(spark):
    rows = pd.read_parquet(f"{SF}/embeddings.parquet")
    ids, x = rows.vec_id.to_numpy(), np.stack(rows.embedding.to_numpy()).astype(np.float64)
    got = queries.QUERIES["op9_ann"](spark, SF).toPandas().sort_values(["query_id", "rank"])
    hits = []
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        near = np.lexsort((ids, d))[:10]
        own = got[got.query_id == q]
        assert own["rank"].tolist() == list(range(1, 11)) and own.vec_id.is_unique
        exact = dict(zip(ids.tolist(), d.tolist(), strict=True))
        assert all(abs(exact[v] - s) < 1e-12 for v, s in zip(own.vec_id, own.score, strict=True))
        hits.append(len(set(own.vec_id) & set(ids[near])) / 10)
    assert set(got.query_id) == set(ids[ids % 100 == 0].tolist()) and np.mean(hits) >= 0.9


def test_op10(spark, texts):
    def hashed(t):
        data = LOWER[np.frombuffer(t.encode(), np.uint8)]
        s, e, _ = words(data, np.array([0, len(data)]))
        return word_hashes(data, s, e)

    items = [(int(i), hashed(t)) for i, t in pd.read_parquet(f"{SF}/benchmark.parquet")[["item_id", "text"]].values]
    want = set()
    for d, t in texts:
        own = hashed(t)
        for i, w in items:
            if len(own) and decontaminate.best_run(w, own)[0] <= decontaminate.edits_allowed(len(w)):
                want.add((d, i))
    got = set(rows_of(spark, "op10_decontaminate", ["doc_id", "item_id"]))
    assert got <= want and len(got) >= 0.98 * len(want) and want


def test_neighbours_end_to_end_on_many_rows(spark, monkeypatch):
    """40,000 vectors: recall of the whole path, and that codes spare most exact distances."""
    r = np.random.default_rng(3)
    centres = 4 * r.normal(size=(300, 32))
    x = (centres[r.integers(0, 300, 40_000)] + r.normal(size=(40_000, 32))).astype(np.float32)
    x[::3] = x[0] + (1e-3 * r.normal(size=x[::3].shape)).astype(np.float32)
    rows = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(40_000), "embedding": x.tolist()}), "vec_id long, embedding array<float>").repartition(4)
    got = ann.search(rows.union(rows.where("vec_id % 4000 = 0")), 400).toPandas()
    hits = []
    for q, own in got.groupby("query_id"):
        d = ((x.astype(np.float64) - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        assert len(own) == 10 and own.vec_id.is_unique
        hits.append(len(set(own.vec_id) & set(np.lexsort((np.arange(len(d)), d))[:10].tolist())) / 10)
    assert len(hits) == 100 and np.mean(hits) >= 0.9
    model = ann.Model(x[::2].astype(np.float64), 100)
    leaf, codes = model.encode(x.astype(np.float64))
    own = np.flatnonzero((leaf == leaf[1]) & (np.arange(len(x)) % 3 > 0))
    ranked, exact = [], ann._distances
    monkeypatch.setattr(ann, "_distances", lambda v, q: ranked.append(len(v)) or exact(v, q))
    found = {"ids": own, "x": x[own].astype(np.float64), "codes": codes[own].reshape(-1), "leaf": leaf[own]}
    ann._search_block(model, found, own[:20], x[own[:20]].astype(np.float64), 10, ann.RERANK)
    assert sum(ranked) < 0.8 * 20 * len(own)


def test_neighbours_of_large_and_repeated_vectors(spark):
    rows = [(0, [3e38, 0.0]), (1, [3e38, 1.0]), (2, [1.0, 3e38]), (100, [1.0, 1.0]), (100, [1.0, 1.0]), (100, [2.0, 1.0]), (3, [1.0, 2.0]), (3, [5.0, 5.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 100).toPandas()
    assert got[got.query_id == 100].sort_values("rank").vec_id.tolist()[0] == 3 and got.groupby("query_id").vec_id.nunique().tolist() == [4, 4]
    assert len(got) == 8
