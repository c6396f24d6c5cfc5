"""Substring deduplication, the Jaccard join and components against brute force."""

import hashlib
import random
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corvina.llm import bpe, components, jaccard_join, substring_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def kept(rows, window):
    split = [WORDS.findall(t or "") for _, t in rows]
    first, out = {}, []
    for (d, _), w in zip(rows, split, strict=True):
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, (d, i)), (d, i))
    for (d, _), w in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (d, i):
                gone.update(range(i, i + window))
        stay = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(stay.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("window", [2, 4, 7])
def test_substrings(spark, window):
    r = random.Random(window)
    rows = [(i, None if i % 17 == 0 else " ".join(r.choice("ab") for _ in range(r.randint(0, 60)))) for i in range(-20, 40)]
    rows += [(41, ""), (42, "　 é\xa0b \x0b\x1f c"), (43, "a b " * 400), (43, "a b " * 400)]
    docs = spark.createDataFrame([(*x, "n") for x in rows], "doc_id long, text string, chunk string").repartition(5)
    got = substring_dedup.dedup(docs, window, chunk_bytes=200, digest=True)
    assert sorted(map(tuple, got.collect())) == kept(rows, window)


def test_window_of_documents(spark):
    base = " ".join(f"w{k}" for k in range(300))
    rows = [(5, base), (2, "x y " + " ".join(base.split()[100:180]) + " z"), (9, base.replace("w150", "other")), (10, " ".join(base.split()[:19]))]
    got = substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), digest=True)
    assert sorted(map(tuple, got.collect())) == kept(rows, 20)
    assert substring_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    null = spark.createDataFrame([(None, base), (1, base)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.dedup(null).collect()} == {1: 0, None: 300}


def joined(rows, n, percent):
    sets = {}
    for d, t in rows:
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return sorted((d, len(s), root(d)) for d, s in sets.items())


@pytest.mark.parametrize(("n", "percent", "block"), [(4, 85, 4096), (5, 80, 16), (2, 50, 16)])
def test_jaccard(spark, n, percent, block):
    r, rows = random.Random(n), []
    for i in range(250):
        if i % 4:
            w = (r.choice(rows)[1] or "x").split(" ")
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice("abcdefGh")
        else:
            w = [r.choice("abcdefghij") + r.choice("abcdefg") for _ in range(r.randint(0, 120))]
        rows.append((i * 3 - 100, " ".join(w) if i % 31 else None))
    docs = spark.createDataFrame([(*x, "n") for x in rows], "doc_id long, text string, sums string").repartition(4)
    got = jaccard_join.join(docs, n, percent, chunk_bytes=3000, block=block)
    assert sorted(map(tuple, got.collect())) == joined(rows, n, percent)


def test_jaccard_defined_cases(spark):
    rows = [(1, "a b c"), (2, "A  B c"), (3, ""), (4, None), (None, "a b c"), (7, "x " * 5000), (8, "x x x x"), (8, "x x x x")]
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4), (None, 1, None), (7, 1, 7), (8, 1, 7), (8, 1, 7)], key=str)
    assert jaccard_join.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    left = jaccard_join.first_of_each(spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, node string"), 4, 85)
    assert sorted((r["doc_id"] for r in left.collect()), key=str) == sorted([1, 3, 4, None, 7], key=str) and left.columns == ["doc_id", "text", "node"]


def test_hot_group_of_copies(spark):
    base = [f"w{k}" for k in range(200)]
    rows = [(i, " ".join(base[:199] + [f"z{i % 40}"])) for i in range(400)]
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["component_id"] for r in got.collect()} == {0}


def test_large_group_is_dealt_into_blocks(spark):
    r, rows = random.Random(8), []
    base = [f"w{k}" for k in range(150)]
    for i in range(700):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 3, 4])):
            at = r.randrange(len(w))
            w[at : at + 1] = r.choice([[], ["new"], [f"z{r.randrange(9)}", w[at]]])
        rows.append((i, " ".join(w)))
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), chunk_bytes=50_000, block=40)
    assert sorted(map(tuple, got.collect())) == joined(rows, 4, 85)


def test_input_that_is_never_read_in_the_same_order(spark):
    r = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(i, " ".join(f"w{r.randrange(900)}" for _ in range(r.randint(0, 60)))) for i in range(150)]
    rows = [(i, t if i % 3 else f"{t} {passage}") for i, t in rows] + [(200 + i, rows[i][1] + " more") for i in range(0, 150, 2)]

    def mixed(batches):
        order = random.SystemRandom()
        for b in batches:
            yield b.take(order.sample(range(b.num_rows), b.num_rows))

    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).mapInArrow(mixed, "doc_id long, text string")
    assert sorted(map(tuple, substring_dedup.dedup(docs, chunk_bytes=2000, digest=True).collect())) == kept(rows, 20)
    assert sorted(map(tuple, jaccard_join.join(docs, chunk_bytes=2000).collect())) == joined(rows, 4, 85)
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    assert {r["doc_id"]: r["n_tokens"] for r in bpe.digests(docs, path, 2000).collect()} == {d: len(tok.encode(t).ids) for d, t in rows}


def test_very_long_text(spark):
    w = [f"w{k % 7001}" for k in range(300_000)]
    rows = [(1, " ".join(w)), (2, " ".join(w[:299_000])), (3, "w1 w2 w3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substring_dedup.dedup(docs, digest=True).collect())) == kept(rows, 20)
    assert sorted(map(tuple, jaccard_join.join(docs).collect())) == joined(rows, 4, 85)


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100), (205, 200), (203, 205), (None, 1)]
    got = components.components(spark.createDataFrame(edges, "a long, b long").repartition(4))
    assert {tuple(r) for r in got.collect()} == {(i, 0) for i in range(1, 61)} | {(205, 200), (203, 200)}


def test_components_of_few_edges_take_no_rounds(spark, monkeypatch):
    from corvina.llm import components as module

    written = []
    store = module.through_storage
    monkeypatch.setattr(module, "through_storage", lambda df, name: written.append(name) or store(df, name))
    path = [(k + 1, k) for k in range(0, 400)] + [(1000, 900), (900, 1000), (5, 5), (None, 3)]
    edges = spark.createDataFrame(path, "a long, b long").repartition(8)
    want = {(k, 0) for k in range(1, 401)} | {(1000, 900)}
    assert {tuple(r) for r in module.components(edges).collect()} == want and len(written) == 2
    assert {tuple(r) for r in module.components(edges, few=0).collect()} == want and len(written) > 4
    assert module.components(edges.limit(0)).count() == 0
