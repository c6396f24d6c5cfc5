"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

Words are lower-cased (A-Z) runs without white space. A text is contaminated by an item of m words if some run of its words is within floor(m * (100 - PERCENT) / 100) word edits of the item.
1. Windows: a run within k edits of an item of m words holds one of the item's k + 1 fragments (of floor(m / (k + 1)) words and more) unchanged, and m - k of its words. Only windows of an item's size around such a fragment are looked at; no match is lost by this.
2. The CGK random walk reads a window word by word: step j writes the current word and moves on if a random bit for (j, word) is 1. Windows that few edits part from an item stay close to it in Hamming distance.
3. Bit sampling: BANDS times, SAMPLED positions of a walk are taken together as a key; windows that share a key with an item of their size are candidates. For items of at most WALKED words and a fifth of them as edits, the bands reach a recall of RECALL or more at the largest edit distance; equal windows always meet. Walks drift apart as edits add up, so for all other items steps 2 and 3 are left out: every stretch of text that passes step 1 is a candidate, and nothing is missed.
4. Candidates are verified by the exact edit distance between the item and the best run of words around the window.

Items are read to the driver in blocks of at most ITEM_WORDS words, and the corpus is read once for each block, without a shuffle.

Defined cases: null and empty texts and items match nothing; a text of any length is searched whole; of runs with equally few edits the first that ends, then the longest, is reported; null and repeated doc_ids are kept row for row, one row for each item found; items with the same item_id are looked for one by one and reported once with the fewest edits; null item_ids are ignored; other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._chunks import texts_of
from ._common import LOWER, U64, bounded_batches, filtered, grams, mix, ragged, slices, table, word_hashes, words

PERCENT, RECALL = 80, 0.98
WALKS, BANDS, SAMPLED = 8, 48, 2
#: Items of more words are verified wherever the complete filters let them through.
WALKED = 100
#: Words of all items that are looked for in one pass.
ITEM_WORDS = 1 << 20
SCHEMA = "doc_id long, item_id long, edits int, first_word long, n_words int"


def edits_allowed(m: int, percent: int = PERCENT) -> int:
    return m * (100 - percent) // 100


def walked(m: int, k: int) -> bool:
    """Whether the walks and bands reach RECALL for items of m words with k edits."""
    return m <= WALKED and k <= m // 5


def embed(x: np.ndarray, steps: int, walk: int) -> np.ndarray:
    """The CGK walks of rows of words: (rows, steps)."""
    n, m = x.shape
    padded = np.concatenate((x, np.zeros((n, 1), U64)), axis=1)
    at, rows = np.zeros(n, np.int64), np.arange(n)
    out = np.empty((n, steps), U64)
    for j in range(steps):
        now = padded[rows, at]
        out[:, j] = now
        seed = U64((walk * 0x9E3779B97F4A7C15 + j * 0xD1B54A32D192ED03) % (1 << 64))
        at = np.minimum(at + (mix(now ^ seed) & U64(1)).astype(np.int64), m)
    return out


def signatures(x: np.ndarray) -> np.ndarray:
    """The keys of each row of words: (rows, BANDS)."""
    m = x.shape[1]
    steps = 2 * m + 4
    out = np.empty((len(x), BANDS), U64)
    for walk in range(WALKS):
        e = embed(x, steps, walk)
        r = np.random.default_rng(1000 * walk + m)
        for band in range(walk, BANDS, WALKS):
            # positions that the walk has not run past
            pick = r.choice(max(SAMPLED, int(1.5 * m)), SAMPLED, replace=False)
            key = np.full(len(x), band, U64)
            for p in pick:
                key = mix(key * U64(0x2545F4914F6CDD1D) + e[:, min(p, steps - 1)])
            out[:, band] = key
    return out


def best_run(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(fewest edits between the item and a run of the text, its first word, its length); of equal ones the first that ends, then the longest."""
    n = len(text)
    cost, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    j = np.arange(n + 1)
    for i, w in enumerate(item.tolist(), 1):
        change = np.append(i, cost[:-1] + (text != U64(w)))
        drop = cost + 1
        new = np.minimum(change, drop)
        from_ = np.where(change <= drop, np.append(0, begin[:-1]), begin)
        new[0] = i
        # words of the text in between: a running minimum along the row
        low = np.minimum.accumulate(new - j)
        src = np.maximum.accumulate(np.where(new - j == low, j, 0))
        cost, begin = low + j, from_[src]
    end = int(np.argmin(cost))
    return int(cost[end]), int(begin[end]), end - int(begin[end])


def _joined(stretches: np.ndarray):
    """Stretches (document, item, first, end) in order, those of a document and item that overlap as one."""
    held = None
    for d, i, a, b in stretches.T.tolist():
        if held and held[:2] == (d, i) and a <= held[3]:
            held = (d, i, held[2], max(b, held[3]))
        else:
            if held:
                yield held
            held = (d, i, a, b)
    if held:
        yield held


class Items:
    """Items of a block, by size, with their fragments and keys."""

    def __init__(self, ids: list[int], texts: list[str], percent: int = PERCENT):
        self.ids, self.words, self.percent = [], [], percent
        for i, t in zip(ids, texts, strict=True):
            data = LOWER[np.frombuffer((t or "").encode(), np.uint8)]
            s, e, _ = words(data, np.array([0, len(data)]))
            if len(s) and i is not None:
                self.ids.append(i)
                self.words.append(word_hashes(data, s, e))
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.k = np.array([edits_allowed(m, percent) for m in self.sizes.tolist()], np.int64)
        # fragments by length: sorted hashes with item and place
        found: dict[int, list] = {}
        for n, (w, k) in enumerate(zip(self.words, self.k.tolist(), strict=True)):
            # fragments may be taken shorter: this keeps their lengths few and is complete too
            size = len(w) // (k + 1)
            for f in range(k + 1):
                found.setdefault(min(size, 4), []).append((n, f * size))
        self.fragments = {}
        for size, own in found.items():
            item, at = np.array([x[0] for x in own]), np.array([x[1] for x in own])
            h = np.array([grams(self.words[n][a : a + size], size)[0] for n, a in own], U64)
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << 22, bool)
            bits[(h >> U64(42)).astype(np.int64)] = True
            self.fragments[size] = (h[order], item[order], at[order], bits)
        self.keys = {}
        self.walked = np.array([walked(m, k) for m, k in zip(self.sizes.tolist(), self.k.tolist(), strict=True)], bool)
        for m in sorted(set(self.sizes[self.walked].tolist())):
            own = np.flatnonzero(self.sizes == m)
            s = signatures(np.stack([self.words[i] for i in own]))
            flat = s.reshape(-1)
            order = np.argsort(flat, kind="stable")
            self.keys[m] = (flat[order], np.repeat(own, s.shape[1])[order])
        # distinct words of each item, end to end, for the word filter
        self.sets = [np.unique(w) for w in self.words]

    def windows(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows that can match, each once: rows of document, item size, first word; and, of items that are not walked, of document, item, first word, word after the last."""
        doc_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        docs, sizes, starts, whole = [], [], [], [np.zeros((4, 0), np.int64)]
        for size, (h, item, at, bits) in self.fragments.items():
            g = grams(hashes, size)
            ok = np.flatnonzero(bits[(g >> U64(42)).astype(np.int64)])
            ok = ok[doc_of[ok] == doc_of[ok + size - 1]]
            low, high = np.searchsorted(h, g[ok], "left"), np.searchsorted(h, g[ok], "right")
            n = high - low
            hit = ragged(low, n)
            p, it = np.repeat(ok, n), item[hit]
            d = doc_of[p]
            m, k = self.sizes[it], self.k[it]
            # what the item's words must be found in
            a = np.maximum(first[d], p - at[hit] - k)
            b = np.minimum(first[d + 1], p - at[hit] + m + k)
            keep = self._enough(hashes, a, b, it, m - k)
            full = keep & ~self.walked[it]
            whole.append(np.unique(np.stack([d[full], it[full], a[full], b[full]]), axis=1))
            keep &= self.walked[it]
            d, it, p, m, k, place = d[keep], it[keep], p[keep], m[keep], k[keep], at[hit][keep]
            span = 2 * k + 1
            s = ragged(p - place - k, span)
            d, m = np.repeat(d, span), np.repeat(m, span)
            s = np.maximum(s, first[d])
            docs.append(d)
            sizes.append(m)
            starts.append(s)
        each = np.stack([np.concatenate(x) for x in (docs, sizes, starts)]) if docs else np.zeros((3, 0), np.int64)
        return np.unique(each, axis=1), np.unique(np.concatenate(whole, axis=1), axis=1)

    def _enough(self, hashes, a, b, it, need):
        """Whether hashes[a:b] hold `need` words of the item (a word of the text counts as often as it stands)."""
        out = np.zeros(len(a), bool)
        order = np.argsort(it, kind="stable")
        edges = np.searchsorted(it[order], np.arange(len(self.sets) + 1))
        for n in np.unique(it).tolist():
            for own in np.array_split(order[edges[n] : edges[n + 1]], -(-(edges[n + 1] - edges[n]) // 4096)):
                length = b[own] - a[own]
                flat = hashes[ragged(a[own], length)]
                s = self.sets[n]
                at = np.minimum(np.searchsorted(s, flat), len(s) - 1)
                total = np.concatenate(([0], np.cumsum(s[at] == flat)))
                ends = np.cumsum(length)
                out[own] = total[ends] - total[ends - length] >= need[own]
        return out

    def find(self, hashes: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item, edits, first word, number of words): the best run for each document and item within reach."""
        (docs, sizes, starts), whole = self.windows(hashes, first)
        best: dict[tuple[int, int], tuple] = {}

        def verify(d: int, i: int, a: int, b: int) -> None:
            edits, begin, length = best_run(self.words[i], hashes[a:b])
            value = (edits, a + begin - int(first[d]), length, a, b)
            if (d, i) not in best or value[:3] < best[d, i][:3]:
                best[d, i] = value

        for d, i, a, b in _joined(whole):
            verify(d, i, a, b)
        for m in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == m)
            keys, item = self.keys[m]
            for part in np.array_split(own, -(-len(own) // 8192)):
                d, s = docs[part], starts[part]
                at = s[:, None] + np.arange(m)
                inside = at < first[d + 1][:, None]
                x = np.where(inside, hashes[np.minimum(at, len(hashes) - 1)], U64(0))
                sig = signatures(x).reshape(-1)
                low, high = np.searchsorted(keys, sig, "left"), np.searchsorted(keys, sig, "right")
                n = high - low
                window, it = np.repeat(np.repeat(np.arange(len(part)), BANDS), n), item[ragged(low, n)]
                # a window and an item once, however many keys they share
                for w, i in np.unique(np.stack([window, it]), axis=1).T.tolist():
                    pair = (int(d[w]), i)
                    k = int(self.k[i])
                    a, b = max(int(first[pair[0]]), int(s[w]) - k), min(int(first[pair[0] + 1]), int(s[w]) + m + k)
                    if pair in best and (best[pair][0] == 0 or best[pair][3] <= a and b <= best[pair][4]):
                        continue
                    verify(*pair, a, b)
        found: dict[tuple[int, int], tuple] = {}
        for (d, i), v in best.items():
            if v[0] <= self.k[i]:
                key = (d, self.ids[i])
                found[key] = min(found.get(key, v[:3]), v[:3])
        return [(d, i, *v) for (d, i), v in sorted(found.items())]


_prepared: dict[tuple, Items] = {}


def prepared(ids: list[int], texts: list[str], percent: int) -> Items:
    """The tables of a block, made once in a worker and kept for its later tasks."""
    key = (percent, hashlib.md5(repr((ids, texts)).encode()).digest())
    if key not in _prepared:
        _prepared.clear()
        _prepared[key] = Items(ids, texts, percent)
    return _prepared[key]


def _blocks(benchmark: DataFrame, most: int):
    ids, texts, held = [], [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        ids.append(r["item_id"])
        texts.append(r["text"])
        held += len(r["text"].split())
        if held >= most:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def find(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, item_words: int = ITEM_WORDS) -> DataFrame:
    """(doc_id, item_id, edits, first_word, n_words): the best run of each text for each item that contaminates it."""
    out = docs.sparkSession.createDataFrame([], SCHEMA)
    for ids, texts in _blocks(benchmark, item_words):

        def run(batches, ids=ids, texts=texts):
            items = prepared(ids, texts, percent)
            for (own,), data, offsets in slices(batches, ["doc_id"]):
                data = LOWER[data]
                s, e, first = words(data, offsets)
                found = items.find(word_hashes(data, s, e), first)
                if found:
                    d, i, edits, begin, n = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([own.take(pa.array(d)), pa.array(i, pa.int64()), pa.array(edits, pa.int32()), pa.array(begin, pa.int64()), pa.array(n, pa.int32())], ["doc_id", "item_id", "edits", "first_word", "n_words"])

        out = out.unionByName(texts_of(docs).mapInArrow(run, SCHEMA))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, item_words: int = ITEM_WORDS) -> DataFrame:
    """The rows of docs that no item contaminates, with all their columns."""
    bounded_batches(docs.sparkSession)
    for ids, texts in _blocks(benchmark, item_words):

        def good(batch, ids=ids, texts=texts):
            items, out, at = prepared(ids, texts, percent), np.ones(batch.num_rows, bool), 0
            for _, data, offsets in slices([batch], []):
                data = LOWER[data]
                s, e, first = words(data, offsets)
                out[[at + x[0] for x in items.find(word_hashes(data, s, e), first)]] = False
                at += len(offsets) - 1
            return out

        docs = filtered(docs, good)
    return docs


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
