"""Exact substring deduplication with fixed-block anchors.

Reference blocks are the non-overlapping runs of half a window of words in each document, at multiples of that length. Every window holds one whole block, so two equal windows meet in at least one block of the earlier one. The steps:
1. Each chunk sends the hashes of its rolling probes (all runs of a block's length at every word), each distinct one once, marked where one is a reference block.
2. A bucket answers which probes hit: runs that occur twice, one of them a block. These are the anchors.
3. Hits are extended: every window around an anchor is hashed in full and sent with its first place in the chunk.
4. A bucket finds the first place of each window in the corpus; all others are repeats. Overlapping repeats make up the maximal exact ones.
5. Each chunk removes the words that repeated windows cover.

Only windows around anchors are compared in full; no pairs are made, and a passage that a third of all documents hold costs one row a chunk.

Defined cases: null and empty texts have no words; a text of any length lies in one chunk and is judged whole; a null doc_id comes after all others; rows with the same doc_id count as the same place for equal starts, so equal repeated rows do not remove each other (these are the only ties); other columns are ignored; an empty table gives an empty result. Equality of windows is equality of 64-bit hashes of their word sequences.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import _chunks as ck
from ._common import U64, buckets, grams, mix, pack, table, unpack, word_hashes, words
from ._common import binaries

WINDOW = 20
NULL_ID = np.iinfo(np.int64).max


class _Words:
    """Words of a chunk and the hashes of its runs."""

    def __init__(self, c: ck.Chunk, window: int):
        self.block = window // 2
        self.starts, self.ends, self.first = words(c.data, c.offsets)
        n = len(self.starts)
        self.doc = np.repeat(np.arange(len(c.doc_id)), np.diff(self.first))
        self.pos = np.arange(n) - self.first[:-1][self.doc] if n else np.zeros(0, np.int64)
        self.left = self.first[1:][self.doc] - np.arange(n) if n else np.zeros(0, np.int64)
        hashes = word_hashes(c.data, self.starts, self.ends)
        self.blocks = grams(hashes, self.block)
        # a window is two runs: hashed from theirs, with the rest of an odd length
        m = n - window + 1
        if m > 0:
            self.windows = self.blocks[:m] * U64(0x9E3779B97F4A7C15) + mix(self.blocks[self.block : self.block + m] + U64(1))
            if window % 2:
                self.windows = self.windows + mix(hashes[window - 1 :] + U64(2))
            self.windows = mix(self.windows)
        else:
            self.windows = np.zeros(0, U64)
        self.window_at = np.flatnonzero(self.left[: len(self.windows)] >= window)
        # only documents with a whole window matter
        long = np.diff(self.first) >= window
        self.probe_at = np.flatnonzero((self.left[: len(self.blocks)] >= self.block) & long[self.doc[: len(self.blocks)]])
        self.doc_id = np.where(c.null, NULL_ID, c.doc_id)

    def probes(self):
        """(distinct keys in order, flags: 1 a block, 2 repeated here; order and run of each probe)"""
        keys = ck.short(self.blocks[self.probe_at])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        begin = ck.runs(keys)
        if not len(begin):
            return keys, np.zeros(0, np.uint8), order, begin
        aligned = (self.pos[self.probe_at][order] % self.block == 0).astype(np.uint8)
        flags = np.maximum.reduceat(aligned, begin) | (np.diff(np.append(begin, len(keys))) > 1).astype(np.uint8) << 1
        return keys[begin], flags, order, begin

    def distinct_windows(self, at: np.ndarray):
        """(distinct hashes in order, doc_id and position of the first place of each; order and run of each window at `at`)"""
        h, doc, pos = self.windows[at], self.doc_id[self.doc[at]], self.pos[at]
        order = np.lexsort((pos, doc, h))
        begin = ck.runs(h[order])
        first = order[begin]
        return h[first], doc[first], pos[first], order, begin


def _send_probes(n: int, window: int):
    def run(batches):
        for c in ck.stored(batches):
            keys, flags, _, _ = _Words(c, window).probes()
            bounds = ck.bucket_bounds(keys, n)
            yield ck.rows([(c.name, b, pack(flags=np.packbits(np.unpackbits(flags[bounds[b] : bounds[b + 1], None], axis=1)[:, 6:].reshape(-1)), **ck.sorted_planes(keys[bounds[b] : bounds[b + 1]]))) for b in range(n) if bounds[b] < bounds[b + 1]])

    return run


def _find_anchors(group: pa.Table) -> pa.Table:
    """For each chunk's list of probes, which of them hit."""
    names, of, found = ck.split_bucket(group)
    keys = [ck.from_sorted(x) for x in found]
    flags = [np.unpackbits(x["flags"])[: 2 * len(k)].reshape(-1, 2) for x, k in zip(found, keys, strict=True)]
    flat, marks = np.concatenate(keys), np.concatenate(flags)
    order = np.argsort(flat, kind="stable")
    begin = ck.runs(flat[order])
    sizes = np.diff(np.append(begin, len(flat)))
    repeated = np.maximum.reduceat(marks[order, 0], begin) | (sizes > 1)
    hit = (np.maximum.reduceat(marks[order, 1], begin) & repeated).astype(bool)
    answer = np.empty(len(flat), bool)
    answer[order] = np.repeat(hit, sizes)
    ends = np.cumsum([len(k) for k in keys])
    parts = np.split(answer, ends[:-1])
    return ck.as_table([(c, b, pack(bits=np.packbits(a))) for c, b, a in zip(names, of, parts, strict=True) if a.any()])


def _by_bucket(group: pa.Table) -> dict[int, dict]:
    return {b: unpack(v) for b, v in zip(group.column("bucket").to_pylist(), binaries(group.column("payload")), strict=True)}


def _send_windows(n: int, window: int):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not answers.num_rows:  # no probe of the chunk is an anchor
            return ck.as_table([])
        c = ck.unpack_texts(texts.column("chunk")[0].as_py(), binaries(texts.column("payload"))[0])
        w = _Words(c, window)
        keys, _, order, begin = w.probes()
        bounds = ck.bucket_bounds(keys, n)
        hit = np.zeros(len(keys), bool)
        for b, x in _by_bucket(answers).items():
            size = bounds[b + 1] - bounds[b]
            hit[bounds[b] : bounds[b + 1]] = np.unpackbits(x["bits"])[:size]
        # how many probes up to each word are anchors
        count = np.zeros(len(w.starts) + 1, np.int64)
        count[1 + w.probe_at[order[np.repeat(hit, np.diff(np.append(begin, len(order))))]]] = 1
        count = np.cumsum(count)
        at = w.window_at[count[w.window_at + window - w.block + 1] > count[w.window_at]]
        h, doc, pos, _, _ = w.distinct_windows(at)
        bounds = ck.bucket_bounds(ck.short(h), n)
        out = []
        for b in range(n):
            s = slice(bounds[b], bounds[b + 1])
            if s.start < s.stop:
                doc_planes = {f"d{k}": v for k, v in ck.planes((doc[s].astype(np.int64) ^ np.int64(-(2**63))).view(U64) if (doc[s] < 0).any() else doc[s].view(U64)).items()}
                pos_planes = {f"s{k}": v for k, v in ck.planes(pos[s].astype(U64)).items()}
                out.append((c.name, b, pack(signed=np.array([(doc[s] < 0).any()]), **ck.sorted_planes(h[s]), **doc_planes, **pos_planes)))
        return ck.as_table(out)

    return run


def _find_repeats(group: pa.Table) -> pa.Table:
    """For each chunk, the windows whose first place in the corpus lies elsewhere."""
    names, of, found = ck.split_bucket(group)
    h = [ck.from_sorted(x) for x in found]
    doc = []
    for x in found:
        d = ck.from_planes(x, "d").view(np.int64)
        doc.append(d ^ np.int64(-(2**63)) if x["signed"][0] else d)
    flat, docs, pos = np.concatenate(h), np.concatenate(doc), np.concatenate([ck.from_planes(x, "s") for x in found])
    order = np.lexsort((pos, docs, flat))
    begin = ck.runs(flat[order])
    sizes = np.diff(np.append(begin, len(flat)))
    first = np.repeat(order[begin], sizes)
    later = np.empty(len(flat), bool)
    later[order] = (docs[order] != docs[first]) | (pos[order] != pos[first])
    parts = np.split(later, np.cumsum([len(x) for x in h])[:-1])
    return ck.as_table([(c, b, pack(**ck.sorted_planes(x[a]))) for c, b, x, a in zip(names, of, h, parts, strict=True) if a.any()])


def _removed(c: ck.Chunk, w: _Words, answers: pa.Table, window: int) -> np.ndarray:
    """Which words of the chunk repeated windows cover."""
    repeated = [ck.from_sorted(unpack(v)) for v in binaries(answers.column("payload"))]
    at = w.window_at
    h, doc, pos, order, begin = w.distinct_windows(at)
    elsewhere = np.zeros(len(h), bool)
    for r in repeated:
        k = np.searchsorted(h, r)
        if len(r) and (k.max() >= len(h) or (h[k] != r).any()):
            raise ValueError("an answer names windows that the chunk does not hold")
        elsewhere[k] = True
    sizes = np.diff(np.append(begin, len(at)))
    own_doc, own_pos = w.doc_id[w.doc[at]][order], w.pos[at][order]
    later = np.repeat(elsewhere, sizes) | (own_doc != np.repeat(doc, sizes)) | (own_pos != np.repeat(pos, sizes))
    step = np.zeros(len(w.starts) + 1, np.int64)
    hit = at[order[later]]
    np.add.at(step, hit, 1)
    np.add.at(step, hit + window, -1)
    return np.cumsum(step[:-1]) > 0


def _results(window: int, texts_too: bool):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        ids, n_words, n_removed, kept_out = [], [], [], []
        names, values = texts.column("chunk").to_pylist(), binaries(texts.column("payload"))
        for name, value in zip(names, values, strict=True):  # one chunk
            c = ck.unpack_texts(name, value)
            w = _Words(c, window)
            gone = _removed(c, w, answers, window)
            raw = c.data.tobytes()
            for k in range(len(c.doc_id)):
                a, b = int(w.first[k]), int(w.first[k + 1])
                keep = np.flatnonzero(~gone[a:b]) + a
                kept = b" ".join([raw[s:e] for s, e in zip(w.starts[keep].tolist(), w.ends[keep].tolist(), strict=True)])
                ids.append(None if c.null[k] else int(c.doc_id[k]))
                n_words.append(b - a)
                n_removed.append(b - a - len(keep))
                kept_out.append(kept.decode() if texts_too else hashlib.sha256(kept).hexdigest())
        return pa.table([pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept_out, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def dedup(docs: DataFrame, window: int = WINDOW, chunk_bytes: int = ck.CHUNK_BYTES, digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept is the text that stays, its words joined by one space (or the SHA-256 of it)."""
    if window < 2:
        raise ValueError("a window has two words at least")
    n = buckets(docs)
    texts = ck.text_rows(docs, chunk_bytes)
    probes = texts.mapInArrow(_send_probes(n, window), ck.SCHEMA)
    anchors = probes.groupBy("bucket").applyInArrow(_find_anchors, ck.SCHEMA)
    windows = texts.groupBy("chunk").cogroup(anchors.groupBy("chunk")).applyInArrow(_send_windows(n, window), ck.SCHEMA)
    repeats = windows.groupBy("bucket").applyInArrow(_find_repeats, ck.SCHEMA)
    return texts.groupBy("chunk").cogroup(repeats.groupBy("chunk")).applyInArrow(_results(window, not digest), "doc_id long, n_words long, n_removed long, kept string")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), p AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS pos FROM w WHERE len(words) >= 20
), k AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY array_to_string(words[pos:pos + 19], ' ') ORDER BY doc_id, pos) AS nth FROM p
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS at FROM k WHERE nth > 1
), word AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS at FROM w
), kept AS (
  SELECT word.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY word.at) AS text FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.at = gone.at WHERE gone.at IS NULL GROUP BY word.doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
