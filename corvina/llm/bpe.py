"""BPE encoding and decoding by a table of distinct words.

Encoding: texts are split into pre-tokens in chunks of bounded size, once, and the chunks are kept in the shared folder. Each chunk keeps a list of its distinct words, in order, and every document becomes positions in that list. The chunks' lists are dealt out by word, so each distinct word of the corpus meets in one task and is encoded there once; the ids go back to the chunks by position and are joined to the documents. Only distinct words and their ids are shuffled; positions stay in the chunk's file, and texts are read once.

Decoding: ids are joined to the table of pieces (bounded: the vocabulary) by id, and the pieces' bytes are put together by position.

Defined cases: a null text counts as empty and has no ids; a text of any length is one row of one chunk, and is encoded whole; there are no ties; null and repeated doc_ids are kept, row for row; other columns of the input are ignored; an empty table gives an empty result. Special tokens' strings inside texts become their ids, as in the library.
"""

from __future__ import annotations

import functools
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._chunks import from_planes, planes
from ._common import binaries, bounded_batches, buckets, pack, ragged, shared_dir, slices, store_of, table, through_storage, trim, unpack
from ._tokens import encoder, splitter

#: Bytes of text whose words share one list.
CHUNK_BYTES = 12 << 20


def _chunks(batches, columns: list[str], path: str, size: int):
    """(other columns, list of distinct words in order of appearance, position of each word of the chunk, words per text)"""
    split = splitter(path)
    places: dict = {}
    found, counts, rows, held = [], [], [[] for _ in columns], 0

    def out():
        return rows, list(places), np.concatenate(found) if found else np.zeros(0, np.uint32), np.array(counts, np.int64)

    for others, data, offsets in slices(batches, columns):
        raw, bounds = data.tobytes(), offsets.tolist()
        for k in range(len(bounds) - 1):
            words = split(raw[bounds[k] : bounds[k + 1]].decode())
            # a word's place is the number of distinct words before it
            found.append(np.fromiter((places.setdefault(w, len(places)) for w in words), np.uint32, len(words)))
            counts.append(len(words))
        for to, x in zip(rows, others, strict=True):
            to += x.to_pylist()
        held += len(data)
        if held >= size:
            yield out()
            places, found, counts, rows, held = {}, [], [], [[] for _ in columns], 0
            trim()
    if counts:
        yield out()
    trim()


def _word_key(w) -> bytes:
    return w.encode() if isinstance(w, str) else b"\xff" + json.dumps(w).encode()


def _key_word(b: bytes):
    return tuple(json.loads(b[1:])) if b[:1] == b"\xff" else b.decode()


def _dealt(keys: list[bytes], n: int) -> np.ndarray:
    """The bucket of each word."""
    return np.fromiter(map(zlib.crc32, keys), np.uint32, len(keys)) % np.uint32(n)


def _lists(path: str, n: int, size: int, folder: str):
    """mapInArrow: for each chunk a file with its documents, a row (chunk, -1, nothing) and one (chunk, bucket, its words for that bucket) for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]):
        store, base = store_of(folder)
        store.create_dir(base, recursive=True)
        for rows, words, positions, counts in _chunks(batches, ["doc_id"], path, size):
            keys = list(map(_word_key, words))
            dealt = _dealt(keys, n)
            payload = pack(
                doc_id=np.array([x or 0 for x in rows[0]], np.int64),
                null=np.array([x is None for x in rows[0]], bool),
                counts=counts,
                bucket=dealt.astype(np.min_scalar_type(n)),
                **_ranked(positions, len(words)),
            )
            order = np.argsort(dealt, kind="stable")
            bounds = np.searchsorted(dealt[order], np.arange(n + 1))
            picked = [keys[i] for i in order.tolist()]
            lengths = np.fromiter(map(len, picked), np.uint32, len(picked))
            full = [b for b in range(n) if bounds[b] < bounds[b + 1]]
            payloads = [_zip(pack(lengths=lengths[bounds[b] : bounds[b + 1]], raw=np.frombuffer(b"".join(picked[bounds[b] : bounds[b + 1]]), np.uint8))) for b in full]
            # the rows are kept in the shared folder before anything reads them: a repeated task leaves at most files that no row names
            chunk = uuid.uuid4().hex
            with store.open_output_stream(f"{base}/{chunk}") as out:
                out.write(_zip(payload))
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * (1 + len(full))), pa.array([-1, *full], pa.int32()), pa.array([b"", *payloads], pa.binary())], ["chunk", "bucket", "payload"])

    return run


def _unzip(view) -> dict:
    size = int.from_bytes(view[:8], "little")
    return unpack(pa.decompress(pa.py_buffer(view[8:]), decompressed_size=size, codec="zstd"))


def _zip(p: bytes) -> bytes:
    return len(p).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(p, asbytes=True)


def _ranked(positions: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """Positions as ranks by frequency: a byte each for the first 255, 255 and the rest apart for others."""
    order = np.argsort(-np.bincount(positions, minlength=n), kind="stable").astype(np.uint32)
    rank = np.empty(n, np.uint32)
    rank[order] = np.arange(n, dtype=np.uint32)
    ranks = rank[positions]
    return {"order": order, "low": np.minimum(ranks, 255).astype(np.uint8)} | {f"r{k}": v for k, v in planes(ranks[ranks >= 255] - np.uint32(255)).items()}


def _positions(x: dict[str, np.ndarray]) -> np.ndarray:
    ranks = x["low"].astype(np.int64)
    ranks[ranks == 255] += from_planes(x, "r").astype(np.int64)
    return x["order"][ranks].astype(np.int64)


def _encode_bucket(path: str):
    """applyInArrow over a bucket of words: each distinct word is encoded once; a row of ids for each chunk's list."""

    def run(found: pa.Table) -> pa.Table:
        encode, places, lists = encoder(path), {}, []
        for view in binaries(found.column("payload")):
            x = _unzip(view)
            raw, ends = x["raw"].tobytes(), np.cumsum(x["lengths"], dtype=np.int64).tolist()
            begin, places_of = 0, np.empty(len(ends), np.int64)
            for k, end in enumerate(ends):
                places_of[k] = places.setdefault(raw[begin:end], len(places))
                begin = end
            lists.append(places_of)
        ids = encode(list(map(_key_word, places)))
        lengths = np.fromiter(map(len, ids), np.uint32, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(lengths.sum()))
        starts = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))[:-1]
        payloads = [_zip(pack(lengths=lengths[p], ids=flat[ragged(starts[p], lengths[p].astype(np.int64))])) for p in lists]
        places = ids = lists = None
        trim()
        return pa.table({"chunk": found.column("chunk"), "bucket": found.column("bucket"), "payload": pa.array(payloads, pa.binary())})

    return run


def _join_chunk(group: pa.Table, folder: str):
    """A chunk's documents with what joins their positions to the ids of its words."""
    parts = {b: _unzip(v) for b, v in zip(group.column("bucket").to_pylist(), binaries(group.column("payload")), strict=True) if b >= 0}
    store, base = store_of(folder)
    with store.open_input_file(f"{base}/{group.column('chunk')[0].as_py()}") as f:
        head = _unzip(memoryview(f.read_buffer()))
    dealt = head["bucket"].astype(np.int64)
    lengths = np.zeros(len(dealt), np.int64)
    sources = np.zeros(len(dealt), np.int64)
    flat, base = [], 0
    order = np.argsort(dealt, kind="stable")
    bounds = np.searchsorted(dealt[order], np.arange(int(dealt.max(initial=-1)) + 2))
    for b in range(len(bounds) - 1):
        own = order[bounds[b] : bounds[b + 1]]
        if not len(own):
            continue
        x = parts[b]
        own_lengths = x["lengths"].astype(np.int64)
        lengths[own] = own_lengths
        sources[own] = base + np.concatenate(([0], np.cumsum(own_lengths)))[:-1]
        flat.append(x["ids"])
        base += len(x["ids"])
    positions = _positions(head)
    ids = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
    word_bounds = np.concatenate(([0], np.cumsum(head["counts"])))
    doc_ids = [None if null else int(d) for d, null in zip(head["doc_id"], head["null"], strict=True)]
    return doc_ids, word_bounds, positions, sources, lengths, ids


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(start of each id's bytes and one more, all bytes) of the vocabulary of a byte-level file; ids that no piece has are empty."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    codes = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
    every = dict(spec["model"]["vocab"].items()) | {x["content"]: x["id"] for x in spec["added_tokens"]}
    out: list[bytes] = [b""] * (max(every.values()) + 1)
    for piece, i in every.items():
        out[i] = bytes(codes[c] for c in piece) if all(c in codes for c in piece) else piece.encode()
    return np.concatenate(([0], np.cumsum([len(x) for x in out]))), np.frombuffer(b"".join(out), np.uint8)


def decoded(path: str, ids: np.ndarray) -> str:
    """The text of ids: each joined to its piece by id, the pieces' bytes put together by position."""
    starts, raw = pieces(path)
    ids = ids[ids < len(starts) - 1].astype(np.int64)
    return raw[ragged(starts[ids], starts[ids + 1] - starts[ids])].tobytes().decode("utf-8", "replace")


def decoded_each(path: str, lists: pa.Array) -> list:
    """The texts of a column of lists of ids: one gather over all of them, null for null."""
    starts, raw = pieces(path)
    ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    known = ids < len(starts) - 1
    ids = np.where(known, ids, 0)
    sizes = np.where(known, starts[ids + 1] - starts[ids], 0)
    data = raw[ragged(starts[ids], sizes)].tobytes()
    at = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum([n or 0 for n in pc.list_value_length(lists).to_pylist()])))].tolist()
    return [data[a:b].decode("utf-8", "replace") if ok else None for a, b, ok in zip(at[:-1], at[1:], lists.is_valid().to_pylist(), strict=True)]


def _per_chunk(docs: DataFrame, path: str, then, schema: str, chunk_bytes: int) -> DataFrame:
    bounded_batches(docs.sparkSession)
    n = buckets(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = "chunk string, bucket int, payload binary"
    # split once and kept: both sides of the join below read the same chunks, whatever order the input comes in
    folder = shared_dir(docs.sparkSession, "bpe-chunks")
    stored = through_storage(texts.mapInArrow(_lists(path, n, chunk_bytes, folder), kind), "bpe", packed=True)
    ids = stored.where("bucket >= 0").groupBy("bucket").applyInArrow(_encode_bucket(path), kind)
    return ids.unionByName(stored.where("bucket < 0")).groupBy("chunk").applyInArrow(lambda group: then(*_join_chunk(group, folder)), schema)


def encode(docs: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, ids array<int>) of docs(doc_id, text)."""

    def run(doc_ids, bounds, positions, sources, lengths, ids) -> pa.Table:
        out = [ids[ragged(sources[p], lengths[p])].astype(np.int32) for p in (positions[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True))]
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.array(out, pa.list_(pa.int32()))})

    return _per_chunk(docs, path, run, "doc_id long, ids array<int>", chunk_bytes)


def decode(tokens: DataFrame, path: str, to: str = "text") -> DataFrame:
    """tokens(ids array<int>, ...) with the decoded text as a new column; null ids give a null text."""
    if to in tokens.columns:
        raise ValueError(f"there is a column {to}")

    @F.arrow_udf("string")
    def text_of(x: pa.Array) -> pa.Array:
        return pa.array(decoded_each(path, x), pa.string())

    return tokens.withColumn(to, text_of("ids"))


def digests(docs: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): what encode() and decode() give, as digests."""

    def run(doc_ids, bounds, positions, sources, lengths, ids) -> pa.Table:
        sizes, of_ids, of_text = [], [], []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            p = positions[a:b]
            own = ids[ragged(sources[p], lengths[p])].astype("<u4")
            sizes.append(len(own))
            of_ids.append(hashlib.sha256(own.tobytes()).hexdigest())
            of_text.append(hashlib.sha256(decoded(path, own).encode()).hexdigest())
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": pa.array(sizes, pa.int64()), "ids_sha256": pa.array(of_ids, pa.string()), "decoded_sha256": pa.array(of_text, pa.string())})

    return _per_chunk(docs, path, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", chunk_bytes)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
