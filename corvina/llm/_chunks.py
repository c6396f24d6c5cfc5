"""Chunks of documents whose 64-bit keys are dealt out by value and answered by position.

A chunk holds whole texts up to a bounded size. Chunks are written to the shared folder once, and all steps read them there: so a chunk and its name are the same in every step, whatever order the input comes in. Its distinct keys go to buckets as sorted lists, so a key that a third of all documents hold is sent once a chunk, not once a document. Answers come back in the order of the list. The texts themselves move at most once for each step that needs them, compressed.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import U64, binaries, bounded_batches, pack, slices, through_storage, trim, unpack

CHUNK_BYTES = 12 << 20
#: Bits of a key that is dealt out.
KEY_BITS = 48
SCHEMA = "chunk string, bucket int, payload binary"


@dataclass
class Chunk:
    name: str
    doc_id: np.ndarray
    null: np.ndarray
    data: np.ndarray
    offsets: np.ndarray


def texts_of(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _named(ids: list, parts: list, sizes: list) -> Chunk:
    null = np.array([x is None for x in ids], bool)
    doc_id = np.array([0 if x is None else x for x in ids], np.int64)
    data = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    offsets = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int64)
    return Chunk(uuid.uuid4().hex, doc_id, null, data, offsets)


def chunks(batches, size: int):
    ids, parts, sizes, held = [], [], [], 0
    for (own,), data, offsets in slices(batches, ["doc_id"]):
        ids += own.to_pylist()
        parts.append(data)
        sizes.append(np.diff(offsets))
        held += len(data)
        if held >= size:
            yield _named(ids, parts, sizes)
            ids, parts, sizes, held = [], [], [], 0
            trim()
    if ids:
        yield _named(ids, parts, sizes)
    trim()


def row(chunk: str, bucket: int, payload: bytes) -> pa.RecordBatch:
    return rows([(chunk, bucket, payload)])


def rows(found: list) -> pa.RecordBatch:
    a, b, c = zip(*found, strict=True) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.int32()), pa.array(c, pa.binary())], ["chunk", "bucket", "payload"])


def as_table(found: list) -> pa.Table:
    trim()
    return pa.Table.from_batches([rows(found)])


def pack_texts(c: Chunk) -> bytes:
    return pack(doc_id=c.doc_id, null=c.null, offsets=c.offsets, data=np.frombuffer(pa.compress(c.data.tobytes(), "zstd", asbytes=True) if len(c.data) else b"", np.uint8))


def unpack_texts(name: str, value) -> Chunk:
    x = unpack(value)
    size = int(x["offsets"][-1])
    data = np.frombuffer(pa.decompress(pa.py_buffer(x["data"]), decompressed_size=size, codec="zstd"), np.uint8) if size else np.zeros(0, np.uint8)
    return Chunk(name, x["doc_id"], x["null"], data, x["offsets"])


def text_rows(docs: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """A row (chunk, -1, texts) for each chunk, kept in the shared folder."""

    def run(batches):
        for c in chunks(batches, size):
            yield row(c.name, -1, pack_texts(c))

    return through_storage(texts_of(docs).mapInArrow(run, SCHEMA), "chunks", packed=True)


def stored(batches):
    """The chunks of rows that text_rows() made."""
    for batch in batches:
        for name, value in zip(batch.column(0).to_pylist(), binaries(batch.column(2)), strict=True):
            yield unpack_texts(name, value)
    trim()


def planes(values: np.ndarray) -> dict[str, np.ndarray]:
    """Unsigned values byte by byte, so that leading zeros compress."""
    raw = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)
    width = next((k for k in range(8, 0, -1) if raw[:, k - 1].any()), 0)
    return {f"p{k}": np.ascontiguousarray(raw[:, k]) for k in range(width)} | {"n": np.array([len(values)], np.int64)}


def from_planes(x: dict[str, np.ndarray], prefix: str = "") -> np.ndarray:
    raw = np.zeros((int(x[f"{prefix}n"][0]), 8), np.uint8)
    for k in range(8):
        if f"{prefix}p{k}" in x:
            raw[:, k] = x[f"{prefix}p{k}"]
    return raw.reshape(-1).view("<u8").astype(U64)


def sorted_planes(values: np.ndarray) -> dict[str, np.ndarray]:
    return planes(np.diff(values, prepend=U64(0)))


def from_sorted(x: dict[str, np.ndarray], prefix: str = "") -> np.ndarray:
    return np.cumsum(from_planes(x, prefix), dtype=U64)


def short(keys: np.ndarray) -> np.ndarray:
    return keys >> U64(64 - KEY_BITS)


def bucket_bounds(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of n buckets of equal key ranges begins in sorted keys of KEY_BITS bits."""
    edges = np.array([(b << KEY_BITS) // n for b in range(n)], U64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def runs(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)


def split_bucket(group: pa.Table) -> tuple[list[str], list[int], list[dict]]:
    return group.column("chunk").to_pylist(), group.column("bucket").to_pylist(), [unpack(v) for v in binaries(group.column("payload"))]
