"""Helpers that the corpus operators share: shared storage, vectorised words, packed rows."""

from __future__ import annotations

import ctypes
import json
import os
import struct
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

_OWN_DIRS: dict[str, str] = {}
#: Bytes of text that the vectorised code handles at once.
SLICE_BYTES = 1 << 19
U64 = np.uint64


def shared_dir(spark, name: str) -> str:
    """A fresh folder name under the cluster's shared folder (spark.checkpoint.dir); a temporary one only where that is unset in local mode, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN_DIRS:
            _OWN_DIRS[app] = tempfile.mkdtemp(prefix="corvina-")
            spark.sparkContext.setCheckpointDir(_OWN_DIRS[app])
        root = _OWN_DIRS[app]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store_of(folder: str):
    """(file system, folder in it) of a folder that executors share, for files that tasks write and read themselves."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


#: For rows of megabytes: row groups and pages end after few of them, so that readers hold little at once; they are compressed already.
PACKED = {"compression": "uncompressed", "parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}


def through_storage(df, name: str, packed: bool = False):
    """Cuts the lineage: writes df to the shared folder and reads it back. packed: its rows are large and compressed."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.options(**(PACKED if packed else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Bytes of input for each bucket that keys are dealt to, most buckets, and an estimate of bytes that only stands for "unknown".
BUCKET_BYTES, MOST_BUCKETS, UNKNOWN = 16 << 20, 8192, 1 << 50


def buckets(docs) -> int:
    """How many buckets keys of docs are dealt to: one for each shuffle partition, and more for large inputs, as a bucket is held by one task at a time."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(partitions(docs.sparkSession), min(MOST_BUCKETS, size // BUCKET_BYTES) if size < UNKNOWN else 0)


def bounded_batches(spark) -> None:
    """Lets Arrow batches of long texts end at a few megabytes, unless the session sets another bound than Spark's own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in (f"{64 << 20}b", "64m", str(64 << 20)):
        spark.conf.set(name, str(8 << 20))


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filtered(docs, good):
    """The rows of docs, with all their columns whatever their names, for which good(batch with the column `text` only) gives True."""
    names, at = docs.columns, docs.columns.index("text")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(good(pa.RecordBatch.from_arrays([batch.column(at).cast(pa.string())], ["text"]))))

    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    return plain.mapInArrow(run, plain.schema).toDF(*names)


def trim() -> None:
    """Gives free memory of a worker back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)


# ---- packed rows: named arrays in one binary value


def pack(**arrays: np.ndarray) -> bytes:
    head = json.dumps([(k, a.dtype.str, len(a)) for k, a in arrays.items()]).encode()
    return b"".join([struct.pack("<I", len(head)), head, *(np.ascontiguousarray(a).tobytes() for a in arrays.values())])


def unpack(value) -> dict[str, np.ndarray]:
    view = memoryview(value)
    (n,) = struct.unpack_from("<I", view)
    at, out = 4 + n, {}
    for k, kind, size in json.loads(bytes(view[4:at])):
        dtype = np.dtype(kind)
        out[k] = np.frombuffer(view, dtype, size, at)
        at += size * dtype.itemsize
    return out


def binaries(column) -> list[memoryview]:
    """The values of a binary Arrow column without copies."""
    out = []
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        for i in range(len(chunk)):
            value = chunk[i].as_buffer()
            out.append(memoryview(value) if value is not None else memoryview(b""))
    return out


# ---- text columns as bytes and offsets


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8) if len(column) else np.zeros(0, np.uint8)
    return data, offsets


def slices(batches, columns: list[str], text: str = "text", size: int = SLICE_BYTES):
    """(other columns as lists of the slice, bytes, offsets from 0) for runs of rows of about `size` bytes of text."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
            last = min(last, batch.num_rows)
            yield [batch.column(batch.schema.get_field_index(c)).slice(first, last - first) for c in columns], data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            first = last
    trim()


_rng = np.random.default_rng(20240607)
BYTE_CODES = _rng.integers(0, 1 << 64, 256, dtype=U64)
_BASE = int(_rng.integers(0, 1 << 62)) * 4 + 1
GRAM_CODES = _rng.integers(0, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        step = np.full(size, _BASE % (1 << 64), U64)
        step[0] = 1
        down = np.full(size, pow(_BASE, -1, 1 << 64), U64)
        down[0] = 1
        _powers["up"], _powers["down"] = np.multiply.accumulate(step), np.multiply.accumulate(down)
    return _powers["up"][:n], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte after the last, first word of each text and one more) of runs of bytes other than 0x20 and 0x09 to 0x0D."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    space = SPACES[data]
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, space[:-1]
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, space[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = True
    after[inner - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit value for each word, equal for equal bytes."""
    out = np.empty(len(starts), U64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + SLICE_BYTES, "right")))
        a, b = starts[first], ends[last - 1]
        up, down = _power(b - a)
        total = np.zeros(b - a + 1, U64)
        np.cumsum(BYTE_CODES[data[a:b]] * up, out=total[1:])
        s, e = starts[first:last] - a, ends[first:last] - a
        out[first:last] = mix((total[e] - total[s]) * down[s] + (e - s).astype(U64))
        first = last
    return out


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit value for each run of n neighbours (len - n + 1 of them, none if shorter)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = np.zeros(m, U64)
    for k in range(n):
        out += hashes[k : k + m] * GRAM_CODES[k % 256] + U64(k // 256)
    return mix(out)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i], starts[i] + 1, ... (lengths[i] of them), one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return shift + np.arange(total)


def groups(keys: np.ndarray, n: int):
    """(order, bounds): order sorts keys 0..n-1 stably, bounds[k]:bounds[k+1] are those of key k."""
    order = np.argsort(keys, kind="stable")
    return order, np.searchsorted(keys[order], np.arange(n + 1))


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
if TaskContext.get() is not None:
    # in a worker, large arrays come from the system one by one and go back when they are freed, so that idle workers stay small
    getattr(ctypes.CDLL(None), "mallopt", lambda *_: 0)(-3, 4 << 20)
    pa.set_memory_pool(pa.system_memory_pool())
