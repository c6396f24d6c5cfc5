"""Token ids as binary shards with a minimal perfect hash index.

A shard is one file: magic, length of the header, header (JSON: sections with type and size, counts), then the sections:
- doc_id, null: the documents in payload order;
- words, ranks: the index, bit arrays over levels of ever fewer keys, and how many bits are set before each run of 512; the rank of a key's bit is its slot;
- prints, offsets, lengths: of each slot, the key's fingerprint, where its ids begin and how many they are;
- ids: raw ids, two bytes each where the vocabulary allows it, else four.
A key is a document's doc_id and its how-manieth row it is. A lookup reads the header once, then for each key a bit for each level it is tried on (1.1 on average, MOST_LEVELS at most), one run of 64 bytes, one rank, fingerprint, offset and length, and the ids themselves: a bounded number of bytes, however large the shard. The fingerprint tells keys that are not in the shard (but for one in 2**32).

Documents are dealt out by ranges of doc_id and written in ascending order; a manifest in the shared folder lists the shards of successful tasks with the doc_ids they hold, so a lost or repeated task leaves at most unlisted files. locate() finds the shards of any doc_ids by an equi join on aligned ranges of ids, lookup() reads their ids.

Defined cases: a null text is empty and has the end id only; a text of any length is encoded whole, and makes a shard larger than the others if need be; null doc_ids come last; rows with the same doc_id are ordered by a hash of their texts, then by the texts, and told apart by their number within their task's rows; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import U64, mix, partitions, shared_dir, slices, store_of, table, through_storage, trim
from ._tokens import encoder, splitter

END = 1
MAGIC = b"CVTOK01\n"
#: Bytes of ids in a shard, and distinct words that a worker remembers.
SHARD_BYTES, REMEMBERED = 24 << 20, 900_000
MOST_LEVELS = 40
MANIFEST = "part int, seq int, file string, docs long, ids long, low long, high long, number long, nulls boolean"
#: Bits of the index between two ranks.
RUN = 512


def key_of(doc_id: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The key of the number-th row (from 0) of a doc_id."""
    return mix(mix(doc_id.astype(np.int64).view(U64)) + number.astype(U64) * U64(0x9E3779B97F4A7C15))


def _spot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys ^ U64(0xA0761D6478BD642F * (level + 1) % (1 << 64))) % U64(size)).astype(np.int64)


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits of each level, all levels' bits) for distinct keys: each level keeps the keys that are alone on their bit."""
    sizes, words = [], []
    rest = keys
    for level in range(MOST_LEVELS):
        if not len(rest):
            break
        size = max(64, -(-int(len(rest) * 1.5) // 64) * 64)
        spot = _spot(rest, level, size)
        alone = np.bincount(spot, minlength=size)[spot] == 1
        bits = np.zeros(size, np.uint8)
        bits[spot[alone]] = 1
        sizes.append(size)
        words.append(np.packbits(bits))
        rest = rest[~alone]
    if len(rest):
        raise ValueError("keys are not distinct")
    return np.array(sizes, np.int64), np.concatenate(words) if words else np.zeros(0, np.uint8)


def ranks(words: np.ndarray) -> np.ndarray:
    """How many bits are set before each run of RUN bits."""
    n = -(-8 * len(words) // RUN)
    ones = np.bitwise_count(np.concatenate((words, np.zeros(n * RUN // 8 - len(words), np.uint8)))).reshape(n, RUN // 8).sum(axis=1)
    return (np.cumsum(ones) - ones).astype(np.uint32)


def slots(keys: np.ndarray, sizes, fetch) -> np.ndarray:
    """The slot of each key, -1 where no level has its bit. fetch(section, first, count) gives some of "words" or "ranks" for each of `first`, a row each."""
    out, base = np.full(len(keys), -1, np.int64), 0
    todo = np.arange(len(keys))
    for level, size in enumerate(sizes):
        if not len(todo):
            break
        spot = base + _spot(keys[todo], level, size)
        hit = fetch("words", spot >> 3, 1)[:, 0] >> (7 - (spot & 7)).astype(np.uint8) & 1 == 1
        at = spot[hit]
        # the bits of the run that come before the key's own
        run = fetch("words", at // RUN * (RUN // 8), RUN // 8)
        inside = np.clip((at % RUN)[:, None] - 8 * np.arange(RUN // 8), 0, 8).astype(np.uint8)
        before = np.bitwise_count(run & (0xFF00 >> inside.astype(np.uint16)).astype(np.uint8)).sum(axis=1)
        out[todo[hit]] = fetch("ranks", at // RUN, 1)[:, 0].astype(np.int64) + before
        todo = todo[~hit]
        base += size
    return out


def prints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys + U64(0xE7037ED1A0B428DB)) >> U64(32)).astype(np.uint32)


def shard_bytes(doc_id: np.ndarray, null: np.ndarray, number: np.ndarray, lengths: np.ndarray, ids: bytes, width: int) -> bytes:
    keys = key_of(*_plain(doc_id, null, number))
    sizes, words = build_index(keys)
    words = np.concatenate((words, np.zeros(-len(words) % (RUN // 8), np.uint8)))
    over = ranks(words)

    def fetch(name, first, count):
        return {"words": words, "ranks": over}[name][first[:, None] + np.arange(count)]

    by_slot = np.empty(len(keys), np.int64)
    by_slot[slots(keys, sizes.tolist(), fetch)] = np.arange(len(keys))
    offsets = (np.cumsum(lengths) - lengths)[by_slot]
    sections = {"doc_id": doc_id, "null": null.astype(np.uint8), "words": words, "ranks": over, "prints": prints(keys)[by_slot], "offsets": offsets.astype(np.uint64), "lengths": lengths[by_slot].astype(np.uint32), "ids": np.frombuffer(ids, f"<u{width}")}
    head = json.dumps({"docs": len(keys), "levels": sizes.tolist(), "first_number": int(number[0]) if len(number) else 0, "sections": [[k, v.dtype.str, len(v)] for k, v in sections.items()]}).encode()
    return b"".join([MAGIC, struct.pack("<Q", len(head)), head, *(np.ascontiguousarray(v).tobytes() for v in sections.values())])


def _plain(doc_id: np.ndarray, null: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What key_of takes for rows with and without a doc_id."""
    return np.where(null, np.iinfo(np.int64).min + 7, doc_id), number + null * (1 << 40)


class Shard:
    """Keyed access to a shard: only the parts of the file that a lookup needs are read."""

    def __init__(self, file):
        self.file = file
        start = file.read_at(len(MAGIC) + 8, 0)
        if bytes(start[: len(MAGIC)]) != MAGIC:
            raise ValueError("not a token shard")
        (size,) = struct.unpack_from("<Q", start, len(MAGIC))
        self.head = json.loads(bytes(file.read_at(size, len(MAGIC) + 8)))
        self.places, at = {}, len(MAGIC) + 8 + size
        for name, kind, n in self.head["sections"]:
            self.places[name] = (at, np.dtype(kind), n)
            at += n * np.dtype(kind).itemsize
        self.held: dict[str, np.ndarray] = {}

    def load(self, *names: str) -> None:
        """Reads whole sections, for many lookups."""
        for name in names:
            at, kind, n = self.places[name]
            self.held[name] = np.frombuffer(self.file.read_at(n * kind.itemsize, at), kind)

    def fetch(self, name: str, first: np.ndarray, count: int) -> np.ndarray:
        """`count` values of a section from each place on."""
        at, kind, _ = self.places[name]
        if name in self.held:
            return self.held[name][first[:, None] + np.arange(count)]
        parts = [np.frombuffer(self.file.read_at(count * kind.itemsize, at + int(f) * kind.itemsize), kind) for f in first]
        return np.stack(parts) if parts else np.zeros((0, count), kind)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offset, length) of each key's ids; length -1 for keys that are not here."""
        slot = slots(keys, self.head["levels"], self.fetch)
        ok = slot >= 0
        ok[ok] = self.fetch("prints", slot[ok], 1)[:, 0] == prints(keys[ok])
        offset, length = np.zeros(len(keys), np.int64), np.full(len(keys), -1, np.int64)
        offset[ok], length[ok] = self.fetch("offsets", slot[ok], 1)[:, 0], self.fetch("lengths", slot[ok], 1)[:, 0]
        return offset, length

    def ids(self, offset: int, length: int) -> np.ndarray:
        return self.fetch("ids", np.array([offset]), length)[0]

    def documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc_id, null, number) of all documents, in payload order."""
        self.load("doc_id", "null")
        d, z = self.held["doc_id"], self.held["null"].astype(bool)
        begin = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (z[1:] != z[:-1]))) if len(d) else np.zeros(0, np.int64)
        number = np.arange(len(d)) - np.repeat(begin, np.diff(np.append(begin, len(d))))
        return d, z, number + np.where(np.arange(len(d)) < (begin[1] if len(begin) > 1 else len(d)), self.head["first_number"], 0)


_known: dict[tuple[str, int], dict] = {}


def _encoded(path: str, width: int, text: str) -> bytes:
    known = _known.setdefault((path, width), {})
    found = splitter(path)(text)
    try:
        return b"".join(map(known.__getitem__, found))
    except KeyError:
        pass
    rest = list({w for w in found if w not in known})
    if len(known) + len(rest) > REMEMBERED:
        known.clear()
        rest = list(set(found))
    for w, ids in zip(rest, encoder(path)(rest), strict=True):
        known[w] = np.array(ids, f"<u{width}").tobytes()
    return b"".join(map(known.__getitem__, found))


def _writer(path: str, folder: str, width: int, end: int, most: int):
    def run(batches):
        store, base = store_of(folder)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        last = np.array([end], f"<u{width}").tobytes()
        seq, ids, doc, null, number, held = 0, [], [], [], [], 0
        before, times = object(), 0

        def flush():
            nonlocal seq, ids, doc, null, number, held
            d, z, k = np.array([x or 0 for x in doc], np.int64), np.array(null, bool), np.array(number, np.int64)
            lengths = np.array([len(x) // width for x in ids], np.int64)
            name = f"{part:06d}-{seq:05d}-{attempt}.tok"
            with store.open_output_stream(f"{base}/{name}") as out:
                out.write(shard_bytes(d, z, k, lengths, b"".join(ids), width))
            own = d[~z]
            ends = [pa.array([int(own[i]) if len(own) else None], pa.int64()) for i in (0, -1)]
            values = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([name]), pa.array([len(d)]), pa.array([int(lengths.sum())]), *ends, pa.array([int(k[0])]), pa.array([bool(z.any())])]
            batch = pa.RecordBatch.from_arrays(values, ["part", "seq", "file", "docs", "ids", "low", "high", "number", "nulls"])
            seq, ids, doc, null, number, held = seq + 1, [], [], [], [], 0
            return batch

        store.create_dir(base, recursive=True)
        for (own,), data, offsets in slices(batches, ["doc_id"]):
            raw, bounds = data.tobytes(), offsets.tolist()
            for k, d in enumerate(own.to_pylist()):
                ids.append(_encoded(path, width, raw[bounds[k] : bounds[k + 1]].decode()) + last)
                times = times + 1 if d == before else 0
                before = d
                doc.append(d)
                null.append(d is None)
                number.append(times)
                held += len(ids[-1])
                if held >= most:
                    yield flush()
        if ids:
            yield flush()

    return run


def write(docs: DataFrame, path: str, folder: str, end: int = END, shard_ids_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes shards of docs(doc_id, text) under folder (a URI that executors share) and returns their manifest, with `start`, the ids in all shards before."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    top = max([end, *spec["model"]["vocab"].values(), *(x["id"] for x in spec["added_tokens"])])
    width = 2 if top < 1 << 16 else 4
    n = partitions(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # the hash parts rows of one doc_id, or of none, that are too many for a task
    texts = texts.withColumn("hash", F.xxhash64("text"))
    ordered = texts.repartitionByRange(n, F.asc_nulls_last("doc_id"), "hash").sortWithinPartitions(F.asc_nulls_last("doc_id"), "hash", "text").drop("hash")
    manifest = through_storage(ordered.mapInArrow(_writer(path, folder, width, end, shard_ids_bytes), MANIFEST), "manifest")
    # sums of parts, of which there are as many as partitions, then of the shards of each part
    earlier = lambda w: F.coalesce(F.sum("ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("ids")).select("part", earlier(Window.orderBy("part")).alias("before"))
    inside = manifest.withColumn("within", earlier(Window.partitionBy("part").orderBy("seq")))
    return inside.join(parts, "part").withColumn("start", F.col("before") + F.col("within")).drop("before", "within")


def _open(folder: str):
    store, base = store_of(folder)
    return lambda file: store.open_input_file(f"{base}/{file}")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents: each one's key is looked up in the shard's index, and its ids are read where that says."""

    def run(batches):
        opened = _open(folder)
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with opened(file) as f:
                    shard = Shard(f)
                    doc_id, null, number = shard.documents()
                    shard.load("words", "ranks", "prints", "offsets", "lengths", "ids")
                    offset, length = shard.find(key_of(*_plain(doc_id, null, number)))
                    if (length < 0).any():
                        raise ValueError(f"{file}: a document is not in the index")
                    ids = shard.held["ids"]
                    sums = [zlib.crc32(ids[o : o + n].astype("<u4").tobytes()) for o, n in zip(offset.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_id, mask=null), pa.array(start + offset), pa.array(length), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
        trim()

    n = partitions(manifest.sparkSession)
    return manifest.select("file", "start").repartition(n, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _aligned(low: int, high: int):
    """The fewest (bits, number) whose ranges number << bits ... + (1 << bits) - 1 make up low ... high."""
    while low <= high:
        bits = 63 if low == 0 else (low & -low).bit_length() - 1
        while low + (1 << bits) - 1 > high:
            bits -= 1
        yield bits, low >> bits
        low += 1 << bits


def locate(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, file, number): the shards whose range holds each distinct doc_id of `wanted`, and the number from which its rows there may be counted."""

    def cells(batches):
        for b in batches:
            rows = [(f, bits, n, low, number) for f, low, high, number in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True) for bits, n in _aligned(low, high)]
            columns = zip(*rows, strict=True) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["file", "bits", "cell", "low", "number"])

    cell = through_storage(manifest.where("low IS NOT NULL").select("file", "low", "high", "number").mapInArrow(cells, "file string, bits int, cell long, low long, number long"), "cells")
    bits = sorted(r["bits"] for r in cell.select("bits").distinct().collect())  # 64 at most
    ids = wanted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    own = F.explode(F.array(*map(F.lit, bits)) if bits else F.array().cast("array<int>"))
    ids = ids.select("doc_id", own.alias("bits")).withColumn("cell", F.expr("shiftright(doc_id, bits)"))
    return ids.join(cell, ["bits", "cell"]).select("doc_id", "file", F.when(F.col("doc_id") == F.col("low"), F.col("number")).otherwise(0).cast("long").alias("number"))


def lookup(manifest: DataFrame, folder: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids array<int>) of the rows that the doc_ids of `wanted` have in the shards; of each shard only what the lookups need is read."""

    def run(batches):
        opened, shards = _open(folder), {}
        for b in batches:
            found = []
            for doc_id, file, number in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                if file not in shards:
                    for old in shards.values():
                        old.file.close()
                    shards = {file: Shard(opened(file))}
                while True:  # the rows of a doc_id are numbered one by one
                    offset, length = shards[file].find(key_of(np.array([doc_id]), np.array([number])))
                    if length[0] < 0:
                        break
                    found.append((doc_id, shards[file].ids(int(offset[0]), int(length[0])).astype(np.int32)))
                    number += 1
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return locate(manifest, wanted).sortWithinPartitions("file", "doc_id").mapInArrow(run, "doc_id long, ids array<int>")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_dir(spark, "tokens")
    return read(write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder), folder)
