"""A quality classifier by attention-based multiple-instance learning.

A text is a bag of passages of PASSAGE bytes. Each passage becomes counts of hashed pairs of bytes and a few shares of byte classes; a learned layer encodes it. Gated attention weighs the passages, and the weighted sum is scored. Only labels of whole documents are used to learn the encoder, the gates and the score.

Training reads a bounded sample of labelled rows: at most SAMPLE of each label, the smallest by a hash of doc_id, whatever the length of their texts; a text of more than MOST passages trains with MOST of them, evenly spaced over all of it. Weights restore the shares of the labels. The sample's features reach the driver, the fit has a fixed number of steps, and every text of the corpus is then scored whole, without a shuffle.

Defined cases: a null text is empty: one empty passage, with a score; null and repeated doc_ids are kept row for row; a doc_id that is repeated in docs trains with the smallest of its texts, one that has both labels does not train; a text of any length is scored by all its passages; ties of the hash go to the smaller doc_id; unlabelled rows are scored like others; with fewer than two labels in the sample the score is the share of label 1 (0.5 without labels); other columns are never inputs; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._chunks import texts_of
from ._common import SPACES, bounded_batches, filtered, pack, slices, table, trim, unpack

PASSAGE, BINS, HIDDEN = 512, 256, 32
SAMPLE, MOST, STEPS, THRESHOLD = 2500, 128, 600, 0.7
_BLOCK = 1 << 20
_PAIR = np.random.default_rng(77).integers(0, BINS, 1 << 16, dtype=np.int64)
_CLASS = np.full(256, 7)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[ord(c) for c in ".,;:'\"-?()"]] = 3
_CLASS[SPACES] = 4
_CLASS[ord("\n")] = 5
_CLASS[128:] = 6
FEATURES = BINS + 8 + 2


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, first passage of each text and one more)"""
    sizes = np.diff(offsets)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    first = np.concatenate(([0], np.cumsum(counts)))
    doc = np.repeat(np.arange(len(sizes)), counts)
    begin = offsets[doc] + (np.arange(first[-1]) - first[doc]) * PASSAGE
    end = np.minimum(begin + PASSAGE, offsets[doc + 1])
    out = np.zeros((first[-1], FEATURES), np.float32)
    a = 0
    while a < first[-1]:
        b = max(a + 1, int(np.searchsorted(end, begin[a] + _BLOCK, "right")))
        part = data[begin[a] : end[b - 1]]
        length = (end - begin)[a:b]
        if len(part):
            of = np.repeat(np.arange(b - a), length)
            pair = part[:-1].astype(np.int64) << 8 | part[1:]
            inner = of[:-1] == of[1:]
            bins = np.bincount((of[:-1] * BINS + _PAIR[pair])[inner], minlength=(b - a) * BINS).reshape(b - a, BINS)
            shares = np.bincount(of * 8 + _CLASS[part], minlength=(b - a) * 8).reshape(b - a, 8)
            size = np.maximum(length, 1)[:, None]
            out[a:b, :BINS] = np.sqrt(bins / size) * 4
            out[a:b, BINS : BINS + 8] = shares / size * 4
            out[a:b, BINS + 8] = (bins > 0).sum(axis=1) / np.minimum(np.maximum(length, 1), BINS)
        out[a:b, BINS + 9] = length / PASSAGE
        a = b
    return out, first


def start(seed: int = 5) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    n = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s)
    return {"W": n(FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": n(HIDDEN, HIDDEN), "U": n(HIDDEN, HIDDEN), "w": n(HIDDEN, 1)[:, 0], "c": n(HIDDEN, 1)[:, 0], "d": np.zeros(1)}


def forward(p: dict, x: np.ndarray, first: np.ndarray) -> dict:
    """Scores of bags of passages x[first[i]:first[i + 1]], with what the gradient needs."""
    h = np.tanh(x @ p["W"] + p["b"])
    t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
    e = (t * g) @ p["w"]
    bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
    e = np.exp(e - np.maximum.reduceat(e, first[:-1])[bag])
    a = e / np.add.reduceat(e, first[:-1])[bag]
    z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "bag": bag, "score": 1 / (1 + np.exp(-(z @ p["c"] + p["d"])))}


def gradient(p: dict, x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    f = forward(p, x, first)
    ds = (f["score"] - y) * weight / weight.sum()
    dz = ds[:, None] * p["c"]
    da = (dz[f["bag"]] * f["h"]).sum(axis=1)
    de = f["a"] * (da - np.add.reduceat(f["a"] * da, first[:-1])[f["bag"]])
    dt, dg = de[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
    dh = (f["a"][:, None] * dz[f["bag"]] + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
    return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ ds, "d": np.array([ds.sum()])}


def fit(bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray, steps: int = STEPS, batch: int = 64, seed: int = 6) -> dict:
    """The parameters after `steps` steps of Adam over bags of passages."""
    p, r = start(), np.random.default_rng(seed)
    m, v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    for step in range(1, steps + 1):
        pick = r.integers(0, len(bags), min(batch, len(bags)))
        x = np.concatenate([bags[i] for i in pick]).astype(np.float64)
        first = np.concatenate(([0], np.cumsum([len(bags[i]) for i in pick])))
        rate = 0.01 * (1 - 0.9 * step / steps)
        for k, dx in gradient(p, x, first, y[pick], weight[pick]).items():
            dx = dx + 1e-4 * p[k] * (k in "WVU")
            m[k], v[k] = 0.9 * m[k] + 0.1 * dx, 0.999 * v[k] + 0.001 * dx**2
            p[k] = p[k] - rate * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return p


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, steps: int = STEPS) -> dict | float:
    """Parameters from labels(doc_id, quality) whose doc_id is not held out; a constant score where there is nothing to tell apart."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out(F.col("doc_id")))
    labels = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("top")).where("quality = top").drop("top")
    total = {r["quality"]: r["n"] for r in labels.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        return float(next(iter(total), 0.5))
    one = labels.where("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    zero = labels.where("quality = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most 2 * sample rows
    picked = F.broadcast(one.unionByName(zero))
    texts = texts_of(docs).join(picked, "doc_id").groupBy("doc_id", "quality").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def run(batches):
        for (ids, quality), data, offsets in slices(batches, ["doc_id", "quality"]):
            x, first = passages(data, offsets)
            each = [np.unique(np.linspace(a, b - 1, min(b - a, MOST)).astype(np.int64)) for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([ids, quality, pa.array([pack(x=x[at].astype(np.float16).reshape(-1)) for at in each], pa.binary())], ["doc_id", "quality", "x"])

    rows = texts.mapInArrow(run, "doc_id long, quality int, x binary").toArrow().sort_by("doc_id")
    y = rows.column("quality").to_numpy().astype(np.float64)
    if len(set(y)) < 2:
        return float(total.get(1, 0) / sum(total.values()))
    bags = [unpack(v)["x"].reshape(-1, FEATURES) for v in rows.column("x").to_pylist()]
    weight = np.where(y == 1, total[1] / max(1, (y == 1).sum()), total[0] / max(1, (y == 0).sum()))
    model = fit(bags, y, weight / weight.mean(), steps)
    del rows, bags
    trim()
    return model


def score(docs: DataFrame, model: dict | float, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs(doc_id, text)."""

    def run(batches):
        for (ids,), data, offsets in slices(batches, ["doc_id"]):
            s = scores(model, data, offsets)
            yield pa.RecordBatch.from_arrays([ids, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = texts_of(docs).mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def keep(docs: DataFrame, model: dict | float, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose `text` scores `threshold` or more, with all their columns."""
    bounded_batches(docs.sparkSession)

    return filtered(docs, lambda batch: np.concatenate([scores(model, data, offsets) for _, data, offsets in slices([batch], [])]) >= threshold)


def scores(model: dict | float, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    if isinstance(model, float):
        return np.full(len(offsets) - 1, model)
    x, first = passages(data, offsets)
    return np.concatenate([_scored(model, x, first, a) for a in range(0, len(first) - 1, 256)])


def _scored(model: dict, x: np.ndarray, first: np.ndarray, a: int) -> np.ndarray:
    own = first[a : a + 257]
    return forward(model, x[own[0] : own[-1]], own - own[0])["score"]


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
