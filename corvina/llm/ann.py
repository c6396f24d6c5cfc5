"""Approximate nearest neighbours by score-aware anisotropic quantisation.

Nearest by Euclidean distance is largest by q.x - |x|^2 / 2, an inner product with an exact addend. Vectors are grouped by leaf centres; what is left of each, by pairs of dimensions, is quantised to 16 codewords (four bits). Codes and codewords minimise |e|^2 + (eta - 1) (e . x/|x|)^2: the part of the error that is parallel to the vector counts eta times, as it is that part which shifts large inner products. A query's table of inner products with all codewords scores a leaf's codes; the best of each block are then ranked by exact distances on the original vectors.

With the quantisation error e of a vector and the leaf's centre c, the score's error is c.e, which is known, and (q - c).e, which is at most |q - c| |e|. All vectors of a block whose score could, within that bound, reach the k-th best exact one are ranked exactly too, in bounded pieces. So a block's nearest are the true ones, however many near copies share codes; only leaves that are not probed can hide neighbours.

Leaf centres and codewords come from a bounded sample (SAMPLE vectors, the smallest by a hash of vec_id); every vector is indexed. There are about as many leaves as the root of the number of rows (LEAST_LEAVES to MOST_LEAVES). How many of them a query probes is measured: sample vectors look for their nearest among the sample, and as many leaves are probed as hold RECALL of these (the corpus is denser than the sample, so its neighbours lie closer and are held by fewer leaves). Vectors without structure need most leaves, clustered ones few.

Leaves with many vectors are split into blocks, and a leaf's queries into runs of QUERIES, so neither a vector that a third of the rows repeat nor a leaf that every query probes fills one task. Ties go to the smaller vec_id, also where candidates are cut off.

Defined cases: repeated rows count once; of rows with one vec_id and different vectors the smallest (component by component) is the query, and each is a candidate, but a vec_id is named once, with its nearest; vectors of any finite length of components take part, as all sums are in doubles; vectors that are null, zero, of another length than the most frequent one (the smaller of two alike), or hold null or non-finite components take no part, neither as queries nor as candidates; null vec_ids take no part; rows with the query's vec_id are never its neighbours; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _chunks as ck
from ._common import binaries, bounded_batches, table, through_storage

SAMPLE, LEAST_LEAVES, MOST_LEAVES, CODES, ETA, SWEEPS = 16_384, 16, 1024, 16, 4.0, 3
#: Share of the sample's nearest that probed leaves must hold; sample vectors that look for theirs.
RECALL, ASKED = 0.97, 512
#: First candidates of a query in a block, which set the distance to beat; vectors in a block; vectors compared exactly at once.
RERANK, BLOCK, PIECE = 16, 16_384, 2_048
#: Queries that one task compares with a block.
QUERIES = 4_096
#: Rounding of a score in doubles, relative to the squared lengths that it is made of.
ROUNDING = 1e-11


def valid(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """(rows(vec_id, embedding array<float>) that take part, their length, how many there are)"""
    fine = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = fine.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(finite & F.exists("embedding", lambda x: x != 0))
    first = fine.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = first["dim"] if first else 0
    return fine.where(F.size("embedding") == dim), dim, first["count"] if first else 0


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1)


def _centres(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        of = _nearest(x, c)
        total, n = np.zeros_like(c), np.bincount(of, minlength=len(c))
        np.add.at(total, of, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


class Model:
    """Leaf centres and codewords."""

    def __init__(self, x: np.ndarray, leaves: int, eta: float = ETA, seed: int = 3):
        self.dim, self.eta = x.shape[1], eta
        self.pairs = -(-self.dim // 2)
        self.centres = _centres(x, leaves, 10, seed)
        leaf = _nearest(x, self.centres)
        left = self._split(x - self.centres[leaf])
        unit = self._split(x / np.linalg.norm(x, axis=1, keepdims=True))
        self.words = np.stack([np.resize(_centres(left[:, m], CODES, 8, seed + m), (CODES, 2)) for m in range(self.pairs)])
        for _ in range(4):
            codes = self._codes(left, unit)
            self._update(left, unit, codes)

    def _split(self, x: np.ndarray) -> np.ndarray:
        if x.shape[1] % 2:
            x = np.concatenate((x, np.zeros((len(x), 1), x.dtype)), axis=1)
        return x.reshape(len(x), -1, 2)

    def _codes(self, left: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Codes by coordinate descent on the anisotropic loss."""
        n = len(left)
        codes = np.stack([_nearest(left[:, m], self.words[m]) for m in range(self.pairs)], axis=1)
        error = left - self.words[np.arange(self.pairs), codes]
        parallel = (error * unit).sum(axis=(1, 2))
        for _ in range(SWEEPS):
            for m in range(self.pairs):
                e = left[:, m, None] - self.words[m]
                along = (e * unit[:, m, None]).sum(axis=2)
                rest = parallel - (error[:, m] * unit[:, m]).sum(axis=1)
                best = np.argmin((e**2).sum(axis=2) + (self.eta - 1) * (rest[:, None] + along) ** 2, axis=1)
                codes[:, m], error[:, m] = best, e[np.arange(n), best]
                parallel = rest + along[np.arange(n), best]
        return codes.astype(np.uint8)

    def _update(self, left: np.ndarray, unit: np.ndarray, codes: np.ndarray) -> None:
        """The codewords that minimise the loss for given codes: one small linear system each."""
        error = left - self.words[np.arange(self.pairs), codes]
        along = (error * unit).sum(axis=2)
        rest = along.sum(axis=1)[:, None] - along
        for m in range(self.pairs):
            u, x = unit[:, m].astype(np.float64), left[:, m].astype(np.float64)
            push = x + (self.eta - 1) * (rest[:, m] + (x * u).sum(axis=1))[:, None] * u
            for j in range(CODES):
                own = codes[:, m] == j
                if own.any():
                    a = own.sum() * np.eye(2) + (self.eta - 1) * u[own].T @ u[own]
                    self.words[m, j] = np.linalg.solve(a, push[own].sum(axis=0))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, codes: two of four bits in a byte)"""
        leaf = _nearest(x, self.centres)
        codes = self._codes(self._split(x - self.centres[leaf]), self._split(x / np.linalg.norm(x, axis=1, keepdims=True)))
        if codes.shape[1] % 2:
            codes = np.concatenate((codes, np.zeros((len(codes), 1), np.uint8)), axis=1)
        return leaf, codes[:, ::2] << 4 | codes[:, 1::2]

    def decode(self, leaf: int, codes: np.ndarray) -> np.ndarray:
        """The vectors that rows of bytes of codes stand for, in doubles."""
        each = np.stack((codes >> 4, codes & 15), axis=2).reshape(len(codes), -1)[:, : self.pairs]
        return self.centres[leaf].astype(np.float64) + self.words[np.arange(self.pairs), each].astype(np.float64).reshape(len(codes), -1)[:, : self.dim]

    def probes(self, q: np.ndarray, most: int) -> np.ndarray:
        return np.argsort(-(q @ self.centres.T - 0.5 * (self.centres**2).sum(axis=1)), axis=1, kind="stable")[:, :most]

    def wanted(self, x: np.ndarray, k: int, recall: float = RECALL, asked: int = ASKED, seed: int = 4) -> int:
        """How many leaves hold `recall` of the k nearest of vectors of x among x."""
        own = np.random.default_rng(seed).choice(len(x), min(asked, len(x)), replace=False)
        leaf = _nearest(x, self.centres)
        place = np.argsort(self.probes(x[own], len(self.centres)), axis=1)  # of each leaf in the order of a query's probes
        half = 0.5 * (x**2).sum(axis=1)
        near = []
        for row, i in enumerate(own.tolist()):
            score = x @ x[i] - half
            score[i] = -np.inf
            top = np.argpartition(-score, min(k, len(x) - 1) - 1)[:k] if len(x) > 1 else np.zeros(0, np.int64)
            near.append(place[row, leaf[top]])
        near = np.sort(np.concatenate(near))
        return 1 + int(near[min(len(near) - 1, int(np.ceil(recall * len(near))))]) if len(near) else 1

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For one query, the inner product of each byte of two codes: (bytes, 256)."""
        each = (self.words * self._split(q[None])[0][:, None]).sum(axis=2)
        if len(each) % 2:
            each = np.concatenate((each, np.zeros((1, CODES), each.dtype)))
        return (each[::2, :, None] + each[1::2, None, :]).reshape(-1, 256)


def _distinct(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The places of distinct rows (id, vector), by id."""
    order = np.lexsort((*x.T[::-1], ids))
    i, v = ids[order], x[order]
    return order[np.append(True, (i[1:] != i[:-1]) | (v[1:] != v[:-1]).any(axis=1))]


def _distances(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact distances of the rows of x to v, a piece at a time."""
    return np.concatenate([np.sqrt(((x[a : a + PIECE].astype(np.float64) - v) ** 2).sum(axis=1)) for a in range(0, len(x), PIECE)] or [np.zeros(0)])


def _search_block(model: Model, found: dict, q_ids: np.ndarray, q: np.ndarray, k: int, rerank: int):
    """The k nearest of each query among the vectors of one block: scan of codes, exact distances of the best and of all that could be as near."""
    ids, x, codes, leaf = found["ids"], found["x"].reshape(-1, model.dim), found["codes"].reshape(len(found["ids"]), -1), int(found["leaf"][0])
    order = _distinct(ids, x)
    ids, x, codes = ids[order], x[order], codes[order]
    asked, k = k, k * int(np.diff(np.append(ck.runs(ids), len(ids))).max())  # rows that hold the k nearest vec_ids
    centre, half, error, shift = model.centres[leaf].astype(np.float64), np.empty(len(ids)), np.empty(len(ids)), np.empty(len(ids))
    for a in range(0, len(ids), PIECE):
        own = slice(a, a + PIECE)
        y = x[own].astype(np.float64)
        half[own] = 0.5 * (y**2).sum(axis=1)
        e = y - model.decode(leaf, codes[own])
        error[own], shift[own] = np.sqrt((e**2).sum(axis=1)), e @ centre
    codes = np.ascontiguousarray(codes.T)
    length = np.sqrt(2 * half) + error + np.linalg.norm(centre)
    out = []
    for qid, v in zip(q_ids.tolist(), q.astype(np.float64), strict=True):
        t = model.tables(v)
        approx = float(v @ centre) + shift - half
        for b in range(len(t)):
            approx += t[b][codes[b]]
        approx[ids == qid] = -np.inf
        if len(ids) > max(rerank, k):
            first = np.argpartition(approx, -max(rerank, k))[-max(rerank, k) :]
            first = first[np.isfinite(approx[first])]
            d = np.sort(_distances(x[first], v))
            bound = np.linalg.norm(v - centre) * error + ROUNDING * (np.linalg.norm(v) + length) ** 2
            pick = np.flatnonzero(approx + bound >= 0.5 * (v @ v - d[k - 1] ** 2)) if len(d) >= k else np.arange(len(ids))
        else:
            pick = np.arange(len(ids))
        pick = pick[np.isfinite(approx[pick])]
        d = np.concatenate([_distances(x[pick[a : a + PIECE]], v) for a in range(0, len(pick), PIECE)] or [np.zeros(0)])
        best = np.lexsort((ids[pick], d))
        best = best[np.sort(np.unique(ids[pick][best], return_index=True)[1])][:asked]
        out.append((np.full(len(best), qid), ids[pick][best], d[best]))
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def search(rows: DataFrame, every: int, k: int = 10, probes: int | None = None, leaves: int | None = None, rerank: int = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each vec_id that is divisible by `every`."""
    spark = rows.sparkSession
    bounded_batches(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    rows, dim, count = valid(rows)
    if not dim:
        return spark.createDataFrame([], schema)
    sample = matrix(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow().column("embedding"))
    model = Model(sample, leaves or min(MOST_LEAVES, max(LEAST_LEAVES, round(count**0.5))))
    probes = probes or model.wanted(sample, k)
    del sample

    def leaf_of(batches):
        for b in batches:
            if b.num_rows:
                b = b.take(pa.array(np.sort(_distinct(b.column(0).to_numpy(), matrix(b.column(1))))))
                leaf, codes = model.encode(matrix(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaf, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], ["vec_id", "embedding", "leaf", "codes"])

    coded = rows.mapInArrow(leaf_of, "vec_id long, embedding array<float>, leaf int, codes binary")

    def leaf_only(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_nearest(matrix(b.column(1)), model.centres), pa.int32())], ["leaf"])

    def probe(batches):
        for b in batches:
            if b.num_rows:
                q = model.probes(matrix(b.column(1)), probes)
                at = np.repeat(np.arange(b.num_rows), q.shape[1])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(q.reshape(-1), pa.int32())], ["vec_id", "embedding", "leaf"])

    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = through_storage(queries.mapInArrow(probe, "vec_id long, embedding array<float>, leaf int"), "ann-queries")
    # two counts a leaf: numbers of rows that the model bounds
    blocks = {r["leaf"]: -(-r["count"] // BLOCK) for r in rows.mapInArrow(leaf_only, "leaf int").groupBy("leaf").count().collect()}
    turns = {r["leaf"]: -(-r["count"] // QUERIES) for r in asked.groupBy("leaf").count().collect()}
    if not turns:
        return spark.createDataFrame([], schema)
    of = lambda counts: F.create_map(*[F.lit(x) for pair in counts.items() for x in pair])[F.col("leaf")]
    every_of = lambda n: F.explode(F.sequence(F.lit(0), n.cast("int") - 1))
    own_of = lambda n: F.pmod(F.xxhash64("vec_id"), n).cast("int")
    coded = coded.where(F.col("leaf").isin(list(turns))).withColumns({"block": own_of(of(blocks)), "turn": every_of(of(turns))})
    asked = asked.where(F.col("leaf").isin(list(blocks))).withColumns({"block": every_of(of(blocks)), "turn": own_of(of(turns))})

    def run(x: pa.Table, q: pa.Table) -> pa.Table:
        empty = pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["query_id", "vec_id", "score"])
        if not x.num_rows or not q.num_rows:
            return empty
        found = {"ids": x.column("vec_id").to_numpy(), "x": matrix(x.column("embedding")), "codes": np.frombuffer(b"".join(binaries(x.column("codes"))), np.uint8), "leaf": x.column("leaf").to_numpy()}
        ids, q_ids, score = _search_block(model, found, q.column("vec_id").to_numpy(), matrix(q.column("embedding")), k, rerank)
        return pa.table([pa.array(ids), pa.array(q_ids), pa.array(score)], ["query_id", "vec_id", "score"])

    on = ["leaf", "block", "turn"]
    near = coded.groupBy(*on).cogroup(asked.groupBy(*on)).applyInArrow(run, "query_id long, vec_id long, score double")
    near = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), 100)
