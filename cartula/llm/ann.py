"""Exact nearest neighbours by a block matrix join.

Query rows are cut into blocks of bounded bytes. A block is sent to all executors, where the
candidates stream past it in pieces; a part of a block and a piece of candidates are one
tile. In a tile, unit vectors quantised to 8 bits are multiplied as matrices; their products
are whole numbers, which floats hold exactly as dimensions are taken by the thousand. The
norms of the quantisation errors bound how far each product is from the cosine; pairs whose
upper bound falls below the k-th best lower bound are out, the others are computed from the
original vectors in double precision, and heaps keep the k best, over the pieces of a
partition first and over partitions then. Candidates are never copied or shuffled for it; a
further block is a further pass over them.

Defined results: rows with a null id or a vector that is null, empty, zero or has null or
non-finite components take no part; of rows that repeat an id the one with the smallest
vector counts; vectors of different lengths are not compared; with fewer than k
candidates all are returned; ties go to the smaller id; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartula.llm.common import checkpoint, small_batches

K, EVERY = 5, 50
#: Bytes of the vectors of a query block; queries and candidates of a tile; dimensions multiplied at once (127 ** 2 times that is under 2 ** 24).
QUERY_BYTES, QUERIES, PIECE, DIMS = 32 << 20, 1024, 2048, 1024


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(~bad & F.exists("v", lambda x: x != 0.0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def quantised(x: np.ndarray):
    """Numbers of 8 bits, their scale, and the norm of the error, of unit vectors."""
    scale = np.abs(x).max(axis=1, keepdims=True) / 127
    q = np.rint(x / scale)
    return q.astype(np.int8), scale[:, 0], np.linalg.norm(x - q * scale, axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of rows of 8-bit numbers."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], DIMS):
        out += a[:, at : at + DIMS].astype(np.float32) @ b[:, at : at + DIMS].astype(np.float32).T
    return out


class Block:
    """A block of queries and the heaps of their k best so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int = K):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.norm = np.linalg.norm(vectors, axis=1)
        self.unit = quantised(vectors / self.norm[:, None])
        #: Of each query (-score, id); the first is the worst kept: least score, then largest id.
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in ids]

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        norm = np.linalg.norm(vectors, axis=1)
        unit = quantised(vectors / norm[:, None])
        for at in range(0, len(self.ids), QUERIES):
            self._tile(slice(at, at + QUERIES), ids, vectors, norm, unit)

    def _tile(self, part: slice, ids, vectors, norm, unit) -> None:
        k, heaps = self.k, self.heaps[part]
        (q, q_scale, q_err), (c, c_scale, c_err) = (tuple(x[part] for x in self.unit), unit)
        near = products(q, c) * (q_scale[:, None] * c_scale[None, :])
        slack = q_err[:, None] + (1 + q_err[:, None]) * c_err[None, :] + 1e-9
        near[self.ids[part][:, None] == ids[None, :]] = -np.inf
        low = near - slack
        best = np.partition(low, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(q), -np.inf)
        bar = np.array([max(b, -h[0][0] - 1e-9) if len(h) == k else b for b, h in zip(best, heaps)])
        rows, cols = np.nonzero((near + slack >= bar[:, None]) & np.isfinite(near))
        cuts = np.searchsorted(rows, np.arange(len(q) + 1))
        for r in np.unique(rows).tolist():
            pick = cols[cuts[r] : cuts[r + 1]]
            score = (vectors[pick] * self.vectors[part][r]).sum(axis=1) / (norm[pick] * self.norm[part][r])
            merged = [*heaps[r], *zip((-score).tolist(), ids[pick].tolist())]
            self.heaps[part.start + r] = sorted(heapq.nsmallest(k, merged), reverse=True)

    def found(self) -> list[tuple[int, int, float]]:
        return [(int(i), int(c), -s) for i, h in zip(self.ids, self.heaps) for s, c in h]


_FOUND = "query_id long, vec_id long, score double"


def _stream(shared, dim: int, k: int):
    """Reads candidates (vec_id, v); gives the k best of the partition for each query of the block."""

    def run(batches):
        block, held, n = Block(*shared.value, k), [], 0
        for b in batches:
            held.append((np.asarray(b.column(0)), np.asarray(b.column(1).flatten(), np.float64).reshape(-1, dim)))
            n += b.num_rows
            if n >= PIECE:
                block.meet(*map(np.concatenate, zip(*held)))
                held, n = [], 0
        if n:
            block.meet(*map(np.concatenate, zip(*held)))
        a, c, s = zip(*got) if (got := block.found()) else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

    return run


def search(queries: DataFrame, candidates: DataFrame, k: int = K, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of candidates for each of queries (both vec_id, v).

    One pass over the candidates for each block of queries, whose size in bytes is bounded; what is
    sent back of a partition is k rows a query. A block's result is written before the next starts.
    """
    spark = queries.sparkSession
    small_batches(spark)
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    sizes = queries.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy("dim").collect()  # a row for each length
    for dim, n in sizes:
        blocks = -(-n * dim * 8 // query_bytes)
        for b in range(blocks):
            own = queries.where((F.size("v") == dim) & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)).select("vec_id", "v").toArrow()
            if not own.num_rows:
                continue
            matrix = np.asarray(own.column("v").combine_chunks().flatten(), np.float64).reshape(-1, dim)
            shared = spark.sparkContext.broadcast((np.asarray(own.column("vec_id")), matrix))
            found = candidates.where(F.size("v") == dim).select("vec_id", "v").mapInArrow(_stream(shared, dim, k), _FOUND)
            top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
            out = out.unionByName(checkpoint(top))
            shared.unpersist()
    return out


def digest(vectors: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    rows = checkpoint(usable(vectors))
    return search(rows.where(F.col("vec_id") % every == 0), rows, k)
