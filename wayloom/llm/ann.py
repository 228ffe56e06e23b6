"""Nearest neighbours by randomly rotated one-bit codes.

Every vector is centred, rotated at random and kept as the signs of its coordinates, packed into bits, with two correction scalars: its
distance from the centre and the inner product of the normed vector with its code. From the packed bits (and a query rounded to a few bit
planes) an inner product is estimated by counting bits; with the scalars this gives an estimate of the distance and a bound of its
error. Candidates whose lower bound is under the k-th least upper bound are reranked with the original vectors, in double precision.

Queries are a stated set, worked on in blocks: a block of ``block`` queries is broadcast (so its size is fixed), the codes are scanned, and
each task returns its own k best of each query, of which the k best of all are taken. The whole index is scanned, so nothing is
missed but what an error bound misses.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.shared import written

K = 10
BLOCK = 8192
#: Error bounds hold for a share of about 1 - exp(-EPSILON**2 / 2) of the vectors each.
EPSILON = 3.5
PLANES = 8
SEED = 97
CHUNK = 2048
QUERY_CHUNK = 256


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix of the next multiple of 64 dimensions; only its first ``dim`` columns are needed."""
    size = -(-dim // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return (q * np.sign(np.diag(r)))[:, :dim]


def pack(signs: np.ndarray) -> np.ndarray:
    """Rows of booleans to rows of 64-bit words."""
    return np.packbits(signs, axis=1, bitorder="little").view("<u8")


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def encoded(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes, distances from the centre, and inner products of the normed vectors with their codes."""
    y = (x - centre) @ turn.T
    norm = np.linalg.norm(y, axis=1)
    signs = y >= 0
    code = np.where(signs, 1.0, -1.0) / np.sqrt(y.shape[1])
    return pack(signs), norm, (y * code).sum(axis=1) / np.where(norm > 0, norm, 1)


class Queries:
    """A block of queries, rotated and rounded to bit planes."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, centre: np.ndarray, turn: np.ndarray, planes: int = PLANES):
        self.ids, self.x = ids, x
        y = (x - centre) @ turn.T
        self.norm = np.linalg.norm(y, axis=1)
        y /= np.where(self.norm > 0, self.norm, 1)[:, None]
        self.low = y.min(axis=1)
        self.step = np.maximum((y.max(axis=1) - self.low) / ((1 << planes) - 1), 1e-12)
        level = np.rint((y - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        self.total = level.sum(axis=1)
        self.planes = [pack((level >> p) & 1 == 1) for p in range(planes)]
        self.size = y.shape[1]
        #: what rounding can change in an inner product with a unit vector
        self.rounding = self.step / 2 * np.sqrt(self.size)

    def part(self, at: slice) -> Queries:
        out = object.__new__(Queries)
        out.__dict__ = {k: v[at] if isinstance(v, np.ndarray) else v for k, v in self.__dict__.items()}
        out.planes = [p[at] for p in self.planes]
        return out

    def distances(self, code: np.ndarray, norm: np.ndarray, own: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
        """Bounds (low, high) of the squared distances, query x vector."""
        ones = np.zeros((len(self.ids), len(code)), np.int64)
        for p, plane in enumerate(self.planes):
            for w in range(code.shape[1]):
                ones += np.bitwise_count(plane[:, w, None] & code[None, :, w]).astype(np.int64) << p
        set_bits = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
        # <query, code>, where the code is (2 x bit - 1) / sqrt(size) and the query low + step x level
        product = (2 * (self.low[:, None] * set_bits + self.step[:, None] * ones) - (self.low * self.size + self.step * self.total)[:, None]) / np.sqrt(self.size)
        safe = np.maximum(own, 1e-6)
        cosine = product / safe
        slack = epsilon * np.sqrt(np.maximum(1 - safe**2, 0)) / (safe * np.sqrt(max(1, self.size - 1))) + self.rounding[:, None] / safe
        square = norm[None] ** 2 + self.norm[:, None] ** 2
        scale = 2 * norm[None] * self.norm[:, None]
        return square - scale * np.minimum(cosine + slack, 1), square - scale * np.maximum(cosine - slack, -1)


def usable(embedding: Column, dim: int) -> Column:
    """Vectors of ``dim`` finite components that aren't all zero."""
    x = embedding.cast("array<double>")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.coalesce((F.size(x) == dim) & F.forall(x, finite) & F.exists(x, lambda v: v != 0), F.lit(False))


def dimension(vectors: DataFrame) -> int:
    """The most frequent length of the embeddings (ties: the larger); 0 for none."""
    top = vectors.filter("embedding IS NOT NULL").groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return top.d if top else 0


def nearest(vectors: DataFrame, is_query: Column, k: int = K, block: int = BLOCK, epsilon: float = EPSILON) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest other rows of every query row, by Euclidean distance.

    ``vectors``: vec_id, embedding; other columns are ignored. Vectors that are null, zero, not of the most frequent dimension, or hold null or
    non-finite components take no part. Ties go to the smaller vec_id. Rows that share an id are all candidates, except of queries with that id;
    rows with a null id take no part. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    dim = dimension(vectors)
    rows = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("is_query"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"), dim))
    result = "query_id bigint, vec_id bigint, score double"
    if not dim:
        return spark.createDataFrame([], result).selectExpr("query_id", "1 AS rank", "vec_id", "score").limit(0)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dim), 0
        for b in batches:
            if b.num_rows:
                total += matrix(b.column("embedding")).sum(axis=0)
                n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([n], pa.int64())], names=["s", "n"])

    sums = rows.select("embedding").mapInArrow(summed, "s array<double>, n bigint")
    mean = sums.agg(*[F.sum(F.col("s")[i]).alias(f"c{i}") for i in range(dim)], F.sum("n").alias("n")).first()
    count = mean["n"] or 0
    centre = np.array([(mean[f"c{i}"] or 0.0) / max(1, count) for i in range(dim)])
    turn = rotation(dim)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                code, norm, own = encoded(matrix(b.column("embedding")), centre, turn)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(norm), pa.array(own)], names=[*b.schema.names, "code", "norm", "own"])

    index = written(rows.mapInArrow(coded, "vec_id bigint, embedding array<double>, is_query boolean, code binary, norm double, own double"), "codes")
    queries = index.filter("is_query").select("vec_id", "embedding")
    n_blocks = max(1, -(-queries.count() // block))
    parts = []
    for i in range(n_blocks):
        own_part = queries if n_blocks == 1 else queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == i)
        table = own_part.toArrow()
        if not table.num_rows:
            continue
        ids = table.column("vec_id").to_numpy()
        x = matrix(table.column("embedding").combine_chunks())
        sent = spark.sparkContext.broadcast(Queries(ids, x, centre, turn))

        def searched(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            q = sent.value
            n = len(q.ids)
            best = np.full((n, k), np.inf)
            best_id = np.full((n, k), np.iinfo(np.int64).max)
            for whole in batches:
                for at in range(0, whole.num_rows, CHUNK):
                    b = whole.slice(at, CHUNK)
                    v_ids = b.column("vec_id").to_numpy()
                    v = matrix(b.column("embedding"))
                    code = np.frombuffer(b"".join(b.column("code").to_pylist()), "<u8").reshape(len(v_ids), -1)
                    norm, own = b.column("norm").to_numpy(), b.column("own").to_numpy()
                    for lo in range(0, n, QUERY_CHUNK):
                        part = slice(lo, min(n, lo + QUERY_CHUNK))
                        qp = q.part(part)
                        low, high = qp.distances(code, norm, own, epsilon)
                        same = qp.ids[:, None] == v_ids[None]
                        high[same] = np.inf
                        limit = best[part, -1] ** 2
                        if high.shape[1] >= k:
                            limit = np.minimum(limit, np.partition(high, k - 1, axis=1)[:, k - 1])
                        qi, vi = np.nonzero((low <= limit[:, None] * (1 + 1e-9) + 1e-12) & ~same)
                        if not len(qi):
                            continue
                        d = np.sqrt(((qp.x[qi] - v[vi]) ** 2).sum(axis=1))
                        _keep(best[part], best_id[part], qi, d, v_ids[vi], k)
            qi, ki = np.nonzero(np.isfinite(best))
            yield pa.RecordBatch.from_arrays([pa.array(q.ids[qi]), pa.array(best_id[qi, ki]), pa.array(best[qi, ki])], names=["query_id", "vec_id", "score"])

        found = index.select("vec_id", "embedding", "code", "norm", "own").mapInArrow(searched, result)
        if n_blocks > 1:  # a block is done and gone before the next: one broadcast at a time, and no plan of many scans
            found = written(ranked(found, k), "nearest")
            sent.destroy()
        parts.append(found)
    if not parts:
        return spark.createDataFrame([], result).selectExpr("query_id", "1 AS rank", "vec_id", "score").limit(0)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return ranked(found, k) if n_blocks == 1 else found


def ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _keep(best: np.ndarray, best_id: np.ndarray, qi: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int) -> None:
    """Puts new distances into the sorted k best of their queries, in place."""
    some = np.unique(qi)
    all_q = np.concatenate((np.repeat(some, k), qi))
    all_d = np.concatenate((best[some].ravel(), d))
    all_id = np.concatenate((best_id[some].ravel(), ids))
    order = np.lexsort((all_id, all_d, all_q))
    all_q, all_d, all_id = all_q[order], all_d[order], all_id[order]
    first = np.searchsorted(all_q, some)
    take = first[:, None] + np.arange(k)[None]
    best[some], best_id[some] = all_d[take], all_id[take]


def op4_nearest(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, F.col("vec_id") % 100 == 0)


OP4_SQL = r"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM p) WHERE rank <= 10
"""
