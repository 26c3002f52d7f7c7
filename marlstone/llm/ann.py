"""Nearest neighbours by inner product from randomly rotated one-bit codes.

Vectors are centred on the corpus mean and turned by one random rotation. A code
keeps the sign of each rotated component in one bit, the length of the centred
vector and the inner product of its direction with the code's. From these a
query's inner product is estimated without bias, with an error that exceeds
``epsilon`` standard bounds only rarely. In each tile of queries and vectors, exact
products of a few times k vectors with the greatest estimates give a level that the
k-th best can't be below, and exact products are computed for all vectors whose
upper bound reaches it: ties and crowds of equal vectors are all looked at, none is
cut off.

Every vector is coded, once; the rotation and the mean are all that is fitted. Queries
are dealt in blocks against blocks of vectors, each task holding one of either, in
the precision in which they are stored.

Edge cases: vectors that are null, zero, of another length than the rest (the
most frequent length counts), or hold null or non-finite components take no part,
as queries or otherwise. A query meets every row but itself. Fewer rows than k give
all of them. Rows with equal ids are separate vectors that meet each other, and as
queries each has a list of its own. An id column named like another column of the
result is called ``id`` there. An empty table gives nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from marlstone.llm.shared import settle

ROW_BLOCK, QUERY_BLOCK = 8192, 1024
#: Blocks grow with the input from here on, up to these sizes in bytes of vectors.
MAX_BLOCKS, MAX_BLOCK_BYTES = 64, 256 << 20
EPSILON = 3.0
#: Exact products that set the level, for each of the k asked for.
RERANK = 3


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


class Codes:
    """Packed bits and correction scalars of some vectors."""

    def __init__(self, dim: int, bits: np.ndarray, length: np.ndarray, aligned: np.ndarray):
        self.dim, self.bits, self.length, self.aligned = dim, bits, length, aligned

    @staticmethod
    def of(vectors: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> Codes:
        centred = vectors - mean
        dim = vectors.shape[1]
        length = np.sqrt((centred**2).sum(axis=1))
        turned = centred @ turn
        # the inner product of a vector's direction and its code's
        aligned = np.abs(turned).sum(axis=1) / np.sqrt(dim) / np.where(length > 0, length, 1)
        aligned[length == 0] = 1
        return Codes(dim, np.packbits(turned > 0, axis=1), length, aligned)

    def packed(self) -> bytes:
        return self.length.tobytes() + self.aligned.tobytes() + self.bits.tobytes()

    @staticmethod
    def unpacked(data: bytes, dim: int, n: int) -> Codes:
        return Codes(dim, np.frombuffer(data, dtype=np.uint8, offset=16 * n).reshape(n, -1), np.frombuffer(data, count=n), np.frombuffer(data, count=n, offset=8 * n))

    def estimate(self, queries: np.ndarray, mean: np.ndarray, turn: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products (queries, vectors) and the half width of their bounds."""
        turned = (queries @ turn).astype(np.float32)
        signs = np.unpackbits(self.bits, axis=1, count=self.dim).astype(np.float32) * 2 - 1
        raw = turned @ signs.T / np.float32(np.sqrt(self.dim))
        scale = (self.length / self.aligned).astype(np.float32)
        centre = (queries @ mean).astype(np.float32)
        spread = np.sqrt(np.maximum(0, 1 - self.aligned**2)) / self.aligned * self.length / np.sqrt(max(1, self.dim - 1))
        size = np.sqrt((queries**2).sum(axis=1))
        slack = 1e-5 * (self.length + np.sqrt((mean**2).sum()))  # of single precision
        return raw * scale[None, :] + centre[:, None], (size[:, None] * (epsilon * spread + slack)[None, :]).astype(np.float32)


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, components in order, alike for equal vectors wherever they lie."""
    out = np.zeros(len(vectors))
    for component, x in zip(np.ascontiguousarray(vectors.T), query):
        out += component * x
    return out


def search_tile(
    ids: np.ndarray, vectors: np.ndarray, codes: Codes, query_ids: np.ndarray, queries: np.ndarray, k: int, mean: np.ndarray, turn: np.ndarray, epsilon: float
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: its number, and ids and products of the k best of ``vectors`` but itself."""
    if not len(ids):
        return
    for begin in range(0, len(queries), 128):
        some, some_ids = queries[begin : begin + 128], query_ids[begin : begin + 128]
        guess, width = codes.estimate(some, mean, turn, epsilon)
        for q, row in zip(*np.nonzero(some_ids[:, None] == ids[None, :])):
            if guess[q, row] > -np.inf and not np.isneginf(guess[q, ids == some_ids[q]]).any() and (vectors[row] == some[q]).all():
                guess[q, row] = -np.inf  # the query itself; copies of it are alike
        high = guess + width
        reach = min(RERANK * k, len(ids))
        for q in range(len(some)):
            top = np.argpartition(guess[q], len(ids) - reach)[len(ids) - reach :]
            top = top[~np.isneginf(guess[q, top])]
            sure = vectors[top] @ some[q]
            level = np.partition(sure, len(sure) - k)[len(sure) - k] if len(sure) >= k else -np.inf
            rows = np.flatnonzero((high[q] >= level - 1e-6 * abs(level)) & (guess[q] > -np.inf)) if len(sure) >= k else top
            score = vectors[rows] @ some[q]
            if len(rows) > k:  # all that rounding could bring among the best, equal vectors included
                level = np.partition(score, len(rows) - k)[len(rows) - k]
                rows = rows[score >= level - 1e-9 * np.abs(score).max()]
            score = exact(vectors[rows], some[q])
            best = np.lexsort((ids[rows], -score))[:k]
            yield begin + q, ids[rows[best]], score[best]


def nearest(df: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, seed: int = 1, epsilon: float = EPSILON) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``id_col``, ``score`` of the k rows with the greatest inner products; ids are integers."""
    spark = df.sparkSession
    ident, vector = F.col(f"`{id_col}`"), F.col(f"`{vector_col}`")
    narrow = isinstance(df.schema[vector_col].dataType, ArrayType) and isinstance(df.schema[vector_col].dataType.elementType, FloatType)
    kind = np.float32 if narrow else np.float64  # single precision stays so where it is moved, and is widened to compute
    rows = df.select(ident.cast("long").alias("_id"), vector.cast("array<float>" if narrow else "array<double>").alias("_v"), is_query.alias("_asks"))
    fine = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("_v", lambda x: x != 0)
    rows = rows.where(F.col("_id").isNotNull() & F.col("_v").isNotNull()).where(fine)
    lengths = rows.groupBy(F.size("_v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("_asks", F.lit(False)).cast("int")).alias("q")).orderBy(F.desc("n"), "d").first()
    named = "id" if id_col in ("query_id", "rank", "score") else id_col
    empty = f"query_id long, rank int, `{named}` long, score double"
    if lengths is None or not lengths["q"]:
        return spark.createDataFrame([], empty)
    dim, count, asking = lengths["d"], lengths["n"], lengths["q"]
    rows = rows.where(F.size("_v") == dim)
    at_most = max(1, MAX_BLOCK_BYTES // (kind().itemsize * dim))
    row_blocks = -(-count // min(at_most, max(ROW_BLOCK, -(-count // MAX_BLOCKS))))
    query_blocks = -(-asking // min(at_most, max(QUERY_BLOCK, -(-asking // MAX_BLOCKS))))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dim), 0
        for batch in batches:
            total += batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).sum(axis=0, dtype=np.float64)
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()]), pa.array([n])], names=["total", "n"])

    sums = rows.select("_v").mapInArrow(add_up, "total array<double>, n long").collect()  # one row a partition
    mean = np.sum([r["total"] for r in sums], axis=0) / count
    turn = rotation(dim, seed)

    def to_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            ids, vectors = batch.column(1).to_numpy(), batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            for block in np.unique(blocks).tolist():
                mine = blocks == block
                held.setdefault(block, []).append((ids[mine], vectors[mine]))
        for block, parts in held.items():
            ids, vectors = (np.concatenate([p[i] for p in parts]) for i in range(2))
            codes = Codes.of(vectors.astype(np.float64), mean, turn).packed()
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([x], pa.binary()) for x in (ids.tobytes(), vectors.tobytes(), codes))], names=["block", "ids", "vectors", "codes"])

    def blobs(part: DataFrame, blocks: int) -> DataFrame:
        dealt = part.select(F.pmod(F.xxhash64("_id", "_v"), F.lit(blocks)).cast("int").alias("block"), "_id", "_v").repartition(blocks, "block")
        return settle(dealt.mapInArrow(to_blobs, "block int, ids binary, vectors binary, codes binary"), "vector-blocks")

    # blocks are written once, codes with them, and dealt to tiles; a query is known by its block and place there
    tile = lambda name: F.explode(F.sequence(F.lit(0), F.lit(name - 1)))
    sides = blobs(rows, row_blocks).withColumn("other", tile(query_blocks)).select((F.col("block") * query_blocks + F.col("other")).alias("tile"), F.lit(0).alias("side"), "ids", "vectors", "codes")
    asks = blobs(rows.where("_asks"), query_blocks).withColumn("other", tile(row_blocks))
    asks = asks.select((F.col("other") * query_blocks + F.col("block")).alias("tile"), F.lit(1).alias("side"), "ids", "vectors", F.lit(b"").alias("codes"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            for number, side, ids, vectors, codes in zip(*(c.to_pylist() for c in batch.columns)):
                if side == 0:
                    before = (number, ids, vectors, codes)
                    continue
                if before is None or before[0] != number:
                    continue
                row_ids, query_ids = (np.frombuffer(x, dtype=np.int64) for x in (before[1], ids))
                own, asked = (np.frombuffer(x, dtype=kind).reshape(-1, dim).astype(np.float64) for x in (before[2], vectors))
                found = list(search_tile(row_ids, own, Codes.unpacked(before[3], dim, len(row_ids)), query_ids, asked, k, mean, turn, epsilon))
                before = None
                at = np.repeat(np.array([f[0] for f in found], dtype=np.int64), [len(f[1]) for f in found])
                yield pa.RecordBatch.from_arrays(
                    [pa.array((number % query_blocks << 32) + at), pa.array(query_ids[at]), pa.array(np.concatenate([row_ids[:0], *(f[1] for f in found)])), pa.array(np.concatenate([np.zeros(0), *(f[2] for f in found)]))],
                    names=["_query", "query_id", "_id", "score"],
                )

    tiles = sides.unionByName(asks).repartition(min(4096, row_blocks * query_blocks), "tile").sortWithinPartitions("tile", "side")
    found = tiles.mapInArrow(search, "_query long, query_id long, _id long, score double")
    ranked = found.selectExpr("_query", "query_id", "int(row_number() over (partition by _query order by score desc, _id)) as rank", "_id", "score")
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("_id").alias(named), "score")
