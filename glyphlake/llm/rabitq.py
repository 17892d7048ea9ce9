"""Nearest neighbours by inner product from randomly rotated one-bit codes.

Each vector is rotated by one random orthogonal matrix and keeps the signs of its coordinates, packed into bits,
with two correction scalars: its length, and the inner product of its direction with its code. A query's rotated
coordinates are rounded to 6 bits, and its inner product with a code is the sum over those bits of the number of bits that both have
set. Over the correction scalar this estimates the inner product with the vector without bias; the part of the direction that the
code does not see, and what the rounding took, bound the error (Gao and Long, RaBitQ). All codes are scanned; a vector
is reranked exactly only if its upper bound reaches the k-th best exact score found so far in its block.

The scan is made of blocks: codes lie in blocks of a fixed number of vectors, queries in blocks too, and each pair
of blocks is one row of work. Each block of queries meets every block of codes and gives its k best there, so at most k rows a query
and block are shuffled; the k best over all blocks follow by a ranking that drops all but k rows a query before its shuffle. A block's
vectors travel with it in the type they came in, for reranking where they lie: on vectors of 64 dimensions without clusters a quarter
of all pairs pass the bounds, which would be more to send than the blocks.

Defined results: vectors that are null, empty, zero, or hold a null or a component that is not finite take no
part; vectors of different lengths do not meet; rows of one vec_id and vector are one, rows of one vec_id and different
vectors compete each and ask each, with a ranking of its own, and do not find each other; ties go to the smaller vec_id; with fewer
candidates than k all are returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from glyphlake.llm.workspace import Workspace

VECTORS_PER_BLOCK = 16_384
QUERIES_PER_BLOCK = 2_048
QUERIES_AT_ONCE = 64
QUERY_BITS = 6
EPSILON = 2.6  # half-width of the error bound in standard deviations


@lru_cache(maxsize=4)
def rotation(dimensions: int) -> np.ndarray:
    """A random orthogonal matrix, the same on every executor."""
    draw = np.random.Generator(np.random.PCG64(11)).normal(size=(dimensions, dimensions))
    q, r = np.linalg.qr(draw)
    return q * np.sign(np.diag(r))


def packed(bits: np.ndarray) -> np.ndarray:
    """The last axis of a boolean array as 64-bit words, filled up with zeros."""
    raw = np.packbits(bits, axis=-1)
    return np.ascontiguousarray(np.pad(raw, [(0, 0)] * (raw.ndim - 1) + [(0, -raw.shape[-1] % 8)])).view(np.uint64)


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, lengths, and inner products of direction and code of the vectors."""
    lengths = np.linalg.norm(vectors, axis=1)
    turned = (vectors / lengths[:, None]) @ rotation(vectors.shape[1]).T
    return packed(turned > 0), lengths, np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])


class CodeBlock:
    """Vectors of a block with their codes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, lengths: np.ndarray, agree: np.ndarray) -> None:
        self.ids, self.vectors, self.codes = ids, vectors, codes
        self.scale = lengths / agree
        self.ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
        self.spread = lengths * np.sqrt(np.maximum(0, 1 - agree**2)) / (agree * np.sqrt(max(vectors.shape[1] - 1, 1)))

    def estimate(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and code the estimated inner product, and how far rounding the query can have moved it before scaling."""
        n = queries.shape[1]
        turned = queries @ rotation(n).T
        low = turned.min(axis=1, keepdims=True)
        step = np.maximum((turned.max(axis=1, keepdims=True) - low) / (2**QUERY_BITS - 1), 1e-300)
        levels = np.rint((turned - low) / step).astype(np.int64)
        rounded = low + step * levels
        both = np.zeros((len(queries), len(self.codes)), dtype=np.int32)
        for bit in range(QUERY_BITS):
            plane = packed((levels >> bit) & 1 == 1)
            for word in range(self.codes.shape[1]):
                both += np.bitwise_count(plane[:, word, None] & self.codes[None, :, word]).astype(np.int32) << bit
        with_code = (2 * (low * self.ones[None, :] + step * both) - rounded.sum(axis=1, keepdims=True)) / np.sqrt(n)
        return with_code * self.scale[None, :], np.linalg.norm(turned - rounded, axis=1)

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each query the ids and exact scores of its k best here, by estimate, bound and exact rerank."""
        size = np.linalg.norm(queries, axis=1)
        estimate, moved = self.estimate(queries)
        found_ids, found_scores = [], []
        for row, (own, query) in enumerate(zip(query_ids, queries)):
            guess = estimate[row]
            margin = EPSILON * size[row] * self.spread + moved[row] * self.scale
            guess[self.ids == own] = -np.inf
            first = np.argpartition(-guess, min(2 * k, len(guess) - 1))[: 2 * k]
            first = first[np.isfinite(guess[first])]
            exact = self.vectors[first].astype(np.float64) @ query
            reach = np.partition(exact, -k)[-k] if len(exact) >= k else -np.inf
            more = np.union1d(np.flatnonzero((guess + margin >= reach) & np.isfinite(guess)), first)
            exact = self.vectors[more].astype(np.float64) @ query
            best = np.lexsort((self.ids[more], -exact))[:k]
            found_ids.append(self.ids[more][best])
            found_scores.append(exact[best])
        return found_ids, found_scores


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, v (array of float or double) and n (its length) of the vectors that take part, equal rows once."""
    kind = "array<float>" if dict(embeddings.dtypes)["embedding"] == "array<float>" else "array<double>"
    v = F.col("embedding").cast(kind)
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(fine)
    return rows.distinct().withColumn("n", F.size("v"))


def search(embeddings: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose vec_id is divisible by `every`."""
    spark = embeddings.sparkSession
    work = Workspace(spark, "ann")
    rows = work.save(usable(embeddings), "vectors")
    item = np.float32 if dict(rows.dtypes)["v"] == "array<float>" else np.float64
    asked = F.col("vec_id") % every == 0
    # Blocks of codes and of queries for each length of vectors.
    counts = work.save(rows.groupBy("n").agg(F.ceil(F.count("*") / VECTORS_PER_BLOCK).cast("long").alias("blocks"), F.ceil(F.count_if(asked) / QUERIES_PER_BLOCK).cast("long").alias("parts")), "counts")
    key = F.xxhash64("vec_id", "v")

    def build(group: tuple, table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        vectors = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        codes, size, agree = encode(vectors.astype(np.float64))
        return pa.table({"n": pa.array([group[0].as_py()], pa.int32()), "block": pa.array([group[1].as_py()], pa.int64()), "ids": [ids.tobytes()], "vectors": [vectors.tobytes()], "codes": [codes.tobytes()], "sizes": [size.tobytes()], "agree": [agree.tobytes()]})

    binary = "ids binary, vectors binary, codes binary, sizes binary, agree binary"
    dealt = rows.join(counts, "n").withColumn("block", F.pmod(key, F.col("blocks"))).select("n", "block", "vec_id", "v")
    codes = work.save(dealt.groupBy("n", "block").applyInArrow(build, f"n int, block long, {binary}"), "codes")

    def gather(group: tuple, table: pa.Table) -> pa.Table:
        vectors = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return pa.table({"n": pa.array([group[0].as_py()], pa.int32()), "query_ids": [table.column("vec_id").to_numpy().tobytes()], "query_keys": [table.column("k").to_numpy().tobytes()], "query_vectors": [vectors.tobytes()]})

    queries = rows.where(asked).join(counts, "n").select("n", F.pmod(F.xxhash64("vec_id", "v", F.lit(1)), F.col("parts")).alias("part"), "vec_id", "v", key.alias("k"))
    queries = queries.groupBy("n", "part").applyInArrow(gather, "n int, query_ids binary, query_keys binary, query_vectors binary")
    # Every block of queries against every block of codes, as rows that name both.
    work_rows = queries.join(counts, "n").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if at != (row["n"], row["block"]):
                    at = row["n"], row["block"]
                    ids, size, agree = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["sizes"], np.float64), np.frombuffer(row["agree"], np.float64)
                    vectors = np.frombuffer(row["vectors"], item).reshape(len(ids), -1)
                    held = CodeBlock(ids, vectors, np.frombuffer(row["codes"], np.uint64).reshape(len(ids), -1), size, agree)
                query_ids, query_keys = np.frombuffer(row["query_ids"], np.int64), np.frombuffer(row["query_keys"], np.int64)
                query_vectors = np.frombuffer(row["query_vectors"], item).reshape(len(query_ids), -1).astype(np.float64)
                near, scores = [], []
                for begin in range(0, len(query_ids), QUERIES_AT_ONCE):
                    some = slice(begin, begin + QUERIES_AT_ONCE)
                    for total, part in zip((near, scores), held.nearest(query_ids[some], query_vectors[some], k)):
                        total += part
                n = [len(x) for x in near]
                yield pa.record_batch([pa.array(np.repeat(query_ids, n)), pa.array(np.repeat(query_keys, n)), pa.array(np.concatenate(near)), pa.array(np.concatenate(scores))], names=["query_id", "query_key", "vec_id", "score"])

    joined = work_rows.join(codes, ["n", "block"]).select("n", "block", "query_ids", "query_keys", "query_vectors", *[c.split()[0] for c in binary.split(", ")])
    found = joined.mapInArrow(scan, "query_id long, query_key long, vec_id long, score double")
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
