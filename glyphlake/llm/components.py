"""Connected components of a table of links: union-find within each task, then star contraction by joins."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.workspace import Workspace


class UnionFind:
    """Sets of numbers; the root of a set is its smallest number."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def union(self, a: int, b: int) -> bool:
        """Whether a and b were apart."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True

    def links(self) -> list[tuple[int, int]]:
        """(number, root) of every number that is not its root."""
        return [(x, r) for x in list(self.parent) if (r := self.find(x)) != x]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = UnionFind()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found.union(a, b)
    pairs = found.links()
    yield pa.record_batch([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])


def components(links: DataFrame, work: Workspace, most_rounds: int | None = None) -> DataFrame:
    """(node, component) of every node of links (a, b: long), component being the smallest node reachable.

    Nulls and links of a node with itself are left out. Large-star and small-star steps (Kiveris et al.) alternate
    until nothing changes, or raise an error if that takes more than most_rounds; each step is written to the shared folder. No task
    sees more than its share of links: minima are partial aggregates, written before the join with them, so that the join reads
    two plain tables, of which Spark splits the partition that holds a hub's links.
    """
    real = links.where(F.col("a") != F.col("b")).select("a", "b")
    edges = work.save(real.mapInArrow(_contract, "a long, b long"), "contracted")
    before = None
    for turn in itertools.count():
        if turn == most_rounds:
            raise RuntimeError(f"links are not contracted after {most_rounds} rounds")
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = work.save(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), f"least{turn}")
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()
        large = work.save(large, f"large{turn}")
        work.drop(least)
        least = work.save(large.groupBy("a").agg(F.min("b").alias("m")), f"lower{turn}")
        small = large.join(least, "a")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")))
        small = work.save(small.where(F.col("a") != F.col("b")).distinct(), f"small{turn}")
        work.drop(edges, large, least)
        edges = small
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
