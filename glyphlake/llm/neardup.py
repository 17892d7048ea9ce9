"""Near-duplicate groups: SuperMinHash, banding, exact verification, union-find.

1. Each document's set of word shingles gets a key (128 bits, equal for equal sets), a signature and band keys.
   One document of each set goes on; copies need no comparing.
2. Documents that share a band key are a bucket. Bands of four out of 128 places miss a pair of similarity 0.8 with
   a probability of 5e-8. Every member of a bucket is compared with its smallest on full sets, where their signatures agree
   well enough (six standard deviations below the threshold). What is linked so far has a component.
3. Only buckets whose members lie in several components are left. They form clusters: the components of the graph that ties each
   member to the smallest of its bucket. Within a cluster, pairs whose signatures agree well enough and that are not connected
   yet are compared. A cluster is compared in blocks of bounded bytes and rows, pair of blocks by pair of blocks, so
   a huge one is many tasks; a task emits only the links of a spanning forest. The work of a cluster grows with the square of
   its blocks; a large group of copies is no cluster, as the second step has connected it.
4. The links' components are the groups, named by their smallest doc_id.

Defined results: documents without words have empty sets and are linked with nothing; rows that share a doc_id
are one document; a null doc_id is linked with nothing, has a null component and is kept; an empty table gives no rows.
doc_id must be of an integer type; another is an error before anything runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.llm.components import UnionFind, components
from glyphlake.llm.superminhash import PLACES, SLICE_BYTES, band_keys, shingle_sets, signatures
from glyphlake.llm.wordstream import slices, text_bytes
from glyphlake.llm.workspace import Workspace

ROWS_PER_BAND = 4
BLOCK_ROWS = 1_000
BLOCK_BYTES = 16_000_000
SIGMAS = 6


def sets(docs: DataFrame, shingle: int, places: int = PLACES) -> DataFrame:
    """doc_id, n_shingles, k1, k2, n_bytes, signature (16 bits a place) and bands of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, bounds = text_bytes(batch.column(1))
            for begin, end in slices(bounds, SLICE_BYTES):
                found = shingle_sets(batch.column(1).slice(begin, end - begin), shingle)
                signed = signatures(found, places)
                bands = band_keys(signed, ROWS_PER_BAND).view(np.int64)
                keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in found), np.int64).reshape(-1, 2)
                yield pa.record_batch(
                    [
                        batch.column(0).slice(begin, end - begin),
                        pa.array([len(x) for x in found], pa.int64()),
                        pa.array(keys[:, 0]),
                        pa.array(keys[:, 1]),
                        pa.array(np.diff(bounds[begin : end + 1])),
                        pa.array([x.tobytes() for x in signed.astype(np.uint16)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * bands.shape[1]), pa.array(bands.reshape(-1))),
                    ],
                    names=["doc_id", "n_shingles", "k1", "k2", "n_bytes", "signature", "bands"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, k1 long, k2 long, n_bytes long, signature binary, bands array<long>")


def least_agreement(share: Fraction, places: int = PLACES) -> float:
    """The share of equal places below which signatures of sets of similarity `share` hardly ever lie."""
    return float(share) - SIGMAS * (float(share) * (1 - float(share)) / places) ** 0.5


def similar(a: np.ndarray, b: np.ndarray, share: Fraction) -> bool:
    """Whether the similarity of two sorted sets is `share` or more."""
    low, high = sorted((len(a), len(b)))
    if low * share.denominator < high * share.numerator:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return share.denominator * both >= share.numerator * (len(a) + len(b) - both)


def forest(nodes: np.ndarray, side: np.ndarray, found: list[np.ndarray], signed: np.ndarray, share: Fraction, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of a spanning forest over the pairs of similarity `share` or more; with two sides, over pairs across them.

    The pairs of greatest estimated similarity come first, so that most others are connected before their turn. Nodes of
    one known component are connected from the start.
    """
    estimated = least_agreement(share, signed.shape[1])
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    left, right, close = [], [], []
    for i in range(len(nodes) - 1):
        low, high = np.minimum(sizes[i + 1 :], sizes[i]), np.maximum(sizes[i + 1 :], sizes[i])
        fit = low * share.denominator >= high * share.numerator
        if side.any():
            fit &= side[i + 1 :] != side[i]
        if known is not None:
            fit &= known[i + 1 :] != known[i]
        js = np.flatnonzero(fit)
        agree = (signed[js + i + 1] == signed[i]).mean(axis=1)
        js, agree = js[agree >= estimated], agree[agree >= estimated]
        left.append(np.full(len(js), i))
        right.append(js + i + 1)
        close.append(agree)
    if not left:
        return []
    left, right = np.concatenate(left), np.concatenate(right)
    order = np.argsort(-np.concatenate(close), kind="stable")
    groups = UnionFind()
    name = np.arange(len(nodes)) if known is None else np.unique(known, return_inverse=True)[1]
    links = []
    for i, j in zip(left[order].tolist(), right[order].tolist()):
        a, b = int(name[i]), int(name[j])
        if groups.find(a) != groups.find(b) and similar(found[i], found[j], share):
            groups.union(a, b)
            links.append((int(nodes[i]), int(nodes[j])))
    return links


def agreeing(pairs: DataFrame, signed: DataFrame, share: Fraction) -> DataFrame:
    """The pairs (a, b) whose signatures (doc_id, signature) agree well enough."""
    least = least_agreement(share)

    @F.pandas_udf("boolean")
    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        one, two = (np.frombuffer(b"".join(x), np.uint16).reshape(len(x), -1) for x in (a, b))
        return pd.Series((one == two).mean(axis=1) >= least)

    sides = [signed.select(F.col("doc_id").alias(c), F.col("signature").alias(f"of_{c}")) for c in ("a", "b")]
    return pairs.join(sides[0], "a").join(sides[1], "b").where(close("of_a", "of_b")).select("a", "b")


def spokes(pairs: DataFrame, held: DataFrame, shingle: int, share: Fraction, work: Workspace) -> DataFrame:
    """The pairs (a, b) of similarity `share` or more, by full sets; held (doc_id, text, n_bytes).

    The members of a hub b are dealt in slices of bounded bytes and rows, and each slice gets the hub's text.
    """
    sized = pairs.join(held.select(F.col("doc_id").alias("a"), "n_bytes"), "a")
    cut = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n_bytes") / BLOCK_BYTES), F.lit(1)).cast("long")
    hubs = work.save(sized.groupBy("b").agg(cut.alias("slices"), (F.sum("n_bytes") + F.count("*")).alias("bytes")), "hubs")
    total = hubs.agg(F.sum("bytes")).first()[0] or 0
    parts = max(1, -(-total // BLOCK_BYTES))
    part = F.pmod(F.xxhash64("b", "slice"), F.lit(parts)).alias("part")
    members = pairs.join(hubs, "b").withColumn("slice", F.pmod(F.xxhash64("a"), F.col("slices")))
    members = members.join(held.select(F.col("doc_id").alias("a"), "text"), "a").select(part, "b", "a", "text")
    centres = hubs.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    centres = centres.join(held.select(F.col("doc_id").alias("b"), F.col("text").alias("hub")), "b").select(part.alias("part"), F.col("b").alias("b"), "hub")

    def verify(key: tuple, ours: pa.Table, theirs: pa.Table) -> pa.Table:
        sets: dict[int, list[np.ndarray]] = {}
        for b, found in zip(theirs.column("b").to_pylist(), shingle_sets(theirs.column("hub").combine_chunks(), shingle)):
            sets.setdefault(b, []).append(found)
        links = []
        for begin in range(0, ours.num_rows, BLOCK_ROWS):
            rows = ours.slice(begin, BLOCK_ROWS)
            found = shingle_sets(rows.column("text").combine_chunks(), shingle)
            links += [(a, b) for a, b, x in zip(rows.column("a").to_pylist(), rows.column("b").to_pylist(), found) if any(similar(x, y, share) for y in sets.get(b, ()))]
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return members.groupBy("part").cogroup(centres.groupBy("part")).applyInArrow(verify, "a long, b long")


def starred(members: DataFrame, buckets: DataFrame) -> DataFrame:
    """(a, b): each member (band, doc_id) of the buckets (band, first) next to the bucket's smallest."""
    return members.join(buckets.select("band", "first"), "band").where(F.col("doc_id") != F.col("first")).select(F.col("doc_id").alias("a"), F.col("first").alias("b")).distinct()


def group(docs: DataFrame, shingle: int, percent: int = 80, work: Workspace | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs; linked where 100 * intersection >= percent * union.

    The result reads from tables in work.
    """
    if dict(docs.dtypes)["doc_id"] not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError("doc_id must be of an integer type")
    share = Fraction(percent, 100)
    work = work or Workspace(docs.sparkSession, "neardup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    all_sets = work.save(sets(docs, shingle), "sets")
    with_words = all_sets.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    keyed = with_words.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    keyed = work.save(keyed, "keys")
    one = with_words.join(keyed.select("k1", "k2", "doc_id"), ["k1", "k2", "doc_id"], "left_semi")

    # Buckets of two or more; each member against the smallest.
    members = work.save(one.select(F.explode("bands").alias("band"), "doc_id"), "bands")
    buckets = members.groupBy("band").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where(F.col("first") < F.col("last"))
    buckets = work.save(buckets, "buckets")
    near = work.save(starred(members, buckets), "near")
    work.release()
    ids = work.save(near.select("a").unionByName(near.select(F.col("b").alias("a"))).distinct().withColumnRenamed("a", "doc_id"), "ids")
    signed = work.save(one.select("doc_id", "n_bytes", "signature").distinct().join(ids, "doc_id", "left_semi"), "signed")
    close = work.save(agreeing(near, signed, share), "close")
    held = work.save(docs.join(ids, "doc_id", "left_semi").join(signed.select("doc_id", "n_bytes").distinct(), "doc_id"), "held")
    work.drop(near)
    work.release()
    linked = work.save(spokes(close, held, shingle, share, work), "spokes")
    joint = work.save(components(linked, work), "joint")
    work.drop(close)
    work.release()

    # Buckets that still span several components, as clusters.
    placed = members.join(joint.select(F.col("node").alias("doc_id"), F.col("component").alias("known")), "doc_id", "left").withColumn("known", F.coalesce("known", "doc_id"))
    mixed = placed.groupBy("band").agg(F.min("doc_id").alias("first"), F.min("known").alias("low"), F.max("known").alias("high")).where("low < high")
    mixed = work.save(mixed, "mixed")
    clusters = work.save(components(starred(members, mixed), work), "clusters")
    work.drop(members, buckets, mixed)
    facts = signed.join(clusters.withColumnRenamed("node", "doc_id"), "doc_id").join(joint.withColumnsRenamed({"node": "doc_id", "component": "known"}), "doc_id", "left")
    facts = work.save(facts.withColumn("known", F.coalesce("known", "doc_id")), "candidates")
    sizes = facts.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n_bytes") / BLOCK_BYTES)).cast("long").alias("blocks"))
    sizes = work.save(sizes, "sizes")
    dealt = facts.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks"))).drop("n_bytes")
    pairs = held.drop("n_bytes").join(dealt, "doc_id").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = pairs.select("component", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "doc_id", "text", "signature", "known")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        nodes = table.column("doc_id").to_numpy()
        found = shingle_sets(table.column("text").combine_chunks(), shingle)
        signed = np.stack([np.frombuffer(x, np.uint16) for x in table.column("signature").to_pylist()])
        low, high = key[1].as_py(), key[2].as_py()
        side = (table.column("own").to_numpy() == high) & (low != high)
        links = forest(nodes, side, found, signed, share, table.column("known").to_numpy())
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    links = work.save(pairs.groupBy("component", "low", "high").applyInArrow(compare, "a long, b long"), "links")
    groups = work.save(components(links.unionByName(joint.select(F.col("node").alias("a"), F.col("component").alias("b"))), work), "groups")
    work.drop(held, facts, signed, links, joint, linked)
    work.release()

    # Only sets with copies, and first documents with links, have another component than themselves.
    first = keyed.where("copies > 1").select("k1", "k2", F.col("doc_id").alias("first"))
    named = all_sets.select("doc_id", "n_shingles", "k1", "k2").join(first, ["k1", "k2"], "left")
    named = named.withColumn("node", F.when(F.col("n_shingles") > 0, F.coalesce("first", "doc_id")).otherwise(F.col("doc_id")))
    out = named.join(groups, "node", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, shingle: int, percent: int = 80) -> DataFrame:
    """docs with one row for each group: its smallest doc_id, and of rows that share it the first by hash of the text.

    Rows without a doc_id all stay.
    """
    spark, rank = docs.sparkSession, "_rank"
    while rank in docs.columns:
        rank += "_"
    grouping = Workspace(spark, "neardup")
    first = Workspace(spark, "keep").save(group(docs, shingle, percent, grouping).where("kept and doc_id is not null").select("doc_id").distinct(), "first")
    grouping.clear()
    grouping.release()
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    one = docs.join(first, "doc_id", "left_semi").withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).drop(rank)
    return one.unionByName(docs.where(F.col("doc_id").isNull())).select(docs.columns)
