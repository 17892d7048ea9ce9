"""Balanced label propagation: shards of even size that keep linked documents together.

Every shard has an exact quota of rows. Linked rows are counted against the whole of it; unlinked rows only fill what is left.

1. Every linked row begins in the shard that a hash of its number names, so shards begin even.
2. Propagation: in rounds, linked rows ask to move to the shard where most of their neighbours lie. Which ones may is decided by a
   histogram of bounded size: what fits the quotas, and exchanges of about equal size. Equal texts are all linked with each other,
   so the votes of a row are its group's rows in each shard, and rows of one group and shard ask alike: a round is over the
   counts of groups, until nobody may move. Given links are followed row by row, until no fewer of them are cut.
3. Check of the sizes: groups, the connected components of the links, take their rows to the shard that most of them came to, largest
   first, or where that is full to the one that they fill most tightly; if tightest filling alone cuts fewer groups, it holds.
   Small groups are placed as bins of a hash and a shard, so the driver sees a bounded number of items.
4. A group that fits no shard fills whole further shards one after the other, and its rest is placed as a group of its own. Given links
   inside such a group are followed in rounds once more, from these parts.
5. Unlinked rows are dealt by hash over the room that is left, and one distributed sort makes the sizes exact: the rows
   that are over, unlinked ones and then those of the smallest groups first, fill the gaps of other shards.

Rows are numbered by doc_id and text, and all choices follow from these numbers, so how a table is partitioned does not matter. The
counts of a group are written before rows are joined with them, so that Spark can split the join on a large group.

Defined results: null texts have size 1 and are linked with each other as empty texts are not with them; repeated rows
are rows of their own; an empty table gives no rows; with fewer rows than shards some shards stay empty.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.components import components
from glyphlake.llm.workspace import Workspace

LARGE_PARTS = 1024  # a group over this part of a shard is packed by itself
BINS = 1024  # for the other groups, in each shard
COARSE, FINE = 256, 8
PATIENCE = 4  # rounds without fewer cut links, by coin and by number, before the propagation ends


def facts(docs: DataFrame, work: Workspace) -> DataFrame:
    """node, doc_id, size, text_crc32 and key (equal for equal texts) of every document; the text itself goes no further.

    node is the row's number from 0 by doc_id and key; rows alike in both are interchangeable.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.md5(F.encode("text", "UTF-8"))).otherwise("null").alias("key"),
    )
    rows = work.save(rows.withColumns({"all": F.lit(0), "seq": F.monotonically_increasing_id()}), "rows")
    dealt, _ = numbered(rows, "all", ["doc_id", "key", "seq"], work)
    return dealt.withColumnRenamed("p", "node").drop("all", "seq")


def begins(shards: int) -> Column:
    """The shard in which a row begins."""
    return F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int")


def votes_of(shard: Column, shards: int) -> Column:
    """How many rows of a group lie in each shard, as an aggregate."""
    return F.array(*(F.count_if(shard == s) for s in range(shards))).alias("votes")


def leader(shards: int) -> Column:
    """The shard with most of a group's rows; which of equal ones, the group decides."""
    turn = lambda s: F.pmod(s - F.xxhash64("group"), F.lit(shards))
    ranked = F.transform("votes", lambda n, s: F.struct(n.alias("n"), (-turn(s)).alias("turn"), s.cast("int").alias("shard")))
    return F.array_max(ranked)["shard"]


def bin_of(limit: int) -> Column:
    """A group of more than limit rows itself, as it is not below 0; any other's bin, which is."""
    return F.when(F.col("n") > limit, F.col("group")).otherwise(-1 - F.pmod(F.xxhash64("group"), F.lit(BINS)))


def gathered(groups: DataFrame, target: dict[int, int], limit: int, work: Workspace) -> DataFrame:
    """groups (group, n, votes) of equal texts with their votes after all rounds of propagation.

    Rows of a group in one shard have the same neighbours and move together, to where most rows of the group are: that is never
    another shard later on. Each round leaves fewer such parts, so the rounds end.
    """
    shards = len(target)
    groups = groups.withColumn("place", bin_of(limit))
    turn = 0
    while True:
        held = groups.agg(*(F.sum(F.get("votes", F.lit(s))) for s in range(shards))).first()
        asks = groups.withColumn("new", leader(shards)).select("place", "new", F.posexplode("votes").alias("old", "n")).where("old <> new and n > 0")
        # At most shards x shards rows a bin and shards rows a large group, whatever the input.
        wanted = [(r["n"], r["old"], r["new"], r["place"]) for r in asks.groupBy("old", "new", "place").agg(F.sum("n").alias("n")).collect()]
        taken = admitted(wanted, {s: n - (held[s] or 0) for s, n in target.items()})
        if not taken:
            return groups.drop("place")
        moves = defaultdict(list)
        for old, new, place in taken:
            moves[place, new].append(old)
        told = F.broadcast(work.spark.createDataFrame([(p, n, sorted(olds)) for (p, n), olds in sorted(moves.items())], "place long, new int, olds array<int>"))
        seen = groups.withColumn("new", leader(shards)).join(told, ["place", "new"], "left")
        leaves = lambda s: F.coalesce(F.array_contains("olds", s.cast("int")), F.lit(False))
        come = F.aggregate(F.transform("votes", lambda n, s: F.when(leaves(s), n).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, n: a + n)
        after = F.transform("votes", lambda n, s: F.when(leaves(s), F.lit(0).cast("long")).when(s == F.col("new"), n + F.col("come")).otherwise(n))
        turn += 1
        groups = work.save(seen.withColumn("come", come).withColumn("votes", after).select(groups.columns), f"gathered{turn}")


def grouped_equals(nodes: DataFrame, target: dict[int, int], limit: int, work: Workspace) -> DataFrame:
    """nodes with group, the first row of those with the same key, its n rows and the shard that most of them come to; all null for rows alone."""
    shards = len(target)
    first = nodes.groupBy("key").agg(F.min("node").alias("group"), F.count("*").alias("n"), votes_of(begins(shards), shards)).where(F.col("n") > 1)
    first = gathered(work.save(first, "first"), target, limit, work)
    return nodes.join(work.save(first.select("key", "group", "n", leader(shards).alias("label")), "labels"), "key", "left")


def grouped_links(nodes: DataFrame, links: DataFrame, target: dict[int, int], work: Workspace) -> DataFrame:
    """nodes with group, the first row reachable over links, its n rows and the shard that most of them come to; all null for rows without links."""
    shards = len(target)
    found = work.save(components(links, work).withColumnRenamed("component", "group"), "groups")
    state = work.save(found.select("node", begins(shards).alias("shard")), "begin")
    held = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    state = propagate(state, links, {s: n - held.get(s, 0) for s, n in target.items()}, work, "whole")
    sizes = found.join(state, "node").groupBy("group").agg(F.count("*").alias("n"), votes_of(F.col("shard"), shards))
    sizes = work.save(sizes.select("group", "n", leader(shards).alias("label")), "sizes")
    return nodes.join(found.join(sizes, "group"), "node", "left")


def packed(sizes: dict[int, int], quota: dict[int, int], labels: dict[int, int] | None = None) -> list[tuple[int, int, int, int]]:
    """(item, shard, first, last): where the rows of each item go, as ranges of their numbers; one range wherever a shard has room for all.

    An item goes to the shard of its label where that has room for all of it.
    """
    labels = labels or {}
    room = dict(quota)
    out = []
    for item, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        at = 0
        while at < n:
            fits = [s for s in room if room[s] >= n - at]
            shard = labels[item] if labels.get(item) in fits else min(fits, key=lambda s: (room[s], s)) if fits else min(room, key=lambda s: (-room[s], s))
            taken = min(room[shard], n - at)
            out.append((item, shard, at, at + taken))
            room[shard] -= taken
            at += taken
    return out


def numbered(rows: DataFrame, by: str, order: list[str | Column], work: Workspace) -> tuple[DataFrame, dict[int, int]]:
    """rows with their number p, from 0, within each value of `by`, and how many rows each value has."""
    keys = [by, *order]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = work.save(dealt.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "numbered")
    # A run is the rows of one value in one partition: as many as partitions and values together, at most.
    runs = sorted((r[by], r["part"], r["first"], r["n"]) for r in dealt.groupBy(by, "part").agg(F.min("at").alias("first"), F.count("*").alias("n")).collect())
    held: dict[int, int] = defaultdict(int)
    bases = []
    for value, part, first, n in runs:
        bases.append((value, part, held[value] - first))
        held[value] += n
    base = F.broadcast(work.spark.createDataFrame(bases, f"{by} {dict(rows.dtypes)[by]}, part int, base long"))
    return dealt.join(base, [by, "part"]).withColumn("p", F.col("at") + F.col("base")).drop("part", "at", "base"), held


def admitted(wanted: list[tuple[int, int, int, int]], room: dict[int, int]) -> list[tuple[int, int, int]]:
    """(old, new, place) of the bins (n, old, new, place) that may move: those that fit, then exchanges of two shards."""
    room, taken, rest = dict(room), [], sorted(wanted)
    while True:
        left = []
        for n, old, new, place in rest:
            if n <= room[new]:
                room[new] -= n
                room[old] += n
                taken.append((old, new, place))
            else:
                left.append((n, old, new, place))
        if len(left) == len(rest):
            break
        rest = left
    ways = defaultdict(list)
    for n, old, new, place in rest:
        ways[old, new].append((n, place))
    for (s, t), there in ways.items():
        back = ways.get((t, s), []) if s < t else []
        i = j = ahead = 0  # rows that went there beyond those that came back
        while i < len(there) and j < len(back):
            if ahead <= 0:
                ahead += there[i][0]
                taken.append((s, t, there[i][1]))
                i += 1
            else:
                ahead -= back[j][0]
                taken.append((t, s, back[j][1]))
                j += 1
        while ahead > 0 and j < len(back):
            ahead -= back[j][0]
            taken.append((t, s, back[j][1]))
            j += 1
    return taken


def propagate(state: DataFrame, links: DataFrame, room: dict[int, int], work: Workspace, label: str = "") -> DataFrame:
    """node and shard of state after all rounds, with the fewest cut links seen; room is what each shard may take more."""
    held = lambda frame: {r["shard"]: r["n"] for r in frame.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    begin = held(state)
    best_state, least, idle, turn = state, None, 0, 0
    while True:
        votes = links.join(state.withColumnRenamed("node", "b"), "b").groupBy("a", "shard").agg(F.count("*").alias("n"), F.min("b").alias("near"))
        best = votes.groupBy("a").agg(F.max_by(F.struct("shard", "n", "near"), F.struct("n", -F.col("shard"))).alias("top"), F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("by_shard"), F.sum("n").alias("links"))
        own = F.coalesce(F.element_at("by_shard", F.col("shard")), F.lit(0))
        asks = best.join(state, best["a"] == state["node"]).select("node", F.col("shard").alias("old"), F.col("top.shard").alias("new"), (F.col("top.n") - own).alias("gain"), F.col("top.near").alias("near"), (F.col("links") - own).alias("cut"))
        asks = work.save(asks.withColumn("place", F.pmod(F.xxhash64(F.least("node", "near")), F.lit(COARSE)) * FINE + F.pmod(F.xxhash64("node", F.lit(-1)), F.lit(FINE))), f"{label}asks{turn}")
        cut = asks.agg(F.sum("cut")).first()[0] or 0
        if least is None or cut < least:
            best_state, least, idle = state, cut, 0
        else:
            idle += 1
        asks = asks.where(F.col("gain") > 0)
        if idle == PATIENCE or not asks.take(1):
            return best_state
        # A coin or the order of numbers keeps neighbours from swapping.
        free = asks.where(F.pmod(F.xxhash64("node", F.lit(turn + 1)), F.lit(2)) == 0 if turn % 2 == 0 else F.col("node") > F.col("near"))
        # At most shards x shards x COARSE x FINE rows, whatever the input.
        wanted = [(r["n"], r["old"], r["new"], r["place"]) for r in free.groupBy("old", "new", "place").agg(F.count("*").alias("n")).collect()]
        now = held(state)
        taken = admitted(wanted, {s: r + begin.get(s, 0) - now.get(s, 0) for s, r in room.items()})
        turn += 1
        if taken:
            moved = free.join(F.broadcast(work.spark.createDataFrame(taken, "old int, new int, place long")), ["old", "new", "place"]).select("node", "new")
            state = work.save(state.join(moved, "node", "left").select("node", F.coalesce("new", "shard").alias("shard")), f"{label}state{turn}")


def assign(docs: DataFrame, shards: int = 8, links: DataFrame | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: shards whose row counts are at most one apart."""
    spark = docs.sparkSession
    work = Workspace(spark, "shards")
    nodes = work.save(facts(docs, work), "facts")
    if links is not None:
        links = links.where(F.col("a") != F.col("b")).select("a", "b")
        links = work.save(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    total = nodes.count()
    target = {s: total // shards + (s < total % shards) for s in range(shards)}
    limit = total // (shards * LARGE_PARTS)
    grouped = grouped_equals(nodes, target, limit, work) if links is None else grouped_links(nodes, links, target, work)
    item = F.when(F.col("n") > limit, F.col("group")).otherwise(bin_of(limit) * shards + F.col("label"))  # below 0 for bins
    grouped = work.save(grouped.select("node", "doc_id", "size", "text_crc32", "group", "n", "label", F.when(F.col("group").isNotNull(), item).alias("item")), "grouped")
    linked = grouped.where(F.col("item").isNotNull())
    # At most shards x LARGE_PARTS large groups and the bins of each shard.
    items = linked.groupBy("item").agg(F.count("*").alias("n"), F.min("label").alias("label")).collect()
    sizes = {r["item"]: r["n"] for r in items}
    ranges = min(packed(sizes, target, {r["item"]: r["label"] for r in items}), packed(sizes, target), key=len)
    room = dict(target)
    for _, shard, first, last in ranges:
        room[shard] -= last - first
    whole = [(i, s) for i, s, a, e in ranges if e - a == sizes[i]]
    cut = [r for r in ranges if r[3] - r[2] < sizes[r[0]]]  # every such item but the last fills a shard: a few times the shards
    columns = ["node", "doc_id", "size", "text_crc32", "group", "n", "shard"]
    rows = linked.join(F.broadcast(spark.createDataFrame(whole, "item long, shard int")), "item").select(columns)
    if cut:
        parts, _ = numbered(linked.where(F.col("item").isin(sorted({r[0] for r in cut}))), "item", ["group", "node"], work)
        to = F.broadcast(spark.createDataFrame(cut, "item long, shard int, first long, last long"))
        parts = parts.join(to, "item").where((F.col("p") >= F.col("first")) & (F.col("p") < F.col("last")))
        if links is not None:
            parts = work.save(parts, "parts")
            state = propagate(parts.select("node", "shard"), work.save(links.join(parts.select(F.col("node").alias("a")), "a", "left_semi"), "inner"), room, work)
            parts = parts.drop("shard").join(state, "node")
        rows = rows.unionByName(parts.select(columns))
    dealt, below = F.lit(0), 0
    draw = F.pmod(F.xxhash64("node", F.lit(-2)), F.lit(max(1, sum(room.values()))))
    for s in range(shards):
        dealt = F.when(draw >= below, s).otherwise(dealt) if room[s] else dealt
        below += room[s]
    rows = rows.unionByName(grouped.where(F.col("item").isNull()).withColumn("shard", dealt).select(columns))
    # Rows at the end of a shard are the first to leave it.
    placed, held = numbered(rows, "shard", [F.desc(F.coalesce("n", F.lit(0))), "group", "node"], work)
    spare, over_from, gaps = 0, {}, []
    for s in range(shards):
        over_from[s] = spare
        spare += max(0, held[s] - target[s])
    begin = 0
    for s in range(shards):
        if held[s] < target[s]:
            gaps.append((s, begin, held[s]))
            begin += target[s] - held[s]
    lookup = lambda m: F.element_at(F.create_map(*(F.lit(x) for kv in m.items() for x in kv)), F.col("shard"))
    spill = F.col("p") - lookup(target)
    j = spill + lookup(over_from)
    shard, slot = F.col("shard"), F.col("p")
    if gaps:
        to, at = F.lit(None).cast("int"), F.lit(None).cast("long")
        for s, start, filled in gaps:
            to, at = F.when(j >= start, s).otherwise(to), F.when(j >= start, j - start + filled).otherwise(at)
        shard, slot = F.when(spill >= 0, to).otherwise(shard), F.when(spill >= 0, at).otherwise(slot)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
