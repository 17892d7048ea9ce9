"""The ten operators against brute force on small tables, with nulls, empty and long texts, ties and repeated rows."""

import base64
import collections
import hashlib
import itertools
import pathlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from glyphlake.llm import bpe, components, isomedia, labelled, licenses, neardup, packing, quality, rabitq, sharding, substrings, superminhash, toxicity, wordstream
from glyphlake.llm.workspace import Workspace

SCHEMA = "doc_id long, text string"
RANKS, JSON, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
ODD = [None, "", " ", "  a", "a ", "a  b\n \n c", "x\n \ny", "\x1cq\x1d \x1er", "don't 'S we'll", "日本語 テキスト", "<|endoftext|> x", "a" * 3000, "=-" * 400, " " * 900, "\t\t \t x", "é́ 🙂🙂"]


def mixed(seed=5, n=60):
    draw = random.Random(seed)
    words = ["ab", "the", "Of", "zq", "ßä", "x1", "!!", "\n", "c-d", "ing"]
    made = [" ".join(draw.choice(words) for _ in range(draw.randint(0, 120))) for _ in range(n)]
    return ODD + made + made[:5]


def docs(spark, texts, **more):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_bpe_is_the_librarys(spark):
    texts = mixed()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = by_id(bpe.encode(docs(spark, texts), RANKS, PATTERN))
    for i, t in enumerate(texts):
        assert found[i]["ids"] == library.encode_ordinary(t or ""), repr(t)[:60]
        assert bytes(found[i]["decoded"]) == (t or "").encode()
    digest = by_id(bpe.digests(docs(spark, texts), RANKS, PATTERN))
    assert digest[0]["ids_sha256"] == hashlib.sha256(b"").hexdigest() and digest[3]["n_tokens"] == len(found[3]["ids"])
    assert bpe.digests(empty(spark), RANKS, PATTERN).count() == 0


def test_long_rows_merge_like_short_ones():
    vocab = bpe.vocabulary(RANKS, PATTERN)
    draw = random.Random(2)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocab.rank, special_tokens={})
    for _ in range(60):
        word = "".join(draw.choice("abcae") for _ in range(draw.randint(257, 900)))
        assert vocab._merge_long(word.encode()).tolist() == library.encode_ordinary(word)
    for word in ("", "a", "ab", "a" * 1001, "ab" * 700, "aab" * 500, "éüa漢" * 300):
        assert vocab._merge_long(word.encode()).tolist() == library.encode_ordinary(word)


def test_packing(spark):
    texts = [*mixed(), "word " * 5000]
    library = Tokenizer.from_file(JSON)
    rows = packing.pack(docs(spark, texts), JSON, PATTERN, per_group=20).collect()
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    seen = collections.Counter()
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        seen.update((r["doc_id"], k) for k in range(r["start"], r["start"] + r["length"]))
    assert seen == collections.Counter((i, k) for i, x in ids.items() for k in range(len(x)))
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for r in group:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert packing.pack(empty(spark), JSON, PATTERN).count() == 0


def test_added_tokens_are_the_librarys(spark):
    library, token, draw = Tokenizer.from_file(JSON), "<|endoftext|>", random.Random(1)
    texts = ["a <|endoftext|> b", token, token * 2, f"x  {token}\n\n{token} ", f"<|{token}|>", "<|endoftext|", None, *("".join(draw.choice(["a", " ", "  ", "\n", token, "b c", "é", "don't"]) for _ in range(30)) for _ in range(100))]
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    assert ids[0] == [64, 220, 50256, 275, 0]
    found = {r["doc_id"]: (r["doc_tokens"], r["ids_crc32"]) for r in packing.pack(docs(spark, texts), JSON, PATTERN, added_tokens=True).collect()}
    assert found == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids.items()}


def test_packing_query_takes_added_tokens(spark, tmp_path):
    from glyphlake.llm.queries import op9_packing

    docs(spark, ["a <|endoftext|> b"]).write.parquet(f"{tmp_path}/documents.parquet")
    assert op9_packing(spark, str(tmp_path)).first()["doc_tokens"] == 5


def test_best_fit_takes_the_tightest_window():
    draw = random.Random(4)
    for _ in range(30):
        lengths = np.array([draw.randint(1, 50) for _ in range(draw.randint(1, 80))])
        window, offset = packing.best_fit_decreasing(lengths, 50)
        rooms: list = []
        for k in np.argsort(-lengths, kind="stable"):
            fits = [w for w, room in enumerate(rooms) if room >= lengths[k]]
            best = min((rooms[w] for w in fits), default=None)
            assert (window[k] == len(rooms)) if best is None else rooms[window[k]] == best
            if best is None:
                rooms.append(50)
            assert offset[k] == 50 - rooms[window[k]]
            rooms[window[k]] -= lengths[k]


def test_media_round_trip(spark):
    texts = [*mixed(), "x" * 70_000]
    found = by_id(isomedia.digests(docs(spark, texts)))
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = found[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload)) and r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
        media = isomedia.write(payload)
        assert r["media_sha256"] == hashlib.sha256(media).hexdigest() and r["media_bytes"] == len(media)
    facts = isomedia.facts(isomedia.store(docs(spark, ["x" * 3000])), "doc_id", "media").first()
    assert (facts["codec"], facts["handler"], facts["samples"], facts["duration"], len(facts["key_sizes"])) == ("raw ", "soun", 47, 47 * 64, 3)
    bad = spark.createDataFrame([(1, None), (2, b"no media"), (3, isomedia.write(bytes(640))[:-90])], "doc_id long, media binary")
    assert all(r["error"] for r in isomedia.facts(bad, "doc_id", "media").collect())


def test_media_tables_of_other_writers():
    """Variable sizes, several runs of chunks, large offsets and no sync table."""
    sizes, chunks = [3, 5, 7, 11, 13], [100, 200, 300]
    box, full = isomedia.box, isomedia.full
    import struct

    tables = {b"stsz": full(b"stsz", struct.pack(">II5I", 0, 5, *sizes)), b"stsc": full(b"stsc", struct.pack(">I6I", 2, 1, 2, 1, 3, 1, 1)), b"co64": full(b"co64", struct.pack(">I3Q", 3, *chunks))}
    data = box(b"stbl", *tables.values())
    places = {p[-1]: (a, e) for p, a, e in isomedia.walk(data) if p[-1] in tables}
    offsets, found, sync = isomedia.sample_ranges(places, data)
    assert offsets.tolist() == [100, 103, 200, 207, 300] and found.tolist() == sizes and sync.all()
    assert isomedia.merged(offsets, found) == [(100, 8), (200, 18), (300, 13)]


def test_nearest_neighbours(spark):
    draw = np.random.default_rng(1)
    vectors = draw.normal(size=(1500, 24)).astype(np.float32) * draw.uniform(0.2, 3, (1500, 1)).astype(np.float32)
    vectors[700:720] = vectors[3]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] + [1.0] * 23), (2003, [None] + [1.0] * 23), (2004, [1.0, 2.0]), (2005, []), (None, [1.0] * 24)]
    found = rabitq.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=20, every=20).collect()
    ranked = collections.defaultdict(dict)
    for r in found:
        ranked[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    exact = vectors.astype(np.float64)
    hits = 0
    assert sorted(ranked) == list(range(0, 1500, 20))
    for q, got in ranked.items():
        scores = exact @ exact[q]
        order = [i for i in np.lexsort((np.arange(1500), -scores)) if i != q][:20]
        assert sorted(got) == list(range(1, 21))
        for i, s in got.values():
            assert s == pytest.approx(scores[i], rel=1e-12, abs=1e-12)
        hits += len({i for i, _ in got.values()} & set(order))
    assert hits / (20 * len(ranked)) >= 0.99
    few = rabitq.search(spark.createDataFrame(rows[:5], "vec_id long, embedding array<float>"))
    assert few.count() == 4
    assert rabitq.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_repeated_queries_and_a_common_vector(spark):
    """A query in equal rows is one query; one id with two vectors asks twice; many vectors may tie."""
    draw = np.random.default_rng(2)
    vectors = draw.normal(size=(600, 70)).astype(np.float32)
    vectors[300:450] = vectors[40]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [rows[20], rows[20], (60, vectors[61].tolist()), rows[77]]
    found = collections.defaultdict(list)
    for r in rabitq.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(found) == list(range(0, 600, 20))
    exact, ids = np.vstack((vectors, vectors[61:62])).astype(np.float64), np.append(np.arange(600), 60)

    def wanted(q, own):
        scores = exact @ q
        return [(n + 1, int(ids[j]), scores[j]) for n, j in enumerate([j for j in np.lexsort((ids, -scores)) if ids[j] != own][:20])]

    hits = total = 0
    for q, got in found.items():
        lists = [wanted(exact[q], q)] + ([wanted(exact[600], 60)] if q == 60 else [])
        assert sorted(x[0] for x in got) == sorted(x[0] for y in lists for x in y)
        best = collections.Counter(x[1] for y in lists for x in y)
        hits += sum((best & collections.Counter(x[1] for x in got)).values())
        total += sum(best.values())
    assert hits / total >= 0.99
    common = sorted(found[40])
    assert [v for _, v, _ in common] == list(range(300, 320))


def test_recall_on_the_real_table(spark):
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.01/embeddings.parquet")
    vectors = np.stack(table["embedding"].to_pylist()).astype(np.float64)
    ids = table["vec_id"].to_numpy()
    found = collections.defaultdict(set)
    for r in rabitq.search(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")).collect():
        found[r["query_id"]].add(r["vec_id"])
    hits = 0
    for at in np.flatnonzero(ids % 20 == 0):
        scores = vectors @ vectors[at]
        scores[at] = -np.inf
        hits += len(found[ids[at]] & set(ids[np.argsort(-scores)[:20]].tolist()))
    recall = hits / (20 * len(found))
    print("recall", recall)
    assert recall >= 0.99


def test_packed_bits_estimate_inner_products():
    draw = np.random.default_rng(4)
    vectors, queries = draw.normal(size=(500, 70)), draw.normal(size=(9, 70))
    codes, size, agree = rabitq.encode(vectors)
    block = rabitq.CodeBlock(np.arange(500), vectors, codes, size, agree)
    estimate, moved = block.estimate(queries)
    signs = np.where(vectors @ rabitq.rotation(70).T > 0, 1, -1) / np.sqrt(70)
    plain = (queries @ rabitq.rotation(70).T) @ signs.T * (size / agree)
    assert (np.abs(estimate - plain) <= moved[:, None] * block.scale + 1e-9).all()
    error = (estimate - queries @ vectors.T) / (np.linalg.norm(queries, axis=1)[:, None] * block.spread)
    assert abs(error.mean()) < 0.1 and np.mean(np.abs(error) < rabitq.EPSILON) > 0.98


def test_shards(spark):
    texts = [f"text {k}" for k in range(1500)] + ["same"] * 900 + ["pair a", "pair a", None, None, ""]
    rows = sharding.assign(docs(spark, texts)).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    shards = collections.defaultdict(list)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        shards[r["shard"]].append(r["slot"])
    counts = [len(s) for s in shards.values()]
    assert len(shards) == 8 and max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    pair = {r["shard"] for r in rows if texts[r["doc_id"]] == "pair a"}
    assert len(pair) == 1
    assert sharding.assign(empty(spark)).count() == 0 and sharding.assign(docs(spark, ["a", "a", None])).count() == 3


@pytest.mark.parametrize("share", [0.05, 0.1, 0.33])
def test_a_large_group_takes_as_few_shards_as_hold_it(spark, share):
    n = 2000
    same = int(n * share)
    texts = ["same"] * same + [f"pair {k // 2}" for k in range(n // 4)] + [f"text {k}" for k in range(n - same - n // 4)]
    rows = sharding.assign(docs(spark, texts)).collect()
    shards = collections.defaultdict(collections.Counter)
    for r in rows:
        shards[texts[r["doc_id"]]][r["shard"]] += 1
    assert len(shards["same"]) == -(-same // (n // 8)) and sum(shards["same"].values()) == same
    assert sum(len(shards[f"pair {k}"]) for k in range(n // 8)) == n // 8
    assert set(collections.Counter(r["shard"] for r in rows).values()) == {n // 8}


def test_all_rows_linked_stay_with_their_groups(spark):
    texts = [f"pair {k // 2}" for k in range(1600)]
    shards = {}
    for r in sharding.assign(docs(spark, texts)).collect():
        shards.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert all(len(s) == 1 for s in shards.values())


def test_groups_below_a_shard_are_whole_and_partitions_do_not_matter(spark):
    """Many groups of many sizes, null and empty texts, and repeated rows."""
    draw = random.Random(31)
    texts = [None, None, "", "", *(f"g{k}" for k in range(60) for _ in range(draw.randint(1, 30)))]
    texts += [f"t{k}" for k in range(2400 - len(texts))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5])] * 3 + [(None, "n")] * 2
    frame = spark.createDataFrame(rows, SCHEMA)
    results = []
    for parts in (1, 5):
        out = sharding.assign(frame.repartition(parts)).collect()
        results.append(sorted((str(r["doc_id"]), r["text_crc32"], r["shard"], r["slot"]) for r in out))
        counts = collections.Counter(r["shard"] for r in out)
        assert max(counts.values()) - min(counts.values()) <= 1
        of = collections.defaultdict(set)
        for r in out:
            of[r["text_crc32"] if r["doc_id"] not in (0, 1) else "null"].add(r["shard"])
        assert all(len(x) == 1 for x in of.values())
    assert results[0] == results[1]


def test_groups_come_to_where_most_of_their_rows_began(spark):
    """With room in every shard, propagation and not the order of sizes decides the shard; so also for given links."""
    texts = [f"g{k % 30}" for k in range(270)] + [f"t{k}" for k in range(1730)]
    frame = docs(spark, texts)
    nodes = sharding.facts(frame, sharding.Workspace(spark, "test")).withColumn("begin", sharding.begins(8)).collect()
    node = {r["doc_id"]: r["node"] for r in nodes}
    begun, clique = collections.defaultdict(collections.Counter), collections.defaultdict(list)
    for r in nodes:
        if r["doc_id"] < 270:
            begun[texts[r["doc_id"]]][r["begin"]] += 1
            clique[texts[r["doc_id"]]].append(node[r["doc_id"]])
    links = spark.createDataFrame([(a, b) for c in clique.values() for a in c for b in c if a < b], "a long, b long")
    for given in (None, links):
        came = collections.defaultdict(set)
        for r in sharding.assign(frame, 8, given).collect():
            if r["doc_id"] < 270:
                came[texts[r["doc_id"]]].add(r["shard"])
        assert all(len(s) == 1 for s in came.values())
        follow = sum(begun[t][next(iter(s))] == max(begun[t].values()) for t, s in came.items())
        assert follow == 30 if given is None else follow >= 20, follow


def test_rounds_over_counts_keep_the_quotas(spark):
    work = sharding.Workspace(spark, "test")
    votes = [(0, 6, [4, 2, 0]), (10, 4, [0, 3, 1]), (20, 5, [2, 1, 2]), (30, 3, [0, 1, 2])]
    rows = spark.createDataFrame(votes, "group long, n long, votes array<long>")
    for spare in (0, 1, 9):
        target = {s: sum(v[s] for _, _, v in votes) + spare for s in range(3)}
        after = {r["group"]: list(r["votes"]) for r in sharding.gathered(rows, target, 0, work).collect()}
        assert all(sum(after[g]) == n for g, n, _ in votes) and set(after) == {g for g, _, _ in votes}
        assert sum(x > 0 for v in after.values() for x in v) <= sum(x > 0 for _, _, v in votes for x in v)
    assert all(max(v) == sum(v) for v in after.values())  # with room for all, every group is whole


def test_links_inside_a_group_over_one_shard(spark):
    """A ring of 40 cliques: one component, which the rounds must cut between cliques and not through them."""
    frame = docs(spark, [f"t {k}" for k in range(400)]).repartition(1).sortWithinPartitions("doc_id")
    order = [r["doc_id"] for r in frame.collect()]
    draw = random.Random(3)
    member = list(range(400))
    draw.shuffle(member)
    links = [(member[10 * c + i], member[10 * c + j]) for c in range(40) for i in range(10) for j in range(i)] + [(member[10 * c], member[(10 * c + 10) % 400]) for c in range(40)]
    found = {r["doc_id"]: r["shard"] for r in sharding.assign(frame, 4, spark.createDataFrame(links, "a long, b long")).collect()}
    assert set(collections.Counter(found.values()).values()) == {100}
    cut = sum(found[order[a]] != found[order[b]] for a, b in links)
    assert cut < 0.5 * len(links)  # at random it is three quarters


def shingles(text, size):
    words = (text or "").encode().lower().split()
    n = min(size, len(words))
    return frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) if words else frozenset()


def expected_groups(texts, size):
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    found = [shingles(t, size) for t in texts]
    for i, j in itertools.combinations(range(len(texts)), 2):
        if found[i] and found[j] and 100 * len(found[i] & found[j]) >= 80 * len(found[i] | found[j]):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], [len(f) for f in found]


def near_copies(seed, n, words, edits):
    draw = random.Random(seed)
    base = [f"w{draw.randint(0, 5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(draw.randint(0, edits)):
            copy[draw.randrange(len(copy))] = f"e{draw.randint(0, 10**6)}"
        out.append(" ".join(copy))
    return out


def test_near_duplicate_groups(spark):
    texts = [None, "", "  ", "a", "A", "a b", "a b c", "a b c d", "a b c d e", *near_copies(1, 40, 120, 9), *near_copies(2, 30, 60, 4), *near_copies(3, 3, 4000, 40), "x y " * 50]
    texts += texts[9:14]
    wanted, sizes = expected_groups(texts, 4)
    found = by_id(neardup.group(docs(spark, texts), 4))
    for i in range(len(texts)):
        assert (found[i]["n_shingles"], found[i]["component_id"], found[i]["kept"]) == (sizes[i], wanted[i], wanted[i] == i), i
    assert neardup.group(empty(spark), 4).count() == 0


def test_buckets_without_a_common_neighbour_are_compared_in_full(spark):
    """Chains: neighbours are similar, the smallest of a bucket is often similar to few of its members."""
    draw = random.Random(23)
    words = [f"w{draw.randint(0, 10**6)}" for _ in range(200)]
    texts = []
    for _ in range(60):
        texts.append(" ".join(words))
        words = [w if draw.random() > 0.03 else f"e{draw.randint(0, 10**6)}" for w in words]
    draw.shuffle(texts)
    found = by_id(neardup.group(docs(spark, texts), 4))
    assert [found[i]["component_id"] for i in range(len(texts))] == expected_groups(texts, 4)[0]
    with pytest.raises(TypeError):
        neardup.group(docs(spark, texts).withColumn("doc_id", F.col("doc_id").cast("string")), 4)


def test_blocks_of_a_large_cluster_give_the_same_groups(spark, monkeypatch):
    texts = near_copies(7, 60, 80, 10)
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 7)
    found = by_id(neardup.group(docs(spark, texts), 4))
    assert [found[i]["component_id"] for i in range(len(texts))] == expected_groups(texts, 4)[0]


def test_keep_first_leaves_only_the_ids_that_it_reads(spark):
    """What grouping wrote goes before the next stage of a pipeline writes its own."""
    root = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(root.glob("*"))
    kept = neardup.keep_first(docs(spark, ["a b c d e f", "a b c d e f", "g h i j k l", None]), 5)
    assert [p.name.split("-")[0] for p in set(root.glob("*")) - before] == ["keep"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3]


def test_keep_first_with_null_and_repeated_ids(spark):
    one = near_copies(4, 1, 50, 0)[0]
    rows = [(None, one, 1), (None, one, 2), (5, one, 3), (5, one, 4), (9, one, 5), (7, "other words here now", 6)]
    kept = neardup.keep_first(spark.createDataFrame(rows, "doc_id long, text string, _rank int"), 5)
    assert kept.columns == ["doc_id", "text", "_rank"]
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, -1, 5, 7]


def test_signatures_estimate_similarity():
    draw = np.random.default_rng(3)
    errors = []
    for _ in range(60):
        size, shared = int(draw.integers(20, 400)), draw.uniform(0, 1)
        both = draw.integers(0, 2**63, int(size * shared) + 1, dtype=np.uint64)
        a, b = (np.unique(np.concatenate((both, draw.integers(0, 2**63, size - len(both) + 1, dtype=np.uint64)))) for _ in range(2))
        signed = superminhash.signatures([a, b, np.zeros(0, np.uint64)])
        errors.append((signed[0] == signed[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert (signed[2] == np.uint64(2**64 - 1)).all()
        assert len({x >> np.uint64(32) for x in signed[0]}) >= 1
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_components(spark):
    draw = random.Random(6)
    links = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(5001, 5200)] + [(None, 3), (7, 7)]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long").repartition(5), Workspace(spark, "test")).collect()}
    union = components.UnionFind()
    for a, b in links:
        if a is not None and a != b:
            union.union(a, b)
    assert found == {x: union.find(x) for x in union.parent}


def test_components_do_not_end_early(spark):
    draw = random.Random(9)
    order = list(range(400))
    draw.shuffle(order)
    chain = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long").repartition(8)
    with pytest.raises(RuntimeError):
        components.components(chain, Workspace(spark, "test"), most_rounds=1)
    found = components.components(chain, Workspace(spark, "test")).collect()
    assert len(found) == 400 and {r["component"] for r in found} == {0}


def expected_kept(texts, window):
    words = [(t or "").encode().split() for t in texts]
    counts = collections.Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if counts[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return out


def test_recurring_passages(spark):
    draw = random.Random(8)
    fresh = lambda n: " ".join(f"u{draw.randint(0, 10**9)}" for _ in range(n))
    passage, short = fresh(60), fresh(34)
    texts = [None, "", "few words", passage, f"{fresh(50)} {passage} {fresh(40)}", f"{fresh(5)}\n{passage}", passage.upper(), short, f"{fresh(9)} {short} {fresh(9)}", "For " * 90, "a b c d e f g " * 20, " ".join(passage.split()[10:50]) + " " + fresh(30), fresh(20_000), f"{passage} {passage}", fresh(80).replace(" ", "  \t"), *near_copies(11, 12, 150, 3)]
    texts += [texts[-1], texts[12]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, passage), (None, fresh(70))]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.digests(frame).collect())
    assert found == collections.Counter((i, *x) for (i, _), x in zip(rows, expected_kept([t for _, t in rows], 35)))
    assert substrings.digests(empty(spark)).count() == 0
    named = frame.withColumns({"spans": F.lit(1), "k1": F.lit("x"), "kept": F.lit(True)})
    assert substrings.kept(named, "out").columns == [*named.columns, "out"]


def test_automata_find_every_occurrence():
    machine = substrings.Phrases()
    machine.add("a b c d", False, 3, [0, 1])
    machine.add("x y z q r", True, 3, [2])
    machine.close()
    assert machine.find("a b  c\nd x y z q r z q") == [(0, 4), (4, 9)]
    assert machine.find("z q r a b c b c d") == [(0, 3), (3, 6), (6, 9)]
    assert machine.find("aa b c b c dd x y z q") == [] and machine.find("") == []
    nothing = substrings.Phrases()
    nothing.close()
    assert nothing.find("a b c") == []


def test_small_shards_and_slices_find_the_same(spark, monkeypatch):
    """Phrases of one anchor over several shards, stretches of one shard over several slices, documents in chunks."""
    for name, value in {"SHARD_WORDS": 200, "SLICE_STRETCHES": 3, "CHUNK_WORDS": 40, "SLICE_BYTES": 500}.items():
        monkeypatch.setattr(substrings, name, value)
    draw = random.Random(18)
    line = " ".join(f"c{k}" for k in range(12))
    texts = [f"{' '.join(f'u{draw.randint(0, 40)}' for _ in range(30))} {line} {' '.join(f'u{draw.randint(0, 3)}' for _ in range(30))}" for _ in range(12)]
    texts += [texts[0] + " tail", "x " + texts[1], *near_copies(19, 8, 120, 3), "a b c " * 60]
    found = by_id(substrings.digests(docs(spark, texts)))
    assert [(found[i]["n_words"], found[i]["n_removed"], found[i]["kept_sha256"]) for i in range(len(texts))] == expected_kept(texts, 35)


def test_known_features_are_all_features_that_are_wanted():
    draw = random.Random(23)
    tokens = ["".join(draw.choice("abcé_²x-日̀$") for _ in range(draw.randint(0, 16))) for _ in range(3000)]
    words = {w for t in tokens for w in toxicity.WORD.findall(t)}
    assert all(toxicity.words_of(t) == toxicity.WORD.findall(t) for t in tokens)
    wanted = set(draw.sample(sorted({f for w in words for f in toxicity.features(w)}), 400))
    known, weight = toxicity.Known(wanted), {f: 0.5 + len(f) for f in wanted}
    assert all(known(w) == [f for f in toxicity.features(w) if f in wanted] for w in words)
    scores = toxicity.Scores(weight)
    assert all(scores[t] == sum(max((weight.get(f, 0.0) for f in toxicity.features(w))) for w in toxicity.WORD.findall(t)) for t in tokens)


def test_a_passage_of_most_documents_is_asked_for_once_a_block(spark):
    """One passage in 300 documents over several blocks, two of them equal rows, and documents that hold it several times."""
    draw = random.Random(22)
    fresh = lambda n: " ".join(f"u{draw.randint(0, 10**9)}" for _ in range(n))
    passage = fresh(90)
    texts = [f"{fresh(draw.randint(0, 9))} {passage} {fresh(draw.randint(0, 50))}" for _ in range(300)] + [f"{passage} {fresh(3)} {passage}", fresh(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])] * 2
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.digests(frame).collect())
    assert found == collections.Counter((i, *x) for (i, _), x in zip(rows, expected_kept([t for _, t in rows], 35)))
    every = substrings.stretches(frame.withColumns(dict(zip(("k1", "k2"), substrings.key_columns()))), 35)
    kinds = every.select("block", "anchor", "h1", "h2")
    assert every.where("asks").count() == kinds.distinct().count() < kinds.count()
    assert substrings.joined([(5, 9), (1, 3), (8, 12), (3, 4), (20, 21)]) == [(1, 4), (5, 12), (20, 21)] and substrings.joined([]) == []


def test_a_long_document_twice_is_many_stretches(spark):
    draw = random.Random(20)
    long = " ".join(f"w{draw.randint(0, 10**7)}" for _ in range(400_000))
    found = by_id(substrings.digests(docs(spark, [long, "before " + long + " after", "other words"])))
    assert [(found[i]["n_words"], found[i]["n_removed"]) for i in range(3)] == [(400_000, 400_000), (400_002, 400_000), (2, 0)]


def test_text_stays_as_it_is_but_for_what_goes(spark):
    passage = " ".join(f"p{k}" for k in range(40))
    texts = [f"  one\n\ttwo \n{passage}\n\nthree  four ", passage.replace(" ", "\n"), " a\n b ", None, ""]
    rows = by_id(substrings.kept(docs(spark, texts), "out").select("doc_id", "out.*"))
    assert [rows[i]["text"] for i in range(5)] == ["  one\n\ttwo \nthree  four ", "", " a\n b ", None, ""]
    assert [rows[i]["words"] for i in range(5)] == ["one two three four", "", "a b", "", ""]


def test_hashed_words_are_the_words():
    import pyarrow as pa

    draw = random.Random(21)
    texts = [None, "", " ", "x" * 200 + " y", *("".join(draw.choice(["a", "b", " ", "\n", "é", "Z", "\t", "q" * 70, "\x1c"]) for _ in range(draw.randint(0, 200))) for _ in range(100))]
    data, bounds = wordstream.text_bytes(pa.array(["cut", *texts]).slice(1))
    for lower in (False, True):
        words, seen = wordstream.hash_words(data, bounds, lower), {}
        for k, t in enumerate(texts):
            own = ((t or "").encode().lower() if lower else (t or "").encode()).split()
            here = range(words.first[k], words.first[k + 1])
            assert len(here) == len(own)
            for word, j in zip(own, here):
                assert seen.setdefault(word, words.hash[j]) == words.hash[j]
                assert len(word) == words.end[j] - words.begin[j]
        assert len(set(seen.values())) == len(seen)


def labelled_docs(spark, n=700, seed=12):
    """Clean prose, toxic documents with insults of their own, and junk of repeated or shouted words."""
    draw = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in ("ta", "re", "mi", "so", "lu") for b in ("ne", "ro", "ka") for c in ("n", "s", "le", "t")]
    rows, labels = [(n, None), (n + 1, ""), (n + 2, "long " * 60_000)], []
    for i in range(n):
        words = [draw.choice(vocabulary) for _ in range(draw.randint(15, 120))]
        toxic, good = int(draw.random() < 0.2), int(draw.random() < 0.7)
        if not good:
            words = [w.upper() + "!!" for w in words] if draw.random() < 0.5 else [words[0]] * len(words)
        if toxic:
            for _ in range(max(2, len(words) // 12)):
                words.insert(draw.randrange(len(words)), draw.choice(["grobnik", "vilfusk", "snarlak"]))
        rows.append((i, " ".join(words)))
        labels.append((i, good, toxic))
    labels += [(None, 1, 1), (3, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: (q, t) for i, q, t in labels if i is not None and q is not None}


@pytest.mark.parametrize("module, at, threshold", [(quality, 0, 0.7), (toxicity, 1, 0.3)])
def test_classifiers_hold_out(spark, module, at, threshold):
    frame, labels, truth = labelled_docs(spark)
    found = by_id(module.score(frame, labels))
    assert len(found) == 703 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold) for r in found.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in found.items())
    held = [(found[i]["predicted"], y[at]) for i, y in truth.items() if found[i]["held_out"]]
    assert len(held) > 100 and np.mean([a == b for a, b in held]) > 0.95
    # Held-out labels do not matter.
    turned = labels.withColumns({c: F.when(labelled.held_out(F.col("doc_id")), 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    again = by_id(module.score(frame, turned))
    assert max(abs(again[i]["score"] - r["score"]) for i, r in found.items()) < 1e-6
    none = module.score(frame.limit(5), labels.where("false"))
    assert none.count() == 5
    assert module.score(empty(spark), labels).count() == 0


def test_maximal_segments_are_ruzzo_and_tompas():
    def plain(scores):
        """The definition: the best segment, then the same left and right of it."""
        if not any(s > 0 for s in scores):
            return []
        sums = np.concatenate(([0], np.cumsum(scores)))
        value, length, begin, end = max((sums[j] - sums[i], -(j - i), i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))
        return [*plain(scores[:begin]), (begin, end), *[(a + end, b + end) for a, b in plain(scores[end:])]]

    draw = random.Random(1)
    for _ in range(200):
        scores = [draw.choice([-1.0, -1.0, -1.0, 1.3, 2.7]) for _ in range(draw.randint(0, 25))]
        at = [k for k, s in enumerate(scores) if s > 0]
        assert [(b, e) for b, e, _ in toxicity.maximal_segments(at, [scores[k] for k in at], 1.0)] == plain(scores)


def test_extreme_value_law_of_known_scores(spark):
    """Tokens that score 4 with probability 0.01 and -0.15 else: lambda solves the textbook equation, maxima follow the law."""
    draw = random.Random(30)
    texts = [" ".join("bad" if draw.random() < 0.01 else "fine" for _ in range(200)) for _ in range(3000)]
    labelled_rows = spark.createDataFrame([(t, 0) for t in texts] + [("bad " * 50, 1), (None, 0), ("", 0)], "text string, label int")
    model = toxicity.Model(weight={"bad$": 4.0}, drift=0.15)
    toxicity.fit_extremes(model, labelled_rows.repartition(3))
    share = sum(t.split().count("bad") for t in texts) / (200 * len(texts))
    assert abs(share * np.exp(4 * model.decay) + (1 - share) * np.exp(-0.15 * model.decay) - 1) < 1e-6
    assert abs(model.decay - 0.54) < 0.03
    scores = toxicity.Scores(model.weight)
    best = np.array([max((s for _, _, s in model.segments(t, scores)[1]), default=0.0) for t in texts])
    excess = model.decay * best - model.log_k - np.log(200)
    for at in (1.0, 2.0, 3.0):
        assert abs((excess > at).mean() - (1 - np.exp(-np.exp(-at)))) < 0.08
    same = toxicity.Model(weight={"other$": 1.0})
    toxicity.fit_extremes(same, labelled_rows)
    assert (same.decay, same.log_k) == (1.0, 0.0)


def test_repeated_rows_score_alike(spark):
    frame, labels, _ = labelled_docs(spark, 200)
    twice = frame.unionByName(frame.where("doc_id < 50"))
    for module in (quality, toxicity):
        found = collections.defaultdict(set)
        for r in module.score(twice, labels).collect():
            found[r["doc_id"]].add(r["score"])
        assert len(found) == 203 and all(max(x) - min(x) < 1e-5 for x in found.values())


def test_toxic_passages(spark):
    model = toxicity.Model(weight={"bad$": 4.0}, drift=0.5)
    text = "fine " * 30 + "bad bad word bad " + "fine " * 30
    row = toxicity.passages(docs(spark, [text, None, ""]), model).collect()
    assert [(r["doc_id"], r["begin"], r["end"]) for r in row] == [(0, 30, 34)]


def test_licenses(spark):
    texts = [None, "", "nothing here " * 50, "Some words. Released under the MIT License. More words.", "x\nLICENSED UNDER THE APACHE LICENSE, VERSION 2.0\ny", "This work is licensed under the GNU General Public Licence, version 3.", "Copyright (c) 2020 Some Body. All rights reserved.", "licensed under a bridge", "All rights\nreserved. " + "z " * 20_000 + "Licensed under CC BY-NC 4.0."]
    found = by_id(licenses.notices(docs(spark, texts)))
    names = {i: [n["license"] for n in r["notices"]] for i, r in found.items()}
    assert names == {0: [], 1: [], 2: [], 3: ["MIT"], 4: ["Apache-2.0"], 5: ["GPL-3.0"], 6: ["copyright"], 7: [], 8: ["all-rights-reserved", "CC-BY-NC-4.0"]}
    assert [(d["op"], d["template"], d["found"]) for d in found[5]["notices"][0]["differences"]] == [("replace", "license", "licence")]
    assert found[3]["notices"][0]["differences"] == [] and texts[3][found[3]["notices"][0]["start"] : found[3]["notices"][0]["stop"]] == "Released under the MIT License"
    assert licenses.summary(empty(spark)).count() == 0


@pytest.mark.parametrize(
    "text, wrong",
    [
        ("Released under the BSD License.", "MIT"),
        ("Released under the ISC License.", "MIT"),
        ("Licensed under CC BY-SA 4.0.", "CC-BY-NC-4.0"),
        ("Licensed under CC BY 4.0.", "CC-BY-NC-4.0"),
        ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-4.0"),
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-3.0"),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", "GPL-3.0"),
        ("This work is licensed under the GNU Affero General Public License, version 3.", "GPL-3.0"),
        ("Licensed under the Apache License, Version 1.1.", "Apache-2.0"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "CC-BY-SA-4.0"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "CC-BY-4.0"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 International License.", "CC-BY-SA-4.0"),
    ],
)
def test_another_licence_is_not_confirmed(text, wrong):
    assert wrong not in [n["license"] for n in licenses.Scanner(licenses.TEMPLATES).scan(f"Some words. {text} More words.")[1]]


@pytest.mark.parametrize("text, name", [("Licensed under the Apache License, version 2", "Apache-2.0"), ("This work is licenced under the GNU General Public License, version 3.0", "GPL-3.0")])
def test_spellings_of_one_licence_are_confirmed(text, name):
    assert [n["license"] for n in licenses.Scanner(licenses.TEMPLATES).scan(f"{text}. More words.")[1]] == [name]


def test_every_template_is_found_whole_and_with_small_changes(spark):
    """Each licence in the middle of other words, as it is, in lower case over several lines, and with one plain word changed."""
    scanner = licenses.Scanner(licenses.TEMPLATES)
    plain = {"software", "files", "materials", "program", "file", "following", "work", "released", "warranty", "form", "extent"}
    for name, text in licenses.TEMPLATES.items():
        if licenses.HOLDER in text:
            continue
        changed = text.split()
        at = next((k for k, w in enumerate(changed) if w.lower().strip(".,") in plain and k > 5), None)
        forms = [text, text.lower().replace(" ", "\n  ", 5)]
        if at is not None and len(changed) >= licenses.LONG:
            forms.append(" ".join([*changed[:at], "thing", *changed[at + 1 :]]))
        for k, form in enumerate(forms):
            found = [n["license"] for n in scanner.scan(f"Before it stand words. {form} After it stand more.")[1]]
            # A shorter notice of the same licence without a wrong word goes before a longer one with one.
            assert name in found if k < 2 else name.split("-")[0] in [n.split("-")[0] for n in found], (name, form[:60], found)


def brute_notices(text):
    """Every run of words of a template's length, judged one by one: the names that any of them is confirmed as."""
    scanner = licenses.Scanner(licenses.TEMPLATES)
    words = licenses.words_of(text)
    out = set()
    for length in sorted({len(w) for w in scanner.words.values()}):
        for k in range(len(words) - length + 1):
            judged = scanner.judge(text[words[k][1] : words[k + length - 1][2]])
            if judged and judged[2] == 0:
                out.add((judged[0], words[k][1], words[k + length - 1][2]))
    return out


def test_notices_are_those_of_a_scan_of_all_blocks(spark):
    draw = random.Random(40)
    names = [n for n, t in licenses.TEMPLATES.items() if licenses.HOLDER not in t and len(t) < 200]
    for _ in range(4):
        parts = []
        for _ in range(3):
            parts += [" ".join(draw.choice(["the", "work", "is", "under", "license", "of", "house"]) for _ in range(8)), licenses.TEMPLATES[draw.choice(names)]]
        text = ". ".join(parts)
        exact = brute_notices(text)
        for notice in licenses.Scanner(licenses.TEMPLATES).scan(text)[1]:
            if not notice["differences"]:
                assert (notice["license"], notice["start"], notice["stop"]) in exact
        found = licenses.Scanner(licenses.TEMPLATES).scan(text)[1]
        for name, begin, end in exact:  # each exact one is reported or lies below one that is
            assert any(n["start"] < end and begin < n["stop"] for n in found), name


def test_license_rows_repeat_and_long_texts_are_scanned(spark):
    long = "z " * 150_000 + "Released under the MIT License. " + "y " * 150_000
    rows = [(1, long), (1, long), (2, "Released under the MIT License. Released under the MIT License.")]
    found = licenses.summary(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"], r["licenses"], len(r["spans"].split(","))) for r in found) == [(1, "MIT", 1), (1, "MIT", 1), (2, "MIT", 2)]
