"""Removal of passages that recur, located with sharded Aho-Corasick automata.

A window is a run of `window` consecutive words. A word goes if a window covers it whose words also start anywhere else.

1. Anchors. The anchor of a window is the least hash among its runs of 8 words, the first of equal ones, so equal windows have
   equal anchors. The windows of a document that share one anchor are a stretch: at most 28 windows, so nothing that
   follows grows with a document's length. Anchors are counted over all documents; other stretches cannot recur.
2. Confirmation. Stretches of equal content (128 bits) are counted. All windows of a stretch that occurs twice recur. Where
   an anchor has stretches of several contents, their windows are counted too, by 128 bits, and each that several have is noted
   at one place only, its source. Whole stretches and shared windows are the phrases; where else they occur is not yet known.
3. Location. The phrases are dealt by anchor over shards of a bounded number of words and compiled into automata over words;
   the stretches of all documents stream through the automata of their anchors, equal ones once, and every
   phrase is found word by word. Phrases of one anchor that overfill a shard are spread over several, which its stretches all
   visit; a shard with much to read is read in slices of bounded size by as many tasks.
4. What was found in a stretch holds wherever the stretch is. Documents lie in blocks of about a megabyte of text, whose places are
   fixed when their stretches are written; a block asks once for each of its distinct stretches, so a passage that
   very many documents share is joined once a block rather than once an occurrence, and the answers meet the stretches of their block.
   Every document is put together from the words that no found phrase covers.

Counts are partial aggregates, and counts are written before anything is joined with them, so that Spark can split the join
on a hot stretch or anchor. No group is gathered whole.

Defined results: null and empty texts have no words and the hash of the empty text; documents shorter than a window stay
whole; repeated rows are occurrences of each other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphlake.llm.workspace import Workspace
from glyphlake.llm.wordstream import hash_words, mix, powers, run_sums, slices, text_bytes

GRAM = 8
SLICE_BYTES = 1_000_000
CHUNK_WORDS = 1_000_000
SHARD_WORDS = 400_000
SLICE_STRETCHES = 100_000
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def window_hashes(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of 64 bits of every run of `window` words."""
    return run_sums(h, window, _BASES[0]), run_sums(mix(h + _C), window, _BASES[1])


def window_anchors(grams: np.ndarray, window: int) -> np.ndarray:
    """Where the anchor of every window lies: the first least one of its runs of 8 words."""
    least, at = grams, np.arange(len(grams))
    span, size = window - GRAM + 1, 1
    while size < span:
        step = min(size, span - size)
        n = len(least) - step
        later = least[step:] < least[:n]
        least, at = np.where(later, least[step:], least[:n]), np.where(later, at[step:], at[:n])
        size += step
    return at


def runs_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of the runs of ascending numbers that follow each other by one."""
    if not len(flags):
        return []
    cut = np.flatnonzero(np.diff(flags) != 1)
    return list(zip(flags[np.concatenate(([0], cut + 1))].tolist(), (flags[np.concatenate((cut, [len(flags) - 1]))] + 1).tolist()))


def stretches(rows: DataFrame, window: int) -> DataFrame:
    """(k1, k2, anchor, s, n, h1, h2, block, asks): the n windows from word s that share an anchor, and the hash of their words.

    block numbers the slice of rows it was read in; asks marks one of each content of a block (of a very long text, of each million words).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers.cache_clear()
        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            data, bounds = text_bytes(batch.column(2))
            for begin, end in slices(bounds, SLICE_BYTES):
                block += 1
                words = hash_words(data[bounds[begin] : bounds[end]], bounds[begin : end + 1] - bounds[begin])
                text = np.repeat(np.arange(end - begin), np.diff(words.first))
                for at in range(0, max(0, len(text) - window + 1), CHUNK_WORDS):
                    h, own = words.hash[at : at + CHUNK_WORDS + window - 1], text[at : at + CHUNK_WORDS + window - 1]
                    grams = run_sums(h, GRAM, _BASES[0])
                    where = window_anchors(grams, window)
                    whole = np.flatnonzero(own[: len(where)] == own[window - 1 :])  # windows inside one text
                    if not len(whole):
                        continue
                    where = where[whole]
                    first = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
                    n = np.diff(np.concatenate((first, [len(where)])))
                    s = whole[first]
                    one, two = window_hashes(h, window)
                    k = n.astype(np.uint64)
                    owner = own[s]
                    to = pa.array(begin + owner)
                    h1 = mix(one[s] * _A + one[s + n - 1] * _B + k)
                    h2 = mix(two[s] * _B + two[s + n - 1] * _A + k)
                    order = np.lexsort((h2, h1))
                    asks = np.ones(len(order), dtype=bool)
                    asks[order[1:]] = (h1[order[1:]] != h1[order[:-1]]) | (h2[order[1:]] != h2[order[:-1]])
                    yield pa.record_batch(
                        [
                            batch.column(0).take(to),
                            batch.column(1).take(to),
                            pa.array(grams[where[first]].view(np.int64)),
                            pa.array((at + s - words.first[owner]).astype(np.int32)),
                            pa.array(n.astype(np.int32)),
                            pa.array(h1.view(np.int64)),
                            pa.array(h2.view(np.int64)),
                            pa.array(np.full(len(s), block)),
                            pa.array(asks),
                        ],
                        names=["k1", "k2", "anchor", "s", "n", "h1", "h2", "block", "asks"],
                    )

    return rows.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, anchor long, s int, n int, h1 long, h2 long, block long, asks boolean")


def texts_of(sources: DataFrame, window: int) -> DataFrame:
    """(id, text): the words of stretches, as they lie in their documents; sources (text, held: array of id, s, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column(0))
            held = batch.column(1)
            for begin, end in slices(bounds, SLICE_BYTES):
                words = hash_words(data[bounds[begin] : bounds[end]], bounds[begin : end + 1] - bounds[begin])
                part = held.slice(begin, end - begin)
                each = part.flatten()
                owner = np.repeat(np.arange(end - begin), part.value_lengths().to_numpy(zero_copy_only=False))
                first = words.first[owner] + each.field("s").to_numpy()
                last = first + each.field("n").to_numpy() + window - 2
                raw = words.data.tobytes()
                text = [raw[b:e].decode() for b, e in zip(words.begin[first].tolist(), words.end[last].tolist())]
                yield pa.record_batch([each.field("id"), pa.array(text, pa.string())], names=["id", "text"])

    return sources.select("text", "held").mapInArrow(run, "id long, text string")


def windows(found: DataFrame, window: int) -> DataFrame:
    """(id, i, w1, w2): the hash of the window i words into each stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column(1))
            for begin, end in slices(bounds, SLICE_BYTES):
                words = hash_words(data[bounds[begin] : bounds[end]], bounds[begin : end + 1] - bounds[begin])
                text = np.repeat(np.arange(end - begin), np.diff(words.first))
                one, two = window_hashes(words.hash, window)
                whole = np.flatnonzero(text[: len(one)] == text[window - 1 :])
                owner = text[whole]
                to = pa.array(begin + owner)
                yield pa.record_batch([batch.column(0).take(to), pa.array((whole - words.first[owner]).astype(np.int32)), pa.array(one[whole].view(np.int64)), pa.array(two[whole].view(np.int64))], names=["id", "i", "w1", "w2"])

    return found.select("id", "text").mapInArrow(run, "id long, i int, w1 long, w2 long")


class Phrases:
    """An automaton over phrases of words.

    Every word of the phrases is a number, written as two characters of alphabets that do not meet, so that a match begins at a
    word and no state has many ways on; words that no phrase has are all written alike.
    """

    OTHER = "\x80\x81"

    def __init__(self) -> None:
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        self.code: dict[bytes, str] = {}

    def add(self, text: str, whole: bool, window: int, places: list[int] | None) -> None:
        """The whole text, and its windows that begin at these words."""
        code = self.code
        out = []
        for word in text.encode().split():
            if word not in code:
                n = len(code)
                code[word] = chr(0x400 + (n >> 8)) + chr(0x200 + (n & 255))
            out.append(code[word])
        flat = "".join(out)
        if whole:
            self.machine.add_word(flat)
        for at in places or ():
            self.machine.add_word(flat[2 * at : 2 * (at + window)])

    def close(self) -> None:
        self.machine.make_automaton()

    def find(self, text: str) -> list[tuple[int, int]]:
        """(begin, end), in words, of the parts of text that phrases cover; parts that only touch stay apart."""
        if not self.code:
            return []
        get, other = self.code.get, self.OTHER
        flat = "".join([get(w, other) for w in text.encode().split()])
        out: list[tuple[int, int]] = []
        for last, length in self.machine.iter(flat):
            end = (last + 1) // 2
            begin = end - length // 2
            while out and out[-1][0] >= begin:
                out.pop()
            if out and begin < out[-1][1]:
                begin = out.pop()[0]
            out.append((begin, end))
        return out


def locate(phrases: DataFrame, streamed: DataFrame, window: int, work: Workspace) -> DataFrame:
    """(id, begin, end): the parts, in words, of the streamed stretches (id, anchor, text) that phrases cover.

    phrases (id, anchor, text, whole, places, n): the text if whole, and its windows at places; n words in all.
    """
    counted = work.save(phrases.groupBy("anchor").agg(F.sum("n").alias("n")), "anchors")
    total = counted.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // SHARD_WORDS))
    salts = counted.select("anchor", F.ceil(F.col("n") / SHARD_WORDS).cast("long").alias("salts"))
    shard = F.pmod(F.xxhash64("anchor", "salt"), F.lit(shards)).alias("shard")
    visits = streamed.join(salts, "anchor").select("id", "text", "anchor", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")).select("id", "text", shard)
    visits = work.save(visits, "visits")
    sliced = visits.groupBy("shard").agg(F.ceil(F.count("*") / SLICE_STRETCHES).cast("int").alias("slices"))
    sliced = work.save(sliced, "slices")
    visits = visits.join(sliced, "shard").withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
    dealt = phrases.join(salts, "anchor").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts"))).select("text", "whole", "places", shard)
    dealt = dealt.join(sliced, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "text", "whole", "places")

    def stream(key: tuple, known: pa.Table, documents: pa.Table) -> pa.Table:
        machine = Phrases()
        for text, whole, places in zip(*(known.column(c).to_pylist() for c in ("text", "whole", "places"))):
            machine.add(text, whole, window, places)
        machine.close()
        ids, found = [], []
        for k, text in zip(documents.column("id").to_pylist(), documents.column("text").to_pylist()):
            parts = machine.find(text)
            found += parts
            ids += [k] * len(parts)
        return pa.table({"id": pa.array(ids, pa.int64()), "begin": pa.array([b for b, _ in found], pa.int32()), "end": pa.array([e for _, e in found], pa.int32())})

    return dealt.groupBy("shard", "slice").cogroup(visits.select("shard", "slice", "id", "text").groupBy("shard", "slice")).applyInArrow(stream, "id long, begin int, end int")


def joined(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of (begin, end), ascending."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(parts):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((begin, end))
    return out


_SPANS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
_STRETCH = ("anchor", "h1", "h2")


def _place(held: pa.Table, found: pa.Table) -> pa.Table:
    """(k1, k2, spans) of the documents of a block: what was found in its distinct stretches, at each place that holds one."""
    known = {key: spans for *key3, spans in zip(*(found.column(c).to_pylist() for c in (*_STRETCH, "spans"))) for key in (tuple(key3),)}
    parts: dict[tuple[int, int], list[tuple[int, int]]] = {}
    if known:
        for k1, k2, s, *key in zip(*(held.column(c).to_pylist() for c in ("k1", "k2", "s", *_STRETCH))):
            for part in known.get(tuple(key), ()):
                parts.setdefault((k1, k2), []).append((s + part["begin"], s + part["end"]))
    spans = [[{"begin": b, "end": e} for b, e in joined(p)] for p in parts.values()]
    return pa.table({"k1": pa.array([k for k, _ in parts], pa.int64()), "k2": pa.array([k for _, k in parts], pa.int64()), "spans": pa.array(spans, _SPANS)})


def spans(docs: DataFrame, window: int, work: Workspace) -> DataFrame:
    """(k1, k2, spans): the parts, in words, that go from each row of docs that has any; k1 and k2 are as key_columns gives them."""
    rows = docs.withColumns(dict(zip(("k1", "k2"), key_columns())))
    every = work.save(stretches(rows, window), "stretches")
    again = work.save(every.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"), "again")
    work.release()  # what counting dealt out goes before all stretches are dealt again
    live = work.save(every.join(again, "anchor", "left_semi"), "live")
    work.drop(every, again)
    work.release()
    # One of each content, with one place to read it; all first() of a group are of one row.
    kinds = live.groupBy("anchor", "h1", "h2").agg(F.count("*").alias("m"), *(F.first(c).alias(c) for c in ("k1", "k2", "s", "n")))
    kinds = work.save(kinds.withColumn("id", F.monotonically_increasing_id()), "kinds")
    held = work.save(kinds.groupBy("k1", "k2").agg(F.collect_list(F.struct("id", "s", "n")).alias("held")), "held")
    read = work.save(texts_of(rows.join(held, ["k1", "k2"]), window).join(kinds.select("id", "anchor", "m", "n"), "id"), "texts")
    work.drop(held)
    work.release()

    # Confirmed phrases: whole stretches that occur twice, and windows that stretches of different content share.
    several = work.save(kinds.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"), "several")
    counted = windows(read.join(several, "anchor", "left_semi"), window).groupBy("w1", "w2").agg(F.count("*").alias("c"), F.min("id").alias("id"), F.min_by("i", "id").alias("i"))
    shared = work.save(counted.where("c > 1").groupBy("id").agg(F.collect_set("i").alias("places")), "shared")
    work.release()
    whole = F.col("m") > 1
    size = F.when(whole, F.col("n") + window - 1).otherwise(0) + window * F.coalesce(F.size("places"), F.lit(0))
    phrases = read.join(shared, "id", "left").where(whole | F.col("places").isNotNull()).select("id", "anchor", "text", whole.alias("whole"), "places", size.alias("n"))
    phrases = work.save(phrases, "phrases")
    work.drop(shared, several)

    found = work.save(locate(phrases, read.select("id", "anchor", "text"), window, work), "found")
    work.drop(phrases, read)
    work.release()
    found = work.save(found.groupBy("id").agg(F.collect_list(F.struct("begin", "end")).alias("spans")).join(kinds.select("id", "anchor", "h1", "h2"), "id").drop("id"), "places")
    asked = live.where("asks").select(*(F.col(c).alias(c) for c in ("block", *_STRETCH)))  # as columns of their own
    answers = asked.join(found, [*_STRETCH])
    held = live.select("block", "k1", "k2", "s", *_STRETCH).groupBy("block")
    placed = held.cogroup(answers.groupBy("block")).applyInArrow(_place, "k1 long, k2 long, spans array<struct<begin: int, end: int>>")
    out = work.save(placed.groupBy("k1", "k2").agg(F.first("spans").alias("spans")), "spans")  # equal rows have equal spans
    work.drop(live, kinds, found)
    work.release()
    return out


def key_columns() -> tuple[Column, Column]:
    """128 bits that tell rows of different id or text apart."""
    return F.xxhash64("text"), F.xxhash64(F.lit(1), "text", "doc_id")


def unused(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    while name in docs.columns:
        name += "_"
    return name


_KEPT = T.StructType([T.StructField("words", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])


def keep(text: str | None, gone: list[dict] | None) -> tuple[str, str | None, int, int]:
    """Of a text: the words outside the spans joined by spaces, the text without the others, and how many words it had and lost."""
    raw = (text or "").encode()
    if not gone:
        words = raw.split()
        return b" ".join(words).decode(), text, len(words), 0
    words = hash_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    edge = np.zeros(len(words.begin) + 1, dtype=np.int64)
    for span in gone:
        edge[span["begin"]] += 1
        edge[span["end"]] -= 1
    cover = np.cumsum(edge[:-1]) > 0
    upto = np.append(words.begin[1:], len(raw))  # what is between a word and the next goes with the word
    stay = runs_of(np.flatnonzero(~cover))
    joined = b" ".join(b" ".join(raw[words.begin[b] : words.end[e - 1]].split()) for b, e in stay)
    left = raw[: words.begin[0]] + b"".join(raw[words.begin[b] : upto[e - 1]] for b, e in stay)
    return joined.decode(), left.decode(), len(cover), int(cover.sum())


@F.arrow_udf(_KEPT)
def _keep(texts: pa.Array, gone: pa.Array) -> pa.Array:
    made = [keep(t, s) for t, s in zip(texts.to_pylist(), gone.to_pylist())]
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
    return pa.StructArray.from_arrays([pa.array([r[k] for r in made], kind) for k, kind in enumerate(kinds)], ["words", "text", "n_words", "n_removed"])


def kept(docs: DataFrame, name: str, window: int = 35) -> DataFrame:
    """docs with a struct column (words, text, n_words, n_removed): the kept words joined by spaces, the text as it was
    but for the words that went and the white space after them, and counts."""
    work = Workspace(docs.sparkSession, "substrings")
    k1, k2, gone = (unused(docs, c) for c in ("k1", "k2", "spans"))
    found = spans(docs.select("doc_id", "text"), window, work).toDF(k1, k2, gone)
    keyed = docs.withColumns(dict(zip((k1, k2), key_columns())))
    return keyed.join(found, [k1, k2], "left").withColumn(name, _keep(F.col("text"), F.col(gone))).drop(k1, k2, gone)


def digests(docs: DataFrame, window: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    found = kept(docs.select("doc_id", "text"), "kept", window)
    return found.select("doc_id", "kept.n_words", "kept.n_removed", F.sha2(F.encode("kept.words", "UTF-8"), 256).alias("kept_sha256"))
