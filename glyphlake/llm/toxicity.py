"""Toxic passages as maximum-scoring segments of token log-odds.

Fitting. Features of a word are the word itself and its prefixes. For each, the log-odds between labelled toxic
and other documents are smoothed by a Dirichlet prior proportional to the feature's document frequency in the
whole corpus, and only the lower confidence bound counts. A token scores the best bound among its features,
less a drift that makes ordinary text lose.

Scoring. One linear scan per document finds every maximal scoring segment. Scores are put on the scale of
extreme-value statistics (Karlin and Altschul): lambda solves E[exp(lambda s)] = 1 over the scores of all tokens of
documents that are not toxic, K is fitted to their best segments, and a segment of score s in n tokens has evidence
lambda s - ln(K n). The evidence of all significant segments is summed and turned into a probability by a
logistic curve that was fitted on labelled rows which the log-odds had not seen.

Bounds: log-odds come from at most LABELLED_ROWS rows and are kept for at most MOST_FEATURES features, those of most toxic
documents; token scores reach the driver as a histogram in steps of 0.001, documents as two numbers each.

Defined results: null and empty texts have no segments and the score of no evidence; texts of any length are
scanned whole; repeated rows repeat; without labels of both kinds every document has the same score.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.llm.labelled import held_out, training_sample

WORD = re.compile(r"\w+")
SHORTEST_PREFIX, LONGEST_PREFIX = 4, 12
LABELLED_ROWS = 40_000
MOST_FEATURES = 100_000
STEPS = 1000  # of a token score, for the histogram
LEAST_TOXIC_DOCUMENTS = 3
PRIOR_SHARE = 0.5
BOUND_SIGMAS = 1.64
DRIFT = 0.15
CACHE_TOKENS = 500_000


def features(word: str) -> list[str]:
    """The word, marked by its end, and its prefixes."""
    return [word + "$", *(word[:k] for k in range(SHORTEST_PREFIX, min(LONGEST_PREFIX, len(word)) + 1))]


def words_of(token: str) -> list[str]:
    """The words of a white-space token."""
    return [token] if token.isalnum() else WORD.findall(token)


class Known:
    """The features of a word that are among those wanted; few words share their first letters with any, so prefixes are rarely cut."""

    def __init__(self, wanted: Collection[str]) -> None:
        self.wanted = wanted
        self.stems = {f[:SHORTEST_PREFIX] for f in wanted if not f.endswith("$")}

    def __call__(self, word: str) -> list[str]:
        wanted, whole = self.wanted, word + "$"
        found = [whole] if whole in wanted else []
        if word[:SHORTEST_PREFIX] in self.stems:
            found += [p for k in range(SHORTEST_PREFIX, min(LONGEST_PREFIX, len(word)) + 1) if (p := word[:k]) in wanted]
        return found


def maximal_segments(at: list[int], gain: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score) of a sequence, after Ruzzo and Tompa.

    Tokens at the ascending places `at` score `gain` > 0, all others -drift; a segment starts and ends at a
    place that gains. Linear in the number of places: each is pushed and popped at most once.
    """
    kept: list[tuple[int, int, float, float]] = []  # begin, end, total before, total after
    total = 0.0
    previous = -1
    for place, score in zip(at, gain):
        total -= drift * (place - previous - 1)
        previous = place
        begin, before = place, total
        total += score
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= before:
                j -= 1
            if j < 0 or kept[j][3] >= total:
                kept.append((begin, place + 1, before, total))
                break
            begin, before = kept[j][0], kept[j][2]
            del kept[j:]
    return [(b, e, after - before) for b, e, before, after in kept]


class Scores(dict):
    """Score of a white-space token: the sum over its words of the best feature; filled on demand."""

    def __init__(self, weight: dict[str, float]) -> None:
        super().__init__()
        self.weight = weight
        self.known = Known(weight)

    def __missing__(self, token: str) -> float:
        score = sum((max(map(self.weight.__getitem__, found)) for w in words_of(token) if (found := self.known(w))), 0.0)
        if len(token) <= 64:
            self[token] = score
        return score

    def trim(self) -> None:
        if len(self) > CACHE_TOKENS:
            self.clear()


@dataclass
class Model:
    weight: dict[str, float] = field(default_factory=dict)
    drift: float = DRIFT
    decay: float = 1.0  # lambda of the extreme-value law
    log_k: float = 0.0
    slope: float = 0.0
    intercept: float = 0.0

    def segments(self, text: str, scores: Scores) -> tuple[int, list[tuple[int, int, float]]]:
        tokens = text.lower().split()
        gain = np.fromiter(map(scores.__getitem__, tokens), np.float64, len(tokens))
        at = np.flatnonzero(gain)
        return len(tokens), maximal_segments(at.tolist(), gain[at].tolist(), self.drift)

    def evidence(self, n: int, segments: list[tuple[int, int, float]]) -> float:
        """The summed evidence of the significant segments, in nats."""
        floor = self.log_k + math.log(n) if n else 0.0
        return sum(max(0.0, self.decay * s - max(0.0, floor)) for _, _, s in segments)

    def probability(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-(self.slope * math.log1p(evidence) + self.intercept)))


def _weights(counts: dict[str, list[float]], background: dict[str, int], n_docs: int, n1: float, n0: float) -> dict[str, float]:
    """Lower bounds of the smoothed log-odds, where positive. counts: toxic and other documents with the feature."""
    out = {}
    for feature, (y1, y0) in counts.items():
        share = PRIOR_SHARE * max(background.get(feature, 0), y1 + y0) / max(n_docs, 1)
        a1, a0 = y1 + share * n1, y0 + share * n0
        size1, size0 = n1 * (1 + PRIOR_SHARE), n0 * (1 + PRIOR_SHARE)
        odds = math.log(a1 / max(size1 - a1, 0.5)) - math.log(max(a0, 1e-9) / max(size0 - a0, 0.5))
        bound = odds - BOUND_SIGMAS * math.sqrt(1 / a1 + 1 / max(a0, 1e-9))
        if bound > 0.3:
            out[feature] = bound
    return out


class TokenFeatures(dict):
    """Features of a white-space token, by a function of its words; filled on demand."""

    def __init__(self, of: Callable[[str], list[str]]) -> None:
        super().__init__()
        self.of = of

    def __missing__(self, token: str) -> list[str]:
        found = [f for w in words_of(token) for f in self.of(w)]
        if len(self) >= CACHE_TOKENS:
            self.clear()
        if len(token) <= 64:
            self[token] = found
        return found


def _document_frequencies(docs: DataFrame, wanted: set[str] | None, by: list[str]) -> DataFrame:
    """(feature, *by, n): documents with each feature, counted within each task and then over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, Counter] = defaultdict(Counter)
        held = TokenFeatures(features if wanted is None else Known(wanted))
        for batch in batches:
            keys = list(zip(*(batch.column(1 + k).to_pylist() for k in range(len(by))))) or [()] * batch.num_rows
            for text, key in zip(batch.column(0).to_pylist(), keys):
                counts[key].update(set(chain.from_iterable(map(held.__getitem__, set((text or "").lower().split())))))
            if sum(map(len, counts.values())) > (400_000 if wanted is None else 1_000_000):
                yield _counted(counts, len(by))
                counts.clear()
        yield _counted(counts, len(by))

    fields = "".join(f", `{c}` {dict(docs.dtypes)[c]}" for c in by)
    return docs.select("text", *by).mapInArrow(run, f"feature string{fields}, n long").groupBy("feature", *by).agg(F.sum("n").alias("n"))


def _counted(counts: dict[tuple, Counter], keys: int) -> pa.RecordBatch:
    names = [f for c in counts.values() for f in c]
    more = [[key[j] for key, c in counts.items() for _ in c] for j in range(keys)]
    kinds = [pa.int32(), pa.bool_()][:keys]
    n = [n for c in counts.values() for n in c.values()]
    return pa.record_batch([pa.array(names, pa.string()), *(pa.array(m, t) for m, t in zip(more, kinds)), pa.array(n, pa.int64())], names=["feature", *("label", "calibrate")[:keys], "n"])


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", bound: int = LABELLED_ROWS) -> Model:
    """A model from at most `bound` labelled rows and the document frequencies of the whole corpus."""
    sample = F.broadcast(training_sample(labels, column, bound))
    labelled = docs.select("doc_id", "text").join(sample, "doc_id")
    sizes = {(r["label"], r["calibrate"]): r["n"] for r in labelled.groupBy("label", "calibrate").agg(F.count("*").alias("n")).collect()}
    if not all(sum(sizes.get((y, c), 0) for c in (False, True)) for y in (0, 1)):
        rate = 0.5 if not sizes else min(0.99, max(0.01, sum(n for (y, _), n in sizes.items() if y) / sum(sizes.values())))
        return Model(intercept=math.log(rate / (1 - rate)))
    by_class = _document_frequencies(labelled, None, ["label", "calibrate"])
    wide = by_class.groupBy("feature").agg(*(F.sum(F.when((F.col("label") == y) & (F.col("calibrate") == c), F.col("n")).otherwise(0)).alias(f"n{y}{int(c)}") for y in (1, 0) for c in (False, True)))
    n1, n0 = (sum(sizes.get((y, c), 0) for c in (False, True)) for y in (1, 0))
    y1, y0 = F.col("n10") + F.col("n11"), F.col("n00") + F.col("n01")
    telling = wide.where((y1 >= LEAST_TOXIC_DOCUMENTS) & (y1 / n1 > 2 * (y0 / n0))).orderBy(F.desc(y1), "feature").limit(MOST_FEATURES)
    chosen = telling.toPandas().set_index("feature").sort_index()
    wanted = set(chosen.index)
    frequency = _document_frequencies(docs, wanted, []) if wanted else None
    background = {r["feature"]: r["n"] for r in frequency.collect()} if wanted else {}
    n_docs = docs.count()

    def weights(columns1: list[str], columns0: list[str], sizes1: float, sizes0: float) -> dict[str, float]:
        a, b = chosen[columns1].sum(axis=1), chosen[columns0].sum(axis=1)
        return _weights({f: [float(x), float(y)] for f, x, y in zip(chosen.index, a, b)}, background, n_docs, sizes1, sizes0)

    # Calibrated on rows that the weights have not seen, then the weights are fitted on all.
    half = Model(weight=weights(["n10"], ["n00"], sizes.get((1, False), 0) or 1, sizes.get((0, False), 0) or 1))
    _calibrate(half, labelled.where("calibrate"))
    return Model(weights(["n10", "n11"], ["n00", "n01"], n1, n0), half.drift, half.decay, half.log_k, half.slope, half.intercept)


def extreme_value_rate(gains: np.ndarray, counts: np.ndarray, tokens: int, drift: float) -> float:
    """The positive lambda with E[exp(lambda s)] = 1, where counts tokens of all score gains and the others -drift."""
    share = counts / tokens

    def moment(rate: float) -> float:
        return math.exp(-rate * drift) * (1 - share.sum()) + float((share * np.exp(np.minimum(rate * gains, 500))).sum()) - 1

    low, high = 1e-6, 50.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (low, middle) if moment(middle) > 0 else (middle, high)
    return low


def fit_extremes(model: Model, labelled: DataFrame) -> None:
    """Set lambda and K from the documents (text, label) that are not toxic; both stay as they are without any score."""
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, known = Scores(shared.value.weight), shared.value
        histogram: Counter = Counter()
        documents, lengths, best, tokens = 0, 0.0, 0.0, 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n, segments = known.segments(text or "", scores)
                if n:
                    documents, tokens, lengths = documents + 1, tokens + n, lengths + math.log(n)
                    best += max((s for _, _, s in segments), default=0.0)
                    histogram.update(round(g * STEPS) for g in map(scores.__getitem__, (text or "").lower().split()) if g > 0)
            scores.trim()
        rows = [(None, documents, tokens, lengths, best), *((at, n, 0, 0.0, 0.0) for at, n in histogram.items())]
        yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=["at", "n", "tokens", "lengths", "best"])

    found = labelled.where("label = 0").select("text").mapInArrow(run, "at long, n long, tokens long, lengths double, best double")
    found = found.groupBy("at").agg(*(F.sum(c).alias(c) for c in ("n", "tokens", "lengths", "best"))).toPandas()
    whole, gains = found[found["at"].isna()], found[found["at"].notna()]
    tokens = int(whole["tokens"].sum())
    if tokens and len(gains):
        model.decay = extreme_value_rate(gains["at"].to_numpy(np.float64) / STEPS, gains["n"].to_numpy(np.float64), tokens, model.drift)
        documents = float(whole["n"].sum())
        model.log_k = float(model.decay * whole["best"].sum() / documents - 0.5772156649 - whole["lengths"].sum() / documents)


def _calibrate(model: Model, labelled: DataFrame) -> None:
    """Set lambda and K, and then the curve from evidence to probability, from the documents (text, label)."""
    fit_extremes(model, labelled)
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(shared.value.weight)
        for batch in batches:
            worth = [shared.value.evidence(*shared.value.segments(t or "", scores)) for t in batch.column(0).to_pylist()]
            scores.trim()
            yield pa.record_batch([batch.column(1), pa.array(worth, pa.float64())], names=["label", "evidence"])

    rows = labelled.select("text", "label").mapInArrow(run, "label int, evidence double").toPandas().sort_values(["label", "evidence"])
    model.slope, model.intercept = _logistic(np.log1p(rows["evidence"].to_numpy(np.float64)), rows["label"].to_numpy(np.float64))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method with a weak prior; the slope is not negative."""
    if not len(x):
        return 1.0, 0.0
    design = np.stack((x, np.ones_like(x)), axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (y - p) - 0.01 * beta
        curve = (design * (p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(beta[0]), 0.0), float(beta[1])


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, begin, end, score, evidence): every significant toxic passage, in white-space tokens of the text."""

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, known = Scores(shared.value.weight), shared.value
        for batch in batches:
            owner, rows = [], []
            scores.trim()
            for k, text in enumerate(batch.column(1).to_pylist()):
                n, segments = known.segments(text or "", scores)
                for b, e, s in segments:
                    if (worth := known.evidence(n, [(b, e, s)])) > 0:
                        owner.append(k)
                        rows.append((b, e, s, worth))
            yield pa.record_batch([batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64())))], names=["doc_id", "begin", "end", "score", "evidence"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, begin long, end long, score double, evidence double")


def probability_of(model: Model, spark: SparkSession | None = None) -> Callable[[Column], Column]:
    """A column function from texts to toxicity probabilities; only the text travels to Python."""
    shared = (spark or SparkSession.active()).sparkContext.broadcast(model)  # at most MOST_FEATURES weights

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scores, known = Scores(shared.value.weight), shared.value
        for texts in batches:
            scores.trim()
            yield pa.array([known.probability(known.evidence(*known.segments(t or "", scores))) for t in texts.to_pylist()], pa.float64())

    return run


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit(docs, labels)
    scored = docs.select("doc_id", probability_of(model, docs.sparkSession)(F.col("text")).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
