"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Random indexing. Tokens (words, and the shape of each white-space token) hash into a fixed number of rows. Each
row has a sparse ternary index vector made from its number alone; a row's context vector is the sum of the
index vectors next to its occurrences, over the whole corpus. The sums are made per task and added by Spark, so
the model's size is fixed by its parameters and not by the corpus.

Pooling. A document is the mean of its tokens' normalised context vectors, the mean of their index vectors, the
squared length of the latter and the share of tokens that repeat the one before (which show repetition), and its length.

A network with one hidden layer is fitted in numpy on a bounded sample of labelled rows, and a temperature and
an offset fitted on rows that the network has not seen turn its output into calibrated probabilities.

Defined results: null and empty texts have the vector of no tokens and a score like any document; texts of any
length are pooled whole; repeated rows repeat; without labels of both kinds every document has the same score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.llm.bpe import byte_slices
from glyphlake.llm.labelled import held_out, training_sample

ROWS = 1 << 14
DIMENSIONS = 32
NONZERO = 4
WINDOW = 2
LABELLED_ROWS = 20_000
HIDDEN = 32
CACHE_TOKENS = 500_000
SLICE = 1_000_000
SEPARATOR = 0
WORD = re.compile(r"\w+")


def index_vectors(rows: int = ROWS, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of each row's index vector; the separator's are zero."""
    draw = np.random.Generator(np.random.PCG64(20_240_517))
    places = np.argsort(draw.random((rows, dimensions)), axis=1)[:, :NONZERO].astype(np.int64)
    signs = draw.choice(np.array([-1, 1], dtype=np.int64), (rows, NONZERO))
    signs[SEPARATOR] = 0
    return places, signs


def shape(token: str) -> str:
    """What kind of token this is: its letter case, whether it has digits, and the marks around its words."""
    core = "".join(WORD.findall(token))
    marks = WORD.sub("w", token)
    case = "n" if not core else "d" if any(c.isdigit() for c in core) else "u" if len(core) > 1 and core.isupper() else "t" if core[:1].isupper() else "l"
    return f"\0{case}{marks[:6]}"


class TokenRows(dict):
    """A white-space token's two rows, for its words and its shape, as one number; filled on demand."""

    def __missing__(self, token: str) -> int:
        word = " ".join(WORD.findall(token.lower()))
        a = 1 + zlib.crc32(word.encode()) % (ROWS - 1)
        b = 1 + zlib.crc32(shape(token).encode()) % (ROWS - 1)
        at = a * ROWS + b
        if len(token) <= 64:
            self[token] = at
        return at


def _token_rows(texts: list[str], cache: TokenRows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of words, rows of shapes (a separator after each text), and how many tokens each text has."""
    if len(cache) > CACHE_TOKENS:
        cache.clear()
    tokens = [t.split() for t in texts]
    n = np.fromiter(map(len, tokens), np.int64, len(tokens))
    flat = np.zeros(int(n.sum()) + len(tokens), dtype=np.int64)
    inside = np.ones(len(flat), dtype=bool)
    inside[np.cumsum(n + 1) - 1] = False
    flat[inside] = np.fromiter((at for t in tokens for at in map(cache.__getitem__, t)), np.int64, int(n.sum()))
    return flat // ROWS, flat % ROWS, n


def context_vectors(docs: DataFrame) -> np.ndarray:
    """The context vector of every row over all of docs: a matrix of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = (np.ascontiguousarray(x.T) for x in index_vectors())
        signs = signs.astype(np.float64)
        cache = TokenRows()
        total = np.zeros(ROWS * DIMENSIONS)

        def add(near: np.ndarray, far: np.ndarray) -> None:
            for k in range(NONZERO):
                np.add.at(total, near * DIMENSIONS + places[k][far], signs[k][far])

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for part in byte_slices(texts, SLICE):
                words, shapes, _ = _token_rows([t or "" for t in texts[part]], cache)
                add(words, shapes)
                add(shapes, words)
                for lag in range(1, WINDOW + 1):
                    add(words[:-lag], words[lag:])
                    add(words[lag:], words[:-lag])
                add(shapes[:-1], shapes[1:])
                add(shapes[1:], shapes[:-1])
        table = total.reshape(ROWS, DIMENSIONS)
        used = np.flatnonzero(table.any(axis=1))
        columns = [pa.array(table[used, k].astype(np.int64), pa.int64()) for k in range(DIMENSIONS)]
        yield pa.record_batch([pa.array(used, pa.int32()), *columns], names=["at", *(f"v{k}" for k in range(DIMENSIONS))])

    fields = "at int, " + ", ".join(f"v{k} long" for k in range(DIMENSIONS))
    sums = docs.select("text").mapInArrow(run, fields).groupBy("at").agg(*(F.sum(f"v{k}").alias(f"v{k}") for k in range(DIMENSIONS)))
    found = sums.toPandas()
    out = np.zeros((ROWS, DIMENSIONS), dtype=np.float64)
    out[found["at"].to_numpy(np.int64)] = found.drop(columns="at").to_numpy(np.float64)
    out[SEPARATOR] = 0
    out = np.sign(out) * np.sqrt(np.abs(out))  # dampens the rows of very frequent neighbours
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(length > 0, length, 1)).astype(np.float32)


def pool(texts: list[str], cache: TokenRows, table: np.ndarray) -> np.ndarray:
    """One row of features per text. table has the context and index vectors of each row side by side."""
    words, shapes, n = _token_rows(texts, cache)
    half = table.shape[1] // 2
    out = np.zeros((len(texts), 2 * table.shape[1] + 4), dtype=np.float32)
    ends = np.cumsum(n + 1) - 1
    for k, (begin, end) in enumerate(zip((ends - n).tolist(), ends.tolist())):
        if begin == end:
            out[k, -1] = 1
            continue
        w = words[begin:end]
        means = table[w].mean(axis=0)
        out[k, : table.shape[1]] = means
        out[k, table.shape[1] : -4] = table[shapes[begin:end]].mean(axis=0)
        out[k, -4:-1] = (means[half:] ** 2).sum(), np.count_nonzero(w[1:] == w[:-1]) / (end - begin), math.log1p(end - begin)
    return out


@dataclass
class Model:
    context: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0
    offset: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum((x - self.centre) / self.scale @ w1 + b1, 0) @ w2 + b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature + self.offset, -50, 50)))


def unit_index() -> np.ndarray:
    """Index vectors of length 1 as a dense matrix."""
    places, signs = index_vectors()
    out = np.zeros((ROWS, DIMENSIONS), dtype=np.float32)
    out[np.arange(ROWS)[:, None], places] = signs / math.sqrt(NONZERO)
    return out


def train(x: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-3, seed: int = 7) -> list[np.ndarray]:
    """Weights of a two-layer network by Adam on mini-batches, with weight decay."""
    draw = np.random.default_rng(seed)
    layers = [draw.normal(0, math.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, math.sqrt(1 / HIDDEN), HIDDEN), np.array(math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))]
    first, second, step = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    for epoch in range(epochs):
        order = draw.permutation(len(x))
        for at in range(0, len(x), 256):
            rows = order[at : at + 256]
            inputs, w2 = x[rows], layers[2]
            hidden = np.maximum(inputs @ layers[0] + layers[1], 0)
            error = (1 / (1 + np.exp(-np.clip(hidden @ w2 + layers[3], -50, 50))) - y[rows]) / len(rows)
            back = np.outer(error, w2) * (hidden > 0)
            slopes = [inputs.T @ back + decay * layers[0], back.sum(axis=0), hidden.T @ error + decay * w2, error.sum()]
            step += 1
            now = rate * (1 - epoch / epochs)
            for k, slope in enumerate(slopes):
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * slope**2
                layers[k] = layers[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return layers


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Temperature and offset that give the unseen rows the best likelihood, by Newton's method."""
    beta = np.array([1.0, 0.0])
    design = np.stack((z, np.ones_like(z)), axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -50, 50)))
        slope = design.T @ (y - p) - 0.1 * (beta - [1.0, 0.0])
        curve = (design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        step = np.clip(np.linalg.solve(curve, slope), -0.5, 0.5)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return 1 / max(float(beta[0]), 0.02), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", bound: int = LABELLED_ROWS) -> Model:
    """Context vectors from all of docs; the network from at most `bound` labelled rows."""
    context = context_vectors(docs)
    width = 4 * DIMENSIONS + 4
    blank = Model(context, np.zeros(width), np.ones(width), [np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.array(0.0)])
    shared = docs.sparkSession.sparkContext.broadcast(np.concatenate((context, unit_index()), axis=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = TokenRows()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for part in byte_slices(texts, SLICE):
                x = pool([t or "" for t in texts[part]], cache, shared.value)
                yield pa.record_batch([*(batch.column(k)[part] for k in (1, 2)), pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))], names=["label", "calibrate", "x"])

    labelled = docs.select("doc_id", "text").join(F.broadcast(training_sample(labels, column, bound)), "doc_id").select("text", "label", "calibrate")
    rows = labelled.mapInArrow(run, "label int, calibrate boolean, x array<float>").toPandas()
    if rows["label"].nunique() < 2:
        return blank
    x = np.stack(rows["x"].to_numpy()).astype(np.float64)
    y, unseen = rows["label"].to_numpy(np.float64), rows["calibrate"].to_numpy(bool)
    order = np.lexsort((*x.T[:3], y))  # the same order whatever the partitions
    x, y, unseen = x[order], y[order], unseen[order]
    if len(set(y[~unseen])) < 2:
        unseen = np.zeros_like(unseen)
    centre, scale = x[~unseen].mean(axis=0), x[~unseen].std(axis=0) + 1e-3
    model = Model(context, centre, scale, train((x[~unseen] - centre) / scale, y[~unseen]))
    if unseen.any():
        model.temperature, model.offset = _calibrate(model.logits(x[unseen]), y[unseen])
    return model


def probability_of(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """A column function from texts to quality probabilities; only the text travels to Python."""
    shared = spark.sparkContext.broadcast(model)  # of the fixed size that ROWS and DIMENSIONS give

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache, table = TokenRows(), np.concatenate((shared.value.context, unit_index()), axis=1)
        for column in batches:
            texts = column.to_pylist()
            found = [shared.value.probabilities(pool([t or "" for t in texts[part]], cache, table)) for part in byte_slices(texts, SLICE)]
            yield pa.array(np.concatenate([*found, np.zeros(0)]), pa.float64())

    return run


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit(docs, labels)
    scored = docs.select("doc_id", probability_of(docs.sparkSession, model)(F.col("text")).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
