"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network in numpy.

Every word has two terms: its spelling in lower case and its shape (runs of letter case, digits and signs).  Random indexing
gives each term a sparse ternary index vector from its hash; a spelling's context vector is the sum of its
neighbours' index vectors over the training texts, kept in ``buckets`` hash buckets.  A document is the mean
of its shapes' index vectors, of the index vectors of neighbouring shape pairs and of its words' unit context
vectors, with its share of repeated words.  A tanh layer and a sigmoid are trained by Adam; a temperature fitted on a fifth
of the sample, left out of training, calibrates the probabilities.

Bounded by parameters: the labelled sample (``sample_rows``, the smallest hashes among labelled ids whose crc32
mod 4 is not 2) is all that fitting sees, and the only data sent to the driver are its pooled vectors and the bucket sums.
Scores cover whole texts of all documents, in one pass without a shuffle.  Labels, lang, source and doc_id are no
inputs of a score.

Defined results: a null or empty text has a zero vector and still gets a score; ids with contradicting or null
labels do not teach; without labels every score is 0.5, with one class only every score is that class' smoothed share; equal texts
have equal scores; a null doc_id is not held out; an empty table gives no rows; other columns are kept (filter) or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridewave.llm.common import RangeHash, U64, Words, give_back, mix, slices, small_batches, utf8, written

DIMENSION = 64
NONZEROS = 4
BUCKETS = 1 << 15
WINDOW = 2
THRESHOLD = 0.7
SLICE = 400_000  # bytes of text worked on at once
LOWER = bytes(range(256)).lower()
# lower letters and all non-ASCII are one class, upper letters and digits one each, every sign is its own
CLASS = np.array([1 if chr(b).islower() or b >= 0x80 else 2 if chr(b).isupper() else 3 if chr(b).isdigit() else b + 4 for b in range(256)], np.uint64)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def index_vectors(terms: np.ndarray) -> np.ndarray:
    """Sparse ternary vectors: NONZEROS places of value +1 or -1 for each term."""
    out = np.zeros((len(terms), DIMENSION), np.float32)
    rows = np.arange(len(terms))
    for salt in mix(np.arange(1, NONZEROS + 1, dtype=U64)):
        bits = mix(terms + salt)
        out[rows, (bits >> U64(8)) % U64(DIMENSION)] += np.where(bits & U64(1), np.float32(1), np.float32(-1))
    return out


@dataclass
class Terms:
    """Spellings and shapes of the words of some texts."""
    first: np.ndarray
    spelling: np.ndarray
    shape: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Terms:
        words = Words(texts)
        low = words.data
        spelling = RangeHash(mix(np.frombuffer(LOWER, np.uint8)[low].astype(U64) + U64(3))).of(words.start, words.end)
        kind = CLASS[low]
        change = np.ones(len(kind), bool)
        change[1:] = kind[1:] != kind[:-1]
        change[words.start] = True
        at = np.concatenate([[0], np.cumsum(change)])
        shape = RangeHash(mix(kind[change] + U64(11))).of(at[words.start], at[words.end])
        return cls(words.first, spelling, shape)

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _pool(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Means by text of the index vectors of terms, through the distinct terms of each text."""
    out = np.zeros((n, DIMENSION), np.float32)
    if not len(values):
        return out
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (values[1:] != values[:-1])
    heads = np.flatnonzero(new)
    count = np.diff(np.append(heads, len(text))).astype(np.float32)
    owner = text[heads]
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    sums = np.add.reduceat(index_vectors(values[heads]) * count[:, None], starts, axis=0)
    out[owner[starts]] = sums / np.add.reduceat(count, starts)[:, None]
    return out


def context_sums(texts: list[bytes]) -> np.ndarray:
    """Context vectors by bucket of the spellings of some texts."""
    terms = Terms.of(texts)
    out = np.zeros((BUCKETS, DIMENSION), np.float32)
    if not len(terms.spelling):
        return out
    text, vectors = terms.text, index_vectors(terms.spelling)
    near = np.zeros_like(vectors)
    for step in range(1, WINDOW + 1):
        same = (text[step:] == text[:-step])[:, None]
        near[step:] += vectors[:-step] * same
        near[:-step] += vectors[step:] * same
    bucket = (terms.spelling % U64(BUCKETS)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    starts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    out[bucket[order][starts]] = np.add.reduceat(near[order], starts, axis=0)
    return out


def features(texts: list[bytes], contexts: np.ndarray) -> np.ndarray:
    """Pooled vectors of texts: shapes, shape pairs, context vectors and the share of repeated words."""
    terms = Terms.of(texts)
    n, text = len(texts), terms.text
    size = np.diff(terms.first)
    inside = text[1:] == text[:-1]
    pairs = mix(terms.shape[:-1] * U64(31) + terms.shape[1:])[inside]
    # contexts go through one row for each text and bucket
    bucket = (terms.spelling % U64(BUCKETS)).astype(np.int64)
    pooled = np.zeros((n, DIMENSION), np.float32)
    for at in range(0, len(bucket), 100_000):
        part = slice(at, at + 100_000)
        owner = text[part]
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        pooled[owner[starts]] += np.add.reduceat(contexts[bucket[part]], starts, axis=0)
    pooled /= np.maximum(size, 1)[:, None]
    again = np.bincount(text[1:][inside & (terms.spelling[1:] == terms.spelling[:-1])], minlength=n) / np.maximum(size, 1)
    return np.concatenate([_pool(terms.shape, text, n), _pool(pairs, text[1:][inside], n), pooled, again[:, None].astype(np.float32)], axis=1)


@dataclass
class Network:
    """Standardised inputs, a tanh layer, a sigmoid, a temperature."""
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x).astype(np.float64) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, rounds: int = 40, batch: int = 128, rate: float = 3e-3, decay: float = 1e-3) -> Network:
    """Trains on four fifths of the rows and calibrates the temperature on the rest (rows must be in hash order)."""
    width = x.shape[1] if x.ndim == 2 else 1
    empty = Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), 0.0)
    if len(y) < 10 or y.min() == y.max():
        empty.constant = float((y.sum() + 1) / (len(y) + 2)) if len(y) else 0.5
        return empty
    rest = np.arange(len(y)) % 5 == 0
    tx, ty = x[~rest], y[~rest].astype(np.float32)
    rng = np.random.default_rng(20)
    mean, scale = tx.mean(0), tx.std(0) + 1e-3
    net = Network(mean, scale, rng.normal(0, width ** -0.5, (width, hidden)).astype(np.float32), np.zeros(hidden, np.float32),
                  rng.normal(0, hidden ** -0.5, hidden).astype(np.float32), 0.0)
    tx -= mean
    tx /= scale
    z = tx.astype(np.float32, copy=False)
    params = [net.w1, net.b1, net.w2, np.zeros(1, np.float32)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(rounds):
        order = rng.permutation(len(ty))
        for at in range(0, len(order), batch):
            i = order[at:at + batch]
            a = np.tanh(z[i] @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(a @ params[2] + params[3], -30, 30)))
            d = (p - ty[i]) / len(i)
            back = d[:, None] * params[2] * (1 - a * a)
            step += 1
            for k, g in enumerate((z[i].T @ back + decay * params[0], back.sum(0), a.T @ d + decay * params[2], d.sum(keepdims=True))):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] -= rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    logit, truth = net.logits(x[rest]).astype(np.float64), y[rest].astype(np.float64)
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    loss = [np.mean(np.logaddexp(0, logit / t) - truth * logit / t) for t in grid]
    net.temperature = float(grid[int(np.argmin(loss))])
    return net


def labelled_sample(documents: DataFrame, labels: DataFrame, target: str, sample_rows: int) -> DataFrame:
    """text_order, text, label of at most ``sample_rows`` labelled ids that are not held out, by smallest hash."""
    ids = (labels.where(~held_out() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
           .agg(F.min(target).alias("label"), F.max(target).alias("_most")).where("label = _most")
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select("doc_id", "label"))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # at most sample_rows narrow rows are broadcast
    return texts.join(F.broadcast(ids), "doc_id").select(F.xxhash64("doc_id").alias("place"), "text", F.col("label").cast("int").alias("label"))


def train(documents: DataFrame, labels: DataFrame, target: str = "quality", sample_rows: int = 20_000) -> tuple[np.ndarray, Network]:
    """Bucket context vectors (unit length) and the network."""
    spark = small_batches(documents.sparkSession)
    sample = written(labelled_sample(documents, labels, target, sample_rows).coalesce(8), "quality-sample")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS, DIMENSION), np.float32)
        for batch in slices(batches, most=SLICE):
            total += context_sums(utf8(batch))
            give_back()
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    contexts = np.zeros((BUCKETS, DIMENSION), np.float32)
    for row in sample.select("text").coalesce(4).mapInArrow(sums, "sums binary").toLocalIterator():  # at most four tables of fixed size
        contexts += np.frombuffer(row["sums"], np.float32).reshape(BUCKETS, DIMENSION)
    contexts /= np.linalg.norm(contexts, axis=1, keepdims=True) + 1e-6
    shared = spark.sparkContext.broadcast(contexts)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            give_back()
            x = features(utf8(batch), shared.value)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array([r.tobytes() for r in x], pa.binary())], names=["place", "label", "x"])

    rows = sample.select("place", "text", "label").mapInArrow(pooled, "place long, label int, x binary").toArrow()
    shared.destroy()
    y = rows["label"].to_numpy().astype(np.int64)
    x = np.zeros((len(y), 3 * DIMENSION + 1), np.float32)
    for i, value in enumerate(rows["x"]):
        x[i] = np.frombuffer(value.as_buffer(), np.float32)
    order = np.lexsort((y, rows["place"].to_numpy()))
    del rows
    x, y = x[order], y[order]
    give_back()
    network = fit(x, y)
    del x
    give_back()
    return contexts, network


def scorer(documents: DataFrame, labels: DataFrame, **training):
    """A column function text -> probability of label 1."""
    contexts, network = train(documents, labels, **training)
    shared = documents.sparkSession.sparkContext.broadcast((contexts, network))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        table, net = shared.value
        out, at = np.zeros(len(texts)), 0
        while at < len(texts):
            raw = [texts.iat[at].encode()]
            while at + len(raw) < len(texts) and len(raw) < 256 and sum(map(len, raw)) < SLICE:
                raw.append(texts.iat[at + len(raw)].encode())
            out[at:at + len(raw)] = net.score(features(raw, table))
            at += len(raw)
            give_back()
        return pd.Series(out)

    return lambda text: score(F.coalesce(text, F.lit("")))


def quality_scores(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **training) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    score = scorer(documents, labels, **training)
    return documents.select("doc_id", held_out().alias("held_out"), score(F.col("text")).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def keep_quality(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **training) -> DataFrame:
    """The documents whose score reaches the threshold."""
    score = scorer(documents, labels, **training)
    return documents.withColumn("_score", score(F.col("text"))).where(F.col("_score") >= threshold).select(documents.columns)
