"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network (operator 7).

Texts are cut into runs of letters and runs of marks; each run is followed by its shape (case, digits, kind of mark,
length, same as the run before), so that rare words are known by what they look like. Words and shapes hash to a
fixed number of buckets. A bucket's index vector is sparse and random; its word vector adds the index vectors of its
neighbours over all documents: each task adds up its own, one row per bucket, and a group-by adds the tasks' rows.
A document is the mean of its runs' unit vectors, frequent ones weighing less, with its length and its share of repeats. The network is
fitted in numpy on at most TRAIN_ROWS labelled documents (by the order of a hash; never those whose crc32 of the
doc_id as text divides by 5), and a temperature from rows set apart calibrates its probabilities. Vectors and
network are of fixed size (about 2 MB) and go to every task; scoring is one pass without a shuffle.

Defined cases: null and empty texts have the zero vector and are scored as any; null labels are not learned from, of
several labels of a document the largest counts; with no label, or labels of one class, every score is their share
of ones (0.5 without any); a null doc_id counts as held out; repeated rows are scored each; an empty table gives
no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators.joins import sized_join

from .common import frugal, read_table, text_of, written
from .words import U, factors, hashes, in_slices, mixed, runs_of

BUCKETS = 1 << 14
SHAPES = 1 << 10  # the first buckets are of shapes
DIM = 32
WIDE = DIM + 3  # figures of a document
SPARSE = 4  # places of an index vector that aren't 0
NEAR = 2  # neighbours on either side
RARE = 1e-3  # share of runs at which a bucket weighs half
TRAIN_ROWS = 20_000
HIDDEN = 32
LEAST_SCORE = 0.3

#: Kind of each byte: 0 blank, 1 letter or digit or part of a longer character, 2 and more: marks, each its own.
KIND = np.array([0 if c == 32 or 9 <= c <= 13 else 1 if c >= 128 or chr(c).isalnum() else 2 + c % 64 for c in range(256)], dtype=np.uint8)


def runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all runs and shapes in turn, and the text each is in."""
    data, _, _, _ = runs_of(texts)
    kind = np.minimum(KIND[data], 2)
    edge = np.flatnonzero(np.diff(kind, prepend=np.uint8(0)))
    edge = np.append(edge, len(data))
    solid = kind[edge[:-1]] > 0
    starts, lengths = edge[:-1][solid], np.diff(edge)[solid]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    text = np.searchsorted(begins, starts, side="right") - 1
    h = hashes(data, starts, lengths)
    offsets = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum())) + np.repeat(starts - offsets, lengths)
    upper = np.add.reduceat(((data[at] >= 65) & (data[at] <= 90)).astype(np.int64), offsets)
    digit = np.add.reduceat(((data[at] >= 48) & (data[at] <= 57)).astype(np.int64), offsets)
    same = np.append(False, (h[1:] == h[:-1]) & (text[1:] == text[:-1]))
    case = np.where(upper == 0, 0, np.where((upper == lengths) & (lengths > 1), 3, np.where((upper == 1) & (data[starts] < 97), 1, 2)))
    letters = case + 4 * np.where(digit == 0, 0, np.where(digit == lengths, 2, 1)) + 12 * np.minimum(lengths // 4, 4) + 60 * same
    marks = 128 + KIND[data[starts]].astype(np.int64) * 6 + np.minimum(lengths, 3) - 1 + 3 * same
    shape = np.where(kind[starts] == 1, letters, marks)
    out = np.empty(2 * len(h), dtype=np.int64)
    out[::2] = SHAPES + (h % U(BUCKETS - SHAPES)).astype(np.int64)
    out[1::2] = shape
    return out, np.repeat(text, 2)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's index vector."""
    r = mixed(factors(BUCKETS * SPARSE, 99)).reshape(BUCKETS, SPARSE)
    return (r % U(DIM)).astype(np.int64), np.where((r >> U(40)) & U(1), 1.0, -1.0)


def contexts(docs: DataFrame) -> DataFrame:
    """bucket, n, v: how often and the sum of its neighbours' index vectors, over all documents."""

    @frugal
    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        total, n = np.zeros(BUCKETS * DIM), np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for _, texts in in_slices(batch.column(0)):
                b, text = runs(texts)
                n += np.bincount(b, minlength=BUCKETS)
                for gap in range(1, NEAR + 1):
                    near = text[gap:] == text[:-gap]
                    left, right = b[:-gap][near], b[gap:][near]
                    for word, other in ((left, right), (right, left)):
                        for j in range(SPARSE):
                            total += np.bincount(word * DIM + places[other, j], signs[other, j], minlength=BUCKETS * DIM)
        used = np.flatnonzero(n)
        rows = total.reshape(BUCKETS, DIM)[used].astype(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * DIM), pa.array(rows.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), lists], ["bucket", "n", "v"])

    rows = docs.select(text_of().alias("text")).mapInArrow(per_task, "bucket long, n long, v array<long>")
    sums = rows.groupBy("bucket").agg(F.sum("n").alias("n"), *[F.sum(F.col("v")[k]).alias(f"v{k}") for k in range(DIM)])
    return sums.select("bucket", "n", F.array(*[f"v{k}" for k in range(DIM)]).alias("v"))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Weighted unit vector of each bucket; at most BUCKETS rows come to the driver."""
    out = np.zeros((BUCKETS, DIM), dtype=np.float32)
    rows = contexts(docs).collect()
    every = max(1, sum(r.n for r in rows))
    for r in rows:
        v = np.array(r.v, dtype=float)
        v = np.sign(v) * np.log1p(np.abs(v))
        out[r.bucket] = v / max(1e-9, float(np.sqrt(v @ v))) * (RARE / (RARE + r.n / every))
    return out


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """One row per text: the mean of its runs' vectors, two figures of its length and the share of runs that repeat the one before."""
    out = np.zeros((len(texts), WIDE), dtype=np.float32)
    b, text = runs(texts)
    n = np.bincount(text, minlength=len(texts))
    for at in range(0, len(b), 200_000):
        part, of = b[at : at + 200_000], text[at : at + 200_000]
        first = np.flatnonzero(np.diff(of, prepend=-1))
        out[of[first], :DIM] += np.add.reduceat(vectors[part], first, axis=0)
    out[:, :DIM] *= (8 / np.maximum(n, 1))[:, None]
    out[:, DIM] = np.log1p(n) / 4
    out[:, DIM + 1] = n < 40
    out[:, DIM + 2] = np.bincount(text, (b >= 60) & (b < 120), minlength=len(texts)) / np.maximum(n, 1)
    return out


@dataclass
class Model:
    vectors: np.ndarray
    layers: tuple[np.ndarray, ...]  # mean, spread, w1, b1, w2, b2; or one: the share of ones
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        if len(self.layers) == 1:
            return np.full(len(x), float(self.layers[0]))
        mean, spread, w1, b1, w2, b2 = self.layers
        return np.tanh((x - mean) / spread @ w1 + b1) @ w2 + b2

    def scores(self, texts: pa.Array) -> np.ndarray:
        got = [self.logits(pooled(part, self.vectors)) for _, part in in_slices(texts)]
        return 1 / (1 + np.exp(-np.concatenate(got) / self.temperature)) if got else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray, seed: int = 5, epochs: int = 60) -> tuple[tuple[np.ndarray, ...], float]:
    """The layers and the temperature. A fifth of the rows is set apart for the temperature and to choose the epoch."""
    if len(y) < 20 or y.min() == y.max():
        share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        return (np.array(np.log(share / (1 - share))),), 1.0
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    apart, learn = order[: len(y) // 5], order[len(y) // 5 :]
    mean, spread = x[learn].mean(0), x[learn].std(0) + 1e-3
    z = (x - mean) / spread
    p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), np.zeros(1)]
    m, v, step, best = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0, (np.inf, p)
    out = lambda q, a: np.tanh(a @ q[0] + q[1]) @ q[2] + q[3]
    loss = lambda o, t: float(np.mean(np.logaddexp(0, o) - t * o))
    for _ in range(epochs):
        rng.shuffle(learn)
        for k in range(0, len(learn), 128):
            a, t = z[learn[k : k + 128]], y[learn[k : k + 128]]
            h = np.tanh(a @ p[0] + p[1])
            e = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - t) / len(t)
            back = np.outer(e, p[2]) * (1 - h * h)
            grads = [a.T @ back + 1e-4 * p[0], back.sum(0), h.T @ e + 1e-4 * p[2], np.array([e.sum()])]
            step += 1
            for i, g in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - 0.005 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        now = loss(out(p, z[apart]), y[apart])
        if now < best[0]:
            best = (now, [a.copy() for a in p])
    p = best[1]
    grid = np.exp(np.linspace(np.log(0.25), np.log(4), 81))
    temperature = float(grid[np.argmin([loss(out(p, z[apart]) / t, y[apart]) for t in grid])])
    return (mean, spread, *p), temperature


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAIN_ROWS) -> Model:
    docs = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    vectors = word_vectors(docs)
    rows = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("double").alias("y")).filter(F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
    sample = written(rows.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "sample")

    @frugal
    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in in_slices(b.column(1)):
                x = pooled(texts, vectors)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), b.column(2).slice(first, len(texts)), lists], ["doc_id", "y", "x"])

    got = sized_join(docs, sample, ["doc_id"], "inner").mapInArrow(pool, "doc_id long, y double, x array<float>")
    got = sorted((r.doc_id, r.y, r.x) for r in got.collect())
    layers, temperature = fit(np.array([r[2] for r in got], dtype=float).reshape(len(got), WIDE), np.array([r[1] for r in got]))
    return Model(vectors, layers, temperature)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @frugal
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.scores(b.column(1)))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(per_batch, "doc_id long, score double")


def accepted(docs: DataFrame, model: Model, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs, whole, whose score is at least `least`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    @frugal
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pc.filter(b, pa.array(shared.value.scores(b.column(at)) >= least))

    return docs.mapInArrow(per_batch, docs.schema)


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    got = score(docs, train(docs, read_table(spark, sf_dir, "labels")))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"))
