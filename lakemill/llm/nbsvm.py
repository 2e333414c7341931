"""Naive Bayes support vectors: n-gram indicators scaled by class log-count ratios, then a linear hinge-loss model.

Indicators of lower-cased word unigrams and bigrams and of 4-byte sequences (as written) are hashed to ``DIMENSIONS``
numbers. Class counts of the training rows give each number a log-count ratio; rows of scaled indicators, of length
1, are fitted by dual coordinate descent on the driver. A second fit that leaves rows out places the logistic curve
from margin to score; it has no shift, so 0.5 is the separating plane.

The fit takes at most ``MOST_ROWS`` training rows, those with the least hash of their id: a documented bound. On the
driver a row stays packed, at most ``DIMENSIONS`` / 8 bytes, and is opened for each of its steps, so that the fit holds
``MOST_ROWS`` * ``DIMENSIONS`` / 8 bytes (196 MB) and one open row whatever the lengths of texts. Every text is scored whole. The model is two vectors of ``DIMENSIONS``
numbers, whatever the input, and goes to executors with the function.

Defined cases: a null or empty text has no indicators and scores the plane's offset; null labels don't count; with
labels of one kind only, or none, all scores are the share of label 1 among them (0.5 if none); rows that share a
doc_id are scored each. Other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.llm.words import GOLDEN, U64, first_of_runs, mix, offsets_of, plain, slices, split, window_hashes

BITS = 18
DIMENSIONS = 1 << BITS
MOST_ROWS = 6000
SMOOTHING, COST, EPOCHS, SEED = 1.0, 1.0, 12, 5


def indicators(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct feature numbers of all texts, one text after another, and where each text's begin and end."""
    n = len(texts)
    words = split(texts)
    h = words.hashes(lower=True)
    keys = [(np.repeat(np.arange(n), np.diff(words.bounds)), h)]
    pairs, where = window_hashes(h, words.bounds, 2, 77)
    keys.append((keys[0][0][where], pairs))
    at = offsets_of(texts)
    raw, at = words.raw, at - at[0]
    if len(raw) >= 4:
        codes = raw[:-3].astype(np.uint64) | raw[1:-2].astype(np.uint64) << U64(8) | raw[2:-1].astype(np.uint64) << U64(16) | raw[3:].astype(np.uint64) << U64(24)
        doc = np.repeat(np.arange(n), np.diff(at))
        same = doc[:-3] == doc[3:]
        keys.append((doc[:-3][same], mix(codes[same] + GOLDEN)))
    cells = np.concatenate([d.astype(np.int64) << BITS | (k >> U64(64 - BITS)).astype(np.int64) for d, k in keys])
    cells = np.sort(cells)
    cells = cells[first_of_runs(cells)]
    bounds = np.searchsorted(cells, np.arange(n + 1, dtype=np.int64) << BITS)
    return (cells & (DIMENSIONS - 1)).astype(np.int32), bounds


def _pack(batches):
    for batch in batches:
        texts = plain(batch.column("text"))
        for a, b in slices(texts, 1 << 20):
            numbers, bounds = indicators(texts.slice(a, b - a))
            packed = []
            for i in range(b - a):
                own = numbers[bounds[i] : bounds[i + 1]]
                if len(own) * 32 > DIMENSIONS:
                    bits = np.zeros(DIMENSIONS, bool)
                    bits[own] = True
                    packed.append(b"b" + np.packbits(bits).tobytes())
                else:
                    packed.append(b"i" + own.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("label").slice(a, b - a), pa.array(packed, pa.binary())], names=["label", "numbers"])


def _unpack(packed: bytes) -> np.ndarray:
    if packed[:1] == b"b":
        return np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8, offset=1)))
    return np.frombuffer(packed, np.int32, offset=1)


class Model:
    """margin = sum of ``weights`` over a text's numbers / length of its scaled indicators + offset."""

    def __init__(self, weights: np.ndarray, squares: np.ndarray, offset: float, slope: float, constant: float | None = None):
        self.weights, self.squares, self.offset, self.slope, self.constant = weights, squares, offset, slope, constant

    def scores(self, numbers: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        n = len(bounds) - 1
        if self.constant is not None:
            return np.full(n, self.constant)
        sums = np.zeros(n + 1)
        lengths = np.zeros(n + 1)
        some = np.flatnonzero(np.diff(bounds))
        if len(some):
            sums[some] = np.add.reduceat(self.weights[numbers].astype(np.float64), bounds[some])
            lengths[some] = np.add.reduceat(self.squares[numbers].astype(np.float64), bounds[some])
        margin = sums[:n] / np.sqrt(np.maximum(lengths[:n], 1e-12)) + self.offset
        return 1 / (1 + np.exp(-np.clip(self.slope * margin, -500, 500)))


class Rows:
    """Feature numbers of rows, packed; a row is opened when it is asked for."""

    def __init__(self, packed: list[bytes]):
        self.packed = packed

    def __len__(self) -> int:
        return len(self.packed)

    def __getitem__(self, i: int) -> np.ndarray:
        return _unpack(self.packed[i])

    def some(self, which: np.ndarray) -> Rows:
        return Rows([self.packed[i] for i in which])


def descend(rows, y: np.ndarray, ratio: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for min |w|^2 / 2 + sum of cost * max(0, 1 - y (w x + offset)); x of length 1."""
    w, offset = np.zeros(len(ratio)), 0.0
    alpha = np.zeros(len(rows))
    random = np.random.default_rng(SEED)
    # 1 / length of each row's scaled indicators; a row without any has no values
    scale = np.zeros(len(rows))
    for i in range(len(rows)):
        v = ratio[rows[i]]
        scale[i] = 1 / max(np.sqrt(v @ v), 1e-6)
    norm = np.array([(scale[i] * ratio[rows[i]]) @ (scale[i] * ratio[rows[i]]) for i in range(len(rows))]) + 1.0
    for _ in range(EPOCHS):
        for i in random.permutation(len(rows)):
            own = rows[i]
            values = ratio[own] * scale[i]
            slack = 1 - y[i] * (w[own] @ values + offset)
            new = min(max(alpha[i] + slack / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[own] += step * values
                offset += step
                alpha[i] = new
    return w, offset


def _fit(rows: Rows, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    counts = {s: np.full(DIMENSIONS, SMOOTHING) for s in (1, -1)}
    for i, s in enumerate(y):
        counts[int(s)][rows[i]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[-1] / counts[-1].sum())
    share = max((y > 0).mean(), 1e-9)
    cost = np.where(y > 0, COST * 0.5 / share, COST * 0.5 / max(1 - share, 1e-9))
    w, offset = descend(rows, y, ratio, cost)
    return w * ratio, ratio**2, offset


def fit(labels: list[int], packed: list[bytes]) -> Model:
    rows, y = Rows(packed), np.where(np.array(labels, float) > 0, 1.0, -1.0)
    empty = np.zeros(DIMENSIONS, np.float32)
    if len(set(y.tolist())) < 2:
        return Model(empty, empty, 0.0, 1.0, float((y > 0).mean()) if len(y) else 0.5)
    # margins of rows that were left out
    held = np.arange(len(rows)) % 4 == 3
    slope = 4.0
    if held.sum() >= 20 and len(set(y[~held].tolist())) == 2:
        weights, squares, offset = _fit(rows.some(np.flatnonzero(~held)), y[~held])
        margin = np.array([weights[rows[i]].sum() / np.sqrt(max(squares[rows[i]].sum(), 1e-12)) + offset for i in np.flatnonzero(held)])
        tried = np.array([1, 2, 3, 4, 6, 8, 12, 16])
        slope = float(tried[np.argmin([np.logaddexp(0, -k * y[held] * margin).mean() for k in tried])])
    weights, squares, offset = _fit(rows, y)
    return Model(weights.astype(np.float32), squares.astype(np.float32), float(offset), slope)


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, label 0 or 1)."""
    sample = labels.where(F.col("label").isin(0, 1)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    # at most most_rows rows of two numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id", "label")), "doc_id").select(F.col("label").cast("int").alias("label"), F.col("text").cast("string").alias("text"))
    got = rows.mapInArrow(_pack, "label int, numbers binary").toArrow().sort_by([("label", "ascending"), ("numbers", "ascending")])
    order = np.random.default_rng(SEED).permutation(got.num_rows)
    got = got.take(pa.array(order))
    return fit(got.column("label").to_pylist(), got.column("numbers").to_pylist())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row of ``docs``."""

    def work(batches):
        for batch in batches:
            texts = plain(batch.column("text"))
            for a, b in slices(texts, 1 << 20):
                found = model.scores(*indicators(texts.slice(a, b - a)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(found)], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id bigint, score double")


def op5_nbsvm(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, learned from labels.quality of the others."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = train(docs, labels.where(~held))
    return score(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
