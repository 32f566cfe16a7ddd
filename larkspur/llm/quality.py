"""Quality classifier: ridge regression on random Fourier features of document statistics, with isotonic calibration.

The features approximate a Gaussian kernel. Normal equations are summed by partition, so that what reaches
the driver is a matrix of fixed size for each of a few partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from larkspur.llm import tokens
from larkspur.llm.language_id import held_out
from larkspur.plans.session import dropped, written

#: Labelled rows to learn from, about: a sample by hash of doc_id, all if there are fewer. Random features; ridge penalty for each row.
SAMPLE_ROWS, FEATURES, PENALTY = 20_000, 512, 1e-3
_PARTS = 4

# classes of bytes: upper, lower, digit, space, line feed, sentence marks, brackets and quotes, other signs, not ASCII
_CLASS = np.full(256, 7, np.int64)
for _kind, _bytes in enumerate((range(65, 91), range(97, 123), range(48, 58), b" \t\r\x0b\x0c", b"\n", b".,;:?", b"()[]{}<>'\"", b"", range(128, 256))):
    _CLASS[list(_bytes)] = _kind
_EXCLAIM, _BAR = 9, 10
_CLASS[ord("!")], _CLASS[ord("|")] = _EXCLAIM, _BAR
_CLASSES = 11


def statistics(column: pa.Array) -> np.ndarray:
    """A row of statistics for each text; an empty or null text has zeros."""
    out = []
    for block in tokens.blocks(column, lower=False):
        n = len(block.bounds) - 1
        size, words = np.diff(block.offsets), np.diff(block.bounds)
        kinds = np.bincount(np.repeat(np.arange(n) * _CLASSES, size) + _CLASS[block.data], minlength=n * _CLASSES).reshape(n, _CLASSES)
        share = kinds / np.maximum(size, 1)[:, None]
        owner = np.repeat(np.arange(n), words)
        per = 1 / np.maximum(words, 1)
        mean = np.bincount(owner, block.sizes, n) * per
        spread = np.sqrt(np.maximum(np.bincount(owner, block.sizes.astype(float) ** 2, n) * per - mean**2, 0))
        again = np.zeros(len(block.words))
        again[1:] = (block.words[1:] == block.words[:-1]) & (owner[1:] == owner[:-1])
        ends = _CLASS[block.data[np.maximum(block.starts + block.sizes - 1, 0)]] if len(block.starts) else np.zeros(0, np.int64)
        signs = np.bincount(owner, (ends >= 7) & (ends != 8), n) * per
        distinct, most = np.zeros(n), np.zeros(n)
        for i in np.flatnonzero(words):
            counts = np.unique(block.words[block.bounds[i] : block.bounds[i + 1]], return_counts=True)[1]
            distinct[i], most[i] = len(counts), counts.max()
        lines = kinds[:, 4] + 1
        out.append(
            np.column_stack(
                [share, np.log1p(size), np.log1p(words), mean, spread, np.bincount(owner, again, n) * per, signs, distinct * per, np.log1p(distinct), most * per, np.log1p(words / lines)]
            )
        )
    return np.concatenate(out) if out else np.zeros((0, _CLASSES + 10))


def _spread(x: np.ndarray, model: dict) -> np.ndarray:
    """Random Fourier features, and a constant."""
    z = np.cos(np.clip((x - model["mean"]) / model["scale"], -8, 8) @ model["wave"] + model["phase"]) * np.sqrt(2 / FEATURES)
    return np.column_stack([z, np.ones(len(z))])


def _sums(table: DataFrame, of) -> np.ndarray:
    """The sum over partitions of what of(statistics, labels) gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            if len(batch):
                x = batch.column("x").flatten().to_numpy().reshape(len(batch), -1)
                total = total + of(x, batch.column("y").to_numpy().astype(float))
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()])], names=["v"])

    rows = table.coalesce(_PARTS).mapInArrow(run, "v array<double>").collect()
    return sum(np.array(r[0]) for r in rows) if rows else np.zeros(0)


def _isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: mean score and mean label of each block, both rising."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order], y[order], strict=True):
        blocks.append([s, v, 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    a = np.array(blocks)
    return a[:, 0] / a[:, 2], a[:, 1] / a[:, 2]


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality") -> dict | None:
    """A model of label (0 or 1) from the texts of docs; None if there is no label.

    Rows of labels without an id or label are left out; of several labels of an id the least counts, of several texts one.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("own")).agg(F.min(F.col(label).cast("double")).alias("y"))
    total = known.count()
    if not total:
        return None
    share = min(1.0, SAMPLE_ROWS / total)
    # share bounds the sample, so it can be broadcast
    sample = F.broadcast(known.where(F.pmod(F.xxhash64("own", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1))

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("own"), tokens.lists(x.ravel(), np.full(len(x), x.shape[1])), batch.column("y"), batch.column("later")], names=["own", "x", "y", "later"])

    joined = docs.select("doc_id", "text").join(sample, F.col("doc_id") == F.col("own")).select("own", "text", "y", (F.pmod(F.xxhash64("doc_id", F.lit(33)), F.lit(4)) == 0).alias("later"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    read = joined.mapInArrow(stats, f"own {kind}, x array<double>, y double, later boolean")
    # an id of many rows is one row of the sample
    table = written(read.groupBy("own").agg(F.min(F.struct("x", "y", "later")).alias("s")).select("s.*"))
    first = table.where("not later")
    sums = _sums(first, lambda x, y: np.vstack([x, x**2, np.ones_like(x)]).reshape(3, *x.shape).sum(1))
    if not len(sums):
        return None
    s, s2, n = sums.reshape(3, -1)
    mean = s / n
    model = {"mean": mean, "scale": np.sqrt(np.maximum(s2 / n - mean**2, 1e-8))}
    rng = np.random.default_rng(7)
    model["wave"] = rng.normal(size=(len(mean), FEATURES)) / np.sqrt(len(mean))
    model["phase"] = rng.uniform(0, 2 * np.pi, FEATURES)

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = _spread(x, model)
        return np.column_stack([z.T @ z, z.T @ y])

    both = _sums(first, equations).reshape(FEATURES + 1, FEATURES + 2)
    model["beta"] = np.linalg.solve(both[:, :-1] + PENALTY * n[0] / FEATURES * np.eye(FEATURES + 1), both[:, -1])
    later = table.where("later").select("x", "y").toArrow()  # a part of the bounded sample
    y = later.column("y").to_numpy()
    if len(y) < 20 or len(np.unique(y)) < 2:
        model["knots"] = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    else:
        x = later.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), -1)
        model["knots"] = _isotonic(_spread(x, model) @ model["beta"], y)
    dropped(table)
    return model


def score_quality(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs (doc_id, text): score is 0 to 1, predicted is 1 from 0.7 on.

    Null and empty texts are scored by their statistics, which are zeros. Without a model every score is 0.5.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            if m is None:
                score = np.full(len(batch), 0.5)
            else:
                raw = _spread(statistics(batch.column("text")), m) @ m["beta"]
                score = np.clip(np.interp(raw, *m["knots"]), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score)], names=["doc_id", "held_out", "score"])

    out = docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
