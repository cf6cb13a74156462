"""Operator 1, quality classifier: compression with dictionaries of good and of bad text.

Two zstandard dictionaries of one size are trained on a bounded sample of labelled rows, from as many bytes of good as of bad text. A text is compressed
whole with each; what the good dictionary saves over the bad one, per byte and relative to the
size, is turned into a probability by a logistic calibration fitted on other labelled rows.

Defined results: null and empty texts get the share of good labels, as a text without evidence;
repeated rows score alike; a table without usable labels gives every text 0.5; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import chunks, crc_mod, sampled_texts, share_of

LEVEL = 3
DICTIONARY_BYTES = 112_640
#: The trainer gets so many times a dictionary's bytes at least; with little text the dictionaries are smaller.
SUPPLY, SMALLEST = 8, 256
#: Bound of the training sample: documents for each label value, and bytes taken of each for a dictionary.
SAMPLE = 4_000
EXCERPT = 2_048


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    prior: float


def excerpt(text: bytes, size: int = EXCERPT) -> bytes:
    """A piece of a long training text, from a place that its own hash gives."""
    start = zlib.crc32(text) % (len(text) - size + 1) if len(text) > size else 0
    return text[start : start + size]


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """zstandard's trained dictionary, smaller where the samples are few; the samples themselves if the trainer takes them at no size."""
    samples = [s for s in samples if s]
    size = min(size, sum(map(len, samples)) // SUPPLY)
    while size >= SMALLEST:
        try:
            return zstandard.train_dictionary(size, samples).as_bytes()
        except zstandard.ZstdError:  # too few samples, or too alike
            size //= 2
    return b"\n".join(samples)


def equal_shares(good: list[bytes], bad: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """The first samples of each side up to the bytes of the side that has fewer."""
    share = min(sum(map(len, good)), sum(map(len, bad)))
    most = lambda samples: [s for s, before in zip(samples, np.cumsum([0, *map(len, samples)]), strict=False) if before < share]
    return (most(good), most(bad)) if share else (good, bad)


class Scorer:
    """Holds the two compressors; made once in each Python worker's task."""

    def __init__(self, good: bytes, bad: bytes):
        self.pair = [self._compressor(d) for d in (good, bad)]

    @staticmethod
    def _compressor(data: bytes):
        if not data:
            return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        d = zstandard.ZstdCompressionDict(data)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False)

    def features(self, text: str | None) -> tuple[float, ...]:
        data = (text or "").encode()
        if not data:
            return (0.0, 0.0, 0.0)
        g, b = (len(c.compress(data)) for c in self.pair)
        return (b - g) / len(data), (b - g) / max(b, g), float(np.log(min(b, g) / len(data)))


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted logistic regression by Newton steps with a small ridge: (mean, scale, weights with the intercept last)."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    ridge = np.diag([1e-2] * (z.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + ridge, z.T @ (weight * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def fit(documents: DataFrame, labels: DataFrame, train: Column, sample: int = SAMPLE) -> QualityModel:
    """Learn from labelled rows for which ``train`` holds, ``sample`` of each label value at most.

    Half of the sample feeds the dictionaries, the other half the calibration; both halves reach
    the driver only as bounded excerpts and as three numbers a document.
    """
    rows = sampled_texts(documents, labels, "quality", train, sample)
    half = crc_mod(F.concat(F.lit("half"), F.col("doc_id").cast("string")), 2)

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            pieces = [excerpt((t or "").encode()) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(pieces, pa.binary())], ["y", "piece"])

    pieces = rows.where(half == 0).select("y", "text").mapInArrow(cut_out, "y int, piece binary").collect()
    pieces.sort(key=lambda r: (zlib.crc32(r["piece"]), r["piece"]))
    samples = equal_shares(*([bytes(r["piece"]) for r in pieces if r["y"] == k] for k in (1, 0)))
    size = min(DICTIONARY_BYTES, *(sum(map(len, x)) // SUPPLY for x in samples))
    good, bad = (train_dictionary(x, size) if all(samples) else b"" for x in samples)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(good, bad)
        for b in chunks(batches):
            f = np.array([scorer.features(t) for t in b.column("text").to_pylist()], float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column("y"), *(pa.array(c) for c in f.T)], ["y", "a", "b", "c"])

    found = rows.where(half == 1).select("y", "text").mapInArrow(measure, "y int, a double, b double, c double").collect()
    x = np.array([(r["a"], r["b"], r["c"]) for r in found], float).reshape(-1, 3)
    y = np.array([r["y"] for r in found], float)
    n1, n0 = y.sum(), (1 - y).sum()
    if not n1 or not n0:
        prior = 0.5 if not len(y) else float((n1 + 1) / (len(y) + 2))
        return QualityModel(good, bad, (0.0,) * 3, (1.0,) * 3, (0.0, 0.0, 0.0, float(np.log(prior / (1 - prior)))), prior)
    # The sample holds as many of both values as it can; weights bring their true shares back.
    share = share_of(labels, "quality", train)
    mean, scale, w = calibrate(x, y, np.where(y == 1, share / n1, (1 - share) / n0) * len(y))
    return QualityModel(good, bad, *(tuple(map(float, v)) for v in (mean, scale, w)), share)


def score(documents: DataFrame, model: QualityModel, id_column: str = "doc_id") -> DataFrame:
    """(id, score, saved): one row for each document; ``saved`` is the size difference per byte."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = documents.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer = Scorer(m.good, m.bad)
        mean, scale, w = (np.array(v) for v in (m.mean, m.scale, m.weights))
        for b in chunks(batches):
            texts = b.column("text").to_pylist()
            x = np.array([scorer.features(t) for t in texts], float).reshape(-1, 3)
            p = 1 / (1 + np.exp(-np.clip(np.c_[(x - mean) / scale, np.ones(len(x))] @ w, -30, 30)))
            p[[not t for t in texts]] = m.prior
            yield pa.RecordBatch.from_arrays([b.column(id_column), pa.array(p), pa.array(x[:, 0])], [id_column, "score", "saved"])

    return documents.select(id_column, "text").mapInArrow(run, f"`{id_column}` {kind}, score double, saved double")
