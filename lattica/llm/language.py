"""Operator 10, language ID: multinomial naive Bayes over hashed character n-grams.

Counts of hashed 1- to 3-grams of a bounded training sample are summed by Spark into one
log-probability matrix, which is broadcast; batches of texts are hashed and scored in numpy.

Defined results: a null text and one without a letter get ``und`` and score 0; so does every text if nothing
could be learned; ties go to the language that sorts first; rows that repeat score alike; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import bounded_sample, chunks, text_chunks

GRAMS = (1, 2, 3)
BUCKETS = 1 << 16
#: Bound of the training sample, in documents.
SAMPLE = 20_000
#: n-grams of one text depend on each other: evidence counts as of this many at most in the score.
EVIDENCE = 100
SMOOTHING = 0.5
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    log_p: np.ndarray  # float32, [language, bucket]; bucket 0 holds no letters and says nothing


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, starts, has_letter): lower-cased texts laid end to end, two blanks after each, all but letters blanked."""
    low = [(t or "").lower() for t in texts]
    sizes = np.fromiter((len(t) for t in low), np.int64, len(low)) + 2
    codes = np.frombuffer("".join(t + "  " for t in low).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[codes]
    starts = np.cumsum(sizes) - sizes
    has = np.add.reduceat(letter.astype(np.int32), starts) > 0 if len(low) else np.zeros(0, bool)
    return np.where(letter, codes, 32).astype(np.uint32), starts, has


def gram_buckets(codes: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram at each place; 0 where it holds no letter."""
    h = np.full(len(codes), 0x9E3779B1 * n & 0xFFFFFFFF, np.uint32)
    padded = np.concatenate([codes, np.full(n, 32, np.uint32)])
    any_letter = np.zeros(len(codes), bool)
    for k in range(n):
        c = padded[k : k + len(codes)]
        h = (h ^ c) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
        any_letter |= c != 32
    bucket = 1 + (h * np.uint32(0xC2B2AE35) >> np.uint32(8)) % np.uint32(BUCKETS - 1)
    return np.where(any_letter, bucket, 0).astype(np.int32)


def fit(documents: DataFrame, train: Column, sample: int = SAMPLE) -> LanguageModel:
    """Learn from text and lang of rows for which ``train`` holds and lang is not null.

    The sample is the ``sample`` documents of smallest id hash; its bound is on distinct ids.
    """
    usable = documents.where(train & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    last = bounded_sample(usable.select("doc_id").distinct(), "doc_id", sample).agg(F.max(F.xxhash64("doc_id"))).first()[0]
    if last is None:
        return LanguageModel((), np.zeros((0, BUCKETS), np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in chunks(batches):
            texts, langs = b.column("text").to_pylist(), np.array(b.column("lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                c = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for s, e in text_chunks(own):
                    codes, _, _ = hashed(own[s:e])
                    for n in GRAMS:
                        c += np.bincount(gram_buckets(codes, n), minlength=BUCKETS)
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], ["lang", "bucket", "c"])

    rows = usable.where(F.xxhash64("doc_id") <= last).select("text", "lang").mapInArrow(run, "lang string, bucket int, c long")
    found = rows.groupBy("lang", "bucket").agg(F.sum("c").alias("c")).toPandas()
    langs = tuple(sorted(found["lang"].unique()))
    counts = np.zeros((len(langs), BUCKETS))
    counts[np.searchsorted(langs, found["lang"].to_numpy(str)), found["bucket"].to_numpy(int)] = found["c"].to_numpy(float)
    counts[:, 0] = 0
    log_p = np.log(counts + SMOOTHING) - np.log((counts + SMOOTHING).sum(1, keepdims=True))
    log_p[:, 0] = 0
    return LanguageModel(langs, log_p.astype(np.float32))


def predict(texts: list[str | None], model: LanguageModel) -> tuple[list[str], np.ndarray]:
    langs: list[str] = []
    scores: list[np.ndarray] = []
    for s, e in text_chunks(texts):
        codes, starts, has = hashed(texts[s:e])
        total, grams = np.zeros((len(model.langs), len(starts))), np.zeros(len(starts))
        for n in GRAMS:
            h = gram_buckets(codes, n)
            grams += np.add.reduceat((h > 0).astype(np.int32), starts)
            for k in range(len(model.langs)):
                total[k] += np.add.reduceat(model.log_p[k][h], starts, dtype=np.float64)
        if not len(model.langs):
            langs += [UNKNOWN] * len(starts)
            scores.append(np.zeros(len(starts)))
            continue
        best = total.argmax(0)
        tempered = (total - total.max(0)) * np.minimum(1, EVIDENCE / np.maximum(grams, 1))
        scores.append(np.where(has, 1 / np.exp(tempered).sum(0), 0.0))
        langs += [model.langs[k] if ok else UNKNOWN for k, ok in zip(best, has, strict=True)]
    return langs, np.concatenate(scores) if scores else np.zeros(0)


def identify(documents: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """The columns ``keep`` with the predicted language and its score as ``names``; one row for each document."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    need = [*keep] if "text" in keep else [*keep, "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            langs, scores = predict(b.column("text").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(scores)], [*keep, *names])

    return documents.select(*need).mapInArrow(run, f"{schema}, `{names[0]}` string, `{names[1]}` double")
