"""Operator 3, toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon of words and word beginnings is learned from labelled rows by a likelihood-ratio test, near
copies counted once. Features: lexicon densities, second-person words near lexicon hits, capitals, punctuation and
obfuscation rates. Trees are grown on a bounded sample, and calibrated on margins that
each half of it gets from trees of the other half; whole texts are scored.

Defined results: null and empty texts have all features zero and are scored from them; repeated rows score alike;
without usable labels of both values every text gets 0 (or 1, if toxic rows alone are labelled); extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import chunks, crc_mod, cut, sampled_texts
from lattica.llm.words import mix

#: Bound of the training sample: documents for each label value.
SAMPLE = 4_000
#: Word beginnings of these lengths are lexicon candidates beside whole words.
STEMS = (4, 5)
#: A term enters the lexicon at this likelihood ratio (2 ln) and odds; the lexicon keeps this many terms.
MIN_LLR, MIN_ODDS, LEXICON = 15.0, 5.0, 4_000
TREES, DEPTH, RATE, BINS = 60, 3, 0.2, 32
#: Second-person words of English, French, German and Spanish.
SECOND_PERSON = frozenset("you your yours yourself u ur tu toi te ton ta tes vous votre vos du dich dir dein deine euch ihr usted ustedes vosotros ti tus".split())
NEAR = 5
NAMES = ("density", "hits", "distinct", "weight", "second_person", "near", "capitals", "shouted", "punctuation", "exclaimed", "obfuscated", "size")

_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Tree:
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray  # of the leaves


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: dict[str, float]
    base: float = 0.0
    trees: tuple[Tree, ...] = field(default=())
    x: np.ndarray = field(default_factory=lambda: np.zeros(1))  # isotonic steps: margin to probability
    y: np.ndarray = field(default_factory=lambda: np.zeros(1))


def terms(words: set[str]) -> set[str]:
    return words | {f"{w[:n]}-" for w in words for n in STEMS if len(w) > n}


def likeness_key(words: set[str]) -> int:
    """Equal for near copies most of the time, and for texts that share some words hardly ever: four min-hashes of the words in one."""
    if not words:
        return 0
    c = np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint64, len(words))
    key = np.zeros(1, np.uint64)
    for k in range(4):
        key = mix(key * np.uint64(3) + mix(c + np.uint64(k << 32)).min())
    return int(key.view(np.int64)[0])


def choose_lexicon(counts: list[tuple[str, int, int]], n1: int, n0: int) -> dict[str, float]:
    """Term to log odds, from (term, toxic documents, clean documents): significant and well over-represented terms."""
    out = []
    for term, a, b in counts:
        odds = np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))
        if odds < np.log(MIN_ODDS):
            continue
        llr = 0.0
        p = (a + b) / (n1 + n0)
        for k, n in ((a, n1), (b, n0)):
            for part, share in ((k, p), (n - k, 1 - p)):
                if part and share and n:
                    llr += 2 * part * np.log(part / n / share)
        if llr >= MIN_LLR:
            out.append((-llr, term, float(odds)))
    return {term: odds for _, term, odds in sorted(out)[:LEXICON]}


def features(text: str | None, lexicon: dict[str, float]) -> tuple[float, ...]:
    text = text or ""
    words = _WORD.findall(text.lower())
    if not words:
        return (0.0,) * len(NAMES)
    get, distinct = lexicon.get, set(words)
    stem1, stem2 = STEMS
    # Each distinct word is looked up once; places are gone through only where some word counts.
    found = {w: v for w in distinct if (v := get(w) or get(w[:stem2] + "-") or get(w[:stem1] + "-"))}
    person = distinct & SECOND_PERSON
    at = [k for k, w in enumerate(words) if w in found] if found else []
    you = [k for k, w in enumerate(words) if w in person] if person else []
    weight = sum(found[words[k]] for k in at)
    n, size = len(words), len(text)
    near = 0
    if at and you:
        y = np.array(you)
        i = np.searchsorted(y, at)
        left = np.abs(y[np.maximum(i - 1, 0)] - at)
        near = int((np.minimum(left, np.abs(y[np.minimum(i, len(y) - 1)] - at)) <= NEAR).sum())
    kinds = character_kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    count = np.bincount(kinds, minlength=6)
    shouted = int((np.diff(_runs(kinds == UPPER), axis=0) >= 3).sum()) if count[UPPER] >= 3 else 0
    obfuscated = 0
    if count[DIGIT] or count[SYMBOL]:  # runs of digits and look-alike symbols with letters on both sides
        letter = np.concatenate([[False], (kinds == LOWER) | (kinds == UPPER), [False]])
        start, end = _runs((kinds == DIGIT) | (kinds == SYMBOL))
        obfuscated = int((letter[start] & letter[end + 1]).sum())
    return (len(at) / n, float(np.log1p(len(at))), float(np.log1p(len(found))), weight / n, len(you) / n, near / n, float(count[UPPER] / size), shouted / n, float((count[OTHER] + count[SYMBOL]) / size), text.count("!") / size, obfuscated / n, float(np.log1p(n)))


def _runs(mask: np.ndarray) -> np.ndarray:
    """(starts, ends) of the runs in which ``mask`` holds."""
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)])


OTHER, LOWER, UPPER, DIGIT, BLANK, SYMBOL = range(6)


@cache
def character_kinds() -> np.ndarray:
    """The kind of each code point: letters without case count as lower ones."""
    kind = lambda c: UPPER if c.isupper() else LOWER if c.isalpha() else DIGIT if c.isdigit() else BLANK if c.isspace() else SYMBOL if c in "@$*#" else OTHER
    return np.fromiter((kind(chr(i)) for i in range(0x110000)), np.int8, 0x110000)


def quantile_bins(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]


def grow(codes: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int = DEPTH, ridge: float = 1.0) -> Tree:
    """A complete tree by histogram splits; node k has the children 2k + 1 and 2k + 2."""
    inner = 2**depth - 1
    feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
    node = np.zeros(len(g), np.int64)
    for k in range(inner):
        own = node == k
        best = (1e-9, 0, np.inf, -1)
        gs, hs = g[own].sum(), h[own].sum()
        for j, e in enumerate(edges):
            if not len(e):
                continue
            c = codes[own, j]
            gl = np.cumsum(np.bincount(c, g[own], len(e) + 1))[:-1]
            hl = np.cumsum(np.bincount(c, h[own], len(e) + 1))[:-1]
            gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
            gain[(hl < 0.5) | (hs - hl < 0.5)] = 0
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], j, e[i], i)
        _, j, value, i = best
        feature[k], limit[k] = j, value
        right = own & (codes[:, j] > i) if i >= 0 else np.zeros(len(g), bool)
        node[own] = 2 * k + 1
        node[right] = 2 * k + 2
    leaf = node - inner
    value = -np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
    return Tree(feature, limit, value)


def tree_value(tree: Tree, x: np.ndarray) -> np.ndarray:
    node = np.zeros(len(x), np.int64)
    rows = np.arange(len(x))
    for _ in range(int(np.log2(len(tree.feature) + 1))):
        node = 2 * node + 1 + (x[rows, tree.feature[node]] > tree.cut[node])
    return tree.value[node - len(tree.feature)]


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, tuple[Tree, ...]]:
    """Logistic gradient boosting with weights."""
    p = np.clip((w * y).sum() / w.sum(), 1e-6, 1 - 1e-6)
    base = float(np.log(p / (1 - p)))
    edges = quantile_bins(x)
    codes = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
    margin, trees = np.full(len(y), base), []
    for _ in range(TREES):
        q = 1 / (1 + np.exp(-margin))
        tree = grow(codes, edges, w * (q - y), w * q * (1 - q))
        tree = Tree(tree.feature, tree.cut, RATE * tree.value)
        margin = margin + tree_value(tree, x)
        trees.append(tree)
    return base, tuple(trees)


def isotonic(margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the non-decreasing fit of y, as steps (upper margin, value)."""
    at, which = np.unique(margin, return_inverse=True)
    weight = np.bincount(which, w, len(at))
    blocks: list[list[float]] = []  # value, weight, highest margin; equal margins are one from the start
    for m, v, k in zip(at, np.bincount(which, w * y, len(at)) / weight, weight, strict=True):
        blocks.append([float(v), float(k), float(m)])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, k2, m2 = blocks.pop()
            b = blocks[-1]
            b[0], b[1], b[2] = (b[0] * b[1] + v2 * k2) / (b[1] + k2), b[1] + k2, m2
    return np.array([b[2] for b in blocks]), np.array([b[0] for b in blocks])


def probability(x: np.ndarray, model: ToxicityModel) -> np.ndarray:
    margin = np.full(len(x), model.base)
    for t in model.trees:
        margin += tree_value(t, x)
    at = np.searchsorted(model.x, margin, side="left")
    return model.y[np.minimum(at, len(model.y) - 1)]


def fit(documents: DataFrame, labels: DataFrame, train: Column, sample: int = SAMPLE) -> ToxicityModel:
    """Learn from labelled rows for which ``train`` holds, ``sample`` of each label value at most.

    Clean rows are weighted up to their true share, so the score is a probability among labelled rows.
    """
    share = {r["toxic"]: r["n"] for r in labels.where(train & F.col("toxic").isin(0, 1)).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(share) < 2:
        return ToxicityModel({}, y=np.full(1, float(1 in share)))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            keys = [likeness_key(set(_WORD.findall((t or "").lower()))) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), b.column("y"), pa.array(keys, pa.int64())], ["doc_id", "text", "y", "key"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = sampled_texts(documents, labels, "toxic", train, sample).mapInArrow(keyed, f"doc_id {kind}, text string, y int, key long")
    rows = cut(rows)  # bounded by the sample
    once = rows.join(rows.groupBy("y", "key").agg(F.min("doc_id").alias("doc_id")), ["y", "key", "doc_id"], "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (Counter(), Counter())
        for b in chunks(batches):
            for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                found[y].update(terms(set(_WORD.findall((t or "").lower()))))
                found[y][""] += 1  # the documents
        for y, c in enumerate(found):
            items = list(c.items())
            for s in range(0, len(items), 50_000):
                part = items[s : s + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.string()), pa.array([v for _, v in part], pa.int64()), pa.array([y] * len(part), pa.int32())], ["term", "c", "y"])

    counts = once.select("text", "y").mapInArrow(count, "term string, c long, y int")
    counts = counts.groupBy("term").agg(F.sum(F.when(F.col("y") == 1, F.col("c")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("c")).otherwise(0)).alias("b"))
    # Likelihood of the others is under the limit whatever the rest: a term needs some toxic documents.
    found = counts.where((F.col("a") >= 5) | (F.col("term") == "")).where("a > b or term = ''").collect()
    whole = next((r for r in found if r["term"] == ""), None)
    if whole is None or not whole["a"] or not whole["b"]:
        return ToxicityModel({}, y=np.full(1, share[1] / (share[0] + share[1])))
    lexicon = choose_lexicon([(r["term"], r["a"], r["b"]) for r in found if r["term"]], whole["a"], whole["b"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            f = [features(t, lexicon) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("y"), b.column("half"), pa.array(f, pa.list_(pa.float64()))], ["y", "half", "f"])

    half = crc_mod(F.concat(F.lit("half"), F.col("doc_id").cast("string")), 2).cast("int").alias("half")
    got = rows.select("y", half, "text").mapInArrow(measure, "y int, half int, f array<double>").collect()
    got.sort(key=lambda r: (r["half"], r["y"], r["f"]))
    x, y = np.array([r["f"] for r in got], float).reshape(-1, len(NAMES)), np.array([r["y"] for r in got], float)
    held = np.array([r["half"] for r in got]) == 1
    w = np.where(y == 1, 1.0, share[0] / share[1] * max(1.0, y.sum()) / max(1.0, (1 - y).sum()))
    margin = np.zeros(len(x))
    for fold in (held, ~held):  # each half is judged by trees grown on the other
        base, trees = boost(x[~fold], y[~fold], w[~fold]) if (~fold).any() else (0.0, ())
        margin[fold] = base
        for t in trees:
            margin[fold] += tree_value(t, x[fold])
    base, trees = boost(x, y, w)
    return ToxicityModel(lexicon, base, trees, *isotonic(margin, y, w))


def score(documents: DataFrame, model: ToxicityModel, id_column: str = "doc_id") -> DataFrame:
    """(id, score, hits): one row for each document; ``hits`` is ln(1 + lexicon hits)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = documents.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in chunks(batches):
            x = np.array([features(t, m.lexicon) for t in b.column("text").to_pylist()], float).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(id_column), pa.array(np.clip(probability(x, m), 0, 1)), pa.array(x[:, 1])], [id_column, "score", "hits"])

    return documents.select(id_column, "text").mapInArrow(run, f"`{id_column}` {kind}, score double, hits double")
