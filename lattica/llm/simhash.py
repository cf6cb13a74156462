"""Operator 2, SimHash near-dedup: fingerprints, and a Hamming join by the generalised pigeonhole principle.

A pair of fingerprints within ``distance`` bits, cut into m partitions, agrees in at least one partition i
to within t_i bits for any thresholds with sum(t_i) = distance - m + 1 (t_i = -1 drops a partition).
Correlated bits are put into the same partition, so that what is skewed is skewed in few partitions,
and every fingerprint gets the thresholds that a dynamic program finds cheapest on candidate
counts estimated from 16-bit histograms of the partitions. Candidates are probed and verified in one join.

Defined results: null and empty texts have fingerprint zero and are linked like any other; rows that
repeat an id or a text each get a row; a null id belongs to its group, whose id is the smallest that is
not null (null if none is); extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import chunks, components, cut, fresh, release, text_key, utf8
from lattica.llm.words import mix, words

BITS = 64
SHINGLE = 3
DISTANCE = 3
SEED = 42
#: Bits of a partition that its histogram distinguishes: the tables on the driver are bounded by 2**16 counts a partition.
HISTOGRAM_BITS = 16
#: What an index or probe row costs, in candidates that a join compares.
PROBE_COST = 20.0
_BLOCK = 1 << 18
#: Highest threshold of one partition.
TOP = 3
NEAR_SHINGLE, NEAR_SIMILARITY, NEAR_DISTANCE = 5, 0.8, 10


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles, repeats included; A-Z is lower-cased; 0 for no word."""
    flat = b" ".join(text.lower().split())  # bytes: A-Z only, and the six ASCII white-space bytes
    if not flat:
        return 0
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    n = min(shingle, len(gaps) + 1)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(flat)]
    count, ones = len(starts) - n + 1, np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, count, _BLOCK):
        to = min(count, at + _BLOCK)
        h = np.array([digest(flat[s:e], SEED) for s, e in zip(starts[at:to], ends[at + n - 1 : to + n - 1], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def near_fingerprint(hashes: np.ndarray, shingle: int) -> int:
    """64-bit SimHash of the shingles of a text's words, given by their hashes; 0 for no word."""
    if not len(hashes):
        return 0
    x = shingled(hashes, shingle)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(x), _BLOCK):
        ones += np.unpackbits(x[at : at + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(x), bitorder="little").view("<u8")[0])


#: Multipliers that stand for permutations of 32-bit hashes: odd numbers, each from the one before.
_TIMES = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) >> 20 & 0xFFFFFFFF | 1 for k in range(1, 2 * BITS + 1)], np.uint32)


def minhash_bits(hashes: np.ndarray, shingle: int) -> tuple[int, int]:
    """Two words of 64 bits, one bit of the least hash under each of 128 permutations of the shingles: bits of alike sets agree with probability (1 + similarity) / 2."""
    least = np.full(2 * BITS, 0xFFFFFFFF, np.uint32)
    if len(hashes):
        x = (shingled(hashes, shingle) >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(x), 2048):
            np.minimum(least, (x[at : at + 2048, None] * _TIMES).min(0), out=least)
    a, b = np.packbits((mix(least.astype(np.uint64)) & np.uint64(1)).astype(np.uint8), bitorder="little").view("<u8")
    return int(a), int(b)


def shingled(hashes: np.ndarray, shingle: int) -> np.ndarray:
    """The hash of each ``shingle`` words that follow each other, or of all words, where they are fewer."""
    k = min(shingle, len(hashes))
    n = len(hashes) - k + 1
    x = np.zeros(n, np.uint64)
    for j in range(k):
        x = mix(x * np.uint64(3) + hashes[j : j + n])
    return x


def fingerprints(documents: DataFrame, id_column: str = "doc_id", shingle: int = SHINGLE, keep: tuple[str, ...] = (), near_shingle: int | None = None) -> DataFrame:
    """The columns ``id_column`` and ``keep`` with ``fp``, the fingerprint as a signed 64-bit number, and on demand ``near``, one of ``near_shingle`` words, and ``m1`` and ``m2``, ``minhash_bits``."""
    columns = [id_column, *keep]
    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in columns) + ", fp long" + ", near long, m1 long, m2 long" * bool(near_shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            off, raw = utf8(b.column("_text"))
            fp = [np.array([fingerprint(raw[s:e].tobytes(), shingle) for s, e in zip(off[:-1], off[1:], strict=True)], np.uint64)]
            if near_shingle:
                row, h = words(b.column("_text"))
                edge = np.searchsorted(row, np.arange(b.num_rows + 1))
                each = [h[s:e] for s, e in zip(edge[:-1], edge[1:], strict=True)]
                fp.append(np.array([near_fingerprint(x, near_shingle) for x in each], np.uint64))
                fp.extend(np.array([minhash_bits(x, NEAR_SHINGLE) for x in each], np.uint64).reshape(-1, 2).T.copy())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), *(pa.array(x.view(np.int64)) for x in fp)], [*columns, "fp", "near", "m1", "m2"][: len(columns) + len(fp)])

    return documents.select(*columns, F.col("text").alias("_text")).mapInArrow(run, schema)


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """(n, G) where G[i, j] counts fingerprints with bits i and j set: sums of one 64 x 64 table a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            v = b.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for at in range(0, len(v), _BLOCK):
                bits = np.unpackbits(v[at : at + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                g += bits.T @ bits
            n += len(v)
        if n:
            i, j = np.triu_indices(BITS)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(g[i, j].astype(np.int64)), pa.array(np.full(len(i), n))], ["i", "j", "c", "n"])

    rows = fps.select("fp").mapInArrow(run, "i int, j int, c long, n long").groupBy("i", "j").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).collect()
    g = np.zeros((BITS, BITS))
    for r in rows:
        g[r["i"], r["j"]] = g[r["j"], r["i"]] = r["c"]
    return (int(rows[0]["n"]) if rows else 0), g


def group_bits(n: int, g: np.ndarray, parts: int) -> list[list[int]]:
    """Disjoint groups of nearly equal size; each grows by the bit most correlated with it."""
    p = np.diag(g) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(g / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    left, groups = set(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        order = sorted(left)
        seed = order[int(np.argmax(corr[np.ix_(order, order)].max(1)))]
        group = [seed]
        left.remove(seed)
        while len(group) < size:
            order = sorted(left)
            best = order[int(np.argmax(corr[np.ix_(order, group)].sum(1)))]
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def extract(v: np.ndarray, bits: list[int]) -> np.ndarray:
    """The value of the chosen bits of each fingerprint."""
    out = np.zeros(len(v), np.uint64)
    for to, at in enumerate(bits):
        out |= ((v >> np.uint64(at)) & np.uint64(1)) << np.uint64(to)
    return out


def choose_parts(n: int, distance: int = DISTANCE, radius: int = 0) -> int:
    """The number of partitions with the least rows and expected candidates for n even fingerprints.

    Few wide partitions make more rows and fewer candidates; as n grows, they win.
    """

    def cost(m: int) -> float:
        total, width = distance - m + 1, BITS / m
        spread = [total // m + (k < total % m) for k in range(m)] if total >= 0 else [0] * (total + m) + [-1] * -total
        if max(spread) > TOP:
            return float("inf")
        made = sum(_within(width, radius) + _within(width, max(0, t - radius)) for t in spread if t >= 0)
        return PROBE_COST * made + n * sum(_within(width, t) for t in spread) / 2**width

    return min(range(1, distance + 2), key=cost)


def _within(width: float, t: int) -> float:
    """Values within t bits of one."""
    return sum(_choose(width, k) for k in range(t + 1))


def _choose(n: float, k: int) -> float:
    out = 1.0
    for i in range(k):
        out *= (n - i) / (i + 1)
    return out


def neighbour_counts(counts: np.ndarray, most: int) -> np.ndarray:
    """S[t, v]: sum of counts over values within t bits of v, for t up to ``most``.

    Layers of exact distance by the recurrence over bits: adding bit b, distance t is reached from
    distance t with the bit equal and from t - 1 with it flipped.
    """
    layers = [counts.astype(np.float64)] + [np.zeros(len(counts)) for _ in range(most)]
    index = np.arange(len(counts))
    for b in range(int(np.log2(len(counts)))):
        flipped = index ^ (1 << b)
        layers = [layers[0]] + [layers[t] + layers[t - 1][flipped] for t in range(1, most + 1)]
    return np.cumsum(layers, axis=0)


def allocate(costs: np.ndarray, total: int) -> np.ndarray:
    """Thresholds for each row: costs[i, t + 1, row] for t from -1; the sum is ``total`` and the cost least.

    Dynamic programming over partitions; state: the sum so far.
    """
    m, levels, rows = costs.shape
    width = m * levels  # sums are stored from -m
    best = np.full((width, rows), np.inf)
    best[0] = 0
    choice = np.zeros((m, width, rows), np.int8)
    for i in range(m):
        new = np.full((width, rows), np.inf)
        for t in range(levels):
            moved = np.full((width, rows), np.inf)
            moved[t:] = best[: width - t] + costs[i, t]
            better = moved < new
            new = np.where(better, moved, new)
            choice[i][better] = t
        best = new
    at = np.full(rows, total + m)
    out = np.zeros((m, rows), np.int64)
    for i in range(m - 1, -1, -1):
        t = choice[i, at, np.arange(rows)].astype(np.int64)
        out[i] = t - 1
        at = at - t
    return out


def masks(width: int, most: int) -> list[np.ndarray]:
    """For each exact distance up to ``most``, the values to flip a ``width``-bit part by."""
    return [np.array([sum(1 << b for b in c) for c in combinations(range(width), t)], np.uint64) for t in range(most + 1)]


def plan_partitions(fps: DataFrame, distance: int = DISTANCE, parts: int | None = None, radius: int = 0) -> tuple[list[list[int]], np.ndarray]:
    """(groups of bits, S): S[i, t, v] estimates the fingerprints within t bits in partition i of histogram value v."""
    n, g = bit_counts(fps)
    groups = group_bits(n, g, parts or choose_parts(n, distance, radius))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = np.zeros((len(groups), 1 << HISTOGRAM_BITS), np.int64)
        for b in batches:
            v = b.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for i, bits in enumerate(groups):
                h[i] += np.bincount(extract(v, bits[:HISTOGRAM_BITS]).astype(np.int64), minlength=1 << HISTOGRAM_BITS)
        i, x = np.nonzero(h)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(x, pa.int32()), pa.array(h[i, x])], ["i", "x", "c"])

    rows = fps.select("fp").mapInArrow(run, "i int, x int, c long").groupBy("i", "x").agg(F.sum("c").alias("c")).toPandas()
    counts = np.zeros((len(groups), 1 << HISTOGRAM_BITS))
    counts[rows["i"].to_numpy(int), rows["x"].to_numpy(int)] = rows["c"].to_numpy(float)
    top = min(distance, TOP)
    # Bits beyond the histogram's are taken as even: they thin the candidates out.
    s = np.stack([neighbour_counts(c, top) / 2.0 ** max(0, len(b) - HISTOGRAM_BITS) for c, b in zip(counts, groups, strict=True)])
    return groups, s.astype(np.float32)


def links(fps: DataFrame, distance: int = DISTANCE, radius: int = 0, parts: int | None = None, unlike: int = 0) -> DataFrame:
    """(a, b), a < b: the pairs of the distinct fingerprints ``fps.fp`` that differ in ``distance`` bits or fewer.

    Index rows: for each partition the values within ``radius`` bits of the fingerprint's. Probe rows: the values within
    its threshold less ``radius``. Both are keyed by (partition, value), so the join is an ordinary equi-join whose
    hot values adaptive execution splits, and the bit count is part of its condition. With a radius of 1 at most, so is that
    the pair is met for the first time: in the first partition that finds it, at the index value flipped by the lowest bit that differs.
    If ``fps`` has a column ``root``, pairs of one root are known to be connected and are left out there as well; a null root is no root.
    If it has columns ``m1`` and ``m2``, pairs are left out that differ in more than ``unlike`` of their bits; null ones differ in none.
    """
    groups, s = plan_partitions(fps, distance, parts, radius)
    m = len(groups)
    total = distance - m + 1
    shared = fps.sparkSession.sparkContext.broadcast((groups, s))
    levels = s.shape[1] + 1
    known = "root" in fps.columns
    extra = [c for c in ("root", "m1", "m2") if c in fps.columns]
    once = radius <= 1 and m <= 16

    def rows(batches: Iterator[pa.RecordBatch], probe: bool) -> Iterator[pa.RecordBatch]:
        groups, s = shared.value
        flips = [masks(len(b), max(radius, levels - 2 - radius)) for b in groups]
        names = ["part", "value", "fp", *extra, *["once"] * once]
        places = [np.array([0, *(1 << at for at in bits)], np.uint64).view(np.int64) for bits in groups]
        for b in chunks(batches, 4096):
            fp = b.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            v = fp.view(np.uint64)
            values = [extract(v, g) for g in groups]
            reach = np.full((m, len(v)), radius)
            if probe:
                cost = np.zeros((m, levels, len(v)))
                for i in range(m):
                    short = (values[i] & np.uint64((1 << HISTOGRAM_BITS) - 1)).astype(np.int64)
                    made = [sum(len(f) for f in flips[i][: max(0, t - radius) + 1]) for t in range(levels - 1)]
                    cost[i, 1:] = s[i][:, short] + PROBE_COST * np.array(made, float)[:, None]
                chosen = allocate(cost, total)
                reach = np.where(chosen < 0, -1, np.maximum(chosen - radius, 0))
            # Four bits a partition: one more than the bits up to which it finds others.
            found = sum((np.where(reach[i] < 0, 0, reach[i] + radius + 1).astype(np.int64) << 4 * i for i in range(m)), np.zeros(len(v), np.int64))
            for i in range(m):
                for t, flip in enumerate(flips[i]):
                    take = reach[i] >= t
                    if take.any():
                        x = (values[i][take][:, None] ^ flip[None, :]).ravel()
                        own = np.repeat(np.flatnonzero(take), len(flip))
                        more = [np.repeat(found[take], len(flip)) if probe else np.tile(places[i][t : t + len(flip)], take.sum())] if once else []
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), i, np.int32)), pa.array(x.view(np.int64)), pa.array(fp[own]), *(b.column(c).take(pa.array(own)) for c in extra), *map(pa.array, more)], names)

    schema = "part int, value long, fp long" + "".join(f", {c} long" for c in extra) + ", once long" * once
    source = fps.select("fp", *extra)
    index = source.mapInArrow(lambda it: rows(it, False), schema).alias("x")
    probes = source.mapInArrow(lambda it: rows(it, True), schema).alias("q")
    # Both of a pair probe, and each finds the other: the greater one's probe is enough.
    differ = F.col("x.fp").bitwiseXOR(F.col("q.fp"))
    near = (F.col("x.fp") < F.col("q.fp")) & (F.bit_count(differ) <= distance)
    if known:
        near &= F.coalesce(F.col("x.root") != F.col("q.root"), F.lit(True))
    if "m1" in extra:
        near &= F.coalesce(sum(F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"q.{c}"))) for c in ("m1", "m2")) <= unlike, F.lit(True))
    if once:
        masked = [differ.bitwiseAND(F.lit(int(np.array([sum(1 << at for at in bits)], np.uint64).view(np.int64)[0]))) for bits in groups]
        for i, y in enumerate(masked):
            top = F.lit(-(1 << 63)).cast("long")  # has no negative
            near &= (F.col("x.part") != i) | (F.col("x.once") == F.when(y == top, top).otherwise(y.bitwiseAND(-y)) if radius else F.lit(True))
            near &= (F.col("x.part") <= i) | (F.bit_count(y) >= F.shiftright("q.once", 4 * i).bitwiseAND(F.lit(15)))
    pairs = index.join(probes, (F.col("x.part") == F.col("q.part")) & (F.col("x.value") == F.col("q.value")) & near)
    return pairs.select(F.col("x.fp").alias("a"), F.col("q.fp").alias("b")).distinct()


def group(marked: DataFrame, id_column: str = "doc_id", distance: int = DISTANCE) -> DataFrame:
    """(fp, root, component_id) for each fingerprint of ``marked`` (id, fp): root is the group's least fingerprint,
    component_id its least id. Equal fingerprints are one node."""
    own = cut(marked.groupBy("fp").agg(F.min(id_column).alias("_least")))
    roots = components(links(own, distance)).withColumnRenamed("node", "fp")
    release(marked.sparkSession)
    rooted = cut(own.join(roots, "fp", "left").select("fp", "_least", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("_least").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(documents: DataFrame, id_column: str = "doc_id", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(id, fingerprint, component_id): one row for each row of ``documents``."""
    marked = cut(fingerprints(documents, id_column, shingle))
    out = marked.join(group(marked, id_column, distance), "fp")
    return out.select(id_column, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: A sketch is the whole set of 32-bit hashes of the five-word shingles, where these are fewer than WHOLE; else the least one in each of BINS bins, as four bits.
WHOLE, BINS = 256, 2048
#: Bits of 128 of ``minhash_bits`` in which candidates may differ: one pair in a hundred of similarity 0.8 differs in more.
UNLIKE = round(2 * BITS * (1 - NEAR_SIMILARITY) / 2 + 2.33 * math.sqrt(2 * BITS * (1 - NEAR_SIMILARITY) / 2 * (1 + NEAR_SIMILARITY) / 2))
#: Sketches rule out what is estimated so many standard errors under the similarity: one pair of it in three million.
ERRORS = 5.0
#: Pairs that meet in a group of tasks' input: each text's sketch or set is sent to a group once, not with every pair.
SKETCH_PAIRS, SET_PAIRS = 16_384, 4_096
#: Texts of one fingerprint that are looked at together.
NODE_TEXTS = 1_024
#: Texts whose keys are broadcast at most (16 bytes each), to find the texts again.
BROADCAST_ROWS = 1_000_000


def shingle_sets(texts: pa.Array, shingle: int = NEAR_SHINGLE) -> list[np.ndarray]:
    """For each text the distinct 64-bit hashes of its word shingles, in order."""
    row, h = words(texts)
    begin = np.searchsorted(row, np.arange(len(texts) + 1))
    return [np.unique(shingled(h[s:e], shingle)) if e > s else np.zeros(0, np.uint64) for s, e in zip(begin[:-1], begin[1:], strict=True)]


def sketch(hashes: np.ndarray) -> bytes:
    """Of a set: fewer than WHOLE hashes as they are, in order; else half a byte for each bin."""
    x = np.unique((hashes >> np.uint64(32)).astype("<u4"))
    return x.tobytes() if len(x) < WHOLE else _binned(x).reshape(-1, 2).dot(np.array([1, 16], np.uint8)).astype(np.uint8).tobytes()


def _binned(x: np.ndarray) -> np.ndarray:
    """For each bin 0 if it is empty, else 1 to 15 by the least hash in it."""
    x = x.astype(np.uint64)
    order = np.sort((x % np.uint64(BINS)) << np.uint64(32) | x // np.uint64(BINS))
    at = (order >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    out = np.zeros(BINS, np.uint8)
    out[at[first]] = mix(order[first]) % np.uint64(15) + np.uint64(1)
    return out


def bins_of(data: bytes) -> np.ndarray:
    """The bins of a sketch."""
    if len(data) < 4 * WHOLE:
        return _binned(np.frombuffer(data, "<u4"))
    x = np.frombuffer(data, np.uint8)
    return np.stack([x & 15, x >> 4], 1).ravel()


def sketches(texts: pa.Array, shingle: int = NEAR_SHINGLE) -> list[bytes]:
    """For each text the sketch of the set of its word shingles."""
    return [sketch(x) for x in shingle_sets(texts, shingle)]


def resemblance(a: bytes, b: bytes) -> tuple[float, bool]:
    """(Jaccard similarity, whether it is exact) from two sketches."""
    if max(len(a), len(b)) < 4 * WHOLE:
        x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
        both = len(np.intersect1d(x, y, assume_unique=True))
        every = len(x) + len(y) - both
        return (both / every if every else 1.0), True
    share, _ = estimates(bins_of(a)[None], bins_of(b)[None])
    return float(share[0]), False


def estimates(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(share of equal bins among those in use, their number) of pairs of rows; unequal ones look equal in one of 15 cases, so the share errs upwards."""
    used = ((x > 0) | (y > 0)).sum(1)
    return ((x == y) & (x > 0)).sum(1) / np.maximum(used, 1), used


def meet(pairs: DataFrame, nodes: DataFrame, keys: tuple[str, str], node: str, per: int, run, schema: str) -> DataFrame:
    """``run(pairs, nodes)`` for each group of about ``per`` pairs and the rows of ``nodes`` that they need.

    Nodes are dealt to blocks by hash and pairs to pairs of blocks, so that a node with many partners is sent to as many groups as there are blocks at most,
    and one with few to as many as it has partners.
    """
    blocks = max(1, math.ceil(math.sqrt(pairs.count() / per)))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    dealt = pairs.withColumn("_ka", block(keys[0])).withColumn("_kb", block(keys[1]))
    first, second = (dealt.select(F.col(k).alias("node"), F.col("_ka").alias("_na"), F.col("_kb").alias("_nb")).distinct() for k in keys)  # combined where the pairs are, before they are sent
    wanted = first.union(second).distinct()
    sent = wanted.join(nodes.withColumnRenamed(node, "node"), "node")
    return dealt.groupBy("_ka", "_kb").cogroup(sent.groupBy("_na", "_nb")).applyInPandas(run, schema)


def _judge(similarity: float):
    """Of pairs of fingerprints (a, b) those pairs of texts (ra, rb) that sketches do not rule out; ``sure`` if they are whole sets."""

    def run(pairs: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values(["node", "content"], kind="stable")
        names, first = np.unique(nodes["node"].to_numpy(str), return_index=True)
        data = nodes["sketch"].tolist()
        whole = np.array([len(x) < 4 * WHOLE for x in data], bool)
        bins = np.stack([bins_of(x) for x in data]) if data and not whole.all() else np.zeros((len(data), 0), np.uint8)
        a, b = pairs["a"].to_numpy(), pairs["b"].to_numpy()
        na, nb = (np.searchsorted(names, pairs[c].to_numpy(str)) for c in ("na", "nb"))
        last = np.r_[first[1:], len(data)]
        la, lb, ha, hb = first[na], first[nb], last[na], last[nb]
        found: list[tuple[np.ndarray, ...]] = []
        for step in range(int((ha - la).max(initial=0))):  # the texts of a one by one, each with all of b
            live = np.flatnonzero(la + step < ha)
            n = (hb - lb)[live]
            which = np.repeat(live, n)
            i = (la + step)[which]
            j = np.repeat(lb[live] - np.cumsum(n) + n, n) + np.arange(n.sum())
            own = (na[which] != nb[which]) | (i < j)  # of a node with itself each pair once
            which, i, j = which[own], i[own], j[own]
            for at in range(0, len(i), 1024):
                w, x, y = which[at : at + 1024], i[at : at + 1024], j[at : at + 1024]
                share, used = estimates(bins[x], bins[y])
                sure = whole[x] & whole[y]
                keep = share >= similarity - ERRORS * np.sqrt(similarity * (1 - similarity) / np.maximum(used, 1))
                for k in np.flatnonzero(sure):
                    keep[k] = resemblance(data[x[k]], data[y[k]])[0] >= similarity
                found.append((w[keep], x[keep], y[keep], sure[keep]))
        w, x, y, sure = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
        rows = nodes["row"].to_numpy()
        return pd.DataFrame({"a": a[w], "b": b[w], "ra": rows[x], "rb": rows[y], "sure": np.asarray(sure, bool)})

    return run


def _verify(similarity: float):
    """The pairs of texts (ra, rb) whose whole sets have the similarity."""

    def run(pairs: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        own = {k: np.frombuffer(v, np.uint64) for k, v in zip(nodes["node"], nodes["hashes"], strict=True)}
        ok = []
        for x, y in zip(pairs["ra"], pairs["rb"], strict=True):
            x, y = own[x], own[y]
            least = similarity * max(len(x), len(y))
            both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= least else -1
            ok.append(both >= similarity * (len(x) + len(y) - both))
        return pairs.loc[np.array(ok, bool), ["a", "b", "ra", "rb"]]

    return run


def alike_texts(pairs: DataFrame, marked: DataFrame, texts: DataFrame, similarity: float = NEAR_SIMILARITY) -> DataFrame:
    """(a, b, ra, rb): the texts of the fingerprints (a, b) of ``pairs`` whose shingle sets have a Jaccard similarity of ``similarity``.

    ``marked`` (row, fp, content, sketch) tells the texts of a fingerprint, ``texts`` (row, text) holds them. Every distinct set of
    one is compared with every one of the other. Sketches that are whole sets decide; others only rule out, and the sets are made of the texts again.
    """

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([x.tobytes() for x in shingle_sets(b.column("text"))], pa.binary())], ["row", "hashes"])

    kind = marked.schema["row"].dataType.simpleString()
    distinct = marked.groupBy("fp", "content").agg(F.min("sketch").alias("sketch"), F.min("row").alias("row"))
    # A fingerprint of many texts is several nodes, so that no task gets all of them.
    many = cut(distinct.groupBy("fp").agg(F.ceil(F.count("*") / NODE_TEXTS).cast("int").alias("parts")).where("parts > 1"))
    name = lambda fp, k: F.concat_ws(":", fp, k)
    distinct = distinct.join(many, "fp", "left").select(name("fp", F.pmod(F.xxhash64("content"), F.coalesce("parts", F.lit(1)))).alias("node"), "content", "sketch", "row")
    for c in "ab":
        parts = many.select(F.col("fp").alias(c), F.col("parts").alias(f"p{c}"))
        pairs = pairs.join(parts, c, "left").withColumn(f"p{c}", F.explode(F.sequence(F.lit(0), F.coalesce(f"p{c}", F.lit(1)) - 1)))
    pairs = cut(pairs.where("a <> b or pa <= pb").select("a", "b", name("a", "pa").alias("na"), name("b", "pb").alias("nb")))
    judged = cut(meet(pairs, distinct, ("na", "nb"), "node", SKETCH_PAIRS, _judge(similarity), f"a long, b long, ra {kind}, rb {kind}, sure boolean"))
    open_ = judged.where("not sure").drop("sure")
    rows = open_.select(F.explode(F.array("ra", "rb")).alias("row")).distinct()
    sets = cut(texts.join(rows, "row", "left_semi").dropDuplicates(["row"]).select("row", "text").mapInArrow(full, f"row {kind}, hashes binary"))
    near = meet(open_, sets, ("ra", "rb"), "row", SET_PAIRS, _verify(similarity), f"a long, b long, ra {kind}, rb {kind}")
    return judged.where("sure").drop("sure").unionByName(near)


def alike(pairs: DataFrame, marked: DataFrame, texts: DataFrame, similarity: float = NEAR_SIMILARITY) -> DataFrame:
    """The fingerprints (a, b) of ``pairs`` that have texts of that similarity, see ``alike_texts``."""
    return alike_texts(pairs, marked, texts, similarity).select("a", "b").distinct()


def join_groups(marked: DataFrame, texts: DataFrame, groups: DataFrame, reach: int, similarity: float) -> DataFrame:
    """``groups`` (fp, root), joined further where texts whose ``near`` fingerprints lie within ``reach`` bits are alike.

    ``marked`` (key, fp, near, m1, m2) has a row for each document, ``texts`` (key, text) the texts: key tells texts. Work beyond the fingerprints is done on the texts that have candidates only.
    """
    own = cut(marked.groupBy("key").agg(*(F.first(c).alias(c) for c in ("fp", "near", "m1", "m2"))).join(groups, "fp").select("key", "near", "root", "m1", "m2"))
    # What the texts of a near fingerprint do not share is null; those in different groups are candidates of each other as well.
    shared = [F.when(F.min(c) == F.max(c), F.min(c)).alias(c) for c in ("root", "m1", "m2")]
    nodes = cut(own.groupBy(F.col("near").alias("fp")).agg(*shared))
    pairs = cut(links(nodes, reach, int(reach > 7), unlike=UNLIKE).unionByName(nodes.where("root is null").select(F.col("fp").alias("a"), F.col("fp").alias("b"))))
    release(marked.sparkSession)
    involved = cut(own.drop("m1", "m2").join(pairs.select(F.explode(F.array("a", "b")).alias("near")).distinct(), "near", "left_semi"))
    keys = involved.select("key")
    held = F.broadcast(keys) if involved.count() <= BROADCAST_ROWS else keys
    found = cut(texts.join(held, "key", "left_semi").groupBy(F.col("key").alias("row")).agg(F.first("text").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            sets = shingle_sets(b.column("text"))
            content = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(content), pa.array([sketch(x) for x in sets], pa.binary())], ["row", "content", "sketch"])

    drawn = cut(found.mapInArrow(run, "row binary, content long, sketch binary").join(involved.withColumnRenamed("key", "row"), "row").withColumnRenamed("near", "fp"))
    near = alike_texts(pairs, drawn, found, similarity)
    # Links between texts are links between their groups; so are equal sets of shingles.
    by = lambda c: drawn.select(F.col("row").alias(c), F.col("root").alias(f"root_{c}"))
    edges = near.join(by("ra"), "ra").join(by("rb"), "rb").select(F.col("root_ra").alias("a"), F.col("root_rb").alias("b"))
    equal = drawn.groupBy("fp", "content").agg(F.min("root").alias("a"))
    edges = edges.unionByName(drawn.join(equal, ["fp", "content"]).select("a", F.col("root").alias("b")))
    merged = components(edges).toDF("root", "final")
    release(marked.sparkSession)
    return cut(groups.join(merged, "root", "left").select("fp", F.coalesce("final", "root").alias("root")))


def dedup(documents: DataFrame, id_column: str = "doc_id", shingle: int = SHINGLE, distance: int = DISTANCE, similarity: float = NEAR_SIMILARITY, reach: int = NEAR_DISTANCE, near_shingle: int | None = None) -> DataFrame:
    """One row of each group, whole: that of the smallest id (nulls last), and of rows of one id the one of smallest text hash.

    Groups are those of ``near_duplicates``, joined further where fingerprints within ``reach`` bits belong to texts
    whose five-word shingles have a Jaccard similarity of ``similarity`` (of whole texts). These fingerprints are the same, or
    with ``near_shingle`` others, of shingles of so many words: the shorter the shingles, the nearer are alike texts; and 128 bits of
    min-hashes rule out most pairs that are not alike before they leave the join, with one in a hundred of those that are. Pairs within a
    group are left out of the wider join, so large groups of near copies do not grow into their pairs.
    The choice is made on ids and hashes of 128 bits; texts travel in the last join, and before it those that have candidates. Rows alike in id and text stay one;
    null and empty texts are alike, a null text is told from an empty one.
    """
    key = fresh(documents.columns, "_key")
    numbered = documents.withColumn(key, text_key())
    marked = fingerprints(numbered, id_column, shingle, (key,), near_shingle).withColumnRenamed(key, "key")
    if not near_shingle:
        marked = marked.select("*", F.col("fp").alias("near"), *(F.lit(None).cast("long").alias(c) for c in ("m1", "m2")))
    marked = cut(marked)
    groups = cut(group(marked, id_column, distance).select("fp", "root"))
    groups = join_groups(marked, numbered.select(F.col(key).alias("key"), "text"), groups, reach, similarity)
    # Rows are first reduced by fingerprint, with map-side combining, then by group.
    order = F.struct(F.col(id_column).isNull().alias("n"), F.col(id_column).alias("id"), F.col("key").alias("key"))
    best = marked.groupBy("fp").agg(F.min(order).alias("o")).join(groups, "fp").groupBy("root").agg(F.min("o").alias("o"))
    one = best.select(F.col("o.id").alias("_best_id"), F.col("o.key").alias("_best_key")).alias("one")
    kept = numbered.alias("n").join(one, F.col(f"n.`{key}`").eqNullSafe(F.col("one._best_key")) & F.col(f"n.`{id_column}`").eqNullSafe(F.col("one._best_id")), "left_semi")
    return kept.dropDuplicates([id_column, key]).select(*documents.columns)
