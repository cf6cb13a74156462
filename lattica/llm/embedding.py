"""Operator 4, embedding near-dedup: an exact metric range join with pivots.

Vectors are scaled to length one, where cosine >= c is a distance <= sqrt(2 - 2c) =: r. In each label the
pivots part the vectors into cells by the nearest pivot (its home). A vector is also sent, as a guest, to the cell j < home of
each pivot p_j with d(x, p_j) <= d(x, p_home) + 2r (triangle inequality) and within r of the plane between both
pivots: a partner at home in j cannot be farther away. So each pair within r meets exactly once,
in the lower of its two home cells, and cells join independently. Large cells are dealt out as pairs of blocks. The number of pivots of a label follows
its size: of the powers of two up to one for CELL vectors the one is taken that costs least on a sample, in vectors sent and pairs compared, as
in many dimensions boundaries are wide and more pivots can send more than they save.

Equal vectors of a label are one node with a count. A task returns, for a pair of blocks, link counts and a spanning
set of edges, so dense groups do not grow into all their pairs.

Defined results: null labels, and vectors that are null, zero or hold null or non-finite components, link with nothing
and are their own component; vectors of different sizes do not link; rows that repeat a vec_id each get a row; a row without
vec_id is never kept, and links like any other; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import components, cut

COSINE = 0.93
#: Vectors for each pivot of a label, and pivots in all: the last bounds what is broadcast.
CELL, ALL_PIVOTS = 2_000, 20_000
#: Sample vectors of a label on which the number of its pivots is judged, beside those that may become pivots.
JUDGED = 256
#: What sending a vector to a task costs, in pairs of vectors that are compared.
SENDING = 1_000.0
#: Vectors of a block; a task holds two.
BLOCK = 8_192
#: Cosines this close to the limit are computed again, from the vectors as given and with exact sums.
EDGE = 1e-9


def usable(df: DataFrame, salt: int = 0) -> DataFrame:
    """(vec_id, label, v, uid): v is null for vectors that link with nothing; uid is a hash of label and vector."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists(v, lambda x: x != 0)
    v = F.when(F.col("label").isNull() | v.isNull() | F.coalesce(bad, F.lit(True)) | zero, None).otherwise(v)
    return df.select("vec_id", "label", v.alias("v")).withColumn("uid", F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(salt), "label", "v")))


def choose_pivots(nodes: DataFrame, r: float) -> dict:
    """Label to an array of pivots, for labels of more than CELL vectors; ALL_PIVOTS rows at most are pivots, and twice that and JUDGED for each label are looked at."""
    sizes = nodes.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > CELL)
    sizes = sizes.orderBy(F.desc("n"), "label", "dim").limit(ALL_PIVOTS // 8).collect()  # labels beyond stay one cell, dealt out in blocks
    if not sizes:
        return {}
    want = {(x["label"], x["dim"]): math.ceil(x["n"] / CELL) for x in sizes}
    shrink = min(1.0, ALL_PIVOTS / sum(want.values()))
    most = {k: max(1, int(v * shrink)) for k, v in want.items()}
    drawn = [(*k, x["n"], 2 * most[k] + JUDGED) for k, x in zip(want, sizes, strict=True)]
    table = nodes.sparkSession.createDataFrame(drawn, nodes.select("label", "dim").schema.simpleString()[7:-1].replace(":", " ") + ", n long, k int")
    # The hash thins a label to about 2 k vectors, of which the k of smallest hash serve.
    thinned = nodes.join(F.broadcast(table), ["label", "dim"]).where(F.pmod(F.xxhash64("uid"), F.lit(1 << 30)) < F.lit(float(1 << 30)) * F.lit(2) * F.col("k") / F.col("n"))
    found: dict = {}
    for x in thinned.select("label", "dim", "n", "uid", "v").collect():
        found.setdefault((x["label"], x["dim"], x["n"]), []).append((x["uid"], x["v"]))
    out = {}
    for (label, dim, n), rows in found.items():
        x = _unit(np.array([v for _, v in sorted(rows)[: 2 * most[label, dim] + JUDGED]]))
        judged, pivots = x[-JUDGED:], x[: most[label, dim]]
        choices = [1 << k for k in range(len(pivots).bit_length()) if 1 << k <= len(pivots)]
        out[label, dim] = pivots[: min(choices, key=lambda k: expected_cost(judged, pivots[:k], r, n))]
    return out


def expected_cost(sample: np.ndarray, pivots: np.ndarray, r: float, n: int) -> float:
    """Pairs that are compared, and vectors that are sent in the price of pairs, if n vectors like the sample are dealt to these pivots."""
    row, cell, guest = assign(sample, pivots, r)
    share = n / len(sample)
    home, visits = (np.bincount(cell[guest == g], minlength=len(pivots)) * share for g in (False, True))
    blocks, guests = np.ceil(home / BLOCK), np.ceil(visits / BLOCK)
    sent = home * (blocks + guests) + visits * blocks + (home + visits) * (len(pivots) > 1)
    return float((home * (home / 2 + visits)).sum() + SENDING * sent.sum())


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def assign(x: np.ndarray, pivots: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, guest): each row's home cell, and the lower cells that it visits."""
    d2 = np.maximum(2 - 2 * (x @ pivots.T), 0)
    home = d2.argmin(1)
    own = d2[np.arange(len(x)), home]
    span = np.sqrt(np.maximum(2 - 2 * (pivots @ pivots.T), 0))[home]
    near = np.sqrt(d2) <= np.sqrt(own)[:, None] + 2 * r + 1e-7
    # Distance to the plane midway: (d_j^2 - d_home^2) / (2 |p_j - p_home|).
    near &= d2 - own[:, None] <= 2 * (r + 1e-7) * span + 1e-9
    near &= np.arange(len(pivots)) < home[:, None]
    row, cell = np.nonzero(near)
    return np.r_[np.arange(len(x)), row], np.r_[home, cell], np.r_[np.zeros(len(x), bool), np.ones(len(row), bool)]


def linked(x: np.ndarray, y: np.ndarray, raw_x: np.ndarray, raw_y: np.ndarray, same: bool, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with cosine >= ``cosine``, by strips of rows; only i < j if both blocks are the same."""
    for at in range(0, len(x), 256):
        s = x[at : at + 256] @ y.T
        if same:
            s[np.arange(len(y))[None, :] <= np.arange(at, at + len(s))[:, None]] = -2
        i, j = np.nonzero(s >= cosine - EDGE)
        close = np.abs(s[i, j] - cosine) < EDGE
        keep = np.ones(len(i), bool)
        for k in np.flatnonzero(close):
            keep[k] = exact_cosine(raw_x[at + i[k]], raw_y[j[k]]) >= cosine
        yield i[keep] + at, j[keep]


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index reachable from each of n nodes over the pairs (i, j)."""
    root = np.arange(n)
    while True:
        low = root.copy()
        m = np.minimum(root[i], root[j])
        np.minimum.at(low, i, m)
        np.minimum.at(low, j, m)
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _join_blocks(cosine: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf["side"].to_numpy() == 0
        raw = np.stack(pdf["v"].to_numpy()).astype(float)
        uid, weight, unit = pdf["uid"].to_numpy(np.int64), pdf["c"].to_numpy(np.int64), _unit(raw)
        same = bool(pdf["same"].iloc[0])
        a = np.flatnonzero(first)
        b = a if same else np.flatnonzero(~first)
        count = np.zeros(len(uid), np.int64)
        pairs_i, pairs_j = [], []
        root = np.arange(len(uid))
        for i, j in linked(unit[a], unit[b], raw[a], raw[b], same, cosine):
            gi, gj = a[i], b[j]
            np.add.at(count, gi, weight[gj])
            np.add.at(count, gj, weight[gi])
            if len(gi):
                pairs_i.append(gi)
                pairs_j.append(gj)
            if sum(map(len, pairs_i)) > 1 << 20:  # fold what is known so far
                root = spanning(len(uid), np.concatenate([np.arange(len(uid)), *pairs_i]), np.concatenate([root, *pairs_j]))
                pairs_i, pairs_j = [], []
        root = spanning(len(uid), np.concatenate([np.arange(len(uid)), *pairs_i]), np.concatenate([root, *pairs_j]))
        hit = count > 0
        return pd.DataFrame({"uid": uid[hit], "n": count[hit], "other": uid[root[hit]]})

    return run


def links(nodes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(uid, n, other) in pieces: n to be summed over a uid's rows; (uid, other) are edges that connect what is linked.

    ``nodes`` (uid, label, dim, v, c): distinct vectors of a label with their counts.
    """
    r = math.sqrt(2 - 2 * cosine)
    pivots = nodes.sparkSession.sparkContext.broadcast(choose_pivots(nodes, r))
    label = nodes.schema["label"].dataType.simpleString()

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["label", "dim", "uid", "c", "v", "cell", "guest"]
        for b in batches:
            keys = list(zip(b.column("label").to_pylist(), b.column("dim").to_pylist(), strict=True))
            own: dict = {}
            for k, key in enumerate(keys):
                own.setdefault(key, []).append(k)
            for key, rows in own.items():
                part = b.take(pa.array(rows))
                p = pivots.value.get(key)
                if p is None or len(p) < 2:
                    row, cell, guest = np.arange(len(rows)), np.zeros(len(rows), int), np.zeros(len(rows), bool)
                else:
                    x = _unit(np.array(part.column("v").to_pylist(), float))
                    row, cell, guest = assign(x, p, r)
                part = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names[:5]), pa.array(cell, pa.int32()), pa.array(guest)], names)

    dealt = cut(nodes.select("label", "dim", "uid", "c", "v").mapInArrow(cells, f"label {label}, dim int, uid long, c long, v array<double>, cell int, guest boolean"))
    size = lambda guest: F.ceil(F.sum(F.when(F.col("guest") == F.lit(guest), 1).otherwise(0)) / F.lit(BLOCK)).cast("int")
    sizes = dealt.groupBy("label", "dim", "cell").agg(size(False).alias("cores"), size(True).alias("guests")).where("cores > 0")
    mine = dealt.join(sizes, ["label", "dim", "cell"])
    block = F.pmod(F.xxhash64("uid"), F.when(F.col("guest"), F.col("guests")).otherwise(F.col("cores"))).cast("int")
    mine = mine.withColumn("block", block)
    # A core block meets itself, the later core blocks and all guest blocks; a guest block meets all core blocks.
    with_core = F.transform(F.sequence(F.lit(0), F.col("cores") - 1), lambda o: F.struct(F.least(o, "block").alias("a"), F.greatest(o, "block").alias("b"), F.lit(False).alias("g"), (o < F.col("block")).cast("int").alias("side"), (o == F.col("block")).alias("same")))
    with_guest = F.transform(F.when(F.col("guests") > 0, F.sequence(F.lit(0), F.col("guests") - 1)).otherwise(F.array().cast("array<int>")), lambda o: F.struct(F.col("block").alias("a"), o.alias("b"), F.lit(True).alias("g"), F.lit(0).alias("side"), F.lit(False).alias("same")))
    as_guest = F.transform(F.sequence(F.lit(0), F.col("cores") - 1), lambda o: F.struct(o.alias("a"), F.col("block").alias("b"), F.lit(True).alias("g"), F.lit(1).alias("side"), F.lit(False).alias("same")))
    pairs = mine.withColumn("t", F.explode(F.when(F.col("guest"), as_guest).otherwise(F.concat(with_core, with_guest)))).select("label", "dim", "cell", "t.*", "uid", "c", "v")
    return pairs.groupBy("label", "dim", "cell", "a", "b", "g").applyInPandas(_join_blocks(cosine), "uid long, n long, other long")


def distinct_vectors(embeddings: DataFrame, tries: int = 8) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): the usable rows, and each distinct vector of a label with its count, under a uid that no other has: hashes are salted anew until that is so."""
    for salt in range(tries):
        rows = usable(embeddings, salt)
        nodes = rows.where("uid is not null").groupBy("label", "v").agg(F.first("uid").alias("uid"), F.count("*").alias("c"), F.min("vec_id").alias("least"))
        nodes = cut(nodes.withColumn("dim", F.size("v")))
        if nodes.groupBy("uid").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            return rows, nodes
    raise RuntimeError(f"hashes of vectors collide under {tries} salts")


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for each row of ``embeddings``."""
    rows, nodes = distinct_vectors(embeddings)
    found = cut(links(nodes, cosine))
    roots = components(found.select(F.col("uid").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "uid")
    counts = found.groupBy("uid").agg(F.sum("n").alias("n"))
    known = nodes.select("uid", "c", "least").join(counts, "uid", "left").join(roots, "uid", "left")
    known = cut(known.select("uid", (F.coalesce("n", F.lit(0)) + F.col("c") - 1).alias("n"), "least", F.coalesce("root", "uid").alias("root")))
    least = known.groupBy("root").agg(F.min("least").alias("component"))
    known = known.join(least, "root").select("uid", "n", "component")
    out = rows.select("vec_id", "uid").join(known, "uid", "left")
    component = F.when(F.col("uid").isNull(), F.col("vec_id")).otherwise(F.col("component")).cast("long")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
