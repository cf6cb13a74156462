"""QR: factors of tiles in one task each, tall matrices of any number of rows by a tree of tiles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.matrix import LOCAL_ELEMENTS, Matrix, in_one_task
from lattica.operators import kernels
from lattica.operators.gemm import cells
from lattica.operators.triangular import _strips
from lattica.plans.lineage import cut, cut_frame
from lattica.plans.physical import BROADCAST_ORDER
from lattica.types import Side, require

#: Partial R's that a task merges in a round of the tree, and the rows of a leaf of the tree that makes Q (four times the columns, if that is more).
FAN_IN, LEAF = 16, 4096
#: Columns of a panel of matrices that do not fit one task.
PANEL = 64


@dataclass(frozen=True)
class QRResult:
    """R on and above the diagonal of ``packed``, reflectors below; ``t`` holds a triangle a panel, ``ib`` rows high; ``panel`` is set if the factors do not fit one task."""

    packed: Matrix
    t: Matrix
    panel: int | None = None

    @property
    def r(self) -> Matrix:
        return self.packed.slice((0, min(self.packed.m, self.packed.n)), (0, self.packed.n)).tri("U")

    @property
    def v(self) -> Matrix:
        return self.packed.slice((0, self.packed.m), (0, min(self.packed.m, self.packed.n))).tri("L", diag="U")

    def q(self, thin: bool = True) -> Matrix:
        n = min(self.packed.m, self.packed.n) if thin else self.packed.m
        one = Matrix.identity(self.packed.df.sparkSession, n)
        return unmqr("L", "N", self, Matrix(one.df, self.packed.m, n))


def geqrt(a: Matrix, ib: int = 32) -> QRResult:
    """Blocked Householder QR: in one task if the matrix and its factors fit one, else by panels."""
    k = min(a.m, a.n)
    require(ib >= 1 or not k, "the inner block is 1 at least")
    if 2 * a.m * a.n + ib * k > LOCAL_ELEMENTS and not a.complex:
        return geqrt_by_panels(a)
    ib = max(1, min(ib, k)) if k else 1

    def run(a):
        packed, t = kernels.geqrt(a, ib)
        return {"a": packed, "t": t}

    out = in_one_task({"a": a}, {"a": (a.m, a.n), "t": (ib, k)}, run, keep=True)
    return QRResult(out["a"], out["t"])


def geqr2(a: Matrix) -> tuple[Matrix, Matrix]:
    """Unblocked Householder QR: (packed, tau)."""

    def run(a):
        packed, tau = kernels.geqr2(a)
        return {"a": packed, "tau": tau[:, None]}

    out = in_one_task({"a": a}, {"a": (a.m, a.n), "tau": (min(a.m, a.n), 1)}, run)
    return out["a"], out["tau"]


def unmqr(side, trans, f: QRResult, c: Matrix) -> Matrix:
    """op(Q) C or C op(Q). A factor that fitted one task is broadcast, and strips of C along its free side are independent; else panels are applied by products."""
    left = Side.of(side) is Side.LEFT
    require(f.packed.m == (c.m if left else c.n), f"Q has order {f.packed.m}, C is {c.size()}")
    is_complex = f.packed.complex or c.complex
    adjoint = kernels.reflector_trans(trans, is_complex)
    if f.panel:
        return _unmqr_by_panels(left, adjoint, f, c)
    a, t = f.packed.to_numpy(), f.t.to_numpy()
    return _strips(c, left, f.packed.complex, lambda x: kernels.unmqr(side, trans, a, t, x))


def _tiles(kernel, a1: Matrix, a2: Matrix, ib: int) -> tuple[Matrix, Matrix, Matrix]:
    require(a1.n == a2.n, f"A1 has {a1.n} columns, A2 {a2.n}")
    k = min(a1.m, a1.n)
    ib = max(1, min(ib, k))

    def run(a1, a2):
        r, v, t = kernel(a1, a2, ib)
        return {"r": r, "v": v, "t": t}

    out = in_one_task({"a1": a1, "a2": a2}, {"r": (a1.m, a1.n), "v": (a2.m, a2.n), "t": (ib, k)}, run, keep=True)
    return out["r"], out["v"], out["t"]


def tsqrt(a1: Matrix, a2: Matrix, ib: int = 32) -> tuple[Matrix, Matrix, Matrix]:
    """QR of an upper triangle over a full tile: (R, V, T)."""
    return _tiles(kernels.tsqrt, a1, a2, ib)


def ttqrt(a1: Matrix, a2: Matrix, ib: int = 32) -> tuple[Matrix, Matrix, Matrix]:
    """QR of an upper triangle over an upper triangle: (R, V, T)."""
    return _tiles(kernels.ttqrt, a1, a2, ib)


def _apply(kernel, side, trans, a1: Matrix, a2: Matrix, v: Matrix, t: Matrix) -> tuple[Matrix, Matrix]:
    def run(a1, a2, v, t):
        x, y = kernel(side, trans, a1, a2, v, t)
        return {"a1": x, "a2": y}

    out = in_one_task({"a1": a1, "a2": a2, "v": v, "t": t}, {"a1": (a1.m, a1.n), "a2": (a2.m, a2.n)}, run, keep=True)
    return out["a1"], out["a2"]


def tsmqr(side, trans, a1: Matrix, a2: Matrix, v: Matrix, t: Matrix) -> tuple[Matrix, Matrix]:
    """op(Q) of tsqrt on [A1; A2] from the left or [A1 A2] from the right."""
    return _apply(kernels.tsmqr, side, trans, a1, a2, v, t)


def ttmqr(side, trans, a1: Matrix, a2: Matrix, v: Matrix, t: Matrix) -> tuple[Matrix, Matrix]:
    """op(Q) of ttqrt on [A1; A2] from the left or [A1 A2] from the right."""
    return _apply(kernels.ttmqr, side, trans, a1, a2, v, t)


# -- tall matrices ------------------------------------------------------------------------------------------------


def _qr(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.linalg.qr(np.vstack(parts))


def _merge(group: pd.DataFrame, n: int) -> tuple[list[int], list[np.ndarray]]:
    """Nodes of a group in order, and their triangles."""
    group = group.sort_values("node")
    return group["node"].tolist(), [np.frombuffer(x).reshape(-1, n) for x in group["r"]]


def tall_r(rows: DataFrame, array: str, n: int) -> Matrix:
    """R (n x n, diagonal not negative) of the matrix whose rows are the cells of ``array``, without row keys or order.

    Each task folds its Arrow batches into one R; partial R's are merged FAN_IN at a time until one is left. What is shuffled is n x n numbers a
    task, whatever the number of rows. Null cells, null elements and cells of another length are errors.
    """
    require(n <= BROADCAST_ORDER, f"{n} columns are too many for a tree of triangles; the limit is {BROADCAST_ORDER}")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = np.zeros((0, n))
        for b in batches:
            flat = b.column("_a").flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            for s in range(0, len(flat), max(4096, 4 * n)):
                r = np.linalg.qr(np.vstack([r, flat[s : s + max(4096, 4 * n)]]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["node", "r"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, parts = _merge(pdf, n)
        return pd.DataFrame({"node": [nodes[0] // FAN_IN], "r": [np.linalg.qr(np.vstack(parts), mode="r").tobytes()]})

    def unroll(pdf: pd.DataFrame) -> pd.DataFrame:
        r = np.linalg.qr(np.vstack(_merge(pdf, n)[1]), mode="r")
        r = kernels.positive_diagonal(np.vstack([r, np.zeros((n - len(r), n))]))
        i, j = np.triu_indices(n)
        return pd.DataFrame({"i": i, "j": j, "v": r[i, j]})

    df = cut_frame(rows.select(cells(rows, array, n).alias("_a")).mapInArrow(fold, "node long, r binary"))
    last = df.agg(F.max("node")).first()[0] or 0
    while last >= FAN_IN:
        df, last = df.groupBy(F.floor(F.col("node") / FAN_IN).alias("_g")).applyInPandas(merge, "node long, r binary"), last // FAN_IN
    return Matrix(df.groupBy(F.lit(0).alias("_g")).applyInPandas(unroll, "i long, j long, v double"), n, n)


def tall_q(rows: DataFrame, key: str, array: str, n: int) -> tuple[Matrix, Matrix]:
    """(thin Q, R) by a tree: leaves of LEAF rows are factored apart, their triangles FAN_IN at a time, and the merges are then replayed downwards.

    Q has orthonormal columns whatever the rank, as each node's Householder Q has: nothing is divided by R. With fewer rows than columns Q has as many
    columns as rows. The keys are the row numbers, each once; cells as for ``tall_r``. R is on the driver once (n x n).
    """
    require(n <= BROADCAST_ORDER, f"{n} columns are too many for a tree of triangles; the limit is {BROADCAST_ORDER}")
    spark, size = rows.sparkSession, max(LEAF, 4 * n)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            leaf = (seen + np.arange(b.num_rows)) // size
            seen += b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, part, np.int64)), pa.array(leaf), b.column("i"), b.column("a")], ["part", "leaf", "i", "a"])

    dealt = rows.select(F.col(key).cast("long").alias("i"), cells(rows, array, n).alias("a")).mapInArrow(deal, "part long, leaf long, i long, a array<double>")
    dealt = cut_frame(dealt)
    # Leaves are numbered through: one number a task comes to the driver.
    first, counts = 0, []
    for r in dealt.groupBy("part").agg(F.max("leaf").alias("last")).orderBy("part").collect():
        counts.append((r["part"], first))
        first += r["last"] + 1
    if not first:
        return Matrix.from_numpy(spark, np.zeros((0, n))), Matrix.from_numpy(spark, np.zeros((n, n)))
    leaves = dealt.join(F.broadcast(spark.createDataFrame(counts, "part long, first long")), "part").select((F.col("first") + F.col("leaf")).alias("node"), "i", "a")

    def stacked(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        pdf = pdf.sort_values("i", kind="stable")
        return pdf, np.stack(pdf["a"].to_numpy())

    def leaf_r(pdf: pd.DataFrame) -> pd.DataFrame:
        _, x = stacked(pdf)
        return pd.DataFrame({"node": pdf["node"].iloc[:1], "r": [np.linalg.qr(x, mode="r").tobytes()]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        """The parent's triangle, and for each child its rows of the merge's Q."""
        nodes, parts = _merge(pdf, n)
        q, r = _qr(parts)
        edges = np.cumsum([0, *map(len, parts)])
        out = [(-1, nodes[0] // FAN_IN, r.tobytes())] + [(q.shape[1], k, q[s:e].tobytes()) for k, s, e in zip(nodes, edges[:-1], edges[1:], strict=True)]
        return pd.DataFrame(out, columns=["wide", "node", "r"])

    level, levels = cut_frame(leaves.groupBy("node").applyInPandas(leaf_r, "node long, r binary")), []
    while first > 1:
        made = cut_frame(level.groupBy(F.floor(F.col("node") / FAN_IN).alias("_g")).applyInPandas(merge, "wide int, node long, r binary"))
        levels.append(made.where("wide >= 0"))
        level, first = made.where("wide < 0").select("node", "r"), -(-first // FAN_IN)
    r = np.frombuffer(level.first()["r"]).reshape(-1, n)
    rank = len(r)
    sign = np.where(np.diagonal(r) < 0, -1.0, 1.0)
    r = sign[:, None] * r
    factor = spark.createDataFrame([(0, bytearray(np.diag(sign).tobytes()))], "node long, m binary")

    def descend(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [(x.node, (np.frombuffer(x.r).reshape(-1, x.wide) @ np.frombuffer(x.m).reshape(x.wide, rank)).tobytes()) for x in pdf.itertuples(index=False)]
        return pd.DataFrame(out, columns=["node", "m"])

    for made in reversed(levels):
        parents = factor.withColumnRenamed("node", "_parent")
        joined = made.join(parents, F.floor(F.col("node") / FAN_IN) == F.col("_parent")).select("wide", "node", "r", "m")
        factor = joined.mapInPandas(lambda it: (descend(x) for x in it), "node long, m binary")

    def rows_of_q(x: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        x, a = stacked(x)
        q = np.linalg.qr(a)[0] @ np.frombuffer(m["m"].iloc[0]).reshape(-1, rank)
        return pd.DataFrame({"i": x["i"], "a": list(q)})

    q = leaves.groupBy("node").cogroup(factor.groupBy("node")).applyInPandas(rows_of_q, "i long, a array<double>")
    m = int(dealt.agg(F.max("i")).first()[0]) + 1
    thin = Matrix(cut_frame(q).select("i", F.posexplode("a").alias("j", "v")).withColumn("j", F.col("j").cast("long")), m, rank)
    return thin, Matrix.from_numpy(spark, np.vstack([r, np.zeros((n - rank, n))]))


# -- matrices of any size -----------------------------------------------------------------------------------------


def reflectors_of(q1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(V1, U, T, signs) of an orthonormal Q whose first rows are ``q1``: with V = [V1; Q2 U⁻¹], I - V T Vᵀ has the columns of Q times the signs.

    The signs are chosen while Q - [S; 0] is eliminated, so that every pivot is one at least and none has to be searched for.
    """
    a, n = q1.copy(), len(q1)
    sign = np.zeros(n)
    for k in range(n):
        sign[k] = -1.0 if a[k, k] >= 0 else 1.0
        a[k, k] -= sign[k]
        a[k + 1 :, k] /= a[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :])
    v1, u = np.tril(a, -1) + np.eye(n), np.triu(a)
    return v1, u, -kernels.trsm("R", "L", "T", "U", v1, u * sign), sign


def geqrt_by_panels(a: Matrix, panel: int = PANEL) -> QRResult:
    """Blocked QR of a real matrix of any size: each panel is factored by the tree, its reflectors are made from its Q, and block products update what trails.

    Only panel x panel numbers come to the driver; a panel of m rows is never in one task.
    """
    require(not a.complex, "a complex matrix must fit one task")
    spark, k = a.df.sparkSession, min(a.m, a.n)
    packed, t, rest = [], [], cut(a)
    for s in range(0, k, panel):
        e = min(s + panel, k)
        w, m, n = e - s, a.m - s, a.n - s
        head = rest.slice((0, m), (0, w))
        found = head.df.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "v"))).alias("x"))
        dense_rows = spark.range(m).withColumnRenamed("id", "i").join(found, "i", "left")
        cell = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(w - 1).cast("long")), lambda j: F.coalesce(F.col("x")[j], F.lit(0.0)))
        q, r = tall_q(dense_rows.select("i", cell.alias("a")), "i", "a", w)
        v1, u, t_block, sign = reflectors_of(q.slice((0, w), (0, w)).to_numpy())
        q2 = q.slice((w, m), (0, w))
        below = q2 @ Matrix.from_numpy(spark, kernels.trsm("L", "U", "N", "N", u, np.eye(w)))
        top = Matrix.from_numpy(spark, v1)
        v = cut(Matrix(top.df.unionByName(below.shift(w, 0, m, w).df), m, w))
        packed += [v.tri("L", -1).shift(s, s, a.m, a.n), Matrix.from_numpy(spark, sign[:, None] * r.to_numpy()).tri("U").shift(s, s, a.m, a.n)]
        t.append(Matrix.from_numpy(spark, t_block).shift(0, s, panel, k))
        if w < n:
            tail = rest.slice((0, m), (w, n))
            tail = cut(tail.add(v @ (Matrix.from_numpy(spark, t_block.T) @ (v.T @ tail)), 1, -1))
            packed.append(tail.slice((0, w), (0, n - w)).shift(s, e, a.m, a.n))
            rest = tail.slice((w, m), (0, n - w))
    join = lambda parts, m, n: reduce(lambda x, y: Matrix(x.df.unionByName(y.df), m, n), parts, Matrix(a.df.limit(0), m, n))
    return QRResult(join(packed, a.m, a.n), join(t, min(panel, k) if k else 1, k), panel)


def _unmqr_by_panels(left: bool, adjoint: bool, f: QRResult, c: Matrix) -> Matrix:
    """The reflectors' panels applied one by one, by products; from the right they are applied to the transpose."""
    if not left:
        return _unmqr_by_panels(True, not adjoint, f, c.T).T
    k = min(f.packed.m, f.packed.n)
    starts = list(range(0, k, f.panel))
    for s in starts if adjoint else reversed(starts):
        e = min(s + f.panel, k)
        v = f.packed.slice((s, f.packed.m), (s, e)).tri("L", diag="U")
        t = f.t.slice((0, e - s), (s, e))
        own = c.slice((s, c.m), (0, c.n))
        change = v @ ((t.T if adjoint else t) @ (v.T @ own))
        c = cut(c.add(change.shift(s, 0, c.m, c.n), 1, -1))
    return c
