"""Householder reflectors and blocks of them, on DataFrames of any size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.number import modulus
from lattica.matrix import Matrix, in_one_task
from lattica.operators import kernels
from lattica.operators.gemm import multiply
from lattica.types import Direct, Side, StoreV, require


def larfg(x: Matrix) -> tuple[DataFrame, Matrix]:
    """((beta, tau_re, tau_im) in one row, v): the reflector that turns x into beta e1. Two aggregations, the second on
    elements scaled by the largest, so that squares neither overflow nor vanish."""
    require(x.n == 1, "x is a vector")
    re, im = ("re", F.col("im")) if x.complex else ("v", F.lit(0.0))
    size = modulus(x.complex)
    head = lambda c: F.coalesce(F.sum(F.when(F.col("i") == 0, c)), F.lit(0.0))
    one = x.df.agg(F.max(size).alias("big"), head(F.col(re)).alias("a"), head(im).alias("b"), F.max(F.when((F.col("i") > 0) & (size != 0), 1)).alias("more"))
    scaled = x.df.crossJoin(F.broadcast(one.select("big"))).agg(F.sqrt(F.sum(F.pow(size / F.col("big"), 2))).alias("norm"))
    row = one.crossJoin(F.broadcast(scaled))
    work = F.col("more").isNotNull() | (F.col("b") != 0)
    beta = -F.when(F.col("a") >= 0, F.col("norm")).otherwise(-F.col("norm")) * F.col("big")
    row = row.select(
        F.when(work & (F.lit(x.m) > 1), beta).otherwise(F.col("a")).alias("beta"), "a", "b", (work & (F.lit(x.m) > 1)).alias("work"),
    )
    out = row.select("beta", F.when(F.col("work"), (F.col("beta") - F.col("a")) / F.col("beta")).otherwise(F.lit(0.0)).alias("tau_re"), F.when(F.col("work"), -F.col("b") / F.col("beta")).otherwise(F.lit(0.0)).alias("tau_im"))
    # v = x / (alpha - beta), with a first element of 1.
    d_re, d_im = F.col("a") - F.col("beta"), F.col("b")
    sq = d_re * d_re + d_im * d_im
    body = x.df.where("i > 0").crossJoin(F.broadcast(row.where("work").select("a", "b", "beta")))
    vr, vi = (F.col(re) * d_re + im * d_im) / sq, (im * d_re - F.col(re) * d_im) / sq
    body = body.select("i", "j", vr.alias(re), *([vi.alias("im")] if x.complex else []))
    unit = Matrix.identity(x.df.sparkSession, 1)
    return out, Matrix(body.unionByName((unit.to_complex() if x.complex else unit).df), x.m, 1, x.complex)


def larf(side, v: Matrix, tau: complex, c: Matrix) -> Matrix:
    """H C or C H for H = I - tau v vᴴ, v as it stands: a product with v and a rank-1 update."""
    left = Side.of(side) is Side.LEFT
    require(v.n == 1 and v.m == (c.m if left else c.n), f"v has {v.m} elements, C is {c.size()}")
    if tau == 0:
        return c
    update = multiply(v, multiply(v.H, c)) if left else multiply(multiply(c, v), v.H)
    return c.add(update, 1, -tau)


def unit_part(v: Matrix, direct, storev) -> Matrix:
    """Columnwise V with its unit diagonal set and the zeros beside it."""
    v = v if StoreV.of(storev) is StoreV.COLUMN else v.H
    require(v.m >= v.n, f"a block of {v.n} reflectors has {v.m} elements each")
    if Direct.of(direct) is Direct.FORWARD:
        return v.tri("L", diag="U")
    off = v.m - v.n
    one = Matrix.identity(v.df.sparkSession, v.n)
    one = (one.to_complex() if v.complex else one).shift(off, 0, v.m, v.n)
    return Matrix(v.where(F.col("i") - off < F.col("j")).df.unionByName(one.df), v.m, v.n, v.complex)


def larft(direct, storev, v: Matrix, tau: np.ndarray) -> Matrix:
    """T of a block reflector. Only the k x k Gram matrix of V comes together, in the one task that runs the recurrence."""
    w = unit_part(v, direct, storev)
    k = w.n
    tau = np.asarray(tau).ravel()
    require(len(tau) == k, f"there are {k} reflectors and {len(tau)} factors")
    gram = multiply(w.H, w)
    if np.iscomplexobj(tau):
        gram = gram.to_complex()
    forward = Direct.of(direct) is Direct.FORWARD

    def recur(g: np.ndarray) -> dict[str, np.ndarray]:
        t = np.zeros((k, k), np.result_type(g, tau))
        for i in range(k) if forward else reversed(range(k)):
            done = slice(0, i) if forward else slice(i + 1, k)
            t[done, i] = -tau[i] * (t[done, done] @ g[done, i])
            t[i, i] = tau[i]
        return {"t": t}

    return in_one_task({"g": gram}, {"t": (k, k)}, recur)["t"]


def larfb(side, trans, direct, storev, v: Matrix, t: Matrix, c: Matrix) -> Matrix:
    """The block reflector I - V T Vᴴ, or its adjoint, on C: three products."""
    flip = kernels.reflector_trans(trans, v.complex or t.complex or c.complex)
    w = unit_part(v, direct, storev)
    t = t.tri("U" if Direct.of(direct) is Direct.FORWARD else "L")
    t = t.H if flip else t
    left = Side.of(side) is Side.LEFT
    require(w.m == (c.m if left else c.n) and t.m == w.n, f"V is {w.size()}, T {t.size()}, C {c.size()}")
    update = multiply(w, multiply(t, multiply(w.H, c))) if left else multiply(multiply(multiply(c, w), t), w.H)
    return c.add(update, 1, -1)
