"""Triangular multiply and solve, triangle self-products."""

from __future__ import annotations

from dataclasses import replace
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lattica.matrix import Matrix, dense, entries
from lattica.operators import kernels
from lattica.operators.gemm import herk, multiply
from lattica.plans.lineage import cut
from lattica.plans.physical import BROADCAST_ORDER
from lattica.types import ArgumentError, Diag, Side, Trans, Uplo, require

#: Independent columns (or rows) of the right-hand side that a task solves together.
STRIP = 256


def _check(side: Side, a: Matrix, b: Matrix) -> None:
    require(a.m == a.n, f"the triangle is square, not {a.size()}")
    require(a.n == (b.m if side is Side.LEFT else b.n), f"orders differ: {a.size()} and {b.size()}")


def trmm(side, uplo, trans, diag, a: Matrix, b: Matrix, alpha: complex = 1) -> Matrix:
    """alpha op(A) B or alpha B op(A) for the triangle of A; the other triangle is filtered out before the join."""
    side = Side.of(side)
    _check(side, a, b)
    t = a.tri(uplo, diag=diag).op(trans)
    return (multiply(t, b) if side is Side.LEFT else multiply(b, t)).scale(alpha)


def trsm(side, uplo, trans, diag, a: Matrix, b: Matrix, alpha: complex = 1, limit: int = BROADCAST_ORDER) -> Matrix:
    """X with op(A) X = alpha B or X op(A) = alpha B.

    Columns of B (rows, from the right) are independent: a triangle of order ``limit`` at most is broadcast and strips of B are
    solved apart. A larger one is split in four; the half that waits is updated by a product.
    """
    side, uplo, trans = Side.of(side), Uplo.of(uplo), Trans.of(trans)
    _check(side, a, b)
    if alpha != 1:
        b = b.scale(alpha)
    if a.m > limit:
        return _split(side, uplo, trans, diag, a, b, limit, solve=True)
    t = kernels.triangle(a.tri(uplo).to_numpy(), uplo, diag)
    if not t.diagonal().all():
        kernels.trsm("L", "L", "N", "N", t, np.zeros((len(t), 0)))  # tells the step
    return _strips(b, side is Side.LEFT, a.complex, lambda x: kernels.trsm(side, uplo, trans, "N", t, x))


def _strips(b: Matrix, by_columns: bool, is_complex: bool, f) -> Matrix:
    """Apply a dense function to strips of B's columns or rows, each in one task."""
    free, m, n = ("j" if by_columns else "i"), b.m, b.n
    is_complex = is_complex or b.complex
    b = b.to_complex() if is_complex else b
    columns = ["re", "im"] if is_complex else ["v"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = int(pdf[free].iloc[0]) // STRIP * STRIP
        width = min(STRIP, (n if by_columns else m) - at)
        pdf = pdf.assign(**{free: pdf[free] - at})
        out = entries(np.asarray(f(dense(pdf, *((m, width) if by_columns else (width, n)), is_complex)), complex if is_complex else float))
        out[free] += at
        return out[["i", "j", *columns]]

    schema = "i long, j long, " + ", ".join(f"{c} double" for c in columns)
    df = b.df.groupBy(F.floor(F.col(free) / STRIP).alias("_strip")).applyInPandas(run, schema)
    return Matrix(df, m, n, is_complex)


def _split(side: Side, uplo: Uplo, trans: Trans, diag, a: Matrix, b: Matrix, limit: int, solve: bool) -> Matrix:
    """One step of the 2 x 2 recursion: which half comes first follows from the triangle of op(A) and the side."""
    n = a.m
    mid = 1 << (n - 1).bit_length() - 1  # a power of two
    parts = {0: (0, mid), 1: (mid, n)}
    left = side is Side.LEFT
    lower = (uplo is Uplo.LOWER) == (trans is Trans.NONE)  # of op(A)
    first = 0 if (lower == left) == solve else 1
    half = lambda k: b.slice(parts[k], (0, b.n)) if left else b.slice((0, b.m), parts[k])
    diagonal = lambda k: a.slice(parts[k], parts[k])
    r, c = (1, 0) if uplo is Uplo.LOWER else (0, 1)
    corner = a.slice(parts[r], parts[c]).op(trans)
    recur = lambda k, x: (trsm(side, uplo, trans, diag, diagonal(k), x, 1, limit) if solve else _multiply(side, uplo, trans, diag, diagonal(k), x, limit))
    product = lambda x: multiply(corner, x) if left else multiply(x, corner)
    second = 1 - first
    done = {}
    if solve:
        done[first] = cut(recur(first, half(first)))
        done[second] = recur(second, cut(half(second).add(product(done[first]), 1, -1)))
    else:
        done[first] = recur(first, half(first)).add(product(half(second)))
        done[second] = recur(second, half(second))
    place = lambda k: done[k].shift(parts[k][0], 0, b.m, b.n) if left else done[k].shift(0, parts[k][0], b.m, b.n)
    return place(0).add(place(1))


def _multiply(side: Side, uplo: Uplo, trans: Trans, diag, a: Matrix, b: Matrix, limit: int) -> Matrix:
    if a.m > limit:
        return _split(side, uplo, trans, diag, a, b, limit, solve=False)
    return trmm(side, uplo, trans, diag, a, b)


def rectrxm(side, uplo, trans, alpha: complex, func: str, a: Matrix, b: Matrix, limit: int = BROADCAST_ORDER) -> Matrix:
    """Solve (func 'S') or multiply (func 'M') by recursion on the triangle, which has no unit diagonal."""
    side, uplo, trans = Side.of(side), Uplo.of(uplo), Trans.of(trans)
    require(limit >= 1, "the limit is 1 at least")
    if func not in ("S", "M"):
        raise ArgumentError(f"func is {func!r}; it is 'S' or 'M'")
    _check(side, a, b)
    if func == "S":
        return trsm(side, uplo, trans, "N", a, b, alpha, limit)
    return _multiply(side, uplo, trans, "N", a, b, limit).scale(alpha)


def lauum(uplo, a: Matrix, ib: int | None = None) -> Matrix:
    """The upper triangle of U Uᴴ, or the lower one of Lᴴ L; the other triangle is A's own. Large ones, or with ``ib`` any, go by blocks."""
    require(a.m == a.n, f"the triangle is square, not {a.size()}")
    upper = Uplo.of(uplo) is Uplo.UPPER
    product = herk(uplo, "N" if upper else "C", 1, a.tri(uplo), ib=ib)
    other = a.tri("L", -1) if upper else a.tri("U", 1)
    return replace(product, df=product.df.unionByName(other.df))


def trapezoid(uplo, a: Matrix, diag=Diag.NONUNIT) -> Matrix:
    """The lower or upper trapezoid of any matrix, with its diagonal as it is or of ones."""
    return a.tri(uplo, diag=diag)


# -- the eight direct forms, by side and triangle, without a transpose or a unit diagonal -------------------------

left_lower_trmm = partial(trmm, "L", "L", "N", "N")
left_upper_trmm = partial(trmm, "L", "U", "N", "N")
right_lower_trmm = partial(trmm, "R", "L", "N", "N")
right_upper_trmm = partial(trmm, "R", "U", "N", "N")
left_lower_trsm = partial(trsm, "L", "L", "N", "N")
left_upper_trsm = partial(trsm, "L", "U", "N", "N")
right_lower_trsm = partial(trsm, "R", "L", "N", "N")
right_upper_trsm = partial(trsm, "R", "U", "N", "N")
