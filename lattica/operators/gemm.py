"""Products. Entries join on the contracted index and are summed; large dense products go by blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.number import Num
from lattica.matrix import Matrix
from lattica.plans.physical import BROADCAST_ORDER, Strategy, choose_product
from lattica.types import Trans, Uplo, require


def multiply(a: Matrix, b: Matrix, strategy: Strategy | None = None) -> Matrix:
    """A B, by entries or by blocks as the planner says."""
    require(a.n == b.m, f"inner sizes differ: {a.size()} and {b.size()}")
    if (strategy or choose_product(a.m, a.n, b.n)) is Strategy.BLOCK:
        from lattica.operators.block import BlockMatrix

        return BlockMatrix.from_matrix(a).multiply(BlockMatrix.from_matrix(b)).to_matrix()
    is_complex = a.complex or b.complex
    x, y = a.df.alias("a"), b.df.alias("b")
    z = Num.of("a", a.complex) * Num.of("b", b.complex)
    df = x.join(y, F.col("a.j") == F.col("b.i")).select(F.col("a.i").alias("i"), F.col("b.j").alias("j"), *z.columns(is_complex))
    names = ["re", "im"] if is_complex else ["v"]
    return Matrix(df.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in names)), a.m, b.n, is_complex)


def gemm(trans_a, trans_b, alpha: complex, a: Matrix, b: Matrix, beta: complex = 0, c: Matrix | None = None) -> Matrix:
    """alpha op(A) op(B) + beta C; the transposes are swapped columns, so they cost nothing."""
    x, y = a.op(trans_a), b.op(trans_b)
    if alpha == 0 or not x.n:
        out = Matrix(x.df.limit(0), x.m, y.n, x.complex)
    else:
        out = multiply(x, y).scale(alpha)
    return out if c is None or beta == 0 else out.add(c, 1, beta)


def gemm_add(a: Matrix, b: Matrix, c: Matrix) -> Matrix:
    """C + A B."""
    return gemm("N", "N", 1, a, b, 1, c)


def gemm_sub(a: Matrix, b: Matrix, c: Matrix) -> Matrix:
    """A - B C."""
    return gemm("N", "N", -1, b, c, 1, a)


def _rank_k(uplo, trans, alpha: complex, a: Matrix, beta: complex, c: Matrix | None, conjugate: bool, ib: int | None) -> Matrix:
    """By entries, or by blocks (of ``ib``, if given) of which those of one triangle are made."""
    x = a if Trans.of(trans) is Trans.NONE else a.op("C" if conjugate else "T")
    y = x.H if conjugate else x.T
    lower = Uplo.of(uplo) is Uplo.LOWER
    if ib or choose_product(x.m, x.n, x.m) is Strategy.BLOCK:
        from lattica.operators.block import BlockMatrix

        size = (ib,) if ib else ()
        out = BlockMatrix.from_matrix(x, *size).multiply(BlockMatrix.from_matrix(y, *size), Uplo.of(uplo)).to_matrix().tri(uplo).scale(alpha)
        return out if c is None or beta == 0 else out.add(c.tri(uplo), 1, beta)
    is_complex = x.complex
    z = Num.of("a", x.complex) * Num.of("b", y.complex)
    half = F.col("a.i") >= F.col("b.j") if lower else F.col("a.i") <= F.col("b.j")  # in the join: half the products are never made
    df = x.df.alias("a").join(y.df.alias("b"), (F.col("a.j") == F.col("b.i")) & half).select(F.col("a.i").alias("i"), F.col("b.j").alias("j"), *z.columns(is_complex))
    out = Matrix(df.groupBy("i", "j").agg(*(F.sum(v).alias(v) for v in x.values)), x.m, x.m, is_complex).scale(alpha)
    return out if c is None or beta == 0 else out.add(c.tri(uplo), 1, beta)


def syrk(uplo, trans, alpha: complex, a: Matrix, beta: complex = 0, c: Matrix | None = None, ib: int | None = None) -> Matrix:
    """One triangle of alpha A Aᵀ + beta C (Aᵀ A for trans other than N)."""
    return _rank_k(uplo, trans, alpha, a, beta, c, False, ib)


def herk(uplo, trans, alpha: float, a: Matrix, beta: float = 0, c: Matrix | None = None, ib: int | None = None) -> Matrix:
    """One triangle of alpha A Aᴴ + beta C (Aᴴ A for trans other than N)."""
    return _rank_k(uplo, trans, alpha, a, beta, c, True, ib)


def _rank_2k(uplo, trans, alpha: complex, a: Matrix, b: Matrix, beta: complex, c: Matrix | None, conjugate: bool) -> Matrix:
    require((a.m, a.n) == (b.m, b.n), f"sizes differ: {a.size()} and {b.size()}")
    adjoint = "C" if conjugate else "T"
    if Trans.of(trans) is not Trans.NONE:
        a, b = a.op(adjoint), b.op(adjoint)
    alpha2 = complex(alpha).conjugate() if conjugate else alpha
    one = multiply(a, b.op(adjoint)).tri(uplo).scale(alpha)
    two = multiply(b, a.op(adjoint)).tri(uplo).scale(alpha2 if complex(alpha2).imag else complex(alpha2).real)
    out = one.add(two)
    return out if c is None or beta == 0 else out.add(c.tri(uplo), 1, beta)


def syr2k(uplo, trans, alpha: complex, a: Matrix, b: Matrix, beta: complex = 0, c: Matrix | None = None) -> Matrix:
    """One triangle of alpha (A Bᵀ + B Aᵀ) + beta C."""
    return _rank_2k(uplo, trans, alpha, a, b, beta, c, False)


def her2k(uplo, trans, alpha: complex, a: Matrix, b: Matrix, beta: float = 0, c: Matrix | None = None) -> Matrix:
    """One triangle of alpha A Bᴴ + conj(alpha) B Aᴴ + beta C."""
    return _rank_2k(uplo, trans, alpha, a, b, beta, c, True)


def cells(rows: DataFrame, array: str, n: int) -> Column:
    """The cells as doubles; a null one, one of another length than ``n`` and one with a null element are errors."""
    a = F.col(array).cast("array<double>")
    right = F.coalesce((F.size(a) == n) & ~F.exists(a, lambda x: x.isNull()), F.lit(False))
    return F.when(right, a).otherwise(F.raise_error(F.lit(f"a cell of {array} has not {n} numbers")).cast("array<double>"))


def tall_gram(rows: DataFrame, array: str, n: int) -> Matrix:
    """XᵀX of the matrix whose rows are the cells of ``array``, without row keys.

    Each task adds up its Arrow batches' Gram matrices and gives one; the shuffle moves n (n + 1) / 2 sums a task whatever the number
    of rows, where a join on the row index would first make n times as many rows as there are elements.
    """
    require(n <= BROADCAST_ORDER, f"{n} columns are too many for one task's Gram matrix; the limit is {BROADCAST_ORDER}")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((n, n))
        for b in batches:
            x = b.column("_a").flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            g += x.T @ x
        i, j = np.nonzero(np.triu(g))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(g[i, j])], ["i", "j", "v"])

    half = rows.select(cells(rows, array, n).alias("_a")).mapInArrow(partial, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    mirrored = half.unionByName(half.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    return Matrix(mirrored, n, n)
