"""Vector and rank-1 updates. A vector is an n x 1 Matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions.number import Num
from lattica.matrix import Matrix
from lattica.operators.gemm import multiply
from lattica.types import require


def axpy(a: complex, x: Matrix, y: Matrix) -> Matrix:
    """y + a x; y itself where a is 0 or the vectors are empty."""
    require((x.m, x.n) == (y.m, y.n), f"sizes differ: {x.size()} and {y.size()}")
    return y if a == 0 or not len(x) else y.add(x, 1, a)


def _ger(alpha: complex, x: Matrix, y: Matrix, a: Matrix, conjugate: bool) -> Matrix:
    require(x.n == 1 and y.n == 1, "x and y are vectors")
    require(x.m == a.m and y.m == a.n, f"x has {x.m} and y {y.m} elements, A is {a.m} x {a.n}")
    if alpha == 0 or not len(a):
        return a
    # A contraction over the one column of both: each pair of elements is an entry of the update.
    return a.add(multiply(x, y.H if conjugate else y.T), 1, alpha)


def gerc(alpha: complex, x: Matrix, y: Matrix, a: Matrix) -> Matrix:
    """A + alpha x yᴴ."""
    return _ger(alpha, x, y, a, True)


def geru(alpha: complex, x: Matrix, y: Matrix, a: Matrix) -> Matrix:
    """A + alpha x yᵀ."""
    return _ger(alpha, x, y, a, False)


def gemv(trans, alpha: complex, a: Matrix, x: Matrix, beta: complex = 0, y: Matrix | None = None) -> Matrix:
    """alpha op(A) x + beta y."""
    out = multiply(a.op(trans), x).scale(alpha)
    return out if y is None or beta == 0 else out.add(y, 1, beta)


def dot(x: Matrix, y: Matrix, conjugate: bool = True) -> Matrix:
    """xᴴ y (or xᵀ y) as a 1 x 1 matrix: one aggregation, with partial sums before the shuffle."""
    require((x.m, x.n) == (y.m, y.n), f"sizes differ: {x.size()} and {y.size()}")
    is_complex = x.complex or y.complex
    p, q = Num.of("a", x.complex), Num.of("b", y.complex)
    z = (p.conj() if conjugate else p) * q
    df = x.df.alias("a").join(y.df.alias("b"), (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j"))).select(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), *z.columns(is_complex))
    names = ["re", "im"] if is_complex else ["v"]
    return Matrix(df.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in names)), 1, 1, is_complex)
