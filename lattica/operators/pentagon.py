"""Products with pentagonal matrices, and the block reflectors built on them: joins with a triangle filtered out.

V's l x l corner is triangular: columnwise V has it at the bottom left, upper (forward), or at the top right, lower (backward);
rowwise V at the top right, lower (forward), or at the bottom left, upper (backward).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.matrix import Matrix
from lattica.operators import kernels
from lattica.operators.gemm import multiply
from lattica.types import Direct, Side, StoreV, Trans, require


def pentagon(v: Matrix, l: int, direct, storev) -> Matrix:  # noqa: E741
    """V without what its triangular corner leaves out."""
    require(0 <= l <= min(v.m, v.n), f"the corner of a {v.m} x {v.n} matrix has no order {l}")
    i, j = F.col("i"), F.col("j")
    forward = Direct.of(direct) is Direct.FORWARD
    if (StoreV.of(storev) is StoreV.COLUMN) == forward:
        return v.where(i - (v.m - l) <= j)
    return v.where(j - (v.n - l) <= i)


def pemv(trans, storev, l: int, alpha: complex, a: Matrix, x: Matrix, beta: complex, y: Matrix) -> Matrix:  # noqa: E741
    """alpha op(A) x + beta y for a pentagonal A: columnwise A is transposed, rowwise A is not."""
    trans, column = Trans.of(trans), StoreV.of(storev) is StoreV.COLUMN
    require(column != (trans is Trans.NONE), "columnwise A is used as Aᵀ or Aᴴ, rowwise A as it is")
    p = pentagon(a, l, "F", storev).op(trans)
    require(p.n == x.m and p.m == y.m, f"op(A) is {p.size()}, x has {x.m} and y {y.m} elements")
    if alpha == 0:
        return y.scale(beta)
    out = multiply(p, x).scale(alpha)
    return out if beta == 0 else out.add(y, 1, beta)


def _columnwise(v: Matrix, l: int, direct, storev) -> Matrix:  # noqa: E741
    p = pentagon(v, l, direct, storev)
    return p if StoreV.of(storev) is StoreV.COLUMN else p.H


def pamm_w(side, direct, storev, l: int, a1: Matrix, a2: Matrix, v: Matrix) -> Matrix:  # noqa: E741
    """W = A1 + Vᴴ A2 from the left, A1 + A2 V from the right, for columnwise V (its adjoint, if stored by rows)."""
    p = _columnwise(v, l, direct, storev)
    left = Side.of(side) is Side.LEFT
    require(p.m == (a2.m if left else a2.n), f"V is {v.size()}, A2 {a2.size()}")
    return a1.add(multiply(p.H, a2) if left else multiply(a2, p))


def pamm_a(side, direct, storev, l: int, a2: Matrix, v: Matrix, w: Matrix) -> Matrix:  # noqa: E741
    """A2 - V W from the left, A2 - W Vᴴ from the right."""
    p = _columnwise(v, l, direct, storev)
    return a2.add(multiply(p, w) if Side.of(side) is Side.LEFT else multiply(w, p.H), 1, -1)


def pamm(op: str, side, direct, storev, l: int, a1: Matrix, a2: Matrix, v: Matrix, w: Matrix | None = None) -> Matrix:  # noqa: E741
    """``op`` 'W' gives W, 'A' gives the new A2."""
    require(op in ("W", "A"), f"op is {op!r}; it is 'W' or 'A'")
    if op == "W":
        return pamm_w(side, direct, storev, l, a1, a2, v)
    require(w is not None, "op 'A' needs W")
    return pamm_a(side, direct, storev, l, a2, v, w)


def parfb(side, trans, direct, storev, l: int, a1: Matrix, a2: Matrix, v: Matrix, t: Matrix) -> tuple[Matrix, Matrix]:  # noqa: E741
    """The block reflector with vectors [I; V] on [A1; A2], or on [A1 A2] from the right: (A1, A2)."""
    flip = kernels.reflector_trans(trans, any(x.complex for x in (a1, a2, v, t)))
    t = t.tri("U" if Direct.of(direct) is Direct.FORWARD else "L")
    t = t.H if flip else t
    w = pamm_w(side, direct, storev, l, a1, a2, v)
    w = multiply(t, w) if Side.of(side) is Side.LEFT else multiply(w, t)
    return a1.add(w, 1, -1), pamm_a(side, direct, storev, l, a2, v, w)
