"""LU factorization with four pivot strategies, row swaps, determinant and solve.

A factor that fits one task is made there; a larger one goes by panels: the panel's columns are factored in one task,
its row order is applied by a join, and what trails is updated by a block product. Tall matrices have narrower panels, so that up to two
million rows go; finished columns of L keep the numbers that their rows have in A until the end, when one join puts all in order.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.matrix import LOCAL_ELEMENTS, Matrix, in_one_task
from lattica.operators import kernels
from lattica.operators.triangular import trsm
from lattica.plans.lineage import cut
from lattica.types import Pivot, SingularError, ZeroPivotError, require

PANEL = 128


@dataclass(frozen=True)
class LUResult:
    """A[row_order][:, column_order] = L U. ``rows`` and ``columns`` hold place + 1 of each source, as m x 1 matrices; ``info_`` is 1 x 1."""

    l: Matrix
    u: Matrix
    rows: Matrix
    columns: Matrix
    info_: Matrix

    @property
    def row_perm(self) -> DataFrame:
        """(k, src): row k of L U is row src of A."""
        return _order(self.rows)

    @property
    def col_perm(self) -> DataFrame:
        return _order(self.columns)

    @property
    def info(self) -> int:
        """0, or the 1-based step of the first pivot that was zero (or raised, by getc2); negative for elimination that had to stop there."""
        return int(np.real(self.info_[0, 0]))

    def check(self) -> "LUResult":
        info = self.info
        if info < 0:
            raise ZeroPivotError(-info)
        if info:
            raise SingularError(info)
        return self

    def solve(self, b: Matrix) -> Matrix:
        """X with A X = B."""
        y = trsm("L", "L", "N", "U", self.l, b.permute(self.row_perm))
        x = trsm("L", "U", "N", "N", self.u, y)
        back = self.col_perm.select(F.col("src").alias("k"), F.col("k").alias("src"))
        return x.permute(back)

    def det(self) -> DataFrame:
        """One row: the determinant of a square matrix, as v (or re, im)."""
        require(self.l.m == self.u.n, "only square matrices have a determinant")
        n = self.l.m
        out = in_one_task({"u": self.u, "p": self.rows, "q": self.columns}, {"d": (1, 1)}, lambda u, p, q: {"d": np.prod(np.diag(u)) * _sign(p, n) * _sign(q, n)})
        return out["d"].df.select(*out["d"].values)


def _order(a: Matrix) -> DataFrame:
    return a.df.select(F.col("i").cast("int").alias("k"), (F.col(a.values[0]) - 1).cast("int").alias("src"))


def _sign(order: np.ndarray, n: int) -> float:
    p, sign, seen = np.rint(order.real).astype(int).ravel() - 1, 1.0, np.zeros(n, bool)
    for k in range(n):
        length = 0
        while not seen[k]:
            seen[k], k, length = True, p[k], length + 1
        sign *= -1.0 if length and length % 2 == 0 else 1.0
    return sign


def _results(a: Matrix, f) -> LUResult:
    k = min(a.m, a.n)

    def run(a):
        try:
            packed, rows, columns, info = f(a)
        except ZeroPivotError as e:  # told to the driver as a negative step
            packed, rows, columns, info = a, np.arange(a.shape[0]), np.arange(a.shape[1]), -e.step
        return {"l": np.tril(packed[:, :k], -1) + np.eye(a.shape[0], k), "u": np.triu(packed[:k]), "p": rows[:, None] + 1, "q": columns[:, None] + 1, "info": np.array([[info]])}

    out = in_one_task({"a": a}, {"l": (a.m, k), "u": (k, a.n), "p": (a.m, 1), "q": (a.n, 1), "info": (1, 1)}, run, keep=True)
    return LUResult(out["l"], out["u"], out["p"], out["q"], out["info"])


def lu(a: Matrix, pivot=Pivot.ROW_MAX, check: bool = False) -> LUResult:
    """P A Q = L U. ``check`` raises for a singular matrix; a zero pivot without any search raises always, as there are no factors."""
    pivot = Pivot(pivot)
    if 4 * a.m * a.n <= LOCAL_ELEMENTS or pivot in (Pivot.COMPLETE, Pivot.ROW_NONZERO):
        out = _results(a, lambda x: kernels.lu(x, pivot))
    else:
        out = lu_by_panels(a, pivot)
    return out.check() if check or pivot is Pivot.NONE else out


def getc2(a: Matrix) -> LUResult:
    """Complete pivoting that raises tiny pivots; ``info`` tells of the last that was raised."""
    require(a.m == a.n, "getc2 takes a square matrix")
    return _results(a, kernels.getc2)


def lu_by_panels(a: Matrix, pivot=Pivot.ROW_MAX, panel: int = PANEL) -> LUResult:
    """Right-looking LU of matrices too large for one task; a panel of m x ``panel`` elements, made narrower for tall matrices, must fit one."""
    pivot, k, spark = Pivot(pivot), min(a.m, a.n), a.df.sparkSession
    if not k:
        return _results(a, lambda x: kernels.lu(x, pivot))
    panel = max(1, min(panel, LOCAL_ELEMENTS // (4 * a.m)))
    order = np.arange(a.m)
    columns, upper, rest, info = [], [], cut(a), 0
    numbered = lambda p, s, names: spark.createDataFrame(pd.DataFrame({names[0]: np.arange(s, s + len(p)), names[1]: p}), f"{names[0]} long, {names[1]} long")
    for s in range(0, k, panel):
        e = min(s + panel, k)
        m, n = a.m - s, a.n - s
        head = _results(rest.slice((0, m), (0, e - s)), lambda x: kernels.lu(x, pivot))
        info = info or (head.info and s + head.info)
        turn = head.rows.to_numpy().real.ravel().astype(int) - 1
        order[s:] = order[s:][turn]
        perm = head.row_perm
        source = numbered(order[s:], 0, ("i", "src"))  # of this panel's rows
        columns.append(head.l.df.join(source, "i").select("src", (F.col("j") + s).alias("j"), *head.l.values))
        upper.append(head.u.shift(s, s, k, a.n))
        if e < a.n:
            tail = rest.slice((0, m), (e - s, n)).permute(perm)
            l11 = head.l.slice((0, e - s), (0, e - s))
            u12 = cut(trsm("L", "L", "N", "U", l11, tail.slice((0, e - s), (0, n - (e - s)))))
            upper.append(u12.shift(s, e, k, a.n))
            if e < a.m:
                below = head.l.slice((e - s, m), (0, e - s))
                rest = cut(tail.slice((e - s, m), (0, n - (e - s))).add(below @ u12, 1, -1))
    l = reduce(DataFrame.unionByName, columns).join(numbered(order, 0, ("i", "src")), "src")
    l = Matrix(l.select("i", "j", *a.values), a.m, k, a.complex)
    vector = lambda p: Matrix.from_numpy(spark, np.asarray(p, float)[:, None] + 1)
    return LUResult(l, _union(upper), vector(order), vector(np.arange(a.n)), Matrix.from_numpy(spark, np.array([[float(info)]])))


def _union(parts: list[Matrix]) -> Matrix:
    df = parts[0].df
    for p in parts[1:]:
        df = df.unionByName(p.df)
    return Matrix(df, parts[0].m, parts[0].n, parts[0].complex)


def laswp(a: Matrix, swaps: list[int], first: int = 0, forward: bool = True) -> Matrix:
    """Rows first + k and swaps[k] change places, one pair after the other (or the last first): one join with the moved rows."""
    order = np.arange(a.m)
    places = range(len(swaps)) if forward else reversed(range(len(swaps)))
    for k in places:
        require(0 <= swaps[k] < a.m and first + k < a.m, f"row {swaps[k]} is outside {a.m}")
        order[[first + k, swaps[k]]] = order[[swaps[k], first + k]]
    moved = [(int(k), int(s)) for k, s in enumerate(order) if k != s]
    if not moved:
        return a
    return a.permute(F.broadcast(a.df.sparkSession.createDataFrame(moved, "k int, src int")))  # two rows a swap at most
