"""The Matrix: a DataFrame of entries and its shape.

Entries are (i, j, v), or (i, j, re, im) of a complex matrix. All transformations are lazy
DataFrame operations; shape and kind live on the driver, so sizes are validated before any job runs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.number import Num, modulus, rounded
from lattica.plans.lineage import cut_frame
from lattica.types import ArgumentError, Diag, Trans, Uplo, require

#: Largest number of elements, of all matrices in and out, that may be gathered in one task or on the driver (64 MB dense, four times that as entries).
LOCAL_ELEMENTS = 1 << 23


@dataclass(frozen=True)
class Matrix:
    df: DataFrame
    m: int
    n: int
    complex: bool = False

    # -- construction ---------------------------------------------------------------------------------------------

    @classmethod
    def from_entries(cls, df: DataFrame, m: int | None = None, n: int | None = None, check: bool = False) -> "Matrix":
        """From (i, j, v) or (i, j, re, im). Without a shape, the largest indices give it; ``check`` rejects NULLs and indices outside."""
        is_complex = "re" in df.columns
        values = ["re", "im"] if is_complex else ["v"]
        df = df.select(F.col("i").cast("long"), F.col("j").cast("long"), *(F.col(c).cast("double") for c in values))
        if m is None or n is None or check:
            bad = F.greatest(*(F.max(F.col(c).isNull().cast("int")) for c in df.columns))
            row = df.agg(F.max("i").alias("m"), F.max("j").alias("n"), F.min(F.least("i", "j")).alias("low"), bad.alias("bad")).first()
            require(not row["bad"], "an index or a value is NULL")
            require((row["low"] or 0) >= 0, "an index is negative")
            high_m, high_n = (0 if row["m"] is None else row["m"] + 1), (0 if row["n"] is None else row["n"] + 1)
            m, n = (high_m if m is None else m), (high_n if n is None else n)
            require(high_m <= m and high_n <= n, f"an index lies outside {m} x {n}")
        return cls(df, m, n, is_complex)

    @classmethod
    def from_rows(cls, df: DataFrame, key: str, array: str, n: int, m: int | None = None) -> "Matrix":
        """From one array cell a row; ``key`` is the row index."""
        e = df.select(F.col(key).cast("long").alias("i"), F.posexplode(F.col(array).cast("array<double>")).alias("j", "v"))
        return cls.from_entries(e, m, n)

    @classmethod
    def from_columns(cls, df: DataFrame, key: str, columns: list[str], m: int | None = None) -> "Matrix":
        """From numeric columns; ``key`` is the row index."""
        return cls.from_rows(df.select(F.col(key).alias("_k"), F.array(*(F.col(c).cast("double") for c in columns)).alias("_a")), "_k", "_a", len(columns), m)

    @classmethod
    def from_numpy(cls, spark: SparkSession, a: np.ndarray) -> "Matrix":
        a = np.atleast_2d(np.asarray(a))
        require(a.size <= LOCAL_ELEMENTS, "the array is too large to come from the driver")
        i, j = np.nonzero(a)
        is_complex = np.iscomplexobj(a)
        data = {"i": i.astype(np.int64), "j": j.astype(np.int64)} | ({"re": a[i, j].real.astype(float), "im": a[i, j].imag.astype(float)} if is_complex else {"v": a[i, j].astype(float)})
        schema = "i long, j long, " + ("re double, im double" if is_complex else "v double")
        return cls(spark.createDataFrame(pd.DataFrame(data), schema), *a.shape, is_complex)

    @classmethod
    def identity(cls, spark: SparkSession, n: int) -> "Matrix":
        return cls(spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v")), n, n)

    def to_numpy(self) -> np.ndarray:
        """On the driver; for matrices of LOCAL_ELEMENTS elements at most."""
        require(self.m * self.n <= LOCAL_ELEMENTS, f"{self.m} x {self.n} is too large for the driver")
        return dense(self.df.toPandas(), self.m, self.n, self.complex)

    # -- shape and elements ---------------------------------------------------------------------------------------

    def size(self, axis: int | None = None):
        return (self.m, self.n) if axis is None else (self.m, self.n)[axis]

    def __len__(self) -> int:
        return self.m * self.n

    @property
    def values(self) -> list[str]:
        return ["re", "im"] if self.complex else ["v"]

    def _place(self, key) -> tuple[int, int]:
        i, j = key if isinstance(key, tuple) else (key % self.m, key // self.m)  # linear: column by column
        if not (0 <= i < self.m and 0 <= j < self.n):
            raise IndexError(f"({i}, {j}) is outside {self.m} x {self.n}")
        return i, j

    def __getitem__(self, key):
        """One element, by (i, j) or by its place column by column: a filter that reaches the scan."""
        i, j = self._place(key)
        row = self.df.where((F.col("i") == i) & (F.col("j") == j)).agg(*(F.sum(c).alias(c) for c in self.values)).first()
        parts = [row[c] or 0.0 for c in self.values]
        return complex(*parts) if self.complex else parts[0]

    def with_element(self, key, x: complex) -> "Matrix":
        """The matrix with one element replaced."""
        i, j = self._place(key)
        x = complex(x)
        require(self.complex or not x.imag, "a real matrix takes real elements")
        one = self.df.sparkSession.createDataFrame([(i, j, x.real, x.imag)[: 2 + len(self.values)]], self.df.schema)
        return replace(self, df=self.df.where(~((F.col("i") == i) & (F.col("j") == j))).unionByName(one))

    # -- lazy views -----------------------------------------------------------------------------------------------

    def to_complex(self) -> "Matrix":
        return self if self.complex else Matrix(self.df.select("i", "j", F.col("v").alias("re"), F.lit(0.0).alias("im")), self.m, self.n, True)

    def map(self, f: Callable[[Num], Num], is_complex: bool | None = None) -> "Matrix":
        is_complex = self.complex if is_complex is None else is_complex
        x = f(Num(F.col("re"), F.col("im")) if self.complex else Num(F.col("v")))
        return Matrix(self.df.select("i", "j", *x.columns(is_complex)), self.m, self.n, is_complex)

    def scale(self, alpha: complex) -> "Matrix":
        """alpha * A; nothing is computed for 1, and 0 has no entries."""
        if alpha == 1:
            return self
        if alpha == 0:
            return self.where(F.lit(False))
        a = self.to_complex() if complex(alpha).imag else self
        return a.map(lambda x: x * Num.lit(alpha))

    @property
    def T(self) -> "Matrix":  # noqa: N802
        return Matrix(self.df.select(F.col("j").alias("i"), F.col("i").alias("j"), *self.values), self.n, self.m, self.complex)

    @property
    def H(self) -> "Matrix":  # noqa: N802
        return self.T.map(Num.conj)

    def op(self, trans) -> "Matrix":
        trans = Trans.of(trans)
        return self if trans is Trans.NONE else self.T if trans is Trans.TRANSPOSE else self.H

    def where(self, condition: Column) -> "Matrix":
        return replace(self, df=self.df.where(condition))

    def tri(self, uplo, k: int = 0, diag="N") -> "Matrix":
        """The lower (j - i <= k) or upper (j - i >= k) part; with a unit diagonal, what is stored there is replaced by ones."""
        lower, unit = Uplo.of(uplo) is Uplo.LOWER, Diag.of(diag) is Diag.UNIT
        d = F.col("j") - F.col("i")
        if not unit:
            return self.where(d <= k if lower else d >= k)
        require(k == 0, "a unit diagonal is the main one")
        one = Matrix.identity(self.df.sparkSession, min(self.m, self.n))
        strict = self.where(d < 0 if lower else d > 0)
        return replace(strict, df=strict.df.unionByName((one.to_complex() if self.complex else one).df))

    def slice(self, rows: tuple[int, int], columns: tuple[int, int]) -> "Matrix":
        """Rows and columns from the first up to, not with, the second bound; indices start at 0 again."""
        (r0, r1), (c0, c1) = rows, columns
        require(0 <= r0 <= r1 <= self.m and 0 <= c0 <= c1 <= self.n, f"{rows} x {columns} is outside {self.m} x {self.n}")
        part = self.df.where((F.col("i") >= r0) & (F.col("i") < r1) & (F.col("j") >= c0) & (F.col("j") < c1))
        return Matrix(part.select((F.col("i") - r0).alias("i"), (F.col("j") - c0).alias("j"), *self.values), r1 - r0, c1 - c0, self.complex)

    def shift(self, di: int, dj: int, m: int, n: int) -> "Matrix":
        """The same entries at other places, in a larger matrix."""
        return Matrix(self.df.select((F.col("i") + di).alias("i"), (F.col("j") + dj).alias("j"), *self.values), m, n, self.complex)

    def strided(self, step: int, axis: int = 0) -> "Matrix":
        """Every ``step``-th row or column."""
        require(step > 0, "the step is positive")
        c = "ij"[axis]
        df = self.df.where(F.col(c) % step == 0).withColumn(c, F.floor(F.col(c) / step).cast("long"))
        return replace(self, df=df, **{"mn"[axis]: -(-self.size(axis) // step)})

    def permute(self, source: DataFrame, axis: int = 0) -> "Matrix":
        """Row (or column) k of the result is row ``src`` of this one; ``source`` is (k, src), for all k or those that move."""
        c = "ij"[axis]
        moved = self.df.join(source.select(F.col("src").cast("long").alias(c), F.col("k").cast("long").alias("_k")), c, "left")
        return replace(self, df=moved.withColumn(c, F.coalesce("_k", c)).select("i", "j", *self.values))

    # -- combination ----------------------------------------------------------------------------------------------

    def add(self, other: "Matrix", alpha: complex = 1, beta: complex = 1) -> "Matrix":
        """alpha * A + beta * B: a union and one aggregation."""
        require((self.m, self.n) == (other.m, other.n), f"sizes differ: {self.size()} and {other.size()}")
        a, b = self.scale(alpha), other.scale(beta)
        if a.complex != b.complex:
            a, b = a.to_complex(), b.to_complex()
        df = a.df.unionByName(b.df).groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in a.values))
        return Matrix(df, self.m, self.n, a.complex)

    __add__ = add

    def __sub__(self, other: "Matrix") -> "Matrix":
        return self.add(other, 1, -1)

    def __matmul__(self, other: "Matrix") -> "Matrix":
        from lattica.operators.gemm import multiply

        return multiply(self, other)

    # -- reductions -----------------------------------------------------------------------------------------------

    def fro_norm(self) -> DataFrame:
        return self.df.agg(F.sqrt(F.sum(sum((F.col(c) * F.col(c) for c in self.values), F.lit(0.0)))).alias("norm")).select(F.coalesce("norm", F.lit(0.0)).alias("norm"))

    def one_norm(self) -> DataFrame:
        return self.df.groupBy("j").agg(F.sum(modulus(self.complex)).alias("s")).agg(F.coalesce(F.max("s"), F.lit(0.0)).alias("norm"))

    def inf_norm(self) -> DataFrame:
        return self.T.one_norm()

    def last_nonzero_row(self) -> DataFrame:
        """The number of rows up to the last with a non-zero element; 0 for an all-zero matrix."""
        return self._last("i")

    def last_nonzero_column(self) -> DataFrame:
        return self._last("j")

    def _last(self, c: str) -> DataFrame:
        return self.df.where(modulus(self.complex) != 0).agg(F.coalesce(F.max(c) + 1, F.lit(0)).cast("int").alias("last"))

    def compact(self, digits: int = 6) -> DataFrame:
        """Rounded non-zero entries with int indices: what queries return."""
        out = self.df.select(F.col("i").cast("int"), F.col("j").cast("int"), *(rounded(F.col(c), digits).alias(c) for c in self.values))
        return out.where(" or ".join(f"{c} <> 0" for c in self.values))


def dense(pdf: pd.DataFrame, m: int, n: int, is_complex: bool) -> np.ndarray:
    out = np.zeros((m, n), complex if is_complex else float)
    i, j = pdf["i"].to_numpy(np.int64), pdf["j"].to_numpy(np.int64)
    np.add.at(out, (i, j), pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy() if is_complex else pdf["v"].to_numpy())
    return out


def entries(a: np.ndarray) -> pd.DataFrame:
    i, j = np.nonzero(a)
    v = a[i, j]
    return pd.DataFrame({"i": i, "j": j} | ({"re": v.real, "im": v.imag} if np.iscomplexobj(a) else {"v": v}))


def in_one_task(inputs: dict[str, Matrix], outputs: dict[str, tuple[int, int]], f: Callable[..., dict[str, np.ndarray]], keep: bool = False) -> dict[str, Matrix]:
    """Run a dense kernel on whole matrices in one worker task; all are of LOCAL_ELEMENTS elements together at most.

    ``f`` takes arrays by name and returns arrays by the names and of the shapes of ``outputs``. The kernel runs lazily, once for each output that
    is used; with ``keep`` it runs now, and its outputs are kept in the checkpoint folder.
    """
    first = next(iter(inputs.values()))
    is_complex = any(x.complex for x in inputs.values())
    shapes = {k: (x.m, x.n) for k, x in inputs.items()}
    total = sum(m * n for m, n in [*shapes.values(), *outputs.values()])
    if total > LOCAL_ELEMENTS:
        raise ArgumentError(f"{total} elements are too many for one task; the limit is {LOCAL_ELEMENTS}")
    spark = first.df.sparkSession
    columns = ["re", "im"] if is_complex else ["v"]
    tags, results = {k: t for t, k in enumerate(inputs)}, {k: t for t, k in enumerate(outputs)}
    whole = None
    for k, x in inputs.items():
        part = (x.to_complex() if is_complex else x).df.select(F.lit(tags[k]).alias("tag"), "i", "j", *columns)
        whole = part if whole is None else whole.unionByName(part)
    # A row of its own, so that the kernel runs on matrices without entries too.
    whole = whole.unionByName(spark.createDataFrame([(-1, 0, 0, *(0.0,) * len(columns))], whole.schema))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        arrays = {k: dense(pdf[pdf["tag"] == tags[k]], *shape, is_complex) for k, shape in shapes.items()}
        parts = []
        for k, a in f(**arrays).items():
            e = entries(np.atleast_2d(np.asarray(a, complex if is_complex else float)))
            e.insert(0, "tag", results[k])
            parts.append(e)
        return pd.concat(parts)[["tag", "i", "j", *columns]]

    schema = "tag int, i long, j long, " + ", ".join(f"{c} double" for c in columns)
    out = whole.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(run, schema)
    out = cut_frame(out) if keep else out
    return {k: Matrix(out.where(F.col("tag") == results[k]).select("i", "j", *columns), *shape, is_complex) for k, shape in outputs.items()}
