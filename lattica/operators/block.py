"""Block matrices: rows (bi, bj, data) of row-major doubles, multiplied by BLAS in Arrow-fed workers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.matrix import Matrix
from lattica.plans.physical import BLOCK
from lattica.types import Uplo, require

SCHEMA = "bi int, bj int, nr int, nc int, data binary"
#: Blocks of the contracted index that a group takes, and the side of its square of result blocks: twice SQUARE * FAN_IN blocks, 64 MB, are in memory.
FAN_IN, SQUARE = 16, 4


@dataclass(frozen=True)
class BlockMatrix:
    """``data`` holds nr x nc float64, or complex128 interleaved as (re, im). Absent blocks are zero."""

    df: DataFrame
    m: int
    n: int
    block: int = BLOCK
    complex: bool = False

    @property
    def dtype(self):
        return np.complex128 if self.complex else np.float64

    @classmethod
    def from_matrix(cls, a: Matrix, block: int = BLOCK) -> "BlockMatrix":
        m, n, is_complex, dtype = a.m, a.n, a.complex, np.complex128 if a.complex else np.float64
        e = a.df.withColumn("bi", F.floor(F.col("i") / block).cast("int")).withColumn("bj", F.floor(F.col("j") / block).cast("int"))

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            bi, bj = int(pdf["bi"].iloc[0]), int(pdf["bj"].iloc[0])
            x = np.zeros((min(block, m - bi * block), min(block, n - bj * block)), dtype)
            v = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy() if is_complex else pdf["v"].to_numpy()
            np.add.at(x, (pdf["i"].to_numpy() - bi * block, pdf["j"].to_numpy() - bj * block), v)
            return pd.DataFrame({"bi": [bi], "bj": [bj], "nr": [x.shape[0]], "nc": [x.shape[1]], "data": [x.tobytes()]})

        return cls(e.groupBy("bi", "bj").applyInPandas(build, SCHEMA), m, n, block, is_complex)

    def to_matrix(self) -> Matrix:
        block, is_complex, dtype = self.block, self.complex, self.dtype
        values = "re double, im double" if is_complex else "v double"

        def unroll(batches):
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    x = np.frombuffer(r.data, dtype).reshape(r.nr, r.nc)
                    i, j = np.nonzero(x)
                    v = x[i, j]
                    yield pd.DataFrame({"i": i + r.bi * block, "j": j + r.bj * block} | ({"re": v.real, "im": v.imag} if is_complex else {"v": v}))

        return Matrix(self.df.mapInPandas(unroll, f"i long, j long, {values}"), self.m, self.n, is_complex)

    def multiply(self, other: "BlockMatrix", triangle: Uplo | None = None) -> "BlockMatrix":
        """Result blocks are made in squares of SQUARE x SQUARE, from FAN_IN blocks of the contracted index at a time: a block is sent to one group for
        each SQUARE result blocks. Partial products are then summed. With ``triangle`` only the result blocks that meet it are made."""
        require(self.n == other.m and self.block == other.block, "sizes differ")
        a, b = (self, other) if self.complex == other.complex else (self.to_complex(), other.to_complex())
        dtype = a.dtype
        high, wide = (max(1, -(-x // (self.block * SQUARE))) for x in (self.m, other.n))
        over = lambda c, k: F.floor(F.col(c) / k).cast("int")
        everywhere = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
        x = a.df.select("*", over("bi", SQUARE).alias("si"), everywhere(wide).alias("sj"), over("bj", FAN_IN).alias("part"))
        y = b.df.select("*", everywhere(high).alias("si"), over("bj", SQUARE).alias("sj"), over("bi", FAN_IN).alias("part"))
        if triangle:
            meets = F.col("si") >= F.col("sj") if triangle is Uplo.LOWER else F.col("si") <= F.col("sj")
            x, y = x.where(meets), y.where(meets)

        def products(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            right: dict = {}
            for r in y.itertuples(index=False):
                right.setdefault(r.bi, []).append((r.bj, np.frombuffer(r.data, dtype).reshape(r.nr, r.nc)))
            out: dict = {}
            for r in x.sort_values(["bi", "bj"]).itertuples(index=False):
                left = np.frombuffer(r.data, dtype).reshape(r.nr, r.nc)
                for bj, z in right.get(r.bj, []):
                    if triangle is None or (r.bi >= bj if triangle is Uplo.LOWER else r.bi <= bj):
                        out[r.bi, bj] = out.get((r.bi, bj), 0) + left @ z
            return pd.DataFrame([(bi, bj, *z.shape, z.tobytes()) for (bi, bj), z in out.items()], columns=["bi", "bj", "nr", "nc", "data"])

        def total(pdf: pd.DataFrame) -> pd.DataFrame:
            out = sum(np.frombuffer(d, dtype) for d in pdf["data"])
            return pdf.iloc[:1].assign(data=[out.tobytes()])

        key = ["si", "sj", "part"]
        part = x.groupBy(*key).cogroup(y.groupBy(*key)).applyInPandas(products, SCHEMA)
        if -(-self.n // self.block) > FAN_IN:
            part = part.groupBy("bi", "bj").applyInPandas(total, SCHEMA)
        return BlockMatrix(part, self.m, other.n, self.block, a.complex)

    def to_complex(self) -> "BlockMatrix":
        if self.complex:
            return self

        def widen(batches):
            for pdf in batches:
                yield pdf.assign(data=[np.frombuffer(d).astype(np.complex128).tobytes() for d in pdf["data"]])

        return BlockMatrix(self.df.mapInPandas(widen, SCHEMA), self.m, self.n, self.block, True)
