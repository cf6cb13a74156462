"""Real or complex values as one or two double columns, with the same arithmetic for both."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Num:
    """A value; ``im`` is None for a real one."""

    re: Column
    im: Column | None = None

    @classmethod
    def of(cls, alias: str, is_complex: bool) -> "Num":
        return cls(F.col(f"{alias}.re"), F.col(f"{alias}.im")) if is_complex else cls(F.col(f"{alias}.v"))

    @classmethod
    def lit(cls, x: complex) -> "Num":
        x = complex(x)
        return cls(F.lit(x.real), F.lit(x.imag) if x.imag else None)

    def conj(self) -> "Num":
        return Num(self.re, None if self.im is None else -self.im)

    def __mul__(self, other: "Num") -> "Num":
        if self.im is None and other.im is None:
            return Num(self.re * other.re)
        if self.im is None:
            return Num(self.re * other.re, self.re * other.im)
        if other.im is None:
            return Num(self.re * other.re, self.im * other.re)
        return Num(self.re * other.re - self.im * other.im, self.re * other.im + self.im * other.re)

    def columns(self, is_complex: bool) -> list[Column]:
        """The columns v, or re and im."""
        if not is_complex:
            return [self.re.alias("v")]
        return [self.re.alias("re"), (F.lit(0.0) if self.im is None else self.im).alias("im")]


def modulus(is_complex: bool) -> Column:
    return F.hypot("re", "im") if is_complex else F.abs("v")


def rounded(column: Column, digits: int = 6) -> Column:
    """Rounded, with -0 as 0: what queries compare across engines."""
    r = F.round(column, digits)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)
