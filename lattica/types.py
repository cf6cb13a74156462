"""Flags, errors and machine constants shared by the operators. Indices are 0-based; a missing entry is 0; a NULL is an error."""

from __future__ import annotations

from enum import Enum

import numpy as np


class Flag(str, Enum):
    """A one-letter option that is given as a member or its letter, in either case."""

    @classmethod
    def of(cls, x) -> "Flag":
        try:
            return x if isinstance(x, cls) else cls(str(x).upper())
        except ValueError:
            raise ArgumentError(f"{cls.__name__.lower()} is {x!r}; it is one of {', '.join(m.value for m in cls)}") from None


class Side(Flag):
    LEFT, RIGHT = "L", "R"


class Uplo(Flag):
    UPPER, LOWER = "U", "L"


class Trans(Flag):
    NONE, TRANSPOSE, ADJOINT = "N", "T", "C"


class Diag(Flag):
    NONUNIT, UNIT = "N", "U"


class Direct(Flag):
    FORWARD, BACKWARD = "F", "B"


class StoreV(Flag):
    COLUMN, ROW = "C", "R"


class Pivot(str, Enum):
    NONE, ROW_NONZERO, ROW_MAX, COMPLETE = "none", "row_nonzero", "row_max", "complete"


class ArgumentError(ValueError):
    """A flag, size or index that an operator does not accept."""


class ZeroPivotError(ArithmeticError):
    """Elimination without row search met a zero pivot; ``step`` is its 1-based place."""

    def __init__(self, step: int):
        super().__init__(f"zero pivot in step {step}")
        self.step = step


class SingularError(ArithmeticError):
    """A pivot search found only zeros, or a triangle has a zero on its diagonal; ``step`` is its 1-based place."""

    def __init__(self, step: int):
        super().__init__(f"matrix is singular: zero pivot in step {step}")
        self.step = step


def lamch(dtype, what: str) -> float:
    """Machine constants of a real or complex type: 'E' relative rounding error (eps / 2), 'S' safe minimum, 'P' eps."""
    info = np.finfo(np.dtype(dtype))
    what = what.upper()
    if what == "E":
        return float(info.eps) / 2
    if what == "S":
        tiny, small = float(info.tiny), 1.0 / float(info.max)
        return small * (1 + float(info.eps)) if small >= tiny else tiny
    if what == "P":
        return float(info.eps)
    raise ArgumentError(f"lamch knows 'E', 'S' and 'P', not {what!r}")


def require(ok: bool, message: str) -> None:
    if not ok:
        raise ArgumentError(message)
