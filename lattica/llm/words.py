"""Words of whole Arrow batches as numpy arrays: places and polynomial hashes, without a Python string a word."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lattica.llm.common import utf8

#: An odd multiplier, so it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@lru_cache(maxsize=4)
def powers(base: int, size: int) -> np.ndarray:
    out = np.empty(size, np.uint64)
    out[0] = 1
    done = 1
    while done < size:
        step = np.uint64(pow(base, done, 1 << 64))
        n = min(done, size - done)
        out[done : done + n] = out[:n] * step
        done += n
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of the hash depends on all bits before."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, that depends on its bytes alone."""
    size = 1 << max(10, int(len(raw)).bit_length())
    up, down = powers(BASE, size), powers(INVERSE, size)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs in which ``mask`` holds."""
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row of each word, its hash): words are runs of ASCII letters and digits and of any other letters' bytes, lower-cased.

    Words do not cross rows: a break is put after each.
    """
    low = pc.binary_join_element_wise(pc.utf8_lower(pc.fill_null(texts, "")), "", "\n")
    off, raw = utf8(low)
    starts, ends = spans(_LETTER[raw])
    return np.searchsorted(off, starts, side="right") - 1, span_hashes(raw, starts, ends)
