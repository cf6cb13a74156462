"""Which strategy serves an operator at given sizes."""

from __future__ import annotations

from enum import Enum

#: Orders from which products go by blocks, and the block size. A block of doubles is 512 KB.
BLOCK_FROM = 256
BLOCK = 256
#: Order up to which a triangular or square factor is broadcast to tasks: 2048 squared doubles are 32 MB.
BROADCAST_ORDER = 2048


class Strategy(Enum):
    ENTRY, BLOCK = "entry", "block"


def choose_product(m: int, k: int, n: int) -> Strategy:
    """Entries for what a join and an aggregation do quickly; blocks once each product has many terms."""
    return Strategy.BLOCK if min(m, n) >= BLOCK_FROM and k >= BLOCK_FROM else Strategy.ENTRY
