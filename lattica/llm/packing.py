"""Operator 5, best-fit packing by a configuration linear program.

The histogram of piece lengths, at most 2048 numbers whatever the input, is covered by configurations (multisets of
lengths that fit one sequence). Multiplicative weights solve the covering program: a knapsack dynamic program
prices all rooms for the present weights, and from its table many configurations are read whose value is within a tolerance of the
best price; each is taken a share of what is left of its scarcest length, in whole sequences, so that the solution is
rounded as it grows. Met lengths lose weight, and the next round prices anew. A price turns the weights into a feasible dual solution, whose value
is a lower bound on the number of sequences. The program ends where no configuration is within GAP of the price, and what is
left then is packed by best fit. Full pieces are sequences of their own and are not ranked. The others are dealt to the slots of their length by rank: tasks count
their pieces of each length, and the sums over the tasks before give each its first rank.

Defined results: a null text is an empty one, whose only token is the end mark; rows that repeat are packed each;
an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import chunks, cut

CAPACITY = 2048
END = 0
#: Weights start as this power of the lengths: over 1, so of equal fills the one with the longer pieces is priced best.
TILT = 1.05
#: The weight of a length falls by this factor's exponential as its demand is met.
ETA = 0.1
#: The share of a length's demand that a round may meet, one piece at least.
STEP = 0.125
#: A configuration is taken if its value falls short of the price by no more than this; doubled while none is found, up to GAP.
TOLERANCE, GAP = 0.003, 0.03


@lru_cache(maxsize=2)
def encoder(path: str):
    """Texts to id lists, as the byte-level BPE of the ``tokenizers`` file at ``path`` makes them.

    The vocabulary and merges are handed to tiktoken, which runs the same algorithm several times faster; texts that hold
    an added token's string go to the library of the file itself.
    """
    import json

    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    library = Tokenizer.from_file(path)
    added = [t["content"] for t in spec.get("added_tokens", [])]
    plain = lambda texts: [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    pre = spec.get("pre_tokenizer") or {}
    if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
        return plain
    code = {c: b for b, c in byte_letters().items()}
    skip = set(added)
    ranks = {bytes(code[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in skip}
    fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    probe = "It's 12 o'clock,\n\n  naïve—ok?\t!!  x 中文🙂"
    if plain([probe])[0] != fast.encode_ordinary(probe):
        return plain
    return lambda texts: [fast.encode_ordinary(t) if not any(a in t for a in added) else plain([t])[0] for t in texts]


#: The pattern that cuts text before byte-level BPE, and the letters that stand for bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, str]:
    """Printable bytes stand for themselves, the others for the code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, but the first takes the remainder."""
    head = n % capacity
    out = [(0, head)] if head else []
    return out + [(s, capacity) for s in range(head, n, capacity)]


def pieces(documents: DataFrame, tokenizer: str, id_column: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32, task, nth) of all documents, each with the end mark; the piece is the ``nth`` of its length in its task."""
    kind = documents.schema[id_column].dataType.simpleString()
    names = [id_column, "piece", "start", "length", "ids_crc32", "task", "nth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, task = encoder(tokenizer), Counter(), TaskContext.get().partitionId()
        for b in chunks(batches, 128):
            row, piece, start, length, crc, nth = [], [], [], [], [], []
            for k, ids in enumerate(encode([t or "" for t in b.column("text").to_pylist()])):
                ids.append(END)
                data = np.array(ids, "<u4")
                for p, (s, n) in enumerate(cuts(len(ids), capacity)):
                    row.append(k)
                    piece.append(p)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(data[s : s + n]))
                    nth.append(seen[n])
                    seen[n] += 1
            ints = (pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array([task] * len(row), pa.int32()), pa.array(nth, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(id_column).take(pa.array(row, pa.int64())), *ints], names)

    return documents.select(id_column, "text").mapInArrow(run, f"`{id_column}` {kind}, piece int, start long, length long, ids_crc32 long, task int, nth long")


def prices(values: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The greatest value of repeated lengths in each room up to ``capacity``."""
    f = np.zeros(capacity + 1)
    fitting = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        k = fitting[room]
        f[room] = max(f[room - 1], (f[room - lengths[:k]] + values[:k]).max()) if k else f[room - 1]
    return f


def configuration(f: np.ndarray, values: np.ndarray, lengths: np.ndarray, have: np.ndarray, wish: np.ndarray, slack: float) -> dict[int, int] | None:
    """(place in ``lengths``: times) of a configuration out of ``have`` pieces that is worth the price less ``slack`` at least: of the lengths that allow for it the one of greatest ``wish`` each time."""
    room, own = len(f) - 1, {}
    usable = have >= 1
    while room:
        k = int(np.searchsorted(lengths, room, side="right"))
        loss = f[room] - values[:k] - f[room - lengths[:k]]
        able = np.flatnonzero((loss <= slack) & usable[:k])
        if not len(able):
            break
        i = int(able[wish[able].argmax()])
        own[i] = own.get(i, 0) + 1
        usable[i] = have[i] >= own[i] + 1
        slack -= loss[i]
        room -= int(lengths[i])
    return own if own and f[room] <= slack + 1e-12 else None


def best_configuration(values: np.ndarray, lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[dict[int, int], float]:
    """The knapsack of greatest value over repeated lengths, by dynamic programming; (length to times, value), and no length if there are too few pieces for it."""
    f = prices(values, lengths, capacity)
    own = configuration(f, values, lengths, counts, values, 1e-12 * max(1.0, f[-1])) or {}
    return {int(lengths[i]): k for i, k in own.items()}, float(f[-1])


@dataclass(frozen=True)
class Cover:
    """Configurations (lengths, how often), the pieces of each length that are left, and a lower bound on the sequences of all pieces, by duality."""

    configurations: list[tuple[tuple[int, ...], int]]
    left: dict[int, int]
    bound: float


def configuration_lp(counts: dict[int, int], capacity: int = CAPACITY, gap: float = GAP, step: float = STEP) -> Cover:
    """Cover the histogram by multiplicative weights; with an infinite ``gap`` all of it.

    Each round meets a ``step`` of a length's demand at most. Its configurations are within the tolerance of the round's price, and the tolerance
    grows to ``gap`` only while there are none, so the program ends.
    """
    lengths = np.array(sorted(counts), np.int64)
    demand = np.array([counts[n] for n in lengths], float)
    left, base, used = demand.copy(), (lengths / capacity) ** TILT, Counter()
    bound, tolerance = float((lengths * demand).sum() / capacity), TOLERANCE
    while left.any() and tolerance <= max(gap, TOLERANCE):
        met = 1 - left / demand
        values = np.where(left > 0, base * np.exp(-ETA * (met - met.min())), 0)
        f = prices(values, lengths, capacity)
        bound = max(bound, float((values * demand).sum() / f[-1]))
        quota = np.minimum(left, np.maximum(np.ceil(step * demand), 1))
        whole, found = np.maximum(quota, 1), False
        while own := configuration(f, values, lengths, np.where(quota >= 1, left, 0), quota / whole + 1e-3 * lengths / capacity, tolerance * f[-1]):
            i, k = np.array(list(own)), np.array(list(own.values()), float)
            times = max(1.0, float((quota[i] // k).min()))
            used[tuple(sorted((int(lengths[at]) for at, n in own.items() for _ in range(n)), reverse=True))] += int(times)
            quota[i] -= times * k
            left[i] -= times * k
            found = True
        tolerance = TOLERANCE if found else 2 * tolerance
    return Cover(sorted(used.items()), {int(n): int(k) for n, k in zip(lengths, left, strict=True) if k}, bound)


def best_fit(left: dict[int, int], capacity: int) -> Counter:
    """Best-fit decreasing on the histogram: rows of equal lengths go together, so time follows the number of lengths."""
    out: Counter = Counter()
    rooms: dict[int, dict[tuple[int, ...], int]] = {}  # room to open configurations
    for n in sorted(left, reverse=True):
        many = left[n]
        for room in sorted(r for r in rooms if r >= n):
            if not many:
                break
            fit = room // n
            for config, k in list(rooms[room].items()):
                if not many:
                    break
                full = min(k, many // fit)
                for take, times in ((fit, full), (many % fit if full < k and many // fit == full else 0, 1)):
                    if take and times:
                        rooms[room][config] -= times
                        many -= take * times
                        new = (*config, *(n,) * take)
                        rooms.setdefault(room - take * n, Counter())
                        rooms[room - take * n][new] = rooms[room - take * n].get(new, 0) + times
                if not rooms[room][config]:
                    del rooms[room][config]
        fit = capacity // n
        for take, times in ((fit, many // fit), (many % fit, 1)):
            if take and times:
                rooms.setdefault(capacity - take * n, {})
                rooms[capacity - take * n][(n,) * take] = rooms[capacity - take * n].get((n,) * take, 0) + times
    for group in rooms.values():
        for config, k in group.items():
            out[config] += k
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, how often): whole configurations that hold exactly the histogram."""
    counts = {int(n): int(k) for n, k in counts.items() if k}
    full = counts.pop(capacity, 0)
    cover = configuration_lp(counts, capacity)
    out = Counter(dict(cover.configurations))
    out.update(best_fit(cover.left, capacity))
    if full:
        out[(capacity,)] += full
    return sorted(out.items(), reverse=True)


def slots(config_counts: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length, runs of ranks: (first rank, sequence of the first, offset); later ranks of a run take later sequences."""
    base = 0
    runs: dict[int, list[tuple[int, int, int]]] = {}
    seen: Counter = Counter()
    for config, k in config_counts:
        offset = 0
        for n in config:
            runs.setdefault(n, []).append((seen[n], base, offset))
            seen[n] += k
            offset += n
        base += k
    return {n: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for n, r in runs.items()}


def pack(documents: DataFrame, tokenizer: str, id_column: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): one row for each piece."""
    kept = ["piece", "start", "length", "ids_crc32"]
    made = cut(pieces(documents.withColumnRenamed(id_column, "_id"), tokenizer, "_id", capacity))
    tasks = made.where(F.col("length") < capacity).groupBy("length", "task").agg(F.count("*").alias("n"))
    sizes = {r["length"]: r["n"] for r in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # fewer rows than capacity
    planned = plan(sizes, capacity)
    dealt = made.sparkSession.sparkContext.broadcast(slots(planned))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = tasks.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = made.where(F.col("length") < capacity).join(first, ["length", "task"]).select("_id", *kept, (F.col("first") + F.col("nth")).alias("rank"))
    names = ["_id", *kept, "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = dealt.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order], prepend=-1))
            for own in np.split(order, edges[1:]) if len(order) else []:
                begin, base, at = runs[int(length[own[0]])]
                k = np.searchsorted(begin, rank[own], side="right") - 1
                seq[own] = base[k] + rank[own] - begin[k]
                offset[own] = at[k]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:5]), pa.array(seq), pa.array(offset)], names)

    kind = made.schema["_id"].dataType.simpleString()
    short = ranked.mapInArrow(place, f"_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    alone = sum(k for _, k in planned) + F.monotonically_increasing_id()
    full = made.where(F.col("length") == capacity).select("_id", *kept, alone.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return short.unionByName(full).withColumnRenamed("_id", id_column)
