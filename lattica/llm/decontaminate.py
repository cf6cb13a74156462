"""Operator 6, benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over WIDTH token places, of which it looks at some: a substituted token at an ignored place
leaves the hash as it is. Hashes of all benchmark windows are matched with those of all document windows; around a hit,
document and item are laid on each other at the hit's offset and the stretch with the most agreeing tokens is looked for.
A document is contaminated if a window of ``window`` tokens (the whole item, if it is shorter) agrees in a share
``similarity`` of places.

The benchmark's hashes are broadcast while its words, counted as they are matched, make fewer than BROADCAST; beyond that both sides are joined by
hash, and tokens around the hits are laid on each other. Any window that agrees enough holds a hit, so both ways find the same.

Defined results: items and documents of null text have no words and match nothing, nor does an item of fewer than
MIN_ITEM words; a document row matches an item once, in its best place, the first of several; rows that repeat are matched each;
extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import chunks, cut, fresh
from lattica.llm.words import mix, words

#: Fixed masks: 1 looks at the token, 0 ignores it. With any 2 of 13 tokens substituted, one of the two masks still hits
#: (a test tries all placements); items that are shorter than a window have the short masks, which do the same for them.
MASKS, SHORT_MASKS = ("11101011", "11001111"), ("1111", "11011", "10111", "11101")
WINDOW, SIMILARITY, MIN_ITEM = 13, 0.8, 5
#: Hashes of the benchmark that are broadcast at most: 8 bytes each, beside the items' tokens.
BROADCAST = 4_000_000
FAMILIES = [(m, False) for m in MASKS] + [(m, True) for m in SHORT_MASKS]
_ODD = np.array([pow(0xA24BAED4963EE407, k + 1, 1 << 64) for k in range(16)], np.uint64)


def seed_hashes(h: np.ndarray, row: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the windows that lie within one row."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    out = np.full(n, len(mask) * 2 + mask.count("1"), np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            out += h[k : k + n] * _ODD[k]
    at = np.flatnonzero(row[:n] == row[len(mask) - 1 :])
    return at, mix(out[at])


class Index:
    """The benchmark's windows, sorted by hash, with a bit table in front."""

    def __init__(self, items: list[tuple[object, np.ndarray]], window: int, similarity: float):
        self.ids = [i for i, _ in items]
        self.tokens = [t for _, t in items]
        self.window, self.similarity = window, similarity
        self.masks = [m for m, short in FAMILIES if any(MIN_ITEM <= len(t) and (len(t) < window) == short for t in self.tokens)]
        hashes, item, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, t in enumerate(self.tokens):
            if len(t) < MIN_ITEM:
                continue
            for m in (m for m, short in FAMILIES if short == (len(t) < window)):
                at, h = seed_hashes(t, np.zeros(len(t), np.int64), m)
                hashes.append(h)
                item.append(np.full(len(at), k))
                place.append(at)
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        self.hashes, self.item, self.place = h[order], np.concatenate(item)[order], np.concatenate(place)[order]
        self.table = np.zeros(1 << 22, bool)
        self.table[(self.hashes >> np.uint64(42)).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of h, entry of the index), one for each entry with an equal hash."""
        some = np.flatnonzero(self.table[(h >> np.uint64(42)).astype(np.int64)])
        lo, hi = (np.searchsorted(self.hashes, h[some], side=s) for s in ("left", "right"))
        n = hi - lo
        which = np.repeat(some, n)
        entry = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        return which, entry


def best_overlap(doc: np.ndarray, item: np.ndarray, shift: int, window: int) -> tuple[int, int, int]:
    """(agreeing, start in the document, length): the window with the most equal tokens where item place p lies on p + shift."""
    size = min(window, len(item))
    s, e = max(0, -shift), min(len(item), len(doc) - shift)
    if e - s < size:
        return 0, 0, size
    same = np.concatenate([[0], np.cumsum(item[s:e] == doc[s + shift : e + shift])])
    agree = same[size:] - same[:-size]
    k = int(agree.argmax())
    return int(agree[k]), s + k + shift, size


def search(texts: pa.Array, index: Index) -> list[tuple[int, int, int, int, int]]:
    """(row, item, start, length, agreeing) of each contaminated row with each of its items."""
    row, h = words(texts)
    begin = np.searchsorted(row, np.arange(len(texts) + 1))
    found: set[tuple[int, int, int]] = set()
    for m in index.masks:
        at, seeds = seed_hashes(h, row, m)
        which, entry = index.hits(seeds)
        place = at[which]
        r = row[place]
        shift = place - begin[r] - index.place[entry]
        if len(r):
            found.update(map(tuple, np.unique(np.stack([r, index.item[entry], shift], 1), axis=0).tolist()))
    return verify(sorted(found), lambda r: h[begin[r] : begin[r + 1]], index.tokens, index.window, index.similarity)


def verify(found, doc, tokens, window: int, similarity: float) -> list[tuple[int, int, int, int, int]]:
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for r, k, shift in found:
        agree, start, size = best_overlap(doc(r), tokens[k], shift, window)
        if agree >= similarity * size and (agree, -start) > (best.get((r, k), (0, 0, 0))[0], -best.get((r, k), (0, 0, 0))[1]):
            best[r, k] = (agree, start, size)
    return [(r, k, start, size, agree) for (r, k), (agree, start, size) in best.items()]


def n_words(benchmark: DataFrame) -> int:
    """The number of words of all items, as they are matched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, 256):
            yield pa.RecordBatch.from_arrays([pa.array([len(words(b.column("text"))[0])], pa.int64())], ["n"])

    return benchmark.select("text").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def index_of(benchmark: DataFrame, item_column: str, window: int, similarity: float) -> Index:
    """The index of a benchmark whose size has been checked."""
    rows = benchmark.select(item_column, "text").collect()
    row, h = words(pa.array([r[1] for r in rows], pa.string()))
    edge = np.searchsorted(row, np.arange(len(rows) + 1))
    return Index([(r[0], h[edge[k] : edge[k + 1]]) for k, r in enumerate(rows)], window, similarity)


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, similarity: float = SIMILARITY, broadcast: int = BROADCAST) -> DataFrame:
    """The rows of ``documents`` that hold no item, as they are; with a broadcast benchmark no row is moved."""
    if n_words(benchmark) * len(SHORT_MASKS) > broadcast:
        row = fresh(documents.columns, "_row")
        marked = documents.withColumn(row, row_key("doc_id"))
        items = benchmark.select(F.monotonically_increasing_id().alias("item_id"), "text")
        hits = contaminated(marked, items, row, "item_id", window, similarity, broadcast).select(row).distinct()
        return marked.join(hits, row, "left_anti").select(*documents.columns)
    items = benchmark.select(F.lit(0).alias("item"), "text")
    shared = documents.sparkSession.sparkContext.broadcast(index_of(items, "item", window, similarity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, 256):
            keep = np.ones(b.num_rows, bool)
            keep[[x[0] for x in search(b.column("text"), shared.value)]] = False
            yield b.filter(pa.array(keep))

    return documents.mapInArrow(run, documents.schema)


def row_key(column: str) -> Column:
    """128 bits that tell rows by id and text."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit("\u0000"), F.coalesce("text", F.lit("")))))


def contaminated(documents: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", item_column: str = "item_id", window: int = WINDOW, similarity: float = SIMILARITY, broadcast: int = BROADCAST) -> DataFrame:
    """(id, item, start, length, agreeing): a row for each document row and item that it holds; clean documents have none.

    ``start`` counts the document's words; ``agreeing`` of ``length`` tokens from there are the item's.
    """
    spark = documents.sparkSession
    kind, item_kind = documents.schema[id_column].dataType, benchmark.schema[item_column].dataType
    schema = f"`{id_column}` {kind.simpleString()}, `{item_column}` {item_kind.simpleString()}, start int, length int, agreeing int"
    names = [id_column, item_column, "start", "length", "agreeing"]

    if n_words(benchmark) * len(SHORT_MASKS) > broadcast:
        return _joined(documents, benchmark, id_column, item_column, window, similarity, schema)
    shared = spark.sparkContext.broadcast(index_of(benchmark, item_column, window, similarity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in chunks(batches, 256):
            hits = sorted(search(b.column("text"), index))
            ids = b.column(id_column).take(pa.array([x[0] for x in hits], pa.int64()))
            item = pa.array([index.ids[x[1]] for x in hits], ids.type if item_kind == kind else None)
            yield pa.RecordBatch.from_arrays([ids, item, *(pa.array([x[k] for x in hits], pa.int32()) for k in (2, 3, 4))], names)

    return documents.select(id_column, "text").mapInArrow(run, schema)


def _joined(documents: DataFrame, benchmark: DataFrame, id_column: str, item_column: str, window: int, similarity: float, schema: str) -> DataFrame:
    """The same by an equi-join on seed hashes, for benchmarks of any size; a text with hits travels once, and then the tokens around each hit."""
    widest = max(len(m) for m, _ in FAMILIES)

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, 256):
            row, h = words(b.column("text"))
            begin = np.searchsorted(row, np.arange(b.num_rows + 1))
            for m, _ in FAMILIES:
                at, s = seed_hashes(h, row, m)
                r = row[at]
                yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(r)), pa.array((at - begin[r]).astype(np.int32)), pa.array(s.view(np.int64))], ["key", "place", "seed"])

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The tokens of a window before a hit to a window after it, and the text's number of tokens."""
        for b in chunks(batches, 64):
            row, h = words(b.column("text"))
            begin = np.searchsorted(row, np.arange(b.num_rows + 1))
            out: list[tuple] = []
            for k, places in enumerate(b.column("places").to_pylist()):
                own = h[begin[k] : begin[k + 1]]
                out += [(k, p, max(0, p - window + 1), len(own), own[max(0, p - window + 1) : p + widest + window - 1].tobytes()) for p in places]
            own = pa.array([x[0] for x in out], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("key").take(own), *(pa.array([x[c] for x in out], pa.int32()) for c in (1, 2, 3)), pa.array([x[4] for x in out], pa.binary())], ["key", "place", "first", "size", "tokens"])

    # A row's identity: rows of the same id and text are one here and get the same result.
    docs = documents.select(F.col(id_column).alias("id"), "text", row_key(id_column).alias("key"))
    tests = benchmark.select(F.col(item_column).alias("id"), "text", row_key(item_column).alias("key"))
    found = {}
    for side, rows in (("d", docs), ("t", tests)):
        found[side] = rows.select("key", "text").mapInArrow(seeds, "key binary, place int, seed long").toDF(f"{side}_key", f"{side}_place", "seed")
    hits = cut(found["d"].join(found["t"].distinct(), "seed").select("d_key", "d_place", "t_key", "t_place").distinct())
    near = hits
    for side, rows in (("d", docs), ("t", tests)):
        places = hits.groupBy(F.col(f"{side}_key").alias("key")).agg(F.collect_set(f"{side}_place").alias("places"))  # as many as a text has at most
        texts = rows.select("key", "text").join(places.select("key"), "key", "left_semi").dropDuplicates(["key"])
        cuts = texts.join(places, "key").mapInArrow(around, "key binary, place int, first int, size int, tokens binary")
        near = near.join(cuts.toDF(*(f"{side}_{c}" for c in cuts.columns)), [f"{side}_key", f"{side}_place"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, 4096):
            at, start, length, agreeing = [], [], [], []
            columns = [b.column(c).to_pylist() for c in ("d_place", "d_first", "d_tokens", "t_place", "t_first", "t_tokens", "t_size")]
            for k, (dp, df, dt, tp, tf, tt, size) in enumerate(zip(*columns, strict=True)):
                if size < MIN_ITEM:
                    continue
                doc, item = np.frombuffer(dt, np.uint64), np.frombuffer(tt, np.uint64)
                agree, s, n = best_overlap(doc, item, (dp - df) - (tp - tf), min(window, size))
                if len(item) >= n and agree >= similarity * n:
                    at.append(k)
                    start.append(s + df)
                    length.append(n)
                    agreeing.append(agree)
            own = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("d_key").take(own), b.column("t_key").take(own), *(pa.array(x, pa.int32()) for x in (start, length, agreeing))], ["d_key", "t_key", "start", "length", "agreeing"])

    best = near.mapInArrow(check, "d_key binary, t_key binary, start int, length int, agreeing int")
    best = best.groupBy("d_key", "t_key").agg(F.max(F.struct("agreeing", -F.col("start"), "length")).alias("b"))
    items = tests.select(F.col("key").alias("t_key"), F.col("id").alias(item_column)).distinct()
    out = docs.select(F.col("key").alias("d_key"), F.col("id").alias(id_column)).join(best, "d_key").join(items, "t_key")
    return out.select(id_column, item_column, (-F.col("b")["col2"]).cast("int").alias("start"), F.col("b.length").alias("length"), F.col("b.agreeing").alias("agreeing"))
