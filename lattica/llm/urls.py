"""Operator 8, URL filters: host and path rules, and else a character language-model ratio.

Two variable-order Markov models, for accepted and for rejected URLs, are smoothed by interpolation: the estimate of a
character after a context of k characters blends its counts with the estimate after k - 1 (Witten-Bell weights), down to a uniform
one. A URL without a rule is judged by the difference of both log-likelihoods per character against a limit
that is calibrated on labelled URLs kept apart.

The URLs that rules decide are the labelled ones, and all distinct ones are learned from, each as a whole: 3/4 for the models, 1/4 for the limit. Scheme, query and
fragment are not looked at, and the labels of the host that the rules name are masked, so the models learn from what varies.

A character and the five before it are a gram. Grams are counted by one aggregation with map-side sums, and all orders of a model follow from them.
Up to GRAMS distinct ones the models are broadcast as sorted arrays. Beyond that the estimates of the grams that are asked for are made order by order on
tables of grams, where no key has more rows than there are characters; those of the most frequent are broadcast, and what remains, of which none is frequent, is joined.
The limit is found over all ratios in order, by ranges. Both ways sum the same numbers, in another order.

Defined results: a null URL and one without ``://`` have an empty host and path, no rule, and a ratio of 0; such a URL, and every
URL where one of the classes has no examples, is allowed; repeated rows are judged alike; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import chunks, cut, text_chunks

#: (verdict, rule): a rule is a host, with all its subdomains, and the start of a path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
ORDER = 5
#: Distinct grams that are broadcast, as models or as estimates.
GRAMS = 1 << 19
#: Characters of a host and of a path that are learned from: all.
LONGEST = (1 << 31) - 1
END = "\n"
#: Bits of any character, as its code point and one; three make a long, and 0 is none.
CODE_BITS = 21
_BLOCK = 1 << 18
SYMBOLS = 256


def host_of(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.expr("substring({u}, locate('://', {u}) + 3)".format(u="_url")))
    return F.translate(F.coalesce(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.expr("substring({u}, locate('://', {u}) + 3)".format(u="_url")))
    return F.coalesce(F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rule(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """``pages`` (page_id, url) with host, path, rule and its verdict (null without a rule): the longest rule that fits."""
    out = pages.withColumn("_url", F.col("url"))
    out = out.withColumn("host", host_of(F.col("_url"))).withColumn("path", path_of(F.col("_url"))).drop("_url")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):  # longer rules are asked later and win
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return out.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def shape(host: str, path: str) -> str:
    """What the models read: the host without its last label, and the path."""
    return host.rpartition(".")[0] + path + END


def encode(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, places, sizes): texts laid end to end with ``order`` END before each; where their own characters are; and how many each has."""
    points = np.frombuffer("".join(END * order + t for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return points.astype(np.int64) + 1, np.arange(sizes.sum()) + np.repeat(order * np.arange(1, len(texts) + 1), sizes), sizes


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, a, b) of every character: its text's number and its gram, three characters in each long."""
    codes, places, sizes = encode(texts)
    c = [codes[places - ORDER + k] for k in range(ORDER + 1)]
    a, b = (x << 2 * CODE_BITS | y << CODE_BITS | z for x, y, z in (c[:3], c[3:]))
    return np.repeat(np.arange(len(texts)), sizes), a, b


def characters(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """The characters of grams, the first ones first."""
    return [x >> k * CODE_BITS & ((1 << CODE_BITS) - 1) for x in (a, b) for k in (2, 1, 0)]


def distinct(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): an order that brings equal keys together, and where in it each distinct one begins."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    return order, np.flatnonzero(new)


class Markov:
    """Counts of characters after contexts of up to ``order`` characters, and interpolated estimates from them, as sorted arrays.

    A context is the place of the one without its first character, and this character.
    """

    def __init__(self, order: int = ORDER):
        self.order, self.texts, self.tables = order, [], None

    def add(self, text: str) -> None:
        self.texts.append(text)
        self.tables = None

    def compile(self) -> Markov:
        """Count what was added, if that is not done yet."""
        if self.tables is None:
            codes, places, _ = encode(self.texts, self.order)
            self.count([codes[places - self.order + k] for k in range(self.order + 1)], np.ones(len(places), np.int64))
            self.texts = []
        return self

    def count(self, chars: list[np.ndarray], times: np.ndarray) -> Markov:
        """Make the tables from characters with the ``order`` ones before them, and how often each occurs."""
        self.tables, at = [], np.zeros(len(times), np.int64)
        for n in range(self.order + 1):
            context, at = np.unique(at << CODE_BITS | chars[self.order - n] if n else at, return_inverse=True)
            pair, which = np.unique(at << CODE_BITS | chars[-1], return_inverse=True)
            size, kinds, own = np.bincount(at, times, len(context)), np.bincount(pair >> CODE_BITS, minlength=len(context)), np.bincount(which, times, len(pair))
            self.tables.append((context, size, kinds, pair, own))
        return self

    def log_ps(self, texts: list[str]) -> np.ndarray:
        """The log-likelihood of each text; none may be empty."""
        self.compile()
        out = [np.zeros(0)]
        for s, e in text_chunks(texts, _BLOCK):
            codes, places, sizes = encode(texts[s:e], self.order)
            p, known, at = np.full(len(places), 1.0 / SYMBOLS), np.ones(len(places), bool), np.zeros(len(places), np.int64)
            for n, (context, size, kinds, pair, times) in enumerate(self.tables):
                if not len(context):
                    break
                key = at << CODE_BITS | codes[places - n] if n else at
                at = np.minimum(np.searchsorted(context, key), len(context) - 1)
                known &= context[at] == key
                both = at << CODE_BITS | codes[places]
                i = np.minimum(np.searchsorted(pair, both), len(pair) - 1)
                c = np.where(pair[i] == both, times[i], 0)
                p = np.where(known, (c + kinds[at] * p) / (size[at] + kinds[at]), p)
            out.append(np.add.reduceat(np.log(p), np.cumsum(sizes) - sizes))
        return np.concatenate(out)

    def log_p(self, text: str) -> float:
        return float(self.log_ps([text])[0])


class Estimates:
    """Log ratios of some grams."""

    def __init__(self, a: np.ndarray, b: np.ndarray, v: np.ndarray):
        self.a, ia = np.unique(a, return_inverse=True)
        self.b, ib = np.unique(b, return_inverse=True)
        both = ia * len(self.b) + ib
        order = np.argsort(both)
        self.both, self.v = both[order], v[order]

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known, log ratio) of each gram."""
        if not len(self.v):
            return np.zeros(len(a), bool), np.zeros(len(a))
        ia, ib = (np.minimum(np.searchsorted(x, y), len(x) - 1) for x, y in ((self.a, a), (self.b, b)))
        both = ia * len(self.b) + ib
        at = np.minimum(np.searchsorted(self.both, both), len(self.both) - 1)
        known = (self.a[ia] == a) & (self.b[ib] == b) & (self.both[at] == both)
        return known, np.where(known, self.v[at], 0.0)


@dataclass
class UrlModel:
    """Both models, or, if they are too large, estimates of the most frequent grams and a table (a, b, v) of all that are asked for."""

    good: Markov | None
    bad: Markov | None
    limit: float
    frequent: Estimates | None = None
    values: DataFrame | None = None


def ratios_of(texts: list[str], model: UrlModel) -> np.ndarray:
    """Log-likelihood difference per character; positive: like accepted URLs."""
    return (model.good.log_ps(texts) - model.bad.log_ps(texts)) / np.maximum(1, np.fromiter(map(len, texts), np.int64, len(texts)))


def best_cut(ratios: np.ndarray, good: np.ndarray, bad: np.ndarray, before: tuple[int, int], total: tuple[int, int]) -> tuple[int, int]:
    """(score, k): the best balanced accuracy of a limit right after a ratio, in units of 1 / the product of ``total``, and the first ratio that has it.

    Of each of the distinct ``ratios`` in order there are ``good`` and ``bad`` ones, and ``before`` of them below the first; ``total`` of all.
    """
    g, b = (max(1, t) for t in total)
    kind = np.int64 if g * b < 1 << 61 else object
    lost, caught = (before[0] + np.cumsum(good)).astype(kind), (before[1] + np.cumsum(bad)).astype(kind)
    score = caught * g - lost * b
    k = int(np.argmax(score))
    return int(score[k]), k


def calibrate(scored: DataFrame) -> float:
    """The limit with the best balanced accuracy over all of ``scored`` (ratio, good); midway between neighbours, and the lowest of equals."""
    kinds = scored.groupBy("ratio").agg(F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad"))
    ranged = cut(kinds.repartitionByRange("ratio").sortWithinPartitions("ratio")).select(F.spark_partition_id().alias("part"), "ratio", "good", "bad")
    parts = ranged.groupBy("part").agg(F.min("ratio").alias("low"), F.max("ratio").alias("high"), F.sum("good").alias("good"), F.sum("bad").alias("bad")).orderBy("part").collect()
    if not parts:
        return 0.0
    total = tuple(sum(r[c] for r in parts) for c in ("good", "bad"))
    before, so_far = {}, (0, 0)
    for r in parts:
        before[r["part"]] = so_far
        so_far = so_far[0] + r["good"], so_far[1] + r["bad"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, last, seen = None, None, None  # best: (score, its ratio, the next one in this part)
        for b in batches:
            part, ratios, good, bad = (b.column(c).to_numpy(zero_copy_only=False) for c in ("part", "ratio", "good", "bad"))
            if not len(ratios):
                continue
            seen = seen or before[int(part[0])]
            if best and best[2] is None:
                best = (*best[:2], float(ratios[0]))
            score, k = best_cut(ratios, good, bad, seen, total)
            if best is None or score > best[0]:
                best = score, float(ratios[k]), float(ratios[k + 1]) if k + 1 < len(ratios) else None
            seen, last = (seen[0] + int(good.sum()), seen[1] + int(bad.sum())), int(part[0])
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([str(best[0])]), *(pa.array([x], pa.float64()) for x in best[1:])], ["part", "score", "at", "next"])

    found = {r["part"]: (int(r["score"]), r["at"], r["next"]) for r in ranged.mapInArrow(run, "part int, score string, at double, next double").collect()}
    best, limit = 0, parts[0]["low"] - 1e-9
    for r, after in zip(parts, [*parts[1:], None], strict=True):
        score, at, following = found[r["part"]]
        if score > best:
            following = following if following is not None else after["low"] if after else None
            best, limit = score, (at + following) / 2 if following is not None else at + 1e-9
    return limit


def count_grams(rows: DataFrame, weights: tuple[str, ...]) -> DataFrame:
    """(a, b, and sums of ``weights``) of the grams of ``rows`` (host, path, and integers ``weights``)."""
    names = ["a", "b", *weights]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 4096):
            texts = [shape(h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            own = [batch.column(c).to_numpy(zero_copy_only=False) for c in weights]
            for s, e in text_chunks(texts, _BLOCK):
                text, a, b = grams_of(texts[s:e])
                order, starts = distinct(a, b)
                first = order[starts]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a[first], b[first], *(np.add.reduceat(w[s:e][text[order]], starts) for w in own))], names)

    schema = ", ".join(f"{c} long" for c in names)
    columns = (F.col(c).cast("long").alias(c) for c in weights)
    return rows.select("host", "path", *columns).mapInArrow(run, schema).groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in weights))


def estimates(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """(a, b, v, n): log ratios of the grams ``asked`` (a, b, n) by ``counts`` (a, b, good, bad), order by order.

    Of order k the last k + 1 characters of a gram are looked at. Rows of one context differ in the last character, and those of one
    estimate of the order below in the first, so there are no more of them than characters.
    """
    none = F.lit(0).cast("long")
    grams = counts.select("a", "b", "good", "bad", none.alias("n")).unionByName(asked.select("a", "b", none.alias("good"), none.alias("bad"), "n"))
    sums = [F.sum(c).alias(c) for c in ("good", "bad", "n")]
    keep = lambda c, characters: F.col(c).bitwiseAND(F.lit((1 << max(0, characters) * CODE_BITS) - 1))
    tables = [cut(grams.groupBy("a", "b").agg(*sums))]
    for k in range(ORDER - 1, -1, -1):
        tables.append(cut(tables[-1].groupBy(keep("a", k - 2).alias("a"), keep("b", min(3, k + 1)).alias("b")).agg(*sums)))
    below = None
    for k, t in enumerate(reversed(tables)):
        context = Window.partitionBy("a", F.shiftright("b", CODE_BITS))
        for c in ("good", "bad"):
            t = t.withColumn(f"size_{c}", F.sum(c).over(context)).withColumn(f"kinds_{c}", F.sum((F.col(c) > 0).cast("long")).over(context))
        t = t.where("n > 0")
        if below is None:
            t = t.withColumn("p_good", F.lit(1.0 / SYMBOLS)).withColumn("p_bad", F.lit(1.0 / SYMBOLS))
        else:
            t = t.withColumn("_a", keep("a", k - 3)).withColumn("_b", keep("b", min(3, k))).join(below.withColumnsRenamed({"a": "_a", "b": "_b"}), ["_a", "_b"])
        p = [F.when(F.col(f"size_{c}") > 0, (F.col(c) + F.col(f"kinds_{c}") * F.col(f"p_{c}")) / (F.col(f"size_{c}") + F.col(f"kinds_{c}"))).otherwise(F.col(f"p_{c}")).alias(f"p_{c}") for c in ("good", "bad")]
        t = t.select("a", "b", "n", *p)
        below = cut(t).drop("n") if k < ORDER else t
    return cut(t.select("a", "b", (F.log("p_good") - F.log("p_bad")).alias("v"), "n"))


def frequent_ones(values: DataFrame, most: int) -> Estimates:
    """Estimates of at most ``most`` grams, all that occur so often or more. Of the others each has less than 2 / ``most`` of all occurrences."""
    power = F.floor(F.log2("n")).cast("int")
    least, room = 63, most
    for r in values.groupBy(power.alias("power")).count().orderBy(F.desc("power")).collect():
        room -= r["count"]
        if room < 0:
            break
        least = r["power"]
    t = values.where(power >= least).select("a", "b", "v").toArrow()
    return Estimates(*(t.column(c).to_numpy() for c in ("a", "b", "v")))


def with_ratio(rows: DataFrame, model: UrlModel) -> DataFrame:
    """``rows`` (host, path, asked) with the ratio of those that are asked for, 0 for the others."""
    names = rows.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    if model.values is None:
        shared = rows.sparkSession.sparkContext.broadcast((model.good, model.bad))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = UrlModel(*shared.value, 0.0)
            for b in chunks(batches, 4096):
                host, path, asked = (b.column(c).to_pylist() for c in ("host", "path", "asked"))
                own, ratios = np.flatnonzero(asked), np.zeros(b.num_rows)
                ratios[own] = ratios_of([shape(host[k], path[k]) for k in own], m)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ratios)], [*names, "ratio"])

        return rows.mapInArrow(run, f"{fields}, ratio double")

    frequent = rows.sparkSession.sparkContext.broadcast(model.frequent)
    rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()))
    schema = "_row long, size long, a long, b long, n long, v double"

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = frequent.value
        for batch in chunks(batches, 4096):
            texts = [shape(h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            ids = batch.column("_row").to_numpy()
            for s, e in text_chunks(texts, _BLOCK):
                text, a, b = grams_of(texts[s:e])
                known, v = found.find(a, b)
                sums, sizes = np.bincount(text, v, e - s), np.bincount(text, minlength=e - s)
                none = pa.nulls(e - s, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids[s:e]), pa.array(sizes), none, none, none, pa.array(sums)], ["_row", "size", "a", "b", "n", "v"])
                text, a, b = text[~known], a[~known], b[~known]
                order, starts = distinct(text, a, b)
                first, n = order[starts], np.diff(np.r_[starts, len(order)])
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (ids[s:e][text[first]], np.zeros(len(n), np.int64), a[first], b[first], n)), pa.nulls(len(n), pa.float64())], ["_row", "size", "a", "b", "n", "v"])

    parts = cut(rows.where("asked").select("_row", "host", "path").mapInArrow(spread, schema))
    rest = parts.where("a is not null").drop("v").join(model.values.select("a", "b", "v"), ["a", "b"])
    each = parts.where("a is null").select("_row", "size", "v").unionByName(rest.select("_row", "size", (F.col("n") * F.col("v")).alias("v")))
    ratios = each.groupBy("_row").agg((F.sum("v") / F.sum("size")).alias("ratio"))
    return rows.join(ratios, "_row", "left").select(*names, F.coalesce("ratio", F.lit(0.0)).alias("ratio"))


def fit(judged: DataFrame, grams: int = GRAMS) -> UrlModel | None:
    """Learn from all distinct URLs that rules decide, 3/4 for the models and 1/4 for the limit; none if there are too few.

    With more than ``grams`` distinct grams the model holds estimates for the URLs of ``judged`` that are asked for.
    """
    known = judged.where(F.col("rule").isNotNull()).select("host", "path", (F.col("rule_verdict") == "allow").alias("good")).distinct()
    known = cut(known.withColumn("held", F.pmod(F.xxhash64("host", "path"), F.lit(4)) == 0))
    there = {(r["good"], r["held"]) for r in known.select("good", "held").distinct().collect()}
    if not ({(True, False), (False, False)} <= there and any(held for _, held in there)):
        return None
    counts = cut(count_grams(known.where("not held").select("host", "path", "good", (~F.col("good")).alias("bad")), ("good", "bad")))
    held = known.where("held").select("host", "path", "good", F.lit(True).alias("asked"))
    if counts.count() <= grams:
        t = counts.toArrow()
        a, b, good, bad = (t.column(c).to_numpy() for c in ("a", "b", "good", "bad"))
        chars = characters(a, b)
        model = UrlModel(*(Markov().count([c[times > 0] for c in chars], times[times > 0]) for times in (good, bad)), 0.0)
    else:
        asked = held.select("host", "path").unionByName(judged.where("asked").select("host", "path")).withColumn("n", F.lit(1))
        values = estimates(counts, count_grams(asked, ("n",)))
        model = UrlModel(None, None, 0.0, frequent_ones(values, grams), values)
    model.limit = calibrate(with_ratio(held, model).select("ratio", "good"))
    return model


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, grams: int = GRAMS) -> DataFrame:
    """(page_id, host, path, rule, verdict, ratio): one row for each row of ``pages``; ratio is null where a rule decides."""
    asked = F.col("rule").isNull() & ((F.col("host") != "") | (F.col("path") != ""))
    judged = cut(with_rule(pages.select("page_id", "url"), rules).drop("url").withColumn("asked", asked))
    model = fit(judged, grams)
    scored = with_ratio(judged, model) if model else judged.withColumn("ratio", F.lit(0.0))
    blocked = F.col("asked") & (F.col("ratio") < (model.limit if model else 0.0))
    verdict = F.coalesce("rule_verdict", F.when(blocked, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("rule").isNull(), F.col("ratio")).alias("ratio"))
