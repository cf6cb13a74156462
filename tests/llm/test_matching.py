"""Operators 6 and 7 against brute force."""

from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica.llm import decontaminate, lines
from lattica.llm.words import words

ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma"), (2, "one two three four five six"), (3, None), (4, "short item"), (5, "")]


@pytest.mark.parametrize(("masks", "size", "gone"), [(decontaminate.MASKS, 13, 2), *((decontaminate.SHORT_MASKS, n, n // 5) for n in range(5, 13))])
def test_masks_hit_all_substitutions(masks, size, gone):
    for subs in combinations(range(size), gone):
        assert any(all(c == "0" or p + k not in subs for k, c in enumerate(m)) for m in masks for p in range(size - len(m) + 1))


def brute(doc, item, window=13, share=0.8):
    d, t = ([w for w in "".join(c if c.isalnum() and c.isascii() else " " for c in (x or "").lower()).split()] for x in (doc, item))
    size = min(window, len(t))
    if len(t) < 5:
        return False
    return any(sum(a == b for a, b in zip(d[i : i + size], t[j : j + size], strict=True)) >= share * size for i in range(len(d) - size + 1) for j in range(len(t) - size + 1))


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST, 0])
def test_matches_brute_force(spark, limit):
    rng = np.random.default_rng(2)
    noise = [f"n{k}" for k in range(40)]
    docs = [(0, None), (1, ""), (2, ITEMS[0][1]), (None, ITEMS[1][1]), (3, "short item"), (4, "One, TWO; three-four five SIX!"), (4, "One, TWO; three-four five SIX!")]
    for d in range(10, 80):
        w = ITEMS[d % 2][1].split()
        for k in rng.choice(len(w), rng.integers(0, 5), replace=False):
            w[k] = str(rng.choice(noise))
        docs.append((d, " ".join([*rng.choice(noise, 20), *w[rng.integers(0, 4) :], *rng.choice(noise, 5)])))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("seed", F.lit("x")).withColumn("key", F.lit("y"))
    out = decontaminate.contaminated(df, spark.createDataFrame(ITEMS, "item_id long, text string"), broadcast=limit).collect()
    got = sorted(((r["doc_id"], r["item_id"]) for r in out), key=str)
    assert got == sorted(((d, i) for d, x in docs for i, t in ITEMS if t and brute(x, t)), key=str)
    assert all(r["agreeing"] >= 0.8 * r["length"] for r in out)


def test_decontaminate_edges(spark, edge, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.contaminated(edge, items).count() == 0
    assert decontaminate.contaminated(empty, items).count() == 0
    assert decontaminate.contaminated(edge, items.limit(0)).count() == 0
    assert decontaminate.contaminated(edge, items.limit(0), broadcast=-1).count() == 0


def test_words_do_not_cross_rows():
    row, h = words(pa.array(["ab", "cd", None, "ab cd", "É é"]))
    assert row.tolist() == [0, 1, 3, 3, 4, 4] and h[0] == h[2] and h[1] == h[3] and h[4] == h[5]


# -- lines --------------------------------------------------------------------------------------------------------


def brute_dedup(docs, min_words):
    """Lines of each distinct (id, text) that lie in a shortest window of enough words that occurred before."""
    seen, out = set(), {}
    order = sorted(set(docs), key=lambda r: (r[0] is not None, r[0]))
    for d, text in order:
        ls = [" ".join(x.split()) for x in text.split("\n")]
        full = [k for k, x in enumerate(ls) if x]
        gone = set()
        for a in range(len(full)):
            total, b = 0, a
            while b < len(full) and total < min_words:
                total += len(ls[full[b]].split())
                b += 1
            if total < min_words:
                break
            window = tuple(ls[k] for k in full[a:b])
            if window in seen:
                gone.update(range(full[a], full[b - 1] + 1))
            seen.add(window)
        out[d, text] = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
    return out


def corpus(seed, n=60):
    rng = np.random.default_rng(seed)
    pool = [" ".join(rng.choice([f"w{k}" for k in range(30)], rng.integers(1, 9))) for _ in range(25)] + ["", "  "]
    passage = ["a passage of several words", "that goes on and on", "over three lines in all"]
    docs = []
    for d in range(n):
        ls = list(rng.choice(pool, rng.integers(1, 12)))
        if d % 3 == 0:
            at = int(rng.integers(len(ls) + 1))
            ls[at:at] = passage
        docs.append((d, "\n".join(ls)))
    return docs


@pytest.mark.parametrize("min_words", [5, 12, 30])
def test_lines_match_brute_force(spark, min_words):
    docs = corpus(min_words)
    docs += [docs[3]]  # a repeated row is the same document
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["before"]): r["text"] for r in lines.dedup(df.withColumn("before", F.col("text")), min_words=min_words).collect()}
    assert got == brute_dedup(docs, min_words)


def test_line_hashes():
    row, h, n = lines.line_hashes(pa.array(["a b\n\n a  b ", None, "", "c\n", "a b"]))
    assert row.tolist() == [0, 0, 0, 1, 2, 3, 3, 4] and n.tolist() == [2, 0, 2, 0, 0, 1, 0, 2]
    assert h[0] == h[2] == h[7] and h[0] != h[5]


def test_lines_edges(spark, edge, empty):
    out = lines.dedup(edge)
    assert out.columns == [*edge.columns, "_n_removed"]
    rows = out.collect()
    assert len(rows) == edge.count()
    assert sum(r["text"] is None for r in rows) == 2
    assert lines.dedup(empty).count() == 0


def test_long_passages_go(spark):
    passage = " ".join(f"p{k}" for k in range(51))
    docs = spark.createDataFrame([(d, f"own line {d}\n{passage}\nlast line {d}") for d in range(20)], "doc_id long, text string")
    kept = [r["doc_id"] for r in lines.dedup(docs).collect() if passage in r["text"]]
    assert kept == [0]


def brute_runs(docs, min_words):
    """Lines that hold words, of each document without those in runs of enough words that it shares with an earlier place."""
    full = [(d, [" ".join(x.split()) for x in text.split("\n") if x.split()]) for d, text in sorted(set(docs))]
    out = {}
    for a, (d, x) in enumerate(full):
        gone = set()
        for b, (_, y) in enumerate(full[: a + 1]):
            for i in range(len(x)):
                for j in range(len(y) if b < a else i):
                    k = 0
                    while i + k < len(x) and j + k < len(y) and x[i + k] == y[j + k]:
                        k += 1
                    if sum(len(z.split()) for z in x[i : i + k]) >= min_words:
                        gone.update(range(i, i + k))
        out[d] = [z for k, z in enumerate(x) if k not in gone]
    return out


@pytest.mark.parametrize("min_words", [5, 12, 30])
def test_whole_runs_match_brute_force(spark, min_words):
    docs = corpus(min_words)
    out = lines.dedup(spark.createDataFrame(docs, "doc_id long, text string"), min_words=min_words, whole_runs=True).collect()
    got = {r["doc_id"]: [" ".join(x.split()) for x in r["text"].split("\n") if x.split()] for r in out}
    assert got == brute_runs(docs, min_words)


@pytest.mark.parametrize("sizes", [(25, 25, 3), (60, 40), (3, 25, 25), (50, 1, 50, 1)])
def test_pipeline_deletes_the_end_of_a_run(spark, sizes):
    import corpus_pipeline

    passage = "\n".join(" ".join(f"p{k}x{j}" for j in range(n)) for k, n in enumerate(sizes))
    docs = spark.createDataFrame([(d, f"own {d}\n{passage}\nlast {d}", 0) for d in range(3)], "doc_id long, text string, n_chars long")
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert out[1] == "own 1\nlast 1" and out[2] == "own 2\nlast 2" and passage in out[0]


def by_sql(docs, sql):
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    return {r[0]: r[1:] for r in db.execute(sql).fetchall()}


def test_runs_query_deletes_runs_to_their_last_line(spark, tmp_path):
    """Beside op7_lines, whose SQL fixes forward windows: by the SQL of maximal runs, blank lines in them included."""
    from lattica.llm import queries

    line = lambda k, n: " ".join(f"p{k}x{j}" for j in range(n))
    passages = [[25, 25, 3], [60, 40], [3, 25, 25], [50, 1, 50, 1], [60, 0, 60, 0, 0, 50, 49], [0, 60, 0]]
    texts = ["\n".join(line(f"{k}y{j}", n) if n else " \t" * (j % 2) for j, n in enumerate(p)) for k, p in enumerate(passages)]
    docs = [(10 * d + k, f"own {d} {k}\n{t}\n\nlast {d} {k}\n{t if d == 2 else ''}") for d in range(3) for k, t in enumerate(texts)] + [(100, None), (101, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in queries.op7_runs(spark, str(tmp_path)).collect()}
    assert got == by_sql(docs, queries.RUNS_SQL)
    assert got[10][1] == "own 1 0\n\nlast 1 0\n" and got[14][1] == "own 1 4\n\nlast 1 4\n"
    fewer = {r["doc_id"]: r["n_removed"] for r in queries.op7_lines(spark, str(tmp_path)).collect()}
    assert fewer[10] == 2 and got[10][0] == 3


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_runs_query_equals_its_sql(spark, sf):
    from lattica.llm import queries

    folder = f"/root/testdata/sf{sf}"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert {r["doc_id"]: (r["n_removed"], r["text"]) for r in queries.op7_runs(spark, folder).collect()} == by_sql(docs, queries.RUNS_SQL)


# -- decontamination of other scripts, and without moving rows ----------------------------------------------------


def test_words_of_any_script_are_counted(spark):
    items = spark.createDataFrame([(1, "слово " * 200), (2, "甲 乙 丙"), (3, None), (4, "plain words here")], "item_id long, text string")
    assert decontaminate.n_words(items) == 206


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST, 0])
def test_both_ways_find_the_same_places(spark, limit):
    rng = np.random.default_rng(7)
    vocabulary = [f"w{k}" for k in range(12)]  # few words: many hits, ties and diagonals
    items = [(k, " ".join(rng.choice(vocabulary, n))) for k, n in enumerate([5, 7, 12, 13, 14, 30, 60, 4])]
    docs = [(k, " ".join(rng.choice(vocabulary, rng.integers(0, 120)))) for k in range(60)] + [(100 + k, f"x {t} y {t}") for k, t in items] + [(None, items[5][1]), (None, None)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in decontaminate.contaminated(df, bench, broadcast=limit).collect()}
    want = set()
    for d, x in docs:
        for i, t in items:
            w, v = (x or "").split(), t.split()
            size = min(13, len(v))
            places = [(-sum(a == b for a, b in zip(w[p : p + size], v[q : q + size], strict=True)), p) for p in range(len(w) - size + 1) for q in range(len(v) - size + 1)]
            if len(v) >= 5 and places and -min(places)[0] >= 0.8 * size:
                want.add((d, i, min(places)[1], size, -min(places)[0]))
    assert got == want


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST, 0])
def test_clean_keeps_rows_whole(spark, edge, limit):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [(None, ITEMS[0][1], "a"), (None, None, "b"), (None, "clean", "c"), (1, f"x {ITEMS[1][1]} y", "d"), (1, "other", "e"), (1, "other", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row string")
    assert sorted(r["_row"] for r in decontaminate.clean(df, items, broadcast=limit).collect()) == ["b", "c", "e", "e"]
    out = decontaminate.clean(edge, items, broadcast=limit)
    assert out.columns == edge.columns and out.count() == edge.count()
    assert decontaminate.clean(edge.limit(0), items, broadcast=limit).count() == 0
