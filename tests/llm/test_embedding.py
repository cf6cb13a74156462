import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import embedding


def brute(rows, cosine=0.93):
    """(links, component) by doc: all pairs of equal labels."""
    n = len(rows)
    ok = [lab is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    near = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                near[i, j] = near[j, i] = embedding.exact_cosine(np.array(rows[i][1], float), np.array(rows[j][1], float)) >= cosine
    comp = list(range(n))
    for _ in range(n):
        new = [min([comp[i], *(comp[j] for j in np.flatnonzero(near[i]))]) for i in range(n)]
        if new == comp:
            break
        comp = new
    ids = [r[0] for r in rows]
    out = []
    for i in range(n):
        group = [ids[j] for j in range(n) if comp[j] == comp[i] and ids[j] is not None]
        out.append((ids[i], int(near[i].sum()), (min(group) if group else None) if ok[i] else ids[i]))
    return sorted(out, key=str)


def clusters(n, seed, spread=0.25):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 8, 16))
    return np.float32(centres[rng.integers(len(centres), size=n)] + spread * rng.normal(size=(n, 16)))


@pytest.mark.parametrize(("cell", "block"), [(2_000, 2_048), (30, 2_048), (20, 7)])
def test_matches_brute_force(spark, monkeypatch, cell, block):
    monkeypatch.setattr(embedding, "CELL", cell)
    monkeypatch.setattr(embedding, "BLOCK", block)
    v = clusters(200, 1)
    rows = [(k, x.tolist(), k % 3) for k, x in enumerate(v)]
    rows += [(300 + k, v[k].tolist(), k % 3) for k in range(10)]  # copies
    rows += [(400, None, 0), (401, [0.0] * 16, 0), (402, [float("nan")] + [1.0] * 15, 0), (403, [None] + [1.0] * 15, 0), (404, v[0].tolist(), None), (None, v[0].tolist(), 0), (5, v[7].tolist(), 1), (405, [], 0), (406, v[0].tolist()[:8], 0), (407, (v[0] * 1e30).tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = embedding.near_duplicates(df).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == brute([(i, None if x is None else [None if y is None else float(np.float32(y)) for y in x], lab) for i, x, lab in rows])
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)


def test_empty(spark):
    assert embedding.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_guests_reach_every_pair():
    rng = np.random.default_rng(0)
    x = embedding._unit(clusters(400, 2, 0.4).astype(float))
    r = np.sqrt(2 - 2 * 0.93)
    pivots = x[rng.choice(400, 9, replace=False)]
    row, cell, guest = embedding.assign(x, pivots, r)
    home = {i: c for i, c, g in zip(row, cell, guest, strict=True) if not g}
    at = {(i, c) for i, c in zip(row, cell, strict=True)}
    for i, j in zip(*np.nonzero(x @ x.T >= 0.93), strict=True):
        low = min(home[i], home[j])
        assert (i, low) in at and (j, low) in at


@pytest.mark.parametrize(("cell", "block", "spread"), [(30, 2_048, 0.25), (20, 7, 0.25), (10, 50, 0.05)])
def test_many_pivots_match_brute_force(spark, monkeypatch, cell, block, spread):
    """With free sending the pivots are as many as may be, so cells, guests and blocks are all in use."""
    for name, value in (("CELL", cell), ("BLOCK", block), ("SENDING", 0.0), ("JUDGED", 20)):
        monkeypatch.setattr(embedding, name, value)
    v = clusters(200, 5, spread)
    rows = [(k, x.tolist(), k % 2) for k, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    r = np.sqrt(2 - 2 * 0.93)
    nodes = embedding.usable(df.withColumn("cell", df["label"])).selectExpr("uid", "label", "v", "size(v) as dim")
    assert max(len(p) for p in embedding.choose_pivots(nodes, r).values()) >= 4
    got = embedding.near_duplicates(df).collect()
    assert sorted(((x["vec_id"], x["n_links"], x["component_id"]) for x in got), key=str) == brute([(i, [float(np.float32(y)) for y in x], lab) for i, x, lab in rows])


def test_pivots_are_as_many_as_pay():
    rng = np.random.default_rng(3)
    r = np.sqrt(2 - 2 * 0.93)
    apart = embedding._unit(np.repeat(np.eye(32)[:16], 40, 0) + 0.02 * rng.normal(size=(640, 32)))
    rng.shuffle(apart)
    flat = embedding._unit(rng.normal(size=(640, 32)))
    cost = lambda x, k, n: embedding.expected_cost(x[-256:], x[:k], r, n)
    assert cost(apart, 64, 10**7) < 0.5 * cost(apart, 1, 10**7)  # well parted vectors: cells are small and have few guests
    assert cost(flat, 64, 10**5) > cost(flat, 1, 10**5)  # wide boundaries: guests cost more than they save


def test_clashing_columns(spark):
    rows = [(1, [1.0, 0.0], 0, "x"), (2, [1.0, 0.01], 0, "y"), (3, [0.0, 1.0], 0, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, uid string").withColumn("v", F.lit(1)).withColumn("cell", F.lit("c")).withColumn("dim", F.lit(3)).withColumn("component_id", F.lit(9))
    got = sorted(tuple(r) for r in embedding.near_duplicates(df).collect())
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_colliding_hashes_are_salted_anew(spark, monkeypatch):
    rows = [(k, [1.0, float(k)], 0) for k in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = sorted(tuple(r) for r in embedding.near_duplicates(df).collect())
    plain = embedding.usable
    monkeypatch.setattr(embedding, "usable", lambda d, salt=0: plain(d, salt) if salt else plain(d).withColumn("uid", F.lit(7).cast("long")))
    assert sorted(tuple(r) for r in embedding.near_duplicates(df).collect()) == want
    monkeypatch.setattr(embedding, "usable", lambda d, salt=0: plain(d).withColumn("uid", F.lit(7).cast("long")))
    with pytest.raises(RuntimeError):
        embedding.near_duplicates(df)
