import numpy as np
import pytest
import xxhash

from lattica.llm import simhash
from lattica.llm.common import components


def brute_fingerprint(text, n=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    n = min(n, len(words))
    h = [xxhash.xxh64_intdigest(b" ".join(words[k : k + n]), 42) for k in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(values, near):
    root = list(range(len(values)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(values))]


@pytest.mark.parametrize("text", [None, "", " \x0b\x0c ", "One", "one TWO", "a b c d É\u00a0x  y\nz", "a a a a a a"])
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == brute_fingerprint(text)


def near_fingerprints(n, seed, most):
    """Random fingerprints, and neighbours of them at up to ``most`` flipped bits; one partition is skewed."""
    rng = np.random.default_rng(seed)
    base = [int(x) & ~0xFFFF | int(rng.integers(4)) for x in rng.integers(0, 2**63, n, dtype=np.int64)]
    out = set(base)
    for x in base:
        for _ in range(3):
            y = x
            for b in rng.choice(64, rng.integers(1, most + 1), replace=False):
                y ^= 1 << int(b)
            out.add(y)
    return sorted(out)


@pytest.mark.parametrize(("distance", "radius", "parts"), [(3, 0, None), (3, 0, 2), (3, 0, 3), (2, 0, 3), (10, 1, 4)])
def test_links_match_brute_force(spark, distance, radius, parts):
    v = near_fingerprints(150, distance, distance + 2)
    signed = np.array(v, np.uint64).view(np.int64).tolist()
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), distance, radius, parts).collect()}
    want = {(min(a, b), max(a, b)) for i, (x, a) in enumerate(zip(v, signed, strict=True)) for y, b in zip(v[:i], signed[:i], strict=True) if (x ^ y).bit_count() <= distance}
    assert got == want


def test_links_of_no_and_one_fingerprint(spark):
    df = spark.createDataFrame([(0,)], "fp long")
    assert simhash.links(df).count() == 0 and simhash.links(df.limit(0)).count() == 0


def test_allocation_keeps_the_sum():
    rng = np.random.default_rng(0)
    costs = np.sort(rng.random((4, 5, 100)), axis=1)
    for total in (0, 3, 7):
        assert (simhash.allocate(costs, total).sum(0) == total).all()


def test_neighbour_counts():
    counts = np.random.default_rng(0).integers(0, 5, 64)
    s = simhash.neighbour_counts(counts, 2)
    for v in range(64):
        for t in range(3):
            assert s[t, v] == sum(c for w, c in enumerate(counts) if (v ^ w).bit_count() <= t)


def test_bits_are_grouped_once():
    v = np.random.default_rng(0).integers(0, 2**63, 500, dtype=np.int64).view(np.uint64)
    bits = np.unpackbits(v.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    groups = simhash.group_bits(500, bits.T @ bits, 3)
    assert sorted(b for g in groups for b in g) == list(range(64)) and {len(g) for g in groups} == {21, 22}


def test_near_duplicates_on_edges(spark, edge, empty):
    out = simhash.near_duplicates(edge).toPandas()
    assert len(out) == edge.count()
    by = out.set_index("doc_id")["component_id"].to_dict()
    assert by[2] == by[3] == by[1] == 1 and by[5] == by[6] == 5
    assert (out[out["doc_id"] == 1]["fingerprint"] == "0" * 16).all()
    assert simhash.near_duplicates(empty).count() == 0


def test_groups_match_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(50)]
    texts = [" ".join(rng.choice(words, rng.integers(0, 60))) for _ in range(60)]
    for k in range(40):  # near copies
        w = texts[k].split()
        if w:
            w[int(rng.integers(len(w)))] = "changed"
        texts.append(" ".join(w))
    out = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas().sort_values("doc_id")
    f = [brute_fingerprint(t) for t in texts]
    assert [int(x, 16) for x in out["fingerprint"]] == f
    assert out["component_id"].tolist() == brute_groups(f, lambda a, b: (a ^ b).bit_count() <= 3)


def test_dedup_keeps_one_of_each_group(spark, edge, empty):
    kept = simhash.dedup(edge)
    assert kept.columns == edge.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(5) == 1 and 6 not in ids and len({1, 2, 3} & set(ids)) == 1 and 4 in ids and 11 in ids
    assert simhash.dedup(empty).count() == 0


def test_dedup_catches_near_copies(spark):
    rng = np.random.default_rng(5)
    words = np.array([f"word{k}" for k in range(5000)])
    texts = [rng.choice(words, 400) for _ in range(60)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    for k in range(30):
        w = texts[k].copy()
        w[rng.choice(400, 5, replace=False)] = "changed"  # similarity about 0.88
        rows.append((100 + k, " ".join(w)))
    kept = {r["doc_id"] for r in simhash.dedup(spark.createDataFrame(rows, "doc_id long, text string"), reach=10).collect()}
    assert set(range(60)) <= kept and len(kept) <= 63


def near_texts(seed, sizes, n, changes):
    """Texts, and copies of them with some words changed."""
    rng = np.random.default_rng(seed)
    words = np.array([f"word{k}" for k in range(5000)])
    texts = [rng.choice(words, int(rng.choice(sizes))) for _ in range(n)]
    for t in texts[:n]:
        w = t.copy()
        w[rng.choice(len(w), int(rng.integers(*changes) * len(w) // 100), replace=False)] = "changed"
        texts.append(w)
    return [" ".join(t) for t in texts]


def brute_kept(texts, reach):
    """The least of each group of texts within ``reach`` bits and of similarity 0.8, or within 3 bits."""
    shingles = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    all_ = list(zip(map(brute_fingerprint, texts), shingles, strict=True))
    bits = lambda a, b: (a[0] ^ b[0]).bit_count()
    return {k for k, r in enumerate(brute_groups(all_, lambda a, b: bits(a, b) <= 3 or bits(a, b) <= reach and len(a[1] & b[1]) >= 0.8 * len(a[1] | b[1]))) if r == k}


def test_dedup_reaches_ten_bits(spark):
    texts = near_texts(8, [120, 150, 200], 80, (1, 3))
    want = brute_kept(texts, 10)
    assert want != brute_kept(texts, 7)
    kept = {r["doc_id"] for r in simhash.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == want


def test_dedup_verifies_whole_texts(spark):
    texts = near_texts(9, [300, 400, 700], 80, (1, 4))
    kept = {r["doc_id"] for r in simhash.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == brute_kept(texts, 10)


@pytest.mark.parametrize("size", [100, 600])
def test_all_texts_of_a_fingerprint_are_compared(spark, size):
    a, b = (" ".join(f"{c}{k}" for k in range(size)) for c in "ab")
    rows = [(1, 10, a), (2, 20, b), (3, 10, b + " end"), (4, 20, a + " end"), (5, 30, "c " + b), (6, 40, "something else"), (7, 20, b)]
    for first, second in ((a, b), (b, a)):  # whichever has the lesser sketch
        rows[0], rows[2] = (1, 10, first), (3, 10, second + " end")
        texts = [t for _, _, t in rows]
        import pyarrow as pa

        marked = spark.createDataFrame([(r, fp, hash(t), bytearray(s)) for (r, fp, t), s in zip(rows, simhash.sketches(pa.array(texts)), strict=True)], "row long, fp long, content long, sketch binary")
        pairs = spark.createDataFrame([(10, 30), (20, 30), (10, 40), (30, 40)], "a long, b long")
        got = simhash.alike(pairs, marked, spark.createDataFrame([(r, t) for r, _, t in rows], "row long, text string"))
        assert {tuple(r) for r in got.collect()} == {(10, 30), (20, 30)}


def test_resemblance():
    import pyarrow as pa

    a, b, none = simhash.sketches(pa.array(["a b c d e f", "a b c d e g", None]))
    assert simhash.resemblance(a, a) == (1.0, True) and simhash.resemblance(a, b) == (1 / 3, True) and simhash.resemblance(none, none) == (1.0, True)


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rng = np.random.default_rng(0)
    pairs = {"chain": [(k, k + 1) for k in range(100)], "star": [(50, k) for k in range(100)], "random": [tuple(map(int, rng.integers(0, 300, 2))) for _ in range(150)], "none": []}[shape]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    groups = brute_groups(range(300), lambda a, b: False)
    root = list(groups)
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    assert got == {n: root[n] for a, b in pairs if a != b for n in (a, b)}


# -- the pipeline's way: fingerprints of two-word shingles, min-hashes, sets compared in blocks --------------------


def test_minhash_bits_agree_with_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 2000, dtype=np.int64).view(np.uint64)
    agree = []
    for k in range(60):
        x, y = (np.concatenate([a[: 160 + k], rng.integers(0, 2**63, 20, dtype=np.int64).view(np.uint64)]) for _ in range(2))
        both = [simhash.minhash_bits(z, 1) for z in (x, y)]
        agree.append(1 - sum((p ^ q).bit_count() for p, q in zip(*both, strict=True)) / 128 - (1 + (160 + k) / (200 + k)) / 2)
    assert abs(np.mean(agree)) < 0.015 and np.std(agree) < 0.06
    assert simhash.minhash_bits(np.zeros(0, np.uint64), 5) == simhash.minhash_bits(np.zeros(0, np.uint64), 5)


def test_sketches_estimate_and_small_ones_decide():
    rng = np.random.default_rng(1)
    new = lambda n: rng.integers(0, 2**63, n, dtype=np.int64).view(np.uint64)
    for n, share in ((100, 0.8), (230, 0.5), (300, 0.8), (5000, 0.8), (5000, 0.3)):
        common = new(int(n * share))
        a, b = (np.concatenate([common, new(n - len(common))]) for _ in range(2))
        got, exact = simhash.resemblance(simhash.sketch(a), simhash.sketch(b))
        want = len(common) / (2 * n - len(common))
        assert exact == (n < simhash.WHOLE) and (got == pytest.approx(want) if exact else want - 0.06 < got < want + 0.12)


def similarity_pairs(texts):
    s = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    return {(i, j): len(s[i] & s[j]) / len(s[i] | s[j]) for j in range(len(s)) for i in range(j)}


def test_two_word_stage_recall_and_precision(spark):
    """Of pairs of similarity 0.8 and more at least nine in ten lose one side; and no text goes that is not linked to a kept one."""
    texts = near_texts(21, [60, 120, 200, 400, 900], 150, (1, 4))
    sims = similarity_pairs(texts)
    kept = {r["doc_id"] for r in simhash.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), reach=9, near_shingle=2).collect()}
    near = [p for p, v in sims.items() if v >= 0.8]
    assert len(near) > 60 and sum(not set(p) <= kept for p in near) >= 0.9 * len(near)
    fp = [brute_fingerprint(t) for t in texts]
    linked = {k: {i + j - k for (i, j), v in sims.items() if k in (i, j) and (v >= 0.8 or (fp[i] ^ fp[j]).bit_count() <= 3)} for k in range(len(texts))}
    assert all(linked[k] for k in range(len(texts)) if k not in kept)


@pytest.mark.parametrize("near", [None, 2])
def test_a_large_group_of_one_fingerprint(spark, monkeypatch, near):
    """Many texts of one fingerprint and of one near fingerprint, cut into several nodes and blocks, come out as with one."""
    base = " ".join(f"b{k}" for k in range(300))
    texts = [f"{base} {k}" for k in range(60)] + [" ".join(f"c{k}" for k in range(300))] + [None, ""]
    rows = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(texts)], "doc_id long, text string, near string, m1 string")
    whole = sorted(r["doc_id"] for r in simhash.dedup(rows, near_shingle=near).collect())
    for name, value in (("NODE_TEXTS", 4), ("SKETCH_PAIRS", 3), ("SET_PAIRS", 2)):
        monkeypatch.setattr(simhash, name, value)
    assert sorted(r["doc_id"] for r in simhash.dedup(rows, near_shingle=near).collect()) == whole == [0, 60, 61]


def test_texts_of_one_fingerprint_in_several_nodes(spark, monkeypatch):
    """Pairs of a fingerprint with itself and with another, whose texts lie in different nodes."""
    import pyarrow as pa

    monkeypatch.setattr(simhash, "NODE_TEXTS", 2)
    monkeypatch.setattr(simhash, "SKETCH_PAIRS", 2)
    texts = [" ".join(f"{c}{k}" for k in range(120)) for c in "abcdef"]
    texts += [t + " end" for t in texts[:3]]
    fps = [1, 1, 1, 1, 1, 2, 2, 2, 1]
    marked = spark.createDataFrame([(k, fp, k * 7919, bytearray(s)) for k, (fp, s) in enumerate(zip(fps, simhash.sketches(pa.array(texts)), strict=True))], "row long, fp long, content long, sketch binary")
    pairs = spark.createDataFrame([(1, 1), (1, 2)], "a long, b long")
    got = {tuple(sorted((r["ra"], r["rb"]))) for r in simhash.alike_texts(pairs, marked, spark.createDataFrame(list(enumerate(texts)), "row long, text string")).collect()}
    assert got == {(0, 6), (1, 7), (2, 8)}
