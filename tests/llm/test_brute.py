"""The scores of operators 1, 3, 8 and 10 against versions by plain loops and dicts."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from lattica.llm import language, quality, toxicity, urls
from lattica.llm.common import crc_mod, sampled_texts

SF = "/root/testdata/sf0.01"


# -- quality ------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def quality_model(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    return quality.fit(docs, labels, crc_mod(F.col("doc_id"), 4) != 2)


def test_both_dictionaries_are_trained(quality_model):
    magic = (0xEC30A437).to_bytes(4, "little")
    assert quality_model.good[:4] == quality_model.bad[:4] == magic and len(quality_model.good) == len(quality_model.bad) >= 2048


def test_equal_shares():
    good, bad = quality.equal_shares([b"a" * 10] * 5, [b"b" * 7] * 3)
    assert (len(good), len(bad)) == (3, 3)
    assert quality.equal_shares([b"a"], []) == ([b"a"], [])


def test_quality_scores_by_two_compressions(spark, quality_model):
    m = quality_model
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality.score(docs, m).collect():
        data = (texts[r["doc_id"]] or "").encode()
        if not data:
            assert r["score"] == pytest.approx(m.prior)
            continue
        sizes = []
        for d in (m.good, m.bad):
            c = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False)
            out = c.compress(data)
            assert zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(d)).decompress(out, max_output_size=len(data) + 1) == data
            sizes.append(len(out))
        g, b = sizes
        x = ((b - g) / len(data), (b - g) / max(b, g), math.log(min(b, g) / len(data)))
        z = sum((v - mean) / scale * w for v, mean, scale, w in zip(x, m.mean, m.scale, m.weights, strict=False)) + m.weights[3]
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-9, abs=1e-9)


def test_samples_are_bounded_by_rows(spark):
    docs = spark.createDataFrame([(k % 3, f"text {k}", "x") for k in range(300)], "doc_id long, text string, y string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(3)], "doc_id long, quality int")
    rows = sampled_texts(docs, labels, "quality", F.lit(True), 1).collect()
    assert len(rows) == 2 and {r["y"] for r in rows} == {0, 1}


# -- toxicity -----------------------------------------------------------------------------------------------------


def plain_tree(x, g, h, edges, depth, ridge=1.0):
    """Nested (feature, cut, left, right) or a leaf's value, by trying each cut on each feature."""
    if not depth:
        return -sum(g) / (sum(h) + ridge)
    best = (1e-9, None)
    for j, e in enumerate(edges):
        for c in e:
            left = [k for k in range(len(g)) if x[k][j] <= c]
            gl, hl = sum(g[k] for k in left), sum(h[k] for k in left)
            gr, hr = sum(g) - gl, sum(h) - hl
            if hl < 0.5 or hr < 0.5:
                continue
            gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - sum(g) ** 2 / (sum(h) + ridge)
            if gain > best[0] + 1e-12:
                best = (gain, (j, c))
    if best[1] is None:
        return (0, math.inf, plain_tree(x, g, h, edges, depth - 1), 0.0)
    j, c = best[1]
    parts = [[k for k in range(len(g)) if (x[k][j] > c) == side] for side in (False, True)]
    return (j, c, *(plain_tree([x[k] for k in p], [g[k] for k in p], [h[k] for k in p], edges, depth - 1) for p in parts))


def plain_value(tree, row):
    while isinstance(tree, tuple):
        tree = tree[3] if row[tree[0]] > tree[1] else tree[2]
    return tree


def test_boosting_by_plain_loops(monkeypatch):
    monkeypatch.setattr(toxicity, "TREES", 4)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 3)).round(2)
    y = (x[:, 0] + x[:, 1] ** 2 + rng.normal(size=80) > 0.6).astype(float)
    w = rng.choice([1.0, 2.0], 80)
    base, trees = toxicity.boost(x, y, w)
    margin = np.full(80, math.log((w * y).sum() / (w * (1 - y)).sum()))
    assert base == pytest.approx(margin[0])
    edges = toxicity.quantile_bins(x)
    for t in trees:
        q = 1 / (1 + np.exp(-margin))
        plain = plain_tree(x.tolist(), (w * (q - y)).tolist(), (w * q * (1 - q)).tolist(), edges, toxicity.DEPTH)
        step = np.array([toxicity.RATE * plain_value(plain, r) for r in x.tolist()])
        assert np.allclose(toxicity.tree_value(t, x), step)
        margin += step
    margin = base + sum(toxicity.tree_value(t, x) for t in trees).round(9)  # without rounding's last bits, so that ties stay ties
    px, py = toxicity.isotonic(margin, y, w)
    model = toxicity.ToxicityModel({}, base, trees, px + 1e-8, py)
    got = toxicity.probability(x, model)
    # The isotonic fit by its min-max formula.
    order = np.argsort(margin, kind="stable")
    mean = lambda a, b: (w * y)[order[a : b + 1]].sum() / w[order[a : b + 1]].sum()
    m = margin[order]
    for at in (0, 20, 50, 79):
        first, last = np.searchsorted(m, m[at]), np.searchsorted(m, m[at], side="right") - 1
        ends = [k for k in range(last, 80) if k == 79 or m[k] != m[k + 1]]
        starts = [k for k in range(first + 1) if k == 0 or m[k] != m[k - 1]]
        assert got[order[at]] == pytest.approx(max(min(mean(a, b) for b in ends) for a in starts))


def test_toxicity_features_by_plain_loops():
    lexicon = {"vile": 2.0, "grub-": 1.0}
    text = "YOU are vile! Grubby gr4bs, v!le you? 12ab AAA"
    f = dict(zip(toxicity.NAMES, toxicity.features(text, lexicon), strict=True))
    words = ["you", "are", "vile", "grubby", "gr4bs", "v", "le", "you", "12ab", "aaa"]
    assert f["density"] == 2 / 10 and f["weight"] == pytest.approx(3 / 10) and f["second_person"] == 2 / 10 and f["near"] == 2 / 10
    assert f["capitals"] == pytest.approx(sum(c.isupper() for c in text) / len(text)) and f["exclaimed"] == 2 / len(text)
    assert f["shouted"] == 2 / len(words) and f["obfuscated"] == 1 / len(words) and f["size"] == pytest.approx(math.log(11))


# -- URLs ---------------------------------------------------------------------------------------------------------


class PlainMarkov:
    def __init__(self, texts, order):
        self.order, self.after = order, defaultdict(Counter)
        for t in texts:
            padded = urls.END * order + t
            for k in range(order, len(padded)):
                for n in range(order + 1):
                    self.after[padded[k - n : k]][padded[k]] += 1

    def log_p(self, text):
        padded, total = urls.END * self.order + text, 0.0
        for k in range(self.order, len(padded)):
            p = 1 / urls.SYMBOLS
            for n in range(self.order + 1):
                seen = self.after.get(padded[k - n : k])
                if seen is None:
                    break
                p = (seen[padded[k]] + len(seen) * p) / (sum(seen.values()) + len(seen))
            total += math.log(p)
        return total


def test_markov_by_dicts():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abc/é🙂"), rng.integers(1, 20))) + "\n" for _ in range(80)]
    new = ["".join(rng.choice(list("abcd/é🙂漢"), rng.integers(1, 40))) for _ in range(60)] + ["a" * 3000]
    m = urls.Markov()
    for t in texts:
        m.add(t)
    plain = PlainMarkov(texts, urls.ORDER)
    assert np.allclose(m.log_ps(new), [plain.log_p(t) for t in new])


def test_judgement_by_dicts(spark):
    """Verdicts of a whole table: the models, the held-out quarter, the limit and the ratio, all by plain loops."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").withColumn("ratio", F.lit("clash"))
    long = [(10**6 + k, u) for k, u in enumerate(["http://long.net/" + "ab/" * 20_000, None, "no scheme", "http://x.com/de/" + "z" * 50_000])]
    pages = pages.select("page_id", "url", "ratio").unionByName(spark.createDataFrame([(*r, "x") for r in long], "page_id long, url string, ratio string"))
    judged = urls.with_rule(pages.select("page_id", "url"))
    h = F.xxhash64("host", "path")
    cut = judged.where("rule is not null").select(F.substring("host", 1, urls.LONGEST).alias("host"), F.substring("path", 1, urls.LONGEST).alias("path"), "rule_verdict").distinct()
    known = cut.withColumn("held", F.pmod(h, F.lit(4)) == 0).collect()
    text = lambda r: r["host"].rpartition(".")[0] + r["path"] + "\n"
    good, bad = (PlainMarkov([text(r) for r in known if r["rule_verdict"] == v and not r["held"]], urls.ORDER) for v in ("allow", "block"))
    ratio = lambda t: (good.log_p(t) - bad.log_p(t)) / len(t)
    held = sorted((ratio(text(r)), r["rule_verdict"] == "allow") for r in known if r["held"])
    best, limit = -1.0, None
    for k in range(len(held) + 1):
        caught = sum(not g for _, g in held[:k]) / max(1, sum(not g for _, g in held)) - sum(g for _, g in held[:k]) / max(1, sum(g for _, g in held))
        if caught > best + 1e-12:
            best = caught
            limit = held[0][0] - 1e-9 if not k else held[-1][0] + 1e-9 if k == len(held) else (held[k - 1][0] + held[k][0]) / 2
    out = urls.judge(pages).collect()
    assert len(out) == pages.count()
    for r in out:
        if r["rule"] is None and (r["host"] or r["path"]):
            x = ratio(text(r))
            assert r["ratio"] == pytest.approx(x, abs=1e-9) and r["verdict"] == ("block" if x < limit else "allow")
        elif r["rule"] is None:
            assert r["ratio"] == 0 and r["verdict"] == "allow"
        else:
            assert r["ratio"] is None


# -- language -----------------------------------------------------------------------------------------------------


def plain_grams(text):
    """The buckets of all letter n-grams of a text, one by one."""
    low = "".join(c if c.isalpha() else " " for c in (text or "").lower()) + "  "
    out = []
    for n in language.GRAMS:
        for k in range(len(low)):
            gram = (low[k : k + n] + "   ")[:n]
            if gram.strip(" "):
                codes = np.array([ord(c) for c in gram], np.uint32)
                out.append(int(language.gram_buckets(codes, n)[0]))
    return out


def test_bayes_by_dicts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang", F.substring("text", 1, 1500).alias("text"))
    train = crc_mod(F.col("doc_id"), 5) != 0
    rows = docs.collect()
    counts = defaultdict(Counter)
    for r in rows:
        if r["lang"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5:
            counts[r["lang"]].update(plain_grams(r["text"]))
    langs = sorted(counts)
    total = {x: sum(counts[x].values()) + language.SMOOTHING * language.BUCKETS for x in langs}
    got = {r["doc_id"]: r for r in language.identify(docs, language.fit(docs, train)).collect()}
    for r in rows[:60]:
        grams = plain_grams(r["text"])
        p = [sum(math.log((counts[x][g] + language.SMOOTHING) / total[x]) for g in grams) for x in langs]
        has = any(c.isalpha() for c in r["text"] or "")
        scale = min(1, language.EVIDENCE / max(1, len(grams)))
        score = 1 / sum(math.exp((v - max(p)) * scale) for v in p) if has else 0.0
        assert got[r["doc_id"]]["lang_pred"] == (langs[int(np.argmax(p))] if has else "und")
        assert got[r["doc_id"]]["lang_score"] == pytest.approx(score, rel=2e-3, abs=1e-4)
