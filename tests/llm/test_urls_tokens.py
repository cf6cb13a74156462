"""Operators 8 and 9."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from lattica.llm import tokencount, urls
from tests.llm.test_brute import PlainMarkov

URLS = [None, "", "no scheme", "http://", "http://Example.ORG/es/1", "https://a.example.org/es/x?q=/de/", "http://example.org/en/12", "http://example.org/en/2", "http://example.org", "http://b.com/fr/", "http://b.com/frx", "http://com/de/z#f", "http://telecom/de/", "ftp://u@x.com:80/de/a", "x://y://z/p", "http://e.net?a=/b", "http://e.net#/b", "http://e.net/p?\n", "http://ÄB.org/", "http://a.org//es/"]


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]
    fits = []
    for verdict, rule in urls.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_rules(spark):
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate(URLS)], "page_id long, url string, host string")
    out = urls.judge(df).collect()
    assert len(out) == len(URLS)
    for r in out:
        host, path, rule, verdict = brute_rule(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), URLS[r["page_id"]]
        assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")
    assert urls.judge(df.limit(0)).count() == 0


def test_model_is_a_distribution_and_tells_apart():
    m = urls.Markov()
    for x in ("news/today\n", "news/world\n", "sport\n"):
        m.add(x)
    assert sum(np.exp(m.log_p(chr(c))) for c in range(256)) == pytest.approx(1)
    assert m.log_p("news/a\n") > m.log_p("zqxj/a\n")


def test_judges_by_likelihood(spark):
    good = [f"http://a{k}.com/fr/wiki/article{k}" for k in range(60)]
    bad = [f"http://b{k}.com/de/xxx-casino-{k}" for k in range(60)]
    new = ["http://c.net/de/xxx-casino-9", "http://c.net/fr/wiki/article7"]
    rows = [(k, u) for k, u in enumerate([*good, *bad, *new, None, new[0]])]
    out = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert (out[120], out[121], out[122], out[123]) == ("block", "allow", "allow", "block")


def many_urls(n, seed=5):
    """URLs that rules decide and others, from a few syllables; some repeat, hold rare characters or are long."""
    rng = np.random.default_rng(seed)
    part = lambda syllables: "".join(rng.choice(syllables, rng.integers(1, 5)))
    out = []
    for k in range(n):
        syllables = ["news", "wiki", "art", "é", "漢"] if k % 2 else ["cas", "xx", "art", "pill", "🙂"]
        end = ("com/fr/" if k % 2 else "com/de/") if k % 3 else "net/"
        out.append(f"http://{part(syllables)}.{end}{part(syllables)}{'/' + part(syllables) if k % 5 == 0 else ''}{k % 97}")
    return [*out, *out[:20], None, "no scheme", "http://", "http://q.net/" + "ab" * 3000, "http://q.com/de/" + "xx" * 3000]


def model_of(judged):
    """Both models and the limit by plain loops over all distinct URLs that rules decide."""
    known = {(r["host"], r["path"], r["rule_verdict"], r["held"]) for r in judged.where("rule is not null").withColumn("held", F.pmod(F.xxhash64("host", "path"), F.lit(4)) == 0).collect()}
    text = lambda h, p: h.rpartition(".")[0] + p + "\n"
    good, bad = (PlainMarkov([text(h, p) for h, p, v, held in known if v == says and not held], urls.ORDER) for says in ("allow", "block"))
    ratio = lambda h, p: (good.log_p(text(h, p)) - bad.log_p(text(h, p))) / len(text(h, p))
    held = [(ratio(h, p), v == "allow") for h, p, v, held in known if held]
    return ratio, plain_limit(held)


def plain_limit(held):
    """The lowest limit, before all ratios or right after one, that blocks most of the bad and fewest of the good."""
    each = sorted({r for r, _ in held})
    n = [max(1, sum(g is says for _, g in held)) for says in (True, False)]
    cuts = [each[0] - 1e-9, *((x + y) / 2 for x, y in zip(each, each[1:], strict=False)), each[-1] + 1e-9]
    return max(cuts, key=lambda c: (sum(r < c for r, g in held if not g) * n[0] - sum(r < c for r, g in held if g) * n[1], -c))


@pytest.mark.parametrize("grams", [urls.GRAMS, 300, 0])
def test_all_urls_are_learned_from(spark, grams):
    """Models broadcast, estimates broadcast for frequent grams only, and all joined."""
    pages = spark.createDataFrame(list(enumerate(many_urls(600))), "page_id long, url string")
    ratio, limit = model_of(urls.with_rule(pages))
    out = urls.judge(pages, grams=grams).collect()
    assert len(out) == pages.count()
    for r in out:
        if r["rule"] is not None:
            assert r["ratio"] is None and r["verdict"] == dict((t, v) for v, t in urls.RULES)[r["rule"]]
        elif not (r["host"] or r["path"]):
            assert r["ratio"] == 0 and r["verdict"] == "allow"
        else:
            x = ratio(r["host"], r["path"])
            assert r["ratio"] == pytest.approx(x, abs=1e-9) and (abs(x - limit) < 1e-9 or r["verdict"] == ("block" if x < limit else "allow"))
    assert {r["verdict"] for r in out if r["rule"] is None} == {"allow", "block"}


def test_no_bound_on_what_is_learned(spark):
    """25,000 URLs a class, more than earlier versions took, and long ones: every gram is counted."""
    n = 25_000
    rows = spark.range(2 * n).selectExpr("id as page_id", "concat('http://h', id % 7, if(id % 2 = 0, '.com/fr/', '.com/de/'), id, repeat('z', if(id < 4, 5000, 0))) as url")
    judged = urls.with_rule(rows)
    known = judged.where(F.pmod(F.xxhash64("host", "path"), F.lit(4)) != 0)
    size = {r["rule_verdict"]: r["n"] for r in known.groupBy("rule_verdict").agg(F.sum(F.length("host") - 4 + F.length("path") + 1).alias("n")).collect()}
    m = urls.fit(judged.withColumn("asked", F.lit(False)))
    assert [t.tables[0][1].tolist() for t in (m.good, m.bad)] == [[size["allow"]], [size["block"]]]


def test_characters_are_not_pooled():
    """Beyond 4,095 characters, too, each is told from all others."""
    texts = [chr(0x4E00 + k) * 2 + "\n" for k in range(5000)]
    m = urls.Markov()
    for t in texts:
        m.add(t)
    new = ["一一", chr(0x4E00 + 4999) * 2, "一丁", "é"]
    assert np.allclose(m.log_ps(new), [PlainMarkov(texts, urls.ORDER).log_p(t) for t in new])


@pytest.mark.parametrize("kind", ["mixed", "ties", "good first", "only good", "only bad"])
def test_limit_over_parts(spark, kind):
    rng = np.random.default_rng(3)
    ratios = rng.normal(size=400) if kind != "ties" else rng.integers(0, 9, 400) / 4
    good = {"good first": ratios < 0, "only good": ratios > -99, "only bad": ratios < -99}.get(kind, ratios + rng.normal(size=400) > 0)
    held = [(float(r), bool(g)) for r, g in zip(ratios, good, strict=True)]
    assert urls.calibrate(spark.createDataFrame(held, "ratio double, good boolean")) == pytest.approx(plain_limit(held), abs=1e-15)


# -- token counts -------------------------------------------------------------------------------------------------

PATH = public_tokenizers.path("piece_bpe_32k.model")


def library(vocabulary, bytes_known):
    pieces = list(vocabulary.items())
    vocab = [("<unk>", 0.0), *([(f"<0x{b:02X}>", 0.0) for b in range(256)] if bytes_known else []), *pieces]
    # The library's unknown score is its lowest less ten; placeholder scores of 0 are not the lowest.
    t = Tokenizer(models.Unigram(vocab, 0, bytes_known))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="never")
    return lambda text: len(t.encode(" " + text, add_special_tokens=False).ids) if text else 0


TEXTS = ["hello world", "  two  spaces ", "naïve café 中文🙂🙂x", "aaaaaaaaaaaaaa", "The quick brown fox.\nNew line\ttab", "\u0000", "ÿ", "▁▁a ▁b"]


@pytest.mark.parametrize("bytes_known", [True, False])
def test_counts_match_the_library(bytes_known):
    vocabulary, _ = tokencount.load_vocabulary(PATH)
    t, c = library(vocabulary, bytes_known), tokencount.Counter(vocabulary, bytes_known)
    for text in TEXTS:
        assert c.text(text) == t(text), text


@pytest.mark.parametrize("bytes_known", [True, False])
def test_ties_and_unknowns_match_the_library(bytes_known):
    rng = np.random.default_rng(1)
    for _ in range(60):
        pieces = {"".join(rng.choice(list("▁ab"), rng.integers(1, 4))): float(-rng.integers(1, 4)) for _ in range(12)}
        pieces = {p: s for p, s in pieces.items() if "▁" not in p[1:]}
        if not pieces:
            continue
        t, c = library(pieces, bytes_known), tokencount.Counter(pieces, bytes_known)
        for _ in range(20):
            text = "".join(rng.choice(list("abc a"), rng.integers(1, 12)))
            assert c.text(text) == t(text), (pieces, text)


def whole_library(vocabulary, bytes_known):
    """The library's model over a whole text, without a splitter."""
    vocab = [("<unk>", 0.0), *([(f"<0x{b:02X}>", 0.0) for b in range(256)] if bytes_known else []), *vocabulary.items()]
    t = Tokenizer(models.Unigram(vocab, 0, bytes_known))
    return lambda text: len(t.encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).ids) if text else 0


BLANKS = [*TEXTS, "x    y", "def f():\n    return  1", " " * 40, "a" + " " * 8 + "b", "  indented\n        more   \n", "| a   | bb  |    c|", "▁ ▁▁▁  x"]


@pytest.mark.parametrize("bytes_known", [True, False])
def test_runs_of_blanks_match_the_library(bytes_known):
    vocabulary, _ = tokencount.load_vocabulary(PATH)
    t, c = whole_library(vocabulary, bytes_known), tokencount.Counter(vocabulary, bytes_known, split=False)
    for text in BLANKS:
        assert c.text(text) == t(text), text
    assert tokencount.Counter(vocabulary, bytes_known).text("x    y") > c.text("x    y")


@pytest.mark.parametrize("bytes_known", [True, False])
@pytest.mark.parametrize("inner", ["any", "runs", "none"])
def test_pieces_with_blanks_match_the_library(bytes_known, inner):
    rng = np.random.default_rng(4)
    for _ in range(80):
        pieces = {"".join(rng.choice(list("▁▁ab"), rng.integers(1, 5))): float(-rng.integers(1, 4)) for _ in range(12)}
        if inner != "any":
            pieces = {p: s for p, s in pieces.items() if "▁" not in p.lstrip("▁") and (inner == "runs" or p != "▁")}
        if not pieces:
            continue
        t, c = whole_library(pieces, bytes_known), tokencount.Counter(pieces, bytes_known, split=False)
        for _ in range(20):
            text = "".join(rng.choice(list("abc   "), rng.integers(1, 14)))
            assert c.text(text) == t(text), (pieces, text)


def test_query_counts_runs_of_blanks(spark):
    vocabulary, known = tokencount.load_vocabulary(PATH)
    t = whole_library(vocabulary, known)
    rows = list(enumerate(BLANKS))
    got = tokencount.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {k: t(x) for k, x in rows}


def test_memory_is_bounded():
    c = tokencount.Counter({"a": -1.0, "▁": -1.0}, False, remembered=5)
    assert [c.text("a" * k) for k in range(1, 20)] == [k + 1 for k in range(1, 20)] and len(c) <= 5 and len(c.older) <= 5
    assert c.text("a " * 9) == 19


def test_edges(edge, empty):
    out = tokencount.token_counts(edge, PATH).toPandas()
    assert len(out) == edge.count() and (out[out["doc_id"].isin([1, 2])]["n_tokens"] == 0).all()
    assert tokencount.token_counts(empty, PATH).count() == 0
