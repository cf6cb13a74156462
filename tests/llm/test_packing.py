import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lattica.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(out, texts):
    """Every document's ids come back whole, and every sequence is gapless and not too long."""
    t = Tokenizer.from_file(PATH)
    for d, text in texts.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = out[out["doc_id"] == d].sort_values("piece")
        assert own["piece"].tolist() == list(range(len(own))) and own["length"].sum() == len(ids)
        assert own["start"].tolist() == np.cumsum([0, *own["length"]])[:-1].tolist()
        assert (len(own) == 1) == (len(ids) <= 2048) and (own["length"].iloc[1:] == 2048).all()
        for r in own.itertuples():
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == np.cumsum([0, *g["length"]])[:-1].tolist() and g["length"].sum() <= 2048


def test_round_trip(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = packing.pack(docs, PATH).toPandas()
    check(out, {r["doc_id"]: r["text"] for r in docs.collect()})
    assert out["sequence_id"].nunique() <= 1.02 * out["length"].sum() / 2048 + 1


def test_edges(spark, edge, empty):
    out = packing.pack(edge, PATH).toPandas()
    docs = edge.where("doc_id is not null and doc_id <> 5").collect()
    whole = out[out["doc_id"].notna() & (out["doc_id"] != 5)]
    for r in docs:
        own = whole[whole["doc_id"] == r["doc_id"]]
        assert own["length"].sum() == len(Tokenizer.from_file(PATH).encode(r["text"] or "", add_special_tokens=False).ids) + 1
    assert len(out[out["doc_id"] == 5]) == 2
    check(out, {})
    assert packing.pack(empty, PATH).count() == 0


def test_added_token_strings_are_as_in_the_library():
    text = "some <|endoftext|> here"
    assert packing.encoder(PATH)([text])[0] == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_exactly_the_histogram(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(2048, rng.lognormal(6, 1, 3000).astype(int) + 1)
    counts = Counter(lengths.tolist())
    got = Counter()
    n = 0
    for config, k in packing.plan(counts):
        assert sum(config) <= 2048 and k > 0
        n += k
        for x in config:
            got[x] += k
    assert got == counts and n <= lengths.sum() / 2048 * 1.01 + 1


def test_configurations_price_best():
    lengths, values = np.array([3, 4, 7]), np.array([3.0, 4.1, 7.0])
    config, value = packing.best_configuration(values, lengths, np.array([9, 9, 9]), 12)
    assert config == {4: 3} and abs(value - 12.3) < 1e-12


def test_cuts():
    assert packing.cuts(1) == [(0, 1)] and packing.cuts(2048) == [(0, 2048)] and packing.cuts(4100) == [(0, 4), (4, 2048), (2052, 2048)]


def least_sequences(lengths, capacity):
    """The fewest sequences, by trying all ways to add each piece to an open one or a new one."""
    best = len(lengths)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for room in {r for r in rooms if r >= lengths[k]}:
            rest = list(rooms)
            rest.remove(room)
            go(k + 1, [*rest, room - lengths[k]])
        go(k + 1, [*rooms, capacity - lengths[k]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(12))
def test_program_against_the_optimum(seed):
    """The whole cover holds the histogram; bound <= optimum <= cover; copies of an instance bring the cover near the bound's side of the optimum."""
    rng = np.random.default_rng(seed)
    lengths = sorted(rng.integers(2, 13, 9).tolist(), reverse=True)
    counts = Counter(lengths)
    cover = packing.configuration_lp(counts, 20, gap=float("inf"))
    assert not cover.left and sum((Counter({n: c.count(n) * k for n in c}) for c, k in cover.configurations), Counter()) == counts
    assert all(sum(c) <= 20 and k > 0 for c, k in cover.configurations)
    best, n = least_sequences(lengths, 20), sum(k for _, k in cover.configurations)
    assert cover.bound <= best + 1e-9 and best <= n <= best + 1
    many = packing.configuration_lp({n: 1000 * k for n, k in counts.items()}, 20, gap=float("inf"))
    total = sum(k for _, k in many.configurations)
    assert many.bound <= total <= 1000 * best * 1.05 and many.bound <= 1000 * best + 1e-6


def test_program_holds_most_pieces():
    rng = np.random.default_rng(0)
    counts = Counter(np.minimum(2047, rng.lognormal(6, 1, 10_000).astype(int) + 1).tolist())
    cover = packing.configuration_lp(counts)
    held = sum(len(c) * k for c, k in cover.configurations)
    assert held + sum(cover.left.values()) == 10_000 and held >= 9_000
    assert sum(k for _, k in packing.plan(counts)) <= min(cover.bound * 1.002 + 1, sum(packing.best_fit(counts, 2048).values()))


def test_many_full_pieces_need_no_rank(spark):
    text = " ".join("word" for _ in range(5000))
    out = packing.pack(spark.createDataFrame([(k % 3, text, "x") for k in range(40)], "doc_id long, text string, task string"), PATH).toPandas()
    assert (out.groupby("sequence_id")["length"].sum() <= 2048).all() and (out["length"] == 2048).sum() == 80
    for _, g in out.groupby("sequence_id"):
        assert sorted(g["offset"]) == np.cumsum([0, *g.sort_values("offset")["length"]])[:-1].tolist()
