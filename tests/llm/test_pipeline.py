import corpus_pipeline
import duckdb
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica.llm import language, simhash
from lattica.llm.common import crc_mod
from lattica.llm.queries import DECONTAMINATE_SQL
from lattica.llm.words import words
from tests.llm.test_matching import brute_runs
from tests.llm.test_packing import check
from tests.llm.test_simhash import brute_fingerprint, brute_groups


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data)
        assert docs.columns == columns, name
        docs = docs.cache()
        sizes.append(docs.count())
    assert sizes[0] == sizes[1] >= sizes[2] >= sizes[3] > 100
    last = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert {r["doc_id"] for r in last.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_run_matches_its_stages(spark, data):
    out = corpus_pipeline.run(spark, data).toPandas()
    assert (out.groupby("sequence_id")["length"].sum() <= 2048).all() and len(out) > 100


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
@pytest.mark.parametrize("table", ["edge", "empty"])
def test_edges(spark, data, stage, table, request):
    docs = request.getfixturevalue(table)
    out = stage[1](spark, docs, data)
    rows = out.collect()
    assert table == "edge" or not rows
    if stage[0] != "packing":
        assert out.columns == docs.columns


def test_decontamination_goes_by_row(spark, data):
    item = max((r["text"] or "" for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()), key=len)
    rows = [(None, item), (None, "a clean text without an id"), (None, None), (7, f"before {item} after"), (7, "another clean text of that id"), (8, "clean"), (9, item), (9, item)]
    out = corpus_pipeline.decontaminated(spark, spark.createDataFrame(rows, "doc_id long, text string"), data).collect()
    assert {(r["doc_id"], r["text"]) for r in out} == {(None, "a clean text without an id"), (None, None), (7, "another clean text of that id"), (8, "clean")} and len(out) == 4


# -- each stage, and the whole, against versions by brute force on the documents of the smallest scale -------------


@pytest.fixture(scope="module")
def stages(spark, data):
    """(name, input rows, output rows) of every stage, each on what its predecessor kept."""
    docs, out = spark.read.parquet(f"{data}/documents.parquet").withColumn("_hit", F.lit("x")), []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, data).cache()
        out.append((name, docs.collect(), made.collect()))
        docs = made
    return out


def stage_of(stages, name):
    return next((before, after) for n, before, after in stages if n == name)


def test_language_stage_by_brute_force(spark, stages):
    before, after = stage_of(stages, "language_id")
    model = language.fit(spark.createDataFrame(before), crc_mod(F.col("doc_id"), 5) != 0)
    keep = []
    for r in before:
        lang, score = language.predict([r["text"]], model)
        has = any(c.isalpha() for c in r["text"] or "")
        assert has == (lang[0] != "und")
        if has and score[0] >= 0.5:
            keep.append(r)
    assert sorted(after) == sorted(keep) and len(keep) >= 0.95 * len(before)


def test_line_stage_by_brute_force(stages):
    before, after = stage_of(stages, "line_dedup")
    want = brute_runs([(r["doc_id"], r["text"] or "") for r in before], 50)
    texts = {r["doc_id"]: r["text"] for r in before}
    for r in after:
        assert [" ".join(x.split()) for x in (r["text"] or "").split("\n") if x.split()] == want[r["doc_id"]]
        assert r["text"] == texts[r["doc_id"]] or r["n_chars"] == len(r["text"])
    assert sum(r["text"] != texts[r["doc_id"]] for r in after) > 3


def test_simhash_stage_by_brute_force(stages):
    before, after = stage_of(stages, "simhash_dedup")
    keys = []
    for r in before:
        h = words(pa.array([r["text"] or ""]))[1]
        keys.append((brute_fingerprint(r["text"]), simhash.near_fingerprint(h, 2), sum(x << 64 * k for k, x in enumerate(simhash.minhash_bits(h, 5))), set(simhash.shingle_sets(pa.array([r["text"] or ""]))[0].tolist())))
    bits = lambda x, y: (x ^ y).bit_count()
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    near = lambda a, b: bits(a[0], b[0]) <= 3 or bits(a[1], b[1]) <= corpus_pipeline.NEAR_REACH and bits(a[2], b[2]) <= simhash.UNLIKE and alike(a[3], b[3])
    roots = brute_groups(keys, near)
    least = {}
    for r, root in zip(before, roots, strict=True):
        least[root] = min(least.get(root, r["doc_id"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in after) == sorted(least.values()) and len(after) < len(before)
    assert {r["doc_id"]: r for r in before}.items() >= {r["doc_id"]: r for r in after}.items()


def test_decontamination_stage_by_sql(data, stages):
    before, after = stage_of(stages, "decontaminate")
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r["doc_id"] for r in before], "text": [r["text"] for r in before]}))
    con.sql(f"CREATE VIEW benchmark AS SELECT * FROM '{data}/benchmark.parquet'")
    hit = {r[0] for r in con.sql(f"SELECT DISTINCT doc_id FROM ({DECONTAMINATE_SQL})").fetchall()}
    assert hit and sorted(after) == sorted(r for r in before if r["doc_id"] not in hit)


def test_packing_stage_and_run(spark, data, stages):
    before, after = stage_of(stages, "packing")
    out = pd.DataFrame([r.asDict() for r in after])
    check(out, {r["doc_id"]: r["text"] for r in before})
    whole = corpus_pipeline.run(spark, data).toPandas()
    piece = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole[piece].to_numpy().tolist())) == sorted(map(tuple, out[piece].to_numpy().tolist()))
    check(whole, {})


def test_stages_on_rows_that_clash_and_repeat(spark, edge, data):
    """Rows of null and repeated ids, null and empty texts and clashing columns, through all stages but the last: what is kept is whole."""
    docs = edge
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = stage(spark, docs, data)
        after = docs.collect()
        if name != "line_dedup":
            assert all(r in before for r in after)
        assert docs.columns == edge.columns and len(after) <= len(before)
        ids = [r["doc_id"] for r in after]
        want = {"language_id": {None: 1, 4: 1, 5: 2, 6: 1, 8: 1, 9: 1, 11: 1}, "simhash_dedup": {4: 1, 5: 1, 6: 0, 9: 1, 11: 1}}.get(name, {})
        assert all(ids.count(k) == v for k, v in want.items()), (name, ids)
