"""One query for each operator, over its whole table with production parameters; and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import decontaminate, embedding, language, lines, packing, quality, simhash, tokencount, toxicity, urls
from lattica.llm.common import crc_mod, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 4) == 2
    model = quality.fit(documents, table(spark, sf_dir, "labels"), ~held)
    out = quality.score(documents, model)
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 5) == 0
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"), ~held)
    out = toxicity.score(documents, model)
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), count_column="n_removed")
    return out.select("doc_id", "n_removed", "text")


def op7_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``op7_lines``, whose SQL fixes forward windows, but repeated runs go to their last line."""
    out = lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), count_column="n_removed", whole_runs=True)
    return out.select("doc_id", "n_removed", "text")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "ratio")


def op9_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 5) == 0
    out = language.identify(documents, language.fit(documents, ~held))
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_quality, op2_simhash, op3_toxicity, op4_embedding, op5_packing, op6_decontaminate, op7_lines, op7_runs, op8_urls, op9_tokencount, op10_language)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op4_embedding": EMBEDDING_SQL, "op6_decontaminate": DECONTAMINATE_SQL, "op7_lines": LINES_SQL, "op7_runs": RUNS_SQL}


#: Pairs by brute force; components by walking the links.
EMBEDDING_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), ok AS (
  SELECT vec_id, label, e FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), n AS (
  SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM ok
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.u, b.u) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION
  SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
), comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
cnt AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT v.vec_id, coalesce(cnt.n, 0)::BIGINT AS n_links, comp.c AS component_id, v.vec_id = comp.c AS kept
FROM v JOIN comp ON comp.a = v.vec_id LEFT JOIN cnt ON cnt.a = v.vec_id
"""

#: All diagonals on which a document and an item have enough equal tokens, and all windows on them.
DECONTAMINATE_SQL = r"""
WITH d AS (
  SELECT doc_id, unnest(w) AS tok, generate_subscripts(w, 1) - 1 AS p, len(w) AS n
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+') AS w FROM documents)
), b AS (
  SELECT item_id, unnest(w) AS tok, generate_subscripts(w, 1) - 1 AS p, len(w) AS n
  FROM (SELECT item_id, regexp_extract_all(lower(text), '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+') AS w FROM benchmark) WHERE len(w) >= 5
), eq AS (
  SELECT d.doc_id, b.item_id, d.p - b.p AS diag, b.p AS p, d.n AS dn, b.n AS bn FROM d JOIN b ON d.tok = b.tok
), diags AS (
  SELECT doc_id, item_id, diag, list(p) AS ps, least(13, bn) AS size, greatest(0, -diag) AS lo, least(bn, dn - diag) - least(13, bn) AS hi
  FROM eq GROUP BY doc_id, item_id, diag, bn, dn HAVING count(*) >= 0.8 * least(13, bn)
), win AS (
  SELECT doc_id, item_id, size, s + diag AS start, len(list_filter(ps, lambda x: x >= s AND x < s + size)) AS agreeing
  FROM (SELECT *, unnest(range(lo, hi + 1)) AS s FROM diags)
), best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY agreeing DESC, start) AS r FROM win WHERE agreeing >= 0.8 * size
)
SELECT doc_id, item_id, start::INT AS start, size::INT AS length, agreeing::INT AS agreeing FROM best WHERE r = 1
"""

#: Every window of lines with 50 words, by its whole content.
LINES_SQL = r"""
WITH l AS (
  SELECT doc_id, k, line, list_filter(regexp_split_to_array(line, '[\t\x0b\f\r ]+'), lambda x: x <> '') AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)
), f AS (
  SELECT doc_id, k, array_to_string(w, ' ') AS c, len(w) AS n, sum(len(w)) OVER (PARTITION BY doc_id ORDER BY k) AS t FROM l WHERE len(w) > 0
), win AS (
  SELECT a.doc_id, a.k AS s, min(b.k) AS e FROM f a JOIN f b ON a.doc_id = b.doc_id AND b.k >= a.k AND b.t - a.t + a.n >= 50 GROUP BY a.doc_id, a.k
), content AS (
  SELECT w.doc_id, w.s, w.e, string_agg(f.c, chr(10) ORDER BY f.k) AS c FROM win w JOIN f ON f.doc_id = w.doc_id AND f.k BETWEEN w.s AND w.e GROUP BY ALL
), later AS (
  SELECT doc_id, s, e FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY doc_id, s) AS r FROM content) WHERE r > 1
), gone AS (
  SELECT DISTINCT l.doc_id, l.k FROM l JOIN later x ON l.doc_id = x.doc_id AND l.k BETWEEN x.s AND x.e
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.k) FILTER (gone.k IS NULL) AS text, count(gone.k) AS n
  FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.k = l.k GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(kept.n, 0)::INT AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
FROM documents d LEFT JOIN kept USING (doc_id)
"""

#: Every pair of equal lines on its diagonal, and the maximal runs of them that hold 50 words.
RUNS_SQL = r"""
WITH l AS (
  SELECT doc_id, k, line, list_filter(regexp_split_to_array(line, '[\t\x0b\f\r ]+'), lambda x: x <> '') AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)
), f AS (
  SELECT doc_id, k, array_to_string(w, ' ') AS c, len(w) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS r FROM l WHERE len(w) > 0
), eq AS (
  SELECT x.doc_id, y.doc_id AS earlier, x.r - y.r AS diag, x.r, x.k, x.n
  FROM f x JOIN f y ON x.c = y.c AND (y.doc_id < x.doc_id OR y.doc_id = x.doc_id AND y.r < x.r)
), run AS (
  SELECT doc_id, min(k) AS s, max(k) AS e
  FROM (SELECT *, r - row_number() OVER (PARTITION BY doc_id, earlier, diag ORDER BY r) AS island FROM eq)
  GROUP BY doc_id, earlier, diag, island HAVING sum(n) >= 50
), gone AS (
  SELECT DISTINCT l.doc_id, l.k FROM l JOIN (SELECT DISTINCT doc_id, s, e FROM run) x ON l.doc_id = x.doc_id AND l.k BETWEEN x.s AND x.e
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.k) FILTER (gone.k IS NULL) AS text, count(gone.k) AS n
  FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.k = l.k GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(kept.n, 0)::INT AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
FROM documents d LEFT JOIN kept USING (doc_id)
"""
