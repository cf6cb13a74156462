"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, benchmark decontamination, best-fit packing.

Each stage takes what its predecessor kept, written as Parquet and read again, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import posixpath
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import decontaminate, language, lines, packing, simhash
from lattica.llm.common import crc_mod, fresh, release, remove, shared_folder, table

#: A document goes if its language is ``und`` or less probable than this.
MIN_LANGUAGE_SCORE = 0.5
#: Candidates of the SimHash stage: fingerprints of two-word shingles within so many bits. The README has their recall.
NEAR_WORDS, NEAR_REACH = 2, 9


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an identified language.

    Null texts and those without a letter have none and go, whatever their other columns hold; rows that repeat stay or go together; a null lang or doc_id is not
    learned from; of equal scores the first language in order is taken; extra columns stay with their rows.
    """
    model = language.fit(docs, crc_mod(F.col("doc_id"), 5) != 0)
    lang, score = (fresh(docs.columns, n) for n in ("lang_pred", "lang_score"))
    judged = language.identify(docs, model, tuple(docs.columns), (lang, score))
    return judged.where((F.col(lang) != language.UNKNOWN) & (F.col(score) >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later repeats of runs of lines.

    Null stays null and empty stays empty; a text of which all goes becomes empty, its row stays; rows without doc_id come before all others, and rows of one id and
    text are one document; n_chars follows the text where lines went; extra columns stay with their rows.
    """
    gone = fresh(docs.columns, "n_removed")
    out = lines.dedup(docs, count_column=gone, whole_runs=True)
    n_chars = F.when(F.col(gone) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one of smallest doc_id, the first of equal rows.

    Null and empty texts are one group; a null doc_id sorts last; extra columns stay with their rows.
    """
    return simhash.dedup(docs, reach=NEAR_REACH, near_shingle=NEAR_WORDS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark, each row judged by its own text: ids may be null or repeat.

    Null and empty texts hold none and stay; repeated rows stay or go together; extra columns, whatever their names, stay with their rows.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences.

    A null text is an empty one, of one token; repeated rows are packed each; extra columns are not read.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("simhash_dedup", simhash_dedup), ("decontaminate", decontaminated), ("packing", pack)]

#: SQL cannot express the stages: each is tested against a brute-force version in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = posixpath.join(shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        path = posixpath.join(folder, f"{k}-{name}")
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            remove(spark, before)
        release(spark)
        before = path
    return docs
