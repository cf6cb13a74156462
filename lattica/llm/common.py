"""What several operators share: lineage cuts, Arrow text access, components, bounded samples."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that are worked on at a time, so memory follows the texts of few documents.
CHUNK_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where that is unset, one JVM alone (``local[...]``) may use a folder of its own; a cluster has none that all can read."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Compute once and cut lineage through the reliable checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of lineage that has been cut: it does when the driver's JVM finds nothing refers to them, which by itself may take half an hour."""
    gc.collect()  # Python's own references first
    spark._jvm.System.gc()


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that is not needed any more, in whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(columns: list[str], name: str) -> str:
    """``name``, with underscores in front until no column has it (Spark ignores case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_key() -> Column:
    """128 bits of the column ``text`` that tell texts; a null text is told from an empty one."""
    return F.coalesce(F.unhex(F.md5("text")), F.lit(b""))


def crc_mod(column: Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``; null for null."""
    return F.crc32(column.cast("string").cast("binary")) % modulus


def chunks(batches: Iterator[pa.RecordBatch], rows: int = CHUNK_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_chunks(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters, one text at least."""
    at = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array without copying the texts; a null is an empty text."""
    array = pc.fill_null(array, "") if array.null_count else array
    if pa.types.is_large_string(array.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = array.buffers()
    if offsets is None or len(array) == 0:
        return np.zeros(len(array) + 1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(offsets, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0] : off[-1]]


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, the same ones each time: those of the smallest key hash.

    Spark keeps ``most`` rows a task for this and merges them, so its size is bounded by the parameter.
    """
    return df.orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(most)


def sampled_texts(documents: DataFrame, labels: DataFrame, label: str, train: Column, most: int) -> DataFrame:
    """(doc_id, text, label) of a bounded sample of labelled training rows.

    ``most`` bounds the ids per label value; the id table is broadcast, as that bound holds at any size. Of an id
    with several texts the one of least hash is taken, so the bound holds for rows. A document whose label rows disagree is left out.
    """
    ids = (
        labels.where(train & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.min(label).alias("_y"), F.max(label).alias("_y2"))
        .where("_y = _y2 and _y in (0, 1)")
        .select("doc_id", "_y")
    )
    both = bounded_sample(ids.where("_y = 0"), "doc_id", most).unionByName(bounded_sample(ids.where("_y = 1"), "doc_id", most))
    rows = documents.select("doc_id", "text").join(F.broadcast(both), "doc_id")
    one = rows.groupBy("doc_id", "_y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    return one.select("doc_id", "t.text", F.col("_y").cast("int").alias("y"))


def share_of(labels: DataFrame, label: str, train: Column) -> float:
    """The share of 1 among the training rows labelled 0 or 1; 0.5 without any."""
    found = labels.where(train & F.col(label).isin(0, 1)).agg(F.avg(label)).first()[0]
    return 0.5 if found is None else float(found)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b): root is the smallest node reachable.

    Alternating large-star and small-star over whole tables: each round is two aggregations
    with map-side combining and two joins, and cuts lineage; no node's neighbours are gathered in a task.
    Ends when a round changes nothing.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(e)
    for _ in range(rounds):
        if state[0] == 0:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = cut(small.where("u <> v").distinct())
        now = _state(e)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    member = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return member.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(e: DataFrame) -> tuple[int, int]:
    row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], int(row["s"] or 0)
