"""Helpers that the corpus operators share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words, as Java's regular expressions say it: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes in an Arrow batch, about: whole texts travel in them, and a text can be long.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20
#: Seconds between two collections of garbage after checkpoints, at least.
COLLECT_EVERY = 4.0
_collected = [0.0]


def scratch(spark: SparkSession) -> str:
    """The shared folder for checkpoints; a temporary one only for a local master whose session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", named)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if the session still runs."""
    jvm = spark.sparkContext._jvm
    if spark.sparkContext._jsc is not None:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Has a folder that exists deleted when the driver's JVM ends, be it that the session was stopped before."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


def checkpoint(df: DataFrame) -> DataFrame:
    """df, written to the shared folder: its lineage is cut, and a lost executor costs nothing.

    Now and then garbage is collected, so that Spark's cleaner removes the shuffle files that
    only the lineage held.
    """
    scratch(df.sparkSession)
    out = df.checkpoint(eager=True)
    del df
    if time.monotonic() - _collected[0] > COLLECT_EVERY:
        collect_garbage(out.sparkSession)
    return out


def collect_garbage(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of plans that nothing holds any more."""
    _collected[0] = time.monotonic()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame) -> DataFrame:
    """df, as a table of Parquet in the shared folder, which goes when the driver ends: columns can be read apart, and take less room."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    remove_at_end(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing will read again."""
    for t in tables:
        remove(t.sparkSession, t._stored_at)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches that hold whole texts stay small; plans read this when they run, so it is left set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def merged(vectors: DataFrame, kind: str = "<i8") -> np.ndarray | None:
    """The sum of a column of vectors (binary, a row for each partition or so), added up in a tree of tasks; None without rows.

    A task adds some forty vectors, and no more than that reach the driver.
    """
    rows = vectors.rdd.map(lambda r: np.frombuffer(r[0], kind))
    n, depth = rows.getNumPartitions(), 2
    if not n:
        return None
    while 40**depth < n:
        depth += 1
    return rows.mapPartitions(_added).treeReduce(_sum, depth)


def _sum(a, b):
    return b if a is None else a if b is None else a + b


def _added(vectors):
    out = None
    for v in vectors:
        out = _sum(out, v)
    return [out]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of an Arrow column, one after another, and where each begins and the last ends; null is empty."""
    own = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(own):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    cuts = np.frombuffer(own.buffers()[1], np.int64)[own.offset : own.offset + len(own) + 1]
    data = np.frombuffer(own.buffers()[2] or b"", np.uint8)[cuts[0] : cuts[-1]]
    return data, cuts - cuts[0]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until no column of df, in any case, has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: str | F.Column) -> F.Column:
    """Number of words; null has none."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, order: list, weight: str | None = None) -> DataFrame:
    """df with __rank, gapless from 0 in the order, and __total, the number of rows.

    With a weight also __before, the sum of the weights of the rows before, and __sum, of all.
    Rows are ranged and numbered within their partitions; the counts and sums of the
    partitions, one row each, make the numbers global. The ranged rows are checkpointed, so
    that both steps see the same partitions.
    """
    ranged = df.repartitionByRange(parts(df.sparkSession), *order).sortWithinPartitions(*order)
    ranged = checkpoint(ranged.withColumn("__at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("__part", F.shiftright("__at", 33).cast("int"))
    own = F.lit(0) if weight is None else F.col(weight)
    counts = ranged.groupBy("__part").agg(F.count("*").alias("n"), F.sum(own).alias("w"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    for source, first, total in (("n", "__first", "__total"), ("w", "__ahead", "__sum")):
        counts = counts.withColumn(first, F.coalesce(F.sum(source).over(before), F.lit(0))).withColumn(total, F.sum(source).over(everything))
    counts = checkpoint(counts.drop("n", "w"))  # a row for each partition: small, whatever the input
    rows = ranged.join(F.broadcast(counts), "__part").withColumn("__rank", F.col("__first") + F.col("__at").bitwiseAND((1 << 33) - 1))
    if weight is None:
        return rows.drop("__part", "__at", "__first", "__ahead", "__sum")
    within = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__before", F.col("__ahead") + F.coalesce(F.sum(own).over(within), F.lit(0)))
    return rows.drop("__part", "__at", "__first", "__ahead")
