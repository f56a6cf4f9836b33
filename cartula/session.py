"""The Spark session this engine expects."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "cartula", **config: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; config wins over these."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    builder = SparkSession.builder.appName(app)
    for k, v in (settings | config).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


#: What runs keep until release.
_KEPT: list[DataFrame] = []


def keep(rows: DataFrame) -> DataFrame:
    """rows, kept in memory and on disk until release: several steps read them."""
    _KEPT.append(rows.persist())
    return _KEPT[-1]


def release() -> None:
    """Frees what runs so far kept; what they returned is computed anew if it is read again."""
    while _KEPT:
        _KEPT.pop().unpersist()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one only for a local master whose session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", named)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(rows: DataFrame) -> DataFrame:
    """rows, written to the shared folder: what is built on them is planned without what they were built from."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint(eager=True)
