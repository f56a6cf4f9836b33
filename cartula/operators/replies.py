"""A table of a model's replies, which grows by committed batches.

Requests are rows (key, system, user); a key is a hash of all that decides the reply. What the
table lacks is asked once for each key, a batch at a time: a batch's replies are appended in
one commit before the next batch starts. A server that fails doesn't fail its task: what was
answered is committed, and then the run stops. A later run over the same requests asks for
the rest alone.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartula.operators.models import ModelError, cache_misses
from cartula.session import cut

#: Requests of a batch, about.
BATCH = 2000


def _asked(reply: Callable[[str, str], str]):
    """Reads key, system, user; gives key, reply, error. After a failure the rest of a task isn't asked."""

    def run(batches):
        broken = None
        for b in batches:
            told, why = [], []
            for system, user in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                out = None
                if broken is None:
                    try:
                        out = reply(system, user)
                    except Exception as e:  # whatever a server does: the other replies are kept
                        broken = f"{type(e).__name__}: {e}"
                told.append(out)
                why.append(broken if out is None else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(told, pa.string()), pa.array(why, pa.string())], ["key", "reply", "error"])

    return run


class Replies:
    """The table at a path that the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def known(self) -> DataFrame:
        """key, reply of all that was answered."""
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            return self.spark.createDataFrame([], "key string, reply string")
        return self.spark.read.schema("key string, reply string").parquet(self.path).dropDuplicates(["key"])

    def ask(self, requests: DataFrame, reply: Callable[[str, str], str], batch: int = BATCH) -> DataFrame:
        """requests with reply; fails with ModelError once a batch with a failure is committed. A reply of None counts as a failure."""
        missing = cut(cache_misses(requests.select("key", "system", "user"), self.known()))
        batches = -(-missing.count() // batch)
        for n in range(batches):
            own = missing.where(F.pmod(F.xxhash64("key"), F.lit(batches)) == n)
            told = cut(own.mapInArrow(_asked(reply), "key string, reply string, error string"))
            told.where("reply is not null").select("key", "reply").write.mode("append").parquet(self.path)
            failed = told.where("reply is null").agg(F.count("*").alias("n"), F.max("error").alias("why")).first()
            if failed["n"]:
                raise ModelError(f"{failed['n']} of batch {n + 1} of {batches} have no reply: {failed['why']}")
        return requests.join(self.known(), "key", "left")
