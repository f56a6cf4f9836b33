"""Sharding along a Hilbert curve.

Source, language and size of a document are quantised to cells of a cube: each in its
order, by what share of the rows comes before, so that cells are about equally full and
neighbours on an axis are neighbours in order. Documents are sorted by the place of their
cell on a Hilbert curve through the cube and cut into runs, so that a run spans few values
of each dimension, and the least and largest values that Parquet keeps of it let a filter
on any of them pass over most runs.

Law ``bytes``: the shards are equal runs of bytes, cut between groups of equal texts: a
group stays whole, at the first place that any of its rows has, in the shard that its
middle falls into. So a shard is off its even share by one group at most; only a group
that is larger than an even share is cut, between its rows.

Defined results: a null text has size 1 and CRC 0, and is equal to an empty one; null
source or language come first; a missing ``source`` or ``lang`` column is null; rows that
repeat are kept as often as they come; an empty table gives an empty result; other columns
are ignored by ``shard`` and kept by ``sharded``, where shard columns take the place of
columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartula.llm.common import checkpoint, ranked

#: Bits of each dimension.
BITS = 4
#: Distinct values of a dimension that are sent to all executors; more are joined by a shuffle.
VALUES = 100_000


def curve_index(axes: list[int], bits: int = BITS) -> int:
    """Place on the Hilbert curve of a cell, by Skilling's transform of its coordinates."""
    x, n = list(axes), len(axes)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    return sum(((x[i] >> b) & 1) << (b * n + n - 1 - i) for b in range(bits) for i in range(n))


def curve_table(spark, dims: int = 3, bits: int = BITS) -> DataFrame:
    """cell, place of all 2 ** (dims * bits) cells: 4,096 rows by default, whatever the input."""
    side = 1 << bits
    rows = [(c, curve_index([(c // side**i) % side for i in range(dims)], bits)) for c in range(side**dims)]
    return spark.createDataFrame(rows, "cell int, place int")


def with_cell(rows: DataFrame, value: str, name: str, bits: int = BITS) -> DataFrame:
    """rows with a cell of bits bits: which part of the rows, in order of the value, the middle of its rows falls into."""
    counts = ranked(rows.groupBy(F.col(value).alias("__value")).agg(F.count("*").alias("__n")), [F.col("__value").asc_nulls_first()], "__n")
    cell = F.floor((1 << bits) * (F.col("__before") + F.col("__n") / 2) / F.col("__sum")).cast("int")
    cells = checkpoint(counts.select("__value", cell.alias(name)))
    cells = F.broadcast(cells) if cells.count() <= VALUES else cells
    return rows.join(cells, rows[value].eqNullSafe(cells["__value"])).drop("__value")


def assigned(docs: DataFrame, shards: int, keep: bool) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and, to keep, row (all columns) of each row of docs."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    named = lambda c: (F.col(c) if c in docs.columns else F.lit(None)).cast("string").alias(c)
    slim = docs.select(
        F.col("doc_id"), named("source"), named("lang"), (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"),
        *([F.struct(*docs.columns).alias("row")] if keep else []),
    )
    slim = slim.withColumn("scale", F.floor(4 * F.log2(F.col("size").cast("double"))))
    for value, name in (("source", "x"), ("lang", "y"), ("scale", "z")):
        slim = with_cell(slim, value, name)
    side = 1 << BITS
    slim = slim.withColumn("cell", (F.col("x") + side * F.col("y") + side * side * F.col("z")).cast("int")).join(F.broadcast(curve_table(spark)), "cell")
    slim = slim.drop("scale", "x", "y", "z", "cell")
    if not keep:
        slim = checkpoint(slim)
    text_key = ["h", "text_crc32", "size"]
    groups = slim.groupBy(*text_key).agg(F.min("place").alias("first"), F.sum("size").alias("bytes"))
    groups = ranked(groups, ["first", *text_key], "bytes")
    share = F.col("__sum") / F.lit(float(shards))
    middle = F.least(F.floor((F.col("__before") + F.col("bytes") / 2) / share), F.lit(shards - 1)).cast("int")
    groups = checkpoint(groups.select(*text_key, "first", F.col("__before").alias("before"), F.col("__sum").alias("all"), F.when(F.col("bytes") <= share, middle).alias("of_group")))
    rows = ranked(slim.drop("place").join(groups, text_key), ["first", *text_key, F.col("doc_id").asc_nulls_first(), F.col("source").asc_nulls_first(), F.col("lang").asc_nulls_first()])
    # Groups over an even share: fewer than there are shards.
    large = checkpoint(rows.where("of_group is null").groupBy(*text_key).agg(F.min("__rank").alias("group_rank")))
    rows = rows.join(F.broadcast(large), text_key, "left")
    at = F.col("before") + (F.col("__rank") - F.col("group_rank") + 0.5) * F.col("size")
    own = F.least(F.floor(at / (F.col("all") / F.lit(float(shards)))), F.lit(shards - 1)).cast("int")
    rows = rows.withColumn("shard", F.coalesce("of_group", own))
    firsts = checkpoint(rows.groupBy("shard").agg(F.min("__rank").alias("shard_rank")))  # a row for each shard
    rows = rows.join(F.broadcast(firsts), "shard").withColumn("slot", (F.col("__rank") - F.col("shard_rank")).cast("long"))
    return rows.select("doc_id", "size", "text_crc32", "shard", "slot", *(["row"] if keep else []))


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of docs.

    Only slim rows are ranged along the curve; texts stay where they are.
    """
    rows = assigned(docs, shards, keep=False)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sharded(docs: DataFrame, shards: int = 8) -> DataFrame:
    """docs with size, text_crc32, law, shard, slot, in the order of the curve: as they were ranged to be ranked."""
    rows = assigned(docs, shards, keep=True)
    made = ("size", "text_crc32", "law", "shard", "slot")
    own = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in made]
    return rows.select(*own, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """Writes docs to path as Parquet, a folder for each shard, each of files that are runs of the curve."""
    sharded(docs, shards).write.partitionBy("shard").parquet(path)
