"""Mixing sources to target weights by weighted fair queueing.

Each document gets the virtual time at which its source would have sent it: the
source's words so far, in a shuffled order, divided by the source's target. All
copies (a source may be read twice) are ranged by that time and cut where the
total budget is spent.

Defined results: a null source is a source of its own, the last; null or empty
texts have size 0 and take no words; a source with no words has target 0; an
empty table gives an empty result; repeated rows are separate documents that
follow one another; columns besides ``doc_id``, ``text`` and ``source`` are
ignored, whatever their names. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartula.llm.common import checkpoint, fresh, word_count

#: Share of all words that the mix has, and times that a document may be taken.
SHARE, EPOCHS = 1.5, 2
#: Source weights, repeating.
WEIGHTS = (5, 2, 1)
#: Rows that a window over one bucket of one source holds, about; bins of a range of virtual times.
BUCKET_ROWS, BINS = 20_000, 4096
#: Copies of the last range of times that are sorted and read one by one, at most.
SORTED = 10_000


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, epochs=EPOCHS) -> DataFrame:
    """source, source_size, n_rows, target from one row a source (source, source_size, n_rows).

    With sources in order of how soon they are full (cap / weight), the level at which
    the rest share what is left rises until the first that is not full and falls after
    it, so the final level is the largest. The windows run over one row a source, in one task:
    ten million sources are about a gigabyte, which windows spill.
    """
    level = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, rest = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    return (
        sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
        .withColumn("target", F.least("cap", F.max("level").over(everything) * F.col("weight")))
        .select("source", "source_size", "n_rows", "target", "budget")
    )


def timed(docs: DataFrame, weights=WEIGHTS, share=SHARE, epochs=EPOCHS) -> tuple[DataFrame, float]:
    """docs' doc_id, source, size, source_size, target and first (virtual finish time of the
    first copy; each further one comes source_size / target later), and the time of the cut.

    The order within a source is by the MD5 of the id, or of the text if that is null. Sums run over (source, bucket) first,
    then over the rows of a bucket, so that a source of any size is spread over many tasks.
    """
    slim = docs.select("doc_id", "source", word_count("text").alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")).cast("binary")).alias("h"))
    slim = checkpoint(slim)
    sources = checkpoint(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")), weights, share, epochs))
    most = sources.agg(F.max("n_rows")).first()[0] or 0
    digits = 1
    while 16**digits * BUCKET_ROWS < most and digits < 8:
        digits += 1
    keyed = slim.withColumn("b", F.substring("h", 1, digits))
    ahead = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy("source", "b").agg(F.sum("size").alias("s")).withColumn("ahead", F.coalesce(F.sum("s").over(ahead), F.lit(0))).drop("s")
    offsets = offsets.join(sources.drop("n_rows"), offsets["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    own = Window.partitionBy("source", "b").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = keyed.withColumn("cum", F.sum("size").over(own))
    rows = rows.join(offsets, rows["source"].eqNullSafe(offsets["source"]) & (rows["b"] == offsets["b"])).select(
        rows["doc_id"], rows["source"], "size", "source_size", "target", "budget", ((F.col("ahead") + F.col("cum")) / F.col("target")).alias("first")
    )
    rows = checkpoint(rows)
    return rows.drop("budget"), cut(rows, epochs)


def copies(rows: DataFrame, epochs: int) -> DataFrame:
    step = F.col("source_size") / F.col("target")
    return rows.select("size", "budget", F.explode(F.array(*[F.col("first") + k * step for k in range(epochs)])).alias("v")).where("size > 0")


def cut(rows: DataFrame, epochs: int) -> float:
    """The last virtual time at which what is sent so far is within the budget.

    The bins of a histogram say in which range of times the budget ends; that range gets bins
    of its own, and so on, until few copies are left to sort or their times can't be told apart.
    """
    sent = copies(rows, epochs)
    budget, low, high = (sent.agg(F.max("budget"), F.min("v"), F.max("v")).first() or (None, None, None))
    if budget is None:
        return -1.0
    spent, last = 0, -1.0  # what is sent before low, and when the last of it is
    while True:
        width = (high - low) / BINS
        inside = sent.where((F.col("v") >= low) & (F.col("v") <= high))
        exact = not width > 0 or low + width == low
        at = F.col("v") if exact else F.least(F.floor((F.col("v") - low) / width), F.lit(BINS - 1))
        bins = inside.groupBy(at.alias("bin")).agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.min("v").alias("first"), F.max("v").alias("last"))
        over = None
        for b in bins.orderBy("bin").toLocalIterator():
            if spent + b["s"] > budget:
                over = b
                break
            spent, last = spent + b["s"], b["last"]
        if over is None or exact or over["first"] == over["last"]:
            return float(last)
        low, high = over["first"], over["last"]
        if over["n"] <= SORTED:
            for r in sent.where((F.col("v") >= low) & (F.col("v") <= high)).groupBy("v").agg(F.sum("size").alias("s")).orderBy("v").collect():
                if spent + r["s"] > budget:
                    break
                spent, last = spent + r["s"], r["v"]
            return float(last)


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, epochs=EPOCHS) -> DataFrame:
    """doc_id, size, source_size, target, taken and n_copies of each document; see the module."""
    rows, last = timed(docs, weights, share, epochs)
    step = F.col("source_size") / F.col("target")
    n = sum((F.coalesce(F.col("first") + k * step <= F.lit(last), F.lit(False)).cast("int") for k in range(epochs)), F.lit(0))
    return rows.withColumn("n_copies", n).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).cast("long").alias("taken"), "n_copies")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share=SHARE, epochs=EPOCHS) -> DataFrame:
    """The rows of docs that the mix takes, as often as it takes them; docs' columns, in no order.

    Repeated ids share their decision: the most copies that any of them got.
    """
    id_, n, k = fresh(docs, "__id", "__n", "__k")
    chosen = mix(docs.select("doc_id", "text", "source"), weights, share, epochs).where("n_copies > 0").groupBy(F.col("doc_id").alias(id_)).agg(F.max("n_copies").alias(n))
    out = docs.join(chosen, F.col("doc_id").eqNullSafe(F.col(id_)))
    return out.withColumn(k, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, text, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source COLLATE "binary" ASC NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(rank % 3 + 1)::INT] AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
         - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.budget,
         CASE WHEN t.target > 0 THEN sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) / t.target END AS v0
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT size, budget, v0 AS v FROM r WHERE size > 0 UNION ALL SELECT size, budget, v0 + source_size / target FROM r WHERE size > 0),
q AS (SELECT v, budget, sum(size) OVER (ORDER BY v RANGE UNBOUNDED PRECEDING) AS total FROM c),
e AS (SELECT max(v) AS last FROM q WHERE total <= budget)
SELECT doc_id, size, source_size, target,
       (size * (coalesce(v0 <= last, false)::INT + coalesce(v0 + source_size / target <= last, false)::INT))::BIGINT AS taken
FROM r, e
"""
