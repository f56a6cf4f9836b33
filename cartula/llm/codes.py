"""Vector code compression: product codes whose nearest entries are found by annular norm pruning.

Components become whole numbers (``SCALE`` times the component, floored), vectors are cut
into ``PARTS`` equal parts, and each part is replaced by the number of the nearest entry of
its position's codebook. A codebook's entries are sorted by norm once. A part that has some
best distance so far can only be nearer to an entry whose norm differs from its own by no
more than that distance; binary search gives this annulus of the sorted entries, and only
entries in it, both ends included, are compared exactly. Entries are taken from the part's
own norm outwards, a few at a time, and the annulus is narrowed after each few.

Codebooks start as the parts of the vectors with the smallest ids. A round sends them out
(a few kB, whatever the input), assigns all parts where they are, and adds up what falls to
each entry: a vector of sums for each partition, merged in a tree of tasks.

Defined results: rows whose vector is null, empty, not a multiple of ``PARTS`` long, or has
null or non-finite components take no part; vectors of another length have codebooks of
their own; components beyond ``LARGEST`` count as that; null ids come last among the first
entries, ties are broken by the vector; with fewer rows than ``ENTRIES`` codebooks have as
many entries; repeated rows are coded alike; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartula.llm.common import checkpoint, merged, small_batches

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: The largest whole number of a component: distances stay below 2 ** 63.
LARGEST = 1 << 22
#: Entries compared on each side before the annulus is narrowed; parts compared at once; labels whose sums are broadcast.
FEW, TILE, LABELS = 6, 1 << 15, 100_000


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, x (whole numbers) of the rows that take part."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & (F.size("v") % PARTS == 0) & ~bad)
    whole = F.transform("v", lambda x: F.floor(F.greatest(F.least(x * SCALE, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("int"))
    return rows.select("vec_id", "label", whole.alias("x"))


class Codebooks:
    """entries: whole numbers [part, entry, position within the part]."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        norm = np.sqrt((self.entries**2).sum(axis=2))
        #: Of each part: the entries' numbers in the order of their norms, and those norms.
        self.order = np.argsort(norm, axis=1, kind="stable")
        self.norms = np.take_along_axis(norm, self.order, axis=1)
        self.compared = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and squared distances of whole vectors, both [row, part]; ties go to the smaller number."""
        parts = x.reshape(len(x), PARTS, -1)
        codes, errors = np.empty(parts.shape[:2], np.int64), np.empty(parts.shape[:2], np.int64)
        for at in range(0, len(x), TILE):
            for p in range(PARTS):
                best = self._annulus(parts[at : at + TILE, p], p)
                codes[at : at + TILE, p], errors[at : at + TILE, p] = best % ENTRIES, best // ENTRIES
        return codes, errors

    def _annulus(self, x: np.ndarray, p: int) -> np.ndarray:
        """For each part ENTRIES times the least squared distance, plus the number of the entry."""
        norms, order, own = self.norms[p], self.order[p], self.entries[p]
        r = np.sqrt((x * x).sum(axis=1))
        best = np.full(len(x), np.iinfo(np.int64).max)
        low = np.searchsorted(norms, r)  # entries from low to high - 1 have been compared
        high = low.copy()
        first, last = np.zeros(len(x), np.int64), np.full(len(x), len(norms))  # the annulus
        open_ = np.arange(len(x))
        reach = np.arange(1, FEW + 1)
        while len(open_):
            around = np.hstack([low[open_, None] - reach, high[open_, None] + reach - 1])
            inside = (around >= first[open_, None]) & (around < last[open_, None])
            entry = order[np.clip(around, 0, len(norms) - 1)]
            gap = x[open_, None, :] - own[entry]
            key = np.where(inside, (gap * gap).sum(axis=2) * ENTRIES + entry, np.iinfo(np.int64).max)
            self.compared += int(inside.sum())
            best[open_] = np.minimum(best[open_], key.min(axis=1))
            low[open_] -= FEW
            high[open_] += FEW
            width = np.sqrt(best[open_] // ENTRIES) + 1e-9 * (r[open_] + 1)
            first[open_] = np.searchsorted(norms, r[open_] - width, "left")
            last[open_] = np.searchsorted(norms, r[open_] + width, "right")
            open_ = open_[(first[open_] < low[open_]) | (last[open_] > high[open_])]
        return best

    def moved(self, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
        """Entries at the floored means of what fell to them; unused ones stay."""
        mean = sums // np.maximum(counts, 1)[:, :, None]
        return Codebooks(np.where(counts[:, :, None] > 0, mean, self.entries))

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def __reduce__(self):
        return Codebooks, (self.entries,)


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a batch, all of one length."""
    return np.asarray(column.flatten(), np.int64).reshape(len(column), -1)


def _sums(rows: DataFrame, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """Sums and numbers of the parts that fall to each entry."""
    shared, (parts, n, width) = rows.sparkSession.sparkContext.broadcast(books), books.entries.shape

    def run(batches):
        out = np.zeros((width + 1, parts * n), np.int64)
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0))
                at = (shared.value.nearest(x)[0] + np.arange(parts) * n).ravel()
                flat = x.reshape(-1, width)
                for j in range(width):
                    out[j] += np.bincount(at, flat[:, j], parts * n).astype(np.int64)
                out[width] += np.bincount(at, minlength=parts * n)
        yield pa.RecordBatch.from_arrays([pa.array([out.astype("<i8").tobytes()], pa.binary())], ["sums"])

    got = merged(rows.select("x").mapInArrow(run, "sums binary")).reshape(width + 1, parts, n)
    return np.moveaxis(got[:width], 0, 2), got[width]


def fit(rows: DataFrame, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of usable rows, all of one length."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(ENTRIES).select("x").collect()  # ENTRIES rows
    books = Codebooks(np.moveaxis(np.array([r["x"] for r in first]).reshape(len(first), PARTS, -1), 0, 1))
    for _ in range(rounds):
        books = books.moved(*_sums(rows, books))
    return books


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code (a byte for each part), error (the sum of the parts' squared distances) of usable rows."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    label = rows.schema["label"].dataType.simpleString()
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            if b.num_rows:
                codes, errors = shared.value.nearest(_matrix(b.column("x")))
                packed = codes.astype(np.uint8).tobytes()
                code = pa.array([packed[k : k + PARTS] for k in range(0, len(packed), PARTS)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), code, pa.array(errors.sum(axis=1))], ["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, f"vec_id {kind}, label {label}, code binary, error long")


def decode(coded: DataFrame, books: Codebooks) -> DataFrame:
    """coded with vec, the vector that the code (a byte for each part) stands for."""
    flat = F.array(*(F.lit(x / SCALE) for x in books.entries.ravel().tolist()))
    n, width = books.entries.shape[1:]
    digit = lambda p: F.conv(F.hex(F.substring("code", p + 1, 1)), 16, 10).cast("int")
    return coded.withColumn("__all", flat).withColumn("vec", F.concat(*(F.slice("__all", (F.lit(p * n) + digit(p)) * width + 1, width) for p in range(PARTS)))).drop("__all")


def digest(vectors: DataFrame) -> DataFrame:
    """vec_id, code (hexadecimal), error, label_error, codebooks_sha256 of each row that takes part."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = checkpoint(usable(vectors))
    out = spark.createDataFrame([], f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, code binary, error long, codebooks_sha256 string")
    for (size,) in rows.select(F.size("x").alias("n")).distinct().orderBy("n").collect():  # a row for each length
        own = rows.where(F.size("x") == size)
        books = fit(own)
        out = out.unionByName(encode(own, books).withColumn("codebooks_sha256", F.lit(books.sha256())))
    out = checkpoint(out)
    totals = checkpoint(out.groupBy("label").agg(F.sum("error").alias("label_error")))
    totals = totals.withColumnRenamed("label", "__label")
    if totals.count() <= LABELS:
        totals = F.broadcast(totals)  # two numbers for each of so many labels at most; else joined by shuffles, whose hot labels Spark splits
    both = out.join(totals, F.col("label").eqNullSafe(F.col("__label")), "left")
    return both.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", "codebooks_sha256")


def _sql() -> str:
    finite = "embedding IS NOT NULL AND len(embedding) > 0 AND len(embedding) % 16 = 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0"
    out = [
        f"k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda v: floor({SCALE} * v::DOUBLE)::BIGINT) AS x, len(embedding) // {PARTS} AS d FROM embeddings WHERE {finite})",
        f"p AS MATERIALIZED (SELECT r, vec_id, p, x[p * d + 1:p * d + d] AS x FROM k, range(0, {PARTS}) t(p))",
        f"c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT {ENTRIES}))",
    ]
    for t in range(ROUNDS + 1):
        out.append(f"a{t} AS MATERIALIZED (SELECT r, p.p AS p, min(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT * {ENTRIES} + e) AS b FROM p JOIN c{t} USING (p) GROUP BY r, p.p)")
        if t < ROUNDS:
            out.append(f"s{t} AS (SELECT p, e, list(m ORDER BY j) AS c FROM (SELECT p.p AS p, b % {ENTRIES} AS e, j, floor(sum(x[j]) / count(*))::BIGINT AS m FROM p JOIN a{t} USING (r, p), range(1, len(x) + 1) t(j) GROUP BY p.p, b % {ENTRIES}, j) GROUP BY p, e)")
            out.append(f"c{t + 1} AS MATERIALIZED (SELECT p, e, coalesce(s{t}.c, c{t}.c) AS c FROM c{t} LEFT JOIN s{t} USING (p, e))")
    last = f"a{ROUNDS}"
    out.append(f"f AS MATERIALIZED (SELECT r, string_agg(printf('%02x', b % {ENTRIES}), '' ORDER BY p) AS code, sum(b // {ENTRIES})::BIGINT AS error FROM {last} GROUP BY r)")
    books = f"(SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM c{ROUNDS})"
    return f"WITH {', '.join(out)} SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, {books} AS codebooks_sha256 FROM k JOIN f USING (r)"


SQL = _sql()
