"""Importance resampling towards a target distribution, in two passes of Arrow batches.

A text's features are its words and its pairs of neighbouring words, hashed into
``BUCKETS`` buckets. The first pass counts them: each partition of the documents and of
the target gives one vector of bucket counts (``np.bincount``), and a tree of tasks adds
them up. From the two vectors each bucket's gain is known, the logarithm of how much more
frequent it is in the target. The second pass gathers the gains, which were sent to all
executors (80 kB, whatever the input), and sums them by document (``np.bincount`` with
weights); their mean is the document's weight. Weights disturbed by Gumbel noise from a
hash of the id are ranked, so that the best are a draw without replacement in proportion
to the exponential of the weight, and the same draw each time.

Words are found on the bytes of a whole batch at once, and hashed a position at a time;
the checksum of a pair follows from those of its words, as appending bytes is linear in it.

Defined results: a null or wordless text has no features, weight 0, and is not drawn;
texts with fewer words than ``LEAST`` are not drawn; without documents or target the
counts are zero; a null id draws its noise as an empty one and comes last among equals;
repeated rows are ranked one by one; an empty table gives an empty result; further columns
are ignored (``drawn`` keeps them).
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartula.llm.common import checkpoint, fresh, merged, ranked, small_batches, text_bytes

#: Buckets of features; words a drawn document has at least; per cent that are drawn; seed of the noise.
BUCKETS, LEAST, SHARE, SEED = 10_000, 20, 25, 7
#: Words hashed at once; bytes of words that are hashed in step, longer ones go one by one.
STEP, LONG = 1 << 18, 64


def _byte_table() -> np.ndarray:
    """What one byte makes of a checksum, of the usual polynomial with its bits in reverse."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1).astype(np.uint32)
    return out


_BYTE = _byte_table()


def _shift_tables() -> np.ndarray:
    """[n, k, b]: what n further zero bytes make of byte b at place k of a checksum."""
    at = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    out = [at]
    for _ in range(LONG):
        out.append(_BYTE[out[-1] & 255] ^ (out[-1] >> 8))
    return np.array(out, np.uint32)


_SHIFT = _shift_tables()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def word_bounds(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased bytes of texts that begin at cuts: where each word begins and ends, and its text's place."""
    inside = _IN_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[cuts] = True
    joined = inside[1:] & inside[:-1] & ~edge[1:-1] if len(data) else inside
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~joined
    last[:-1] &= ~joined
    begins, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begins, ends, np.searchsorted(cuts, begins, "right") - 1


def checksums(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each word."""
    sizes = ends - begins
    order = np.argsort(-np.minimum(sizes, LONG + 1).astype(np.int8), kind="stable")
    at, own = begins[order], sizes[order]
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    far = int(np.count_nonzero(own > LONG))
    left = np.searchsorted(-own[far:], -np.arange(1, LONG + 1), "right") + far  # words of n bytes at least
    for k in range(LONG):
        if left[k] == far:
            break
        c = crc[far : left[k]]
        crc[far : left[k]] = _BYTE[(c ^ data[at[far : left[k]] + k]) & 255] ^ (c >> 8)
    crc ^= np.uint32(0xFFFFFFFF)
    for k in range(far):
        crc[k] = zlib.crc32(data[at[k] : at[k] + own[k]])
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _appended(crc: np.ndarray, more: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Checksums of what had crc, with words of up to LONG bytes appended that have the checksums more."""
    t = _SHIFT
    return t[sizes, 0, crc & 255] ^ t[sizes, 1, (crc >> 8) & 255] ^ t[sizes, 2, (crc >> 16) & 255] ^ t[sizes, 3, crc >> 24] ^ more


_BLANK = zlib.crc32(b" ")


def features(texts: pa.Array):
    """The buckets of all features of a column of texts, in pieces: places of texts, buckets, and how many of the first are words."""
    data, cuts = text_bytes(texts)
    data = _LOWER[data]
    begins, ends, text = word_bounds(data, cuts)
    for at in range(0, len(begins), STEP):
        own = slice(max(0, at - 1), at + STEP)  # the last word of the piece before begins the first pair
        b, e, t = begins[own], ends[own], text[own]
        crc = checksums(data, b, e)
        second = np.flatnonzero(t[1:] == t[:-1]) + 1
        sizes = np.minimum(e - b, LONG)
        led = _appended(crc[second - 1], np.uint32(_BLANK), np.ones(len(second), np.int64))
        pair = _appended(led, crc[second], sizes[second])
        for k in np.flatnonzero((e - b)[second] > LONG).tolist():
            pair[k] = zlib.crc32(data[b[second[k]] : e[second[k]]], int(led[k]))
        new = 1 if at else 0
        yield np.concatenate([t[new:], t[second]]), np.concatenate([crc[new:], pair]) % np.uint32(BUCKETS), len(t) - new


def counts(texts: DataFrame) -> np.ndarray:
    """How many features of all texts (text) fall into each bucket."""
    small_batches(texts.sparkSession)

    def run(batches):
        out = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for _, bucket, _ in features(b.column(0)):
                out += np.bincount(bucket, minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([out.astype("<i8").tobytes()], pa.binary())], ["n"])

    got = merged(texts.select("text").mapInArrow(run, "n binary"))
    return np.zeros(BUCKETS, np.int64) if got is None else got


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much more frequent each bucket is in the target, one being added to each count; whole numbers."""
    s, t = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((b + 1) * s / ((a + 1) * t))) for a, b in zip(source.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, seed: int = SEED, names: tuple = ("n_words", "n_features", "weight", "score")) -> DataFrame:
    """docs (doc_id, text and others) with the four columns of names, which docs don't have."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(gain.astype(float))
    n_words, n_features, weight, score = names
    place = docs.columns.index("text")

    def run(batches):
        for b in batches:
            words, every, total = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for text, bucket, n in features(b.column(place)):
                words += np.bincount(text[:n], minlength=b.num_rows)
                every += np.bincount(text, minlength=b.num_rows)
                total += np.bincount(text, shared.value[bucket], b.num_rows).astype(np.int64)
            mean = np.where(every > 0, total // np.maximum(every, 1), 0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-3], *map(pa.array, (words, every, mean))], schema=b.schema)

    out = docs.withColumns({c: F.lit(None).cast("long") for c in names[:3]})
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return out.mapInArrow(run, out.schema).withColumn(score, F.col(weight) + noise)


def _order(id_: str = "doc_id", score: str = "score") -> list:
    return [F.desc(score), F.asc_nulls_last(id_)]


def _numbered(rows: DataFrame, share: int) -> DataFrame:
    """rank (from 1) of the drawn rows of doc_id, n_words, n_features, weight, score; null for the others."""
    able = ranked(rows.where(F.col("n_words") >= LEAST), [*_order(), "weight", "n_features"])
    drawn = F.col("__rank") < F.expr(f"{share} * __total div 100")
    able = able.withColumn("rank", F.when(drawn, F.col("__rank") + 1).cast("long")).drop("__rank", "__total")
    return able.unionByName(rows.where(F.col("n_words") < LEAST).withColumn("rank", F.lit(None).cast("long")))


def digest(docs: DataFrame, target: DataFrame, share: int = SHARE, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each document: its place in the draw towards the target's texts."""
    rows = weighed(docs.select("doc_id", "text"), gains(counts(docs), counts(target)), seed)
    return _numbered(checkpoint(rows.drop("text")), share).select("doc_id", "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, target: DataFrame, share: int = SHARE, seed: int = SEED) -> DataFrame:
    """The documents that are drawn, with all their columns.

    Texts are not shuffled: the last place of the draw is found on numbers alone, and texts are
    weighed again up to it. Rows that equal the last one in score and id are drawn with it.
    """
    gain = gains(counts(docs), counts(target))
    rows = checkpoint(weighed(docs.select("doc_id", "text"), gain, seed).drop("text"))
    last = _numbered(rows, share).where("rank is not null").orderBy(F.desc("rank")).select("score", "doc_id").limit(1).collect()
    if not last:
        return docs.limit(0)
    names = fresh(docs, "n_words", "n_features", "weight", "score")
    n_words, score, id_ = F.col(names[0]), F.col(names[3]), F.col("doc_id")
    tie = F.lit(True) if last[0]["doc_id"] is None else id_ <= last[0]["doc_id"]
    taken = (n_words >= LEAST) & ((score > last[0]["score"]) | ((score == last[0]["score"]) & tie))
    return weighed(docs, gain, seed, tuple(names)).where(taken).select(*docs.columns)


_SQL_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
#: Checksums by a fold over the bytes, with the same table of bytes.
SQL = f"""
WITH c AS (SELECT {[int(x) for x in _BYTE]}::BIGINT[] AS c),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents),
b AS MATERIALIZED (SELECT {_SQL_WORDS} AS w FROM benchmark),
fd AS MATERIALIZED (SELECT r, f, count(*) AS n FROM (SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d) GROUP BY r, f),
fb AS MATERIALIZED (SELECT f, count(*) AS n FROM (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM b) GROUP BY f),
h AS MATERIALIZED (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM fd UNION SELECT f FROM fb)),
k AS MATERIALIZED (SELECT f, xor(list_reduce(list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT), lambda s, y: xor(s >> 8, c[(xor(s, y) & 255) + 1]), 4294967295::BIGINT), 4294967295) % {BUCKETS} AS k FROM h, c),
s AS (SELECT k, sum(n) AS s FROM fd JOIN k USING (f) GROUP BY k), t AS (SELECT k, sum(n) AS t FROM fb JOIN k USING (f) GROUP BY k),
g AS (SELECT k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM fd) + {BUCKETS}) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM fb) + {BUCKETS}))))::BIGINT AS g FROM s FULL JOIN t USING (k)),
w AS (SELECT r, sum(n)::BIGINT AS n_features, floor(sum(n * g) / sum(n))::BIGINT AS weight FROM fd JOIN k USING (f) JOIN g USING (k) GROUP BY r),
o AS (SELECT r, doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN w USING (r)),
p AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, weight, n_features) AS rank, count(*) OVER () AS n FROM o WHERE n_words >= {LEAST})
SELECT doc_id, n_features, weight, score::BIGINT AS score, CASE WHEN rank <= {SHARE} * n // 100 THEN rank END AS rank FROM o LEFT JOIN p USING (r)
"""
