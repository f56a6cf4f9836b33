"""Substring deduplication by level-wise doubling.

Windows of ``WINDOW`` words that two documents have are extended to windows of twice the
length, those that still repeat to twice that, and so on, until no candidates survive. At
each level the windows come in stretches: neighbours whose least hashed short window (half
as long; ``FIRST`` words at the first level) is the same, which equal stretches share. Only
stretches whose short window another document has are looked at; those that are equal as
wholes are settled at once, by 96 bits of hashes of all their words, and the windows of the
others are compared one by one, by two 64-bit hashes each. What survives a level is, in
each document, runs of words all of whose windows repeat; of runs that are equal as wholes
one goes on, as that of the others is as long as it gets.

A word is removed if a window of ``WINDOW`` words that covers it also starts in a document
with a smaller id; longer windows that repeat consist of such. ``longest`` is the length of
the longest window, of all levels, that a document shares with one of a smaller id.

Windows are judged on the input. Defined results: a null text has no words; a text
shorter than the window keeps all; rows with a null id never are the smaller one and
lose what any row with an id has; ids are under 2 ** 63 - 2 ** 41; rows that repeat an id are the same document for that
comparison and so don't remove each other's words; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartula.llm.common import checkpoint, collect_garbage, discard, small_batches, stored

#: Stands for a null id: larger than any. (Ids are under 2 ** 63 - 2 ** 41.)
_LAST = (1 << 63) - (1 << 41)
#: Words of a window, and of the short windows of the first level.
WINDOW, FIRST = 13, 7

_ODD = np.uint64(0x9E3779B97F4A7C15)
_TWO = np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, length: int, factor: np.uint64 = _ODD) -> np.ndarray:
    """A hash of each run of so many words, by doubling: powers of two are joined as length says."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out, done, power, size = None, 0, _mixed(words * factor), 1
        while size <= length:
            if length & size:
                own = power[done : done + n]
                out = own if out is None else _mixed(out * factor + own)
                done += size
            if size * 2 <= length:
                power = _mixed(power[:-size] * factor + power[size:])
            size *= 2
    return out[:n]


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of so many."""
    size = 1
    while size * 2 <= width:
        x, size = np.minimum(x[:-size], x[size:]), size * 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :])


class Stretches:
    """Stretches of the windows of many rows; words of all rows, and offsets of the rows in them.

    Of each stretch: key, row, at (its first window, as a place in words) and span (its
    windows); whole() hashes all its words: its first and last window cover them.
    """

    def __init__(self, words: np.ndarray, offsets: np.ndarray, length: int, short: int):
        self.words, self.length = words, length
        n = np.maximum(np.diff(offsets) - length + 1, 0)
        total = int(n.sum())
        firsts = np.cumsum(n) - n
        #: Windows that lie within their row, and its row.
        self.window_row = np.repeat(np.arange(len(n)), n)
        self.window = (offsets[:-1] - firsts)[self.window_row] + np.arange(total)
        if not total:
            self.key, self.row, self.at, self.span, self.lo = np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(4))
            return
        width = length - short + 1
        least = sliding_least(window_hashes(words, short), width)[self.window]
        start = np.r_[True, least[1:] != least[:-1]]
        start[firsts[n > 0]] = True
        runs = np.flatnonzero(start)
        start |= (np.arange(total) - np.repeat(runs, np.diff(np.r_[runs, total]))) % width == 0
        self.lo = np.flatnonzero(start)
        self.key, self.row, self.at, self.span = least[self.lo], self.window_row[self.lo], self.window[self.lo], np.diff(np.r_[self.lo, total])

    def whole(self, factor: np.uint64 = _ODD) -> np.ndarray:
        h = window_hashes(self.words, self.length, factor)
        with np.errstate(over="ignore"):
            return _mixed(h[self.at] * factor + _mixed(h[self.at + self.span - 1] * _TWO + self.span.astype(np.uint64))) if len(self.at) else self.key

    def windows_of(self, chosen: np.ndarray) -> np.ndarray:
        """Which windows, as places in window, are of the chosen stretches (a mask)."""
        return np.repeat(chosen, self.span)


def _member(values: np.ndarray, rows: np.ndarray, lists: pa.ListArray) -> np.ndarray:
    """Whether each value is in the list of its row."""
    size = np.asarray(lists.value_lengths().fill_null(0))
    given = np.asarray(lists.flatten()).astype(np.int64).view(np.uint64)
    if not len(given) or not len(values):
        return np.zeros(len(values), bool)
    with np.errstate(over="ignore"):
        own = _mixed(values + (rows + 1).astype(np.uint64) * _ODD)
        asked = _mixed(given + (np.repeat(np.arange(len(size)), size) + 1).astype(np.uint64) * _ODD)
    return np.isin(own, asked)


def _list(batch: pa.RecordBatch, name: str) -> pa.ListArray:
    return batch.column(name).cast(pa.list_(pa.int64()))


def _split(texts: list[bytes | None]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, and hashes and offsets of all."""
    split = [t.split() if t else [] for t in texts]
    offsets = np.r_[0, np.cumsum([len(w) for w in split], dtype=np.int64)]
    return split, np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(split)), np.uint64, offsets[-1]), offsets


def _words(batch: pa.RecordBatch, hashed: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and offsets of the words of a batch's texts, or of its runs, which are hashes already."""
    rows = batch.column("t").to_pylist()
    if not hashed:
        return _split(rows)[1:]
    return np.frombuffer(b"".join(rows), np.uint64), np.r_[0, np.cumsum([len(r) // 8 for r in rows], dtype=np.int64)]


def _signed(*columns: np.ndarray) -> list[pa.Array]:
    return [pa.array(c if c.dtype == np.int64 else c.view(np.int64)) for c in columns]


def _keys(length: int, short: int, hashed: bool):
    """key of each stretch, and id of its row."""

    def run(batches):
        for b in batches:
            s = Stretches(*_words(b, hashed), length, short)
            yield pa.RecordBatch.from_arrays(_signed(s.key, np.minimum(np.asarray(b.column("rid")), _LAST)[s.row]), ["key", "id"])

    return run


def _wholes(length: int, short: int, hashed: bool):
    """key, whole, other (hashes of all words, of 64 and 32 bits) and rid of each stretch."""

    def run(batches):
        for b in batches:
            s = Stretches(*_words(b, hashed), length, short)
            other = pa.array((s.whole(_TWO) >> np.uint64(33)).astype(np.int32))
            key, whole, rid = _signed(s.key, s.whole(), np.asarray(b.column("rid"))[s.row])
            yield pa.RecordBatch.from_arrays([key, whole, other, rid], ["key", "whole", "other", "rid"])

    return run


def _windows(length: int, short: int, hashed: bool):
    """rid and the two hashes of each window of a row's wanted stretches."""

    def run(batches):
        for b in batches:
            words, offsets = _words(b, hashed)
            s = Stretches(words, offsets, length, short)
            chosen = s.windows_of(_member(s.whole(), s.row, _list(b, "wanted")))
            at, row = s.window[chosen], s.window_row[chosen]
            h1, h2 = window_hashes(words, length), window_hashes(words, length, _TWO)
            made = _signed(np.asarray(b.column("rid"))[row], *((h1[at], h2[at]) if len(at) else (h1[:0], h2[:0])))
            yield pa.RecordBatch.from_arrays(made, ["rid", "h1", "h2"])

    return run


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, t (the text) and rid: the id or, without one, a number by the text from _LAST on."""
    small_batches(docs.sparkSession)
    without = F.lit(_LAST) + F.pmod(F.xxhash64("text"), F.lit(1 << 40))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("t"), F.coalesce(F.col("doc_id").cast("long"), without).alias("rid"))


def _id() -> F.Column:
    """The id by which rows are compared: rows without one are one, the last."""
    return F.least("rid", F.lit(_LAST))


def repeated(rows: DataFrame, length: int = WINDOW, short: int = FIRST, hashed: bool = False) -> DataFrame:
    """rid and the hashes of what other documents have of its windows: whole stretches (``shared``; ``lost`` if a smaller id
    has them) and single windows (``shared_w``, ``lost_w``).

    What repeats is found by partial sums (the least and the largest id of a hash), so a passage
    that any number of documents share is one row a task; the sums are written before they are
    joined back, so that the join can split a hot hash. Of equal stretches only the one of the
    smallest id is compared by windows. Stretches are cut twice from the texts rather than stored,
    as they take more room than the texts.
    """
    rows = rows.select("rid", "t")
    keys = rows.mapInArrow(_keys(length, short, hashed), "key long, id long")
    twice = checkpoint(keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key"))
    alive = stored(rows.mapInArrow(_wholes(length, short, hashed), "key long, whole long, other int, rid long").join(twice, "key", "left_semi"))
    collect_garbage(rows.sparkSession)
    owners = stored(alive.groupBy("key", "whole", "other").agg(F.min(_id()).alias("owner"), F.max(_id()).alias("last")))
    unlike = owners.groupBy("key").agg(F.count("*").alias("n"), F.min("owner").alias("lo"), F.max("owner").alias("hi")).where("n > 1 and lo < hi")
    unlike = checkpoint(unlike.select("key", F.lit(True).alias("unlike")))
    judged = owners.join(unlike, "key", "left").where("unlike or owner < last").select("whole", "other", "owner", (F.col("owner") < F.col("last")).alias("both"), "unlike")
    told = alive.drop("key").join(checkpoint(judged), ["whole", "other"])
    of = lambda condition, name: F.collect_set(F.when(condition, F.col("whole"))).alias(name)
    whole = told.groupBy("rid").agg(of(F.col("both"), "shared"), of(_id() > F.col("owner"), "lost"), of(F.col("unlike") & (_id() == F.col("owner")), "wanted"))
    whole = stored(whole)
    discard(alive, owners)
    collect_garbage(rows.sparkSession)
    wanted = whole.where(F.size("wanted") > 0).select("rid", "wanted")
    windows = stored(rows.join(wanted, "rid").mapInArrow(_windows(length, short, hashed), "rid long, h1 long, h2 long"))
    least = checkpoint(windows.groupBy("h1", "h2").agg(F.min(_id()).alias("lo"), F.max(_id()).alias("hi")).where("lo < hi").drop("hi"))
    part = windows.join(least, ["h1", "h2"]).groupBy("rid").agg(F.collect_set("h1").alias("shared_w"), F.collect_set(F.when(_id() > F.col("lo"), F.col("h1"))).alias("lost_w"))
    out = stored(whole.drop("wanted").join(part, "rid", "full"))
    discard(whole, windows)
    collect_garbage(rows.sparkSession)
    return out


def _covered(s: Stretches, batch: pa.RecordBatch, whole: str, windows: str) -> np.ndarray:
    """Windows, as places in s.window, that are marked (a mask)."""
    out = s.windows_of(_member(s.whole(), s.row, _list(batch, whole))) if len(s.row) else np.zeros(0, bool)
    if len(s.window):
        out |= _member(window_hashes(s.words, s.length)[s.window], s.window_row, _list(batch, windows))
    return out


def _spread(s: Stretches, windows: np.ndarray) -> np.ndarray:
    """Words that the windows cover (a mask)."""
    change = np.zeros(len(s.words) + 1, np.int64)
    np.add.at(change, s.window[windows], 1)
    np.add.at(change, s.window[windows] + s.length, -1)
    return np.cumsum(change[:-1]) > 0


def _runs(s: Stretches, windows: np.ndarray, n_rows: int) -> list[list[bytes]]:
    """For each row the runs of words, of twice the length at least, all of whose windows are marked."""
    out: list[list[bytes]] = [[] for _ in range(n_rows)]
    at, row = s.window[windows], s.window_row[windows]
    if len(at):
        cuts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1]), True])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if b - a > s.length:
                out[row[a]].append(s.words[at[a] : at[b - 1] + s.length].tobytes())
    return out


_KEPT = "doc_id long, rid long, n_words long, n_removed long, kept_sha256 string, kept binary, lost boolean, runs array<binary>"


def _kept(with_text: bool):
    """What stays of each row, and the runs that go to the next level."""

    def run(batches):
        for b in batches:
            split, words, offsets = _split(b.column("t").to_pylist())
            s = Stretches(words, offsets, WINDOW, FIRST)
            gone = _spread(s, _covered(s, b, "lost", "lost_w"))
            removed = np.diff(np.r_[0, np.cumsum(gone)][offsets])
            kept = [b" ".join(w if not n else compress(w, (~gone[x:y]).tolist())) for w, n, x, y in zip(split, removed.tolist(), offsets[:-1].tolist(), offsets[1:].tolist())]
            runs = _runs(s, _covered(s, b, "shared", "shared_w"), b.num_rows)
            made = [pa.array(np.diff(offsets)), pa.array(removed), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array(kept if with_text else [None] * len(kept), pa.binary())]
            made += [pa.array(removed > 0), pa.array(runs, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("doc_id", "rid")), *made], [c.split()[0] for c in _KEPT.split(", ")])

    return run


def _next_runs(length: int, short: int):
    """rid, lost (whether a smaller id has any window), runs of each run."""

    def run(batches):
        for b in batches:
            words, offsets = _words(b, True)
            s = Stretches(words, offsets, length, short)
            lost = np.zeros(b.num_rows, bool)
            lost[s.window_row[_covered(s, b, "lost", "lost_w")]] = True
            made = [pa.array(lost), pa.array(_runs(s, _covered(s, b, "shared", "shared_w"), b.num_rows), pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays([b.column("rid"), *made], ["rid", "lost", "runs"])

    return run


def longest(first: DataFrame, window: int = WINDOW) -> DataFrame:
    """rid and longest, from the rows of the first level: the length of the longest window that a smaller id has too.

    A run that a smaller id has as a whole is as long as it gets: only the run of the smallest
    id goes on, to be held against other runs.
    """
    reached, length = first.where("lost").select("rid", F.lit(window).cast("long").alias("n")), window
    level = first
    while True:
        runs = level.select("rid", F.explode("runs").alias("t")).withColumn("h", F.xxhash64("t")).withColumn("g", F.xxhash64(F.lit(1), "t"))
        runs = stored(runs)
        if runs.isEmpty():
            break
        own = checkpoint(runs.groupBy("h", "g").agg(F.min(_id()).alias("owner")))
        told = runs.join(own, ["h", "g"])
        doubled = F.pow(F.lit(2.0), F.floor(F.log2(F.octet_length("t") / F.lit(8.0 * window)) + 1e-9))
        settled = told.where(_id() > F.col("owner")).select("rid", (window * doubled).cast("long").alias("n"))
        length, short = length * 2, length
        rows = stored(told.where(_id() == F.col("owner")).dropDuplicates(["h", "g"]).select("rid", "t"))
        marks = repeated(rows, length, short, hashed=True)
        level = rows.join(marks, "rid").select("rid", "t", "shared", "lost", "shared_w", "lost_w")
        level = checkpoint(level.mapInArrow(_next_runs(length, short), "rid long, lost boolean, runs array<binary>"))
        discard(rows, marks)
        reached = checkpoint(reached.unionByName(settled).unionByName(level.where("lost").select("rid", F.lit(length).cast("long").alias("n"))).groupBy("rid").agg(F.max("n").alias("n")))
        discard(runs)
    return reached.groupBy("rid").agg(F.max("n").alias("longest"))


def dedup(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the words that stay, joined by spaces; null without text) and longest of each row."""
    rows = numbered(docs)
    marked = rows.join(repeated(rows), "rid", "left").select("doc_id", "rid", "t", "shared", "lost", "shared_w", "lost_w")
    first = stored(marked.mapInArrow(_kept(with_text), _KEPT))
    out = first.join(longest(first), "rid", "left")
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", F.col("kept").cast("string").alias("kept"), F.coalesce("longest", F.lit(0)).cast("long").alias("longest"))


def digest(docs: DataFrame) -> DataFrame:
    return dedup(docs, with_text=False).drop("kept")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
r AS (SELECT doc_id, 13 AS n, list_transform(range(1, len(w) - 11), lambda i: md5(array_to_string(w[i:i + 12], ' '))) AS k FROM d WHERE len(w) >= 13
  UNION ALL SELECT doc_id, 2 * n, list_transform(range(1, len(k) - n + 1), lambda i: md5(k[i] || k[i + n])) FROM r WHERE len(k) > n),
p AS (SELECT doc_id, n, unnest(k) AS k, generate_subscripts(k, 1) AS i FROM r),
f AS (SELECT n, k, min(doc_id) AS first FROM p GROUP BY n, k),
x AS (SELECT doc_id, i, n FROM p JOIN f USING (n, k) WHERE first < doc_id),
c AS (SELECT doc_id, list(DISTINCT i + j) AS gone FROM x, range(0, 13) r(j) WHERE n = 13 GROUP BY doc_id),
m AS (SELECT doc_id, max(n) AS longest FROM x GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)), ' ')) AS kept_sha256,
  coalesce(longest, 0)::BIGINT AS longest
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""
