"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every run of words of every test item. A document's words are
streamed through it; at each word it knows the longest match that ends there. Where
that is at least a window long, the window's words are hit, and the state says which
items contain them. Words that no item has reset the automaton, so a stretch of
known words shorter than the shortest window is passed over.

Defined results: a null or wordless text has no words and no hits; an item without
words is none; items with null ids are named ``null`` in lists; repeated rows give
repeated results; a benchmark without items finds nothing; an empty table of documents
gives an empty result; further columns are kept by ``clean`` and ignored by ``report``.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartula.llm.common import checkpoint, fresh, small_batches

#: Words of a window; a shorter item is one window.
WINDOW = 13
#: Share of hit words, as one in so many, from which a document is contaminated.
ONE_IN = 20
#: Words of test items in one automaton, which is sent to all executors (about 300 bytes a word).
#: A larger benchmark is cut into several automata, used one after another.
AUTOMATON_WORDS = 300_000

#: Bytes outside of words become spaces, and A-Z lower case: 0-9, a-z and all above ASCII are words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class Automaton:
    """Generalised suffix automaton of word sequences, with the items of each state."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window, self.names = window, [name for name, _ in items]
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [[self.words.setdefault(w, len(self.words)) for w in words] for _, words in items]
        for ids in coded:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.items: list[set[int]] = [set() for _ in self.next]
        whole: dict[int, list[tuple[int, int]]] = {}
        for k, ids in enumerate(coded):
            at = 0
            for c in ids:
                at = self.next[at][c]
                up = at
                while up > 0 and k not in self.items[up]:
                    self.items[up].add(k)
                    up = self.link[up]
            if 0 < len(ids) < window:
                whole.setdefault(at, []).append((len(ids), k))
        #: For each state the short items that end where it ends.
        self.short: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.short[s] = self.short[self.link[s]] + whole.get(s, [])
        self.least = min([len(ids) if len(ids) < window else window for ids in coded if ids], default=0)

    def _extend(self, last: int, c: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        if c in nexts[last]:
            q = nexts[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        new = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return new

    def _split(self, p: int, c: int, q: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Stretches [from, to) of words that windows hit, disjoint and in order, and the items."""
        least, known = self.least, self.words.get
        found: list[tuple[int, int]] = []
        items: set[int] = set()
        if not least or len(words) < least:
            return found, items
        ids = [known(w, -1) for w in words]
        # A stretch of at least so many known words has one at each multiple of that number.
        n, done = len(ids), 0
        for probe in range(least - 1, n, least):
            if probe < done or ids[probe] < 0:
                continue
            lo = probe
            while lo > done and ids[lo - 1] >= 0:
                lo -= 1
            hi = probe + 1
            while hi < n and ids[hi] >= 0:
                hi += 1
            done = hi
            if hi - lo >= least:
                self._stream(ids, lo, hi, found, items)
        return found, items

    def _stream(self, ids, lo, hi, found, items) -> None:
        nexts, link, length, window = self.next, self.link, self.length, self.window
        state = matched = 0
        for i in range(lo, hi):
            c = ids[i]
            while c not in nexts[state] and state:
                state = link[state]
                matched = length[state]
            if c in nexts[state]:
                state = nexts[state][c]
                matched += 1
            start = i + 1
            if matched >= window:
                at = state
                while length[link[at]] >= window:
                    at = link[at]
                items |= self.items[at]
                start = i + 1 - window
            for size, k in self.short[state]:
                if size <= matched:
                    items.add(k)
                    start = min(start, i + 1 - size)
            if start <= i:
                while found and found[-1][1] >= start:
                    start = min(start, found.pop()[0])
                found.append((start, i + 1))


def automata(benchmark: DataFrame, window: int = WINDOW, words: int = AUTOMATON_WORDS):
    """Automata of the items (item_id, text), each of about so many words at most.

    Items stream to the driver; what is alive at any time is one automaton's worth.
    """
    group, size = [], 0
    for r in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("k"), F.col("text").cast("binary").alias("t")).orderBy("k", "t").toLocalIterator():
        own = words_of(bytes(r["t"]) if r["t"] is not None else None)
        if not own:
            continue
        if group and size + len(own) > words:
            yield Automaton(group, window)
            group, size = [], 0
        group.append((r["k"], own))
        size += len(own)
    if group:
        yield Automaton(group, window)


def _joined(a, b):
    out: list[tuple[int, int]] = []
    for lo, hi in sorted([*a, *b]):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


_STATE = pa.struct([("n", pa.int64()), ("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])
_STATE_SQL = "struct<n:bigint,spans:array<int>,items:array<string>>"


def _pass(shared, text_at: str, state_at: str):
    def run(batches):
        automaton = shared.value
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            before = batch.column(state_at).to_pylist()
            out = []
            for text, old in zip(texts, before):
                words = words_of(text)
                spans, items = automaton.find(words) if automaton else ([], set())
                names = {automaton.names[k] for k in items} if items else set()
                if old is not None:
                    spans = _joined(zip(old["spans"][::2], old["spans"][1::2]), spans)
                    names |= set(old["items"])
                out.append({"n": len(words), "spans": [x for s in spans for x in s], "items": sorted(names)})
            at = batch.schema.get_field_index(state_at)
            yield batch.set_column(at, pa.field(state_at, _STATE), pa.array(out, _STATE))

    return run


def matched(docs: DataFrame, benchmark: DataFrame, name: str, window: int = WINDOW, words: int = AUTOMATON_WORDS) -> DataFrame:
    """docs with a column of that name: number of words, hit stretches (from, to, from, to ...) and items, one row a row.

    Each automaton is one more pass over the rows, in place: nothing is shuffled. Before a further
    one is sent out, the rows so far are checkpointed and the last one is taken back, so that one
    is alive at a time, whatever the size of the benchmark.
    """
    spark = docs.sparkSession
    small_batches(spark)
    (text,) = fresh(docs, "__text")
    rows = docs.withColumn(text, F.col("text").cast("binary")).withColumn(name, F.lit(None).cast(_STATE_SQL))
    out, shared = rows, None
    for automaton in automata(benchmark, window, words):
        if shared is not None:
            out = checkpoint(out)
            shared.unpersist()
        shared = spark.sparkContext.broadcast(automaton)
        out = out.mapInArrow(_pass(shared, text, name), rows.schema)
    if shared is None:
        out = out.mapInArrow(_pass(spark.sparkContext.broadcast(None), text, name), rows.schema)
    return out.drop(text)


def _hits(match: str) -> F.Column:
    spans = F.col(match)["spans"]
    return F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0), lambda a, x: a + x).cast("long")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, words: int = AUTOMATON_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of docs."""
    rows = matched(docs.select("doc_id", "text"), benchmark, "match", window, words).withColumn("n_hit", _hits("match")).withColumn("n_words", F.col("match.n"))
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("match.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("match.items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (ONE_IN * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


#: A word of a document, in place: what is cut from a text are bytes.
_WORD_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def _cut(text: str, spans: list[int]) -> str:
    """text without the words of the stretches, and what lies between them."""
    raw = text.encode()
    at = [m.span() for m in _WORD_BYTES.finditer(raw)]
    kept, last = [], 0
    for lo, hi in zip(spans[::2], spans[1::2]):
        kept.append(raw[last : at[lo][0]])
        last = at[hi - 1][1]
    return b"".join([*kept, raw[last:]]).decode()


def _cutter(match: str):
    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            out = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column(match).to_pylist()):
                out.append(_cut(text, found["spans"]) if text and found["spans"] else text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return run


def clean(docs: DataFrame, benchmark: DataFrame, mode: str = "drop", window: int = WINDOW, words: int = AUTOMATON_WORDS) -> DataFrame:
    """docs without contaminated rows (mode ``drop``), or with the hit words cut from all texts (``cut``)."""
    (match,) = fresh(docs, "__match")
    rows = matched(docs, benchmark, match, window, words)
    if mode == "cut":
        return rows.mapInArrow(_cutter(match), rows.schema).select(*docs.columns)
    hit = _hits(match)
    return rows.where(~((hit > 0) & (ONE_IN * hit >= F.col(match)["n"]))).select(*docs.columns)


_SQL_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_SQL_WORDS} AS w FROM benchmark),
k AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM k) WHERE len(w) >= n)),
m AS (SELECT doc_id, i, n, item FROM p JOIN k USING (n, k)),
h AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM m, range(0, 13) r(j) WHERE j < n GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
