"""Windows over texts and tokens, and runs of labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from cartula.functions import fixed
from cartula.functions.text import rx, slices
from cartula.operators.spans import LINES, pieces


def token_windows(counts: DataFrame, size: int = 220, overlap: int = 64) -> DataFrame:
    """note_id, lo, hi of windows over n tokens (note_id, n): every size - overlap tokens, and one that ends with the last."""
    step = size - overlap
    last = F.greatest(F.col("n") - size, F.lit(0)).cast("int")
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(step)), F.array(last)))
    rows = counts.where("n > 0").select("note_id", "n", F.explode(starts).alias("lo"))
    return rows.select("note_id", "lo", F.least(F.col("lo") + size, F.col("n")).cast("int").alias("hi"))


def rescue_windows(counts: DataFrame, required: DataFrame, size: int = 220, overlap: int = 64) -> DataFrame:
    """token_windows, and for each required span (note_id, lo, hi) that none holds whole one around its middle."""
    base = token_windows(counts, size, overlap)
    held = (F.col("r.note_id") == F.col("w.note_id")) & (F.col("w.lo") <= F.col("r.lo")) & (F.col("r.hi") <= F.col("w.hi"))
    lost = required.alias("r").join(base.alias("w"), held, "left_anti").join(counts, "note_id")
    lo = F.greatest(F.lit(0), F.least(F.floor((F.col("lo") + F.col("hi") - size) / 2), F.col("n") - size)).cast("int")
    return base.unionByName(lost.select("note_id", lo.alias("lo"), F.least(lo + size, F.col("n")).cast("int").alias("hi"))).distinct()


def piece_windows(counts: DataFrame, capacity: int, stride: int) -> DataFrame:
    """note_id, lo, hi over n sub-word pieces: every capacity - stride, until the last piece is in one."""
    step = max(1, capacity - stride)
    most = F.ceil(F.greatest(F.col("n") - capacity, F.lit(0)) / step).cast("int")
    rows = counts.where("n > 0").select("note_id", "n", F.explode(F.sequence(F.lit(0), most)).alias("k"))
    lo = (F.col("k") * step).cast("int")
    return rows.select("note_id", lo.alias("lo"), F.least(lo + capacity, F.col("n")).cast("int").alias("hi"))


def votes(tokens: DataFrame) -> DataFrame:
    """The label with the highest score of each token (note_id, start, end) that several windows labelled."""
    from cartula.operators.spans import best_of

    return best_of(tokens, ["note_id", "start", "end"], F.desc("score"), "label")


def bio_spans(tokens: DataFrame, threshold: float = 0.0) -> DataFrame:
    """note_id, start, end, type, confidence of runs of labels (note_id, start, end, label, score; label O, B-x or I-x).

    A run ends at O, under the threshold, where the type changes, at a B, and at a gap (column
    gap: whether other than white space lies before the token; optional). Its confidence is the mean score.
    """
    w = Window.partitionBy("note_id").orderBy("start", "end")
    gap = F.col("gap") if "gap" in tokens.columns else F.lit(False)
    rows = tokens.withColumn("type", F.when((F.col("label") == "O") | (F.col("score") < threshold), None).otherwise(F.substring("label", 3, 100)))
    fresh = F.col("type").isNotNull() & (F.lag("type").over(w).isNull() | (F.lag("type").over(w) != F.col("type")) | F.col("label").startswith("B-") | gap)
    rows = rows.withColumn("run", F.sum(F.when(fresh, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("type is not null")
    return rows.groupBy("note_id", "run", "type").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.round(F.avg("score"), 6).alias("confidence")).drop("run")


def bio_labels(tokens: DataFrame, gold: DataFrame) -> DataFrame:
    """tokens (note_id, start, end) with label: B- or I- of the shortest gold span over it, O without; null for empty tokens (specials)."""
    own = tokens.groupBy("note_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("ts"))
    best = F.struct((F.col("end") - F.col("start")).alias("n"), "start", "end", "type")
    over = gold.where("start < end").groupBy("note_id").agg(F.array_sort(F.collect_set(best)).alias("gs"))
    # a note's tokens and spans are two lists, which stay where the note is
    rows = own.join(over, "note_id", "left").withColumn("labels", _labels("ts.start", "ts.end", "gs.start", "gs.end", "gs.type"))
    return rows.select("note_id", F.explode(F.arrays_zip("ts", "labels")).alias("x")).select("note_id", "x.ts.start", "x.ts.end", F.col("x.labels").alias("label"))


@F.pandas_udf(ArrayType(StringType()))
def _labels(starts: pd.Series, ends: pd.Series, gold_starts: pd.Series, gold_ends: pd.Series, types: pd.Series) -> pd.Series:
    """Labels of tokens in order by spans, the shortest first: later ones are laid first, so that what lies on top counts."""

    def one(a, z, ga, gz, kinds):
        won = np.full(len(a), -1)
        if ga is not None and len(ga):
            lo, hi = np.searchsorted(np.maximum.accumulate(z), ga, "right"), np.searchsorted(a, gz, "left")
            for k in range(len(ga) - 1, -1, -1):
                own = slice(lo[k], hi[k])
                won[own][z[own] > np.maximum(a[own], ga[k])] = k
        first = np.zeros(len(a), bool)
        first[np.unique(won, return_index=True)[1]] = True
        said = [None if k < 0 else kinds[k] for k in won.tolist()]
        return [None if e else "O" if t is None else ("B-" if f else "I-") + t for e, f, t in zip((a == z).tolist(), first.tolist(), said)]

    return pd.Series([one(*x) for x in zip(starts, ends, gold_starts, gold_ends, types)], dtype=object)


#: Pieces of a text that end where it may be cut: after a line break, or a full stop and a space.
STOPS = r"[^\n.]*(?:\n|\.[ ]?)|[^\n.]+$"
_SPAN = "struct<a:int,z:int>"


def stops(notes: DataFrame, sentences: bool = True) -> DataFrame:
    """note_id, p, e: the marks (from p to e) after which a text may be cut."""
    rows = pieces(notes, STOPS if sentences else LINES)
    size = F.when(F.endswith("piece", F.lit("\n")), 1).when(F.endswith("piece", F.lit(". ")), 2)
    e = F.col("start") + F.length("piece")
    return rows.select("note_id", (e - size).alias("p"), e.alias("e")).where(F.col("p").isNotNull())


def _chunks(a: Column, z: Column, marks: Column, size: int, overlap: int) -> Column:
    """Chunks from a to z as an array: each size long at most, and cut after the last mark of its second half, if there is one.

    One fold over the marks in order. A mark in reach is the cut so far; one out of reach closes the chunk. Where chunks have
    no mark they are cut at their size, and how many of them lie before the next mark follows from its place. Each chunk begins
    overlap before the end of the one before.
    """
    if not 0 <= overlap < size // 2:
        raise ValueError(f"chunks of {size} can't overlap by {overlap}")
    step = size - overlap
    span = lambda x, y: F.struct(x.cast("int").alias("a"), y.cast("int").alias("z"))
    whole = lambda at, to: F.greatest(F.lit(0), F.ceil((to - at - size) / step)).cast("int")
    plain = lambda at, n: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: span(at + i * step, at + i * step + size))).otherwise(F.array().cast(f"array<{_SPAN}>"))
    state = lambda at, cut, out: F.struct(at.cast("int").alias("at"), cut.cast("int").alias("cut"), out.alias("out"))

    def closed(s):
        """The chunk up to the cut so far, if there is one: the next one's start, and the chunks."""
        some = s["cut"].isNotNull()
        return F.when(some, s["cut"] - overlap).otherwise(s["at"]), F.when(some, F.concat(s["out"], F.array(span(s["at"], s["cut"])))).otherwise(s["out"])

    def met(s, m):
        at, out = closed(s)
        n = F.least(whole(at, m["e"]), whole(at, z))
        to = at + n * step
        inside = (m["p"] >= to + size // 2) & (to + size < z)
        within = state(s["at"], F.when(m["p"] >= s["at"] + size // 2, m["e"]).otherwise(s["cut"]), s["out"])
        beyond = state(to, F.when(inside, m["e"]), F.concat(out, plain(at, n)))
        return F.when(s["at"] + size >= z, s).when(m["e"] > s["at"] + size, beyond).otherwise(within)

    def last(s):
        at, out = closed(F.when(s["at"] + size < z, s).otherwise(state(s["at"], F.lit(None), s["out"])))
        n = whole(at, z)
        return F.concat(out, plain(at, n), F.array(span(at + n * step, z)))

    none = F.array().cast(f"array<{_SPAN}>")
    return F.when(z > a, F.aggregate(marks, state(a, F.lit(None), none), met, last)).otherwise(none)


def _marks(column: str = "marks") -> Column:
    return F.coalesce(column, F.array().cast("array<struct<p:int,e:int>>"))


def char_chunks(notes: DataFrame, size: int = 2600, overlap: int = 120) -> DataFrame:
    """note_id, start, end: chunks of fixed size, cut at a line break in their second half."""
    marks = stops(notes, sentences=False).groupBy("note_id").agg(F.array_sort(F.collect_list(F.struct("p", "e"))).alias("marks"))
    rows = notes.select("note_id", F.coalesce(F.length("text"), F.lit(0)).alias("z")).join(marks, "note_id", "left")
    cut = rows.select("note_id", F.explode(_chunks(F.lit(0), F.col("z"), _marks(), size, overlap)).alias("c"))
    return cut.select("note_id", F.col("c.a").alias("start"), F.col("c.z").alias("end"))


def heading_blocks(notes: DataFrame) -> DataFrame:
    """note_id, a, z, heading: what numbered headings begin; a heading before any other text names the first block, else DOCUMENT does."""
    own = F.regexp_replace("piece", r"(?U)^\s+|\s+$", "")
    rows = pieces(notes, LINES).withColumn("own", own).withColumn("head", (F.col("own") != "") & F.col("piece").rlike(f"(?iuUm){fixed.CHUNK_HEADING}"))
    w = Window.partitionBy("note_id").orderBy("i")
    seen = F.coalesce(F.max(F.col("own") != "").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    rows = rows.withColumn("block", F.sum((F.col("head") & seen).cast("int")).over(w))
    first = F.min(F.when(F.col("own") != "", F.struct("i", "head", F.substring("own", 1, 180).alias("own"))))
    out = rows.groupBy("note_id", "block").agg(F.min("start").alias("a"), F.max(F.col("start") + F.length("piece")).alias("z"), first.alias("f"))
    return out.select("note_id", "a", "z", F.when(F.col("f.head"), F.col("f.own")).otherwise("DOCUMENT").alias("heading"))


def semantic_chunks(notes: DataFrame, sections: DataFrame | None = None, size: int = 1800, overlap: int = 120, least: int = 1) -> DataFrame:
    """note_id, start, end, heading, signal of chunks that say something medical.

    Blocks are sections, or what numbered headings begin; administrative blocks without a cue are left out, neighbours (of one
    heading, if they are sections) are joined while they fit. A note in which no chunk has enough cues is one chunk, whatever its length.
    """
    cues = lambda t: F.regexp_count(t, F.lit(rx(fixed.MEDICAL_CUE)))
    notes = notes.select("note_id", F.coalesce("text", F.lit("")).alias("text"))
    if sections is None:
        blocks = heading_blocks(notes)
    else:
        title = F.when(F.trim("header") != "", F.concat_ws(": ", "canonical", F.trim("header"))).otherwise(F.col("canonical"))
        first = F.when(F.col("header") != "", F.col("header_start")).otherwise(F.col("content_start"))
        blocks = sections.select("note_id", first.alias("a"), F.col("content_end").alias("z"), F.substring(title, 1, 180).alias("heading"))
    block = F.struct(F.col("a").cast("int").alias("a"), F.col("z").cast("int").alias("z"), "heading")
    held = notes.join(blocks.where("z > a").groupBy("note_id").agg(F.array_sort(F.collect_list(block)).alias("blocks")), "note_id")
    idle = lambda t: (cues(t) < least) & t.rlike(rx(rf"^\s*{fixed.ADMIN_BLOCK.lstrip('^')}"))
    said = F.zip_with("blocks", slices("text", "blocks.a", "blocks.z"), lambda b, t: F.when(~idle(t), b))
    near = lambda x, b: (x["z"] == b["a"]) & (b["z"] - x["a"] <= size) & (F.lit(sections is None) | (x["heading"] == b["heading"]))
    tail = lambda x: F.element_at(x, -1)
    longer = lambda x, b: F.concat(F.slice(x, 1, F.size(x) - 1), F.array(F.struct(tail(x)["a"].alias("a"), b["z"].alias("z"), tail(x)["heading"].alias("heading"))))
    joined = F.aggregate("said", F.slice("said", 1, 0), lambda x, b: F.when((F.size(x) > 0) & near(tail(x), b), longer(x, b)).otherwise(F.concat(x, F.array(b))))
    rows = held.withColumn("said", F.filter(said, lambda b: b.isNotNull())).select("note_id", F.explode(joined).alias("b")).select("note_id", "b.*")
    marks = stops(notes).select("note_id", F.col("p").alias("at"), F.lit(1).alias("kind"), F.struct("p", "e").alias("m"))
    both = rows.select("note_id", F.col("a").alias("at"), F.lit(0).alias("kind"), F.struct("a", "z").alias("b")).unionByName(marks, True)
    within = F.last("b", ignorenulls=True).over(Window.partitionBy("note_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    own = both.withColumn("b", within).where((F.col("kind") == 1) & (F.col("at") < F.col("b.z"))).groupBy("note_id", F.col("b.a").alias("a")).agg(F.array_sort(F.collect_list("m")).alias("marks"))
    cut = rows.join(own, ["note_id", "a"], "left").select("note_id", "heading", F.explode(_chunks(F.col("a"), F.col("z"), _marks(), size, overlap)).alias("c"))
    of = cut.groupBy("note_id").agg(F.array_sort(F.collect_list(F.struct("c.a", "c.z", "heading"))).alias("chunks"))
    told = notes.join(of, "note_id", "left").withColumn("chunks", F.coalesce("chunks", F.slice(F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("z"), F.lit("").alias("heading"))), 1, 0)))
    chunk = lambda c, n: F.struct(c["a"].alias("start"), c["z"].alias("end"), c["heading"].alias("heading"), n.alias("signal"))
    good = F.filter(F.zip_with("chunks", slices("text", "chunks.a", "chunks.z"), lambda c, t: chunk(c, cues(t))), lambda c: c["signal"] >= least)
    every = F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end"), F.lit("DOCUMENT").alias("heading"), cues(F.col("text")).alias("signal")))
    return told.withColumn("good", good).select("note_id", F.explode(F.when(F.size("good") > 0, F.col("good")).otherwise(every)).alias("c")).select("note_id", "c.*")


def debug_counts(chunks: DataFrame, found: DataFrame, kept: DataFrame) -> DataFrame:
    """note_id, segments, tokens, before, after, removed: how many chunks (with n, their tokens) a note was read in, and how many
    spans were found and are left once those that windows share are one."""
    n = lambda rows, name: rows.groupBy("note_id").agg(F.count("*").alias(name))
    out = chunks.groupBy("note_id").agg(F.count("*").alias("segments"), F.sum("n").alias("tokens"))
    out = out.join(n(found, "before"), "note_id", "left").join(n(kept, "after"), "note_id", "left").na.fill(0, ["before", "after"])
    return out.withColumn("removed", F.col("before") - F.col("after"))


def observed_counts(chunks: DataFrame, found: DataFrame, kept: DataFrame):
    """The three tables, and a function that tells segments, tokens, before, after and removed over all notes.

    The numbers are gathered while the tables are first written or read to their end; nothing is read for them.
    """
    of = {"chunks": Observation(), "found": Observation(), "kept": Observation()}
    chunks = chunks.observe(of["chunks"], F.count(F.lit(1)).alias("segments"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"))
    found, kept = found.observe(of["found"], F.count(F.lit(1)).alias("before")), kept.observe(of["kept"], F.count(F.lit(1)).alias("after"))

    def told() -> dict[str, int]:
        out = {k: v for o in of.values() for k, v in o.get.items()}
        return out | {"removed": out["before"] - out["after"]}

    return chunks, found, kept, told


def record_chunks(lines: DataFrame, header: str) -> DataFrame:
    """note_id, record, start, end: what each line that matches header begins, up to the next."""
    heads = lines.where(F.col("line").rlike(header))
    w = Window.partitionBy("note_id").orderBy("start")
    last = lines.groupBy("note_id").agg(F.max("end").alias("__end"))
    rows = heads.join(last, "note_id").withColumn("record", F.row_number().over(w))
    return rows.select("note_id", "record", "start", F.coalesce(F.lead("start").over(w), F.col("__end")).alias("end"))


def chunk_strategy(records: str = "records", covered: str = "covered", mode: str = "auto", share: float = 0.65):
    """Which chunks a note is read in: as asked, or records from two on, else sections if they cover enough, else the document."""
    if mode != "auto":
        return F.lit(mode)
    return F.when(F.col(records) >= 2, "records").when(F.col(covered) >= share, "sections").otherwise("document")
