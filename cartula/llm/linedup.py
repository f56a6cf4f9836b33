"""Line deduplication by a deletion-neighbourhood join.

Lines are sequences of words. Two are near when one word put in, left out or replaced
makes them equal, and the longer has ``LEAST`` words at least. The bound is one word
whatever the length: a similarity of 0.8 at five words, but of 0.95 at twenty, so longer
lines with two or more edits stay; any lines of equal words are equal. Of near or equal lines all but the earliest, by
document and line number, are removed; lines are judged on the input.

One edit leaves the front or the back half of a line as it is. So lines that share a half
with another line are found first, and only these emit their deletion neighbourhood: for
each word of the other half the hash of the line without it. A line is hashed as the
exclusive or of the hashes of its words with their places; words that follow a deleted one
move by a place, and both kinds of sums run along the line, so its variants cost its
length. Equal variants meet in a grouped minimum, the earliest line of a variant, and the
pair is verified word by word. Sums and minima are partial before they are shuffled, and
are written before they are joined back, so a variant or a line that any number of
documents share is split like any hot key.

Defined results: a null text has no lines; lines without words stay; rows that share an
id are one document, in which line numbers may repeat; rows with a null id come last; an
empty table gives an empty result; further columns are ignored. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartula.llm.common import WORD, checkpoint, fresh, stored

#: Words that the longer of two near lines has at least.
LEAST = 5

_LAST = (1 << 63) - 1


def lines(docs: DataFrame) -> DataFrame:
    """id (doc_id; a large number for null), line_no from 0, line."""
    cut = F.posexplode(F.split(F.col("text"), "\n")).alias("line_no", "line")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), cut)


def _words(line: str = "line") -> F.Column:
    """Words between ASCII white space; a split at one character is the cheapest there is, and few lines have other white space."""
    plain = F.when(F.col(line).rlike(r"[\t\x0B\f\r]"), F.translate(line, "\t\n\x0b\f\r", "     ")).otherwise(F.col(line))
    return F.array_remove(F.split(plain, " "), "")


def _keys(words: F.Column, n: F.Column) -> list[F.Column]:
    """Keys of the front and the back half of a line of n words: as the shorter or equal one, and as the longer by a word."""
    out = []
    for short in (n, n - 1):
        front = F.floor(short / 2).cast("int")
        out += [F.xxhash64(F.lit("front"), short, F.slice(words, 1, front)), F.xxhash64(F.lit("back"), short, F.slice(words, n - (short - front) + 1, short))]
    return out


def variants(candidates: DataFrame) -> DataFrame:
    """at (id, line_no), kind and v, the hash of a variant, of lines (id, line_no, h, words, shared) whose half keys others share.

    kind 0: a word replaced; 1: nothing deleted, for longer lines; 2: a word deleted, for shorter ones.
    A word is left out where the half that it isn't in is shared.
    """
    n = F.size("words")
    met = [F.array_contains("shared", k) for k in _keys(F.col("words"), n)]
    rows = candidates.select("id", "line_no", "h", n.alias("n"), *(m.alias(f"met{k}") for k, m in enumerate(met)), F.posexplode("words").alias("i", "w"))
    rows = rows.withColumn("here", F.xxhash64("i", "w")).withColumn("moved", F.xxhash64(F.col("i") - 1, "w")).drop("w")
    line = Window.partitionBy("id", "line_no", "h")
    ahead = line.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    to_here = line.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    none = F.lit(0).cast("long")
    rows = rows.select(
        "*", F.coalesce(F.bit_xor("here").over(ahead), none).alias("before"), F.bit_xor("moved").over(to_here).alias("so_far"),
        F.bit_xor("here").over(line).alias("all_here"), F.bit_xor("moved").over(line).alias("all_moved"),
    )
    without = F.col("all_here").bitwiseXOR(F.col("here"))
    deleted = F.col("before").bitwiseXOR(F.col("all_moved")).bitwiseXOR(F.col("so_far"))
    half, half_longer = F.floor(F.col("n") / 2), F.floor((F.col("n") - 1) / 2)
    outside = lambda front, back, cut: (F.col(front) & (F.col("i") >= cut)) | (F.col(back) & (F.col("i") < cut))
    made = lambda on, kind, v: F.when(on, F.struct(F.lit(kind).alias("kind"), v.alias("v")))
    own = F.array(
        made(outside("met0", "met1", half), 0, F.xxhash64(F.lit("replace"), "n", "i", without)),
        made((F.col("i") == 0) & (F.col("met0") | F.col("met1")), 1, F.xxhash64(F.lit("indel"), "n", "all_here")),
        made((F.col("met2") & (F.col("i") >= half_longer)) | (F.col("met3") & (F.col("i") <= half_longer)), 2, F.xxhash64(F.lit("indel"), F.col("n") - 1, deleted)),
    )
    return rows.select(F.struct("id", "line_no").alias("at"), F.explode(F.array_compact(own)).alias("x")).select("at", "x.kind", "x.v")


def near(a: F.Column, b: F.Column) -> F.Column:
    """Whether one edit of a word at most makes the lines equal."""
    first = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False).cast("int")
    n, m, most = F.size(a), F.size(b), F.size(a) + F.size(b)
    return (
        F.when(first == 0, F.lit(True))
        .when(n == m, F.slice(a, first + 1, most) == F.slice(b, first + 1, most))
        .when(n == m + 1, F.slice(a, first + 1, most) == F.slice(b, first, most))
        .when(m == n + 1, F.slice(b, first + 1, most) == F.slice(a, first, most))
        .otherwise(F.lit(False))
    )


def removed(docs: DataFrame) -> DataFrame:
    """id, line_no, first_id, first_line of each line that is removed: an earlier equal line, or else an earlier near one."""
    # Through shuffles go hashes; words, which take three times the room of lines, are made where they are needed.
    hashed = lines(docs).where(F.col("line").rlike(WORD)).withColumn("words", _words())
    hashed = hashed.select("id", "line_no", F.xxhash64("words").alias("h"), F.xxhash64(F.lit(1), "words").alias("g"), F.size("words").alias("n"), "words")
    keys = (F.when(F.col("n") >= LEAST - 1, k).alias(f"k{i}") for i, k in enumerate(_keys(F.col("words"), F.col("n"))))
    slim = stored(hashed.select("id", "line_no", "h", "g", *keys))
    first = F.struct("id", "line_no").alias("at")
    names = [f"k{i}" for i in range(4)]
    distinct = stored(slim.groupBy("h", "g", *names).agg(F.min(first).alias("first")))  # the keys go with h and g

    keyed = distinct.where("k0 is not null").select("h", F.explode(F.array(*names)).alias("key"))
    shared = checkpoint(keyed.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo < hi").select("key"))
    wanted = checkpoint(keyed.join(shared, "key").groupBy("h").agg(F.collect_set("key").alias("shared")))  # four at most
    wanted = wanted.join(distinct.select("h", "g", "first"), "h")
    wanted = wanted.select(F.col("h").alias("__h"), F.col("g").alias("__g"), F.col("first.id").alias("__id"), F.col("first.line_no").alias("__no"), "shared")
    # The candidates' words, once: from the place where each first stands.
    texts = lines(docs)
    met = texts.join(wanted, (texts["id"] == wanted["__id"]) & (texts["line_no"] == wanted["__no"])).withColumn("words", _words())
    # Rows may share an id. Said as differences, these stay behind the join; as equalities they would be keys of it, made for all lines.
    met = met.where((F.xxhash64("words").bitwiseXOR(F.col("__h")) == 0) & (F.xxhash64(F.lit(1), "words").bitwiseXOR(F.col("__g")) == 0))
    candidates = checkpoint(met.dropDuplicates(["id", "line_no", "__h", "__g"]).select("id", "line_no", F.col("__h").alias("h"), "line", "shared")).withColumn("words", _words())

    # Long lines and lines of few documents lie anywhere: their words are dealt anew by the windows.
    found = checkpoint(variants(candidates))
    earliest = lambda k: F.min(F.when(F.col("kind") == k, F.col("at"))).alias(f"first{k}")
    met = found.groupBy("v").agg(earliest(0), earliest(1), earliest(2), F.min("at").alias("lo"), F.max("at").alias("hi")).where("lo < hi").drop("lo", "hi")
    met = checkpoint(met)
    other = F.when(F.col("kind") == 0, F.col("first0")).when(F.col("kind") == 1, F.col("first2")).otherwise(F.col("first1"))
    pairs = found.join(met, "v").withColumn("other", other).where("other < at").select("at", "other").distinct()
    own, theirs = candidates.select("id", "line_no", "line"), candidates.select(F.col("id").alias("o_id"), F.col("line_no").alias("o_no"), F.col("line").alias("o_line"))
    pairs = pairs.select("at.id", "at.line_no", F.col("other.id").alias("o_id"), F.col("other.line_no").alias("o_no"))
    proved = pairs.join(own, ["id", "line_no"]).join(theirs, ["o_id", "o_no"])
    proved = proved.withColumn("words", _words()).withColumn("o_words", _words("o_line"))
    proved = proved.where(near(F.col("words"), F.col("o_words")) & (F.greatest(F.size("words"), F.size("o_words")) >= LEAST))
    near_ones = proved.groupBy("id", "line_no").agg(F.min(F.struct(F.col("o_id").alias("id"), F.col("o_no").alias("line_no"))).alias("other"))
    near_ones = checkpoint(near_ones.select(F.struct("id", "line_no").alias("first"), "other"))

    cover = checkpoint(distinct.select("h", "g", "first").join(near_ones, "first", "left"))
    at = F.struct("id", "line_no")
    judged = slim.select("id", "line_no", "h", "g").join(cover, ["h", "g"]).withColumn("other", F.when(at > F.col("first"), F.col("first")).otherwise(F.col("other")))
    return judged.where("other is not null").select("id", "line_no", F.col("other.id").alias("first_id"), F.col("other.line_no").alias("first_line"))


def removed_by_document(docs: DataFrame, key: str, name: str) -> DataFrame:
    """key (the id; a large number for null) and name, the numbers of the lines that are removed, of each document that loses any."""
    return removed(docs.select("doc_id", "text")).groupBy(F.col("id").alias(key)).agg(F.array_sort(F.collect_set("line_no")).alias(name))


def dedup(docs: DataFrame) -> DataFrame:
    """docs with the lines left that are not removed; all columns."""
    key, gone = fresh(docs, "__id", "__gone")
    rows = docs.join(removed_by_document(docs, key, gone), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)) == F.col(key), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col(gone), i)), "\n")
    return rows.select(*(c if c != "text" else F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept).alias("text") for c in docs.columns))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and removed, the numbers of the lines that go, in order, of each row of docs."""
    slim = docs.select("doc_id", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("__k"))
    slim = slim.withColumn("n_lines", F.when(F.col("n_lines") < 0, 0).otherwise(F.col("n_lines")).cast("long"))
    rows = slim.join(removed_by_document(docs, "__id", "__gone"), F.col("__k") == F.col("__id"), "left")
    gone = F.coalesce("__gone", F.array().cast("array<int>"))
    return rows.select("doc_id", "n_lines", F.size(gone).cast("long").alias("n_removed"), gone.alias("removed"))
