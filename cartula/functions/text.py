"""Text functions on columns. Offsets are in code points, half open."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def rx(pattern: str) -> str:
    """A pattern for Java that ignores case and knows all of Unicode, whatever the Java version."""
    return f"(?iuU){pattern}"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squash(c: str | Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def fold(c: str | Column, strip: str = "") -> Column:
    """Lower case and squashed; then without the characters of strip at either end."""
    out = squash(F.lower(col(c)))
    return F.btrim(out, F.lit(strip)) if strip else out


def upper_each(c: str | Column) -> Column:
    """Upper case, one character for each: ``ß`` becomes ``ẞ``, and what has no upper case of one character stays."""
    own, big = F.translate(col(c), "ß", "ẞ"), F.upper(F.translate(col(c), "ß", "ẞ"))
    one = F.transform(F.split(own, ""), lambda ch: F.when(F.length(F.upper(ch)) == 1, F.upper(ch)).otherwise(ch))
    return F.when(F.length(big) == F.length(own), big).otherwise(F.array_join(one, ""))


@F.pandas_udf(StringType())
def fold_exact(s: pd.Series) -> pd.Series:
    """NFC, case-folded, squashed; exact for every script."""
    return s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFC", x).casefold().split()))


def _letters() -> tuple[str, str]:
    """Letters whose decomposition starts from one of a-z or 0-9, and that letter."""
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)).casefold() if not unicodedata.combining(c))
        if len(base) == 1 and (base.isascii() and base.isalnum()):
            source.append(chr(code))
            target.append(base)
    return "".join(source), "".join(target)


LETTERS = _letters()


def ontology_key(c: str | Column) -> Column:
    """Latin text as words of a-z and 0-9: marks dropped, anything else a space. A letter without a
    decomposition is a space too, so ``đau`` is ``au``; this is how both sides of every lookup are made."""
    low = F.replace(F.lower(col(c)), F.lit("ß"), F.lit("ss"))
    plain = F.regexp_replace(F.translate(low, *LETTERS), r"\p{M}", "")
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


@F.pandas_udf(StringType())
def ontology_key_exact(s: pd.Series) -> pd.Series:
    """As ontology_key, by full compatibility decomposition."""

    def one(x):
        if x is None:
            return None
        plain = "".join(c for c in unicodedata.normalize("NFKD", x).casefold() if not unicodedata.combining(c))
        return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in plain).split())

    return s.map(one)


def ontology_tokens(c: str | Column) -> Column:
    """Words of the key with more than one character."""
    return F.filter(F.split(ontology_key(c), " "), lambda t: F.length(t) > 1)


#: The column of ``spans.near``: a part of a note (text), where it begins (base), and how long the whole is (size).
NEAR = "__near"


def _held(text: str | Column) -> tuple[Column, Column | int]:
    """What is held of a text, and the place where that begins."""
    return (F.col(f"{text}.text"), F.col(f"{text}.base")) if isinstance(text, str) and text.split(".")[-1] == NEAR else (col(text), 0)


def between(text: str | Column, start: str | Column, end: str | Column) -> Column:
    """The characters from start to end."""
    s, e = col(start), col(end)
    own, base = _held(text)
    return F.substring(own, s + 1 - base, F.greatest(e - s, F.lit(0)))


@F.pandas_udf(ArrayType(StringType()))
def slices(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    """The characters from each of several starts to its end: of a long text each costs its own length, not its place."""
    return pd.Series([[t[a:z] for a, z in zip(own, others)] for t, own, others in zip(text, starts, ends)], dtype=object)


def before(text: str | Column, at: str | Column, n: int) -> Column:
    """At most n characters before a place."""
    a = col(at)
    return between(text, F.greatest(a - n, F.lit(0)), a)


def after(text: str | Column, at: str | Column, n: int) -> Column:
    own, base = _held(text)
    return F.substring(own, col(at) + 1 - base, F.lit(n))


def clause_before(text: str | Column, at: str | Column, n: int, cut: str = r"\n.;:") -> Column:
    """What stands before a place in its clause, n characters at most. (The dollar sign also stands before a last line break.)"""
    return _after_last(before(text, at, n), cut)


def _after_last(own: Column, cut: str) -> Column:
    """What follows the last of some characters, or all: found on the way back from the end, as a search from the front tries each place."""
    return F.regexp_extract(own, rf"(?s)\A(?:.*[{cut}])?+(.*)\z", 1)


def clause_around(text: str | Column, start: str | Column, end: str | Column, n: int = 180) -> Column:
    """The clause of a span: to the nearest full stop, semicolon or line break on either side."""
    left = _after_last(before(text, start, n), r".\n;")
    right = F.regexp_extract(after(text, end, n), r"^[^.\n;]*", 0)
    return F.concat(left, between(text, start, end), right)


def snippet(text: str | Column, start: str | Column, end: str | Column, n: int = 120) -> Column:
    """The span with n characters on either side, in one line."""
    e = col(end)
    return F.translate(between(text, F.greatest(col(start) - n, F.lit(0)), e + n), "\n", " ")


def scope_text(section: str | Column, text: str | Column, start: str | Column, end: str | Column, n: int = 140) -> Column:
    """What a scope classifier reads of a mention."""
    return F.format_string("SECTION=%s LEFT=%s ENTITY=%s RIGHT=%s", col(section), before(text, start, n), between(text, start, end), after(text, end, n))


def trimmed(text: str | Column, start: str | Column, end: str | Column, tail: str = r"[\s,;.]+") -> tuple[Column, Column]:
    """start and end of a span without white space in front and without tail behind."""
    return trimmed_own(between(text, start, end), start, tail)


def trimmed_own(own: str | Column, start: str | Column, tail: str = r"[\s,;.]+") -> tuple[Column, Column]:
    """As trimmed, of a span's own text."""
    lead = F.length(own) - F.length(F.regexp_replace(own, r"(?U)^\s+", ""))
    kept = F.length(F.regexp_replace(own, f"(?U){tail}$", ""))
    return col(start) + lead, F.greatest(col(start) + lead, col(start) + kept)


def top_level_colon(line: str | Column) -> Column:
    """Place of the first colon outside of brackets, or -1."""
    c = col(line)
    start = F.struct(F.lit(0).alias("depth"), F.lit(-1).alias("found"), F.lit(0).alias("at"))

    def step(s, ch):
        opened = F.when(ch.isin("(", "[", "{"), s["depth"] + 1).when(ch.isin(")", "]", "}"), F.greatest(F.lit(0), s["depth"] - 1)).otherwise(s["depth"])
        hit = (s["found"] < 0) & (ch == ":") & (s["depth"] == 0)
        return F.struct(opened.alias("depth"), F.when(hit, s["at"]).otherwise(s["found"]).alias("found"), (s["at"] + 1).alias("at"))

    return F.when(~c.contains(":"), -1).otherwise(F.aggregate(F.split(c, ""), start, step)["found"])


def is_word(ch: Column) -> Column:
    """Letters, digits, marks and the underscore; an empty string is none."""
    return ch.rlike(r"(?U)^[\p{L}\p{M}\p{N}_]")


def mid_word(text: str | Column, start: str | Column, end: str | Column) -> Column:
    """Whether a span begins or ends inside of a word."""
    s, e = col(start), col(end)
    front = is_word(between(text, s - 1, s)) & is_word(between(text, s, s + 1)) & (s > 0)
    return front | (is_word(between(text, e - 1, e)) & is_word(between(text, e, e + 1)))


def valid_span(text: str | Column, start: str | Column, end: str | Column, own: str | Column) -> Column:
    """The invariant of every span: in range, not empty, and equal to its text."""
    s, e = col(start), col(end)
    size = F.col(f"{text}.size") if isinstance(_held(text)[1], Column) else F.length(col(text))
    return (s >= 0) & (s < e) & (e <= size) & (between(text, s, e) == col(own))


def spaced(phrase: str) -> str:
    """A pattern for a phrase in which any white space stands for any other."""
    import re

    return r"\s+".join(map(re.escape, phrase.split()))


def repeats_a_word(c: str | Column) -> Column:
    """Whether two neighbouring words are equal, but for case and punctuation at their ends."""
    words = F.transform(F.split(squash(c), " "), lambda t: F.btrim(F.lower(t), F.lit(".,;:()[]{}")))
    return F.exists(F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1))), lambda a, b: (a == b) & (a != "")), lambda x: F.coalesce(x, F.lit(False)))


def related_codes(a: str | Column, b: str | Column) -> Column:
    """Whether one code is the other's category, as I50 is of I50.9."""
    x, y = F.replace(col(a), F.lit("."), F.lit("")), F.replace(col(b), F.lit("."), F.lit(""))
    return F.startswith(x, y) | F.startswith(y, x)


def piece_surface(c: str | Column) -> Column:
    """A word piece without its marks of continuation."""
    return F.regexp_replace(col(c), "@@$|▁", "")


def token_count(c: str | Column) -> Column:
    """Words between ASCII white space."""
    return F.regexp_count(col(c), F.lit(r"[^\x20\x09-\x0D]+"))
