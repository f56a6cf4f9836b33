"""Rules that propose entities: structured lines, phrases in context, and dictionaries.

An entity is a span with the columns of ``ENTITY``; ``seq`` is its place in the order of
proposals, which some folds depend on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartula.functions import fixed
from cartula.functions.fixed import DIAGNOSIS, DRUG, RESULT, SYMPTOM, TEST
from cartula.functions.text import NEAR, after, before, between, fold, repeats_a_word, rx, squash, top_level_colon, trimmed_own
from cartula.operators import lexicon as lex
from cartula.operators import spans
from cartula.operators.assertions import REACH, flagged, inferred
from cartula.operators.sections import in_header, section_of, with_policy
from cartula.session import keep

ENTITY = {
    "start": "int", "end": "int", "text": "string", "type": "string", "assertions": "array<string>", "candidates": "array<string>", "confidence": "double",
    "source": "string", "section": "string", "canonical_name": "string", "normalized": "string", "context": "string", "trusted": "boolean", "needs_support": "boolean",
    "linked_start": "int", "recheck": "boolean", "link_method": "string", "supporting_sources": "array<string>",
}
_DEFAULT = {"assertions": F.array, "candidates": F.array, "supporting_sources": F.array, "section": lambda: F.lit("UNKNOWN"), "trusted": lambda: F.lit(False), "needs_support": lambda: F.lit(False), "recheck": lambda: F.lit(False)}


def entities(rows: DataFrame, **values: Column | str | float | bool) -> DataFrame:
    """rows as entities: values by name, else rows' columns, else defaults."""
    out = []
    for name, kind in ENTITY.items():
        v = values.get(name, F.col(name) if name in rows.columns else _DEFAULT.get(name, lambda: F.lit(None))())
        out.append((v if isinstance(v, Column) else F.lit(v)).cast(kind).alias(name))
    return rows.select("note_id", *out)


def _lines_in(notes: DataFrame, sections: DataFrame) -> DataFrame:
    """Parts of lines in the content of one section: note_id, section, start, line."""
    own = spans.lines(notes).where("start < end")
    s = sections.where("content_start < content_end").select("note_id", F.col("content_start").alias("start"), F.col("content_end").alias("end"), "canonical")
    rows = spans.overlapping(own, s)
    lo, hi = F.greatest("l.start", "r.start"), F.least("l.end", "r.end")
    rows = rows.select("l.note_id", F.col("r.canonical").alias("section"), lo.alias("start"), F.substring(F.col("l.line"), lo - F.col("l.start") + 1, F.greatest(hi - lo, F.lit(0))).alias("line"))
    return rows.where(F.trim("line") != "")


def structured(notes: DataFrame, sections: DataFrame) -> DataFrame:
    """Imaging modalities in test sections, and lines ``label: value`` of tests, vital signs and attributes of symptoms."""
    rows = _lines_in(notes, sections)
    imaging = spans.regex_spans(rows.where(F.col("section").isin(*fixed.MODALITY_SECTIONS)).select(F.struct("note_id", "section", "start").alias("k"), "line").select(F.to_json("k").alias("note_id"), F.col("line").alias("text")), {"m": fixed.MODALITY})
    kind = notes.schema["note_id"].dataType.simpleString()
    imaging = imaging.withColumn("k", F.from_json("note_id", f"note_id {kind}, section string, start int"))
    imaging = imaging.select("k.note_id", "k.section", (F.col("k.start") + F.col("start")).alias("start"), (F.col("k.start") + F.col("end")).alias("end"), "text")
    found = [entities(imaging, type=TEST, confidence=0.98, source="structured_imaging_test", trusted=True)]

    rows = rows.withColumn("colon", top_level_colon("line")).where("colon >= 0")
    raw_left = F.expr("substring(line, 1, colon)")
    left = F.regexp_replace(F.regexp_replace(raw_left, r"^[ \t\-*•0-9.)]+", ""), r"[ \t\-*•0-9.)]+$", "")
    rows = rows.withColumn("left", left).withColumn("value", F.regexp_replace(F.regexp_replace(F.expr("substring(line, colon + 2)"), r"(?U)^\s+", ""), r"(?U)\s+$", ""))
    rows = rows.where("left <> '' and value <> ''").withColumn("lnorm", fold("left"))
    l_start = F.col("start") + F.expr("locate(left, line)") - 1
    r_start = F.col("start") + F.length("line") - F.length(F.regexp_replace(F.expr("substring(line, colon + 2)"), r"(?U)^\s+", ""))
    value = F.regexp_replace("value", "[,;.]+$", "")
    rows = _settled(rows.withColumn("ls", l_start).withColumn("rs", r_start).withColumn("value", value))
    attribute = F.col("lnorm").isin(*fixed.FIELD_LABELS)
    own = rows.where(attribute & (F.col("value") != ""))
    found.append(entities(own, start=F.col("rs"), end=F.col("rs") + F.length("value"), text=F.col("value"), type=SYMPTOM, confidence=0.62, source="structured_symptom_attribute"))
    vital, modality, hint = F.col("lnorm").isin(*fixed.VITAL_LABELS), F.col("left").rlike(rx(fixed.MODALITY)), F.col("left").rlike(rx(fixed.TEST_HINT))
    balanced = lambda a, b: F.regexp_count("left", F.lit(a)) == F.regexp_count("left", F.lit(b))
    tests = rows.where(~attribute & (F.col("section").isin(*fixed.TEST_SECTIONS) | vital | modality) & ~F.col("lnorm").rlike(rx(fixed.GENERIC_TEST_LABEL)))
    tests = tests.where((F.size(F.split(squash("left"), " ")) <= 12) & balanced(r"\(", r"\)") & balanced(r"\[", r"\]") & (hint | vital | modality))
    found.append(entities(tests, start=F.col("ls"), end=F.col("ls") + F.length("left"), text=F.col("left"), type=TEST, confidence=0.98, source="structured_test_label", trusted=True))
    norm = fold("value")
    results = tests.where((F.length("value") <= 90) & (F.col("value") != "") & (norm.rlike(rx(fixed.RESULT_WORDS)) | norm.rlike(r"^\d")))
    found.append(entities(results, start=F.col("rs"), end=F.col("rs") + F.length("value"), text=F.col("value"), type=RESULT, confidence=0.97, source="structured_test_result", trusted=True))
    return _union(found)


def _settled(rows: DataFrame) -> DataFrame:
    """rows, kept. A filter on columns that are made from one another step by step would else be pushed below all
    the steps, and each use of a column would become a copy of its whole history."""
    return keep(rows)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def contextual(notes: DataFrame, sections: DataFrame) -> DataFrame:
    """Tests after their cue, results after a label, and what a test is said to show: findings, not diseases, up to their consequences."""

    def cut(rows, own):
        s, e = trimmed_own(own, "start")
        rows = rows.withColumn("s", s).withColumn("e", e).where("s < e").withColumn("text", F.substring(own, F.col("s") - F.col("start") + 1, F.col("e") - F.col("s")))
        return rows.withColumn("start", F.col("s")).withColumn("end", F.col("e")).drop("s", "e")

    cues = cut(spans.regex_spans(notes, {"test": fixed.TEST_CUE, "result": fixed.RESULT_CUE}, "own"), F.col("text"))
    shows = spans.regex_spans(notes, {"shows": fixed.TEST_SHOWS}, "test")
    tails = spans.regex_spans(notes, {"tail": fixed.TEST_SHOWS}, "own").select("note_id", F.col("start").alias("tail"), F.col("text").alias("tail_text"))
    parts = tails.select("note_id", "tail", F.posexplode(F.regexp_extract_all("tail_text", F.lit("[^,]+,?"), 0)).alias("i", "part"))
    w = Window.partitionBy("note_id", "tail").orderBy("i")
    ahead = F.coalesce(F.sum(F.length("part")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("start", (F.col("tail") + ahead).cast("int")).withColumn("end", (F.col("start") + F.length("part")).cast("int"))
    parts = parts.withColumn("stop", F.max(F.trim("part").rlike(rx(fixed.STOP_FINDINGS)).cast("int")).over(w)).where("stop = 0")
    findings = cut(parts, F.col("part")).where(F.col("text").rlike(rx(fixed.LAB_FINDING)) & ~F.col("text").rlike(rx(fixed.DIAGNOSIS_LIKE)))
    linked = findings.join(shows.select("note_id", F.col("start").alias("t")), "note_id").where("t < tail")
    linked = spans.best_of(linked, ["note_id", "start", "end"], F.desc("t"))
    made = lambda rows, **v: entities(rows, trusted=True, **v)
    rows = _union([
        made(cues.where("name = 'test'"), type=TEST, confidence=0.99, source="contextual_test_cue_v5"),
        made(cues.where("name = 'result'"), type=RESULT, confidence=0.96, source="contextual_result_cue_v5"),
        made(shows, type=TEST, confidence=0.99, source="contextual_test_cue_v5"),
        made(linked, type=RESULT, confidence=0.94, source="contextual_lab_finding_v5", linked_start=F.col("t")),
    ])
    return section_of(spans.best_of(rows, ["note_id", "start", "end", "type"], F.desc("confidence"), "source"), sections)


def result_windows(names: DataFrame, notes: DataFrame, reach: int = 130) -> DataFrame:
    """names with window, the text after each up to the next one, the line's end, a semicolon or reach characters, and window_end."""
    return _windows(spans.near(names, notes, reach, placed=True).withColumn("__line", _line_after(reach)).drop(NEAR))


def _line_after(reach: int = 130) -> Column:
    return F.regexp_extract(after(NEAR, "end", reach), r"^[^\n]*", 0)


def _windows(names: DataFrame) -> DataFrame:
    """As result_windows, of names with __line, what follows each in its line."""
    rows = names.withColumn("next_start", F.lead("start").over(Window.partitionBy("note_id").orderBy("start")))
    free = F.when(F.col("next_start").isNull(), F.col("__line")).otherwise(F.substring("__line", F.lit(1), F.greatest(F.col("next_start") - F.col("end"), F.lit(0))))
    window = F.regexp_extract(free, "^[^;]*", 0)
    return rows.withColumn("window", window).withColumn("window_end", (F.col("end") + F.length("window")).cast("int")).drop("__line")


def tests(notes: DataFrame, sections: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Names of tests by dictionary (surface, canonical, category, priority), and the result that follows each."""
    hits = lex.scan(notes, lexicon, reach=290)  # 160 for a bracket, 130 behind it
    low = F.lower(F.trim("surface"))
    around = before(NEAR, "start", 40)
    inside = F.concat(around, between(NEAR, "start", F.col("end") + 80)).rlike(rx(fixed.PROTECTED_NAME))
    hyphen = (before(NEAR, "start", 1) == "-") | (after(NEAR, "end", 1) == "-")
    hits = hits.where(~(low.isin(*fixed.CHEMICAL_PARTS) & (inside | hyphen)))
    bracket = F.length(F.regexp_extract(after(NEAR, "end", 160), r"(?U)^\s*\([^)]{0,98}\)", 0))
    hits = hits.withColumn("end", (F.col("end") + bracket).cast("int")).withColumn("text", between(NEAR, "start", "end")).withColumn("__line", _line_after()).drop(NEAR)
    names = _settled(section_of(_windows(spans.greedy(hits, -F.col("priority"), F.lower("surface"))), sections))
    own = entities(names, type=TEST, confidence=0.98, source="test_dictionary", canonical_name=F.col("canonical"))

    rows = names.where(F.trim("window") != "")
    lead = F.length(F.regexp_extract("window", rx(fixed.CONNECTOR), 0))
    rows = _settled(rows.withColumn("lead", lead)).withColumn("connector", F.regexp_extract("window", rx(fixed.CONNECTOR), 1)).withColumn("tail", F.expr("substring(window, lead + 1)"))
    number = F.regexp_extract("tail", rx(fixed.NUMERIC_RESULT), 1)
    sure = (F.col("connector") != "") | (F.regexp_extract("tail", rx(fixed.NUMERIC_RESULT), 3) != "") | number.rlike("[.,]") | (F.length(number) >= 2)
    numeric = F.when((F.col("category") == "laboratory") & (number != "") & sure, F.length(F.regexp_extract("tail", rx(fixed.NUMERIC_RESULT), 0))).otherwise(0)
    size = F.greatest(numeric, F.length(F.regexp_extract("tail", rx(fixed.QUALITATIVE_RESULT), 0)), F.length(F.regexp_extract("tail", rx(fixed.DESCRIPTIVE_RESULT), 0)))
    rows = rows.where(~F.col("tail").rlike(rx(fixed.COUNT))).withColumn("size", size)
    rows = _settled(rows).where("size > 0").withColumn("whole", F.expr("substring(tail, 1, size)"))
    rest = F.regexp_replace(F.regexp_replace("whole", rx(fixed.FROM_PREFIX), ""), r"(?U)^\s+", "")
    rows = rows.withColumn("own", F.regexp_replace(rest, r"(?U)\s+$", "")).withColumn("at", F.col("end") + F.col("lead") + F.col("size") - F.length(rest)).where("own <> ''")
    results = entities(rows, start=F.col("at"), end=F.col("at") + F.length("own"), text=F.col("own"), type=RESULT, confidence=0.93, source="test_result_rule", linked_start=F.col("start"))
    return own.unionByName(results)


def drugs(notes: DataFrame, sections: DataFrame, lexicon: DataFrame, policy: DataFrame) -> DataFrame:
    """Drugs by dictionary (surface, canonical, code), inside of words where a cue is glued to them, with strength and route."""
    hits = lex.scan_glued(notes, lexicon, reach=REACH)
    hits = hits.where(lex.glue_ok(NEAR, "start", "end", fixed.LEFT_GLUE, fixed.RIGHT_GLUE))
    more = F.regexp_extract(F.regexp_extract(after(NEAR, "end", 55), r"^[^\n;]*", 0), rx(f"^(?:{fixed.STRENGTH})?(?:{fixed.ROUTE}){{0,3}}"), 0)
    hits = hits.withColumn("__end", (F.col("end") + F.length(F.regexp_replace(more, r"(?U)\s+$", ""))).cast("int")).withColumn("text", between(NEAR, "start", "__end"))
    hits = hits.withColumn("__marks", inferred(F.lit(DRUG), text=NEAR)).drop(NEAR)
    rows = spans.greedy(hits, F.lower("surface")).withColumn("end", F.col("__end"))
    rows = with_policy(section_of(rows, sections), policy)
    code = F.when(F.col("code") != "", F.array("code")).otherwise(F.array().cast("array<string>"))
    marks = flagged(F.col("__marks"), DRUG, F.col("p_assertion_history"), F.col("p_assertion_family"))
    return entities(rows, type=DRUG, assertions=marks, candidates=code, confidence=0.97, source="drug_dictionary", canonical_name=F.col("canonical"))


def symptoms(notes: DataFrame, sections: DataFrame, lexicon: DataFrame, policy: DataFrame) -> DataFrame:
    """Symptoms by dictionary where the section's policy admits their priority, and lines of sections of symptoms."""
    hits = lex.scan(notes, lexicon, reach=REACH).withColumn("__marks", inferred(F.lit(SYMPTOM), text=NEAR)).drop(NEAR)
    hits = with_policy(section_of(hits, sections), policy).where("priority >= p_min_priority")
    rows = _settled(spans.greedy(hits, -F.col("priority"), F.lower("surface")))
    marks = flagged(F.col("__marks"), SYMPTOM, F.col("p_assertion_history"), F.col("p_assertion_family"))
    found = entities(rows, type=SYMPTOM, assertions=marks, confidence=0.94, source="symptom_dictionary", canonical_name=F.col("canonical"), needs_support=F.col("p_rule_trust") != "trusted")

    rows = _free_lines(notes, sections, policy).where("p_symptom_structural")
    body = F.regexp_replace("line", r"(?U)^\s*(?:[-*•]\s*)?", "")
    rows = rows.withColumn("at", F.col("start") + F.length("line") - F.length(body)).withColumn("body", F.regexp_replace(body, r"(?U)\s+$", ""))
    colon = F.expr("locate(':', body)")
    left, right = F.trim(F.expr("substring(body, 1, locate(':', body) - 1)")), F.regexp_replace(F.expr("substring(body, locate(':', body) + 1)"), r"(?U)^\s+", "")
    generic = (colon > 0) & F.lower(left).isin(*fixed.GENERIC_LABELS) & (right != "")
    rows = rows.withColumn("at", F.when(generic, F.col("at") + F.length("body") - F.length(right)).otherwise(F.col("at")))
    rows = _settled(rows.withColumn("body", F.when(generic, right).when((colon > 0) & (left != ""), left).otherwise(F.col("body"))))
    plain = F.regexp_replace("body", rx(fixed.NARRATIVE_PREFIX), "")
    rows = rows.withColumn("at", F.col("at") + F.length("body") - F.length(plain)).withColumn("body", F.regexp_replace(plain, rx(fixed.TIME_SUFFIX), ""))
    rows = _settled(_cleaned(rows))
    low = F.lower("body")
    good = F.length("body").between(2, 90) & ~low.isin(*fixed.GENERIC_LABELS, *fixed.MEASUREMENT_LABELS) & ~repeats_a_word("body")
    for pattern in (fixed.SYMPTOM_REJECT, fixed.SYMPTOM_DENIED, fixed.SYMPTOM_OTHER):
        good = good & ~F.col("body").rlike(rx(pattern))
    good = good & F.col("body").rlike(rx(fixed.SYMPTOM_CUE)) & (F.regexp_count("body", F.lit(",")) < 2) & ~F.col("body").contains(".")
    return found.unionByName(_fallback(rows.where(good), F.lit(""), F.col("line"), F.col("start"), found, SYMPTOM, 0.55, "symptom_section_fallback"))


def diagnoses(notes: DataFrame, sections: DataFrame, lexicon: DataFrame, policy: DataFrame) -> DataFrame:
    """Diagnoses by dictionary (surface, canonical, codes, priority), and items of lists in sections of diagnoses."""
    rows = lex.longest(notes, lexicon, -F.col("priority"), F.lower("surface"), reach=REACH).withColumn("__marks", inferred(F.lit(DIAGNOSIS), text=NEAR)).drop(NEAR)
    rows = _settled(with_policy(section_of(rows, sections), policy))
    marks = flagged(F.col("__marks"), DIAGNOSIS, F.col("p_assertion_history"), F.col("p_assertion_family"))
    found = entities(rows, type=DIAGNOSIS, assertions=marks, candidates=F.col("codes"), confidence=0.95, source="diagnosis_dictionary", canonical_name=F.col("canonical"))

    rows = _free_lines(notes, sections, policy).where("p_diagnosis_structural")
    body = F.regexp_replace("line", r"(?U)^\s*(?:[-*•]\s*)?", "")
    listed = F.col("line").rlike(r"(?U)^\s*[-*•]")
    plain = F.regexp_replace(body, rx(fixed.DIAGNOSIS_PREFIX), "")
    ahead = F.substring("line", F.lit(1), F.length("line") - F.length(plain))
    rows = rows.where(listed | (F.length(plain) < F.length(body))).withColumn("from", F.col("start") + F.length("line") - F.length(plain))
    rows = rows.select("note_id", "section", "p_assertion_history", "p_assertion_family", "from", F.substring(ahead, -REACH, REACH).alias("head"), F.posexplode(F.regexp_extract_all(plain, F.lit("[^;]+;?|^;+"), 0)).alias("i", "part"))
    rows = rows.withColumn("head", F.when(F.col("i") == 0, F.col("head")).otherwise(""))  # a semicolon ends what is read before the others
    w = Window.partitionBy("note_id", "from").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("from", F.col("from") + F.coalesce(F.sum(F.length("part")).over(w), F.lit(0)))
    own = F.regexp_replace("part", r"(?U)^\s+", "")
    rows = _settled(rows)
    rows = _cleaned(rows.withColumn("at", F.col("from") + F.length("part") - F.length(own)).withColumn("body", F.regexp_replace(own, ";+$", "")))
    rows = _settled(rows)
    good = F.length("body").between(4, 120) & ~repeats_a_word("body") & F.col("body").rlike(rx(fixed.DIAGNOSIS_CUE))
    for pattern in (fixed.DIAGNOSIS_REJECT, fixed.DIAGNOSIS_COURSE, fixed.DIAGNOSIS_THERAPY):
        good = good & ~F.col("body").rlike(rx(pattern))
    return found.unionByName(_fallback(rows.where(good), F.col("head"), F.col("part"), F.col("from"), found, DIAGNOSIS, 0.52, "diagnosis_section_fallback"))


def _free_lines(notes: DataFrame, sections: DataFrame, policy: DataFrame) -> DataFrame:
    """Lines without headers, with the section of their first character that is not white space."""
    rows = spans.lines(notes).withColumn("seen", F.col("start") + F.length("line") - F.length(F.regexp_replace("line", r"(?U)^\s+", "")))
    heads = sections.where("header_start < header_end").select(F.col("note_id").alias("__n"), "header_start", "header_end")
    met = (F.col("note_id") == F.col("__n")) & (F.greatest("start", "header_start") < F.least("end", "header_end"))
    return with_policy(section_of(rows.join(heads, met, "left_anti"), sections, "seen"), policy)


def _cleaned(rows: DataFrame) -> DataFrame:
    """body without white space in front and without punctuation behind; at moves along."""
    lead = F.regexp_replace("body", r"(?U)^\s+", "")
    rows = rows.withColumn("at", (F.col("at") + F.length("body") - F.length(lead)).cast("int"))
    return rows.withColumn("body", F.regexp_replace(F.regexp_replace(lead, r"(?U)\s+$", ""), r"(?U)[.;:,]+\s*$", "")).withColumn("body", F.regexp_replace("body", r"(?U)\s+$", ""))


def _fallback(rows: DataFrame, head: Column, own: Column, start: Column, known: DataFrame, kind: str, confidence: float, source: str) -> DataFrame:
    """Lines as entities that need support, where neither a known entity nor an earlier line overlaps them.

    own, which begins at start, holds at and body, and head is what stands before it in its clause: assertions are read in these, as
    no line break and no semicolon is passed on the way back from a span.
    """
    flags = ["p_assertion_history", "p_assertion_family"]
    held = F.struct(F.concat(F.repeat(F.lit("\n"), F.lit(REACH)), head, own).alias("text"), (start - F.length(head) - REACH).cast("int").alias("base"))
    rows = rows.select("note_id", "section", *flags, F.col("at").alias("start"), (F.col("at") + F.length("body")).cast("int").alias("end"), held.alias(NEAR)).where("start < end")
    rows = rows.withColumn("text", between(NEAR, "start", "end")).withColumn("__marks", inferred(F.lit(kind), text=NEAR)).drop(NEAR)
    rows = spans.greedy(spans.overlapping(rows, known, how="left_anti"))
    return entities(rows, type=kind, assertions=flagged(F.col("__marks"), kind, F.col(flags[0]), F.col(flags[1])), confidence=confidence, source=source, needs_support=True)


def rule_entities(notes: DataFrame, sections: DataFrame, resources: dict[str, DataFrame]) -> DataFrame:
    """All rules, in order (seq): structured, contextual, tests, drugs, symptoms, diagnoses."""
    policy = resources["policy"]
    made = [
        structured(notes, sections),
        contextual(notes, sections),
        tests(notes, sections, resources["tests"]),
        drugs(notes, sections, resources["drugs"], policy),
        symptoms(notes, sections, resources["symptoms"], policy),
        diagnoses(notes, sections, resources["diagnoses"], policy),
    ]
    return in_order(_union([m.withColumn("__k", F.lit(k)) for k, m in enumerate(made)]), "__k").drop("__k")


def in_order(rows: DataFrame, *first: str) -> DataFrame:
    """rows with seq, from 1 in each note: by first, then place, source and type."""
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("note_id").orderBy(*first, "start", "end", "source", "type", "text")))


__all__ = ["ENTITY", "entities", "rule_entities", "in_header"]
