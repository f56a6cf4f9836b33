"""Admission: each filter adds ``accepted`` and the first ``reason`` that holds; rows stay.

Support is looked for in other rows of the same note: ``r.start``, ``r.end``, ``r.type``. A
row is known by ``seq``; support by a row of the same seq and source is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartula.functions import fixed
from cartula.functions.fixed import DIAGNOSIS, DRUG, RESULT, SYMPTOM, TEST
from cartula.functions.text import after, before, between, clause_before, fold, mid_word, rx, squash
from cartula.operators import spans
from cartula.operators.sections import in_header

SHORT = (SYMPTOM, DIAGNOSIS)
RULE_MODES = ("all", "exact_only", "section_consensus")


def flag(rows: DataFrame, others: DataFrame, name: str, condition: Column, also: Column | None = None, shared: bool = False, reach: int | None = None) -> DataFrame:
    """rows with a boolean column: whether any of others (alias r) meets the condition with the row (alias l).

    shared says that the condition holds only for spans that share a character, reach that they must start so near.
    """
    key = ["note_id", "seq"]
    test = condition if also is None else condition & also
    met = spans.nearby(rows, others, reach, test) if reach else (spans.overlapping if shared else spans.joined)(rows, others, test)
    met = met.select(F.col("l.note_id").alias("note_id"), F.col("l.seq").alias("seq")).distinct()
    return rows.join(met.withColumn(name, F.lit(True)), key, "left").na.fill(False, [name])


def flags(rows: DataFrame, support: DataFrame | None, tests: dict, among: bool = False) -> DataFrame:
    """rows with boolean columns, as several calls of flag for spans that share a character would make them, but rows and support meet once and nothing is joined.

    tests has for each column a condition on support's rows, and a function of two spans (a row, one of support) that says whether the second
    backs the first. Without support rows themselves are, and with among they are as well. All lie in the stretches of their note that they touch, where each row looks
    through the list of what may back it; rows of one seq share what any of them has.
    """
    said = ["seq", "source", "start", "end", "type"]
    held, mine = F.struct(*said), rows.withColumn("__mine", F.lit(True))
    every = mine if support is None else mine.unionByName(support.withColumn("__mine", F.lit(False)), True)
    theirs = F.lit(True) if support is None or among else ~F.col("__mine")
    stretch = lambda at: F.floor(at / spans.STRETCH).cast("int")
    first = stretch(F.col("start"))
    every = every.withColumn("__at", F.explode_outer(F.sequence(first, F.greatest(first, stretch(F.col("end") - 1)))))
    near, own = Window.partitionBy("note_id", "__at"), Window.partitionBy("note_id", "seq")
    lists = {f"__l{k}": F.collect_list(F.when(theirs & which, held)).over(near) for k, (which, _) in enumerate(tests.values())}
    every = every.withColumns(lists).where("__mine").withColumn("__l", held)
    meets = lambda k, test: F.exists(f"__l{k}", lambda r: F.coalesce(test(F.col("__l"), r), F.lit(False)))
    every = every.withColumns({name: meets(k, test) for k, (name, (_, test)) in enumerate(tests.items())}).drop("__l", *lists)
    every = every.withColumns({name: F.coalesce(F.col("seq").isNotNull() & F.max(name).over(own), F.lit(False)) for name in tests})
    return every.where(F.col("__at").isNull() | (F.col("__at") == first)).select(*rows.columns, *tests)


def _other(a: Column, b: Column) -> Column:
    return (a["seq"] != b["seq"]) | (a["source"] != b["source"])


def _alike(a: Column, b: Column) -> Column:
    return a["type"] == b["type"]


def _one_span(a: Column, b: Column) -> Column:
    return (a["start"] == b["start"]) & (a["end"] == b["end"])


def _within(inner: Column, outer: Column) -> Column:
    return (outer["start"] <= inner["start"]) & (inner["end"] <= outer["end"]) & (F.greatest(inner["start"], outer["start"]) < F.least(inner["end"], outer["end"]))


def _shares(ratio: float):
    """Whether two spans of one type share a character, and so much of the shorter one."""

    def test(a, b):
        shared = F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"])
        return _alike(a, b) & (shared > 0) & (shared / F.greatest(F.lit(1), F.least(a["end"] - a["start"], b["end"] - b["start"])) >= ratio)

    return test


def backed(rows: DataFrame, name: str) -> DataFrame:
    """rows with a boolean column: whether another of them is trusted, has the type, and covers the row (or the row it) by four fifths."""
    alike = _shares(0.8)
    return flags(rows, None, {name: (trusted(), lambda a, b: alike(a, b) & _other(a, b))})


def _same_type() -> Column:
    return F.col("l.type") == F.col("r.type")


def _limits(values: dict[str, float], default: float, kind: str | Column = "type") -> Column:
    k = F.col(kind) if isinstance(kind, str) else kind
    out = F.lit(default)
    for name, v in values.items():
        out = F.when(k == name, F.lit(v)).otherwise(out)
    return out


def ladder(*rules: tuple[Column, str]) -> Column:
    """The name of the first rule that holds, or null."""
    out = F.when(rules[0][0], rules[0][1])
    for condition, name in rules[1:]:
        out = out.when(condition, name)
    return out


def decided(rows: DataFrame, reason: Column, accepted: Column | str = "accepted") -> DataFrame:
    rows = rows.withColumn("reason", reason)
    rows = rows.withColumn("accepted", F.col("reason").isNull())
    return rows.withColumn("reason", F.coalesce("reason", F.lit(accepted) if isinstance(accepted, str) else accepted))


def _n_words(c: str = "text") -> Column:
    return F.when(squash(c) == "", 0).otherwise(F.size(F.split(squash(c), " ")))


def _marks(c: str = "text") -> Column:
    return F.regexp_count(c, F.lit("[,;:]"))


def first_exact_support(rows: DataFrame, others: DataFrame, name: str) -> DataFrame:
    """rows with name, the first of others (by seq) that has the type and start, and the end but for up to two marks; null without."""
    text, other = F.col("l.text"), F.col("r.text")
    longer, shorter = F.when(F.col("r.end") > F.col("l.end"), other).otherwise(text), F.when(F.col("r.end") > F.col("l.end"), text).otherwise(other)
    tail = F.substring(longer, F.length(shorter) + 1, F.length(longer))
    close = (F.abs(F.col("r.end") - F.col("l.end")) <= 2) & F.startswith(longer, shorter) & tail.rlike(r"(?U)^[\s.;:,]+$")
    met = spans.joined(rows, others, _same_type() & (F.col("l.start") == F.col("r.start")) & ((F.col("l.end") == F.col("r.end")) | close))
    one = met.groupBy(F.col("l.note_id").alias("note_id"), F.col("l.seq").alias("seq")).agg(F.min(F.struct(F.col("r.seq").alias("seq"), F.col("r.confidence").alias("confidence"), F.col("r.source").alias("source"))).alias(name))
    return rows.join(one, ["note_id", "seq"], "left")


def rules(rows: DataFrame, baseline: DataFrame, ner: DataFrame, thresholds: dict[str, float] | None = None, mode: str = "section_consensus") -> DataFrame:
    """Rules that need support are admitted in mode all; never in exact_only; in section_consensus where the baseline, or
    the first row of a model (if sure enough), has the same span and type. Others are admitted."""
    if mode not in RULE_MODES:
        raise ValueError(f"no such mode: {mode}")
    structural = F.endswith("source", F.lit("_fallback"))
    needs = structural | F.coalesce("needs_support", F.lit(False))
    name = lambda a, b: F.when(structural, a).otherwise(b)
    if mode == "section_consensus":
        rows = first_exact_support(first_exact_support(rows, baseline, "__base"), ner, "__ner")
        sure = F.col("__ner.confidence") >= _limits(thresholds or {}, 0.95)
        reason = F.when(~needs, "trusted_exact_rule").when(F.col("__base").isNotNull(), "structural_exact_baseline_support").when(sure, "structural_exact_vihealth_support")
        reason = reason.otherwise(name("structural_rule_requires_independent_support", "context_rule_requires_independent_support"))
        ok = ~needs | F.col("__base").isNotNull() | F.coalesce(sure, F.lit(False))
    else:
        ok = ~needs | F.lit(mode == "all")
        reason = F.when(ok, "trusted_exact_rule").otherwise(name("structural_rule_disabled", "context_rule_disabled"))
    return rows.withColumn("accepted", ok).withColumn("reason", reason).drop("__base", "__ner")


def tokens_model(rows: DataFrame, rule_rows: DataFrame, llm_rows: DataFrame, anchors: DataFrame, thresholds: dict[str, float], uncorroborated: set[str], ratio: float, max_chars=None, max_words=None, exact: bool = False) -> DataFrame:
    """Spans of a token classifier: conflict, shape, threshold, corroboration."""
    pool = rule_rows.unionByName(llm_rows, True).unionByName(anchors, True)
    near = _same_type() & (spans.overlap_ratio("l", "r") >= ratio)
    for name, others in (("by_rule", rule_rows), ("by_llm", llm_rows), ("by_anchor", anchors)):
        rows = flag(rows, others, f"corroborated_{name}", near, shared=True)
    rows = flag(rows, pool, "exact_support", spans.same_span("l", "r"), _same_type())
    rows = flag(rows, pool, "__conflict", spans.same_span("l", "r"), ~_same_type())
    own, norm, short = F.trim("text"), fold("text"), F.col("type").isin(*SHORT)
    some = F.col("corroborated_by_rule") | F.col("corroborated_by_llm") | F.col("corroborated_by_anchor")
    good = F.col("exact_support") if exact else some
    reason = ladder(
        (F.col("__conflict"), "same_span_cross_type_conflict"),
        (F.length(own) < 2, "span_too_short"),
        (F.length(own) > _limits(max_chars or fixed.NER_CHARS, 80), "span_too_long"),
        (_n_words() > _limits(max_words or fixed.NER_WORDS, 10), "too_many_words"),
        (short & norm.rlike(rx(fixed.NER_ACTION)), "action_or_advice"),
        ((F.col("type") == SYMPTOM) & norm.rlike(rx(fixed.NER_GENERIC)), "generic_or_nonclinical_symptom"),
        (short & own.contains("\n"), "multiline_span"),
        (short & (_marks() >= 2), "clause_like_span"),
        (F.col("confidence") < _limits(thresholds, 0.95), "below_type_threshold"),
        (~good & ~F.col("type").isin(*uncorroborated), "corroboration_required"),
    )
    accepted = F.when(good, "exactly_corroborated" if exact else "corroborated").otherwise("high_confidence_uncorroborated_allowed")
    return decided(rows, reason, accepted).drop("__conflict")


def span_model(rows: DataFrame, support: DataFrame, thresholds: dict[str, float], uncorroborated: set[str], ratio: float = 0.45, max_chars=None, max_words=None, exact: bool = False) -> DataFrame:
    """Spans of a span model: threshold, length, line breaks, corroboration."""
    rows = flag(rows, support, "exact_support", spans.same_span("l", "r"), _same_type())
    rows = flag(rows, support, "corroborated", _same_type() & (spans.overlap_ratio("l", "r") >= ratio), shared=True)
    reason = ladder(
        (F.col("confidence") < _limits(thresholds, 0.75), "below_threshold"),
        (F.length("text") > _limits(max_chars or {}, 100), "span_too_long"),
        (_n_words() > _limits(max_words or {}, 16), "too_many_words"),
        (F.col("text").contains("\n"), "multiline"),
        (~F.col("exact_support" if exact else "corroborated") & ~F.col("type").isin(*uncorroborated), "corroboration_required"),
    )
    return decided(rows, reason)


def language_model(rows: DataFrame, support: DataFrame, least: float = 0.74, uncorroborated: set[str] = frozenset(), ratio: float = 0.55, max_chars=None, max_words=None, exact: bool = False) -> DataFrame:
    """Spans of a language model; support is the rules' and other models' rows."""
    rows = flag(rows, support, "exact_support", spans.same_span("l", "r"), _same_type())
    rows = flag(rows, support, "corroborated", _same_type() & (spans.overlap_ratio("l", "r") >= ratio), shared=True)
    rows = flag(rows, support, "__conflict", spans.same_span("l", "r"), ~_same_type())
    every = support.select("note_id", "seq", "source", "start", "end", "type").unionByName(rows.select("note_id", "seq", "source", "start", "end", "type"))
    other = (F.col("l.seq") != F.col("r.seq")) | (F.col("l.source") != F.col("r.source"))
    rows = flag(rows, every.where(F.col("type") == TEST), "__near", other, reach=300)
    own, norm, kind = F.trim("text"), fold("text"), F.col("type")
    short, says = kind.isin(*SHORT), lambda p, c=norm: c.rlike(rx(p))
    reason = ladder(
        (F.col("confidence") < least, "below_confidence"),
        (says(fixed.LLM_GENERIC), "generic_phrase"),
        (F.length(own) > _limits(max_chars or fixed.LLM_CHARS, 80), "span_too_long"),
        (_n_words() > _limits(max_words or fixed.LLM_WORDS, 10), "too_many_words"),
        (own.contains("\n"), "multiline_span"),
        (short & (_marks() >= 2), "clause_like_span"),
        (short & says(fixed.LLM_ACTION), "action_or_advice"),
        ((kind == SYMPTOM) & says(fixed.LLM_LIFESTYLE), "lifestyle_or_trigger"),
        ((kind == DIAGNOSIS) & says(fixed.LLM_PROCEDURE), "procedure_not_diagnosis"),
        ((kind == DIAGNOSIS) & (says(fixed.DOSE, own) | says(fixed.LLM_TEST, own) | says(fixed.LLM_RESULT)), "diagnosis_looks_like_other_type"),
        ((kind == DRUG) & (says(fixed.LLM_TEST, own) | says(fixed.LLM_RESULT)), "drug_looks_like_test_or_result"),
        ((kind == TEST) & (says(fixed.DOSE, own) | says(fixed.LLM_RESULT)), "test_looks_like_result_or_dose"),
        ((kind == RESULT) & ~F.col("__near") & ~F.coalesce(says(fixed.LLM_TEST, F.col("context")), F.lit(False)), "result_without_test_context"),
        (F.col("__conflict"), "same_span_supported_type_conflict"),
        (~F.col("exact_support" if exact else "corroborated") & ~kind.isin(*uncorroborated), "exact_corroboration_required" if exact else "corroboration_required"),
    )
    return decided(rows, reason, F.when(F.col("exact_support"), "exactly_corroborated").otherwise("accepted")).drop("__conflict", "__near")


# --- Fixed values: the older filter -----------------------------------------------------------
OLD_ACTION = r"^(?:được\s+|tiếp\s+tục\s+|hẹn\s+|tái\s+khám|theo\s+dõi|điều\s+trị|chỉ\s+định|thực\s+hiện|chuyển\s+đến|nhập\s+viện)"
OLD_TEST = r"\b(?:xét\s+nghiệm|chụp|x-?quang|ct\b|mri\b|siêu\s+âm|điện\s+tâm\s+đồ|ecg\b|holter|nội\s+soi|sinh\s+thiết|khám\s+chuyên\s+khoa|đánh\s+giá\s+lâm\s+sàng)\b"
OLD_DIAGNOSIS = r"\b(?:bệnh|viêm|ung\s+thư|u\s+ác|suy|hẹp|hở|tắc|rung|xơ|hội\s+chứng|rối\s+loạn|nhiễm|xuất\s+huyết|nhồi\s+máu|gãy|tràn\s+dịch|thoát\s+vị|loét|áp\s+xe|đái\s+tháo|béo\s+phì|gút|liệt)\b"
OLD_GENERIC = r"^(?:tình\s+trạng|triệu\s+chứng|bất\s+thường|kết\s+quả|đánh\s+giá|thăm\s+khám|sự\s+kiện)$"
OLD_COUNT = r"^(?:x\s*)?\d+\s*(?:mẫu|lần|lọ|viên)?$"
OLD_LIFESTYLE = r"^(?:uống|ăn|hút|sử\s+dụng|tiêu\s+thụ|\d+\s*(?:tách|ly|cốc))\b.*\b(?:cà\s+phê|caffeine|rượu|bia|thuốc\s+lá|shisha)\b"
OLD_GENERIC_SYMPTOM, OLD_GENERIC_TEST = r"^(?:triệu\s+chứng|tình\s+trạng|biểu\s+hiện)$", r"^(?:hình\s+ảnh|kết\s+quả|xét\s+nghiệm|đánh\s+giá)$"
OLD_STRONG_RESULT = r"^(?:âm\s+tính|dương\s+tính|không\s+(?:ghi\s+nhận|phát\s+hiện|thấy|có))"
OLD_DRUG_PHRASES, OLD_DIAGNOSIS_SECTIONS = ("thuốc", "dùng thuốc", "đơn thuốc", "thuốc điều trị"), ("PAST_HISTORY", "DIAGNOSIS", "DIAGNOSIS_EXTRA", "DOCUMENT_RECORD")
# --- End of fixed values ----------------------------------------------------------------------


def language_model_old(rows: DataFrame, rule_rows: DataFrame, notes: DataFrame) -> DataFrame:
    """The older pipeline's filter of a language model's spans, by type."""
    half, exact, is_in = spans.overlap_ratio("l", "r") >= 0.5, spans.same_span("l", "r"), lambda *t: F.col("r.type").isin(*t)
    rows = flag(rows, rule_rows, "__exact", exact, is_in(DRUG, TEST, RESULT))
    rows = flag(rows, rule_rows, "__half", half, is_in(DRUG, TEST, RESULT), shared=True)
    rows = flag(rows, rule_rows, "__exact_name", exact, is_in(DRUG, TEST))
    rows = flag(rows, rule_rows, "__exact_test", exact, is_in(TEST))
    rows = flag(rows, rule_rows, "__half_drug", half, is_in(DRUG), shared=True)
    rows = flag(rows, rule_rows, "__wider", spans.contains("l", "r") & ~exact, is_in(SYMPTOM), shared=True)
    cols = ["note_id", "start", "end", "text", "type"]
    every = rule_rows.select(*cols).unionByName(rows.select(*cols)).where(F.col("type") == TEST)
    # Line breaks before a place: their difference says how many lie between two.
    breaks = lambda at: F.regexp_count(between("__note", F.lit(0), at), F.lit("\n"))
    placed = lambda rows: spans.with_text(rows, notes).withColumns({"__a": breaks("start"), "__z": breaks("end")}).drop("__note")
    near = spans.nearby(placed(rows.where(F.col("type") == RESULT).select("note_id", "seq", "start", "end")), placed(every), 450, ~exact)
    near = near.where(F.greatest("l.__z", "r.__z") - F.least("l.__a", "r.__a") <= 1).select("l.note_id", "l.seq").distinct().withColumn("__near", F.lit(True))
    rows = rows.join(near, ["note_id", "seq"], "left").na.fill(False, ["__near"])
    told = rows.where(F.trim(F.coalesce("context", F.lit(""))) != "").select("note_id", "seq", "context")
    named_in = spans.joined(told, every, (F.length("r.text") >= 3) & F.lower("l.context").contains(F.lower("r.text"))).select("l.note_id", "l.seq").distinct().withColumn("__named", F.lit(True))
    rows = rows.join(named_in, ["note_id", "seq"], "left").na.fill(False, ["__named"])
    own, norm, kind = F.trim("text"), fold("text"), F.col("type")
    says = lambda p, c=norm: F.coalesce(c.rlike(rx(p)), F.lit(False))
    named = F.trim(F.coalesce("normalized", F.lit(""))) != ""
    cued, support = says(OLD_DIAGNOSIS, own), F.col("__near") | says(OLD_TEST, F.col("context")) | F.col("__named")
    dosed, resulting = says(fixed.DOSE, own), says(fixed.LLM_RESULT)
    dx, sx, rx_, tx, res = (kind == k for k in (DIAGNOSIS, SYMPTOM, DRUG, TEST, RESULT))
    reason = ladder(
        (dx & says(OLD_GENERIC), "generic_phrase"),
        ((F.length(own) > 180) & ~res, "span_too_long"),
        (~kind.isin(RESULT, TEST) & (F.regexp_count(own, F.lit("[.;]")) >= 2), "multi_sentence_span"),
        (~res & says(OLD_COUNT), "numeric_or_count_only"),
        (dx & (F.col("__exact") | (F.col("__half") & ~named & ~cued)), "diagnosis_conflicts_with_rule_type"),
        (dx & (dosed | resulting | says(OLD_TEST, own)), "diagnosis_looks_like_drug_test_or_result"),
        (dx & says(OLD_ACTION), "diagnosis_is_action_or_plan"),
        (dx & ~named & ~cued & ~F.col("section").isin(*OLD_DIAGNOSIS_SECTIONS), "diagnosis_without_support"),
        (sx & F.col("__exact_name"), "symptom_exact_conflict"),
        (sx & says(OLD_LIFESTYLE), "symptom_is_lifestyle_exposure"),
        (sx & says(OLD_GENERIC_SYMPTOM), "generic_symptom_phrase"),
        (sx & F.col("__wider"), "symptom_broader_than_rule_span"),
        (sx & (dosed | own.rlike(rx(f"^{OLD_TEST}$"))), "symptom_looks_like_drug_or_test"),
        (rx_ & norm.isin(*OLD_DRUG_PHRASES), "generic_drug_phrase"),
        (rx_ & F.col("__exact_test"), "drug_conflicts_with_test"),
        (rx_ & (says(OLD_TEST, own) | resulting), "drug_looks_like_test_or_result"),
        (tx & says(OLD_GENERIC_TEST), "generic_test_phrase"),
        (tx & F.col("__half_drug"), "test_conflicts_with_drug"),
        (tx & (resulting | dosed), "test_looks_like_result_or_dose"),
        (res & says(OLD_COUNT) & ~support, "sample_count_not_result"),
        (res & ~support & ~says(OLD_STRONG_RESULT), "result_without_nearby_test"),
    )
    return decided(rows, reason).select(*[c for c in rows.columns if not c.startswith("__")], "accepted", "reason")


def false_friend(text: str = "__note", own: Column | None = None) -> Column:
    """Why a word is not what it looks like, by what stands on either side; null if it is."""
    n = fold(between(text, "start", "end"), " :;,.") if own is None else own
    left, right = F.lower(before(text, "start", 18)), F.lower(after(text, "end", 18))
    rules_ = []
    for word, front, back, name in fixed.FALSE_FRIENDS:
        met = n == word
        met = met & left.rlike(rx(front)) if front else met
        rules_.append((met & right.rlike(rx(back)) if back else met, name))
    return ladder(*rules_)


def protected(text: str = "__note") -> Column:
    """Whether a test or result stands inside of the name of an enzyme that is protected."""
    left, own, right = before(text, "start", 40), between(text, "start", "end"), after(text, "end", 80)
    marked = F.concat(left, F.lit("\u0001"), own, F.lit("\u0002"), right)
    loose = r"[\x{1}\x{2}]?"
    name = "".join(rf"{c}{loose}" for c in "glucose") + rf"[-\s]*{loose}6{loose}[-\s]*" + "".join(rf"{c}{loose}" for c in "phosphate") + r"\s+" + loose + "".join(rf"{c}{loose}" for c in "dehydrogenase")
    whole = F.regexp_extract(marked, rx(f"{loose}{name}"), 0)
    return F.col("type").isin(TEST, RESULT) & whole.contains("\u0001") & whole.contains("\u0002")


def trusted() -> Column:
    return F.col("source").rlike(f"^(?:{'|'.join(fixed.TRUSTED_SOURCES)})") | F.coalesce("trusted", F.lit(False))


def semantic_gate(rows: DataFrame, context: DataFrame, sections: DataFrame, notes: DataFrame, least: float = 0.88, strict: bool = False) -> DataFrame:
    """The last gate before merging: 22 reasons, and two repairs of types that keep the row.

    Support is judged on the rows as they come, so no row sees another's repair. With strict,
    alternatives of several words in the action and conjunction lists never match.
    """
    heads = in_header(rows.select("note_id", "seq", "source", "start", "end"), sections).select("note_id", "seq", "source").distinct().withColumn("__head", F.lit(True))
    source, alike = F.col("source"), _shares(0.8)
    inside = lambda a, b: _within(a, b) & _other(a, b)
    rows = flags(rows, context, {
        "__trusted": (trusted(), lambda a, b: alike(a, b) & _other(a, b)),
        "__exact": (F.lit(True), lambda a, b: _one_span(a, b) & _alike(a, b) & _other(a, b)),
        "__in_test": (source == "contextual_test_cue_v5", inside),
        "__in_result": (source.isin("contextual_result_cue_v5", "contextual_lab_finding_v5"), inside),
    }, among=True)
    rows = spans.with_text(rows.join(heads, ["note_id", "seq", "source"], "left").na.fill(False, ["__head"]), notes)
    n, kind, text = fold("text", " :;,.\t\n"), F.col("type"), F.col("text")
    short, neural = kind.isin(*SHORT), F.col("source").rlike(f"^(?:{'|'.join(fixed.NEURAL_SOURCES)})")
    action, conj = (p.replace("không nên|", "").replace("|mặc dù|tuy nhiên|sau đó|đồng thời", "") if strict else p for p in (fixed.GATE_ACTION, fixed.GATE_CONJUNCTION))
    shows = clause_before("__note", "start", 140, r".\n").rlike(rx(fixed.SHOWS_BEFORE))
    modality = n.rlike(rx(fixed.GATE_MODALITY)) & (kind != TEST)
    finding = n.rlike(rx(fixed.GATE_FINDING)) & (kind == SYMPTOM) & shows
    lone, corroborated = ~F.col("__trusted"), F.coalesce(F.col("corroborated") if "corroborated" in rows.columns else F.lit(False), F.lit(False))
    first = ladder(
        (false_friend(own=n).isNotNull(), ""),
        (F.col("__head") | n.isin(*fixed.HEADING_TERMS), "heading_or_task_label"),
        (protected(), "component_of_protected_biochemical_name"),
        (F.col("__in_test") & (kind == DIAGNOSIS), "diagnosis_nested_inside_explicit_test"),
        (F.col("__in_result") & (kind == DIAGNOSIS), "diagnosis_nested_inside_explicit_result"),
        (n.isin(*fixed.FIELD_LABELS) & short, "field_label"),
        (F.col("section").isin("FAQ_RISK_FACTORS", "RISK_FACTORS") & (n.isin(*fixed.RISK_TERMS) | short) & lone, "risk_factor_not_target_entity"),
        (modality, "repair:imaging_modality_to_test"),
        (finding, "repair:lab_finding_to_result"),
        (n.isin(*fixed.FRAGMENTS) & lone, "known_boundary_fragment"),
        (n.isin(*fixed.GENERIC_CLINICAL) & lone, "generic_clinical_term"),
        (short & ((_n_words() > 14) | text.rlike(rx(conj))), "long_clause_like_span"),
        (short & n.rlike(rx(action)), "action_or_advice"),
        (short & n.rlike(rx(fixed.GATE_PROCEDURE)), "procedure_not_target_entity"),
        (short & n.rlike(rx(fixed.GATE_MECHANISM)), "mechanism_not_target_entity"),
        ((F.col("source") == "structured_symptom_attribute") & lone, "symptom_attribute_needs_model_support"),
        ((kind == TEST) & n.startswith("thuốc "), "drug_not_test"),
        ((kind == DIAGNOSIS) & n.isin("chẩn đoán hình ảnh", "xét nghiệm", "kết quả"), "generic_task_not_diagnosis"),
        ((kind == RESULT) & n.rlike(rx(fixed.MISSED_DETECTION)), "missed_detection_not_test_result"),
        (neural & (kind == SYMPTOM) & (_n_words() == 1) & ~n.isin(*fixed.ONE_WORD_SYMPTOMS) & lone, "unsupported_one_token_symptom"),
        (neural & short & (F.length(n) < 4) & lone, "unsupported_short_neural_span"),
        (neural & lone & ~F.col("__exact") & ~corroborated & (F.col("confidence") < least), "uncorroborated_neural_below_gate"),
    )
    first = F.when(F.col("source") == "baseline_anchor", None).otherwise(F.when(first == "", false_friend(own=n)).otherwise(first))
    rows = rows.withColumn("__r", first)
    repair = F.coalesce(F.col("__r").startswith("repair:"), F.lit(False))
    to = F.when(F.col("__r") == "repair:imaging_modality_to_test", TEST).otherwise(RESULT)
    out = rows.withColumn("__repair", repair).withColumn("type", F.when(repair, to).otherwise(kind))
    out = out.withColumn("source", F.when(F.col("__repair"), F.concat("source", F.lit("_type_repaired"))).otherwise(F.col("source")))
    out = out.withColumn("assertions", F.when(F.col("__r") == "repair:lab_finding_to_result", F.array().cast("array<string>")).otherwise(F.col("assertions")))
    out = out.withColumn("accepted", F.col("__r").isNull() | F.col("__repair")).withColumn("reason", F.when(F.col("__repair"), "type_repaired").otherwise(F.coalesce("__r", F.lit("accepted"))))
    return out.select(*[c for c in out.columns if not c.startswith("__")])


def cleanup(rows: DataFrame, repair: bool = True, generic: bool = True, conflicts: bool = True) -> DataFrame:
    """Neural spans: labels and known conflicts of category dropped, known types repaired; action and reason say which."""
    n, neural = fold("text", " .,:;()[]{}"), F.col("source").rlike(f"^(?:{'|'.join(fixed.CLEANUP_SOURCES)})")
    listed = lambda pairs: F.array_contains(F.array(*[F.lit(f"{t}\t{v}") for t, v in pairs]), F.concat("type", F.lit("\t"), n))
    repairs = F.create_map(*[F.lit(x) for v, t, to in fixed.TYPE_REPAIRS for x in (f"{t}\t{v}", to)])
    to = F.when(neural & F.lit(repair), F.element_at(repairs, F.concat("type", F.lit("\t"), n)))
    reason = F.when(neural & F.lit(generic) & listed(fixed.GENERIC_BY_TYPE), "generic_field_or_section_label")
    reason = reason.when(neural & F.lit(conflicts) & listed(fixed.DROP_BY_TYPE), "known_category_type_conflict").when(to.isNotNull(), "trusted_exact_type_repair").otherwise("unchanged")
    rows = rows.withColumn("reason", reason).withColumn("before_type", F.col("type")).withColumn("__to", to)
    action = F.when(F.col("reason") == "unchanged", "keep").when(F.col("reason") == "trusted_exact_type_repair", "repair").otherwise("drop")
    rows = rows.withColumn("action", action).withColumn("accepted", action != "drop")
    rows = rows.withColumn("candidates", F.when(F.col("action") == "repair", F.array().cast("array<string>")).otherwise(F.col("candidates")))
    return rows.withColumn("type", F.when(F.col("action") == "repair", F.col("__to")).otherwise(F.col("type"))).drop("__to")


def unsafe(sources=("self_host_llm", "vihealthbert", "gliner")) -> Column:
    """Spans that a verifier looks at: of these sources, or of sources that begin like them."""
    return F.col("source").rlike(f"^(?:{'|'.join(sources)})")


def verified(rows: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """rows after a verifier's decisions (note_id, seq, keep, type); without one a risky row needs a confidence of 0.96 and two words."""
    if decisions is None:
        rows = rows.withColumn("__keep", F.lit(None).cast("boolean")).withColumn("__type", F.lit(None).cast("string"))
    else:
        rows = rows.join(decisions.select("note_id", "seq", F.col("keep").alias("__keep"), F.col("type").alias("__type")), ["note_id", "seq"], "left")
    sure = (F.col("confidence") >= 0.96) & (_n_words() >= 2)
    ok = F.when(~unsafe(), True).otherwise(F.coalesce("__keep", sure))
    reason = F.when(~unsafe(), "safe_source").when(F.col("__keep").isNull(), F.when(sure, "no_decision_but_sure").otherwise("no_decision")).when(F.col("__keep"), "kept").otherwise("rejected")
    kind = F.when(unsafe() & F.col("__type").isin(*fixed.TYPES), F.col("__type")).otherwise(F.col("type"))
    return rows.withColumn("accepted", ok).withColumn("reason", reason).withColumn("type", kind).drop("__keep", "__type")


def high(rows: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Rows that are sure enough to support others."""
    return rows.where(F.col("confidence") >= _limits(thresholds, 0.95))


def promoted(rows: DataFrame, support: DataFrame, to: float = 0.84) -> DataFrame:
    """rows whose span and type an independent model has, with a confidence of at least to."""
    return flag(rows, support, "__p", spans.same_span("l", "r") & _same_type()).withColumn("confidence", F.when(F.col("__p"), F.greatest("confidence", F.lit(to))).otherwise(F.col("confidence"))).drop("__p")


def rescued(rules_: DataFrame, llm: DataFrame, least: float = 0.7) -> DataFrame:
    """Rules that are sure or not fallbacks, and those that a language model's span of their type overlaps."""
    weak = (F.col("confidence") < least) | F.endswith("source", F.lit("_fallback"))
    backed = flag(rules_.where(weak), llm, "__met", spans.overlaps("l", "r"), _same_type(), shared=True).where("__met").drop("__met")
    return rules_.where(~weak).unionByName(backed)


def bad_anchor() -> Column:
    """Why a prior prediction is dropped before repair; null if it is kept. Reads __note."""
    own = F.trim("text")
    tiny = F.col("type").isin(SYMPTOM, DIAGNOSIS, DRUG) & (F.length(own) <= 2) & own.rlike(r"(?U)^\p{L}+$") & ~F.lower(own).isin(*fixed.SHORT_ANCHORS)
    return ladder(
        (false_friend(own=F.lower(own)).isNotNull(), "false_friend"),
        ((F.col("type") == DIAGNOSIS) & F.lower(own).isin(*fixed.DIAGNOSIS_FRAGMENTS), "generic_baseline_diagnosis_fragment"),
        (protected(), "component_of_protected_biochemical_name"),
        (mid_word("__note", "start", "end"), "baseline_midword_fragment"),
        (tiny, "baseline_too_short_alpha_fragment"),
    )
