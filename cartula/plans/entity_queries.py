"""Queries over proposals of entities: admission, merging, linking and text around spans, and the SQL that says the same.

Proposals are hits of the corpus' lexicon, three of each, with types, sources and confidences
made from their places, so that sources agree and contradict one another. Patterns for
Vietnamese phrases are part of the operators, but match little in these texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartula.functions import fixed, text
from cartula.functions.fixed import DIAGNOSIS, DRUG, RESULT, SYMPTOM, TEST, TYPES
from cartula.operators import assertions, extract, filters, lexicon, linking, merge, models, sections, spans, windows
from cartula.plans import queries as base
from cartula.session import keep

SOURCES = ("baseline_anchor", "symptom_dictionary", "diagnosis_section_fallback", "vihealthbert", "phobert", "gliner", "self_host_llm")
METHODS = ("icd_alias_exact", "icd_bm25_calibrated", "icd_embedding_calibrated", "rxnorm_exact", "rxnorm_clinical_strength", "icd_hybrid_reranker", "icd_blacklisted")


def proposals(spark, sf_dir, again: bool = False) -> DataFrame:
    """Entities with seq, three of each hit; seq tells those of a note apart. If they are read again, the hits are kept: what is made of them is many times their size."""
    notes = base._notes(spark, sf_dir)
    found = keep(lexicon.scan(lexicon.dealt(notes), base.corpus_lexicon(notes)).select("note_id", "start", "end", "text", "surface")) if again else lexicon.together(base._hits(spark, sf_dir), notes)
    hits = found.withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    w = F.length("surface")
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))
    rows = hits.withColumn("seq", (F.col("start") * 100 + w) * 3 + F.col("k"))
    made = extract.entities(
        rows.withColumn("__seq", F.col("seq")), type=pick(TYPES, F.col("start") * 7 + w * 3 + F.col("k") * (F.col("start") % 2)), source=pick(SOURCES, F.col("start") * 5 + w + F.col("k") * 2),
        confidence=((F.col("start") * 11 + w * 17 + F.col("k") * 7) % 50 + 50) / 100.0, needs_support=(F.col("start") + w) % 3 == 0, normalized=F.col("seq").cast("string"),
        candidates=F.when(F.col("start") % 4 == 0, F.array(F.upper("surface"))).otherwise(F.array().cast("array<string>")), link_method=pick(METHODS, F.col("start") + F.col("k")),
    )
    return made.withColumn("seq", F.col("normalized").cast("int")).withColumn("normalized", F.lit(None).cast("string"))


def _of(rows: DataFrame, *sources: str) -> DataFrame:
    return rows.where(F.col("source").isin(*sources))


def _models(spark, sf_dir):
    rows = proposals(spark, sf_dir, again=True)
    return (_of(rows, "symptom_dictionary", "diagnosis_section_fallback"), *(_of(rows, s) for s in ("baseline_anchor", "vihealthbert", "phobert", "gliner", "self_host_llm")))


def _told(rows: DataFrame, *columns) -> DataFrame:
    return rows.select(F.col("note_id").alias("doc_id"), "seq", *columns)


def _judged(rows: DataFrame) -> DataFrame:
    return _told(rows, "accepted", "reason")


THRESHOLDS = {SYMPTOM: 0.6, DIAGNOSIS: 0.7, TEST: 0.8, RESULT: 0.65, DRUG: 0.75}


def rule_admission(spark, sf_dir):
    raw, anchors, vh, ph, gl, _ = _models(spark, sf_dir)
    return _judged(filters.rules(raw, anchors, vh.unionByName(ph).unionByName(gl), THRESHOLDS))


def token_model_admission(spark, sf_dir):
    raw, anchors, vh, _, _, llm = _models(spark, sf_dir)
    return _judged(filters.tokens_model(vh, raw, llm, anchors, THRESHOLDS, {RESULT}, 0.4))


def span_model_admission(spark, sf_dir):
    raw, anchors, _, _, gl, llm = _models(spark, sf_dir)
    return _judged(filters.span_model(gl, raw.unionByName(anchors).unionByName(llm), THRESHOLDS, {RESULT}, 0.45, {}, {}))


def language_model_admission(spark, sf_dir):
    raw, anchors, _, _, _, llm = _models(spark, sf_dir)
    return _judged(filters.language_model(llm, raw.unionByName(anchors), 0.68, {SYMPTOM}, 0.4))


def cleanup_decisions(spark, sf_dir):
    """Entities that are called by listed names, by their places, after cleanup."""
    names = [v for _, v in fixed.GENERIC_BY_TYPE + fixed.DROP_BY_TYPE] + [v for v, _, _ in fixed.TYPE_REPAIRS] + ["sonst"]
    rows = proposals(spark, sf_dir).withColumn("text", F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("start") % len(names) + 1).cast("int")))
    return _told(filters.cleanup(rows), "action", "reason", "before_type", "type")


def verifier_decisions(spark, sf_dir):
    """Decisions of a verifier on a third of all spans, and what holds without one."""
    rows = proposals(spark, sf_dir)
    made = rows.where("seq % 3 = 0").select("note_id", "seq", (F.col("start") % 2 == 0).alias("keep"), F.when(F.col("start") % 5 == 0, F.lit(DRUG)).otherwise("?").alias("type"))
    return _told(filters.verified(rows, made), "accepted", "reason", "type")


def consensus_promotion(spark, sf_dir):
    _, _, vh, ph, _, llm = _models(spark, sf_dir)
    return _told(filters.promoted(llm, filters.high(vh.unionByName(ph), THRESHOLDS), 0.84), "confidence")


def weak_rule_rescue(spark, sf_dir):
    raw, _, _, _, _, llm = _models(spark, sf_dir)
    return _told(filters.rescued(raw, llm, 0.7))


def exact_support_flags(spark, sf_dir):
    raw, anchors, vh, _, _, _ = _models(spark, sf_dir)
    rows = filters.flag(vh, raw.unionByName(anchors), "same", spans.same_span("l", "r"), F.col("l.type") == F.col("r.type"))
    return _told(filters.flag(rows, raw.unionByName(anchors), "other", spans.same_span("l", "r"), F.col("l.type") != F.col("r.type")), "same", "other")


def first_support(spark, sf_dir):
    """The first anchor or rule with a span's type and place, but for marks at the end."""
    raw, anchors, _, _, gl, _ = _models(spark, sf_dir)
    rows = filters.first_exact_support(gl, raw.unionByName(anchors), "s")
    return _told(rows, F.col("s.seq").alias("support"), F.col("s.source").alias("by"))


def trusted_overlaps(spark, sf_dir):
    """Spans that a trusted span of their type covers by four fifths."""
    return _told(filters.backed(proposals(spark, sf_dir), "backed"), "backed")


def source_summary(spark, sf_dir):
    return merge.run_summary(proposals(spark, sf_dir), "source")


def place_range(spark, sf_dir):
    """Least, most and number of places, checked to be under a bound."""
    rows = proposals(spark, sf_dir).groupBy("note_id").agg(F.collect_list("start").alias("at"))
    return merge.id_stats(rows, "at", 10_000_000)


def one_type_a_span(spark, sf_dir):
    """Of each span the proposal that merging chooses, before overlaps are resolved."""
    return _told(merge.one_of_each_span(proposals(spark, sf_dir), dealt=True), "type", "source", "confidence")


def type_chains(spark, sf_dir):
    """Of spans of one type that overlap, from left to right, those that stay: the longer, then the earlier."""
    rows = spans.best_of(proposals(spark, sf_dir).select("note_id", "start", "end", "type", "seq"), ["note_id", "start", "end", "type"], F.asc("seq"))
    met = spans.chained(rows, ["note_id", "type"], ["start", "end"], [F.col("end") - F.col("start")], lambda a, b: a[0] > b[0])
    last = spans.best_of(met, ["note_id", "type", "__run"], F.desc("__won"), F.desc("__at"))
    return last.select(F.col("note_id").alias("doc_id"), "type", "start", "end")


def evidence_gate_decisions(spark, sf_dir):
    rows = proposals(spark, sf_dir).withColumn("icd_bm25", F.struct((F.col("start") % 100 / 100.0).alias("coverage"), (F.col("end") % 100 / 100.0).alias("margin"), (F.col("start") % 9 * 1.0).alias("adjusted")))
    rows = rows.withColumn("icd_embedding", F.struct((F.col("end") % 100 / 100.0).alias("score"), (F.col("start") % 10 / 100.0).alias("margin"))).withColumn("rerank", F.when(F.col("seq") % 2 == 0, "keep").otherwise("abstain"))
    return _told(linking.evidence_gate(rows, "hybrid_reranker"), "gate", F.size("candidates").alias("n_candidates"))


def context_gate_decisions(spark, sf_dir):
    return _told(linking.context_gate(proposals(spark, sf_dir), base._notes(spark, sf_dir)), "gate", F.size("candidates").alias("n_candidates"))


def rerank_decisions(spark, sf_dir):
    """Scores of two codes for each span decide, if they are good and far enough apart."""
    rows = proposals(spark, sf_dir).withColumn("candidates", F.array().cast("array<string>"))
    score = lambda code, n: F.struct(F.lit(code).alias("code"), (F.col("seq") * n % 101 / 100.0).alias("score"))
    scores = rows.select("note_id", "seq", F.explode(F.array(score("A", 7), score("B", 13))).alias("x")).select("note_id", "seq", "x.*")
    return _told(linking.reranked(rows, scores, 0.55, 0.08), "rerank", "link_method", F.array_join("candidates", ",").alias("code"))


def assertion_modes(spark, sf_dir):
    """Assertions of a model and of rules, combined in each mode."""
    rows = proposals(spark, sf_dir)
    some = lambda n: F.filter(F.array(*[F.when(F.col("start") / (i + n) % 2 < 1, a) for i, a in enumerate(fixed.ASSERTIONS)]), lambda x: x.isNotNull())
    return _told(rows, *(F.array_join(assertions.combined(some(1), some(2), mode), ",").alias(mode) for mode in ("llm_only", "rule_only", "union", "llm_plus_historical_rule")))


def verifier_batch_places(spark, sf_dir):
    rows = proposals(spark, sf_dir).where(filters.unsafe())
    return _told(models.verifier_batches(rows, 12), F.col("batch").cast("long").alias("batch"), "index")


def header_hits(spark, sf_dir):
    """Hits inside of headers."""
    rows = sections.in_header(base._hits(spark, sf_dir), base._sections(spark, sf_dir))
    return rows.select(F.col("note_id").alias("doc_id"), "start", "end", "surface")


def section_policy_join(spark, sf_dir):
    """What the policy of its section says of each longest hit."""
    rows = sections.section_of(base._longest(spark, sf_dir), base._sections(spark, sf_dir))
    policy = spark.createDataFrame([("THE", "lab", 5, True), ("UNKNOWN", "none", 7, None), ("DIE", None, None, False)], "section string, role string, min_priority int, symptom_structural boolean")
    for c in sections.POLICY:
        policy = policy if c in policy.columns else policy.withColumn(c, F.lit(None).cast("string" if isinstance(sections.POLICY[c], str) else "boolean"))
    out = sections.with_policy(rows, policy)
    return out.select(F.col("note_id").alias("doc_id"), "start", "section", "p_role", "p_min_priority", "p_symptom_structural", "p_rule_trust")


def text_around_spans(spark, sf_dir):
    """Snippet, clause, scope and enclosing line of each longest hit, and whether it is within a word, is its text, and ends trimmed."""
    rows = base._longest(spark, sf_dir, reach=180)
    late = F.col("end") + 2
    lo, hi = text.trimmed(text.NEAR, F.col("start"), late)
    return rows.select(
        F.col("note_id").alias("doc_id"), "start", F.md5(text.snippet(text.NEAR, "start", "end")).alias("snippet"), F.md5(text.clause_around(text.NEAR, "start", "end")).alias("clause"),
        F.md5(text.scope_text("kind", text.NEAR, "start", "end")).alias("scope"), text.mid_word(text.NEAR, "start", F.col("end") - 1).alias("cut"), text.valid_span(text.NEAR, "start", "end", "text").alias("valid"),
        lo.cast("int").alias("lo"), hi.cast("int").alias("hi"),
    )


def repeated_words(spark, sf_dir):
    """Clauses that say a word twice in a row."""
    rows = spans.clauses(base._notes(spark, sf_dir))
    return rows.select(F.col("note_id").alias("doc_id"), "start", text.repeats_a_word("clause").alias("repeats"))


def colon_places(spark, sf_dir):
    rows = spans.lines(base._notes(spark, sf_dir))
    return rows.select(F.col("note_id").alias("doc_id"), "line_no", text.top_level_colon(F.translate("line", ",.;", "(:)")).alias("colon"))


def dose_strengths(spark, sf_dir):
    """Strengths, name and mention of drugs as they are written with their doses."""
    rows = base._longest(spark, sf_dir)
    n = (F.col("start") % 900 + 1).cast("string")
    said = F.concat(F.lit("uống "), "surface", F.lit(" "), n, F.when(F.col("start") % 3 == 0, F.concat(F.lit("-"), n, F.lit(" mg po daily"))).when(F.col("start") % 3 == 1, F.lit("mg/ml oral tablet")).otherwise(F.lit(" units, 5 ml bid")))
    tty = F.element_at(F.array(*[F.lit(t) for t in ("SCD", "IN", "BN", "XX")]), (F.col("start") % 4 + 1).cast("int"))
    own = rows.withColumn("tty", tty)
    return own.select(
        F.col("note_id").alias("doc_id"), "start", F.array_join(linking.strengths(said), "|").alias("strengths"), F.array_join(linking.name_tokens(said), " ").alias("name"),
        linking.clean_mention(said).alias("mention"), linking.tty_rank(F.col("start") % 2 == 0, "tty").alias("rank"),
    )


def char_chunk_bounds(spark, sf_dir):
    """Chunks up to a size, cut at the last line break of their second half."""
    return windows.char_chunks(base._notes(spark, sf_dir), 2600, 120).select(F.col("note_id").alias("doc_id"), "start", "end")


def piece_window_bounds(spark, sf_dir):
    rows = base._notes(spark, sf_dir).select("note_id", F.length("text").alias("n"))
    return windows.piece_windows(rows, 256, 32).select(F.col("note_id").alias("doc_id"), "lo", "hi")


def token_label_votes(spark, sf_dir):
    rows = proposals(spark, sf_dir).select("note_id", "start", "end", F.col("type").alias("label"), F.col("confidence").alias("score"))
    return windows.votes(rows.groupBy("note_id", "start", "end", "label").agg(F.max("score").alias("score"))).select(F.col("note_id").alias("doc_id"), "start", "end", "label", "score")


def record_bounds(spark, sf_dir):
    """Records that begin at lines with a header."""
    lines = spans.lines(base._notes(spark, sf_dir)).where("start < end")
    rows = windows.record_chunks(lines, f"(?i)^(?:{'|'.join(base.HEADERS)})(?![{base.WORD_CLASS}])")
    return rows.select(F.col("note_id").alias("doc_id"), "record", "start", "end")


def lexicon_codes(spark, sf_dir):
    """Codes of the surfaces of a lexicon by ontology key: all of a key in order, and the last row's."""
    words = base.corpus_lexicon(base._notes(spark, sf_dir)).select("surface", F.array(F.concat(F.lit("c:"), "surface"), F.col("kind")).alias("codes"), (F.length("surface") * 1000 + F.ascii("surface")).cast("long").alias("ord"))
    every, last = linking.code_map(words), linking.code_map(words, last_wins=True)
    both = every.select("key", F.array_join("codes", ",").alias("codes")).join(last.select("key", F.array_join("codes", ",").alias("last")), "key")
    return both


def glued_scan(spark, sf_dir):
    """Hits of all surfaces, inside of words as well, counted by note."""
    notes = base._notes(spark, sf_dir)
    return lexicon.scan_glued(notes, base.corpus_lexicon(notes).select("surface")).groupBy(F.col("note_id").alias("doc_id")).agg(F.count("*").alias("n"), F.sum("start").alias("places"))


def exact_keys(spark, sf_dir):
    """Texts folded and as keys by full Unicode rules."""
    rows = base._notes(spark, sf_dir)
    return rows.select(F.col("note_id").alias("doc_id"), F.md5(text.fold_exact("text")).alias("folded"), F.md5(text.ontology_key_exact("text")).alias("key"))


def code_relations(spark, sf_dir):
    """Whether codes of events are of one category, and their names without marks of word pieces."""
    rows = base._table(spark, sf_dir, "events")
    a, b = F.concat(F.lit("I"), (F.col("event_id") % 13).cast("string")), F.concat(F.lit("I"), (F.col("event_id") % 7).cast("string"), F.lit("."), (F.col("event_id") % 5).cast("string"))
    return rows.select("event_id", text.related_codes(a, b).alias("related"), text.piece_surface(F.concat(F.lit("▁"), "event_type", F.lit("@@"))).alias("piece"))


def chunk_choice(spark, sf_dir):
    """Which chunks each text would be read in, by its records and how much its sections cover."""
    notes, secs = base._notes(spark, sf_dir), base._sections(spark, sf_dir)
    own = secs.where("canonical <> 'UNKNOWN'")
    records = own.groupBy("note_id").agg(F.count("*").alias("records"))
    covered = spans.coverage(own.select("note_id", F.col("header_start").alias("start"), F.col("content_end").alias("end")), notes)
    rows = covered.join(records, "note_id", "left").na.fill(0, ["records"])
    return rows.select(F.col("note_id").alias("doc_id"), windows.chunk_strategy("records", "covered", share=0.9).alias("strategy"))


def hint_counts(spark, sf_dir):
    """How many hints each chunk of a text is given: what is proposed in it, 80 at most."""
    chunks = windows.char_chunks(base._notes(spark, sf_dir), 2600, 120).withColumn("chunk", F.concat_ws("/", "note_id", "start"))
    rows = models.hints(chunks, proposals(spark, sf_dir))
    return rows.select(F.col("note_id").alias("doc_id"), "start", F.size(F.from_json("hints", "array<struct<start:int>>")).alias("n"))


def token_labels(spark, sf_dir):
    """Words labelled by the longest hits over them."""
    tokens = spans.words(base._notes(spark, sf_dir)).select("note_id", "start", (F.col("start") + F.length("word")).alias("end"))
    rows = windows.bio_labels(tokens, base._longest(spark, sf_dir).select("note_id", "start", "end", F.col("kind").alias("type")))
    return rows.select(F.col("note_id").alias("doc_id"), "start", "end", "label")


QUERIES = {
    f.__name__: f
    for f in (
        rule_admission, token_model_admission, span_model_admission, language_model_admission, cleanup_decisions, verifier_decisions, consensus_promotion, weak_rule_rescue,
        exact_support_flags, first_support, trusted_overlaps, source_summary, place_range, one_type_a_span, type_chains, evidence_gate_decisions, context_gate_decisions,
        rerank_decisions, assertion_modes, verifier_batch_places, header_hits, section_policy_join, text_around_spans, repeated_words, colon_places, dose_strengths,
        char_chunk_bounds, piece_window_bounds, token_label_votes, record_bounds, lexicon_codes, glued_scan,
        exact_keys, code_relations, chunk_choice, hint_counts, token_labels,
    )
}

# --- The same in SQL ------------------------------------------------------------------------


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _cut_at(at: str, n: str, size: int, rest: str) -> str:
    """Where a chunk ends that begins at a place: before what of its second half matches rest, if that is not all of it."""
    half = f"substr(text, ({at} + {size // 2} + 1)::INT, {size - size // 2})"
    left = f"length(regexp_extract({half}, '{rest}'))".replace("{NL}", "\n")
    return f"CASE WHEN {at} + {size} >= {n} THEN {n} WHEN {left} < {size - size // 2} THEN {at} + {size} - {left} ELSE {at} + {size} END::INT"


def _limits(values: dict, default) -> str:
    return "CASE " + " ".join(f"WHEN l.type = '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {default} END"


#: Chunks of 2600 characters, cut after the last line break in their second half.
_CHUNKS = f"""nn AS (SELECT doc_id, text, length(text)::INT AS n FROM documents WHERE length(text) > 0),
c AS (SELECT doc_id, n, 0 AS start, {_cut_at("0", "n", 2600, "[^{NL}]*$")} AS "end" FROM nn
   UNION ALL SELECT doc_id, c.n, "end" - 120, {_cut_at('"end" - 120', "c.n", 2600, "[^{NL}]*$")} FROM c JOIN nn USING (doc_id) WHERE "end" < c.n)"""
_ENT = f"""WITH {base._WORDS},
ent AS MATERIALIZED (SELECT h.doc_id, h.start::BIGINT AS start, h."end"::BIGINT AS "end", substr(d.text, h.start + 1, h."end" - h.start) AS text, h.surface, k, ((h.start * 100 + length(surface)) * 3 + k)::INT AS seq,
   {_list(TYPES)}[((h.start * 7 + length(surface) * 3 + k * (h.start % 2)) % {len(TYPES)} + 1)::INT] AS type, {_list(SOURCES)}[((h.start * 5 + length(surface) + k * 2) % {len(SOURCES)} + 1)::INT] AS source,
   ((h.start * 11 + length(surface) * 17 + k * 7) % 50 + 50) / 100.0::DOUBLE AS confidence, (h.start + length(surface)) % 3 = 0 AS needs_support,
   CASE WHEN h.start % 4 = 0 THEN [upper(surface)] ELSE []::VARCHAR[] END AS candidates, {_list(METHODS)}[((h.start + k) % {len(METHODS)} + 1)::INT] AS link_method
   FROM hits h JOIN documents d USING (doc_id), range(3) r(k)),
raw AS (SELECT * FROM ent WHERE source IN ('symptom_dictionary', 'diagnosis_section_fallback')), base AS (SELECT * FROM ent WHERE source = 'baseline_anchor'),
vh AS (SELECT * FROM ent WHERE source = 'vihealthbert'), ph AS (SELECT * FROM ent WHERE source = 'phobert'), gl AS (SELECT * FROM ent WHERE source = 'gliner'), llm AS (SELECT * FROM ent WHERE source = 'self_host_llm')"""
_SAME = 'r.doc_id = l.doc_id AND r.start = l.start AND r."end" = l."end"'
_MET = 'r.doc_id = l.doc_id AND r.start < l."end" AND l.start < r."end"'
_SHARE = '(least(l."end", r."end") - greatest(l.start, r.start))::DOUBLE / least(l."end" - l.start, r."end" - r.start)'
_WORDS_OF = r"len(string_split(trim(regexp_replace(l.text, '\s+', ' ', 'g')), ' '))"


def _has(table: str, condition: str) -> str:
    return f"EXISTS (SELECT 1 FROM {table} r WHERE {condition})"


def _near(table: str, ratio: float) -> str:
    return _has(table, f"{_MET} AND r.type = l.type AND {_SHARE} >= {ratio}")


_FOLD = r"trim(regexp_replace(lower(l.text), '\s+', ' ', 'g'))"
_SHORT = f"l.type IN ('{SYMPTOM}', '{DIAGNOSIS}')"
_CLAUSE = r"len(regexp_extract_all(l.text, '[,;:]')) >= 2"


def _rx(value: str, pattern: str) -> str:
    return f"regexp_matches({value}, '(?i){pattern}')"


def _first(table: str) -> str:
    """The first row of a table that has the type and start, and the end but for marks."""
    tail = r"""((r."end" = l."end") OR (abs(r."end" - l."end") <= 2 AND CASE WHEN r."end" > l."end" THEN starts_with(r.text, l.text) AND regexp_full_match(substr(r.text, length(l.text) + 1), '[\s.;:,]+')
        ELSE starts_with(l.text, r.text) AND regexp_full_match(substr(l.text, length(r.text) + 1), '[\s.;:,]+') END))"""
    return f"SELECT l.doc_id, l.seq, arg_min(r, r.seq) AS s FROM {{rows}} l JOIN {table} r ON r.doc_id = l.doc_id AND r.type = l.type AND r.start = l.start AND {tail} GROUP BY 1, 2"


_BIG = "CASE source " + " ".join(f"WHEN '{s}' THEN {fixed.SOURCE_PRIORITY.get(s, 1 if s.endswith('_fallback') else 3)}" for s in SOURCES) + " END"
_TYPE_ORDER = "CASE type " + " ".join(f"WHEN '{t}' THEN {n}" for t, n in fixed.TYPE_PRIORITY.items()) + " END"
_HINT = f"CASE WHEN type = '{DRUG}' AND {_rx('trim(text)', fixed.MERGE_DOSE)} THEN 3 WHEN type = '{TEST}' AND {_rx('trim(text)', fixed.MERGE_TEST)} THEN 2 WHEN type = '{RESULT}' AND {_rx('trim(text)', fixed.MERGE_RESULT)} THEN 1 ELSE 0 END"
_KEYED = base._KEY.replace("lower(text)", "lower(surface)")
_H = f"{base._WITH}, {base._walk('hits', 'h')}"

ORACLES = {
    "rule_admission": f"""{_ENT}, ner AS (SELECT * FROM vh UNION ALL SELECT * FROM ph UNION ALL SELECT * FROM gl),
b AS ({_first("base").format(rows="raw")}), n AS ({_first("ner").format(rows="raw")}),
j AS (SELECT l.*, b.s IS NOT NULL AS anchored, n.s.confidence >= {_limits(THRESHOLDS, 0.95)} AS sure, l.source LIKE '%_fallback' AS structural FROM raw l LEFT JOIN b USING (doc_id, seq) LEFT JOIN n USING (doc_id, seq))
SELECT doc_id, seq, NOT (structural OR needs_support) OR anchored OR coalesce(sure, false) AS accepted, CASE WHEN NOT (structural OR needs_support) THEN 'trusted_exact_rule' WHEN anchored THEN 'structural_exact_baseline_support'
  WHEN sure THEN 'structural_exact_vihealth_support' WHEN structural THEN 'structural_rule_requires_independent_support' ELSE 'context_rule_requires_independent_support' END AS reason FROM j""",
    "token_model_admission": f"""{_ENT}, pool AS (SELECT * FROM raw UNION ALL SELECT * FROM llm UNION ALL SELECT * FROM base),
j AS (SELECT l.doc_id, l.seq, l.type, {_near("pool", 0.4)} AS good, CASE WHEN {_has("pool", _SAME + " AND r.type <> l.type")} THEN 'same_span_cross_type_conflict' WHEN length(trim(l.text)) < 2 THEN 'span_too_short'
  WHEN length(trim(l.text)) > {_limits(fixed.NER_CHARS, 80)} THEN 'span_too_long' WHEN {_WORDS_OF} > {_limits(fixed.NER_WORDS, 10)} THEN 'too_many_words' WHEN {_SHORT} AND contains(l.text, chr(10)) THEN 'multiline_span'
  WHEN {_SHORT} AND {_CLAUSE} THEN 'clause_like_span' WHEN l.confidence < {_limits(THRESHOLDS, 0.95)} THEN 'below_type_threshold' END AS r FROM vh l)
SELECT doc_id, seq, r IS NULL AND (good OR type = '{RESULT}') AS accepted, coalesce(r, CASE WHEN good THEN 'corroborated' WHEN type = '{RESULT}' THEN 'high_confidence_uncorroborated_allowed' ELSE 'corroboration_required' END) AS reason FROM j""",
    "span_model_admission": f"""{_ENT}, pool AS (SELECT * FROM raw UNION ALL SELECT * FROM llm UNION ALL SELECT * FROM base),
j AS (SELECT l.doc_id, l.seq, CASE WHEN l.confidence < {_limits(THRESHOLDS, 0.75)} THEN 'below_threshold' WHEN length(l.text) > 100 THEN 'span_too_long' WHEN {_WORDS_OF} > 16 THEN 'too_many_words'
  WHEN contains(l.text, chr(10)) THEN 'multiline' WHEN NOT {_near("pool", 0.45)} AND l.type <> '{RESULT}' THEN 'corroboration_required' END AS r FROM gl l)
SELECT doc_id, seq, r IS NULL AS accepted, coalesce(r, 'accepted') AS reason FROM j""",
    "language_model_admission": f"""{_ENT}, pool AS (SELECT * FROM raw UNION ALL SELECT * FROM base),
near AS (SELECT DISTINCT l.doc_id, l.seq FROM llm l JOIN (SELECT * FROM pool UNION ALL SELECT * FROM llm) r ON r.doc_id = l.doc_id AND r.type = '{TEST}' AND abs(l.start - r.start) <= 300 AND (l.seq <> r.seq OR l.source <> r.source) WHERE l.type = '{RESULT}'),
j AS (SELECT l.doc_id, l.seq, {_has("pool", _SAME + " AND r.type = l.type")} AS exact, CASE WHEN l.confidence < 0.68 THEN 'below_confidence' WHEN {_rx(_FOLD, fixed.LLM_GENERIC)} THEN 'generic_phrase'
  WHEN length(trim(l.text)) > {_limits(fixed.LLM_CHARS, 80)} THEN 'span_too_long' WHEN {_WORDS_OF} > {_limits(fixed.LLM_WORDS, 10)} THEN 'too_many_words' WHEN contains(trim(l.text), chr(10)) THEN 'multiline_span'
  WHEN {_SHORT} AND {_CLAUSE} THEN 'clause_like_span' WHEN l.type = '{RESULT}' AND n.seq IS NULL THEN 'result_without_test_context' WHEN {_has("pool", _SAME + " AND r.type <> l.type")} THEN 'same_span_supported_type_conflict'
  WHEN NOT {_near("pool", 0.4)} AND l.type <> '{SYMPTOM}' THEN 'corroboration_required' END AS r FROM llm l LEFT JOIN near n ON n.doc_id = l.doc_id AND n.seq = l.seq)
SELECT doc_id, seq, r IS NULL AS accepted, coalesce(r, CASE WHEN exact THEN 'exactly_corroborated' ELSE 'accepted' END) AS reason FROM j""",
    "cleanup_decisions": f"""{_ENT}, names AS (SELECT {_list([v for _, v in fixed.GENERIC_BY_TYPE + fixed.DROP_BY_TYPE] + [v for v, _, _ in fixed.TYPE_REPAIRS] + ["sonst"])} AS l),
x AS (SELECT doc_id, seq, type, l[(start % len(l) + 1)::INT] AS t, source IN ('gliner', 'self_host_llm', 'vihealthbert', 'phobert') AS neural FROM ent, names),
y AS (SELECT *, CASE WHEN neural AND (type, t) IN ({", ".join(f"('{a}', '{b}')" for a, b in fixed.GENERIC_BY_TYPE)}) THEN 'generic_field_or_section_label' WHEN neural AND (type, t) IN ({", ".join(f"('{a}', '{b}')" for a, b in fixed.DROP_BY_TYPE)}) THEN 'known_category_type_conflict'
  WHEN neural AND (type, t) IN ({", ".join(f"('{b}', '{a}')" for a, b, _ in fixed.TYPE_REPAIRS)}) THEN 'trusted_exact_type_repair' ELSE 'unchanged' END AS reason FROM x)
SELECT doc_id, seq, CASE reason WHEN 'unchanged' THEN 'keep' WHEN 'trusted_exact_type_repair' THEN 'repair' ELSE 'drop' END AS action, reason, type AS before_type,
  CASE WHEN reason = 'trusted_exact_type_repair' THEN CASE t {" ".join(f"WHEN '{a}' THEN '{c}'" for a, _, c in fixed.TYPE_REPAIRS)} END ELSE type END AS type FROM y""",
    "verifier_decisions": f"""{_ENT}, x AS (SELECT l.*, source IN ('self_host_llm', 'vihealthbert', 'gliner') AS risky, seq % 3 = 0 AS asked, start % 2 = 0 AS keep, confidence >= 0.96 AND {_WORDS_OF} >= 2 AS sure FROM ent l)
SELECT doc_id, seq, CASE WHEN NOT risky THEN true WHEN asked THEN keep ELSE sure END AS accepted, CASE WHEN NOT risky THEN 'safe_source' WHEN NOT asked THEN CASE WHEN sure THEN 'no_decision_but_sure' ELSE 'no_decision' END WHEN keep THEN 'kept' ELSE 'rejected' END AS reason,
  CASE WHEN risky AND asked AND start % 5 = 0 THEN '{DRUG}' ELSE type END AS type FROM x""",
    "consensus_promotion": f"""{_ENT}, sure AS (SELECT * FROM (SELECT * FROM vh UNION ALL SELECT * FROM ph) l WHERE confidence >= {_limits(THRESHOLDS, 0.95)})
SELECT doc_id, seq, CASE WHEN {_has("sure", _SAME + " AND r.type = l.type")} THEN greatest(confidence, 0.84) ELSE confidence END AS confidence FROM llm l""",
    "weak_rule_rescue": f"""{_ENT} SELECT doc_id, seq FROM raw l WHERE (confidence >= 0.7 AND source NOT LIKE '%_fallback') OR {_has("llm", _MET + " AND r.type = l.type")}""",
    "exact_support_flags": f"""{_ENT}, pool AS (SELECT * FROM raw UNION ALL SELECT * FROM base) SELECT doc_id, seq, {_has("pool", _SAME + " AND r.type = l.type")} AS same, {_has("pool", _SAME + " AND r.type <> l.type")} AS other FROM vh l""",
    "first_support": f"""{_ENT}, pool AS (SELECT * FROM raw UNION ALL SELECT * FROM base), f AS ({_first("pool").format(rows="gl")}) SELECT doc_id, l.seq, s.seq AS support, s.source AS "by" FROM gl l LEFT JOIN f USING (doc_id, seq)""",
    "trusted_overlaps": f"""{_ENT}, t AS (SELECT * FROM ent WHERE regexp_matches(source, '^({"|".join(fixed.TRUSTED_SOURCES)})'))
SELECT doc_id, seq, {_has("t", f"{_MET} AND r.type = l.type AND r.seq <> l.seq AND {_SHARE} >= 0.8")} AS backed FROM ent l""",
    "source_summary": f"""{_ENT} SELECT source, count(DISTINCT doc_id) AS files, count(*) AS entities, count(*) FILTER (type = '{DIAGNOSIS}') AS diagnoses, count(*) FILTER (type = '{DRUG}') AS drugs,
  round(count(*) FILTER (type IN ('{DIAGNOSIS}', '{DRUG}') AND len(candidates) > 0) / greatest(count(*) FILTER (type IN ('{DIAGNOSIS}', '{DRUG}')), 1)::DOUBLE, 6) AS candidate_coverage FROM ent GROUP BY 1""",
    "place_range": f"{_ENT} SELECT min(start)::INT AS least, max(start)::INT AS most, count(*) AS n FROM ent",
    "one_type_a_span": f"""{_ENT}, pp AS (SELECT *, {_BIG} AS pr, source = 'baseline_anchor' AS anchor FROM ent),
e AS (SELECT * FROM pp QUALIFY row_number() OVER (PARTITION BY doc_id, start, "end", type ORDER BY anchor DESC, CASE WHEN anchor THEN seq END, confidence DESC, pr DESC, seq) = 1),
f AS (SELECT e.*, m.first FROM e JOIN (SELECT doc_id, start, "end", type, min(seq) AS first FROM ent GROUP BY ALL) m USING (doc_id, start, "end", type))
SELECT doc_id, seq, type, source, confidence FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, start, "end" ORDER BY anchor DESC, CASE WHEN anchor THEN confidence END DESC NULLS LAST, {_HINT} DESC, round(1 + 0.2 * pr, 6) DESC, {_TYPE_ORDER} DESC, first) = 1""",
    "type_chains": f"""{_ENT}, e AS (SELECT DISTINCT doc_id, type, start, "end" FROM ent),
chains AS (SELECT doc_id, type, list_reduce(list_transform(l, lambda x: [x]), lambda acc, x: CASE WHEN x[1].a >= acc[-1].z THEN list_concat(acc, x) WHEN x[1].z - x[1].a > acc[-1].z - acc[-1].a THEN list_concat(acc[:-2], x) ELSE acc END) AS x
   FROM (SELECT doc_id, type, list({{'a': start, 'z': "end"}} ORDER BY start, "end") AS l FROM e GROUP BY 1, 2))
SELECT doc_id, type, s.a::INT AS start, s.z::INT AS "end" FROM (SELECT doc_id, type, unnest(x) AS s FROM chains)""",
    "evidence_gate_decisions": f"""{_ENT}, x AS (SELECT *, CASE link_method WHEN 'icd_hybrid_reranker' THEN seq % 2 = 0 WHEN 'icd_bm25_calibrated' THEN start % 100 / 100.0 >= 0.72 AND "end" % 100 / 100.0 >= 0.65 AND start % 9 >= 4.5
  WHEN 'icd_embedding_calibrated' THEN "end" % 100 / 100.0 >= 0.86 AND start % 10 / 100.0 >= 0.065 ELSE link_method IN ({_list(fixed.TRUSTED_LINKS)[1:-1]}) END AS fine, type IN ('{DIAGNOSIS}', '{DRUG}') AND len(candidates) > 0 AS asked FROM ent)
SELECT doc_id, seq, CASE WHEN asked THEN CASE WHEN fine THEN 'keep' ELSE 'clear' END END AS gate, CASE WHEN asked AND NOT fine THEN 0 ELSE len(candidates) END::INT AS n_candidates FROM x""",
    "context_gate_decisions": f"""{_ENT}, x AS (SELECT *, CASE WHEN type NOT IN ('{DIAGNOSIS}', '{DRUG}') THEN NULL WHEN len(candidates) = 0 THEN 'keep_empty' WHEN type = '{DIAGNOSIS}' AND regexp_matches(upper(text), '{fixed.ICD_CODE}') THEN 'keep_explicit_code'
  WHEN link_method = 'rxnorm_clinical_strength' THEN 'keep_clinical_strength' WHEN link_method IN ({_list(fixed.TRUSTED_LINKS)[1:-1]}) THEN 'keep_trusted_exact' WHEN link_method IN ({_list(fixed.FUZZY_LINKS)[1:-1]}) THEN 'clear_fuzzy' ELSE 'clear_untrusted' END AS gate FROM ent)
SELECT doc_id, seq, gate, CASE WHEN gate LIKE 'clear%' THEN 0 ELSE len(candidates) END::INT AS n_candidates FROM x""",
    "rerank_decisions": f"""{_ENT}, x AS (SELECT *, seq * 7 % 101 / 100.0 AS a, seq * 13 % 101 / 100.0 AS b, type IN ('{DIAGNOSIS}', '{DRUG}') AS asked FROM ent),
y AS (SELECT *, greatest(a, b) >= 0.55 AND round(greatest(a, b) - least(a, b), 6) >= 0.08 AS fine FROM x)
SELECT doc_id, seq, CASE WHEN asked THEN CASE WHEN fine THEN 'keep' ELSE 'abstain' END END AS rerank, CASE WHEN asked AND fine THEN CASE WHEN type = '{DIAGNOSIS}' THEN 'icd_hybrid_reranker' ELSE 'rxnorm_hybrid_reranker' END ELSE link_method END AS link_method,
  CASE WHEN asked AND fine THEN CASE WHEN a >= b THEN 'A' ELSE 'B' END ELSE '' END AS code FROM y""",
    "assertion_modes": f"""{_ENT}, x AS (SELECT doc_id, seq, list_filter([{", ".join(f"CASE WHEN (start / {i + 1}) % 2 < 1 THEN '{a}' END" for i, a in enumerate(fixed.ASSERTIONS))}], lambda v: v IS NOT NULL) AS m,
  list_filter([{", ".join(f"CASE WHEN (start / {i + 2}) % 2 < 1 THEN '{a}' END" for i, a in enumerate(fixed.ASSERTIONS))}], lambda v: v IS NOT NULL) AS r FROM ent)
SELECT doc_id, seq, array_to_string(m, ',') AS llm_only, array_to_string(r, ',') AS rule_only, array_to_string(list_concat(m, list_filter(r, lambda v: NOT list_contains(m, v))), ',') AS "union",
  array_to_string(list_concat(m, list_filter(r, lambda v: v = '{fixed.HISTORICAL}' AND NOT list_contains(m, v))), ',') AS llm_plus_historical_rule FROM x""",
    "verifier_batch_places": f"""{_ENT}, x AS (SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS n FROM ent WHERE source IN ('self_host_llm', 'vihealthbert', 'gliner')) SELECT doc_id, seq, n // 12 AS batch, (n % 12)::INT AS "index" FROM x""",
    "header_hits": f"""{base._WITH}, {base._SECTIONS} SELECT doc_id, start, "end", surface FROM hits h WHERE EXISTS (SELECT 1 FROM sections s WHERE s.doc_id = h.doc_id AND s.header_start < s.header_end AND s.header_start <= h.start AND h."end" <= s.header_end)""",
    "section_policy_join": f"""{_H}, {base._SECTIONS}, x AS (SELECT doc_id, start, {base._ASOF} AS section FROM h)
SELECT doc_id, start, section, CASE section WHEN 'THE' THEN 'lab' WHEN 'DIE' THEN 'unknown' ELSE 'none' END AS p_role, CASE section WHEN 'THE' THEN 5 WHEN 'DIE' THEN 110 ELSE 7 END AS p_min_priority,
  section = 'THE' AS p_symptom_structural, 'model_support' AS p_rule_trust FROM x""",
    "text_around_spans": rf"""{_H}, x AS (SELECT h.doc_id, h.start, h."end", kind, text, substr(text, greatest(start - 180, 0) + 1, start - greatest(start - 180, 0)) AS pre, substr(text, "end" + 1, 180) AS post, substr(text, start + 1, "end" - start) AS own,
  substr(text, start + 1, "end" + 2 - start) AS more, substr(text, "end" - 1, 1) AS a, substr(text, "end", 1) AS b, CASE WHEN start > 0 THEN substr(text, start, 1) ELSE '' END AS c, substr(text, start + 1, 1) AS d FROM h JOIN documents USING (doc_id))
SELECT doc_id, start, md5(replace(substr(text, greatest(start - 120, 0) + 1, "end" + 120 - greatest(start - 120, 0)), chr(10), ' ')) AS snippet, md5(regexp_extract(pre, '[^.\n;]*$') || own || regexp_extract(post, '^[^.\n;]*')) AS clause,
  md5('SECTION=' || kind || ' LEFT=' || substr(text, greatest(start - 140, 0) + 1, start - greatest(start - 140, 0)) || ' ENTITY=' || own || ' RIGHT=' || substr(text, "end" + 1, 140)) AS scope,
  (regexp_matches(c, '^{base._W}') AND regexp_matches(d, '^{base._W}')) OR (regexp_matches(a, '^{base._W}') AND regexp_matches(b, '^{base._W}')) AS cut, true AS valid,
  (start + length(more) - length(regexp_replace(more, '^\s+', '')))::INT AS lo, (start + length(regexp_replace(more, '[\s,;.]+$', '')))::INT AS hi FROM x""",
    "repeated_words": rf"""
WITH p AS (SELECT doc_id, unnest(l) AS piece, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{spans.CLAUSES}') AS l FROM documents)),
c AS (SELECT doc_id, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, regexp_replace(piece, '^\s+', '') AS front, length(piece) AS n FROM p),
t AS (SELECT doc_id, (start + n - length(front))::INT AS start, regexp_replace(front, '\s+$', '') AS clause FROM c),
w AS (SELECT doc_id, start, list_transform(string_split(trim(regexp_replace(clause, '\s+', ' ', 'g')), ' '), lambda x: trim(lower(x), '.,;:()[]{{}}')) AS l FROM t WHERE regexp_replace(clause, '[.!?;\s]+', '', 'g') <> '')
SELECT doc_id, start, len(list_filter(l, lambda x, i: i > 1 AND x = l[i - 1] AND x <> '')) > 0 AS repeats FROM w""",
    "colon_places": f"""WITH {base._LINES}, x AS (SELECT doc_id, line_no, string_split(translate(line, ',.;', '(:)'), '') AS c FROM lines),
r AS (SELECT doc_id, line_no, list_reduce(list_transform(c, lambda ch, i: {{'d': 0, 'f': -1, 'at': (i - 1)::INT, 'c': ch}}), lambda s, e: {{'d': CASE WHEN e.c IN ('(', '[', '{{') THEN s.d + 1 WHEN e.c IN (')', ']', '}}') THEN greatest(0, s.d - 1) ELSE s.d END, 'f': CASE WHEN s.f < 0 AND e.c = ':' AND s.d = 0 THEN e.at ELSE s.f END, 'at': e.at, 'c': e.c}},
   {{'d': 0, 'f': -1, 'at': 0, 'c': ''}}) AS s FROM x)
SELECT doc_id, line_no::INT AS line_no, coalesce(s.f, -1)::INT AS colon FROM r""",
    "dose_strengths": rf"""{_H}, x AS (SELECT doc_id, start, 'uống ' || surface || ' ' || (start % 900 + 1) || CASE start % 3 WHEN 0 THEN '-' || (start % 900 + 1) || ' mg po daily' WHEN 1 THEN 'mg/ml oral tablet' ELSE ' units, 5 ml bid' END AS text FROM h),
y AS (SELECT *, regexp_replace(text, '(?i){fixed.RX_RANGE}', ' ', 'g') AS free, {base._TOKENS} AS t FROM x),
z AS (SELECT *, list_concat(list_transform(regexp_extract_all(text, '(?i){fixed.RX_RANGE}', 1), lambda v, i: replace(v, ',', '.') || ' ' || regexp_replace(lower(regexp_extract_all(text, '(?i){fixed.RX_RANGE}', 2)[i]), '^units$', 'unit')),
   list_transform(regexp_extract_all(free, '(?i){fixed.RX_STRENGTH}', 1), lambda v, i: replace(v, ',', '.') || ' ' || regexp_replace(lower(regexp_extract_all(free, '(?i){fixed.RX_STRENGTH}', 2)[i]), '^units$', 'unit'))) AS s,
   list_filter(t, lambda v: NOT regexp_full_match(v, '\d+') AND v NOT IN ({_list(fixed.RX_STOP)[1:-1]})) AS n, regexp_replace(regexp_replace(trim(text), '(?i){fixed.RX_LEAD}', ''), '(?is){fixed.RX_SCHEDULE}', '') AS m FROM y)
SELECT doc_id, start, array_to_string(list_filter(s, lambda v, i: NOT list_contains(s[:i - 1], v)), '|') AS strengths, array_to_string(list_filter(n, lambda v, i: NOT list_contains(n[:i - 1], v)), ' ') AS name, trim(regexp_replace(trim(m, ' ,;:-'), '\s+', ' ', 'g')) AS mention,
  CASE WHEN start % 2 = 0 THEN [0, 8, 10, 99][start % 4 + 1] ELSE [6, 0, 3, 99][start % 4 + 1] END AS "rank" FROM z""",
    "exact_keys": rf"""SELECT doc_id, md5(trim(regexp_replace(nfc_normalize(replace(lower(text), 'ß', 'ss')), '\s+', ' ', 'g'))) AS folded, md5(trim({base._KEY})) AS key FROM documents""",
    "code_relations": """WITH x AS (SELECT event_id, event_type, 'I' || (event_id % 13) AS a, 'I' || (event_id % 7) || (event_id % 5) AS b FROM events) SELECT event_id, starts_with(a, b) OR starts_with(b, a) AS related, event_type AS piece FROM x""",
    "chunk_choice": f"""WITH {base._SECTIONS}, n AS (SELECT doc_id, sum(content_end - header_start) AS n, count(*) AS records FROM sections WHERE canonical <> 'UNKNOWN' GROUP BY 1)
SELECT d.doc_id, CASE WHEN records >= 2 THEN 'records' WHEN coalesce(x.n, 0) / greatest(d.n, 1)::DOUBLE >= 0.9 THEN 'sections' ELSE 'document' END AS strategy FROM d LEFT JOIN n x USING (doc_id)""",
    # every place of every text, by stretches of 64 characters, against the surfaces of each length
    "glued_scan": f"""WITH {base._WORDS}, sz AS (SELECT DISTINCT length(surface) AS n FROM lexicon), top AS (SELECT max(n) AS m FROM sz),
st AS (SELECT doc_id, 64 * k AS lead, lower(substr(text, (64 * k + 1)::INT, (64 + m)::INT)) AS c FROM documents, top, range(0, length(text) // 64 + 1) t(k)),
pl AS (SELECT doc_id, lead, c, i FROM st, range(1, 65) t(i) WHERE i <= length(c)),
hi AS (SELECT doc_id, lead + i - 1 AS start FROM (SELECT doc_id, lead, i, substr(c, i::INT, n::INT) AS own, n FROM pl, sz WHERE i + n - 1 <= length(c)) x JOIN lexicon ON own = surface)
SELECT doc_id, count(*) AS n, sum(start)::BIGINT AS places FROM hi GROUP BY doc_id""",
    "hint_counts": f"""{_ENT.replace("WITH ", "WITH RECURSIVE ", 1)}, {_CHUNKS}
SELECT l.doc_id, l.start::INT AS start, least(count(r.doc_id), 80)::INT AS n FROM c l LEFT JOIN ent r ON {_MET} GROUP BY l.doc_id, l.start""",
    "token_labels": f"""{_H}, t AS (SELECT doc_id, start, (start + length(word))::INT AS "end" FROM w WHERE word <> ''),
m AS (SELECT t.doc_id, t.start, t."end", h.kind, row_number() OVER (PARTITION BY t.doc_id, h.start ORDER BY t.start) AS n FROM t JOIN h ON h.doc_id = t.doc_id AND h.start < t."end" AND t.start < h."end")
SELECT t.doc_id, t.start, t."end", CASE WHEN kind IS NULL THEN 'O' WHEN n = 1 THEN 'B-' || kind ELSE 'I-' || kind END AS label FROM t LEFT JOIN m USING (doc_id, start, "end")""",
    "char_chunk_bounds": f"""WITH RECURSIVE {_CHUNKS}
SELECT doc_id, start::INT AS start, "end"::INT AS "end" FROM c""",
    "piece_window_bounds": """WITH n AS (SELECT doc_id, length(text)::INT AS n FROM documents WHERE length(text) > 0),
k AS (SELECT doc_id, n, unnest(range(0, ceil(greatest(n - 256, 0) / 224.0)::BIGINT + 1)) AS k FROM n) SELECT doc_id, (k * 224)::INT AS lo, least(k * 224 + 256, n)::INT AS hi FROM k""",
    "token_label_votes": f"""{_ENT}, g AS (SELECT doc_id, start, "end", type, max(confidence) AS score FROM ent GROUP BY ALL)
SELECT doc_id, start::INT AS start, "end"::INT AS "end", type AS label, score FROM g QUALIFY row_number() OVER (PARTITION BY doc_id, start, "end" ORDER BY score DESC, type) = 1""",
    "record_bounds": f"""WITH {base._LINES}, x AS (SELECT doc_id, start, (start + length(line))::INT AS "end", line FROM lines WHERE line <> ''), h AS (SELECT * FROM x WHERE regexp_matches(line, '(?i)^({"|".join(base.HEADERS)})($|[^{base.WORD_CLASS}])')),
l AS (SELECT doc_id, max("end") AS last FROM x GROUP BY 1)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start)::INT AS record, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), last)::INT AS "end" FROM h JOIN l USING (doc_id)""",
    "lexicon_codes": f"""WITH {base._WORDS}, o AS (SELECT surface, ['c:' || surface, kind] AS codes, (length(surface) * 1000 + unicode(surface))::BIGINT AS ord FROM lexicon),
k AS (SELECT trim({_KEYED}) AS key, codes, ord FROM o), e AS (SELECT key, flatten(list(codes ORDER BY ord, codes)) AS c, (list(codes ORDER BY ord DESC, codes DESC))[1] AS l FROM k WHERE key <> '' GROUP BY key)
SELECT key, array_to_string(list_filter(c, lambda x, i: NOT list_contains(c[:i - 1], x)), ',') AS codes, array_to_string(list_filter(l, lambda x, i: NOT list_contains(l[:i - 1], x)), ',') AS last FROM e""",
}
