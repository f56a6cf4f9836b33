"""The queries of the library over the test tables, by name, and the SQL that says the same.

The texts of the test tables are invented words, so lexicons, headers and cues are derived
from them; the operators are those that clinical notes go through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartula.functions.text import LETTERS, NEAR, fold, ontology_tokens, token_count, upper_each
from cartula.operators import lexicon as lex
from cartula.operators import retrieval, spans, windows
from cartula.session import keep

WORD_CLASS = r"\p{L}\p{M}\p{N}_"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _notes(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("note_id"), "text")


def corpus_lexicon(notes: DataFrame) -> DataFrame:
    """surface, kind, priority: words of three letters or more in a tenth of all notes, and pairs of words in a fiftieth.

    Each text is cut to the set of its words and pairs where it is; only these are counted.
    """
    low, word = F.lower("text"), f"[{WORD_CLASS}]+"
    single = F.filter(F.array_distinct(F.regexp_extract_all(low, F.lit(word), 0)), lambda w: F.length(w) >= 3)
    double = F.array_distinct(F.regexp_extract_all(low, F.lit(f"(?=({word} {word})){word}"), 1))
    pick = lambda words, share: notes.select(F.explode(words).alias("surface"), F.lit(share).alias("share"))
    df = pick(single, 10).unionByName(pick(double, 50)).groupBy("surface", "share").agg(F.count("*").alias("df"))
    total = notes.agg(F.count("*").alias("n"))
    kept = df.crossJoin(F.broadcast(total)).where("df * share >= n")  # one row of statistics
    kind = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.length("surface") % 3 + 1).cast("int"))
    return kept.select("surface", kind.alias("kind"), ((F.length("surface") * 7) % 5).cast("int").alias("priority"))


def _hits(spark, sf_dir) -> DataFrame:
    notes = _notes(spark, sf_dir)
    return lex.scan(notes, corpus_lexicon(notes))


def _longest(spark, sf_dir, reach: int | None = None) -> DataFrame:
    notes = _notes(spark, sf_dir)
    return lex.longest(notes, corpus_lexicon(notes), -F.col("priority"), reach=reach)


def _sections(spark, sf_dir) -> DataFrame:
    """Tiles that begin at lines whose first word is a header."""
    from cartula.operators.sections import tiles

    notes = _notes(spark, sf_dir)
    heads = spans.lines(notes).withColumn("head", F.lower(F.regexp_extract("line", f"^[{WORD_CLASS}]+", 0))).where(F.col("head").isin(*HEADERS))
    marks = heads.select("note_id", F.upper("head").alias("canonical"), "start", (F.col("start") + F.length("head")).alias("end"), F.col("line_no"), F.expr("substring(line, 1, length(head))").alias("header"))
    return tiles(marks, notes)


HEADERS = ("the", "in", "die", "der", "la", "le", "de", "el", "and", "of")


def line_offsets(spark, sf_dir):
    return spans.lines(_notes(spark, sf_dir)).select(F.col("note_id").alias("doc_id"), "line_no", "start", "end", F.md5("line").alias("line_md5"))


def clause_split(spark, sf_dir):
    return spans.clauses(_notes(spark, sf_dir)).select(F.col("note_id").alias("doc_id"), "start", "end", F.md5("clause").alias("clause_md5"))


def normalize_tokens(spark, sf_dir):
    rows = _notes(spark, sf_dir).select("note_id", ontology_tokens("text").alias("t"))
    return rows.select(F.col("note_id").alias("doc_id"), F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


def doc_frequency(spark, sf_dir):
    rows = _notes(spark, sf_dir).select("note_id", F.explode(F.array_distinct(ontology_tokens("text"))).alias("term"))
    return rows.groupBy("term").agg(F.count("*").alias("df"))


def flagship_term_sections(spark, sf_dir):
    """Lines, dictionary scan, longest match, section of each hit, and counts by language, section and term."""
    from cartula.operators.sections import section_of

    found = section_of(_longest(spark, sf_dir), _sections(spark, sf_dir))
    langs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("note_id"), "lang")
    return found.join(langs, "note_id").groupBy("lang", "section", "surface").agg(F.count("*").alias("n"), F.countDistinct("note_id").alias("n_docs"))


def dict_scan(spark, sf_dir):
    return _hits(spark, sf_dir).select(F.col("note_id").alias("doc_id"), "start", "end", "surface")


def dict_scan_longest(spark, sf_dir):
    return _longest(spark, sf_dir).select(F.col("note_id").alias("doc_id"), "start", "end", "surface", "kind")


def dict_scan_policy(spark, sf_dir):
    """Hits whose priority the policy of their section admits, longest first."""
    from cartula.operators.sections import section_of

    hits = section_of(_hits(spark, sf_dir), _sections(spark, sf_dir))
    least = F.when(F.col("section") == "UNKNOWN", 4).when(F.col("section").isin("THE", "DIE", "LA"), 0).otherwise(2)
    kept = spans.greedy(hits.where(F.col("priority") >= least), -F.col("priority"), F.lower("text"))
    return kept.select(F.col("note_id").alias("doc_id"), "start", "end", "surface", "section")


def ngram_hits(spark, sf_dir):
    notes = _notes(spark, sf_dir)
    words = corpus_lexicon(notes).where(F.col("surface").rlike("^[a-z0-9 ]+$"))
    return lex.ngram_hits(notes, words.select("surface")).select(F.col("note_id").alias("doc_id"), "surface")


def section_tiles(spark, sf_dir):
    return _sections(spark, sf_dir).select(F.col("note_id").alias("doc_id"), "sec_no", "canonical", "header_start", "content_start", "content_end")


def section_asof(spark, sf_dir):
    from cartula.operators.sections import section_of

    rows = section_of(_longest(spark, sf_dir), _sections(spark, sf_dir))
    return rows.select(F.col("note_id").alias("doc_id"), "start", "section")


def section_coverage(spark, sf_dir):
    own = _sections(spark, sf_dir).where("canonical <> 'UNKNOWN'").select("note_id", F.col("header_start").alias("start"), F.col("content_end").alias("end"))
    return spans.coverage(own, _notes(spark, sf_dir)).select(F.col("note_id").alias("doc_id"), F.round("covered", 6).alias("covered"))


def next_span_window(spark, sf_dir):
    """After each longest hit: what is free up to the next one, the end of the line, or 130 characters."""
    from cartula.operators.extract import result_windows

    rows = result_windows(_longest(spark, sf_dir), _notes(spark, sf_dir))
    return rows.select(F.col("note_id").alias("doc_id"), "start", "window_end", F.md5("window").alias("window_md5"))


def last_cue_assertion(spark, sf_dir):
    """Whether a cue stands before a hit in its clause, near enough, with no contrast between."""
    from cartula.operators.assertions import cue_before

    rows = spans.near(_longest(spark, sf_dir), _notes(spark, sf_dir), 120, placed=True)
    cue = cue_before(NEAR, "start", ["the", "der", "la", "que", "un"], reach=120, most=90, contrast=r"\b(?:and|und|et)\b")
    return rows.select(F.col("note_id").alias("doc_id"), "start", "surface", cue.alias("asserted"))


def _two_sources(spark, sf_dir):
    rows = _hits(spark, sf_dir).withColumn("type", F.col("kind"))
    rows = rows.withColumn("confidence", F.round((F.col("start") * 7 + F.length("surface") * 13) % 100 / 100, 2))
    return rows.where("priority < 3"), rows.where("priority >= 2")


def support_semi(spark, sf_dir):
    left, right = _two_sources(spark, sf_dir)
    return spans.supported(left, right, 0.8).select(F.col("note_id").alias("doc_id"), "start", "end", "type")


def conflict_anti(spark, sf_dir):
    left, right = _two_sources(spark, sf_dir)
    other = right.withColumn("type", F.when(F.col("confidence") < 0.5, F.lit("A")).otherwise(F.col("type")))
    return spans.unconflicted(left, other).select(F.col("note_id").alias("doc_id"), "start", "end", "type")


def overlap_ratio_join(spark, sf_dir):
    left, right = _two_sources(spark, sf_dir)
    rows = spans.overlapping(left, right, ~spans.same_span("l", "r"))
    return rows.select(F.col("l.note_id").alias("doc_id"), F.col("l.start").alias("l_start"), F.col("l.end").alias("l_end"), F.col("r.start").alias("r_start"), F.col("r.end").alias("r_end"), F.round(spans.overlap_ratio("l", "r"), 6).alias("ratio"))


def containment_join(spark, sf_dir):
    left, right = _two_sources(spark, sf_dir)
    rows = spans.overlapping(left, right, spans.contains("l", "r") & ~spans.same_span("l", "r"))
    return rows.groupBy(F.col("l.note_id").alias("doc_id")).agg(F.count("*").alias("n_nested"))


def _proposals(spark, sf_dir):
    """Hits as several sources propose them, with repeats and different types."""
    rows = lex.together(_hits(spark, sf_dir), _notes(spark, sf_dir)).withColumn("source", F.explode(F.array(*[F.lit(s) for s in ("drug_dictionary", "gliner", "rule")])))
    salt = F.length("source")
    rows = rows.withColumn("type", F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), ((F.col("start") * salt) % 3 + 1).cast("int")))
    return rows.withColumn("confidence", (F.col("start") * salt * 11 + F.length("surface")) % 100 / 100.0).withColumn("seq", salt)


def argmax_dedup(spark, sf_dir):
    rows = spans.best_of(_proposals(spark, sf_dir), ["note_id", "start", "end", "type"], F.desc("confidence"), "seq")
    return rows.select(F.col("note_id").alias("doc_id"), "start", "end", "type", "source", "confidence")


def type_votes(spark, sf_dir):
    from cartula.operators.merge import vote_types

    rows = vote_types(_proposals(spark, sf_dir), {"A": 1, "B": 2, "C": 3})
    return rows.select(F.col("note_id").alias("doc_id"), "start", "end", "type", F.round("votes", 6).alias("votes"))


def same_span_merge(spark, sf_dir):
    """One row a span and type: the best row's source, and all sources, best first."""
    from cartula.operators.merge import merge_same

    rows = _proposals(spark, sf_dir).withColumn("candidates", F.array(upper_each("surface"))).withColumn("assertions", F.array("source"))
    return merge_same(rows).select(F.col("note_id").alias("doc_id"), "start", "end", "type", "source", F.array_join("assertions", ",").alias("assertions"), F.array_join("candidates", ",").alias("candidates"))


def _bm25(spark, sf_dir, k):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    queries = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")
    return retrieval.bm25(docs, queries, k)


def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir, 5).select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "rank", "score")


def bm25_margin_gate(spark, sf_dir):
    rows = retrieval.margins(_bm25(spark, sf_dir, 2), ["query"])
    return rows.select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "margin", ((F.col("score") >= 3.4) & (F.col("margin") >= 0.55)).alias("accepted"))


def _vectors(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))


def cosine_topk(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    found = retrieval.cosine_others(rows.withColumnRenamed("vec_id", "doc"), rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query"), 5, 4)
    return found.select(F.col("query").alias("query_id"), F.col("doc").alias("vec_id"), "rank", "score")


def cosine_cells(spark, sf_dir):
    """As cosine_topk, through an index of cells whatever the number of vectors."""
    rows = _vectors(spark, sf_dir)
    index = retrieval.cell_index(rows.withColumnRenamed("vec_id", "doc"), whole=0)
    found = retrieval.cosine_others(index, rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query"), 5, 4)
    return found.select(F.col("query").alias("query_id"), F.col("doc").alias("vec_id"), "rank", "score")


#: Letters whose numbers in a text are its vector in dense_link.
COUNTED = "abcdefghijklmnop"


def dense_link(spark, sf_dir):
    """The document whose letters are most like those of each benchmark item, and of a blank text."""
    embed = lambda t: t.withColumn("vec", F.array(*[(F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))).cast("double") for c in COUNTED]))
    docs = _table(spark, sf_dir, "documents")
    index = embed(docs.select(F.col("doc_id").alias("doc"), "text")).select("doc", "vec")
    texts = _table(spark, sf_dir, "benchmark").select(F.col("text").alias("query")).unionByName(spark.createDataFrame([(" ",)], "query string"))
    entries = docs.select(F.col("doc_id").alias("doc"), F.concat(F.lit("D"), "doc_id").alias("code"), F.col("source").alias("title"))
    return retrieval.dense_link(texts, index, entries, embed).select(F.md5("query").alias("query_md5"), "code", "title", "score")


def hybrid_fusion(spark, sf_dir):
    """BM25 and cosine hits of the benchmark items whose number is a vector's, weighted."""
    vecs = _vectors(spark, sf_dir)
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id"))
    dense = retrieval.cosine_others(vecs.withColumnRenamed("vec_id", "doc"), vecs.join(items, "vec_id", "left_semi").withColumnRenamed("vec_id", "query"), 15, 4)
    rows = retrieval.fused(_bm25(spark, sf_dir, 15), dense.drop("rank"), 5)
    return rows.select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "rank", F.round("score", 4).alias("score"))


def rarest_posting_candidates(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    queries = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")
    return retrieval.rarest_posting(queries, retrieval.postings(docs)).select(F.col("query").alias("item_id"), "term", F.col("doc").alias("doc_id"))


def token_coverage_join(spark, sf_dir):
    """Share of an item's tokens that each document with its rarest one has."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    queries = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")
    pairs = retrieval.rarest_posting(queries, retrieval.postings(docs))
    rows = pairs.join(queries.select("query", ontology_tokens("text").alias("q")), "query").join(docs.select("doc", ontology_tokens("text").alias("d")), "doc")
    share = F.round(retrieval.token_coverage(F.col("q"), F.col("d")), 6)
    return rows.select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), share.alias("coverage"))


def token_windows(spark, sf_dir):
    rows = _notes(spark, sf_dir).select("note_id", token_count("text").alias("n"))
    return windows.token_windows(rows).select(F.col("note_id").alias("doc_id"), "lo", "hi")


def bio_decode(spark, sf_dir):
    """Runs of event types of a user as labelled tokens."""
    rows = _table(spark, sf_dir, "events").select(
        F.col("user_id").alias("note_id"),
        F.col("event_id").cast("int").alias("start"),
        (F.col("event_id") + 1).cast("int").alias("end"),
        F.when(F.col("event_id") % 5 == 0, "O").otherwise(F.concat(F.when(F.col("event_id") % 3 == 0, "B-").otherwise("I-"), "event_type")).alias("label"),
        (F.col("event_id") % 10 / 10.0).alias("score"),
    )
    return windows.bio_spans(rows, 0.2).select(F.col("note_id").alias("user_id"), "start", "end", "type", "confidence")


def json_props(spark, sf_dir):
    """Numbers and forms that replies about events list in an object between other words."""
    from cartula.operators.models import items_reply

    reply = F.concat(F.lit('so: {"items":[{"id":'), F.col("event_id").cast("string"), F.lit(',"normalized":"'), "event_type", F.lit('"},{"id":0,"normalized":"'), F.col("user_id").cast("string"), F.lit('"}]} done'))
    rows = _table(spark, sf_dir, "events").select("event_id", F.explode(items_reply(reply)).alias("x"))
    return rows.select("event_id", F.col("x.id").cast("long").alias("id"), "x.normalized")


def export_json_rows(spark, sf_dir):
    """Spans of each note as one JSON array."""
    from cartula.sources.sinks import as_json

    rows = _longest(spark, sf_dir).select("note_id", "start", "end", "text", F.col("kind").alias("type"), F.array().cast("array<string>").alias("assertions"), F.array("surface").alias("candidates"))
    return as_json(rows).select(F.col("note_id").alias("doc_id"), F.md5("json").alias("json_md5"))


def cache_miss_anti(spark, sf_dir):
    """Requests that a cache of the even conversations lacks, once each."""
    from cartula.operators.models import cache_misses, request_key

    rows = _table(spark, sf_dir, "conversations").withColumn("key", request_key("m", "role", "text"))
    cache = rows.where("conv_id % 2 = 0").select("key").distinct()
    return cache_misses(rows, cache).select("key")


def run_summary(spark, sf_dir):
    """Files, entities, diagnoses, drugs and candidates by toxicity label."""
    from cartula.functions.fixed import DIAGNOSIS, DRUG, SYMPTOM
    from cartula.operators.merge import run_summary as summary

    rows = _longest(spark, sf_dir).join(_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("note_id"), "toxic"), "note_id")
    rows = rows.withColumn("type", F.when(F.col("kind") == "A", DIAGNOSIS).when(F.col("kind") == "B", DRUG).otherwise(SYMPTOM))
    return summary(rows.withColumn("candidates", F.when(F.length("surface") > 4, F.array("surface")).otherwise(F.array().cast("array<string>"))), "toxic")


def filter_reason_counts(spark, sf_dir):
    """Why spans are not admitted, by the first reason that holds."""
    from cartula.operators.filters import decided, ladder

    reason = ladder((F.col("confidence") < 0.2, "below_confidence"), (F.length("surface") > 8, "span_too_long"), (F.col("type") == "C", "type_not_allowed"))
    return decided(_two_sources(spark, sf_dir)[0], reason).groupBy("reason").agg(F.count("*").alias("n"))


def fold_text(spark, sf_dir):
    return _notes(spark, sf_dir).select(F.col("note_id").alias("doc_id"), F.md5(fold("text", " .,:;()[]{}")).alias("folded_md5"))


def regex_span_offsets(spark, sf_dir):
    """Places of words of five Latin letters and more, with the characters there."""
    return spans.regex_spans(_notes(spark, sf_dir), {"capital": r"\b[A-ZÀ-Þ][a-zß-ÿ]{4,}"})


def _rule_resources(spark, notes):
    """Headers, and tests, drugs, symptoms and diagnoses from the lexicon of the notes, by kind and priority."""
    words = keep(corpus_lexicon(notes))
    rows = [(h.upper(), "unknown", 0 if h in ("the", "die", "la") else 110, h in ("the", "in"), h in ("die", "der"), h == "la", h == "le", "trusted" if h in ("the", "die", "la") else "model_support") for h in HEADERS]
    rows.append(("UNKNOWN", "unknown", 110, False, False, False, False, "model_support"))
    schema = "section string, role string, min_priority int, symptom_structural boolean, diagnosis_structural boolean, assertion_history boolean, assertion_family boolean, rule_trust string"
    named = ["surface", F.col("surface").alias("canonical")]
    weight = (F.col("priority") * 10 + 90).cast("int").alias("priority")
    return {
        "aliases": [(h.upper(), h) for h in HEADERS],
        "policy": spark.createDataFrame(rows, schema),
        "tests": words.where("kind = 'A'").select(*named, F.lit("laboratory").alias("category"), weight),
        "drugs": words.where("kind = 'B'").select(*named, F.lit("").alias("code")),
        "symptoms": words.where("kind = 'C' and priority < 3").select(*named, weight),
        "diagnoses": words.where("kind = 'C' and priority >= 3").select(*named, F.array(upper_each("surface")).alias("codes"), weight),
    }


def rule_entities(spark, sf_dir):
    """Rows only: sections, rules and merged entities of the documents."""
    from cartula.plans import pipelines

    notes = _notes(spark, sf_dir)
    return pipelines.rules(notes, _rule_resources(spark, notes))


QUERIES = {
    f.__name__: f
    for f in (
        flagship_term_sections, line_offsets, clause_split, normalize_tokens, fold_text, doc_frequency, dict_scan, dict_scan_longest, dict_scan_policy, ngram_hits,
        section_tiles, section_asof, section_coverage, next_span_window, last_cue_assertion, support_semi, conflict_anti, overlap_ratio_join, containment_join,
        argmax_dedup, type_votes, same_span_merge, bm25_topk, bm25_margin_gate, cosine_topk, cosine_cells, dense_link, hybrid_fusion, rarest_posting_candidates, token_coverage_join,
        token_windows, bio_decode, json_props, export_json_rows, cache_miss_anti, run_summary, filter_reason_counts, regex_span_offsets,
        rule_entities,
    )
}

# --- The same in SQL ------------------------------------------------------------------------

_W = rf"[{WORD_CLASS}]+"
_WORDS = rf"""
p AS (SELECT doc_id, unnest(l) AS piece, generate_subscripts(l, 1) - 1 AS i FROM (SELECT doc_id, regexp_extract_all(text, '{spans.WORDS}') AS l FROM documents)),
w AS (SELECT doc_id, i, piece, regexp_extract(piece, '^{_W}') AS word,
        coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start FROM p),
ww AS MATERIALIZED (SELECT * FROM (SELECT *, lead(word) OVER (PARTITION BY doc_id ORDER BY i) AS following, lead(piece) OVER (PARTITION BY doc_id ORDER BY i) AS next_piece FROM w WHERE word <> '')),
cand AS (SELECT doc_id, lower(word) AS surface, 10 AS share FROM ww WHERE length(word) >= 3
   UNION ALL SELECT doc_id, lower(piece || following), 50 FROM ww WHERE piece = word || ' ' AND following IS NOT NULL),
lexicon AS MATERIALIZED (SELECT surface, ['A', 'B', 'C'][length(surface) % 3 + 1] AS kind, ((length(surface) * 7) % 5)::INT AS priority
   FROM (SELECT surface, share, count(DISTINCT doc_id) AS df FROM cand GROUP BY 1, 2) WHERE df * share >= (SELECT count(*) FROM documents)),
hits AS MATERIALIZED (SELECT w.doc_id, w.start, w.start + length(l.surface)::INT AS "end", l.surface, l.kind, l.priority FROM ww w JOIN lexicon l ON lower(w.word) = l.surface
   UNION ALL SELECT w.doc_id, w.start, w.start + length(l.surface)::INT, l.surface, l.kind, l.priority FROM ww w JOIN lexicon l
     ON contains(l.surface, ' ') AND lower(w.piece || w.following) = l.surface)"""


def _walk(source: str, out: str, *more: str) -> str:
    """Longest matches: a fold over each note's hits in order."""
    fields = ", ".join(f"'{c}': \"{c}\"" for c in ("start", "end", "surface", "kind", "priority", *more))
    return f"""
{out} AS (SELECT doc_id, unnest(x) FROM (SELECT doc_id, unnest(list_reduce(list_transform(l, lambda e: [e]),
     lambda acc, e: CASE WHEN e[1].start >= acc[-1]."end" THEN list_concat(acc, e) ELSE acc END)) AS x
   FROM (SELECT doc_id, list({{{fields}}} ORDER BY start, -("end" - start), -priority, surface) AS l FROM {source} GROUP BY doc_id)))"""


_LINES = """
lp AS (SELECT doc_id, unnest(l) AS piece, generate_subscripts(l, 1) AS line_no FROM (SELECT doc_id, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+$') AS l FROM documents)),
lines AS (SELECT doc_id, line_no, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start,
   regexp_replace(piece, '[\\r\\n]+$', '') AS line FROM lp)"""
_SECTIONS = (
    _LINES
    + f""",
marks AS (SELECT doc_id, start, line, regexp_extract(line, '^{_W}') AS head FROM lines),
m AS (SELECT doc_id, start, upper(head) AS canonical, start + length(head)::INT AS "end", head FROM marks WHERE lower(head) IN ({", ".join(f"'{h}'" for h in HEADERS)})),
d AS (SELECT doc_id, text, length(text)::INT AS n FROM documents),
s0 AS (SELECT m.doc_id, canonical, start AS header_start, "end" AS header_end,
   ("end" + length(regexp_extract(substr(d.text, "end" + 1), '^[ \\t:;–—*-]*')))::INT AS content_start,
   coalesce(lead(start) OVER (PARTITION BY m.doc_id ORDER BY start), d.n)::INT AS content_end FROM m JOIN d USING (doc_id)
   UNION ALL SELECT d.doc_id, 'UNKNOWN', 0, 0, 0, coalesce(f.first, d.n)::INT FROM d LEFT JOIN (SELECT doc_id, min(start) AS first FROM m GROUP BY 1) f USING (doc_id)
   WHERE f.first IS NULL OR (f.first > 0 AND trim(substr(d.text, 1, f.first), ' ' || chr(9) || chr(10) || chr(13)) <> '')),
sections AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY header_start, content_end) AS sec_no FROM s0)"""
)
_ASOF = "coalesce((SELECT any_value(s.canonical) FROM sections s WHERE s.doc_id = h.doc_id AND s.header_start <= h.start AND h.start < s.content_end), 'UNKNOWN')"
_WITH = "WITH " + _WORDS
_KEY = f"regexp_replace(regexp_replace(translate(replace(lower(text), 'ß', 'ss'), '{LETTERS[0]}', '{LETTERS[1]}'), '\\p{{M}}', '', 'g'), '[^a-z0-9]+', ' ', 'g')"
_TOKENS = f"list_filter(string_split(trim({_KEY}), ' '), lambda t: length(t) > 1)"
_TWO = """
two AS (SELECT *, kind AS type, round(((start * 7 + length(surface) * 13) % 100) / 100, 2) AS confidence FROM hits),
l AS (SELECT * FROM two WHERE priority < 3), r AS (SELECT * FROM two WHERE priority >= 2)"""
_SHARED = 'least(l."end", r."end") - greatest(l.start, r.start)'
_RATIO = f'greatest(0, {_SHARED})::DOUBLE / greatest(1, least(l."end" - l.start, r."end" - r.start))'
_PROPOSALS = """
prop AS (SELECT h.*, s.source, length(s.source) AS seq, ['A', 'B', 'C'][(start * length(s.source)) % 3 + 1] AS type,
   ((start * length(s.source) * 11 + length(surface)) % 100) / 100.0::DOUBLE AS confidence FROM hits h, (VALUES ('drug_dictionary'), ('gliner'), ('rule')) s(source))"""
_BM25 = f"""
dt AS (SELECT doc_id, {_TOKENS} AS t FROM documents), qt AS (SELECT item_id, {_TOKENS} AS t FROM benchmark),
post AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM dt) GROUP BY ALL),
qq AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(t) AS term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY 1), st AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM dt),
sc AS (SELECT item_id, doc_id, round(sum(times * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean))), 6) AS score
   FROM qq JOIN df USING (term) JOIN post USING (term), st GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0)"""
_COS = """
v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings),
cs AS (SELECT q.vec_id AS query, c.vec_id AS doc, round(list_dot_product(q.u, c.u), 4) AS score FROM v q, v c WHERE q.vec_id <> c.vec_id AND {which})"""
_RAREST = """
rare AS (SELECT item_id, term FROM (SELECT DISTINCT item_id, term, df, FROM qq JOIN df USING (term) WHERE length(term) >= 3)
   QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY df, term) = 1)"""
_PRIORITY = "CASE source WHEN 'drug_dictionary' THEN 10 WHEN 'gliner' THEN 5 ELSE 3 END"

ORACLES = {
    "line_offsets": f'WITH {_LINES} SELECT doc_id, line_no::INT AS line_no, start, (start + length(line))::INT AS "end", md5(line) AS line_md5 FROM lines',
    "clause_split": rf"""
WITH p AS (SELECT doc_id, unnest(l) AS piece, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{spans.CLAUSES}') AS l FROM documents)),
c AS (SELECT doc_id, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
   regexp_replace(piece, '^\s+', '') AS front, length(piece) AS n FROM p),
t AS (SELECT doc_id, (start + n - length(front))::INT AS start, regexp_replace(front, '\s+$', '') AS clause FROM c)
SELECT doc_id, start, (start + length(clause))::INT AS "end", md5(clause) AS clause_md5 FROM t WHERE regexp_replace(clause, '[.!?;\s]+', '', 'g') <> ''""",
    "normalize_tokens": f"SELECT doc_id, len({_TOKENS})::INT AS n_tokens, md5(array_to_string({_TOKENS}, ' ')) AS tokens_md5 FROM documents",
    "fold_text": r"SELECT doc_id, md5(trim(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' .,:;()[]{}')) AS folded_md5 FROM documents",
    "doc_frequency": f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY 1",
    "regex_span_offsets": f"""WITH {_WORDS}, x AS (SELECT doc_id, start, regexp_extract(word, '^[A-Za-zÀ-ÖØ-Þà-öø-þ][A-Za-zÀ-ÖØ-öø-ÿŸ]{{4,}}') AS m FROM ww)
SELECT doc_id AS note_id, 'capital' AS name, start, (start + length(m))::INT AS "end", m AS text FROM x WHERE m <> ''""",
    "dict_scan": f'WITH {_WORDS} SELECT doc_id, start, "end", surface FROM hits',
    "dict_scan_longest": f'{_WITH}, {_walk("hits", "g")} SELECT doc_id, start, "end", surface, kind FROM g',
    "dict_scan_policy": f"""{_WITH}, {_SECTIONS},
h AS (SELECT h.*, {_ASOF} AS section FROM hits h),
k AS (SELECT * FROM h WHERE priority >= CASE WHEN section = 'UNKNOWN' THEN 4 WHEN section IN ('THE', 'DIE', 'LA') THEN 0 ELSE 2 END), {_walk("k", "g", "section")}
SELECT doc_id, start, "end", surface, section FROM g""",
    "ngram_hits": f"""WITH {_WORDS},
a AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents),
b AS (SELECT doc_id, unnest(t) AS t1, generate_subscripts(t, 1) AS i FROM a),
g AS (SELECT doc_id, t1 AS surface FROM b UNION SELECT doc_id, t1 || ' ' || lead(t1) OVER (PARTITION BY doc_id ORDER BY i) FROM b),
x AS (SELECT DISTINCT doc_id, surface FROM g JOIN (SELECT surface FROM lexicon WHERE regexp_full_match(surface, '[a-z0-9 ]+')) USING (surface))
SELECT doc_id, surface FROM x l WHERE NOT EXISTS (SELECT 1 FROM x r WHERE r.doc_id = l.doc_id AND contains(r.surface, l.surface) AND length(r.surface) > length(l.surface))""",
    "section_tiles": f"WITH {_SECTIONS} SELECT doc_id, sec_no::INT AS sec_no, canonical, header_start, content_start, content_end FROM sections",
    "section_asof": f"{_WITH}, {_SECTIONS}, {_walk('hits', 'h')} SELECT doc_id, start, {_ASOF} AS section FROM h",
    "section_coverage": f"""WITH {_SECTIONS}
SELECT d.doc_id, round(coalesce(x.n, 0) / greatest(d.n, 1)::DOUBLE, 6) AS covered FROM d LEFT JOIN (SELECT doc_id, sum(content_end - header_start) AS n FROM sections WHERE canonical <> 'UNKNOWN' GROUP BY 1) x USING (doc_id)""",
    "flagship_term_sections": f"""{_WITH}, {_SECTIONS}, {_walk("hits", "h")},
x AS (SELECT h.doc_id, h.surface, {_ASOF} AS section FROM h)
SELECT lang, section, surface, count(*) AS n, count(DISTINCT x.doc_id) AS n_docs FROM x JOIN documents USING (doc_id) GROUP BY ALL""",
    "next_span_window": f"""{_WITH}, {_walk("hits", "h")},
a AS (SELECT *, lead(start) OVER (PARTITION BY doc_id ORDER BY start) AS nxt FROM h),
b AS (SELECT a.*, substr(text, "end" + 1, 130) AS rest FROM a JOIN documents USING (doc_id)),
c AS (SELECT *, regexp_extract(rest, '^[^\\n]*') AS line FROM b),
e AS (SELECT *, CASE WHEN nxt IS NULL THEN line ELSE substr(line, 1, greatest(nxt - "end", 0)) END AS part FROM c),
f AS (SELECT *, regexp_extract(part, '^[^;]*') AS win FROM e)
SELECT doc_id, start, ("end" + length(win))::INT AS window_end, md5(win) AS window_md5 FROM f""",
    "last_cue_assertion": rf"""{_WITH}, {_walk("hits", "h")},
a AS (SELECT h.*, substr(text, greatest(start - 120, 0) + 1, start - greatest(start - 120, 0)) AS pre FROM h JOIN documents USING (doc_id)),
b AS (SELECT *, regexp_extract(pre, '[^\n.;:]*$') AS clause FROM a),
c AS (SELECT *, regexp_extract(clause, '(?is)^(?:.*[^{WORD_CLASS}])?(the|der|la|que|un)((?:[^{WORD_CLASS}].*)?)$', 2) AS between_, regexp_matches(clause, '(?is)^(?:.*[^{WORD_CLASS}])?(the|der|la|que|un)(?:[^{WORD_CLASS}].*)?$') AS found FROM b)
SELECT doc_id, start, surface, found AND length(between_) <= 90 AND NOT regexp_matches(between_, '(?i)(^|[^{WORD_CLASS}])(and|und|et)($|[^{WORD_CLASS}])') AS asserted FROM c""",
    "support_semi": f'WITH {_WORDS}, {_TWO} SELECT doc_id, start, "end", type FROM l WHERE EXISTS (SELECT 1 FROM r WHERE r.doc_id = l.doc_id AND r.type = l.type AND r.start < l."end" AND l.start < r."end" AND {_RATIO} >= 0.8)',
    "conflict_anti": f"""WITH {_WORDS}, {_TWO}, o AS (SELECT doc_id, start, "end", CASE WHEN confidence < 0.5 THEN 'A' ELSE type END AS type FROM r)
SELECT doc_id, start, "end", type FROM l WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.doc_id = l.doc_id AND o.start = l.start AND o."end" = l."end" AND o.type <> l.type)""",
    # pairs are met in the first stretch of 256 characters that both spans touch
    "overlap_ratio_join": f"""WITH {_WORDS}, {_TWO}, ls AS (SELECT *, unnest(range(start // 256, ("end" - 1) // 256 + 1)) AS k FROM l), rs AS (SELECT *, unnest(range(start // 256, ("end" - 1) // 256 + 1)) AS k FROM r)
SELECT l.doc_id, l.start AS l_start, l."end" AS l_end, r.start AS r_start, r."end" AS r_end, round({_RATIO}, 6) AS ratio FROM ls l JOIN rs r ON l.doc_id = r.doc_id AND l.k = r.k AND l.k = greatest(l.start, r.start) // 256
WHERE l.start < r."end" AND r.start < l."end" AND NOT (l.start = r.start AND l."end" = r."end")""",
    "containment_join": f"""WITH {_WORDS}, {_TWO}
SELECT l.doc_id, count(*) AS n_nested FROM l JOIN r ON l.doc_id = r.doc_id AND l.start <= r.start AND r."end" <= l."end" WHERE NOT (l.start = r.start AND l."end" = r."end") GROUP BY 1""",
    "argmax_dedup": f"""WITH {_WORDS}, {_PROPOSALS} SELECT doc_id, start, "end", type, source, confidence FROM prop QUALIFY row_number() OVER (PARTITION BY doc_id, start, "end", type ORDER BY confidence DESC, seq) = 1""",
    "type_votes": f"""WITH {_WORDS}, {_PROPOSALS}, v AS (SELECT doc_id, start, "end", type, round(sum(1 + 0.2 * {_PRIORITY}), 6)::DOUBLE AS votes FROM prop GROUP BY ALL)
SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY doc_id, start, "end" ORDER BY votes DESC, type DESC) = 1""",
    "same_span_merge": f"""WITH {_WORDS}, {_PROPOSALS}
SELECT doc_id, start, "end", type, first(source ORDER BY confidence DESC, seq) AS source, string_agg(source, ',' ORDER BY confidence DESC, seq) AS assertions, any_value(upper(surface)) AS candidates FROM prop GROUP BY ALL""",
    "bm25_topk": f"WITH {_BM25} SELECT item_id, doc_id, rank::INT AS rank, score FROM bm WHERE rank <= 5",
    "bm25_margin_gate": f"WITH {_BM25}, m AS (SELECT *, round(score - coalesce(lead(score) OVER (PARTITION BY item_id ORDER BY rank), 0), 6) AS margin FROM bm WHERE rank <= 2) SELECT item_id, doc_id, margin, score >= 3.4 AND margin >= 0.55 AS accepted FROM m WHERE rank = 1",
    "cosine_topk": f"WITH {_COS.format(which='q.vec_id % 20 = 0')} SELECT query AS query_id, doc AS vec_id, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc)::INT AS rank, score FROM cs QUALIFY rank <= 5",
    "dense_link": f"""WITH t AS (SELECT DISTINCT text FROM benchmark UNION SELECT ' '), u AS (SELECT doc_id, text FROM documents UNION ALL SELECT NULL, text FROM t),
c AS (SELECT doc_id, text, list_transform(string_split('{COUNTED}', ''), lambda x: (length(text) - length(replace(text, x, '')))::DOUBLE) AS v FROM u),
n AS (SELECT doc_id, text, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM c WHERE list_sum(v) > 0),
s AS (SELECT q.text, d.doc_id, round(list_dot_product(q.v, d.v), 6) AS score FROM n q, n d WHERE q.doc_id IS NULL AND d.doc_id IS NOT NULL),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY text ORDER BY score DESC, doc_id) = 1)
SELECT md5(t.text) AS query_md5, 'D' || doc_id AS code, source AS title, score FROM t LEFT JOIN b USING (text) LEFT JOIN documents USING (doc_id)""",
    "hybrid_fusion": f"""WITH {_BM25}, {_COS.format(which="q.vec_id IN (SELECT item_id FROM benchmark)")},
dn AS (SELECT query AS item_id, doc AS doc_id, score AS d FROM cs QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) <= 15),
b AS (SELECT coalesce(bm.item_id, dn.item_id) AS item_id, coalesce(bm.doc_id, dn.doc_id) AS doc_id, coalesce(bm.score, 0) AS s, coalesce(dn.d, 0) AS d FROM (SELECT * FROM bm WHERE rank <= 15) bm FULL JOIN dn ON bm.item_id = dn.item_id AND bm.doc_id = dn.doc_id),
f AS (SELECT item_id, doc_id, round(0.45 * s / greatest(max(s) OVER (PARTITION BY item_id), 1e-6) + 0.55 * d, 6) AS score FROM b)
SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, round(score, 4) AS score FROM f QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 5""",
    "rarest_posting_candidates": f"WITH {_BM25}, {_RAREST} SELECT item_id, term, doc_id FROM rare JOIN post USING (term)",
    "token_coverage_join": f"""WITH {_BM25}, {_RAREST}
SELECT item_id, doc_id, round(len(list_intersect(list_distinct(qt.t), dt.t)) / greatest(1, len(list_distinct(qt.t)))::DOUBLE, 6) AS coverage FROM rare JOIN post USING (term) JOIN qt USING (item_id) JOIN dt USING (doc_id)""",
    "token_windows": r"""
WITH n AS (SELECT doc_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::INT AS n FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, n, unnest(list_distinct(list_append(range(0, greatest(n - 220, 0) + 1, 156), greatest(n - 220, 0)))) AS lo FROM n WHERE n > 0)
SELECT doc_id, lo::INT AS lo, least(lo + 220, n)::INT AS hi FROM s""",
    "bio_decode": """
WITH t AS (SELECT user_id, event_id::INT AS start, (event_id + 1)::INT AS "end", event_id % 10 / 10.0::DOUBLE AS score, event_id % 3 = 0 AS b,
   CASE WHEN event_id % 5 = 0 OR event_id % 10 / 10.0::DOUBLE < 0.2 THEN NULL ELSE event_type END AS type FROM events),
f AS (SELECT *, lag(type) OVER (PARTITION BY user_id ORDER BY start) AS prev FROM t),
r AS (SELECT *, sum((type IS NOT NULL AND (prev IS NULL OR prev <> type OR b))::INT) OVER (PARTITION BY user_id ORDER BY start) AS run FROM f)
SELECT user_id, min(start) AS start, max("end") AS "end", type, round(avg(score), 6) AS confidence FROM r WHERE type IS NOT NULL GROUP BY user_id, run, type""",
    "json_props": "SELECT event_id, event_id::BIGINT AS id, event_type AS normalized FROM events UNION ALL SELECT event_id, 0, user_id::VARCHAR FROM events",
    "export_json_rows": f"""{_WITH}, {_walk("hits", "h")},
x AS (SELECT doc_id, start, "end", kind, substr(text, start + 1, "end" - start) AS own FROM h JOIN documents USING (doc_id))
SELECT doc_id, md5('[' || string_agg('{{"text":"' || own || '","position":[' || start || ',' || "end" || '],"type":"' || kind || '","assertions":[]}}', ',' ORDER BY start, "end") || ']') AS json_md5 FROM x GROUP BY 1""",
    "cache_miss_anti": """
WITH k AS (SELECT conv_id, sha256('{"model":"m","generation":{"temperature":0.0,"top_p":1.0,"max_tokens":640,"seed":42,"timeout":600.0},"system":"' || role || '","user":"' || replace(text, chr(10), '\\n') || '"}') AS key FROM conversations)
SELECT DISTINCT key FROM k WHERE key NOT IN (SELECT key FROM k WHERE conv_id % 2 = 0)""",
    "run_summary": f"""{_WITH}, {_walk("hits", "h")}
SELECT toxic, count(DISTINCT h.doc_id) AS files, count(*) AS entities, count(*) FILTER (kind = 'A') AS diagnoses, count(*) FILTER (kind = 'B') AS drugs,
  round(count(*) FILTER (kind IN ('A', 'B') AND length(surface) > 4) / greatest(count(*) FILTER (kind IN ('A', 'B')), 1)::DOUBLE, 6) AS candidate_coverage FROM h JOIN labels USING (doc_id) GROUP BY 1""",
    "filter_reason_counts": f"""WITH {_WORDS}, {_TWO}
SELECT CASE WHEN confidence < 0.2 THEN 'below_confidence' WHEN length(surface) > 8 THEN 'span_too_long' WHEN type = 'C' THEN 'type_not_allowed' ELSE 'accepted' END AS reason, count(*) AS n FROM l GROUP BY 1""",
}
ORACLES["cosine_cells"] = ORACLES["cosine_topk"]
