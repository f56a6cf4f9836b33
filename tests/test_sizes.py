"""What a job moves and keeps: each thing that is said is looked up once, and what is many times the texts isn't shuffled."""

import re

import numpy as np
from pyspark.sql import functions as F

from cartula import session
from cartula.functions.fixed import DRUG, SYMPTOM
from cartula.functions.text import clause_before
from cartula.operators import extract, filters, lexicon, linking, merge, spans, windows
from cartula.plans import entity_queries, pipelines, queries, rule_queries


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_mentions_are_linked_once(spark, monkeypatch):
    """a mention that many rows have is looked up once, and each row has its code."""
    asked, whole = [], linking.rx_clinical
    monkeypatch.setattr(linking, "rx_clinical", lambda mentions, entries: asked.append(mentions.count()) or whole(mentions, entries))
    rows = spark.createDataFrame([("a", 0, "aspirin 81 mg", DRUG), ("a", 20, "aspirin 81 mg", DRUG), ("b", 0, "aspirin 81 mg", DRUG), ("b", 20, "aspirin", DRUG), ("b", 40, "aspirin 81 mg", SYMPTOM), ("b", 60, None, DRUG)], "note_id string, start int, text string, type string")
    rows = extract.in_order(extract.entities(rows, end=F.col("start") + 5, source="gliner", confidence=0.9))
    catalog = spark.createDataFrame([("1", "aspirin", "IN"), ("2", "aspirin 81 MG Oral Tablet", "SCD")], "rxcui string, name string, tty string")
    got = {(r["note_id"], r["start"]): (list(r["candidates"]), r["link_method"]) for r in linking.link_rxnorm(rows, catalog).collect()}
    strong = (["2"], "rxnorm_clinical_strength")
    assert got == {("a", 0): strong, ("a", 20): strong, ("b", 0): strong, ("b", 20): (["1"], "rxnorm_exact"), ("b", 40): ([], None), ("b", 60): ([], None)}
    assert asked == [3]


def test_grams_meet_the_lexicon_where_they_are_made(spark, monkeypatch):
    """F8: n-grams aren't shuffled, and a lexicon that is sent in parts finds the same."""
    notes = spark.createDataFrame([(1, "Ho and dry cough, dry cough"), (2, "cough and"), (3, None)], "note_id long, text string")
    words = spark.createDataFrame([("dry cough", 1), ("cough", 2), ("and", 3), ("an", 4)], "surface string, n int")
    want = [(1, "and", 3), (1, "dry cough", 1), (2, "and", 3), (2, "cough", 2)]
    hits = lexicon.ngram_hits(notes, words)
    assert sorted(map(tuple, hits.collect())) == want
    assert "hashpartitioning(gram" not in _plan(hits) and "SortMergeJoin" not in _plan(hits)
    monkeypatch.setattr(lexicon, "AUTOMATON_ROWS", 1)
    assert sorted(map(tuple, lexicon.ngram_hits(notes, words).collect())) == want


def test_labels_are_laid_where_notes_are(spark):
    """tokens are shuffled by note alone, and once."""
    tokens = spark.createDataFrame([("a", 0, 2), ("a", 3, 5), ("a", 6, 8), ("a", 9, 9), ("b", 0, 2)], "note_id string, start int, end int")
    gold = spark.createDataFrame([("a", 0, 8, "X"), ("a", 3, 5, "Y"), ("a", 4, 5, None), ("c", 0, 2, "X")], "note_id string, start int, end int, type string")
    labels = windows.bio_labels(tokens, gold)
    assert sorted((r["note_id"], r["start"], r["label"]) for r in labels.collect()) == [("a", 0, "B-X"), ("a", 3, "O"), ("a", 6, "I-X"), ("a", 9, None), ("b", 0, "O")]
    plan = _plan(labels).split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Exchange hashpartitioning(note_id") == 2


def test_hits_that_are_read_again_are_kept_small(spark, monkeypatch):
    """what is kept are hits, not the proposals made of them, in parts of bounded texts."""
    notes = spark.createDataFrame([(k, "x" * 10) for k in range(9)], "note_id long, text string")
    monkeypatch.setattr(lexicon, "PART", 10)
    assert lexicon.dealt(notes).rdd.getNumPartitions() == 9 and lexicon.dealt(notes.limit(0)).rdd.getNumPartitions() == 1
    session.release()
    rows = entity_queries._models(spark, "/root/testdata/sf0.001")[0]
    assert [k.columns for k in session._KEPT] == [["note_id", "start", "end", "text", "surface"]]
    assert "InMemoryTableScan" in _plan(rows)


def test_longest_hits_are_taken_where_they_are_found(spark, monkeypatch):
    """hits that don't overlap are those of greedy, but nothing of them is shuffled or goes to Python again; texts are scanned a bounded part at a time."""
    text = "ho ho gà đau bụng dưới đau bụng ho gà 😀 ho"
    notes = spark.createDataFrame([("a", text), ("b", None), ("c", ""), ("d", text * 3)], "note_id string, text string").coalesce(1)
    words = spark.createDataFrame([("ho", 1), ("Ho", 3), ("HO", 3), ("ho gà", 2), ("gà đau", 9), ("đau bụng", None), ("đau bụng dưới", 0), ("dưới đau", 7)], "surface string, n int")
    told = lambda df: sorted(map(tuple, df.collect()))
    want = told(spans.greedy(lexicon.scan(notes, words), -F.col("n")))
    taken = lexicon.longest(notes, words, -F.col("n"), reach=4)
    assert told(taken.drop("__near")) == want and len(want) == 20
    whole = {"a": text, "d": text * 3}
    for r in taken.collect():
        own, near = whole[r["note_id"]], r["__near"]
        assert (near["base"], near["text"], near["size"]) == (max(0, r["start"] - 4), own[max(0, r["start"] - 4) : r["end"] + 4], len(own))
    plan = _plan(lexicon.longest(notes, words, -F.col("n")))
    assert "ArrowEvalPython" not in plan and "Exchange" not in plan
    assert list(lexicon._runs(np.array([lexicon.STEP, 1, lexicon.STEP - 1, 1]))) == [(0, 1), (1, 3), (3, 4)] and lexicon.STEP <= 1 << 20
    monkeypatch.setattr(lexicon, "AUTOMATON_ROWS", 2)
    assert told(lexicon.longest(notes, words, -F.col("n"))) == want


def test_rules_carry_no_whole_notes(spark):
    """what rules read around a hit or a line is cut out where it is found, and stays what it is in the whole note."""
    text = "Kết luận chung\n- không viêm gan; suy thận độ hai\ntiền sử dùng aspirin 81 mg mỗi ngày\n\nkhông tăng huyết áp. creatinin (máu) là 120 umol/L"
    notes = spark.createDataFrame([("a", text), ("b", "x " * 3000 + text), ("c", None)], "note_id string, text string")
    res = rule_queries._resources(spark)
    found = extract.rule_entities(notes, pipelines.sections(notes, res), res)
    plan = _plan(found)
    assert "__note" not in plan
    got = {}
    for r in found.collect():
        own = text if r["note_id"] == "a" else "x " * 3000 + text
        assert own[r["start"] : r["end"]] == r["text"]
        got.setdefault(r["note_id"], []).append((r["text"], r["source"], tuple(r["assertions"])))
    past = "isHistorical"
    want = [("creatinin (máu)", "test_dictionary", ()), ("120 umol/L", "test_result_rule", ()), ("aspirin 81 mg mỗi ngày", "drug_dictionary", (past,))]
    want += [("tăng huyết áp", "diagnosis_dictionary", (past, "isNegated")), ("không viêm gan", "diagnosis_section_fallback", (past,)), ("suy thận độ hai", "diagnosis_section_fallback", (past,))]
    assert sorted(got["a"]) == sorted(want)
    assert "c" not in got and len(got["b"]) >= 3
    session.release()


def test_clauses_are_read_from_their_end(spark):
    """what stands before a place in its clause is found in one pass, whatever stands there."""
    texts = ["", "a", "a.b\nc", "a;b", ".", "a.\n", "đau: 😀 ho", "\n\na\r", "a" * 300]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", clause_before("t", F.length("t"), 200).alias("c"))
    assert all(r["c"] == re.split(r"[\n.;:]", r["t"][-200:])[-1] for r in rows.collect())
    assert "*\\z" not in rows._jdf.queryExecution().optimizedPlan().toString().replace("(.*)\\z", "")


def test_one_of_each_span_deals_spans_once(spark):
    """proposals are shuffled once, and read once."""
    said = [("gliner", SYMPTOM, 0.7), ("phobert", SYMPTOM, 0.9), ("gliner", SYMPTOM, 0.8), ("baseline_anchor", DRUG, 0.6)]
    rows = spark.createDataFrame([(note, 0, 4, "abcd", *x, n) for note in "ab" for n, x in enumerate(said) if note == "a" or n < 3], "note_id string, start int, end int, text string, source string, type string, confidence double, seq int")
    out = merge.one_of_each_span(extract.entities(rows.withColumn("normalized", F.col("seq").cast("string"))).withColumn("seq", F.col("normalized").cast("int")))
    plan = _plan(out)
    assert plan.count("Exchange hashpartitioning(") == 1 and "Join" not in plan
    got = {r["note_id"]: (r["type"], r["source"], r["confidence"], r["seq"], r["supporting_sources"]) for r in out.collect()}
    assert got == {"a": (DRUG, "baseline_anchor", 0.6, 3, []), "b": (SYMPTOM, "phobert", 0.9, 1, ["phobert", "gliner"])}


def _hashed(df):
    """Exchanges by hash, and joins, of a query's plan before it runs."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), plan.count("Join ")


def test_hits_are_dealt_once_and_proposals_are_not(spark, monkeypatch):
    """hits go to their note's part before they become proposals; nothing is shuffled or joined after that."""
    monkeypatch.setattr(lexicon, "PART", 10_000)
    for query in (queries.same_span_merge, entity_queries.type_chains, entity_queries.one_type_a_span, entity_queries.trusted_overlaps):
        assert _hashed(query(spark, "/root/testdata/sf0.001")) == (1, 0), query.__name__


def test_scores_are_handed_to_their_rows(spark, monkeypatch):
    """scores and rows meet in a window of their note, not in a join, and hits alone are shuffled."""
    monkeypatch.setattr(lexicon, "PART", 10_000)
    out = entity_queries.rerank_decisions(spark, "/root/testdata/sf0.001")
    plan = _plan(out)
    assert "Join " not in plan and plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") > 0


def test_text_around_hits_is_cut_where_they_are_found(spark):
    """neither hits nor notes are shuffled for what stands around a hit."""
    assert _hashed(entity_queries.text_around_spans(spark, "/root/testdata/sf0.001")) == (0, 0)


def test_flags_of_one_pass_are_those_of_joins(spark):
    """rows and what may back them meet once, without a join, and each row has the flags that a join for each gives it."""
    places = [(0, 4), (0, 4), (2, 6), (250, 260), (255, 258), (100, 700), (256, 256), (600, 601), (690, 800), (None, None)]
    made = [(note, k, f"s{k % 3}", a, z, "AB"[k // 2 % 2], k % 2 == 0) for note in "ab" for k, (a, z) in enumerate(places)] + [("a", 3, "s9", 4, 5, "B", True), ("a", None, "s1", 0, 4, "A", True)]
    every = spark.createDataFrame(made, "note_id string, seq int, source string, start int, end int, type string, trusted boolean")
    rows, support = every.where("source <> 's2'"), every.where("source = 's2'")
    other = (F.col("l.seq") != F.col("r.seq")) | (F.col("l.source") != F.col("r.source"))
    alike = F.col("l.type") == F.col("r.type")
    for among in (False, True):
        pool = rows.unionByName(support) if among else support
        want = filters.flag(rows, pool.where("trusted"), "near", alike & (spans.overlap_ratio("l", "r") >= 0.8), other, shared=True)
        want = filters.flag(want, pool, "same", spans.same_span("l", "r") & alike, other)
        want = filters.flag(want, pool, "inside", spans.contains("r", "l"), other, shared=True)
        near = filters._shares(0.8)
        got = filters.flags(rows, support, {
            "near": (F.col("trusted"), lambda a, b: near(a, b) & filters._other(a, b)),
            "same": (F.lit(True), lambda a, b: filters._one_span(a, b) & filters._alike(a, b) & filters._other(a, b)),
            "inside": (F.lit(True), lambda a, b: filters._within(a, b) & filters._other(a, b)),
        }, among)
        told = lambda df: sorted(map(str, df.select("note_id", "seq", "source", "start", "near", "same", "inside").collect()))
        assert told(got) == told(want) and "Join" not in _plan(got)
        assert len({r["near"] for r in got.collect()}) == len({r["inside"] for r in got.collect()}) == 2
