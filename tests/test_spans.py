"""Text, spans, lexicons and windows against small cases and brute force."""

import random

from pyspark.sql import functions as F

from cartula.functions.text import before, clause_around, clause_before, fold, mid_word, ontology_key, ontology_key_exact, repeats_a_word, top_level_colon, trimmed, valid_span
from cartula.operators import lexicon, spans, windows


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_lines_keep_code_point_offsets(spark):
    text = "một 😀\r\n\nhai ba\n"
    got = rows(spans.lines(spark.createDataFrame([("a", text)], "note_id string, text string")), "line_no", "start", "end", "line")
    assert [(n, line) for n, _, _, line in got] == [(1, "một 😀"), (2, ""), (3, "hai ba")]
    assert all(text[s:e] == line for _, s, e, line in got)


def test_text_functions(spark):
    df = spark.createDataFrame([("Đau  ĐẦU, sốt: không ho (a:b): c",)], "t string")
    r = df.select(
        fold("t").alias("fold"), ontology_key("t").alias("key"), ontology_key_exact("t").alias("exact"), top_level_colon("t").alias("colon"), before("t", F.lit(3), 10).alias("b"),
        clause_before("t", F.lit(21), 30).alias("clause"), clause_around("t", F.lit(0), F.lit(3)).alias("around"), mid_word("t", F.lit(1), F.lit(3)).alias("mid"), valid_span("t", F.lit(0), F.lit(3), F.lit("Đau")).alias("ok"),
    ).first()
    assert r["fold"] == "đau đầu, sốt: không ho (a:b): c"
    assert r["key"] == r["exact"] == "au au sot khong ho a b c"
    assert (r["colon"], r["b"], r["clause"], r["mid"], r["ok"]) == (13, "Đau", " không ", True, True)
    words = spark.createDataFrame([("phù phù chân",), ("phù chân",), ("",)], "t string").select(repeats_a_word("t").alias("r")).collect()
    assert [w["r"] for w in words] == [True, False, False]
    s, e = trimmed("t", F.lit(3), F.lit(10))
    assert tuple(df.select(s, e).first()) == (5, 8)


def test_greedy_equals_brute_force(spark):
    rng = random.Random(5)
    data = [(str(n), a, a + rng.randint(1, 9), rng.randint(0, 3)) for n in range(6) for a in (rng.randint(0, 60) for _ in range(25))]
    want = []
    for note in {d[0] for d in data}:
        taken = []
        for d in sorted((d for d in data if d[0] == note), key=lambda d: (d[1], d[1] - d[2], -d[3])):
            if all(d[1] >= t[2] or t[1] >= d[2] for t in taken):
                taken.append(d)
        want += taken
    got = spans.greedy(spark.createDataFrame(data, "note_id string, start int, end int, p int"), -F.col("p"))
    assert rows(got, "note_id", "start", "end") == sorted(d[:3] for d in want)


def test_support_and_coverage(spark):
    left = spark.createDataFrame([("a", 0, 4, "X"), ("a", 10, 12, "X")], "note_id string, start int, end int, type string")
    right = spark.createDataFrame([("a", 1, 5, "X"), ("a", 10, 12, "Y"), ("b", 0, 4, "X")], "note_id string, start int, end int, type string")
    assert rows(spans.supported(left, right, 0.7), "start") == [(0,)]
    assert rows(spans.unconflicted(left, right), "start") == [(0,)]
    notes = spark.createDataFrame([("a", "x" * 20), ("b", ""), ("c", "xx")], "note_id string, text string")
    assert rows(spans.coverage(right, notes), "note_id", "covered") == [("a", 6 / 20), ("b", 4.0), ("c", 0.0)]


def test_dictionary_scan_respects_words(spark):
    notes = spark.createDataFrame([(1, "Ho, học; NEUT% cao. đau  ngực đau ngực dùngaspirin81"), (2, None), (3, "")], "note_id long, text string")
    words = spark.createDataFrame([("ho",), ("NEUT%",), ("đau ngực",), ("aspirin",)], "surface string")
    text = notes.first()["text"]
    got = rows(lexicon.scan(notes, words), "start", "end", "text", "surface")
    assert [(t, s) for _, _, t, s in got] == [("Ho", "ho"), ("NEUT%", "NEUT%"), ("đau ngực", "đau ngực")]
    assert all(text[a:z] == t for a, z, t, _ in got)
    glued = lexicon.scan_glued(notes, words)
    assert {"aspirin"} <= {r["surface"] for r in glued.collect()}
    ok = spans.with_text(glued.where("surface = 'aspirin'"), notes).select(lexicon.glue_ok("__note", "start", "end", ["dùng"], ["và"]).alias("ok")).first()
    assert ok["ok"]


def test_ngram_hits_leave_out_what_a_longer_one_holds(spark):
    notes = spark.createDataFrame([(1, "Insulin glargine daily; aspirin")], "note_id long, text string")
    words = spark.createDataFrame([("insulin",), ("insulin glargine",), ("aspirin",)], "surface string")
    assert rows(lexicon.ngram_hits(notes, words), "surface") == [("aspirin",), ("insulin glargine",)]


def test_windows(spark):
    counts = spark.createDataFrame([("a", 220), ("b", 221), ("c", 532), ("d", 0)], "note_id string, n int")
    assert rows(windows.token_windows(counts), "note_id", "lo", "hi") == [("a", 0, 220), ("b", 0, 220), ("b", 1, 221), ("c", 0, 220), ("c", 156, 376), ("c", 312, 532)]
    need = spark.createDataFrame([("c", 210, 390)], "note_id string, lo int, hi int")
    assert ("c", 190, 410) in rows(windows.rescue_windows(counts, need), "note_id", "lo", "hi")
    assert rows(windows.piece_windows(counts.where("note_id = 'b'"), 100, 20), "lo", "hi") == [(0, 100), (80, 180), (160, 221)]


def test_bio_runs(spark):
    toks = [(0, 2, "B-X", 0.9), (3, 5, "I-X", 0.7), (6, 7, "I-Y", 0.9), (8, 9, "O", 0.9), (10, 11, "I-Y", 0.9), (12, 13, "B-Y", 0.9), (14, 15, "I-Y", 0.1)]
    df = spark.createDataFrame([("a", *t) for t in toks], "note_id string, start int, end int, label string, score double")
    got = rows(windows.bio_spans(df, 0.5), "start", "end", "type", "confidence")
    assert got == [(0, 5, "X", 0.8), (6, 7, "Y", 0.9), (10, 11, "Y", 0.9), (12, 13, "Y", 0.9)]
    gold = spark.createDataFrame([("a", 0, 5, "X"), ("a", 3, 5, "Z")], "note_id string, start int, end int, type string")
    assert dict((s, x) for s, x in rows(windows.bio_labels(df, gold), "start", "label")) == {0: "B-X", 3: "B-Z", 6: "O", 8: "O", 10: "O", 12: "O", 14: "O"}


def test_chunks(spark):
    text = "Phần 1: bệnh\n" + "đau bụng. " * 40 + "\nchữ ký\n"
    notes = spark.createDataFrame([("a", text), ("b", "không gì cả"), ("c", None)], "note_id string, text string")
    got = windows.semantic_chunks(notes, size=200, overlap=20).collect()
    own = [(r["start"], r["end"]) for r in got if r["note_id"] == "a"]
    assert own[0][0] == 0 and all(z - a <= 200 for a, z in own) and all(b[0] < a[1] for a, b in zip(own, own[1:]))
    assert [(r["start"], r["end"], r["heading"]) for r in got if r["note_id"] == "b"] == [(0, 11, "DOCUMENT")]
    fixed_size = [(r["start"], r["end"]) for r in windows.char_chunks(notes.where("note_id = 'a'"), 150, 10).collect()]
    assert fixed_size[-1][1] == len(text)


def test_observed_counts(spark):
    chunks = spark.createDataFrame([("a", 0, 7), ("a", 5, 9), ("b", 0, 4)], "note_id string, start int, n int")
    found = spark.createDataFrame([("a",), ("a",), ("a",), ("b",)], "note_id string")
    kept = found.dropDuplicates()
    grouped = windows.debug_counts(chunks, found, kept).collect()
    own, before, after, told = windows.observed_counts(chunks, found, kept)
    for rows in (own, before, after):
        rows.write.format("noop").mode("overwrite").save()
    assert told() == {c: sum(r[c] for r in grouped) for c in ("segments", "tokens", "before", "after", "removed")}


def test_near_reads_as_the_whole_text(spark):
    """What is near a span reads as the whole text does: at cuts, ends, beyond them, in blank and missing texts, and for long spans."""
    from cartula.functions.text import NEAR, scope_text, snippet

    rng = random.Random(3)
    texts = {"a": "".join(rng.choice("ab. \n😀đ;") for _ in range(5000)), "b": "x" * 2048, "c": "", "d": None, "e": "kurz; und gut"}
    at = [(n, s, s + w) for n in texts for s in (0, 1, 5, 900, 1023, 1024, 1025, 2040, 2047, 2048, 2049, 4095, 4990, 4999, 5000, 5400) for w in (0, 1, 7, 850, 1500, 6000)]
    notes = spark.createDataFrame(list(texts.items()), "note_id string, text string")
    own = spark.createDataFrame([*at, ("a", None, None), ("a", -3, 2), ("z", 1, 2)], "note_id string, start int, end int")
    read = lambda rows, t: sorted(map(str, rows.select("note_id", "start", "end", snippet(t, "start", "end").alias("s"), clause_around(t, "start", "end").alias("c"), scope_text("note_id", t, "start", "end").alias("x"), valid_span(t, "start", "end", F.lit("x")).alias("v"), mid_word(t, "start", "end").alias("m")).collect()))
    whole = read(spans.with_text(own, notes), "__note")
    assert read(spans.near(own, notes, 180), NEAR) == whole and len(whole) == len(at) + 2
    assert {r["note_id"] for r in spans.near(own, notes, 180, how="left").where(f"{NEAR}.text is null").collect()} == {"d", "z"}
    held = spans.near(own.where("note_id = 'a' and start >= 0 and end <= 5000 and end - start < 800"), notes, 180, placed=True)
    assert held.agg(F.max(F.length(f"{NEAR}.text"))).first()[0] <= 180 + 2 * spans.AROUND
