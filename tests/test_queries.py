"""The registry: names, SQL, and what queries keep."""

import __spark_entry__ as entry


def test_sql_goes_with_queries():
    made, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(made) and len(made) >= 80 and all(isinstance(q, str) and q.strip() for q in sql.values())


def test_queries_free_what_others_kept(spark, tmp_path):
    from cartula import session

    texts = [(k, f"the kalo mite lorum {k}\nder vanitas mite\nla kalo torum mite lorum") for k in range(12)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = entry.queries()
    for name in ("rule_admission", "consensus_promotion", "dict_scan"):
        assert made[name](spark, str(tmp_path)).count() > 0
    assert not session._KEPT


def test_bounded_lexicons(spark, monkeypatch):
    """Lexicons beyond their bounds go in several passes, with the same results."""
    from cartula.operators import lexicon

    notes = spark.createDataFrame([(k, f"alpha beta gamma{k % 3} delta alpha") for k in range(20)], "note_id long, text string")
    words = spark.createDataFrame([(w, i) for i, w in enumerate(["alpha", "beta", "gamma1", "delta", "alpha beta", "beta gamma2"])], "surface string, n int")
    hits = lambda: sorted(map(tuple, lexicon.scan(notes, words).collect()))
    once = hits()
    monkeypatch.setattr(lexicon, "AUTOMATON_ROWS", 2)
    assert hits() == once and once


def _like_sql(spark, tmp_path, name, texts):
    """Rows of a query over documents, and of its SQL, sorted."""
    import duckdb
    import pyarrow as pa

    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    own = entry.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}))
    return sorted(map(tuple, own.collect())), sorted(con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in own.columns)} FROM ({entry.oracle_sql()[name]})").fetchall())


def test_capitals_are_one_letter_each(spark, tmp_path):
    """A surface with a letter whose upper case Java makes two of."""
    own, sql = _like_sql(spark, tmp_path, "same_span_merge", ["auß der kalo", "die auß kalo"])
    assert own == sql and any("AUẞ" in r[-1] for r in own)


def test_likeness_counts_letters_as_they_are(spark, tmp_path):
    """Short lines with a letter that case folding makes two of, behind planted headers."""
    own, sql = _like_sql(spark, tmp_path, "fuzzy_headers", ["\n".join(["ßßß"[: k % 4], "daß", "Auß:", "ß"] * 12) for k in range(40)])
    assert own == sql and own
