"""The hybrid pipeline with fake models inside, a server that fails, and replies that are kept."""

import json

import pytest
from pyspark.sql import functions as F

from cartula.functions.fixed import DIAGNOSIS, DRUG, SYMPTOM
from cartula.operators import models
from cartula.operators.replies import Replies
from cartula.plans import fixtures, modelled, pipelines

NOTES = dict(fixtures.NOTES)


def _log(path):
    """A function that notes what a model was asked, over all workers."""

    def note(line):
        with open(path, "a", encoding="utf-8") as f:
            f.write(json.dumps(line) + "\n")

    return note


def _read(path):
    return [json.loads(x) for x in path.read_text("utf-8").splitlines()] if path.exists() else []


def test_replies_are_asked_once(spark, tmp_path):
    asked, log, broken = tmp_path / "asked", _log(tmp_path / "asked"), tmp_path / "broken"
    rows = spark.createDataFrame([(f"u{i % 50}",) for i in range(120)], "user string").withColumn("system", F.lit("s"))
    rows = rows.withColumn("key", models.request_key("m", "system", "user"))
    broken.write_text("x")

    def server(system, user):
        if broken.exists() and user in ("u7", "u31"):
            raise TimeoutError("no answer")
        log(user)
        return user.upper()

    store = Replies(spark, str(tmp_path / "store"))
    for _ in range(2):
        with pytest.raises(models.ModelError, match="no answer"):
            store.ask(rows, server, batch=10)
    before = _read(asked)
    assert 0 < len(before) < 50 and store.known().count() == len(before) == len(set(before))
    broken.unlink()
    got = {(r["user"], r["reply"]) for r in store.ask(rows, server, batch=10).collect()}
    assert got == {(f"u{i}", f"U{i}") for i in range(50)}
    assert sorted(_read(asked)) == sorted(f"u{i}" for i in range(50))  # none twice
    assert store.ask(rows, None).where("reply is null").count() == 0 and store.ask(rows.limit(0), None).count() == 0


def _models(log):
    def extract(system, user):
        log(["extract", user])
        own = user[user.index("INPUT:\n") + 7 : user.rindex("\nOUTPUT:")]
        said = [{"text": w, "type": t, "context": ""} for w, t in (("sốt", "TRIỆU CHỨNG"), ("ho", "TRIỆU CHỨNG"), ("viêm gan lạ", "CHẨN ĐOÁN")) if w in own]
        return "<think>so</think>" + json.dumps({"entities": said}, ensure_ascii=False) + ("" if len(own) % 2 else " done")

    def verify(system, user):
        log(["verify", user])
        return json.dumps({"decisions": [{"index": c["index"], "keep": c["text"] != "ho", "type": c["type"]} for c in json.loads(user)["candidates"]]}, ensure_ascii=False)

    def normalise(system, user):
        log(["normalise", user])
        return json.dumps({"items": [{"id": x["id"], "normalized": "viêm gan"} for x in json.loads(user[user.index("[") : user.rindex("]") + 1]) if "gan" in x["text"]]}, ensure_ascii=False)

    def rerank(pairs):
        log(["rerank", len(pairs)])
        return [0.9 if "B19" in candidate else 0.1 for _, candidate in pairs]

    tokens = lambda texts: [[(t.index("sốt"), t.index("sốt") + 3, SYMPTOM, 0.99)] if "sốt" in t else [] for t in texts]
    return modelled.Models("fake", extract, verify, normalise, rerank, {"gliner": tokens})


def test_hybrid_with_its_models(spark, tmp_path):
    """What is asked comes from the notes, what is answered decides the outcome, and all of it is kept."""
    notes, res = fixtures.notes(spark), fixtures.resources(spark)
    more = spark.createDataFrame([("9", "Chẩn đoán: viêm gan lạ\nTiền sử bệnh: sốt, ho")], notes.select("note_id", "text").schema)
    notes = notes.select("note_id", "text").unionByName(more)
    last = res["icd_catalog"].agg(F.max("row")).first()[0]
    res["icd_catalog"] = res["icd_catalog"].unionByName(spark.createDataFrame([(last + 1, "B19", "viêm gan không xác định", ""), (last + 2, "K75", "viêm gan khác", "")], res["icd_catalog"].select("row", "code", "title", "category").schema))
    config = pipelines.Config(verifier=True, uncorroborated=(SYMPTOM, DIAGNOSIS), gate_least=0.5, cleanup=False, llm_least=0.5)
    log = _log(tmp_path / "asked")
    got = pipelines_rows(modelled.hybrid(notes, res, _models(log), str(tmp_path / "store"), config))
    texts = NOTES | {"9": more.first()["text"]}
    assert all(texts[n][r["start"] : r["end"]] == t for (n, t, _), r in got.items())
    hit = got["9", "viêm gan lạ", DIAGNOSIS]
    assert hit["normalized"] == "viêm gan" and hit["candidates"] == ["B19"] and hit["link_method"] == "icd_hybrid_reranker"
    assert ("9", "ho", SYMPTOM) not in got or got["9", "ho", SYMPTOM]["source"] not in ("self_host_llm", "gliner")  # the verifier's no
    assert "gliner" in {got["9", "sốt", SYMPTOM]["source"], *got["9", "sốt", SYMPTOM]["supporting_sources"]}
    asked = _read(tmp_path / "asked")
    kinds = {k for k, _ in asked}
    assert kinds == {"extract", "verify", "normalise", "rerank"}
    talks = [json.dumps(a) for a in asked if a[0] != "rerank"]
    assert len(talks) == len(set(talks))
    assert Replies(spark, str(tmp_path / "store")).known().count() == len(talks)  # a further run would ask nobody


def pipelines_rows(df):
    return {(r["note_id"], r["text"], r["type"]): r for r in df.select("note_id", "start", "end", "text", "type", "source", "supporting_sources", "normalized", "candidates", "link_method").collect()}


def test_tables_by_span(spark):
    """A caller who has finished tables names rows by their spans."""
    notes, res = fixtures.notes(spark), fixtures.resources(spark)
    text = NOTES["1"]
    at = text.index("sốt")
    gliner = spark.createDataFrame([("1", at, at + 3, "sốt", SYMPTOM, 0.99)], "note_id string, start int, end int, text string, type string, confidence double")
    drug = text.index("aspirin 81 mg mỗi ngày")
    res["normalized"] = spark.createDataFrame([("1", drug, drug + 22, DRUG, "acetylsalicylic acid")], "note_id string, start int, end int, type string, normalized string")
    res["decisions"] = spark.createDataFrame([("1", at, at + 3, SYMPTOM, False)], "note_id string, start int, end int, type string, keep boolean")
    got = {(r["note_id"], r["text"]): r for r in pipelines.hybrid(notes, res, pipelines.Config(verifier=True), gliner=gliner).collect()}
    assert got["1", "aspirin 81 mg mỗi ngày"]["normalized"] == "acetylsalicylic acid"
    assert ("1", "sốt") not in got or "gliner" not in [got["1", "sốt"]["source"], *got["1", "sốt"]["supporting_sources"]]
