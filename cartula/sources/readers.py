"""Readers of notes, lexicons, catalogs, annotations and indexes."""

from __future__ import annotations

from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartula.functions import fixed
from cartula.functions.text import NEAR, valid_span
from cartula.operators import spans

_LAST = 10**9


def notes(spark: SparkSession, path: str, streaming: bool = False, files: int = 1000) -> DataFrame:
    """note_id (the file's name), ord, text of a folder of text files: numbers first, in order. A byte order mark goes."""
    if streaming:
        raw = spark.readStream.option("maxFilesPerTrigger", files).text(path, wholetext=True)
    else:
        raw = spark.read.text(path, wholetext=True)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    return raw.select(stem.alias("note_id"), F.coalesce(F.expr("try_cast(regexp_replace(_metadata.file_name, '[.][^.]*$', '') AS BIGINT)"), F.lit(_LAST)).alias("ord"), F.regexp_replace("value", "^﻿", "").alias("text"))


def config(path: str | Path) -> dict:
    """A YAML file, on the driver."""
    return yaml.safe_load(Path(path).read_text("utf-8-sig")) or {}


def section_aliases(path: str | Path) -> list[tuple[str, str]]:
    """canonical, surface of every header that is listed."""
    return [(str(k), str(v)) for k, values in config(path).items() for v in values or []]


def assertion_cues(path: str | Path) -> dict[str, tuple[str, ...]]:
    """Cues of each assertion, as a YAML file lists them; what it leaves out has none."""
    own = config(path)
    return {name: tuple(str(v) for v in own.get(name) or []) for name in fixed.ASSERTIONS}


def section_policy(spark: SparkSession, payload: dict) -> DataFrame:
    """A row for each kind of section; what it doesn't say is null."""
    names = {"role": "role", "min_priority": "symptom_alias_min_priority", "symptom_structural": "symptom_structural", "diagnosis_structural": "diagnosis_structural", "assertion_history": "assertion_history", "assertion_family": "assertion_family", "rule_trust": "symptom_rule_trust"}
    rows = [(k, *((v or {}).get(n) for n in names.values())) for k, v in payload.items()]
    return spark.createDataFrame(rows, "section string, role string, min_priority int, symptom_structural boolean, diagnosis_structural boolean, assertion_history boolean, assertion_family boolean, rule_trust string")


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("encoding", "UTF-8").csv(path)


def _or(c: str, default: Column | str) -> Column:
    own = F.trim(F.coalesce(F.col(c), F.lit("")))
    return F.when(own == "", default if isinstance(default, Column) else F.lit(default)).otherwise(own)


def _priority() -> Column:
    return F.coalesce(F.expr("try_cast(priority AS INT)"), F.lit(50)).alias("priority")


def lexicon(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """surface, canonical and what the kind has: tests (category, priority), symptoms (priority), diagnoses (codes, priority), drugs (code, source).

    Surfaces shorter than 1, 2, 3 and 3 characters are left out; of drugs that are equal but for case the first stays."""
    rows = _csv(spark, path)
    surface = F.trim(F.col("term" if kind == "drugs" else "surface_form"))
    rows = rows.withColumn("surface", surface).where(F.length("surface") >= {"tests": 1, "symptoms": 2, "diagnoses": 3, "drugs": 3}[kind])
    canonical = _or("canonical_name", F.col("surface")).alias("canonical")
    if kind == "tests":
        return rows.select("surface", canonical, _or("category", "laboratory").alias("category"), _priority())
    if kind == "symptoms":
        return rows.select("surface", canonical, _priority())
    if kind == "diagnoses":
        codes = F.filter(F.transform(F.split(F.coalesce("icd_codes", F.lit("")), "[|]"), lambda c: F.trim(c)), lambda c: c != "")
        return rows.select("surface", canonical, codes.alias("codes"), _priority())
    own = rows.select("surface", canonical, _or("rxcui", "").alias("code"), _or("source", "dictionary").alias("source"), F.monotonically_increasing_id().alias("__n"))
    w = Window.partitionBy(F.lower("surface")).orderBy("__n")
    return own.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__n", "__r")


def icd_catalog(spark: SparkSession, path: str, national: str | None = None) -> DataFrame:
    """row, code, title, category: terminal codes, then a national catalog's."""
    own = _csv(spark, path).where(F.upper(F.trim("terminal_flag")) == "T").select("code", "title", F.col("category_title").alias("category"), F.lit(0).alias("__k"))
    if national:
        rows = _csv(spark, national).select(F.trim("code").alias("code"), F.trim("name_vi").alias("title"), F.coalesce("group_vi", F.lit("")).alias("category"), F.lit(1).alias("__k"))
        own = own.unionByName(rows.where("code <> '' and title <> ''"))
    return own.select(F.xxhash64("__k", "code", "title", "category").alias("row"), "code", "title", "category")


def icd_aliases(spark: SparkSession, path: str, national: str | None = None) -> DataFrame:
    """key, codes: surfaces and canonical names (of one key the last row's codes), and a national catalog's titles (all their codes)."""
    from cartula.operators.linking import code_map

    rows = lexicon(spark, path, "diagnoses").withColumn("ord", F.monotonically_increasing_id())
    both = rows.select("surface", "codes", (F.col("ord") * 2).alias("ord")).unionByName(rows.select(F.col("canonical").alias("surface"), "codes", (F.col("ord") * 2 + 1).alias("ord")))
    found = code_map(both, last_wins=True)
    if national:
        titles = _csv(spark, national).select(F.trim("name_vi").alias("surface"), F.array(F.trim("code")).alias("codes"), F.monotonically_increasing_id().alias("ord"))
        more = code_map(titles)
        found = found.join(more.withColumnRenamed("codes", "more"), "key", "full").select("key", F.array_union(F.coalesce("codes", F.array().cast("array<string>")), F.coalesce("more", F.array().cast("array<string>"))).alias("codes"))
    return found


def proved_codes(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """key, codes of a JSON file of checked mappings: kind icd (exact ones, sure to 0.99) or rxnorm (five surfaces each)."""
    from cartula.operators.linking import code_map

    if kind == "icd":
        one = "struct<mapping_method:string,confidence:double,vn_mention:string,selected_concept:struct<code:string,name_vi:string>>"
        surfaces, code = ["vn_mention", "selected_concept.name_vi"], "selected_concept.code"
    else:
        one = "struct<original_text:string,parsed:struct<raw_text:string,normalized_text:string,drug_name:string>,selected_concept:struct<rxcui:string,name:string>>"
        surfaces, code = ["original_text", "parsed.raw_text", "parsed.normalized_text", "parsed.drug_name", "selected_concept.name"], "selected_concept.rxcui"
    rows = spark.read.schema(f"verified array<{one}>").option("multiLine", True).json(path).select(F.posexplode("verified").alias("n", "v"))
    if kind == "icd":
        rows = rows.where("v.mapping_method = 'exact_icd10' and v.confidence >= 0.99")
    rows = rows.select("n", F.trim(f"v.{code}").alias("code"), F.posexplode(F.array(*[F.col(f"v.{s}") for s in surfaces])).alias("k", "surface")).where("code <> ''")
    return code_map(rows.select("surface", F.array("code").alias("codes"), (F.col("n") * 10 + F.col("k")).alias("ord")))


def rx_catalog(spark: SparkSession, path: str) -> DataFrame:
    """rxcui, name, tty of a Parquet, JSON or pipe-delimited file, by its ending; of the last only English rows that are not suppressed."""
    if path.endswith(".json"):
        raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<map<string,string>>")).alias("m"))
        pick = lambda a, b: F.coalesce(F.element_at("m", F.lit(a)), F.element_at("m", F.lit(b)))
        own = raw.select(pick("rxcui", "RXCUI").alias("rxcui"), pick("name", "STR").alias("name"), pick("tty", "TTY").alias("tty"))
        return own.where("rxcui <> '' and name <> '' and tty <> ''")
    if path.endswith(".RRF"):
        parts = F.split("value", "[|]")
        rows = spark.read.text(path).select(parts.alias("p")).where((F.size("p") > 16) & (F.col("p")[1] == "ENG") & (F.col("p")[16] == "N"))
        return rows.select(F.col("p")[0].alias("rxcui"), F.col("p")[14].alias("name"), F.col("p")[12].alias("tty"))
    return spark.read.parquet(path).select(F.col("RXCUI").cast("string").alias("rxcui"), F.col("STR").alias("name"), F.col("TTY").alias("tty"))


def review_lexicon(spark: SparkSession, path: str, ttys: tuple[str, ...] = ("IN", "PIN", "BN")) -> DataFrame:
    """surface, codes of names of a pipe-delimited catalog: 4 to 60 characters, up to five words."""
    from cartula.functions.text import fold

    rows = rx_catalog(spark, path).where(F.col("tty").isin(*ttys)).select(fold("name").alias("surface"), "rxcui")
    rows = rows.where(F.length("surface").between(4, 60) & (F.size(F.split("surface", " ")) <= 5))
    return rows.groupBy("surface").agg(F.array_sort(F.collect_set("rxcui")).alias("codes"))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """note_id, seq, start, end, text, type, assertions, candidates of JSON arrays, a file a note."""
    one = "array<struct<text:string,position:array<int>,type:string,assertions:array<string>,candidates:array<string>>>"
    raw = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("note_id"), F.from_json("value", one).alias("v"))
    empty = F.array().cast("array<string>")
    rows = raw.select("note_id", F.posexplode("v").alias("seq", "e"))
    return rows.select("note_id", "seq", F.col("e.position")[0].alias("start"), F.col("e.position")[1].alias("end"), "e.text", "e.type", F.coalesce("e.assertions", empty).alias("assertions"), F.coalesce("e.candidates", empty).alias("candidates"))


def anchors(rows: DataFrame, notes_: DataFrame, confidence: float = 0.97) -> DataFrame:
    """Annotations of an earlier run, judged: accepted and reason (offset_mismatch, invalid, duplicate, missing_note)."""
    fits, noted = valid_span(NEAR, "start", "end", "text"), F.col(f"{NEAR}.text").isNotNull()
    own = spans.near(rows, notes_, 0, how="left").withColumns({"__fits": fits, "__noted": noted}).drop(NEAR)
    n = F.row_number().over(Window.partitionBy("note_id", "start", "end", "type").orderBy("seq"))
    reason = F.when(~F.col("__noted"), "missing_note").when(~F.col("type").isin(*fixed.TYPES) | F.col("start").isNull(), "invalid").when(~F.col("__fits"), "offset_mismatch").when(F.col("__n") > 1, "duplicate")
    own = own.withColumn("__n", n).withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())
    return own.withColumn("reason", F.coalesce("reason", F.lit("accepted"))).withColumn("source", F.lit("baseline_anchor")).withColumn("confidence", F.lit(confidence)).drop("__n", "__noted", "__fits")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """id, text_path, gold_path, source: a JSON row a line."""
    return spark.read.schema("id string, text_path string, gold_path string, source string").json(path)


def examples(texts: DataFrame, gold: DataFrame) -> DataFrame:
    """note_id, start, end, text, type of annotations (see annotations) that are the text at their place in notes; others are left out."""
    own = spans.near(gold, texts, 0)
    return own.where(valid_span(NEAR, "start", "end", "text")).select("note_id", "start", "end", "text", "type")


def vector_index(spark: SparkSession, path: str) -> DataFrame:
    """doc, vec and whatever else the index has; fails if vectors differ in length."""
    rows = spark.read.parquet(path)
    sizes = rows.agg(F.min(F.size("vec")).alias("a"), F.max(F.size("vec")).alias("z")).first()
    if sizes["a"] != sizes["z"]:
        raise ValueError(f"vectors of {sizes['a']} to {sizes['z']} dimensions")
    return rows
