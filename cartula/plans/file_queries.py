"""Queries that write what the tables hold to files and read it back, through every reader and writer, and the SQL that says the same without files.

Files lie in the shared folder, in a folder of their own for each call, which the next call of the query removes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartula.functions.fixed import DIAGNOSIS, DRUG, SYMPTOM
from cartula.functions.text import upper_each
from cartula.operators import retrieval
from cartula.plans import queries as base
from cartula.session import shared_folder
from cartula.sources import readers, sinks

_LAST_FOLDER: dict[str, str] = {}


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder for a query; that of its last call goes."""
    path = f"{shared_folder(spark)}/files-{name}-{uuid.uuid4().hex}"
    old = _LAST_FOLDER.get(name)
    _LAST_FOLDER[name] = path
    if old:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    return path


def _lines(rows: DataFrame, path: str) -> str:
    """Writes a column of lines as text files."""
    rows.write.text(path)
    return path


def csv_lexicons(spark, sf_dir):
    """The corpus' lexicon, written as CSV with a mark of its encoding and read as a lexicon of tests, symptoms, diagnoses and drugs."""
    words = base.corpus_lexicon(base._notes(spark, sf_dir)).withColumn("n", F.length("surface"))
    spaced = lambda c: F.concat(F.lit(" "), c, F.lit("  "))
    shared = [F.when(F.col("n") % 2 == 0, spaced(upper_each("surface"))).otherwise("").alias("canonical_name"), F.when(F.col("n") % 3 == 0, F.lit("x")).otherwise(F.col("priority").cast("string")).alias("priority")]
    made = words.select(F.lit("-").alias("mark"), spaced(F.col("surface")).alias("surface_form"), F.col("surface").alias("term"), *shared, F.when(F.col("n") % 4 == 0, F.col("kind")).alias("category"), F.concat(F.lit("A1| "), upper_each(F.substring("surface", 1, 1)), F.lit("2 ||")).alias("icd_codes"), F.concat(F.lit(" "), F.col("n").cast("string")).alias("rxcui"))
    path = _folder(spark, "csv_lexicons")
    sinks.write_csv(made, path)
    own = None
    for kind, code, order in (("tests", F.col("category"), F.col("priority")), ("symptoms", F.lit(""), F.col("priority")), ("diagnoses", F.array_join("codes", ","), F.col("priority")), ("drugs", F.concat_ws("/", "code", "source"), F.lit(0))):
        # without a column named source all drugs are from a dictionary
        rows = readers.lexicon(spark, path, kind) if kind != "drugs" else readers.lexicon(spark, _with_source(spark, path), kind)
        rows = rows.select(F.lit(kind).alias("kind"), "surface", "canonical", code.alias("code"), order.cast("int").alias("priority"))
        own = rows if own is None else own.unionByName(rows)
    return own


def _with_source(spark: SparkSession, path: str) -> str:
    """The CSV again, with an empty column source."""
    rows = spark.read.option("header", True).csv(path)
    rows.withColumn("source", F.lit("")).write.mode("overwrite").option("header", True).csv(f"{path}-drugs")
    return f"{path}-drugs"


def json_entities(spark, sf_dir):
    """Longest hits, written as JSON arrays a note in two runs, the second for what the first left, and read back as text."""
    hits = base._longest(spark, sf_dir).withColumn("type", F.when(F.col("kind") == "A", DIAGNOSIS).when(F.col("kind") == "B", DRUG).otherwise(SYMPTOM))
    rows = hits.select("note_id", "start", "end", "text", "type", F.array(F.lit("x"), F.lit("x")).alias("assertions"), F.array("surface").alias("candidates"))
    notes, path = base._notes(spark, sf_dir), _folder(spark, "json_entities")
    sinks.write_json(rows.where("note_id % 3 = 0"), path, notes=notes.where("note_id % 3 = 0"))
    rest = sinks.unfinished(notes, path)
    sinks.write_json(rows.join(rest.select("note_id"), "note_id", "left_semi"), path, notes=rest)
    return spark.read.schema("note_id long, json string").json(path).select(F.col("note_id").alias("doc_id"), F.md5("json").alias("json_md5"), (F.length("json") > 2).alias("some"))


def text_files(spark, sf_dir):
    """Benchmark items as text files of their own, with a byte order mark in front of every third, read back as notes."""
    items = base._table(spark, sf_dir, "benchmark")
    path = _folder(spark, "text_files")
    marked = F.concat(F.when(F.col("item_id") % 3 == 0, "\ufeff").otherwise(""), F.col("text"))
    items.select("item_id", marked.alias("value")).repartition("item_id").write.partitionBy("item_id").option("lineSep", "\u0003").text(path)
    notes = readers.notes(spark, f"{path}/item_id=*")
    return notes.select(F.regexp_replace("text", "\u0003$", "").alias("text")).select(F.md5("text").alias("text_md5"), F.length("text").alias("n"))


def rx_files(spark, sf_dir):
    """A drug catalogue of the corpus' words as Parquet, JSON and pipe-delimited rows, each read back, and the surfaces to review."""
    words = base.corpus_lexicon(base._notes(spark, sf_dir)).withColumn("n", F.length("surface"))
    rows = words.select(F.concat(F.col("n").cast("string"), F.col("kind")).alias("RXCUI"), F.col("surface").alias("STR"), F.element_at(F.array(*[F.lit(t) for t in ("IN", "SCD", "BN", "PIN")]), (F.col("n") % 4 + 1).cast("int")).alias("TTY"), "n")
    path = _folder(spark, "rx_files")
    rows.drop("n").write.parquet(f"{path}/a.parquet")
    listed = rows.groupBy(F.col("n").alias("k")).agg(F.to_json(F.collect_list(F.struct(F.col("RXCUI").alias("rxcui"), F.col("STR").alias("STR"), F.col("TTY").alias("tty")))).alias("value"))
    listed.repartition("k").write.partitionBy("k").text(f"{path}/a.json")  # a list for each length of words, in a file of its own
    blank = [F.lit("")] * 11
    lat = F.when(F.col("n") % 5 == 0, "FRE").otherwise("ENG")
    sup = F.when(F.col("n") % 7 == 0, "Y").otherwise("N")
    _lines(rows.select(F.concat_ws("|", "RXCUI", lat, *blank[:10], "TTY", F.lit(""), "STR", F.lit(""), sup, F.lit("")).alias("value")), f"{path}/a.RRF")
    out = readers.rx_catalog(spark, f"{path}/a.parquet").withColumn("source", F.lit("parquet"))
    out = out.unionByName(readers.rx_catalog(spark, f"{path}/a.RRF").withColumn("source", F.lit("rrf")))
    out = out.unionByName(readers.rx_catalog(spark, f"{path}/a.json").withColumn("source", F.lit("json")))
    review = readers.review_lexicon(spark, f"{path}/a.RRF").select(F.array_join("codes", ",").alias("rxcui"), F.col("surface").alias("name"), F.lit("").alias("tty"), F.lit("review").alias("source"))
    return out.unionByName(review)


def annotation_files(spark, sf_dir):
    """Annotations of the longest hits, one in five of them moved, one in seven repeated, judged as anchors of an earlier run."""
    hits = base._longest(spark, sf_dir)
    moved = F.when(F.col("start") % 5 == 0, 1).otherwise(0)
    rows = hits.select("note_id", F.col("start").alias("seq"), (F.col("start") + moved).alias("start"), (F.col("end") + moved).alias("end"), "text", F.when(F.col("start") % 11 == 0, "other").otherwise(SYMPTOM).alias("type"), F.explode(F.sequence(F.lit(0), F.when(F.col("start") % 7 == 0, 1).otherwise(0))).alias("copy"))
    rows = rows.withColumn("seq", F.col("seq") * 2 + F.col("copy"))
    notes = base._notes(spark, sf_dir).where("note_id % 13 <> 0")
    return readers.anchors(rows, notes).select(F.col("note_id").alias("doc_id"), "seq", "accepted", "reason")


def index_files(spark, sf_dir):
    """Vectors, indexed, written, read again and asked: the nearest of every fiftieth, itself included."""
    rows = base._vectors(spark, sf_dir).withColumnRenamed("vec_id", "doc")
    path = _folder(spark, "index_files")
    retrieval.cell_index(rows, whole=0).save(path)
    found = retrieval.cosine(retrieval.CellIndex.load(spark, path), rows.where("doc % 50 = 0").withColumnRenamed("doc", "query"), 3, 4)
    return found.select(F.col("query").alias("query_id"), F.col("doc").alias("vec_id"), "rank", "score")


QUERIES = {f.__name__: f for f in (csv_lexicons, json_entities, text_files, rx_files, annotation_files, index_files)}

# --- The same in SQL ------------------------------------------------------------------------

_KIND = f"CASE kind WHEN 'A' THEN '{DIAGNOSIS}' WHEN 'B' THEN '{DRUG}' ELSE '{SYMPTOM}' END"
_CANON = "CASE WHEN length(surface) % 2 = 0 THEN upper(surface) ELSE surface END"
_PRIO = "CASE WHEN length(surface) % 3 = 0 THEN 50 ELSE priority END"
ORACLES = {
    "csv_lexicons": f"""WITH {base._WORDS}
SELECT 'tests' AS kind, surface, {_CANON} AS canonical, CASE WHEN length(surface) % 4 = 0 THEN kind ELSE 'laboratory' END AS code, {_PRIO}::INT AS priority FROM lexicon
UNION ALL SELECT 'symptoms', surface, {_CANON}, '', {_PRIO}::INT FROM lexicon WHERE length(surface) >= 2
UNION ALL SELECT 'diagnoses', surface, {_CANON}, 'A1,' || upper(surface[1]) || '2', {_PRIO}::INT FROM lexicon WHERE length(surface) >= 3
UNION ALL SELECT 'drugs', surface, {_CANON}, length(surface) || '/dictionary', 0 FROM lexicon WHERE length(surface) >= 3""",
    "json_entities": f"""{base._WITH}, {base._walk("hits", "h")},
x AS (SELECT doc_id, start, "end", surface, {_KIND} AS type, substr(text, start + 1, "end" - start) AS own FROM h JOIN documents USING (doc_id)),
j AS (SELECT doc_id, '[' || string_agg('{{"text":"' || own || '","position":[' || start || ',' || "end" || '],"type":"' || type || '","assertions":["x"]' || CASE WHEN type <> '{SYMPTOM}' THEN ',"candidates":["' || surface || '"]' ELSE '' END || '}}', ',' ORDER BY start, "end") || ']' AS json FROM x GROUP BY 1)
SELECT doc_id, md5(coalesce(json, '[]')) AS json_md5, json IS NOT NULL AS some FROM documents LEFT JOIN j USING (doc_id)""",
    "text_files": "SELECT md5(text) AS text_md5, length(text)::INT AS n FROM benchmark",
    "rx_files": f"""WITH {base._WORDS}, r AS (SELECT length(surface) || kind AS rxcui, surface AS name, ['IN', 'SCD', 'BN', 'PIN'][length(surface) % 4 + 1] AS tty, length(surface) AS n FROM lexicon),
e AS (SELECT * FROM r WHERE n % 5 <> 0 AND n % 7 <> 0)
SELECT rxcui, name, tty, s AS source FROM r, (VALUES ('parquet'), ('json')) t(s) UNION ALL SELECT rxcui, name, tty, 'rrf' FROM e
UNION ALL SELECT string_agg(DISTINCT rxcui, ',' ORDER BY rxcui), name, '', 'review' FROM e WHERE tty <> 'SCD' AND n BETWEEN 4 AND 60 GROUP BY name""",
    "annotation_files": f"""{base._WITH}, {base._walk("hits", "h")},
a AS (SELECT doc_id, start * 2 + c AS seq, start + (start % 5 = 0)::INT AS a, "end" + (start % 5 = 0)::INT AS z, start, "end", start % 11 = 0 AS other, c FROM h, (VALUES (0), (1)) t(c) WHERE c = 0 OR start % 7 = 0),
b AS (SELECT a.*, substr(text, a + 1, z - a) = substr(text, start + 1, "end" - start) AS fits, row_number() OVER (PARTITION BY doc_id, a, z, other ORDER BY seq) AS n FROM a JOIN documents USING (doc_id)),
r AS (SELECT doc_id, seq, CASE WHEN doc_id % 13 = 0 THEN 'missing_note' WHEN other THEN 'invalid' WHEN NOT fits OR z > (SELECT length(text) FROM documents d WHERE d.doc_id = b.doc_id) THEN 'offset_mismatch' WHEN n > 1 THEN 'duplicate' ELSE 'accepted' END AS reason FROM b)
SELECT doc_id, seq::INT AS seq, reason = 'accepted' AS accepted, reason FROM r""",
    "index_files": f"WITH {base._COS.format(which='q.vec_id % 50 = 0').replace('q.vec_id <> c.vec_id AND ', '')} SELECT query AS query_id, doc AS vec_id, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc)::INT AS rank, score FROM cs QUALIFY rank <= 3",
}
