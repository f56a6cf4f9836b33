"""Writers of entities, tables and settings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartula.functions.fixed import DIAGNOSIS, DRUG


def export_rows(rows: DataFrame, debug: bool = False) -> DataFrame:
    """note_id, start, end, row: what is handed on of an entity; candidates of diagnoses and drugs only."""
    fields = [
        F.col("text"), F.array("start", "end").alias("position"), F.col("type"), F.array_distinct("assertions").alias("assertions"),
        F.when(F.col("type").isin(DIAGNOSIS, DRUG), F.array_distinct("candidates")).alias("candidates"),
    ]
    if debug:
        fields += [F.col(c) for c in ("confidence", "source", "section")]
    return rows.select("note_id", "start", "end", F.struct(*fields).alias("row"))


def as_json(rows: DataFrame, debug: bool = False, notes: DataFrame | None = None) -> DataFrame:
    """note_id, json: the entities of a note, by place, as one JSON array; an empty one for notes that have none."""
    own = export_rows(rows, debug).groupBy("note_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "row"))).alias("all"))
    made = own.select("note_id", F.to_json(F.transform("all", lambda x: x["row"])).alias("json"))
    return made if notes is None else notes.select("note_id").join(made, "note_id", "left").na.fill("[]", ["json"])


def write_json(rows: DataFrame, path: str, debug: bool = False, notes: DataFrame | None = None) -> None:
    """Adds to a table at path: a row of note_id and JSON array for each note, in as many files as there are tasks, not notes.

    With notes those without entities count as done, too.
    """
    as_json(rows, debug, notes).write.mode("append").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header, and a byte order mark in front of it, by which some programs know UTF-8."""
    first, *others = rows.columns
    rows.withColumnRenamed(first, "\ufeff" + first).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def write_index(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("overwrite").parquet(path)


def unfinished(notes: DataFrame, path: str) -> DataFrame:
    """Notes that have no output at path yet: a run that broke off goes on from there."""
    spark = notes.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return notes
    done = spark.read.schema(f"note_id {notes.schema['note_id'].dataType.simpleString()}").json(path).distinct()
    return notes.join(done, "note_id", "left_anti")
