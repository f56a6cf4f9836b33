"""The hybrid pipeline with its models inside: callables that are asked in turn.

Token models read chunks; a language model reads chunks with hints, decides on risky spans and
gives normal forms; a cross encoder scores the pool of codes of what no link was found for.
Replies are kept in a table (see ``operators.replies``), so a run that breaks off goes on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartula.functions.fixed import DIAGNOSIS, DRUG
from cartula.operators import extract, filters, linking, models, retrieval, spans, windows
from cartula.operators.replies import Replies
from cartula.plans import pipelines
from cartula.session import cut

Chat = Callable[[str, str], str]


@dataclass(frozen=True)
class Models:
    """What is asked; a model that is missing adds nothing. name goes into the keys of requests.

    extract, verify and normalise take a system's and a user's text and give a reply; rerank takes pairs of a mention in its
    context and a candidate and gives scores; tokens (by source) take texts and give start, end, type, confidence of spans.
    """

    name: str = "model"
    extract: Chat | None = None
    verify: Chat | None = None
    normalise: Chat | None = None
    rerank: Callable[[list[tuple[str, str]]], list[float]] | None = None
    tokens: dict[str, Callable] = field(default_factory=dict)
    systems: dict[str, str] = field(default_factory=lambda: {"extract": "List the medical entities as JSON.", "verify": "Decide on each candidate as JSON.", "normalise": "Give each item's usual name as JSON."})


def _keyed(requests: DataFrame, model: Models, task: str) -> DataFrame:
    rows = requests.withColumn("system", F.lit(model.systems[task]))
    return rows.withColumn("key", models.request_key(model.name, "system", "user"))


def extracted(notes: DataFrame, secs: DataFrame, shown: DataFrame, model: Models, store: Replies, size: int = 1800, overlap: int = 120) -> DataFrame:
    """Spans that the language model finds: chunks with hints, replies, places of what they name, and how the hints support them."""
    chunks = windows.semantic_chunks(notes, secs, size, overlap)
    chunks = cut(spans.with_own_text(chunks.withColumn("chunk", F.concat_ws("/", "note_id", "start", "heading")), notes))
    asked = _keyed(models.prompts(models.hints(chunks, shown)), model, "extract")
    told = store.ask(asked.select("chunk", "key", "system", "user"), model.extract)
    rows = cut(extract.in_order(extract.entities(models.aligned(models.parsed(told.select("chunk", "reply")), chunks))))
    return models.with_support(rows, shown)


def decisions(rows: DataFrame, notes: DataFrame, model: Models, store: Replies, size: int = 12) -> DataFrame:
    """note_id, seq, keep, type of risky spans, in batches within their notes; of what a reply repeats the last counts."""
    risky = rows.where(filters.unsafe())
    places = models.verifier_batches(risky, size)
    own = spans.with_text(risky.join(places, ["note_id", "seq"]), notes)
    around = F.substring("__note", F.greatest(F.col("start") - 100, F.lit(0)) + 1, F.col("end") + 100 - F.greatest(F.col("start") - 100, F.lit(0)))
    item = F.struct("index", "text", "type", "section", around.alias("context"))
    asked = own.groupBy("note_id", "batch").agg(F.array_sort(F.collect_list(item)).alias("candidates"))
    asked = _keyed(asked.select("note_id", "batch", F.to_json(F.struct("candidates")).alias("user")), model, "verify")
    told = store.ask(asked, model.verify).select("note_id", "batch", F.posexplode(models.items_reply(F.col("reply"), "decisions", "index INT, keep BOOLEAN, type STRING")).alias("n", "d"))
    last = told.groupBy("note_id", "batch", F.col("d.index").alias("index")).agg(F.max(F.struct("n", "d")).alias("x"))
    return places.join(last, ["note_id", "batch", "index"]).select("note_id", "seq", F.coalesce("x.d.keep", F.lit(False)).alias("keep"), "x.d.type")


def scores(rows: DataFrame, notes: DataFrame, resources: dict, rerank: Callable, k: int = 20) -> DataFrame:
    """note_id, seq, code, score of the pool of each diagnosis and drug that has no candidate yet."""
    open_ = cut(rows.where(F.col("type").isin(DIAGNOSIS, DRUG) & (F.size("candidates") == 0)))
    named = F.coalesce(F.nullif("normalized", F.lit("")), F.nullif("canonical_name", F.lit("")), "text")
    asked = lambda kind: open_.where(F.col("type") == kind).select(named.alias("query")).distinct()
    catalog = resources["icd_catalog"]
    docs = catalog.select(F.col("row").alias("doc"), F.concat_ws(" ", "title", "category").alias("text"))
    icd = retrieval.bm25(docs, asked(DIAGNOSIS).withColumn("text", F.col("query")), k).join(catalog.select(F.col("row").alias("doc"), "code", "title"), "doc")
    drugs = linking.rx_search(asked(DRUG), resources["rx_catalog"], method="exact")
    pool = linking.candidate_pool(open_, icd, drugs, k)
    kind = rows.schema["note_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            got = rerank(list(zip(b.column("query").to_pylist(), b.column("candidate").to_pylist()))) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("note_id", "seq", "code")), pa.array([float(x) for x in got], pa.float64())], ["note_id", "seq", "code", "score"])

    seq = rows.schema["seq"].dataType.simpleString()
    return models.rerank_pairs(open_, pool, notes).select("note_id", "seq", "code", "query", "candidate").mapInArrow(run, f"note_id {kind}, seq {seq}, code string, score double")


def hybrid(notes: DataFrame, resources: dict, model: Models, path: str, config: pipelines.Config = pipelines.Config(), anchors: DataFrame | None = None, shown: str = "anchor_all_rules") -> DataFrame:
    """``pipelines.hybrid`` of notes, with models that are asked as it comes to them; path is where their replies are kept."""
    store = Replies(notes.sparkSession, path)
    secs = pipelines.sections(notes, resources)
    raw = cut(extract.rule_entities(notes, secs, resources))
    base = pipelines.sourced(anchors, raw, "baseline_anchor", -1_000_000)
    pieces = spans.with_own_text(windows.char_chunks(notes), notes)
    found = {source: cut(spans.with_own_text(models.spans_of(pieces, call, source), notes)) for source, call in model.tokens.items()}
    if model.extract is not None:
        exact = raw.where(~F.coalesce("needs_support", F.lit(False)))
        others = [pipelines.sourced(rows, raw, source, 0) for source, rows in found.items()]
        found["self_host_llm"] = cut(extracted(notes, secs, pipelines.proposals(shown, base, exact, raw, *others), model, store))
    asked = {}
    if model.verify is not None:
        asked["decisions"] = lambda rows: decisions(rows, notes, model, store)
    if model.normalise is not None:
        none = notes.sparkSession.createDataFrame([], "key string, normalized string")
        asked["normalized"] = lambda rows: models.normal_forms(rows, none, model.systems["normalise"], None, ask=lambda requests: store.ask(_named(requests, model), model.normalise))[0]
    if model.rerank is not None:
        asked["rerank_scores"] = lambda rows: scores(rows, notes, resources, model.rerank)
    return pipelines.hybrid(notes, resources | asked, config, anchors, secs=secs, raw=raw, **found)


def _named(requests: DataFrame, model: Models) -> DataFrame:
    return requests.withColumn("key", models.request_key(model.name, "system", "user"))
