"""Chat formatting of reply trees.

Messages form trees by their parents. Self-joins that double their reach each time give
every message its root and the sum of the scores on its way there; leaves are ranked by
that sum, and the path of the chosen leaf is enumerated by the same joins, from the
farthest reach to the nearest. Each message of a path is formatted as one piece of a
conversation; the pieces in order are the conversation.

A piece is ``<|role|>`` + text + ``<|end|>`` + newline. In roles and texts a backslash is
doubled, and one is put after the first character of any control string, ours or one of
another template, so none stands in a text as such; taking them away again gives the text.
The loss mask covers the escaped text of assistant pieces.

Defined results: a null text or role is empty; a null conversation id is a conversation
of its own; messages that repeat are separate messages that follow one another, as do
messages of one turn, by role and text; a message whose parent is missing is a root; what
hangs on a cycle has no root and is left out; an empty table gives an empty result; a
column that is not named here is ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartula.llm.common import checkpoint, parts, ranked, small_batches

#: Control strings: this template's, then some of others.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ASSISTANT = "assistant"

_BREAK = re.compile("|".join([r"\\", *(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL)]))
_PIECE = re.compile(r"<\|(.*?)\|>(.*)<\|end\|>\n", re.S)


def escape(text: str) -> str:
    return _BREAK.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def piece(role: str | None, text: str | None) -> tuple[str, int, int]:
    """A formatted message and the stretch of it under the loss mask (empty if none)."""
    head, body = f"<|{escape(role or '')}|>", escape(text or "")
    start = len(head)
    return f"{head}{body}<|end|>\n", start, start + len(body) * (role == ASSISTANT)


def parsed(formatted: str) -> tuple[str, str]:
    """Role and text of a piece."""
    m = _PIECE.fullmatch(formatted)
    return unescape(m[1]), unescape(m[2])


def chosen_paths(nodes: DataFrame, top: int = 1) -> DataFrame:
    """path (its leaf), node and depth (0 is the root) of the best paths of each tree.

    nodes: node (unique), parent, score. Messages on one path: the depth doubles with each
    join, so a thread of a million messages takes twenty.
    """
    known = nodes.select(F.col("node").alias("__known"))
    start = nodes.join(known, nodes["parent"] == known["__known"], "left").select(
        "node", F.col("__known").alias("up"), F.col("score").cast("double").alias("total"), F.when(F.col("__known").isNull(), F.col("node")).alias("root"), F.lit(0).cast("long").alias("depth")
    )
    level = checkpoint(start.withColumn("depth", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long")))
    count = level.count()
    done, active = level.where("up is null"), level.where("up is not null")
    jumps = [active]
    # Messages that have reached their root are through; only the others are joined again.
    while (1 << (len(jumps) - 1)) <= count and not active.isEmpty():
        above = done.unionByName(active).select(F.col("node").alias("__up"), F.col("up").alias("__next"), F.col("total").alias("__total"), F.col("root").alias("__root"), F.col("depth").alias("__depth"))
        level = checkpoint(
            active.join(above, active["up"] == above["__up"]).select(
                "node",
                F.col("__next").alias("up"),
                (F.col("total") + F.col("__total")).alias("total"),
                F.col("__root").alias("root"),
                (F.col("depth") + F.col("__depth")).alias("depth"),
            )
        )
        done, active = done.unionByName(level.where("up is null")), level.where("up is not null")
        jumps.append(active)
    parents = jumps[0].select(F.col("up").alias("node"))
    leaves = done.join(parents, "node", "left_anti")
    best = Window.partitionBy("root").orderBy(F.desc("total"), "node")
    paths = leaves.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top).select(F.col("node").alias("path"), "node", "depth")
    paths = checkpoint(paths)
    for k in reversed(range(len(jumps) - 1)):
        jump = jumps[k].select(F.col("node").alias("__node"), "up")
        higher = paths.join(jump, paths["node"] == jump["__node"]).select("path", F.col("up").alias("node"), (F.col("depth") - (1 << k)).alias("depth"))
        paths = checkpoint(paths.unionByName(higher))
    return paths


def threads(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as reply trees: each message replies to the one before it.

    node, parent, conv_id, role, text, score (1 for each message).
    """
    rows = ranked(conversations.select("conv_id", "turn", "role", "text"), ["conv_id", "turn", "role", "text"])
    rows = rows.select(F.col("__rank").alias("node"), "conv_id", "role", "text")
    before = rows.select((F.col("node") + 1).alias("__after"), F.col("node").alias("parent"), F.col("conv_id").alias("__conv"))
    linked = rows.join(before, (rows["node"] == before["__after"]) & rows["conv_id"].eqNullSafe(before["__conv"]), "left")
    return linked.select("node", "parent", "conv_id", "role", "text", F.lit(1.0).alias("score"))


def formatted(nodes: DataFrame, top: int = 1) -> DataFrame:
    """conv_id, path, depth, piece, loss_from, loss_to of each message of the chosen paths.

    Pieces are made where their messages are; a conversation is its pieces by depth.
    """
    small_batches(nodes.sparkSession)
    nodes = checkpoint(nodes)
    rows = nodes.join(chosen_paths(nodes, top), "node").select("conv_id", "path", "depth", "role", "text")

    def run(batches):
        for b in batches:
            made = [piece(r, t) for r, t in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
            texts, lo, hi = zip(*made) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(texts, pa.string()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["conv_id", "path", "depth", "piece", "loss_from", "loss_to"])

    return checkpoint(rows.mapInArrow(run, "conv_id long, path long, depth long, piece string, loss_from long, loss_to long"))


def read_back(pieces: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each formatted conversation.

    Pieces stream by in order; what is held is one conversation's running hashes, not its text.
    """
    small_batches(pieces.sparkSession)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        at, state = object(), None
        done: list[tuple] = []

        def out():
            columns = list(zip(*done)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
            done.clear()
            return made

        def close():
            if state:
                done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        for b in batches:
            for conv, path, text, lo, hi in zip(*(b.column(n).to_pylist() for n in ("conv_id", "path", "piece", "loss_from", "loss_to"))):
                if path != at:
                    close()
                    at, state = path, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, said = parsed(text)
                lost = unescape(text[lo:hi])
                state[1] += 1
                state[2].update(f"{role}\n{said}\n".encode())
                state[3] += len(lost)
                state[4].update(lost.encode())
                state[5] += len(text)
            yield out()
        close()
        yield out()

    spread = pieces.repartition(parts(pieces.sparkSession), "path").sortWithinPartitions("path", "depth")
    return spread.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A conversation that says what other templates use as control strings.
TRICKY = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def digest(conversations: DataFrame) -> DataFrame:
    own = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    extra = conversations.sparkSession.createDataFrame(TRICKY, "conv_id long, turn long, role string, text string")
    return read_back(formatted(threads(own.unionByName(extra))))


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *,
  length(text) + len(regexp_extract_all(text, '\\|<s>|</s>|\[INST\]|\[/INST\]|<\||\|>')) + len(regexp_extract_all(text, '<<SYS>>|<</SYS>>')) AS n FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, r, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n + length(role) + length('<||>') + length('<|end|>') + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
