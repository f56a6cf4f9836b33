"""Language identification by a string kernel.

Two texts are as alike as the runs of one to ``LENGTHS`` letters that both have (a blended
spectrum; a run counts once however often it occurs, and runs are hashed into ``BUCKETS``):
the number of shared runs over the root of the product of their own numbers. Of a bounded
sample of labelled rows some texts of each language become landmarks; a text is described
by its kernel with the landmarks (Nyström), and for each language a kernel ridge regression
tells it from the rest. Its normal equations are sums over the sample, which each partition
adds up for itself and a tree of tasks merges; what reaches the driver is landmarks (as
numbers of runs) and matrices of their number squared, whatever the input.

Texts are scored where they are, in batches of a few: a matrix of which of the landmarks'
runs occur in which text, times the landmarks' matrix, gives the kernels, and those times the
regressions' coefficients give a value for each language. The largest wins.

Defined results: ``und`` with score 0 for a null text, one without a letter, and all texts if
no language can be learned; rows with a null id, a null language or a text without a letter
are not learned from, those of repeated id, text and language once; ties go to the
language first in the order of code points; letters are compared without case, everything
between letters is one gap; whole texts count, however long; an empty table gives an empty
result; further columns are ignored (``predicted`` keeps them).
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartula.llm.common import checkpoint, fresh, merged, small_batches
from cartula.llm.toxicity import held_out

#: Bounds of what is learned from: languages (those with most rows), rows and landmarks of each, landmarks of all.
LANGUAGES, SAMPLE, OWN_LANDMARKS, LANDMARKS = 200, 1000, 48, 256
#: Longest runs; buckets that they are hashed into; weight of the ridge for each row; how sharp scores are; texts of a product.
LENGTHS, BUCKETS, RIDGE, SHARP, ROWS = 3, 1 << 15, 1e-3, 6.0, 64
#: Letters hashed at once.
STEP = 1 << 20

_LETTER: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """Which code points are letters; made once in each worker."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTER[0]


def letters(text: str | None) -> np.ndarray:
    """Code points of the lower-cased letters, with one zero for each gap, also before and after; empty without letters."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _is_letter()[points]
    if not inside.any():
        return np.empty(0, np.uint32)
    padded = np.zeros(len(points) + 2, np.uint32)
    padded[1:-1] = np.where(inside, points, 0)
    keep = padded != 0
    keep[1:] |= padded[:-1] != 0
    keep[0] = padded[1] != 0
    out = padded[keep]
    return out if out[0] == 0 else np.concatenate([np.zeros(1, np.uint32), out])


def runs(text: str | None) -> np.ndarray:
    """The buckets of all runs of the text, each once, ascending."""
    own, seen = letters(text), np.zeros(BUCKETS, bool)
    for at in range(0, len(own), STEP):
        piece = own[at : at + STEP + LENGTHS - 1]
        code = np.zeros(len(piece), np.uint32)
        for n in range(LENGTHS):
            code = (code[: len(piece) - n] + piece[n:] + np.uint32(n + 1)) * np.uint32(0x9E3779B1)
            code ^= code >> np.uint32(15)
            seen[code & np.uint32(BUCKETS - 1)] = True
    return np.flatnonzero(seen)


class Kernel:
    """Landmarks, each the ascending buckets of its runs, and with coefficients a classifier."""

    def __init__(self, landmarks: list[np.ndarray], names: list[str] = (), coefficients: np.ndarray | None = None):
        self.landmarks, self.names, self.coefficients = landmarks, list(names), coefficients
        self._matrix = None

    def __getstate__(self):
        return self.__dict__ | {"_matrix": None}

    def kernels(self, texts: list[np.ndarray]) -> np.ndarray:
        """[text, landmark] for texts given by the buckets of their runs."""
        if self._matrix is None:
            used = np.unique(np.concatenate(self.landmarks))
            self._place = np.full(BUCKETS, -1)
            self._place[used] = np.arange(len(used))
            self._matrix = np.zeros((len(used), len(self.landmarks)), np.float32)
            for j, own in enumerate(self.landmarks):
                self._matrix[self._place[own], j] = 1
            self._own = np.array([len(x) for x in self.landmarks], float)
        present = np.zeros((len(texts), len(self._matrix)), np.float32)
        for i, own in enumerate(texts):
            at = self._place[own]
            present[i, at[at >= 0]] = 1
        sizes = np.array([len(x) for x in texts], float)
        return (present @ self._matrix) / np.sqrt(np.maximum(sizes, 1)[:, None] * self._own[None, :])

    def values(self, texts: list[np.ndarray]) -> np.ndarray:
        """[text, language]: about 1 for the text's language and 0 for others."""
        return self.kernels(texts) @ self.coefficients


def predict(model: Kernel, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Names and scores."""
    names, scores = ["und"] * len(texts), np.zeros(len(texts))
    if not model.names:
        return names, scores
    for at in range(0, len(texts), ROWS):
        own = [runs(t) for t in texts[at : at + ROWS]]
        some = np.array([at + i for i, x in enumerate(own) if len(x)], int)
        if len(some):
            values = model.values([own[i - at] for i in some])
            best = values.argmax(axis=1)
            sharp = np.exp(SHARP * (values - values.max(axis=1, keepdims=True)))
            scores[some] = 1 / sharp.sum(axis=1)
            for i, k in zip(some.tolist(), best.tolist()):
                names[i] = model.names[k]
    return names, scores


def _sampled(docs: DataFrame, sample: int) -> DataFrame:
    """text, lang, rank of up to sample rows of each language, by a hash of the id; rank tells their order.

    Ids are chosen first, and of a frequent language only the first few by their hash are ranked, so that no task sees all its rows.
    """
    rows = docs.select(F.col("doc_id").alias("__id"), F.col("lang").cast("string").alias("lang"), "text").where(F.col("__id").isNotNull() & F.col("lang").isNotNull() & ~held_out("__id"))
    rows = rows.where(F.col("text").rlike(r"\p{L}"))
    keys = rows.select("__id", "lang", F.xxhash64("text").alias("__h")).distinct()
    most = keys.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).select(F.col("lang").alias("__lang"), "count")
    keys = keys.join(F.broadcast(most), F.col("lang") == F.col("__lang")).withColumn("__o", F.xxhash64("__id"))
    few = F.pmod("__o", F.lit(1 << 30)) * F.col("count") < (1 << 30) * F.lit(1.5 * sample + 100.0)  # about half more than are needed: what is ranked is bounded
    by = Window.partitionBy("lang").orderBy("__o", "__id", "__h")
    keys = keys.where(few).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= sample)
    keys = checkpoint(keys.select(*(F.col(c).alias(f"_{c}") for c in ("__id", "lang", "__h")), "rank"))
    match = (F.col("__id") == F.col("___id")) & (F.col("lang") == F.col("_lang")) & (F.xxhash64("text") == F.col("___h"))
    return rows.join(F.broadcast(keys), match).dropDuplicates(["lang", "rank"]).select("text", "lang", "rank")


def fit(docs: DataFrame, sample: int = SAMPLE) -> Kernel:
    """Learned from a sample of labelled rows that are not held out."""
    spark = docs.sparkSession
    small_batches(spark)

    def cut(batches):
        for b in batches:
            own = [runs(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x.tolist() for x in own], pa.list_(pa.int32())), b.column(1), b.column(2)], ["runs", "lang", "rank"])

    rows = checkpoint(_sampled(docs, sample).mapInArrow(cut, "runs array<int>, lang string, rank int"))
    names = sorted(r["lang"] for r in rows.select("lang").distinct().collect())  # LANGUAGES at most
    if not names:
        return Kernel([])
    own = max(1, min(OWN_LANDMARKS, LANDMARKS // len(names)))
    chosen = rows.where(F.col("rank") <= own).orderBy("rank", "lang").collect()  # LANDMARKS rows of BUCKETS numbers at most
    model = Kernel([np.array(r["runs"], np.int64) for r in chosen])
    shared, (m, n) = spark.sparkContext.broadcast((model, names)), (len(chosen), len(names))

    def equations(batches):
        """The sums of k k' and k y' over the partition's rows, and their number."""
        kernel, langs = shared.value
        place, out = {x: i for i, x in enumerate(langs)}, np.zeros((m + 1, m + n))
        for b in batches:
            texts, known = [np.array(x) for x in b.column(0).to_pylist()], b.column(1).to_pylist()
            for at in range(0, len(texts), ROWS):
                k = kernel.kernels(texts[at : at + ROWS])
                y = np.zeros((len(k), n))
                y[np.arange(len(k)), [place[x] for x in known[at : at + ROWS]]] = 1
                out[:m] += k.T @ np.hstack([k, y])
                out[m, 0] += len(k)
        yield pa.RecordBatch.from_arrays([pa.array([out.astype("<f8").tobytes()], pa.binary())], ["sums"])

    sums = merged(rows.select("runs", "lang").mapInArrow(equations, "sums binary"), "<f8").reshape(m + 1, m + n)
    among = model.kernels(model.landmarks)
    ridge = RIDGE * sums[m, 0] * among + 1e-6 * sums[m, 0] * np.eye(m)
    return Kernel(model.landmarks, names, np.linalg.solve(sums[:m, :m] + ridge, sums[:m, m:]))


def predicted(docs: DataFrame, model: Kernel, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs (text and others) with the two columns of names, which docs don't have."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches):
        for b in batches:
            found, scores = predict(shared.value, b.column(place).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(found, pa.string()), pa.array(scores)], schema=b.schema)

    out = docs.withColumns({names[0]: F.lit(None).cast("string"), names[1]: F.lit(None).cast("double")})
    return out.mapInArrow(run, out.schema)


def of_languages(docs: DataFrame, wanted: list[str], least: float = 0.0, model: Kernel | None = None) -> DataFrame:
    """Documents predicted to be in one of the wanted languages with a score of least at least, with all their columns."""
    name, score = fresh(docs, "lang_pred", "score")
    rows = predicted(docs, model or fit(docs), (name, score))
    return rows.where(F.col(name).isin(*wanted) & (F.col(score) >= least)).select(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document."""
    rows = predicted(docs.select("doc_id", "text"), fit(docs))
    return rows.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
