"""Toxicity by a weighted finite-state pattern grammar.

Words become class symbols through a lexical transducer (a trie of stems and whole
words). A clause's symbols first run through the transducers of threats, one from the back
and one from the front: a threat is aimed if its target stands on either side of it ("kill
you", "dich töten"), and of verbs that mean less only with an intent before ("will hurt you").
Then they run from the front through the composition of three transducers - reported speech,
negation, target of insults ("you fool") - which turn each insult or threat into an outcome
that says in which of these contexts it stands. Only clauses that hold an insult or a threat
are matched, and a text's score is the logistic of the weights of its matched clauses: no
word has a weight outside of its context.

Insults, and how much a plain one weighs, are learned from labelled rows. So is what a
context does to it, around the ratios of ``CONTEXT`` and within bounds: what is negated or
reported never weighs as much as what is plain, and that no more than what has a target.
Seed words that no label confirms are insults only with a target, or several times: one of
them alone doesn't reach the threshold. Nor do threats that are not aimed, however many there
are: of their kinds the one that weighs most counts, once. An aimed one reaches it. Threats,
targets and contexts are lists, as labels are too few to tell them apart.

Defined results: a null, empty or wordless text has no clauses and so the score of the
bias; without any labelled rows the seed grammar is used as it stands; labels other than
0 and 1, and null ids, are not learned from; repeated rows give repeated results; an
empty table gives an empty result; further columns are ignored (``reject`` keeps them).
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartula.llm.common import checkpoint, fresh, small_batches

#: Labelled rows that the grammar is fitted on, the first by a hash of the id: the bound of the sample.
SAMPLE = 6000
#: From this score a text is toxic.
THRESHOLD = 0.7
#: Stems are this many letters at least; texts (near copies counted once) with one, and the most share of clean ones.
STEM, SUPPORT, IMPURE = 4, 6, 0.03
#: Toxic texts that confirm a seed word, at least four for each clean one.
CONFIRMED = 2
#: Fewer texts do if none is clean and each has the stem so many times.
FEW, TIMES = 3, 3

#: Seed words of each class. Targets count after a threat, and before it if an intent stands before them; OBJECT forms on either side,
#: and THIRD persons, for the STRONG verbs, with an intent.
INSULT = "idiot moron stupid scum loser pathetic worthless trash clown disgusting".split()
STRONG = "kill murder strangle töten umbringen tuer matar".split()
THREAT = "hurt destroy burn beat frapper golpear".split()
TARGET = "you your youre yours they du sie ihr tu vous usted ustedes tú ellos".split()
OBJECT = "dich dir euch te toi".split()
THIRD = "him them ihn ihnen".split()
INTENT = "will going gonna must shall should want werde werden wird muss vais va allons voy vamos quiero".split()
NEGATION = "not no never nobody isnt arent wasnt dont nicht kein keine niemals pas jamais aucun nunca jamás tampoco".split()
REPORTED = "said says told quoted quote wrote claimed alleged called sagte schrieb behauptete dit disait écrit dijo escribió".split()

#: Class symbols: learned insult, seed insult, threat, strong threat, target, object, third person, intent, negation, reported speech, other word, end of clause; aimed threat.
I, J, T, K, Y, D, P, W, N, R, O, END, AT = "IJTKYDPWNRO.t"  # noqa: E741
#: Words after a negation that it reaches; words between a target and what is said of it; words that an intent reaches.
REACH, NEAR, MEANT = 3, 4, 6
#: What contexts make of a plain learned insult's weight; of seeds and threats, of the weight that reaches the threshold by one occurrence.
CONTEXT = {
    "I": 1.0, "Iy": 1.15, "In": 0.3, "Iny": 0.35, "Ir": 0.35, "Iry": 0.4, "Irn": 0.15, "Irny": 0.2,
    "J": 0.75, "Jy": 1.1, "Jn": 0.2, "Jny": 0.25, "Jr": 0.25, "Jry": 0.3, "Jrn": 0.1, "Jrny": 0.15,
    "T": 0.35, "Ty": 1.2, "Tn": 0.15, "Tny": 0.25, "Tr": 0.2, "Try": 0.45, "Trn": 0.1, "Trny": 0.15,
}
#: How far learned weights of contexts may be from these ratios.
LEAN = 0.3

_TOKENS = re.compile(r"[^\W\d_]+|[.;!?:\n]")
_MATCHED = re.compile(r"[^.]*[IJTK][^.]*")
_HELD = re.compile("[IJTK]")
#: What is left of a clause for the other transducers once threats are aimed.
_REST = str.maketrans({D: Y, P: Y, W: O, K: T})


class Transducer:
    """Deterministic transducer: step(state, symbol) gives (state, output symbol); 0 is the start."""

    def __init__(self, step):
        self.step = step

    def __matmul__(self, after: Transducer) -> Transducer:
        """This one, then after on its output."""

        def step(state, symbol):
            a, b = state or (0, 0)
            a, out = self.step(a, symbol)
            b, out = after.step(b, out)
            return (a, b), out

        return Transducer(step)

    def run(self, symbols):
        state = 0
        for symbol in symbols:
            state, out = self.step(state, symbol)
            yield out


def _marked(cue: str, mark: str, reach: int, of: str) -> Transducer:
    """Adds mark to symbols of those kinds that follow a cue by reach symbols at most (0: to the clause's end)."""

    def step(left, symbol):
        if symbol[0] == cue:
            return reach or -1, symbol
        out = symbol + mark if left and symbol[0] in of else symbol
        return (left - 1 if left > 0 else left), out

    return Transducer(step)


def _followed() -> Transducer:
    """Reads a clause from its end: after threats that a target, or a third person, follows by NEAR symbols at most it writes which."""

    def step(state, symbol):
        target, third = state or (0, 0)
        out = symbol + (Y if target else "") + (P if third else "") if symbol in (T, K) else symbol
        return (NEAR if symbol in (Y, D) else max(target - 1, 0), NEAR if symbol == P else max(third - 1, 0)), out

    return Transducer(step)


def _aimed() -> Transducer:
    """Reads what that wrote from its front: which threats are aimed, by what stands on either side and by an intent before."""

    def step(state, symbol):
        meant, between, third, near = state or (0, 0, 0, 0)  # words that an intent, a target or third person after it, and an object still reach
        out = symbol
        if symbol[0] in (T, K):
            target = Y in symbol or near or between
            hit = (target or (meant and (P in symbol or third))) if symbol[0] == K else (meant and target)
            out = AT if hit else symbol[0]
        left = lambda n: max(n - 1, 0)
        meant = MEANT if symbol == W else left(meant)
        return (meant, NEAR if symbol == Y and meant else left(between), NEAR if symbol == P and meant else left(third), NEAR if symbol == D else left(near)), out

    return Transducer(step)


FOLLOWED, AIMED = _followed(), _aimed()
GRAMMAR = _marked(R, "r", 0, I + J + T + AT) @ _marked(N, "n", REACH, I + J + T + AT) @ _marked(Y, "y", NEAR, I + J)
#: What a matched word can come out as.
OUTCOMES = [k + r + n + y for k in (I, J, T) for r in ("", "r") for n in ("", "n") for y in ("", "y")]


def named(symbol: str) -> str:
    return T + symbol[1:] + "y" if symbol[0] == AT else symbol


class Compiled:
    """The grammar's composition as a table, filled as states are met."""

    def __init__(self):
        self.table: dict = {}
        self.places = {o: k for k, o in enumerate(OUTCOMES)}

    def outcomes(self, clause: str, counts: list[int]) -> None:
        state, table = 0, self.table
        if T in clause or K in clause:
            clause = "".join(AIMED.run(list(FOLLOWED.run(reversed(clause)))[::-1]))
        for symbol in clause.translate(_REST):
            got = table.get((state, symbol))
            if got is None:
                after, out = GRAMMAR.step(state, symbol)
                got = table[state, symbol] = after, self.places.get(named(out))
            state = got[0]
            if got[1] is not None:
                counts[got[1]] += 1


class Lexicon(dict):
    """word -> class symbol; words met for the first time run through the trie of stems."""

    MOST = 500_000

    def __init__(self, words: list[str], stems: list[str], seeds: list[str]):
        super().__init__()
        classes = ((W, INTENT), (R, REPORTED), (N, NEGATION), (Y, TARGET), (D, OBJECT), (P, THIRD), (T, THREAT), (K, STRONG), (J, seeds), (I, words))
        self.fixed = {w: s for s, own in classes for w in own}
        self.fixed |= dict.fromkeys(".;!?:\n", END)
        self.trie: dict = {}
        for s in stems:
            at = self.trie
            for c in s:
                at = at.setdefault(c, {})
            at[""] = I

    def __missing__(self, word: str) -> str:
        symbol = self.fixed.get(word)
        if symbol is None:
            at, symbol = self.trie, O
            for c in word:
                at = at.get(c)
                if at is None:
                    break
                if "" in at:
                    symbol = I
                    break
        if len(self) >= self.MOST:
            self.clear()
        self[word] = symbol
        return symbol


class Grammar:
    """Lexicon, bias and weights of the outcomes; plain data, so it travels as such."""

    def __init__(self, words=(), stems=(), bias=-3.0, insults=None):
        """words and stems: learned insults, beside which the other seeds stand; insults: weights of the outcomes of learned ones, from the ratios if there are none."""
        self.words, self.stems, self.bias = list(words), list(stems), float(bias)
        self.seeds = [w for w in INSULT if w not in self.words and not w.startswith(tuple(self.stems) or ("\0",))]
        reaching = (np.log(THRESHOLD / (1 - THRESHOLD)) - self.bias) / np.log(2)
        own = insults or {o: 1.1 * reaching * CONTEXT[o] for o in OUTCOMES if o[0] == I}
        self.weights = [float(own[o] if o[0] == I else reaching * CONTEXT[o]) for o in OUTCOMES]
        self._lexicon = self._compiled = None

    def __getstate__(self):
        return self.__dict__ | {"_lexicon": None, "_compiled": None}

    def features(self, text: str | None) -> list[float]:
        """For each outcome its count over the text's matched clauses."""
        if self._lexicon is None:
            self._lexicon, self._compiled = Lexicon(self.words, self.stems, self.seeds), Compiled()
        counts = [0] * len(OUTCOMES)
        if text:
            symbols = "".join(map(self._lexicon.__getitem__, _TOKENS.findall(text.lower())))
            if _HELD.search(symbols):
                for m in _MATCHED.finditer(symbols):
                    self._compiled.outcomes(m[0], counts)
        return counts

    def score(self, text: str | None) -> float:
        z, idle = self.bias, 0.0
        for name, w, c in zip(OUTCOMES, self.weights, self.features(text)):
            if c and name[0] == T and name != T + "y":
                idle = max(idle, w * np.log(2))  # threats that are not aimed, however many
            elif c:
                z += w * np.log1p(c)
        z += idle
        return float(1 / (1 + np.exp(-z)))


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sampled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """text and toxic of the sample, near copies once: by the least hash of their four-word runs."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    chosen = usable.groupBy(F.col("doc_id").alias("__id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("text", "toxic")

    def keyed(batches):
        for b in batches:
            key = []
            for t in b.column(0).to_pylist():
                w = (t or "").lower().encode().split()
                grams = zip(w, w[1:], w[2:], w[3:]) if len(w) > 3 else [w]
                key.append(min((xxhash.xxh64_intdigest(b" ".join(g)) for g in grams), default=0) >> 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(key, pa.int64())], ["text", "toxic", "key"])

    return rows.mapInArrow(keyed, "text string, toxic int, key long").dropDuplicates(["key", "toxic"]).select("text", "toxic")


def _stems(batches):
    """stem, texts with it that are toxic, and clean, and times in toxic ones; a whole word is a stem that ends in a space."""
    counts: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])

    def out():
        names = list(counts)
        columns = (pa.array([counts[s][k] for s in names], pa.int64()) for k in (1, 0, 2))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *columns], ["stem", "toxic", "clean", "times"])

    for b in batches:
        for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            own: Counter = Counter()
            for w, n in Counter(_TOKENS.findall((text or "").lower())).items():
                if len(w) >= STEM:
                    for k in range(STEM, min(len(w), 10) + 1):
                        own[w[:k]] += n
                    own[w + " "] += n
            for s, n in own.items():
                of = counts[s]
                of[label] += 1
                of[2] += n * label
        if len(counts) > 1_000_000:
            yield out()
            counts.clear()
    yield out()


def _terms(rows: list[tuple[str, int]]) -> tuple[list[str], list[str]]:
    """Words and stems that tell toxic texts, from those that pass the limits and how many toxic texts have
    them: the shortest, made as long as they stay as frequent."""
    pure = dict(rows)
    words, stems = [], []
    covered = lambda s: any(s.startswith(x) for x in stems)
    for s in sorted((s for s in pure if s[-1] != " "), key=lambda s: (len(s), s)):
        if covered(s):
            continue
        longest = s
        for other, t in pure.items():
            if other.startswith(s) and other[-1] != " " and t >= 0.98 * pure[s] and len(other) > len(longest):
                longest = other
        whole = longest + " "
        if pure.get(whole, 0) >= 0.98 * pure[s]:
            words.append(longest)
        else:
            stems.append(longest)
    words += [s[:-1] for s in pure if s[-1] == " " and not covered(s) and s[:-1] not in words]
    return words, stems


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Grammar:
    """A grammar whose insults and weights are learned from the sample.

    What reaches the driver is the stems that pass the support and purity limits, and a
    vector of counts for each row of the sample.
    """
    small_batches(docs.sparkSession)
    rows = checkpoint(_sampled(docs, labels, sample))
    counted = rows.mapInArrow(_stems, "stem string, toxic long, clean long, times long").groupBy("stem").agg(*(F.sum(c).alias(c) for c in ("toxic", "clean", "times")))
    often = (F.col("toxic") >= SUPPORT) & (F.col("clean") <= IMPURE * (F.col("toxic") + F.col("clean")))
    seeds = F.col("stem").isin(*[f"{w} " for w in INSULT]) & (F.col("toxic") >= CONFIRMED) & (F.col("clean") <= F.col("toxic") / 4)
    few = (F.col("toxic") >= FEW) & (F.col("clean") == 0) & (F.col("times") >= TIMES * F.col("toxic"))
    words, stems = _terms([(r["stem"], r["toxic"]) for r in counted.where(often | few | seeds).select("stem", "toxic").collect()])
    grammar = Grammar(sorted(set(words)), stems)
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def vectors(batches):
        for b in batches:
            got = [shared.value.features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(got, pa.list_(pa.int32()))], ["toxic", "x"])

    data = rows.mapInArrow(vectors, "toxic int, x array<int>").collect()
    if not data or len({r["toxic"] for r in data}) < 2:
        return grammar
    y = np.array([r["toxic"] for r in data], float)
    x = np.log1p(np.array([r["x"] for r in data], float)[:, : len(OUTCOMES) // 3])  # the outcomes of learned insults come first
    bias, weights = _logistic(x, y)
    return Grammar(grammar.words, grammar.stems, bias, weights)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, steps: int = 50) -> tuple[float, dict[str, float]]:
    """Bias and weights of the insults' outcomes: ridge logistic regression by Newton's method, pulled to multiples of CONTEXT.

    Rare outcomes stay at their ratio; none leaves it by more than LEAN, nor the order plain, targeted and negated or reported.
    """
    names = OUTCOMES[: x.shape[1]]
    ratio = np.array([CONTEXT[o] for o in names])
    z = np.hstack([np.ones((len(x), 1)), (x @ ratio)[:, None], x])
    pull = np.diag([1e-3, ridge / 10] + [ridge * 10] * len(names))
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * np.maximum(p * (1 - p), 1e-9)) @ z + pull, z.T @ (y - p) - pull @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    plain = max(0.0, float(w[1] + w[2 + names.index(I)]))
    free = w[1] * ratio + w[2:]
    bounds = {o: (plain * c * (1 - LEAN), plain * c * (1 + LEAN)) for o, c in zip(names, ratio)}
    own = {o: float(np.clip(v, *bounds[o])) for o, v in zip(names, free)} | {I: plain}
    own["Iy"] = max(own["Iy"], plain)
    return float(w[0]), own


def scored(docs: DataFrame, grammar: Grammar, name: str = "score") -> DataFrame:
    """docs with a column of that name, which docs don't have: a double from 0 to 1."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches):
        for b in batches:
            got = pa.array([shared.value.score(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], got], schema=b.schema)

    out = docs.withColumn(name, F.lit(None).cast("double"))
    return out.mapInArrow(run, out.schema)


def report(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs."""
    rows = scored(docs.select("doc_id", "text"), fit(docs, labels, sample))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs without those whose score reaches the threshold."""
    (score,) = fresh(docs, "score")
    return scored(docs, fit(docs, labels, sample), score).where(F.col(score) < THRESHOLD).select(*docs.columns)
