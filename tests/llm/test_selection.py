"""Resampling, vector codes and languages against brute force, with nulls, empty and very long texts, ties and repeats."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cartula.llm import codes, common, langid, resample

DOCS = "doc_id long, text string, lang string, source string, weight long, score string, rank int"


def texts(n=80, seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["Ka", "lo", "mi", "té", "ru9", "ß"]) for _ in range(rng.randint(1, 3)))
    out = [" ".join(word() for _ in range(rng.choice([3, 19, 20, 45]))) + rng.choice(["", "!", "\n"]) for _ in range(n)]
    long = " ".join(word() for _ in range(70_000))
    return out + [None, "", " .,\n", "x" * 200 + " " + "y" * 64 + " " + "z" * 65 + " b" * 20, long]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, "x", 1) for i, t in rows], DOCS)


# 11 --------------------------------------------------------------------------------------------


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_features(text):
    w = words(text)
    return [zlib.crc32(f.encode()) % 10000 for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]


@pytest.mark.parametrize("step", [1, 7, 1 << 18])
def test_features_are_checksums(step, monkeypatch):
    monkeypatch.setattr(resample, "STEP", step)
    own = texts(30 if step < 9 else 80)[: 34 if step < 9 else None]
    got = [[] for _ in own]
    for text, bucket, n in resample.features(pa.array(own)):
        assert 0 <= n <= len(text)
        for i, b in zip(text.tolist(), bucket.tolist()):
            got[i].append(b)
    assert [sorted(x) for x in got] == [sorted(plain_features(t)) for t in own]


def plain_draw(rows, target, share=25):
    s, t = [0] * 10000, [0] * 10000
    for counts, of in ((s, [x for _, x in rows]), (t, target)):
        for text in of:
            for b in plain_features(text):
                counts[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t)]
    out = []
    for i, text in rows:
        f = plain_features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    able = sorted((x for x in out if x[5] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[2], x[1]))
    for k, x in enumerate(able[: share * len(able) // 100]):
        x[4] = k + 1
    return sorted((tuple(x[:5]) for x in out), key=repr)


def test_resampling(spark):
    rows = [*enumerate(texts()), (3, texts()[3]), (3, texts()[3]), (None, texts()[5] * 9), (None, None)]
    docs, target = frame(spark, rows).repartition(5), frame(spark, enumerate([*texts(9, 5), None, ""]))
    got = resample.digest(docs, target)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = plain_draw(rows, [*texts(9, 5), None, ""])
    assert sorted(map(tuple, got.collect()), key=repr) == want
    kept = resample.drawn(docs, target)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == sorted((x[0] is None, x[0] or 0) for x in want if x[4])
    for source, of in ((rows[:30], []), ([], texts(3)), (rows[:3], texts(3))):
        own, near = frame(spark, source), frame(spark, enumerate(of))
        assert sorted(map(tuple, resample.digest(own, near).collect()), key=repr) == plain_draw(source, of)
        assert resample.drawn(own, near).columns == docs.columns


def test_merged_tree(spark):
    rows = spark.createDataFrame([(np.arange(5, dtype="<i8").tobytes(),)] * 300, "v binary")
    assert common.merged(rows.repartition(130)).tolist() == [0, 300, 600, 900, 1200]
    assert common.merged(rows.where("v is null").repartition(2)) is None


# 12 --------------------------------------------------------------------------------------------


def plain_codes(rows):
    """vec_id, code, error, label_error, checksum by comparing every part with every entry."""
    kept = [(i, lab, np.array([min(max(math.floor(256 * float(x)), -codes.LARGEST), codes.LARGEST) for x in v])) for i, v, lab in rows if v and len(v) % 16 == 0 and all(x is not None and math.isfinite(x) for x in v)]
    out, errors = [], {}
    for size in sorted({len(x) for *_, x in kept}):
        own = [r for r in kept if len(r[2]) == size]
        first = sorted(own, key=lambda r: (r[0] is None, r[0] or 0, list(r[2])))[:64]
        part = lambda x: x.reshape(16, -1)
        books = [[part(r[2])[p].tolist() for r in first] for p in range(16)]
        near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
        for _ in range(2):
            for p in range(16):
                of = [(near(part(r[2])[p].tolist(), books[p])[1], part(r[2])[p].tolist()) for r in own]
                for k in {k for k, _ in of}:
                    mine = [x for j, x in of if j == k]
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
        digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
        for i, lab, x in own:
            got = [near(part(x)[p].tolist(), books[p]) for p in range(16)]
            error = sum(d for d, _ in got)
            errors[lab] = errors.get(lab, 0) + error
            out.append((i, "".join(f"{k:02x}" for _, k in got), error, lab, digest))
    return sorted(((i, c, e, errors[lab], d) for i, c, e, lab, d in out), key=repr)


VECTORS = "vec_id long, embedding array<float>, label int, code string, x int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, "c", 1) for i, v, lab in rows], VECTORS)


@pytest.mark.parametrize("width", [1, 2, 5])
def test_annulus_finds_the_nearest(width):
    rng = np.random.default_rng(width)
    entries = rng.integers(-30, 30, (16, 64, width))
    entries[:, 50:] = entries[:, :14]  # ties
    books = codes.Codebooks(entries)
    x = rng.integers(-60, 60, (700, 16 * width))
    got, errors = books.nearest(x)
    far = ((x.reshape(700, 16, 1, width) - entries[None]) ** 2).sum(3)
    assert (got == far.argmin(2)).all() and (errors == far.min(2)).all()
    assert width > 1 or books.compared < 0.4 * far.size


def test_vector_codes(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.2, 32)], int(i % 3) if i % 7 else None) for i in rng.permutation(150)]
    rows += [rows[0], rows[0], (None, rows[5][1], 1), (7, rows[9][1], 2), (200, None, 1), (201, [], 1), (202, [0.5] * 9, 1), (203, [1.0] * 31 + [None], 1), (204, [float("nan")] + [1.0] * 31, 1)]
    rows += [(205, [float("inf")] + [0.0] * 31, 0), (206, [3e38] * 32, 0), (207, [0.0] * 32, 9), (300, [0.25] * 16, 9), (301, [-0.7] * 16, None)]
    got = codes.digest(vectors(spark, rows).repartition(6))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_codes([(i, v, lab) for i, v, lab in rows])
    assert codes.digest(vectors(spark, [])).count() == 0 and codes.digest(vectors(spark, [(1, None, 2)])).count() == 0


def test_codes_decode(spark, monkeypatch):
    rng = np.random.default_rng(6)
    data = [(i, [float(x) for x in rng.normal(0, 0.2, 16)], 1) for i in range(200)]
    rows = codes.usable(vectors(spark, data))
    books = codes.fit(rows)
    coded = codes.encode(rows, books)
    for r in codes.decode(coded, books).collect():
        x, back = np.floor(256 * np.array(np.float32(data[r["vec_id"]][1]), float)), np.array(r["vec"]) * 256
        assert ((x - back) ** 2).sum() == r["error"]
    broadcast = sorted(map(tuple, codes.digest(vectors(spark, data)).collect()))
    monkeypatch.setattr(codes, "LABELS", 0)  # labels too many to be sent out
    assert sorted(map(tuple, codes.digest(vectors(spark, data)).collect())) == broadcast


# 13 --------------------------------------------------------------------------------------------

SYLLABLES = {"aa": "the ing er on".split(), "bb": "der ung sch ei".split(), "cc": "qué ñi ció lla".split()}


def plain_runs(text):
    """Buckets of runs of one to three letters, a character at a time."""
    own = [0]
    for c in (text or "").lower():
        if c.isalpha():
            own.append(ord(c))
        elif own[-1]:
            own.append(0)
    own += [0] if own[-1] else []
    out = set()
    for i in range(len(own)):
        code = 0
        for n in range(3):
            if i + n < len(own):
                code = (code + own[i + n] + n + 1) * 0x9E3779B1 % (1 << 32)
                code ^= code >> 15
                out.add(code % langid.BUCKETS)
    return out if len(own) > 1 else set()


def language_rows(n=240):
    rng = random.Random(8)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        out.append((i, " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(2, 40))), lang))
    return out


def labelled(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None, "x", 1) for i, t, lang in rows], DOCS)


def test_runs(monkeypatch):
    own = ["", None, "12 .", "Ab", "a  b\n\nÇ3d", "ÀÉ" * 5, "  lead", "trail!!", "𝔞 𐐀"]
    for step in (3, 1 << 20):
        monkeypatch.setattr(langid, "STEP", step)
        assert [set(langid.runs(t).tolist()) for t in own] == [plain_runs(t) for t in own]


def test_languages(spark, monkeypatch):
    rows = language_rows()
    more = [(900, None, "aa"), (901, "", "bb"), (902, "12 !?", "aa"), (903, "der ung", None), (None, "the the", "aa"), rows[0], rows[0], (904, "schei " * 60_000, "bb")]
    docs = labelled(spark, rows + more).repartition(5)
    got = langid.report(docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = got.collect()
    assert len(got) == len(rows + more)
    of = {r["doc_id"]: r for r in got}
    assert all(of[i]["lang_pred"] == "und" and of[i]["score"] == 0.0 for i in (900, 901, 902))
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    held = [(of[i]["lang_pred"], lang) for i, _, lang in rows if of[i]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.98 * len(held) and of[904]["lang_pred"] == of[903]["lang_pred"] == "bb"
    kept = langid.of_languages(docs, ["bb"], 0.5)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in of.items() if r["lang_pred"] == "bb" and r["score"] >= 0.5}
    # the labels of held-out rows are no input
    other = labelled(spark, [(i, t, "zz" if of[i]["held_out"] else lang) for i, t, lang in rows])
    again = {r["doc_id"]: r["lang_pred"] for r in langid.report(other).collect()}
    assert set(again.values()) <= {"aa", "bb", "cc"}


def test_languages_against_plain_regression(spark):
    rows = language_rows(120)
    docs = labelled(spark, rows)
    model = langid.fit(docs)
    learned = [(plain_runs(t), lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    marks = [set(x.tolist()) for x in model.landmarks]
    assert all(any(m == t for t, _ in learned) for m in marks)
    kernel = lambda a, b: np.array([[len(x & y) / math.sqrt(len(x) * len(y)) for y in b] for x in a])
    k, among = kernel([t for t, _ in learned], marks), kernel(marks, marks)
    y = np.array([[float(lang == name) for name in model.names] for _, lang in learned])
    solved = np.linalg.solve(k.T @ k + len(k) * (langid.RIDGE * among + 1e-6 * np.eye(len(marks))), k.T @ y)
    values = kernel([plain_runs(t) for _, t, _ in rows], marks) @ solved
    got = {r["doc_id"]: r for r in langid.report(docs).collect()}
    for (i, *_), v in zip(rows, values):
        assert got[i]["lang_pred"] == model.names[int(v.argmax())]
        assert abs(got[i]["score"] - 1 / np.exp(langid.SHARP * (v - v.max())).sum()) < 1e-3


def test_languages_unlearned(spark, monkeypatch):
    empty = labelled(spark, [])
    assert langid.report(empty).count() == 0
    assert {(r["lang_pred"], r["score"]) for r in langid.report(labelled(spark, [(1, "the", None), (2, None, "aa")])).collect()} == {("und", 0.0)}
    only = langid.report(labelled(spark, [(0, "the ing", "aa"), (2, "", "aa"), (3, "the", None)])).collect()
    assert {(r["doc_id"], r["lang_pred"]) for r in only} == {(0, "aa"), (2, "und"), (3, "aa")}
    monkeypatch.setattr(langid, "LANGUAGES", 2)  # languages beyond the bound are not learned
    assert len(langid.fit(labelled(spark, language_rows(90))).names) == 2
