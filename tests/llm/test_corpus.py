"""The corpus operators against brute force, on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from cartula.llm import ann, chat, decontam, hilbert, idcoder, linedup, mixing, simhash, substring, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, fp long"


def corpus(n=60, seed=3):
    """Invented texts with copies, near copies, shared passages, nulls, empties, a very long text and repeated rows."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "te", "ru"]) for _ in range(rng.randint(1, 3)))
    passage = " ".join(word() for _ in range(30))
    out = []
    for i in range(n):
        lines = [" ".join(word() for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(1, 6))]
        text = "\n".join(lines)
        if i % 7 == 3:
            text = rng.choice(out)[1] or text
        if i % 7 == 5 and out:
            w = (rng.choice(out)[1] or text).split(" ")
            w[len(w) // 2] = "CHANGED"
            text = " ".join(w)
        if i % 9 == 4:
            text += "\t" + passage + "\n"
        out.append((i, text, "en", f"s{i % 4}" if i % 5 else None, len(text), "x", 1))
    long = " ".join(word() for _ in range(60_000))
    more = [(n, None, None, None, None, None, None), (n + 1, "", "en", "s1", 0, "", 0), (n + 2, " \n ", "en", "s1", 3, "", 0), (n + 3, long, "en", "s2", len(long), "", 0)]
    return out + more + [out[0], out[0]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(5).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# 1 ---------------------------------------------------------------------------------------------


def test_grammar_composes():
    g = toxicity.Grammar(stems=["lowei"])
    names = lambda text: {o: c for o, c in zip(toxicity.OUTCOMES, g.features(text)) if c}
    assert names("You are an idiot") == {"Jy": 1}
    assert names("not an idiot. loweis idiot") == {"Jn": 1, "I": 1, "J": 1}
    assert names("she said you idiot, loweischaft") == {"Jry": 1, "Iry": 1}
    assert names("i will kill you") == {"Ty": 1} and names("you kill time") == {"T": 1}
    assert names("") == names(None) == names("plain words") == {}
    assert 0 <= g.score("") < 0.5 < g.score("you idiot, you moron")


def plain_outcomes(text, stems=(), words=()):
    """Outcomes by looking around each word of each clause."""
    t, out = toxicity, {}
    for clause in re.split(r"[.;!?:\n]", text.lower()):
        w = re.findall(r"[^\W\d_]+", clause)
        for i, x in enumerate(w):
            kind = "T" if x in t.THREAT + t.STRONG else "I" if x in words or any(x.startswith(s) for s in stems) else "J" if x in t.INSULT else ""
            if not kind:
                continue
            ahead, behind = w[i + 1 : i + 5], range(max(0, i - 4), i)
            meant = any(v in t.INTENT for v in w[max(0, i - 6) : i])
            told = lambda j: any(w[k] in t.INTENT for k in range(max(0, j - 6), j))  # noqa: B023, E731
            if kind == "T":
                target = any(v in t.TARGET + t.OBJECT for v in ahead) or any(w[j] in t.OBJECT or (w[j] in t.TARGET and told(j)) for j in behind)
                third = any(v in t.THIRD for v in ahead) or any(w[j] in t.THIRD and told(j) for j in behind)
                y = target or (meant and third) if x in t.STRONG else meant and target
            else:
                y = any(w[j] in t.TARGET + t.OBJECT + t.THIRD for j in behind)
            marks = ("r" * any(v in t.REPORTED for v in w[:i])) + ("n" * any(v in t.NEGATION for v in w[max(0, i - 3) : i])) + "y" * bool(y)
            out[kind + marks] = out.get(kind + marks, 0) + 1
    return out


def test_grammar_against_plain_matching():
    rng, g = random.Random(11), toxicity.Grammar(words=["moron"], stems=["zquu"])
    some = ["you", "not", "said", "kill", "idiot", "burn", "zquuta", "the", "cat", "Scum", "niemals", "usted", ".", "!", "\n", ", ", "they", "x1y", "him", "dich", "will", "töten", "moron"]
    texts = [" ".join(rng.choice(some) for _ in range(rng.randint(0, 25))) for _ in range(400)] + ["you idiot " * 2000]
    for t in texts:
        assert {o: c for o, c in zip(toxicity.OUTCOMES, g.features(t)) if c} == plain_outcomes(t, ["zquu"], ["moron"])


def test_contexts_decide():
    rng = np.random.default_rng(5)
    y = (rng.random(3000) < 0.1).astype(float)
    x = np.zeros((3000, 8))
    x[:, 0], x[:, 1] = np.log1p(y * rng.integers(0, 4, 3000)), np.log1p(y * rng.integers(0, 2, 3000))
    x[:, 2] = np.log1p(rng.integers(0, 2, 3000))  # negated insults stand anywhere
    learned = toxicity.Grammar(["idiot"], [], *toxicity._logistic(x, y))
    aimed = ["i will kill you", "ich werde dich töten", "je vais vous tuer", "we must kill him", "te voy a matar", "i will hurt you", "ich werde ihn töten"]
    idle = ["kill", "kill the process. " * 8, "they destroy old files. " * 20, "i beat you at chess", "fire will burn them and destroy them", "you kill time", "you will kill time", "we never kill you", "he said i will kill you", "kill them. we never burn you. he said kill. " * 50]
    for g in (toxicity.Grammar(), learned):
        plain, told = g.score("an idiot"), g.score("you idiot")
        assert g.score("not an idiot") < plain <= told and g.score("she said he was an idiot") < plain
        assert g.score("she said he was not an idiot") < 0.7 <= told
        assert max(map(g.score, idle)) < 0.7 <= min(map(g.score, aimed))
        assert g.score("the word idiot. " * 3) > plain and g.score("nothing here") < 0.3
    assert toxicity.Grammar().score("an idiot") < 0.7 <= learned.score("an idiot")  # one word that no label confirms is no verdict


def test_toxic_copies_and_long_texts(spark):
    long = "words without harm. " * 30_000 + "you idiot, you moron. you loser"
    table = spark.createDataFrame([(1, long, None, None, None, None, None)] * 3 + [(2, long[:-31], None, None, None, None, None)], DOCS)
    got = toxicity.report(table, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert sorted((r["doc_id"], r["predicted"]) for r in got) == [(1, 1)] * 3 + [(2, 0)] and len({r["score"] for r in got}) == 2


def test_toxicity_learns(spark, empty):
    rng = random.Random(1)
    data, labels = [], []
    for i in range(400):
        toxic = int(i % 8 == 0)
        w = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40)]
        if toxic:
            w[5], w[20], w[30] = "zquut" + w[1][:2], "zquut" + w[2][:3], "zquut" + w[3][:1]
        data.append((i, " ".join(w), None, None, None, None, None))
        labels.append((i, 1, toxic))
    table, marks = spark.createDataFrame(data, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.report(table, marks).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert all(got[i]["predicted"] == t and (got[i]["score"] >= 0.7) == t for i, _, t in labels)
    assert toxicity.report(empty, marks).count() == 0
    assert toxicity.reject(table, marks).columns == table.columns
    no_labels = toxicity.report(spark.createDataFrame([(1, None, None, None, None, None, None)], DOCS), marks.limit(0)).collect()
    assert [r["predicted"] for r in no_labels] == [0]


# 2 ---------------------------------------------------------------------------------------------


def test_coder_round_trip():
    rng = np.random.default_rng(2)
    docs = [(1, np.array([2], "<u4")), (None, np.minimum(rng.geometric(0.01, 9000), 49407).astype("<u4")), (2, np.full(5000, 49407, "<u4")), (3, rng.integers(0, 49408, 3000).astype("<u4"))]
    packed = idcoder.pack(docs)
    back = idcoder.unpack(packed)
    assert [i for i, _ in back] == [1, None, 2, 3] and all(np.array_equal(a, b) for (_, a), (_, b) in zip(docs, back))
    assert len(idcoder.pack(docs[2:3])) < 1500  # what repeats costs little
    broken = bytearray(packed)
    broken[-200] ^= 1
    with pytest.raises(ValueError):
        idcoder.unpack(bytes(broken))
    assert idcoder.unpack(idcoder.pack([])) == []
    for ids in (rng.integers(0, 1 << 32, 30_000, dtype=np.uint32), np.array([4294967295, 0, 65536], "<u4"), np.repeat(rng.integers(0, 9, 5000), 3).astype("<u4")):
        assert all(np.array_equal(a, ids) for _, a in idcoder.unpack(idcoder.pack([(7, ids)])))
    damaged = bytearray(packed)
    damaged[18 + 24 * 4 + 24 * 9 + 20] ^= 255  # behind head, index and directory stands the prior
    with pytest.raises(ValueError):
        idcoder.unpack(bytes(damaged))


def test_ids_cost_few_bits():
    """Ids of running text take fewer bits than their static order-0 entropy, whose table is not even counted."""
    public = pytest.importorskip("public_tokenizers")
    table = pytest.importorskip("pyarrow.parquet").read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])
    ids = np.concatenate(idcoder.Encoder(str(public.path("word_bpe_49k.json"))).encode(table.column("text").combine_chunks()))
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    entropy = -(share * np.log2(share)).sum()
    assert 8 * len(idcoder.pack([(1, ids)])) / len(ids) < min(8.0, entropy)


def test_ids_equal_the_library(docs, empty):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = str(public.path("word_bpe_49k.json"))
    t = tokenizers.Tokenizer.from_file(path)
    odd = "Ünï   côté's 12.5% ,,\tA b \x1c z 😀it's <|endoftext|> x"
    own = idcoder.Encoder(path).encode([odd.encode(), None])
    assert own[0].tolist() == t.encode(odd, add_special_tokens=False).ids + [2] and own[1].tolist() == [2]
    want, at = [], 0
    source = sorted(corpus(), key=lambda r: r[0])
    for r in source:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [2]
        want.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert rows(idcoder.digest(docs, path), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    assert idcoder.digest(empty, path).count() == 0


def test_few_numbers_are_coded(monkeypatch):
    """What is coded step by step are phrases: far fewer than the ids, in no more bits."""
    public = pytest.importorskip("public_tokenizers")
    texts = pytest.importorskip("pyarrow.parquet").read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").combine_chunks()
    ids = np.concatenate(idcoder.Encoder(str(public.path("word_bpe_49k.json"))).encode(texts))
    coded, update = [0], idcoder.Model.update

    def counted(self, *columns):
        coded[0] += max(np.size(c) for c in columns)
        return update(self, *columns)

    monkeypatch.setattr(idcoder.Model, "update", counted)
    packed = idcoder.pack([(1, ids)])
    assert coded[0] < 0.75 * len(ids)
    assert np.array_equal(idcoder.unpack(packed)[0][1], ids)


def test_damage_is_found_anywhere():
    rng = np.random.default_rng(5)
    docs = [(None, rng.integers(0, 90, 4000)), (8, np.repeat(rng.integers(0, 1 << 32, 40), 9))]
    packed = idcoder.pack(docs)
    for k in rng.integers(0, len(packed), 300).tolist():
        broken = bytearray(packed)
        broken[k] ^= 1 << int(rng.integers(8))
        with pytest.raises(ValueError):
            idcoder.unpack(bytes(broken))


def test_odd_segments(monkeypatch):
    """Very many ids (coded in halves), several streams, phrases of phrases, one block and many."""
    rng = np.random.default_rng(6)
    many = rng.integers(0, 1 << 32, 200_000, dtype=np.uint32)
    cases = [np.r_[many, many[:50_000], np.tile(many[:7], 400)], np.tile(np.arange(11), 900), np.zeros(1, np.uint32), np.arange(1025), rng.integers(0, 3, 50_000)]
    for lanes, block in ((4096, 1024), (3, 100), (1, 7000)):
        monkeypatch.setattr(idcoder, "LANES", lanes)
        monkeypatch.setattr(idcoder, "BLOCK", block)
        for ids in cases if block > 100 else [x[:9000] for x in cases]:
            docs = [(k, x.astype("<u4")) for k, x in enumerate(np.array_split(ids, 3))]
            back = idcoder.unpack(idcoder.pack(docs))
            assert all(i == k and np.array_equal(a, b) for (i, a), (k, b) in zip(back, docs, strict=True))


def test_letters_are_told_apart(tmp_path):
    """Stretches of letters get the library's ids, known or not; a tokenizer that minds capitals keeps its own way."""
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = str(public.path("word_bpe_49k.json"))
    t, own, rng = tokenizers.Tokenizer.from_file(path), idcoder.Encoder(path), random.Random(4)
    assert own.letters is not None
    own.MOST = 300
    letters = [chr(c) for c in range(65, 0x180) if chr(c).isalpha()] + ["\u0301", "'", "1", "ﬁ", "İ", "\x01", "."]
    for _ in range(6):
        texts = [" ".join("".join(rng.choices(letters if rng.random() < 0.3 else letters[:52], k=rng.randint(1, 12))) for _ in range(40)) for _ in range(20)]
        for text, ids in zip(texts, own.encode(texts), strict=True):
            assert ids.tolist() == t.encode(text, add_special_tokens=False).ids + [2]
    minds = tokenizers.Tokenizer(tokenizers.models.WordLevel({"[UNK]": 0, "the": 1, "The": 2}, unk_token="[UNK]"))
    minds.pre_tokenizer = tokenizers.pre_tokenizers.WhitespaceSplit()
    minds.save(str(tmp_path / "t.json"))
    other = idcoder.Encoder(str(tmp_path / "t.json"))
    assert other.letters is None and other.encode(["the The x", None])[0].tolist() == [1, 2, 0, 2]


def test_several_segments(spark, docs, tmp_path, monkeypatch):
    """Files of many small segments give the same starts, and ids beyond 31 bits come back as they are."""
    public = pytest.importorskip("public_tokenizers")
    path = str(public.path("word_bpe_49k.json"))
    once = rows(idcoder.digest(docs, path), "doc_id", "start", "n_tokens", "ids_crc32")
    monkeypatch.setattr(idcoder, "SEGMENT", 50)
    assert rows(idcoder.digest(docs, path), "doc_id", "start", "n_tokens", "ids_crc32") == once
    idcoder.write(docs, str(tmp_path / "ids"), path, end=(1 << 32) - 1)
    got = idcoder.read(spark, str(tmp_path / "ids"))
    assert spark.read.parquet(str(tmp_path / "ids")).count() > 20
    assert {r["ids"][-1] for r in got.collect()} == {(1 << 32) - 1}



# 3 ---------------------------------------------------------------------------------------------


def test_curve_moves_one_step():
    cells = sorted((hilbert.curve_index([x, y, z], 3), (x, y, z)) for x in range(8) for y in range(8) for z in range(8))
    assert [k for k, _ in cells] == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for (_, p), (_, q) in zip(cells, cells[1:]))


def plain_shards(data, shards=8, bits=4):
    """(doc_id, size, crc, shard, slot) of rows (doc_id, text, lang, source, ...), by sorting lists."""
    import math

    rows = [(i, (t or "").encode(), lang, source) for i, t, lang, source, *_ in data]

    def cells(values):
        order = sorted(set(values), key=lambda v: (v is not None, v))
        before, out = 0, {}
        for v in order:
            n = values.count(v)
            out[v] = int((1 << bits) * (before + n / 2) / len(values))
            before += n
        return out

    scale = [math.floor(4 * math.log2(len(t) + 1)) for _, t, _, _ in rows]
    x, y, z = cells([r[3] for r in rows]), cells([r[2] for r in rows]), cells(scale)
    first: dict = {}
    for (_, t, lang, source), s in zip(rows, scale):
        place = hilbert.curve_index([x[source], y[lang], z[s]], bits)
        first[t] = min(first.get(t, place), place)
    signed = lambda t: (v := xxhash.xxh64_intdigest(t, seed=42)) - (v >> 63 << 64)
    low = lambda v: (v is not None, v if v is not None else 0)
    ordered = sorted(rows, key=lambda r: (first[r[1]], signed(r[1]), zlib.crc32(r[1]), len(r[1]), low(r[0]), (r[3] is not None, r[3] or ""), (r[2] is not None, r[2] or "")))
    total = sum(len(r[1]) + 1 for r in rows)
    share = total / shards
    out, slots, before, k = [], [0] * shards, 0, 0
    while k < len(ordered):
        group = [r for r in ordered[k:] if r[1] == ordered[k][1]]
        size = len(group[0][1]) + 1
        for n, r in enumerate(group):
            middle = before + (len(group) * size / 2 if len(group) * size <= share else (n + 0.5) * size)
            s = min(int(middle / share), shards - 1)
            out.append((r[0], size, zlib.crc32(r[1]), s, slots[s]))
            slots[s] += 1
        before += len(group) * size
        k += len(group)
    return out


@pytest.mark.parametrize("more", [[], [(500 + k, "one text that is most of all " * 400, "de", f"s{k % 5}", 0, "", 0) for k in range(60)]])
def test_shards(spark, docs, empty, more):
    data = corpus() + more
    table = spark.createDataFrame(data, DOCS).withColumnRenamed("fp", "__rank").withColumnRenamed("h", "shard") if more else docs
    got = rows(hilbert.shard(table, 8), "doc_id", "size", "text_crc32", "shard", "slot")
    want = plain_shards(data)
    # Rows that repeat are alike: which of them has which slot is open.
    assert sorted((r[3], r[4], r[1], r[2]) for r in got) == sorted((r[3], r[4], r[1], r[2]) for r in want)
    assert sorted(map(repr, ((r[0], r[3]) for r in got))) == sorted(map(repr, ((r[0], r[3]) for r in want)))
    sizes = [sum(r[1] for r in got if r[3] == s) for s in range(8)]
    groups: dict = {}
    for r in got:
        groups.setdefault((r[1], r[2]), []).append(r[3])
    small = {k: v for k, v in groups.items() if len(v) * k[0] <= sum(sizes) / 8}
    assert all(len(set(v)) == 1 for v in small.values())
    assert hilbert.shard(empty).count() == 0
    whole = hilbert.sharded(table, 8)
    assert set(whole.columns) == {c for c in table.columns if c != "shard"} | {"size", "text_crc32", "law", "shard", "slot"}
    assert sorted(map(repr, ((r["doc_id"], r["text"], r["shard"]) for r in whole.collect()))) == sorted(repr((i, t, s)) for (i, t, *_), s in zip(sorted(data, key=_row), [r[3] for r in sorted(zip_shards(data, want), key=lambda x: _row(x[4]))])) or more


def _row(r):
    return (r[0] is not None, r[0] or 0, r[1] or "")


def zip_shards(data, want):
    by = {}
    for r in want:
        by.setdefault((r[0], r[1], r[2]), []).append(r)
    return [(*by[d[0], len((d[1] or "").encode()) + 1, zlib.crc32((d[1] or "").encode())].pop()[:4], d) for d in data]


def test_runs_of_the_curve_prune(spark):
    """Of 64 runs a filter on a source or a language meets few; of rows in order of their ids nearly all."""
    rng = random.Random(3)
    data = [(i, f"{i} " + "x" * int(10 ** rng.uniform(1, 4)), rng.choice(["de", "en", "es", "fr"]), f"host{rng.randrange(40):02d}", None, None, None) for i in range(4000)]
    placed = {r["doc_id"]: (r["shard"], r["slot"]) for r in hilbert.shard(spark.createDataFrame(data, DOCS), 8).collect()}

    def touched(order, column):
        runs = [order[k * len(order) // 64 : (k + 1) * len(order) // 64] for k in range(64)]
        spans = [(min(r[column] for r in run), max(r[column] for r in run)) for run in runs]
        values = {r[column] for r in order}
        return sum(lo <= v <= hi for v in values for lo, hi in spans) / (64 * len(values))

    curve = sorted(data, key=lambda r: placed[r[0]])
    assert touched(data, 3) > 0.9 and touched(data, 2) > 0.9
    assert touched(curve, 3) < 0.35 and touched(curve, 2) < 0.6


# 4 ---------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    bits = [sum(xxhash.xxh64_intdigest(g.encode(), seed=42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(grams)) if grams else 0


def groups(ids, linked):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {i: root(i) for i in ids}


def test_simhash_components(docs, empty):
    prints = {i: plain_fingerprint(t) for i, t, *_ in corpus()}
    ids = sorted(prints)
    want = groups(ids, [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 4])
    got = simhash.digest(docs)
    assert rows(got, "doc_id", "fingerprint", "component_id") == sorted(((i, f"{prints[i]:016x}", want[i]) for i, *_ in corpus()), key=repr)
    assert simhash.digest(empty).count() == 0


@pytest.mark.parametrize("radius", [0, 3, 4, 7, 20])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 12, dtype=np.uint64)) for _ in range(8)), rng.integers(0, 1 << 63, 100, dtype=np.uint64)]))
    rng.shuffle(fps)
    near = {(a, b) for a in range(len(fps)) for b in range(a) if (int(fps[a]) ^ int(fps[b])).bit_count() <= radius}
    want = groups(range(len(fps)), near)
    assert groups(range(len(fps)), [(int(i), int(j)) for a, b in simhash.large_links(fps, radius) for i, j in zip(a, b)]) == want
    group = np.sort(rng.integers(0, 20, len(fps)))
    got = {(int(j), int(i)) for a, b in simhash.small_links(group, fps, radius) for i, j in zip(a, b)}
    assert got == {(a, b) for a, b in near if group[a] == group[b]}


def test_large_buckets_are_cut(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 16)
    data = [(i, f"same words {'x' * (i % 40)} here and there again and again", None, None, None, None, None) for i in range(80)]
    table = spark.createDataFrame(data, DOCS)
    prints = {i: plain_fingerprint(t) for i, t, *_ in data}
    want = groups(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4])
    assert dict(rows(simhash.near_duplicates(table), "doc_id", "component_id")) == want


def test_one_of_each_group(spark, docs):
    base = [f"w{i}" for i in range(200)]
    near = base[:100] + ["other"] + base[101:]
    far = base[:100] + [f"v{i}" for i in range(100)]
    data = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join(near)), (4, " ".join(far)), (5, None), (6, ""), (1, " ".join(base)), (None, "alone in the world of words"), (None, " ".join(base))]
    table = spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in data], DOCS)
    kept = simhash.one_of_each(table)
    assert kept.columns == table.columns
    assert {i for i, in rows(kept, "doc_id")} >= {1, 4, 5} and not {i for i, in rows(kept, "doc_id")} & {2, 3, 6}
    assert kept.where("text like 'alone%'").count() == 1


def plain_copies(data, least=0.8):
    """component_id of each id: groups by the exact similarity of the sets of five-word shingles."""
    sets = {}
    for i, t in data:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    return groups(sets, [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least])


def graded(first=0, n=300, times=4):
    """Pairs of texts at similarities from 0.7 to 0.9, in steps of 0.01."""
    out = []
    for k, same in enumerate(times * list(range(round(n * 0.823), round(n * 0.948), 2))):
        for own in "ab":
            out.append((first + len(out), " ".join(f"{'a' if j < same else own}{k}w{j}" for j in range(n))))
    return out


def test_copies_by_exact_similarity(spark):
    data = graded()
    want = plain_copies(data)
    assert 20 < sum(i != c for i, c in want.items()) < len(data) // 2 - 20
    table = spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in data], DOCS)
    assert dict(rows(simhash.copies(table), "doc_id", "component_id")) == want


def repeated(first=0, n=300, times=10):
    """Pairs of a text and the same with a passage of it repeated 50 more times: nearly the same set of shingles."""
    out = []
    for k in range(times):
        w = [f"r{k}w{j}" for j in range(n)]
        out += [(first + 2 * k, " ".join(w)), (first + 2 * k + 1, " ".join(w + 50 * w[100:140]))]
    return out


def test_copies_that_repeat_a_passage(spark):
    data = repeated()
    want = plain_copies(data)
    assert want == {i: i - i % 2 for i, _ in data}
    table = spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in data], DOCS)
    assert dict(rows(simhash.copies(table), "doc_id", "component_id")) == want


@pytest.mark.parametrize("cut", ["BUCKET", "PROVED"])
def test_large_groups_are_proved_in_pieces(spark, monkeypatch, cut):
    monkeypatch.setattr(simhash, cut, {"BUCKET": 8, "PROVED": 20_000}[cut])
    base = [f"w{j}" for j in range(300)]
    data = [(i, " ".join(base[: 240 + i] + [f"x{i}y{j}" for j in range(60 - i)])) for i in range(60)]
    want = plain_copies(data)
    assert 1 < len(set(want.values())) < 60
    table = spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in data], DOCS)
    assert dict(rows(simhash.copies(table), "doc_id", "component_id")) == want


# 5 ---------------------------------------------------------------------------------------------


def test_substrings(docs, empty):
    first, words = {}, {}
    for i, t, *_ in sorted(corpus(), key=lambda r: r[0]):
        words[i] = (t or "").encode().split()
        for p in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][p : p + 13]), i)
    longest = plain_longest([(i, words[i]) for i in sorted(words)])
    want = []
    for i, *_ in corpus():
        w = words[i]
        gone = {q for p in range(len(w) - 12) if first[tuple(w[p : p + 13])] < i for q in range(p, p + 13)}
        want.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest(), longest[i]))
    got = rows(substring.digest(docs), "doc_id", "n_words", "n_removed", "kept_sha256", "longest")
    assert got == sorted(want, key=repr) and sum(r[2] for r in got) > 100 and {r[4] for r in got} >= {0, 13, 26}
    assert substring.digest(empty).count() == 0


def plain_longest(docs):
    """For each id the longest window of 13, 26, 52 ... words that a smaller id has too."""
    out, n = {i: 0 for i, _ in docs}, 13
    while n <= max((len(w) for _, w in docs), default=0):
        first: dict = {}
        for i, w in docs:
            for p in range(len(w) - n + 1):
                if first.setdefault(tuple(w[p : p + n]), i) < i:
                    out[i] = n
        n *= 2
    return out


def test_levels_double_until_nothing_survives(spark):
    rng = random.Random(51)
    fresh = lambda n: [f"u{rng.random()}" for _ in range(n)]
    a, b, c = fresh(900), fresh(55), fresh(30)
    texts = [fresh(20) + a, a[:300] + fresh(9), fresh(5) + a[100:], b + fresh(3), fresh(30) + b + c, c + b, a[:12] + fresh(40), ["x"] * 200, ["x"] * 90 + fresh(4), c[3:29] + ["y"] * 30, ["y"] * 25, fresh(7) + c[:16] + fresh(7)]
    data = [(7 * k, " ".join(t)) for k, t in enumerate(texts)] + [(300, texts[4] and " ".join(texts[4])), (None, " ".join(a)), (None, " ".join(a))]
    table = spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in data], DOCS)
    want = plain_longest([(1 << 60 if i is None else i, t.split()) for i, t in data])
    got = rows(substring.digest(table), "doc_id", "longest")
    assert got == sorted(((i, want[1 << 60 if i is None else i]) for i, _ in data), key=repr) and max(n for _, n in got) == 832


# 6 ---------------------------------------------------------------------------------------------


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    data = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)], 0) for i in range(300)]
    data += [(300 + i, data[0][1], 0) for i in range(20)] + [(400, None, 0), (401, [0.0] * 8, 0), (402, [float("nan")] * 8, 0), (403, [1.0, None] * 4, 0), (None, [1.0] * 8, 0), data[5], (500, [2 * x for x in data[7][1]], 0)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    good = {i: np.array(v, float) for i, v, _ in data if i is not None and i not in (400, 401, 402, 403)}
    got = {}
    for r in ann.digest(table).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in good if i % 50 == 0}
    for q, found in got.items():
        score = {i: float((v * good[q]).sum() / (np.linalg.norm(v) * np.linalg.norm(good[q]))) for i, v in good.items() if i != q}
        want = sorted(score, key=lambda i: (-round(score[i], 12), i))[:5]
        assert [i for _, i, _ in sorted(found)] == want and all(abs(s - score[i]) < 1e-12 for _, i, s in found)
    few = ann.digest(table.where("vec_id in (0, 1, 2)")).collect()
    assert len(few) == 2 and ann.digest(table.limit(0)).count() == 0


# 7 ---------------------------------------------------------------------------------------------


def test_escapes_are_reversible():
    rng = random.Random(7)
    for _ in range(500):
        text = "".join(rng.choice(["<", "|", ">", "\\", "s", "/", "[INST]", "</s>", "<|end|>", "<<SYS>>", "x\n"]) for _ in range(rng.randint(0, 12)))
        own, start, end = chat.piece("assistant", text)
        assert chat.parsed(own) == ("assistant", text) and chat.unescape(own[start:end]) == text
        body = chat.escape(text)
        assert not any(c in body for c in chat.CONTROL)


def test_conversations(spark):
    data = [(1, 1, "assistant", "b"), (1, 0, "user", "a<|"), (2, 0, None, None), (2, 0, "user", "x"), (2, 0, "user", "x"), (None, 5, "assistant", ""), (3, None, "system", "s")]
    data += [(9, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(70)]
    table = spark.createDataFrame([(*d, 0) for d in data], "conv_id long, turn long, role string, text string, depth int")
    want = []
    for conv in {d[0] for d in data} | {-1}:
        own = sorted((d for d in data + chat.TRICKY if d[0] == conv), key=lambda d: (d[1] is not None, d[1] or 0, d[2] or "", d[3] or ""))
        turns = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        size = sum(len(chat.piece(r, t)[0]) for _, _, r, t in own)
        want.append((conv, len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size))
    got = rows(chat.digest(table), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    assert got == sorted(want, key=repr)
    assert rows(chat.digest(table.limit(0)), "conv_id") == [(-1,)]


def test_best_branch_of_a_tree(spark):
    data = [("r", None, 1.0), ("a", "r", 5.0), ("b", "r", 1.0), ("c", "b", 9.0), ("d", "a", 1.0), ("lost", "gone", 1.0), ("x", "y", 1.0), ("y", "x", 1.0)]
    nodes = spark.createDataFrame(data, "node string, parent string, score double")
    assert rows(chat.chosen_paths(nodes), "path", "depth", "node") == [("c", 0, "r"), ("c", 1, "b"), ("c", 2, "c"), ("lost", 0, "lost")]
    assert {p for p, in rows(chat.chosen_paths(nodes, 2), "path")} == {"c", "d", "lost"}


# 8 ---------------------------------------------------------------------------------------------


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k:] == b[k + 1 :]


def test_lines(spark, docs, empty):
    extra = [(900, "a b c d e\na b c X e\nb c d e\na b c d e f\nq\nr\n\n"), (901, "a b c d e f\nz b c d e f g\nx a b c d e\nq")]
    long = [f"p{k}" for k in range(20_000)]
    extra += [(902, " ".join(long)), (903, " ".join(long[:9000] + ["other"] + long[9001:])), (904, " ".join(long[:15_000] + ["more"] + long[15_000:])), (905, " ".join(long[:3] + long[5:]))]
    data = corpus(40) + [(i, t, None, None, None, None, None) for i, t in extra]
    table = spark.createDataFrame(data, DOCS)
    seen: dict = {}
    for i, t, *_ in data:
        for k, line in enumerate(t.split("\n") if t is not None else []):
            w = tuple(line.split())
            if w:
                seen[w] = min(seen.get(w, (i, k)), (i, k))
    order = sorted(seen, key=seen.get)
    near = {w for n, w in enumerate(order) if any(max(len(w), len(v)) >= 5 and one_edit(w, v) for v in order[:n])}
    want = set()
    for i, t, *_ in data:
        own = [(k, tuple(x.split())) for k, x in enumerate(t.split("\n") if t is not None else [])]
        gone = tuple(k for k, w in own if w and (seen[w] < (i, k) or w in near))
        want.add((i, len(own), len(gone), gone))
    got = {(r["doc_id"], r["n_lines"], r["n_removed"], tuple(r["removed"])) for r in linedup.digest(table).collect()}
    assert got == want and any(w in near for w in seen)
    assert linedup.digest(empty).count() == 0
    kept = dict(rows(linedup.dedup(table).where("doc_id = 901"), "doc_id", "text"))
    assert linedup.dedup(table).columns == table.columns and "x a b c d e" in kept[901] or "z b c" in kept[901]


# 9 ---------------------------------------------------------------------------------------------


def test_mix(spark, docs, empty):
    got = mixing.mix(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((i, size(t)) for i, t, *_ in corpus())
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    of = {r[0]: r[3] for r in corpus()}
    total = sum(size(t) for _, t, *_ in corpus())
    sources = sorted({of[i] for i in of if of[i]}) + [None]
    words = {s: sum(size(t) for i, t, *_ in corpus() if of[i] == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    target, full = {}, set()
    while True:
        rest = 1.5 * total - sum(2 * words[s] for s in full)
        share = {s: rest * weight[s] / sum(weight[x] for x in sources if x not in full) for s in sources if s not in full}
        over = {s for s in share if share[s] > 2 * words[s]}
        if not over:
            target = share | {s: 2 * words[s] for s in full}
            break
        full |= over
    assert all(abs(r["target"] - target[of[r["doc_id"]]]) < 1e-6 for r in got)
    assert sum(r["taken"] for r in got) <= 1.5 * total
    again = rows(mixing.mix(docs.repartition(3)), "doc_id", "size", "taken")
    assert again == sorted(((r["doc_id"], r["size"], r["taken"]) for r in got), key=repr)
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_mix_meets_targets(spark):
    data = [(i, "w " * (1 + i % 9), None, "abc"[min(i % 6, 2)], None, None, None) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(data, DOCS)).collect()
    of = {i: s for i, _, _, s, *_ in data}
    for s in "abc":
        own = [r for r in got if of[r["doc_id"]] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 20


# 10 --------------------------------------------------------------------------------------------


def fold10(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize("limit", [decontam.AUTOMATON_WORDS, 40])
def test_contamination(spark, docs, empty, limit):
    texts = [t for _, t, *_ in corpus() if t]
    items = [(k, " ".join(t.split()[:20])) for k, t in enumerate(texts[:12])] + [(50, "ka LO"), (51, None), (52, "?!"), (53, texts[0]), (53, texts[1]), (54, "née 9é")]
    docs = docs.unionByName(spark.createDataFrame([(800, "x Née, 9É née 9é ka-lo", None, None, None, None, None)], DOCS))
    bench = spark.createDataFrame(items, "item_id long, text string")
    wins: dict = {}
    for k, t in items:
        w = fold10(t)
        for p in range(max(1, len(w) - 12)):
            if w[p : p + 13]:
                wins.setdefault(tuple(w[p : p + 13]), set()).add(str(k))
    want = []
    for i, t in [(r[0], r[1]) for r in corpus()] + [(800, "x Née, 9É née 9é ka-lo")]:
        w, hit, met = fold10(t), set(), set()
        for n in {len(x) for x in wins}:
            for p in range(len(w) - n + 1):
                if found := wins.get(tuple(w[p : p + n])):
                    hit |= set(range(p, p + n))
                    met |= found
        want.append((i, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    got = rows(decontam.report(docs, bench, words=limit), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(want, key=repr)
    assert decontam.report(empty, bench).count() == 0
    assert decontam.report(docs, bench.limit(0)).where("contaminated or n_hit > 0").count() == 0
    clean = decontam.clean(docs, bench)
    assert sorted(i for i, in rows(clean, "doc_id")) == sorted(w[0] for w in want if not w[-1]) and clean.columns == docs.columns
    cut = decontam.clean(docs, bench, "cut")
    assert decontam.report(cut, bench).where("n_hit > 12").count() <= 3


# Columns of any name ---------------------------------------------------------------------------

NAMES = ["__score", "score", "__text", "__match", "match", "__id", "__h", "h", "__n", "__k", "__gone", "gone", "shard", "slot", "__rank", "__total", "row", "fp", "node", "size"]


def test_clashing_names(spark):
    """Operators that give documents back keep all columns as they were, whatever they are called."""
    data = [(i, f"some words that stand here {i} and there {i % 3} you\nand another line {i % 2}", "en", f"s{i % 2}", i, *[f"{n}{i}" for n in NAMES]) for i in range(12)]
    table = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "nothing of the kind")], "item_id long, text string")
    by_id = {r[0]: r for r in data}
    for made in (toxicity.reject(table, labels), simhash.one_of_each(table), decontam.clean(table, bench), decontam.clean(table, bench, "cut"), mixing.mixed_documents(table), linedup.dedup(table)):
        assert made.columns == table.columns
        got = [tuple(r) for r in made.collect()]
        assert got and all(r[2:] == by_id[r[0]][2:] for r in got)
    whole = hilbert.sharded(table)
    assert all(r["__score"] == f"__score{r['doc_id']}" and r["row"] == f"row{r['doc_id']}" for r in whole.collect())
    for few in (substring.digest(table), simhash.digest(table), decontam.report(table, bench), mixing.mix(table), linedup.digest(table), toxicity.report(table, labels), hilbert.shard(table)):
        assert few.count() == 12


def test_hot_ids_and_long_vectors(spark):
    """A third of all rows without an id; one vector of many dimensions; repeated ids with different texts."""
    data = [(i if i % 3 else None, f"text {i} " + "word " * (i % 7), None, "a", None, None, None) for i in range(90)] + [(7, "other", None, None, None, None, None)]
    table = spark.createDataFrame(data, DOCS)
    assert mixing.mix(table).count() == len(data) and rows(mixing.mix(table), "doc_id", "taken") == rows(mixing.mix(table.repartition(7)), "doc_id", "taken")
    kept = simhash.one_of_each(spark.createDataFrame([(1, "a b c d e f g", None, None, None, None, None), (2, "a b c d e f g", None, None, None, None, None), (2, "q w e r t z u", None, None, None, None, None)], DOCS))
    assert rows(kept, "doc_id", "text") == [(1, "a b c d e f g"), (2, "q w e r t z u")]  # a kept id doesn't save a copy
    rng = np.random.default_rng(8)
    wide = [(i, [float(x) for x in rng.normal(size=3000)], 0) for i in (0, 1, 2, 50)]
    got = ann.digest(spark.createDataFrame(wide, "vec_id long, embedding array<double>, label int")).collect()
    assert len(got) == 6
    for r in got:
        a, b = (np.array(next(v for i, v, _ in wide if i == r[c])) for c in ("query_id", "vec_id"))
        assert abs(r["score"] - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12


def test_query_blocks_of_vectors(spark):
    rng = np.random.default_rng(9)
    table = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(200)], "vec_id long, v array<double>")
    one, many = ann.search(table, table), ann.search(table, table, query_bytes=1000)
    assert rows(one, "query_id", "rank", "vec_id") == rows(many, "query_id", "rank", "vec_id") and one.count() == 1000


def plain_best_path(nodes):
    """Per root the path to the leaf with the largest sum of scores on the way, then the smallest name."""
    parent, score = {n: p for n, p, _ in nodes}, {n: s for n, _, s in nodes}
    best: dict = {}
    for leaf in set(parent) - {p for p in parent.values() if p in parent}:
        path = [leaf]
        while parent[path[-1]] in parent and len(path) <= len(nodes):
            path.append(parent[path[-1]])
        if len(path) <= len(nodes):
            own = (-sum(score[n] for n in path), leaf)
            if path[-1] not in best or own < best[path[-1]][0]:
                best[path[-1]] = own, path[::-1]
    return {root: path for root, (_, path) in best.items()}


def test_branches_against_plain_python(spark):
    rng = random.Random(12)
    nodes = [(f"n{k}", f"n{rng.randrange(k)}" if k > 5 and rng.random() < 0.97 else None, float(rng.randint(-3, 3))) for k in range(150)]
    nodes += [(f"c{k}", f"c{k - 1}" if k else None, 1.0) for k in range(40)] + [("x", "y", 1.0), ("y", "x", 1.0)]
    got: dict = {}
    for r in chat.chosen_paths(spark.createDataFrame(nodes, "node string, parent string, score double")).collect():
        got.setdefault(r["path"], {})[r["depth"]] = r["node"]
    assert sorted([[p[d] for d in sorted(p)] for p in got.values()]) == sorted(plain_best_path(nodes).values())


def test_cut_with_equal_times(spark):
    """Many copies that finish at one time, and a budget that ends among them."""
    data = [(i, "w " * 4, None, "abcdefgh"[i % 8], None, None, None) for i in range(4000)]
    got = mixing.mix(spark.createDataFrame(data, DOCS)).collect()
    assert sum(r["taken"] for r in got) <= 1.5 * 16_000 and {r["taken"] // r["size"] for r in got} <= {0, 1, 2}
    assert abs(sum(r["taken"] for r in got) - 24_000) <= 8 * 8


# Pipeline --------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame(corpus(), DOCS).drop("h", "fp").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join((corpus()[0][1]).split()[:15]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        before = spark.read.parquet(f"{tmp_path}/out{k}")
        if k < 4:
            assert sorted(before.columns) == sorted(docs.columns), name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == before.count() > 0
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).count() == 0


def test_stage_contents(spark, tmp_path):
    """What each stage keeps of what it was given, against plain Python; further columns go along."""
    import corpus_pipeline

    bad = [(300 + k, f"you idiot and you moron, what scum {k}", "en", "s1", 0, "x", 1) for k in range(5)]
    data = [r for r in corpus(40) if r[0] is None or r[0] < 43] + bad
    spark.createDataFrame(data, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    item = " ".join(fold10(corpus(40)[2][1])[:14])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    given, table = data, spark.read.parquet(f"{tmp_path}/documents.parquet")
    grammar = toxicity.Grammar()  # labels of one kind teach nothing: the seed grammar holds
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, table, str(tmp_path)).write.parquet(f"{tmp_path}/kept{k}")
        table = spark.read.parquet(f"{tmp_path}/kept{k}")
        got = sorted((tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars", "h", "fp")) for r in table.collect()), key=repr)
        if name == "toxicity":
            want = [r for r in given if grammar.score(r[1]) < 0.7]
            assert len(want) == len(given) - len(bad)
        elif name.startswith("simhash"):
            of = plain_copies([(i, t or "") for i, t, *_ in given])
            want = list({r[0]: r for r in given if of[r[0]] == r[0]}.values())
            assert len(want) < len(given)
        elif name.startswith("benchmark"):
            window = item.split()[:13], item.split()[1:]
            hit = lambda t: sum(any(w[p : p + 13] in window for p in range(max(0, i - 12), i + 1)) for i in range(len(w))) if (w := fold10(t)) else 0
            want = [r for r in given if not (hit(r[1]) and 20 * hit(r[1]) >= len(fold10(r[1])))]
            assert len(want) < len(given)
        elif name.startswith("mixing"):
            times = {r["doc_id"]: r["n_copies"] for r in mixing.mix(spark.createDataFrame(given, DOCS)).collect()}
            want = [r for r in given for _ in range(times[r[0]])]
            sizes = {i: len(fold10(t)) for i, t, *_ in given}
            assert {0, 2} <= set(times.values()) or len(set(times.values())) > 1, sizes
        else:
            want = given
            placed = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["shard"]) for r in table.collect())
            assert placed == sorted((i is not None, i or 0, s) for i, _, _, s, _ in plain_shards(given))
        assert got == sorted((tuple(r) for r in want), key=repr), name
        given = got


def test_near_copies_stage_against_plain_python(spark):
    import corpus_pipeline

    data = graded(times=2) + repeated(1000, times=5)
    want = plain_copies(data)
    table = spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in data], DOCS)
    kept = corpus_pipeline.near_copies_out(spark, table, "")
    assert rows(kept, "doc_id", "text") == sorted(((i, t) for i, t in data if want[i] == i), key=repr)
    assert corpus_pipeline.near_copies_out(spark, table.limit(0), "").count() == 0


def test_queries_are_named():
    from cartula.llm.queries import ORACLES, QUERIES

    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
