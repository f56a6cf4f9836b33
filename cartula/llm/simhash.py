"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints that differ in few bits agree on all bits of some bands, so buckets of
fingerprints that agree on a choice of bands hold every link. Within a bucket the
fingerprints are stored vertically, one machine word of 64 lanes for each bit, and
distances of 64 lanes at a time are summed by carry-save adders; words whose lanes all
exceed the radius, or don't count, are abandoned on the way. A bucket returns one link
for each fingerprint that joins another, and components are found by alternating
large-star and small-star steps on tables.

Defined results: a null or wordless text has fingerprint zero, which links like any
other; a null ``doc_id`` is carried but never names a component that has another id;
repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartula.llm.common import checkpoint, fresh, parts, small_batches

#: Words of a shingle, and differing bits of linked fingerprints, in the registered query.
SHINGLE, RADIUS, SEED = 4, 4, 42
#: Shingles whose hashes are in memory at once.
SLICE = 1 << 15
#: Distinct fingerprints of a bucket that one task compares; a larger bucket is cut into pairs of pieces.
BUCKET = 8192
#: Up to this size buckets are compared side by side, lag by lag.
SMALL = 48

ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64 bits; a bit is 1 if it is set in over half of the shingles' hashes."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, SLICE):
        own = words[at : at + SLICE + shingle - 1]
        grams = map(b" ".join, zip(*(own[k:] for k in range(shingle)))) if n > 1 or len(words) == shingle else [b" ".join(words)]
        hashes = np.fromiter((digest(g, SEED) for g in grams), np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t, shingle) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("t")).mapInArrow(run, "doc_id long, fp long")


def bands(n: int, radius: int = RADIUS) -> tuple[int, int]:
    """Bands, and how many must agree: as few buckets a fingerprint as keep random buckets small."""
    for extra in range(1, 33 - radius):
        if 64 * extra / (radius + extra) >= np.log2(max(n, 2)) - 1.5 and extra >= 2:
            return radius + extra, extra
    return 32, 32 - radius


def keys(fp: str, n_bands: int, agree: int) -> F.Column:
    """One long for each choice of bands: the choice's number and a hash of the bits of its bands."""
    edges = [64 * k // n_bands for k in range(n_bands + 1)]
    out = []
    for number, chosen in enumerate(combinations(range(n_bands), agree)):
        mask = sum(((1 << edges[b + 1]) - (1 << edges[b])) for b in chosen)
        mask -= (1 << 64) if mask >= 1 << 63 else 0
        out.append(F.xxhash64(F.lit(number), F.col(fp).bitwiseAND(F.lit(mask).cast("long"))))
    return F.array(*out)


def planes(fps: np.ndarray) -> np.ndarray:
    """64 rows of words: bit b of lane i is bit i % 64 of word i // 64 of row b."""
    wide = np.zeros(-(-len(fps) // 64) * 64, np.uint64)
    wide[: len(fps)] = fps
    bits = np.unpackbits(wide.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def within(difference, shape, live: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose 64 difference bits number radius at most.

    difference(b, at) gives the words of difference bit b at the flat places at; live has the
    lanes that count. Two difference words enter a carry-save adder at a time; its carries
    ripple through counters of as many bits as the radius has, and what leaves them is over.
    """
    at = np.flatnonzero(live)
    counts = live.reshape(-1)[at]
    bits = [np.zeros(len(at), np.uint64) for _ in range(max(1, radius.bit_length()))]
    over = np.zeros(len(at), np.uint64)
    for b in range(0, 64, 2):
        x, y = difference(b, at), difference(b + 1, at)
        half = bits[0] ^ x
        carry = (bits[0] & x) | (half & y)
        bits[0] = half ^ y
        for k in range(1, len(bits)):
            bits[k], carry = bits[k] ^ carry, bits[k] & carry
        over |= carry
        if b in (14, 22, 30, 38, 46, 54):
            go = (counts & ~(over | _above(bits, radius))) != 0
            if not go.all():
                at, counts, over, *bits = (v[go] for v in (at, counts, over, *bits))
                if not len(at):
                    break
    out = np.zeros(live.size, np.uint64)
    out[at] = counts & ~(over | _above(bits, radius))
    return out.reshape(shape)


def _above(bits: list[np.ndarray], radius: int):
    """Lanes whose counter, lowest bit first, is above radius."""
    out, same = np.zeros_like(bits[0]), np.full_like(bits[0], ALL)
    for k in reversed(range(len(bits))):
        if radius >> k & 1:
            same = same & bits[k]
        else:
            out |= same & bits[k]
    return out


def _lanes(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), bitorder="little")[:n].astype(bool)


def _pack(lanes: np.ndarray) -> np.ndarray:
    wide = np.zeros(-(-len(lanes) // 64) * 64, bool)
    wide[: len(lanes)] = lanes
    return np.packbits(wide, bitorder="little").view(np.uint64)


def small_links(group: np.ndarray, fps: np.ndarray, radius: int, alike=None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs, as places, within each group; groups are runs of equal values, SMALL long at most.

    alike(i, j) says of pairs within the radius which are links; all if it is not given.
    """
    found, n = [], len(fps)
    p = planes(fps)
    most = int(np.diff(np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])).max(initial=1))
    for lag in range(1, most):
        lanes = np.zeros(n, bool)
        lanes[: n - lag] = group[lag:] == group[: n - lag]
        live = _pack(lanes)
        # Bit planes moved down by lag lanes, from two neighbouring words each.
        skip, shift = lag // 64, np.uint64(lag % 64)
        ahead = np.pad(p, ((0, 0), (0, skip + 2)))

        def difference(b, at):
            low, high = ahead[b, at + skip] >> shift, ahead[b, at + skip + 1] << (np.uint64(64) - shift)
            return p[b, at] ^ (low | high)

        hit = np.flatnonzero(_lanes(within(difference, live.shape, live, radius), n))
        if len(hit) and alike is not None:
            hit = hit[alike(hit, hit + lag)]
        if len(hit):
            found.append((hit, hit + lag))
    return found


def large_links(fps: np.ndarray, radius: int, alike=None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links, as places, that join each component of one group: breadth first, against the lanes not yet reached."""
    found = []
    edge = np.empty(0, np.int64)
    p, own = planes(fps), np.ones(len(fps), bool)
    lane_of = np.arange(len(fps))  # lanes of p, as places in fps
    while own.any():
        if not len(edge):
            seed = int(np.flatnonzero(own)[0])
            edge, own[seed] = lane_of[[seed]], False
        asked, edge = edge[:64], edge[64:]
        live = np.broadcast_to(_pack(own), (len(asked), p.shape[1]))
        width = p.shape[1]
        bits = np.where((fps[asked, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1), ALL, np.uint64(0))
        hit = within(lambda b, at: p[b, at % width] ^ bits[at // width, b], live.shape, live, radius)
        rows, lanes = np.nonzero(np.stack([_lanes(h, len(own)) for h in hit]))
        if len(rows) and alike is not None:
            good = alike(asked[rows], lane_of[lanes])
            rows, lanes = rows[good], lanes[good]
        if len(rows):
            new, one = np.unique(lanes, return_index=True)
            found.append((asked[rows[one]], lane_of[new]))
            own[new] = False
            edge = np.r_[edge, lane_of[new]]
            if own.any() and own.sum() * 2 < len(own):
                lane_of = lane_of[own]
                p, own = planes(fps[lane_of]), np.ones(len(lane_of), bool)
    return found


def _compare(radius: int, similarity: float | None = None):
    """Reads buckets, which are runs of equal k: node, fp and, for a similarity, sketch; gives u > v, links between nodes."""

    def linked(rows: dict[str, np.ndarray]):
        k, f, nodes = rows["k"], rows["fp"].view(np.uint64), rows["node"]
        edges = np.flatnonzero(np.r_[True, k[1:] != k[:-1], True]) if len(k) else np.zeros(1, np.int64)
        sizes = np.diff(edges)
        out = []

        def of(at):
            if similarity is None:
                return None
            own = rows["sketch"][at]
            cut = lambda i: [i[k : k + PAIRS] for k in range(0, len(i), PAIRS)]
            return lambda i, j: np.concatenate([alike(own[x], own[y], similarity) for x, y in zip(cut(i), cut(j))])

        small = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SMALL), sizes))
        if len(small):
            out += [(small[i], small[j]) for i, j in small_links(k[small], f[small], radius, of(small))]
        for g in np.flatnonzero(sizes > SMALL):
            at = np.arange(edges[g], edges[g + 1])
            out += [(at[i], at[j]) for i, j in large_links(f[at], radius, of(at))]
        if out:
            a, b = (nodes[np.concatenate(x)] for x in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["u", "v"])

    def run(batches):
        held = None
        for batch in batches:
            rows = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("k", "node", "fp")}
            if similarity is not None:
                rows["sketch"] = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(-1, BINS)
            held = rows if held is None else {n: np.concatenate([held[n], rows[n]]) for n in rows}
            k = held["k"]
            cut = int(np.searchsorted(k, k[-1])) if len(k) else 0  # the last bucket may go on
            yield from linked({n: v[:cut] for n, v in held.items()})
            held = {n: v[cut:] for n, v in held.items()}
        if held is not None:
            yield from linked(held)

    return run


def _buckets(rows: DataFrame) -> DataFrame:
    """rows (k, node ...) with buckets of over BUCKET rows cut: each pair of their pieces is a bucket."""
    hot = checkpoint(rows.groupBy("k").count().where(F.col("count") > BUCKET))
    if hot.isEmpty():
        return rows
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("pieces"))
    cut = rows.join(hot, "k").withColumn("pieces", F.ceil(F.col("count") / (BUCKET // 2)).cast("int")).withColumn("own", own)
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    cut = cut.withColumn("k", F.xxhash64("k", F.least("own", "other"), F.greatest("own", "other"))).select(*rows.columns)
    return rows.join(hot, "k", "left_anti").unionByName(cut)


def links(distinct: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """u > v: links between the nodes of distinct fingerprints (node, fp) that join what is within the radius."""
    rows = distinct.select(F.explode(keys("fp", *bands(n, radius))).alias("k"), "node", "fp")
    spread = _buckets(rows).repartition(parts(distinct.sparkSession), "k").sortWithinPartitions("k")
    return spread.mapInArrow(_compare(radius), "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: each node of the edges (u, v) and the smallest node that it reaches."""
    edges = checkpoint(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        # Large star: neighbours above a node go to its least neighbour.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpoint(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: a node and its neighbours below it go to the least of them.
        down = checkpoint(large.where("u <> v").distinct())
        least = checkpoint(down.groupBy("u").agg(F.min("v").alias("m")))
        small = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = checkpoint(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        stars = after.select("u").intersect(after.select("v")).isEmpty()
        if stars and after.groupBy("u").count().where("count > 1").isEmpty():
            roots = after.select("v").distinct()
            return after.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
        edges = after


def with_node(rows: DataFrame, key: str, first: str) -> tuple[DataFrame, int]:
    """rows with node: their first id or, without one, a number from the key above all ids; and the largest id.

    So the smallest node that a component reaches is its smallest id, and needs no further grouping by component.
    """
    top = rows.agg(F.max(first)).first()[0]
    top = 0 if top is None else top
    above = F.lit(top) + 1 + F.pmod(F.xxhash64(key), F.lit(max(1, (1 << 63) - 2 - top)))
    return rows.withColumn("node", F.coalesce(first, above)), top


def _named(nodes: DataFrame, found: DataFrame, top: int, key: str) -> DataFrame:
    """__key and component_id of each of the nodes."""
    found = found.withColumnRenamed("node", "__node")
    root = F.coalesce("root", "node")
    return checkpoint(nodes.join(found, nodes["node"] == found["__node"], "left").select(F.col(key).alias("__key"), F.when(root <= top, root).alias("component_id")))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp (signed long) and component_id of each row of docs."""
    prints = checkpoint(fingerprints(docs, shingle))
    nodes, top = with_node(checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("first"))), "fp", "first")
    found = components(links(nodes.select("fp", "node"), nodes.count(), radius))
    of = _named(nodes, found, top, "fp")
    return prints.join(of, prints["fp"] == of["__key"]).drop("__key")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id."""
    rows = near_duplicates(docs)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Near copies by similarity: words of a shingle, and the radius in which they are looked for.
#: Fingerprints of sets at the least similarity differ by 10 bits of 64, and by over 28 with a probability of 1e-8
#: (of 1e-6 where the sets have four and five shingles).
COPY_SHINGLE, COPY_RADIUS = 5, 28
#: Least hashes of a shingle set over so many bands of so many; bins of its sketch; the least similarity of near copies.
COPY_BANDS, COPY_ROWS, BINS, COPY_SIMILARITY = 10, 3, 128, 0.8
#: How far under that a sketch may be and its pair be looked at: over five deviations (of 0.035) of its estimate.
SLACK = 0.2
#: Pairs whose sketches are compared at once.
PAIRS = 1 << 16
#: Bytes of the texts that one task proves; a larger group is cut into pairs of pieces.
PROVED = 32 << 20


def shingles(words: list[bytes], shingle: int = COPY_SHINGLE) -> np.ndarray:
    """The set of the shingles' hashes, in order; fewer words are one shingle."""
    n = max(1, len(words) - shingle + 1)
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, n))


def set_fingerprint(hashes: np.ndarray) -> int:
    """Unsigned 64 bits; a bit is 1 if it is set in over half of the hashes. How often a text repeats a shingle is nothing to it."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SLICE):
        counts += np.unpackbits(hashes[at : at + SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * counts > len(hashes)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def sketch(text: bytes | None, shingle: int = COPY_SHINGLE) -> tuple[int, int, list[int], bytes]:
    """node (a hash of the words), fingerprint of the set of shingles, band keys, and the least hash of each bin of the set of shingles."""
    words = text.lower().split() if text else []
    hashes = shingles(words, shingle)
    node = xxhash.xxh3_64_intdigest(b" ".join(words))
    least = np.array([(hashes * m).min() for m in _FACTORS[:-1]]).reshape(COPY_BANDS, COPY_ROWS)
    keys = [xxhash.xxh3_64_intdigest(bytes([b]) + row.tobytes()) for b, row in enumerate(least)]
    mixed = hashes * _FACTORS[-1]
    bins = np.full(BINS, 0xFFFF, np.uint16)  # stands for an empty bin
    np.minimum.at(bins, (mixed >> np.uint64(57)).astype(np.int64), ((mixed >> np.uint64(41)) & np.uint64(0xFFFF)).astype(np.uint16))
    return node, set_fingerprint(hashes), keys, bins.tobytes()


_FACTORS = np.random.default_rng(SEED).integers(1 << 32, 1 << 63, COPY_BANDS * COPY_ROWS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sketches agree in that share of the bins that either fills."""
    filled = (a != 0xFFFF) | (b != 0xFFFF)
    return ((a == b) & filled).sum(axis=1) >= similarity * np.maximum(filled.sum(axis=1), 1)


def proved_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, np.ndarray]]:
    """Links, as places, that join each component of the sets of a group by their exact similarity: one set at a time
    against all that are not yet reached."""
    found, edge = [], []
    sizes = np.array([len(s) for s in sets], np.int64)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    own = np.split(ids, np.cumsum(sizes)[:-1])
    asked_of = np.zeros(int(ids.max()) + 1, bool)
    place, left = np.arange(len(sets)), np.ones(len(sets), bool)  # sets in ids, and which are not yet reached
    starts = np.cumsum(sizes) - sizes
    while left.any():
        if not edge:
            seed = int(np.flatnonzero(left)[0])
            left[seed] = False
            edge.append(int(place[seed]))
            continue
        asked = edge.pop()
        asked_of[own[asked]] = True
        shared = np.add.reduceat(asked_of[ids], starts, dtype=np.int64)
        asked_of[own[asked]] = False
        hit = np.flatnonzero(left & (shared / (sizes[place] + sizes[asked] - shared) >= similarity))
        if len(hit):
            found.append((asked, place[hit]))
            edge += place[hit].tolist()
            left[hit] = False
        if left.any() and left.sum() * 2 < len(left):
            place = place[left]
            ids, left = np.concatenate([own[i] for i in place]), np.ones(len(place), bool)
            starts = np.cumsum(sizes[place]) - sizes[place]
    return found


def _prove(similarity: float, shingle: int = COPY_SHINGLE):
    """Reads groups, which are runs of equal k: k, node and text; gives u > v, links between nodes."""

    def linked(nodes: list[int], sets: list[np.ndarray]):
        pairs = proved_links(sets, similarity) if len(sets) > 1 else []
        if pairs:
            at = np.array(nodes, np.int64)
            a, b = np.repeat(at[[i for i, _ in pairs]], [len(j) for _, j in pairs]), at[np.concatenate([j for _, j in pairs])]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["u", "v"])

    def run(batches):
        k, nodes, sets = None, [], []
        for batch in batches:
            for key, node, text in zip(*(c.to_pylist() for c in batch.columns)):
                if key != k:
                    yield from linked(nodes, sets)
                    k, nodes, sets = key, [], []
                if not nodes or nodes[-1] != node:
                    nodes.append(node)
                    sets.append(shingles(text.lower().split() if text else [], shingle))
        yield from linked(nodes, sets)

    return run


def proved(docs: DataFrame, nodes: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """u > v: links that join the nodes of each group (node, root) whose sets of shingles have the similarity.

    nodes: node, h (the hash of a text that has these words) and size (its bytes); docs have the text.
    """
    own = checkpoint(groups.join(nodes.select("node", "h", "size"), "node"))
    pieces = F.greatest(F.ceil(F.col("n") / (BUCKET // 2)), F.ceil(F.col("bytes") / (PROVED // 2))).cast("int")
    hot = own.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).where((F.col("n") > BUCKET) | (F.col("bytes") > PROVED))
    hot = checkpoint(hot.select("root", F.greatest(pieces, F.lit(2)).alias("pieces")))
    rows = own.join(hot, "root", "left").withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.col("pieces")))
    others = F.when(F.col("pieces").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("pieces") - 1))
    piece = F.explode(others).alias("other")
    rows = rows.select("node", "h", "root", "own", piece)
    k = F.when(F.col("other") < 0, F.col("root")).otherwise(F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")))
    wanted = own.select("node", "h")
    texts = docs.select(F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("t")).join(wanted, "h").dropDuplicates(["node"]).select("node", "t")
    dealt = rows.select(k.alias("k"), "node").join(texts, "node").select("k", "node", "t")
    spread = dealt.repartition(parts(docs.sparkSession), "k").sortWithinPartitions("k", "node")
    return spread.mapInArrow(_prove(similarity), "u long, v long").distinct()


def copies(docs: DataFrame, similarity: float = COPY_SIMILARITY) -> DataFrame:
    """doc_id, h (a hash of the text) and component_id of each row: groups of near copies by similarity of five-word shingles.

    Texts that share a band of least hashes meet in a bucket; their fingerprints are compared
    bit-sliced, and the sketches of what is within the radius are, with slack. Any link is
    within the groups that this makes; in these the sets of shingles are compared exactly.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            node, fp, ks, bins = zip(*(sketch(t) for t in b.column(1).to_pylist())) if b.num_rows else ((), (), (), ())
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            bands_of = pa.ListArray.from_arrays(np.arange(0, len(ks) * COPY_BANDS + 1, COPY_BANDS, dtype=np.int32), signed(np.array(ks, np.uint64).reshape(-1)))
            made = [b.column(0), signed(node), signed(fp), bands_of, pa.array(bins, pa.binary()), b.column(2), b.column(3)]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "node", "fp", "keys", "sketch", "h", "size"])

    schema = "doc_id long, node long, fp long, keys array<long>, sketch binary, h long, size long"
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("t"), F.xxhash64("text").alias("h"), size)
    made = checkpoint(given.mapInArrow(run, schema))
    prints = made.select("doc_id", F.col("node").alias("words"), "h")
    one = F.min(F.struct("h", "size"))
    nodes = made.groupBy(F.col("node").alias("words")).agg(F.min("doc_id").alias("first"), F.min("fp").alias("fp"), F.min("keys").alias("keys"), F.min("sketch").alias("sketch"), one.alias("one"))
    nodes, top = with_node(checkpoint(nodes.select("words", "first", "fp", "keys", "sketch", "one.h", "one.size")), "words", "first")
    rows = nodes.select(F.explode("keys").alias("k"), "node")
    shared = checkpoint(rows.groupBy("k").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("k"))
    met = _buckets(checkpoint(rows.join(shared, "k"))).join(nodes.select("node", "fp", "sketch"), "node").select("k", "node", "fp", "sketch")
    spread = met.repartition(parts(docs.sparkSession), "k").sortWithinPartitions("k")
    maybe = components(spread.mapInArrow(_compare(COPY_RADIUS, similarity - SLACK), "u long, v long").distinct())
    of = _named(nodes, components(proved(docs, nodes, maybe, similarity)), top, "words")
    return prints.join(of, prints["words"] == of["__key"]).select("doc_id", "h", "component_id")


def one_of_each(docs: DataFrame, similarity: float = COPY_SIMILARITY) -> DataFrame:
    """docs without near copies: of each group the row of the smallest id stays, once; all columns.

    Of texts of one group that share the smallest id one stays. Rows with a null id stay, those of
    equal texts once, unless their text is a copy of a row that has an id.
    """
    id_, h = fresh(docs, "__id", "__h")
    last = F.lit((1 << 63) - 1)
    groups = copies(docs.select("doc_id", "text"), similarity)
    first = groups.where("doc_id = component_id").groupBy("component_id").agg(F.min("h").alias("h"))
    stay = first.unionByName(groups.where("component_id is null").select(last.alias("component_id"), "h").distinct())
    stay = stay.select(F.col("component_id").alias(id_), F.col("h").alias(h))
    rows = docs.withColumn(id_, F.coalesce(F.col("doc_id").cast("long"), last)).withColumn(h, F.xxhash64("text"))
    return rows.join(stay, [id_, h], "left_semi").dropDuplicates([id_, h]).select(*docs.columns)
