"""Near-duplicates by SimHash, linked by generalised pigeonhole search.

Fingerprints that differ in at most `radius` bits are linked; linked ones form components.

The search follows the generalised pigeonhole principle. The 64 bits are put into parts, those
that vary together in the same part. For each fingerprint, thresholds t_1..t_m with
sum(t_i) = radius - m + 1 are allotted by dynamic programming on estimated candidate counts
(-1 leaves a part out): whatever lies within the radius then agrees with it to within t_i bits
in some part i. The fingerprint is probed with every value within t_i bits of its own, and each
candidate is verified.

A bucket of the index with more than `bucket_cap` fingerprints isn't paired up. Whatever has a
row in it, or probes it, is linked in another exact way, whose work is linear: two fingerprints
within radius 2 have a common neighbour at distance 1 or less, and no more than 65 share one.
Copies with one fingerprint are one node throughout, so their number costs nothing.

Edge cases: a null or empty text, or one of white space only, has fingerprint zero and is linked
like any other; fewer words than a shingle has make one shingle; a null doc_id keeps its
fingerprint and takes its component's least id (null if all are null); repeated rows stay
repeated; an empty table gives no rows; other columns are passed over.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import BASES, bounded, buffers, cut, LOWER, mix, Rolling, Scratch, signed, trimmed, U, unused, word_hashes, words

BITS = 64
BUCKET_CAP = 128
#: Above so many distinct fingerprints two parts of 32 bits cost less than three of 21.
TWO_PARTS_FROM = 1 << 26


def text_fingerprint(text: bytes, shingle_words: int, seed: int = 42) -> int:
    """The fingerprint of one text; the vectorised form below gives the same."""
    w = text.lower().split()
    if not w:
        return 0
    k = min(shingle_words, len(w))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), seed) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(BITS) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _hashes(text: bytes, k: int, seed: int) -> list[int]:
    w = text.lower().split()
    if not w:
        return []
    k = min(k, len(w))
    joined, digest = b" ".join(w), xxhash.xxh64_intdigest
    ends = list(accumulate(map(len, w)))
    ends = [e + i for i, e in enumerate(ends)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    return [digest(joined[a:b], seed) for a, b in zip(starts, ends[k - 1 :], strict=False)]


def _majority(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Fingerprints of the runs of hashes between bounds."""
    out = np.zeros(len(bounds) - 1, U)
    full = np.flatnonzero(np.diff(bounds))
    if not len(full):
        return out
    step = 1 << 15
    ones = np.zeros((len(out), BITS), np.int64)
    for a in range(0, len(h), step):
        b = min(a + step, len(h))
        bits = np.unpackbits(h[a:b, None].astype(">u8").view(np.uint8), axis=1)
        at = np.searchsorted(bounds[full + 1], a, side="right")
        to = np.searchsorted(bounds[full], b, side="left")
        rows = full[at:to]
        cuts = np.maximum(bounds[rows], a) - a
        ones[rows] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    major = 2 * ones > np.diff(bounds)[:, None]
    out[:] = np.packbits(major, axis=1).view(">u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, shingle_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long): the fingerprint of each text's word shingles."""

    @trimmed

    def of(batches):
        for b in batches:
            col, ids = b.column(1), b.column(0)
            got = np.zeros(b.num_rows, U)
            for i, j, buf, off in buffers(col):
                raw = buf.tobytes()
                each = [_hashes(raw[off[r] : off[r + 1]], shingle_words, 42) for r in range(j - i)]
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
                got[i:j] = _majority(np.array([x for h in each for x in h], U), bounds)
            yield pa.record_batch([ids.cast(pa.int64()), pa.array(got.view(np.int64))], ["doc_id", "fp"])

    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        of, "doc_id long, fp long"
    )


# --- parts and thresholds ---------------------------------------------------------------


def _bit_table(fps: DataFrame) -> np.ndarray:
    """How many fingerprints have bits i and j set, for all i and j: 4,096 sums."""

    @trimmed

    def of(batches):
        total = np.zeros((BITS, BITS), np.int64)
        for b in batches:
            x = np.asarray(b.column(0)).view(U)
            bits = (x[:, None] >> np.arange(BITS, dtype=U) & U(1)).astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
        cell = np.flatnonzero(total)
        yield pa.record_batch([pa.array(cell.astype(np.int32)), pa.array(total.ravel()[cell])], ["cell", "n"])

    rows = fps.select("fp").mapInArrow(of, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BITS * BITS, np.int64)
    for r in rows:
        out[r.cell] = r.n
    return out.reshape(BITS, BITS)


def bit_parts(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """The bits in parts of nearly equal width, those correlated most in the same part."""
    p = both / max(n, 1)
    one = np.diag(p)
    spread = np.sqrt(np.maximum(one * (1 - one), 1e-12))
    corr = np.abs((p - np.outer(one, one)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, out = set(range(BITS)), []
    for k in range(parts):
        width = (BITS - sum(map(len, out))) // (parts - k)
        rest = sorted(left)
        part = [max(rest, key=lambda b: (corr[b, rest].sum(), -b))]
        left.discard(part[0])
        while len(part) < width:
            nxt = max(sorted(left), key=lambda b: (corr[b, part].sum(), -b))
            part.append(nxt)
            left.discard(nxt)
        out.append(sorted(part))
    return out


def gather(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The value that these bits of each fingerprint make."""
    out = np.zeros(len(fp), U)
    for k, b in enumerate(bits):
        out |= (fp >> U(b) & U(1)) << U(k)
    return out


def _blocks(part: list[int]) -> list[list[int]]:
    return [part[i : i + 8] for i in range(0, len(part), 8)]


def _block_histograms(fps: DataFrame, parts: list[list[int]]) -> list[list[np.ndarray]]:
    """For each part, of each block of 8 bits: how often it has each of its values."""
    flat = [b for p in parts for b in _blocks(p)]

    @trimmed

    def of(batches):
        total = np.zeros((len(flat), 256), np.int64)
        for b in batches:
            x = np.asarray(b.column(0)).view(U)
            for k, bits in enumerate(flat):
                total[k] += np.bincount(gather(x, bits).astype(np.int64), minlength=256)
        cell = np.flatnonzero(total)
        yield pa.record_batch([pa.array(cell.astype(np.int32)), pa.array(total.ravel()[cell])], ["cell", "n"])

    rows = fps.select("fp").mapInArrow(of, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(len(flat) * 256)
    for r in rows:
        total[r.cell] = r.n
    it = iter(total.reshape(len(flat), 256))
    return [[next(it) for _ in _blocks(p)] for p in parts]


def _within(hist: np.ndarray, width: int, radius: int) -> np.ndarray:
    """[distance, value]: the share of fingerprints whose block differs from value in so many bits."""
    v = np.arange(256)
    dist = np.array([bin(x).count("1") for x in range(256)])[v[:, None] ^ v[None, :]]
    share = hist / max(hist.sum(), 1)
    return np.stack([(share[None, :] * (dist == d)).sum(1) for d in range(radius + 1)])


class Allotment:
    """Per-fingerprint thresholds, by dynamic programming on estimated candidate counts."""

    def __init__(self, parts: list[list[int]], hists: list[list[np.ndarray]], n: int, radius: int) -> None:
        self.parts, self.radius, self.n = parts, radius, n
        self.near = [[_within(h, len(b), radius) for h, b in zip(hs, _blocks(p), strict=True)] for p, hs in zip(parts, hists, strict=True)]
        self.masks = []
        for p in parts:
            by = [[0]]
            for d in range(1, radius + 1):
                by.append([sum(1 << b for b in c) for c in combinations(range(len(p)), d)])
            self.masks.append([np.array(sum(by[: d + 1], []), U) for d in range(radius + 1)])

    def costs(self, fp: np.ndarray) -> np.ndarray:
        """[part, threshold + 1, fingerprint]: probes and expected candidates."""
        out = np.zeros((len(self.parts), self.radius + 2, len(fp)))
        for i, part in enumerate(self.parts):
            exact = np.zeros((self.radius + 1, len(fp)))
            exact[0] = 1
            for near, block in zip(self.near[i], _blocks(part), strict=True):
                d = near[:, gather(fp, block).astype(np.int64)]
                exact = np.stack([sum(exact[a] * d[t - a] for a in range(t + 1)) for t in range(self.radius + 1)])
            for t in range(self.radius + 1):
                out[i, t + 1] = len(self.masks[i][t]) + self.n * exact[: t + 1].sum(0)
        return out

    def thresholds(self, fp: np.ndarray) -> np.ndarray:
        """[part, fingerprint]: thresholds of the least total cost whose sum is radius - parts + 1."""
        cost, m = self.costs(fp), len(self.parts)
        goal = self.radius + 1  # of the sum of thresholds plus one each
        best = np.full((goal + 1, len(fp)), np.inf)
        best[0] = 0
        took = []
        for i in range(m):
            options = np.full((goal + 1, self.radius + 2, len(fp)), np.inf)
            for s in range(goal + 1):
                for t in range(min(s, self.radius + 1) + 1):
                    options[s, t] = best[s - t] + cost[i, t]
            took.append(options.argmin(1))
            best = options.min(1)
        out, s, cols = np.zeros((m, len(fp)), np.int64), np.full(len(fp), goal), np.arange(len(fp))
        for i in range(m - 1, -1, -1):
            out[i] = took[i][s, cols]
            s = s - out[i]
        return out - 1

    def rows(self, fp: np.ndarray) -> tuple[np.ndarray, ...]:
        """Index rows and probe rows: (fingerprint, part, value, is probe)."""
        t = self.thresholds(fp)
        f, p, v, q = [], [], [], []
        for i, part in enumerate(self.parts):
            own = gather(fp, part)
            f.append(fp), p.append(np.full(len(fp), i)), v.append(own), q.append(np.zeros(len(fp), bool))
            for d in range(self.radius + 1):
                if len(at := np.flatnonzero(t[i] == d)):
                    m = self.masks[i][d]
                    f.append(np.repeat(fp[at], len(m)))
                    v.append((own[at][:, None] ^ m[None, :]).ravel())
                    p.append(np.full(len(at) * len(m), i))
                    q.append(np.ones(len(at) * len(m), bool))
        return np.concatenate(f), np.concatenate(p), np.concatenate(v), np.concatenate(q)


def links(nodes: DataFrame, radius: int = 2, bucket_cap: int = BUCKET_CAP) -> DataFrame:
    """(a, b): links between the distinct fingerprints `fp` that connect all within the radius.

    A hot bucket's fingerprints are linked through common neighbours, each to the least that
    shares one; the components are the same as with all pairs.
    """
    if radius != 2:
        raise ValueError("hot buckets are linked exactly for a radius of 2 only")
    n = nodes.count()
    parts = bit_parts(_bit_table(nodes), n, 2 if n >= TWO_PARTS_FROM else 3)
    allot = Allotment(parts, _block_histograms(nodes, parts), n, radius)

    @trimmed

    def of(batches):
        for b in batches:
            x = np.asarray(b.column(0)).view(U)
            for a in range(0, len(x), 4096):
                f, p, v, q = allot.rows(x[a : a + 4096])
                yield pa.record_batch(
                    [pa.array(f.view(np.int64)), pa.array(p.astype(np.int32)), pa.array(v.view(np.int64)), pa.array(q)],
                    ["fp", "part", "val", "probe"],
                )

    rows = cut(nodes.select("fp").mapInArrow(of, "fp long, part int, val long, probe boolean"))
    size = rows.filter("not probe").groupBy("part", "val").agg(F.count("*").alias("n"))
    hot = size.filter(F.col("n") > bucket_cap).select("part", "val")
    calm = rows.join(hot, ["part", "val"], "left_anti")
    probe, index = calm.filter("probe"), calm.filter("not probe").withColumnRenamed("fp", "other")
    pairs = (
        probe.join(index, ["part", "val"])
        .filter((F.col("fp") != F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius))
        .select(F.greatest("fp", "other").alias("a"), F.least("fp", "other").alias("b"))
    )
    crowd = rows.join(hot, ["part", "val"], "left_semi").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.shiftleft(F.lit(1).cast("long"), b) for b in range(BITS)))
    around = crowd.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    shared = around.groupBy("mid").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    stars = shared.select(F.array_min("fps").alias("b"), F.explode("fps").alias("a")).filter("a != b").select("a", "b")
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of the undirected edges (a, b) with its component's least node.

    Rounds of large-star and small-star, until a round changes nothing; the number of rounds
    grows with the logarithm of the nodes. Only two sums come to the driver in each round.
    """
    scratch = Scratch(edges.sparkSession)
    e = scratch.table("edges", edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .filter("u != v")
            .distinct()
        )
        before, e = e, scratch.table("edges", small, 2 * state[0] if state else None)
        scratch.drop(before)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        state = now


def near_duplicates(docs: DataFrame, shingle_words: int = 5, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id reachable over links."""
    fps = cut(fingerprints(docs, shingle_words, id_col, text_col))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes, radius))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(ids, "root").select("fp", "component_id")
    return fps.join(of, "fp").select("doc_id", "fp", "component_id")


# --- groups of similar texts ------------------------------------------------------------

#: Bands of min-hashes and their number in a band: two sets of similarity s share a band with probability 1 - (1 - s^ROWS)^BANDS, 0.9994 at 0.8.
BANDS, ROWS = 40, 8
#: Shingles that so many texts have, or fewer, are rare.
RARE = 16
#: Bytes of text that are compared at a time.
COMPARED_BYTES = 1 << 22
#: Up to so many keys of rows that go are broadcast; more are joined.
MOST_SENT = 1 << 21


def _shingle_sets(col: pa.Array, shingle_words: int):
    """Runs of texts: (first row, the sorted distinct hashes of each text's shingles); fewer words than a shingle has make one."""
    for i, j, buf, off in buffers(col):
        low = LOWER[buf]
        starts, ends, unit = words(low, off)
        roll = Rolling(word_hashes(low, starts, ends), BASES[1])
        size = np.minimum(np.diff(unit), shingle_words)
        out = []
        for a, z, k in zip(unit[:-1].tolist(), unit[1:].tolist(), size.tolist(), strict=True):
            at = np.arange(a, z - k + 1) if k else np.zeros(0, np.int64)
            out.append(np.unique(mix(roll.slices(at, at + k))))
        yield i, out


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """[set, band]: hashes of the bands of each set's min-hashes. An empty set has those of no value."""
    flat = np.concatenate([*sets, np.zeros(0, U)])
    n = np.array([len(x) for x in sets], np.int64)
    full = np.flatnonzero(n)
    starts = (np.cumsum(n) - n)[full]
    odd = mix(np.arange(1, bands * rows + 1, dtype=U) * U(BASES[0])) | U(1)
    out = np.zeros((len(sets), bands), U)
    for band in range(bands):
        total = np.full(len(full), band + 1, U)
        for row in range(rows if len(full) else 0):
            least = np.minimum.reduceat(flat * odd[band * rows + row], starts)
            total = mix(total + least)
        out[full, band] = total
    return out


def _signatures(own: DataFrame, shingle_words: int, bands: int, rows: int) -> DataFrame:
    """(key, n, same, fp, bands): of each text's shingle set the size, the hash, the fingerprint and the bands' hashes."""

    @trimmed

    def of(batches):
        for b in batches:
            for i, sets in _shingle_sets(b.column(1), shingle_words):
                n = np.array([len(x) for x in sets], np.int64)
                same = np.array([x.sum(dtype=U) for x in sets], U)
                flat = np.concatenate([*sets, np.zeros(0, U)])
                fp = _majority(flat, np.concatenate([[0], np.cumsum(n)]))
                hashes = band_hashes(sets, bands, rows)
                every = pa.ListArray.from_arrays(pa.array((np.arange(len(sets) + 1) * bands).astype(np.int32)), signed(hashes.ravel()))
                yield pa.record_batch([b.column(0).slice(i, len(sets)), pa.array(n), signed(mix(same)), signed(fp), every], ["key", "n", "same", "fp", "bands"])

    return own.select("key", "text").mapInArrow(of, "key long, n long, same long, fp long, bands array<long>")


def _similar(pairs: DataFrame, texts: DataFrame, shingle_words: int, least: float, scratch: Scratch) -> DataFrame:
    """The pairs (x, y) whose shingle sets have a Jaccard similarity of `least` or more: exact, on all shingles of both."""

    @trimmed

    def of(batches):
        for b in batches:
            size = sum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(b.column(k)), 0)).astype(np.int64) for k in (2, 3))
            step = np.cumsum(size) // COMPARED_BYTES
            for lo, hi in zip(*(np.searchsorted(step, np.unique(step), side=s) for s in ("left", "right")), strict=True):
                part = b.slice(lo, hi - lo)
                keep = np.zeros(hi - lo, bool)
                each = []
                for k in (0, 1):
                    _, first, at = np.unique(np.asarray(part.column(k)), return_index=True, return_inverse=True)
                    sets = [x for _, some in _shingle_sets(part.column(k + 2).take(pa.array(first)), shingle_words) for x in some]
                    each.append((sets, at))
                (xs, x_at), (ys, y_at) = each
                for r in range(hi - lo):
                    s, t = xs[x_at[r]], ys[y_at[r]]
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    keep[r] = both >= least * (len(s) + len(t) - both)
                yield part.select(["x", "y"]).filter(pa.array(keep))

    side = lambda i, s: texts.select(F.col("key").alias(i), F.col("text").alias(s))
    both = pairs.join(side("x", "s"), "x").join(side("y", "t"), "y").select("x", "y", "s", "t")
    return scratch.table("similar", both.mapInArrow(of, "x long, y long"))


def _shingles(texts: DataFrame, shingle_words: int) -> DataFrame:
    """(x, h): the distinct shingles of each text."""

    @trimmed

    def of(batches):
        for b in batches:
            keys = np.asarray(b.column(0))
            for i, sets in _shingle_sets(b.column(1), shingle_words):
                own = np.repeat(keys[i : i + len(sets)], [len(x) for x in sets])
                yield pa.record_batch([pa.array(own), signed(np.concatenate([*sets, np.zeros(0, U)]))], ["x", "h"])

    return texts.select("key", "text").mapInArrow(of, "x long, h long")


def _small(keys: DataFrame) -> DataFrame:
    """The keys, to be broadcast if they are at most `MOST_SENT`."""
    return F.broadcast(keys) if keys.count() <= MOST_SENT else keys


def _roots(found: list[DataFrame], scratch: Scratch, most: int) -> DataFrame:
    """(key, root) of the components of the pairs found so far."""
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    return scratch.table("roots", components(every.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("key"), "root"), most)


def _between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose sides aren't in one component yet."""
    of = lambda i: roots.select(F.col("key").alias(i), F.col("root").alias(f"of_{i}"))
    open_ = pairs.join(of("x"), "x", "left").join(of("y"), "y", "left")
    return open_.filter(F.coalesce("of_x", "x") != F.coalesce("of_y", "y")).select("x", "y")


def similar_groups(
    docs: DataFrame, shingle_words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS, radius: int = 2
) -> DataFrame:
    """(key, group): texts in a group with others; docs has ids that are distinct for distinct texts.

    Texts are linked if their sets of word shingles have a Jaccard similarity of `least` or more,
    verified on all shingles of both; groups are the components of the links, known by a member.
    Equal sets are one class. Candidates are classes whose SimHash fingerprints differ in at most
    `radius` bits, and those that share a band of min-hashes: at a similarity of 0.8 fingerprints
    of 64 bits differ in about ten, so they alone would find the closest pairs only.

    The head of a bucket is the class that meets most others, over all its buckets: where copies were
    made of one text, that text. A class is first compared with the head that meets most, then with
    the heads of all its buckets and those of like fingerprint, and last with every other of its
    buckets, each time only where the two aren't in one component yet. In the last step shingles that
    at most `RARE` of these texts have are apart: texts that share some are met by them, and of two that share
    none the others bound what can be common, which rules out most pairs of a bucket unseen. What then is
    left grows with the square of a group of texts that share nearly all and yet stay below `least`.
    Texts without words are equal to each other.
    """
    scratch = Scratch(bounded(docs).sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    signed_ = scratch.table("signatures", _signatures(own, shingle_words, bands, rows))
    total = signed_.count()
    classes = scratch.table("classes", signed_.groupBy("same", "n").agg(F.min("key").alias("x"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), total)
    members = scratch.table("members", signed_.select("key", "same", "n").join(classes.select("same", "n", "x"), ["same", "n"]).select("key", "x"), total)
    scratch.drop(signed_)

    nodes = scratch.table("nodes", classes.groupBy("fp").agg(F.min("x").alias("y")), total)
    near = links(nodes.select("fp"), radius)
    of = lambda f, i: nodes.select(F.col("fp").alias(f), F.col("y").alias(i))
    alike = near.join(of("a", "p"), "a").join(of("b", "q"), "b").select(F.greatest("p", "q").alias("x"), F.least("p", "q").alias("y"))
    alike = alike.unionByName(classes.join(nodes, "fp").filter("x != y").select("x", "y"))

    each = classes.filter("n > 0").select("x", "n", F.explode("bands").alias("h"))
    shared = each.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1")
    crowd = scratch.table("crowd", each.join(shared, "h").select("h", "x", "n", "c"))
    met = crowd.groupBy("x").agg(F.sum("c").alias("met"))
    heads = crowd.join(met, "x").groupBy("h").agg(F.max(F.struct("met", (-F.col("x")).alias("least"), "x", "n")).alias("head"))
    headed = crowd.join(heads, "h").select("x", "n", F.col("head.x").alias("y"), F.col("head.n").alias("m"), F.col("head.met").alias("met"))
    fits = F.least("n", "m") >= least * F.greatest("n", "m") - 1e-9  # else the sets can't be similar
    drawn = headed.filter("x != y").filter(fits).groupBy("x", "y").agg(F.max("met").alias("met"))
    drawn = drawn.unionByName(alike.select("x", "y", F.lit(0).cast("long").alias("met")))
    ordered = drawn.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"), "met", F.col("x").alias("own"))
    stars = scratch.table("stars", ordered)
    needed = crowd.select("x").unionByName(stars.select("x")).unionByName(stars.select(F.col("y").alias("x"))).distinct()
    texts = own.join(_small(scratch.table("needed", needed.withColumnRenamed("x", "key"), total)), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    texts = scratch.table("texts", texts)
    scratch.drop(classes, nodes)

    best = stars.groupBy("own").agg(F.max(F.struct("met", "x", "y")).alias("best"))
    first = scratch.table("first", best.select("best.x", "best.y").distinct(), total)
    found = [_similar(first, texts, shingle_words, least, scratch)]
    roots = _roots(found, scratch, total)
    second = scratch.table("second", _between(stars.select("x", "y").distinct().join(first, ["x", "y"], "left_anti"), roots))
    found.append(_similar(second, texts, shingle_words, least, scratch))
    scratch.drop(second, first, roots)
    roots = _roots(found, scratch, total)

    named = crowd.select("h", "x", "n").join(roots.withColumnRenamed("key", "x"), "x", "left").withColumn("root", F.coalesce("root", "x"))
    parted = named.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("h")
    left = scratch.table("open", named.join(parted, "h"))
    shingles = scratch.table("shingles", _shingles(texts.join(left.select(F.col("x").alias("key")).distinct(), "key", "left_semi"), shingle_words))
    held = shingles.groupBy("h").agg(F.count("*").alias("c"))
    rare = scratch.table("rare", shingles.join(held.filter(F.col("c") <= RARE), "h").select("h", "x", "c"))
    count = rare.groupBy("x").agg(F.count("*").alias("rare"), F.count_if(F.col("c") == 1).alias("alone"))
    none = F.lit(0).cast("long")
    each = left.select("x", "n", "root").distinct().join(count, "x", "left")
    each = each.filter(F.col("n") - F.coalesce("alone", none) >= least * F.col("n") - 1e-9).select("x", "n", "root", (F.col("n") - F.coalesce("rare", none)).alias("most"))
    each = scratch.table("each", each, total)
    other = each.select(F.col("x").alias("y"), F.col("n").alias("m"), F.col("root").alias("of"), F.col("most").alias("most_y"))

    def possible(common: Column) -> Column:
        """Whether so many common shingles, at most, can make the sets similar."""
        return common >= least * (F.col("n") + F.col("m") - common) - 1e-9

    rows_ = left.select("h", "x").join(each, "x")
    rest = rows_.join(left.select("h", F.col("x").alias("y")).join(other, "y"), "h")
    rest = rest.filter((F.col("x") > F.col("y")) & (F.col("root") != F.col("of")) & possible(F.least("most", "most_y"))).select("x", "y")
    some = rare.filter("c > 1").select("h", "x").join(each.select("x", "root"), "x")
    met = some.join(some.select("h", F.col("x").alias("y"), F.col("root").alias("of")), "h").filter((F.col("x") > F.col("y")) & (F.col("root") != F.col("of")))
    met = met.groupBy("x", "y").agg(F.count("*").alias("s")).join(each, "x").join(other, "y").filter(possible(F.least("most", "most_y") + F.col("s"))).select("x", "y")
    rest = rest.unionByName(met)
    rest = scratch.table("rest", rest.select("x", "y").distinct().join(stars, ["x", "y"], "left_anti"))
    scratch.drop_all_but(members, texts, rest, *found, roots)
    found.append(_similar(rest, texts, shingle_words, least, scratch))
    scratch.drop(rest, roots, texts)
    roots = _roots(found, scratch, total)

    of_class = members.groupBy("x").agg(F.count("*").alias("c")).join(roots.withColumnRenamed("key", "x"), "x", "left")
    group = F.coalesce("root", "x")
    several = of_class.filter("c > 1 or root is not null").select("x", group.alias("group"))
    out = scratch.table("groups", members.join(several, "x").select("key", "group"), total)
    scratch.drop_all_but(out)
    return out


def one_of_each(docs: DataFrame, shingle_words: int = 5, least: float = 0.8) -> DataFrame:
    """The documents, all columns, of which one of each group of near-duplicates stays: that of the least id.

    A null id comes after all others, and of equal ids the text of the least hash first. Rows that
    repeat an id and a text are one row, whichever. Rows are known by a hash of id and text.
    """
    (key,) = unused(docs.columns, "key")
    raw, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    hashed = F.xxhash64(raw.isNull(), F.coalesce(raw, F.lit(0)), text.isNull(), F.coalesce(text, F.lit("")))
    keyed = docs.withColumn(key, hashed)
    groups = similar_groups(keyed, shingle_words, least, key, "text")
    each = groups.groupBy("key", "group").agg(F.count("*").alias("c"))
    ids = keyed.select(F.col(key).alias("key"), raw.alias("id")).distinct().join(each, "key")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "key", "c")
    stays = ids.groupBy("group").agg(F.min(order).alias("first")).select("group", F.col("first.key").alias("stay"), F.col("first.c").alias("c"))
    gone = cut(each.join(stays.select("group", "stay"), "group").filter("key != stay").select(F.col("key").alias(key)))
    twice = cut(stays.filter("c > 1").select(F.col("stay").alias(key)))
    kept = keyed.join(_small(gone), key, "left_anti")
    if twice.isEmpty():
        return kept.select(docs.columns)
    again = kept.join(_small(twice), key, "left_semi").dropDuplicates([key])
    return kept.join(_small(twice), key, "left_anti").unionByName(again).select(docs.columns)
