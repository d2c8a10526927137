"""Language-model scores by context-tree weighting over bytes.

A text is taken as its bytes with A-Z in lower case, white space and all, closed by an end byte
0xFF, which UTF-8 doesn't have. Each bit of each byte is predicted in the context of the bits before it
in its byte and of the `DEPTH` bytes before that (0xFF before the start). In every context of 0 to
`DEPTH` bytes a Krichevsky-Trofimov estimate is kept; the weighted probability of a context is half
its own estimate and half the product of its longer contexts'. What the trained tree predicts for a
bit is the mixture over all depths that these weights give, so a byte's probability depends on the
gram of DEPTH + 1 bytes that it ends.

Counts: every gram of every training text, and every word, is counted: in each task, then in
Spark. The tree is weighted depth by depth. The grams of one context of DEPTH - 1 bytes, 65,536 at
most, give its nodes; the nodes of a shorter context are sums over its 256 longer ones, down to
two bytes; the contexts of one byte and of none, 65,280 rows at most, are sums of those. The
estimates then go back up the same way, each depth joined with the one before. So no group
is larger than a context's 256 children, each of 255 nodes, however large the corpus.

Scores: a text's score is a sum over its grams. The most frequent grams and words are broadcast,
`HEAD_GRAMS` and `HEAD_WORDS` at most; whatever else a text has is looked up by a join.

Edge cases: a null or empty text is its end alone; a null id is in the fold of the empty text;
repeated rows count each and score alike; with no training texts all estimates are even and N and
V are zero; an empty table gives no rows; other columns are passed over. A text is held whole in
its task, with about 100 bytes for each of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import bounded, buffers, flat, fold_of, LOWER, Scratch, signed, trimmed, U, word_hashes, words

DEPTH = 5
HEAD_GRAMS = 1 << 20
HEAD_WORDS = 1 << 20
HELD_ENTRIES = 1 << 20
GRAM, WORD = 0, 1
#: The end's place among the words' hashes, and among the bytes.
END, END_BYTE = 0x656E64, 0xFF
#: Bytes of the groups of contexts that are weighted at a time.
GROUP_BYTES = 1 << 22


class Table:
    """64-bit keys to numbers, for whole arrays at once: open addressing with linear probing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, (len(keys) * 3 // 2).bit_length())
        size = 1 << self.bits
        self.keys, self.values, self.used = np.zeros(size, U), np.zeros(size), np.zeros(size, bool)
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = left[~self.used[at[left]]]
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.values[at[put]], self.used[at[put]] = keys[put], values[put], True
            done = np.zeros(len(keys), bool)
            done[put] = True
            left = left[~done[left]]
            at[left] = (at[left] + 1) & (size - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and which keys are there."""
        out, found = np.zeros(len(keys)), np.zeros(len(keys), bool)
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            slot = at[left]
            hit = self.used[slot] & (self.keys[slot] == keys[left])
            out[left[hit]], found[left[hit]] = self.values[slot[hit]], True
            left = left[self.used[slot] & ~hit]
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
        return out, found


def lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function, for x of 0.5 or more."""
    small = np.minimum(x, 8.0)
    shift = np.where(x < 8, np.log(small * (small + 1) * (small + 2) * (small + 3) * (small + 4) * (small + 5) * (small + 6) * (small + 7)), 0.0)
    y = np.where(x < 8, x + 8, x)
    inv = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - inv * (1 / 360 - inv * (1 / 1260 - inv / 1680))) / y - shift


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the estimate of a zeros and b ones."""
    return lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1.0) - np.log(np.pi)


def normal(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts as they are modelled, each after DEPTH end bytes; their bounds; word hashes; word bounds."""
    low = LOWER[buf]
    starts, ends, unit = words(low, off)
    n = len(off) - 1
    out = np.full(len(low) + n * (DEPTH + 1), END_BYTE, np.uint8)
    out[np.arange(len(low)) + np.repeat(DEPTH + np.arange(n) * (DEPTH + 1), np.diff(off))] = low
    return out, off + np.arange(n + 1) * (DEPTH + 1), word_hashes(low, starts, ends), unit


def grams(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends at each byte, as a number; and each text's bounds among them."""
    g = np.zeros(max(len(text) - DEPTH, 0), U)
    for k in range(DEPTH + 1):
        g = (g << U(8)) | text[k : len(text) - DEPTH + k]
    owned = np.ones(len(g), bool)
    for k in range(DEPTH):  # those that begin in the text before
        at = bounds[1:-1] - 1 - k
        owned[at[(at >= 0) & (at < len(g))]] = False
    edges = bounds - DEPTH * np.arange(len(bounds))
    return g[owned], edges


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.add.reduceat(n, head) if len(head) else n


def counts(docs: DataFrame) -> DataFrame:
    """(kind, key, n): training counts of all grams and training words of (train boolean, text)."""

    @trimmed

    def of(batches):
        held: dict[int, list] = {GRAM: [], WORD: []}

        def out(kind: int, all_of_it: bool):
            if held[kind]:
                held[kind] = [_summed(held[kind])]
                keys, n = held[kind][0]
                if all_of_it or len(keys) > HELD_ENTRIES // 2:
                    held[kind] = []
                    for a in range(0, len(keys), 1 << 16):
                        k = keys[a : a + (1 << 16)]
                        yield pa.record_batch([pa.array(np.full(len(k), kind, np.int32)), signed(k), pa.array(n[a : a + (1 << 16)])], ["kind", "key", "n"])

        for b in batches:
            train = np.asarray(b.column(0))
            for i, j, buf, off in buffers(b.column(1)):
                text, bounds, h, unit = normal(buf, off)
                g, edges = grams(text, bounds)
                used = train[i:j]
                of_train = np.repeat(used, np.diff(edges))
                for part, one in ((g[of_train], 1), (g[~of_train], 0)):
                    k, n = np.unique(part, return_counts=True)
                    held[GRAM].append((k, n.astype(np.int64) * one))
                k, n = np.unique(h[np.repeat(used, np.diff(unit))], return_counts=True)
                held[WORD].append((k, n.astype(np.int64)))
                if ends := int(used.sum()):
                    held[WORD].append((np.array([END], U), np.array([ends])))
                for kind in (GRAM, WORD):
                    if sum(len(x[0]) for x in held[kind]) > HELD_ENTRIES:
                        yield from out(kind, False)
        for kind in (GRAM, WORD):
            yield from out(kind, True)

    return docs.select("train", "text").mapInArrow(of, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def joined_prob(log_a: np.ndarray, log_b: np.ndarray) -> np.ndarray:
    """log of the mean of two probabilities."""
    return np.logaddexp(log_a, log_b) + np.log(0.5)


def stop_share(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The share of a context's own estimate in its weighted probability."""
    return np.exp(np.log(0.5) + log_kt(a, b) - w)


class Deep:
    """The nodes of the two greatest depths, of grams with whole contexts of DEPTH - 1 bytes."""

    def __init__(self, g: np.ndarray, n: np.ndarray) -> None:
        byte, k = (g & U(255)).astype(np.int64), np.arange(8)
        self.bit = ((byte[:, None] >> (7 - k)) & 1).ravel()
        prefix = ((1 << k) | (byte[:, None] >> (8 - k))).ravel().astype(U)
        weight = np.repeat(n, 8)
        context = g >> U(8)
        self.leaf_keys, self.leaf = np.unique(np.repeat(context, 8) * U(256) + prefix, return_inverse=True)
        self.leaf_a, self.leaf_b = (np.bincount(self.leaf, weight * (self.bit == x), minlength=len(self.leaf_keys)) for x in (0, 1))
        short = self.leaf_keys & U((1 << 8 * DEPTH) - 1)  # the context of a byte less, and the prefix
        self.keys, self.up = np.unique(short, return_inverse=True)
        self.a, self.b, longer = (np.bincount(self.up, x, minlength=len(self.keys)) for x in (self.leaf_a, self.leaf_b, log_kt(self.leaf_a, self.leaf_b)))
        self.w = joined_prob(log_kt(self.a, self.b), longer)
        self.node = self.up[self.leaf]

    def log10(self, zero: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """The log10 probability of each gram's byte, from what its nodes of DEPTH - 1 have of a zero, and what is left for longer contexts."""
        ones = self.bit == 1
        kt = (np.where(ones, self.leaf_b[self.leaf], self.leaf_a[self.leaf]) + 0.5) / (self.leaf_a + self.leaf_b + 1)[self.leaf]
        have = np.where(ones, (1 - rest - zero)[self.node], zero[self.node])
        return np.log10(have + rest[self.node] * kt).reshape(-1, 8).sum(1)


class Top:
    """The contexts of one byte and none, from sums over the contexts of two."""

    def __init__(self, last: np.ndarray, prefix: np.ndarray, a: np.ndarray, b: np.ndarray, longer: np.ndarray) -> None:
        size = 65536
        self.a1, self.b1, w2 = (np.bincount(last * 256 + prefix, x, minlength=size) for x in (a, b, longer))
        w1 = joined_prob(log_kt(self.a1, self.b1), w2)
        self.q1 = stop_share(self.a1, self.b1, w1)
        self.a0, self.b0, w1s = (x.reshape(256, 256).sum(0) for x in (self.a1, self.b1, w1))
        self.q0 = stop_share(self.a0, self.b0, joined_prob(log_kt(self.a0, self.b0), w1s))

    def shares(self, last: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What these contexts give to a zero, and what they leave to longer ones."""
        zero, rest = np.zeros(len(last)), np.ones(len(last))
        for a, b, q, at in ((self.a0, self.b0, self.q0, prefix), (self.a1, self.b1, self.q1, last * 256 + prefix)):
            zero = zero + rest * q[at] * (a[at] + 0.5) / (a[at] + b[at] + 1)
            rest = rest * (1 - q[at])
        return zero, rest


def whole_groups(batches):
    """Batches, sorted by their first column, cut anew so that each has whole groups of it."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size > GROUP_BYTES:
            t = pa.Table.from_batches(held).combine_chunks()
            key = np.asarray(t.column(0).combine_chunks())
            end = int(np.searchsorted(key, key[-1]))
            if end:
                yield t.slice(0, end).combine_chunks().to_batches()[0]
            held, size = t.slice(end).combine_chunks().to_batches(), 0 if end else size
    t = pa.Table.from_batches(held).combine_chunks() if held else None
    if t is not None and t.num_rows:
        yield t.to_batches()[0]


def listed(keys: np.ndarray, *values: np.ndarray) -> tuple[pa.Array, pa.Array, list[pa.Array]]:
    """Nodes, sorted by context * 256 + prefix, as one row a context: the contexts, and lists of prefixes and of each of the values."""
    ctx = keys >> U(8)
    head = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(ctx) else np.zeros(0, np.int64)
    bounds = pa.array(np.append(head, len(ctx)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in ((keys & U(255)).astype(np.int16), *values)]
    return signed(ctx[head]), lists[0], lists[1:]


NODES = "ctx long, prefix array<smallint>, a array<double>, b array<double>, w array<double>"
SHARES = "ctx long, prefix array<smallint>, zero array<double>, rest array<double>"


def _flat_nodes(b: pa.RecordBatch, *names: str) -> tuple[np.ndarray, ...]:
    """The row of each node, its prefix, and the named lists' values."""
    bounds, prefix = flat(b.column("prefix"))
    return np.repeat(np.arange(b.num_rows), np.diff(bounds)), prefix.astype(np.int64), *(flat(b.column(x))[1] for x in names)


def _dealt(df: DataFrame, depth: int) -> DataFrame:
    """The rows, dealt and sorted by their context's last `depth` bytes, which come first as `to`."""
    to = F.col("ctx").bitwiseAND((1 << 8 * depth) - 1)
    return df.select(to.alias("to"), *df.columns).repartition("to").sortWithinPartitions("to")


def _shorter(nodes: DataFrame, depth: int) -> DataFrame:
    """The nodes of the contexts of `depth` bytes, from those of one more."""

    @trimmed

    def of(batches):
        for b in whole_groups(batches):
            row, prefix, a, z, w = _flat_nodes(b, "a", "b", "w")
            keys, at = np.unique(np.asarray(b.column("to")).view(U)[row] * U(256) + prefix.astype(U), return_inverse=True)
            a, z, longer = (np.bincount(at, x, minlength=len(keys)) for x in (a, z, w))
            ctx, prefixes, lists = listed(keys, a, z, joined_prob(log_kt(a, z), longer))
            yield pa.record_batch([ctx, prefixes, *lists], ["ctx", "prefix", "a", "b", "w"])

    return _dealt(nodes.select("ctx", "prefix", "a", "b", "w"), depth).mapInArrow(of, NODES)


def _own_shares(prefix: np.ndarray, row: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, zero: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    q = stop_share(a, b, w)
    return zero + rest * q * (a + 0.5) / (a + b + 1), rest * (1 - q)


def _given(b: pa.RecordBatch, row: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the shorter context of each node's row gives to its prefix, and leaves."""
    bounds, known = flat(b.column("of_prefix"))
    keys = np.repeat(np.arange(b.num_rows), np.diff(bounds)) * 256 + known
    at = np.searchsorted(keys, row * 256 + prefix)
    return flat(b.column("zero"))[1][at], flat(b.column("rest"))[1][at]


def _longer(nodes: DataFrame, shares: DataFrame, depth: int) -> DataFrame:
    """The nodes' rows with what the contexts of a byte less give them; `depth` is that of the nodes."""
    of = shares.select(F.col("ctx").alias("to"), F.col("prefix").alias("of_prefix"), "zero", "rest")
    return nodes.withColumn("to", F.col("ctx").bitwiseAND((1 << 8 * (depth - 1)) - 1)).join(of, "to")


def gram_scores(total: DataFrame, scratch: Scratch) -> DataFrame:
    """(kind, key, n, lp): the gram counts with each gram's log10 probability."""
    most = DEPTH - 1
    ctx = F.shiftright("key", 8).bitwiseAND((1 << 8 * most) - 1)
    grams_of = total.filter(F.col("kind") == GRAM).select(ctx.alias("ctx"), "key", "n")

    @trimmed

    def deepest(batches):
        for b in whole_groups(batches):
            g, n = np.asarray(b.column("key")).view(U), np.asarray(b.column("n"))
            each = np.asarray(b.column("ctx"))
            deep = Deep(g, n)
            ctx, prefixes, lists = listed(deep.keys, deep.a, deep.b, deep.w)
            bounds = pa.array(np.append(np.flatnonzero(np.concatenate([[True], each[1:] != each[:-1]])), len(each)).astype(np.int32))
            yield pa.record_batch([ctx, prefixes, *lists, pa.ListArray.from_arrays(bounds, signed(g)), pa.ListArray.from_arrays(bounds, pa.array(n))], ["ctx", "prefix", "a", "b", "w", "key", "n"])

    levels = {most: scratch.table("nodes", _dealt(grams_of, most).mapInArrow(deepest, NODES + ", key array<long>, n array<long>"))}
    for d in range(most - 1, 1, -1):
        levels[d] = scratch.table("nodes", _shorter(levels[d + 1], d))

    @trimmed

    def sums(batches):
        for b in batches:
            row, prefix, a, z, w = _flat_nodes(b, "a", "b", "w")
            cell, at = np.unique((np.asarray(b.column("ctx"))[row] & 255) * 256 + prefix, return_inverse=True)
            yield pa.record_batch([pa.array(cell), *(pa.array(np.bincount(at, x, minlength=len(cell))) for x in (a, z, w))], ["cell", "a", "b", "w"])

    cells = levels[2].mapInArrow(sums, "cell long, a double, b double, w double").groupBy("cell").agg(F.sum("a"), F.sum("b"), F.sum("w")).collect()
    cell = np.array([r.cell for r in cells], np.int64)
    top = Top(cell >> 8, cell & 255, *(np.array([r[k] for r in cells], float) for k in (1, 2, 3)))

    @trimmed

    def first(batches):
        for b in batches:
            row, prefix, a, z, w = _flat_nodes(b, "a", "b", "w")
            zero, rest = _own_shares(prefix, row, a, z, w, *top.shares(np.asarray(b.column("ctx"))[row] & 255, prefix))
            bounds = pa.array(flat(b.column("prefix"))[0].astype(np.int32))
            yield pa.record_batch([b.column("ctx"), b.column("prefix"), *(pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (zero, rest))], ["ctx", "prefix", "zero", "rest"])

    @trimmed

    def further(batches):
        for b in batches:
            row, prefix, a, z, w = _flat_nodes(b, "a", "b", "w")
            zero, rest = _own_shares(prefix, row, a, z, w, *_given(b, row, prefix))
            bounds = pa.array(flat(b.column("prefix"))[0].astype(np.int32))
            yield pa.record_batch([b.column("ctx"), b.column("prefix"), *(pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (zero, rest))], ["ctx", "prefix", "zero", "rest"])

    @trimmed

    def scored(batches):
        for b in batches:
            row, prefix, a, z, w = _flat_nodes(b, "a", "b", "w")
            zero, rest = _own_shares(prefix, row, a, z, w, *_given(b, row, prefix))
            g, n = flat(b.column("key"))[1].view(U), flat(b.column("n"))[1]
            deep = Deep(g, n)
            order = np.argsort(np.asarray(b.column("ctx")).view(U)[row] * U(256) + prefix.astype(U))
            yield pa.record_batch([pa.array(np.full(len(g), GRAM, np.int32)), signed(g), pa.array(n), pa.array(deep.log10(zero[order], rest[order]))], ["kind", "key", "n", "lp"])

    shares = levels[2].mapInArrow(first, SHARES)
    for d in range(3, most):
        shares = _longer(levels[d], shares, d).mapInArrow(further, SHARES)
    out = scratch.table("scores", _longer(levels[most], shares, most).mapInArrow(scored, "kind int, key long, n long, lp double"))
    scratch.drop(*levels.values())
    return out


def head(rows: DataFrame, most: int) -> DataFrame:
    """The most frequent rows by n, `most` of them at most: all those above a count."""
    level = F.floor(F.log2(F.col("n") + 1) * 8).cast("int")
    sizes = sorted(((r.level, r.m) for r in rows.groupBy(level.alias("level")).agg(F.count("*").alias("m")).collect()), reverse=True)
    total, least = 0, None
    for lv, m in sizes:
        if (total := total + m) > most:
            break
        least = lv
    return rows.filter(level >= least) if least is not None else rows.limit(0)


@dataclass
class Model:
    """What is broadcast: frequent grams' scores, frequent words' counts, N and V."""

    grams: Table
    words: Table
    n: int
    v: int

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.n + 0.1 * (self.v + 1)))


def score(docs: DataFrame, folds: int = 10, id_col: str = "doc_id", text_col: str = "text", head_grams: int = HEAD_GRAMS, head_words: int = HEAD_WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    held_out = fold_of(id_col, folds) == 0
    own = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), text.alias("text"), F.xxhash64(F.col(id_col).cast("long"), text).alias("row"))
    scratch = Scratch(docs.sparkSession)
    total = scratch.table("counts", counts(own.select((~F.col("held_out")).alias("train"), "text")))
    sums = total.filter(F.col("kind") == WORD).agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n, v = int(sums.n or 0), int(sums.v or 0)
    lp = gram_scores(total, scratch)
    vocabulary = total.filter(F.col("kind") == WORD)
    g = head(lp, head_grams).select("key", "lp").toArrow()
    w = head(vocabulary, head_words).select("key", "n").toArrow()
    model = Model(Table(np.asarray(g["key"]).view(U), np.asarray(g["lp"])), Table(np.asarray(w["key"]).view(U), np.asarray(w["n"]).astype(float)), n, v)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @trimmed

    def of(batches):
        m = sent.value
        for b in batches:
            for i, j, buf, off in buffers(b.column(2)):
                body, bounds, h, unit = normal(buf, off)
                g, edges = grams(body, bounds)
                lps, there = m.grams.get(g)
                size = j - i
                gs = np.add.reduceat(lps, edges[:-1])
                row = np.repeat(np.arange(size), np.diff(edges))
                h = np.insert(h, unit[1:], U(END))  # each text's end after its words
                unit = unit + np.arange(size + 1)
                c, known = m.words.get(h)
                wrow = np.repeat(np.arange(size), np.diff(unit))
                base = np.bincount(wrow, np.where(known, m.base(c), 0), minlength=size)
                tails = []
                for kind, keys, rows in ((GRAM, g[~there], row[~there]), (WORD, h[~known], wrow[~known])):
                    order = np.lexsort((keys, rows))
                    keys, rows = keys[order], rows[order]
                    new = np.ones(len(keys), bool)
                    new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
                    at = np.flatnonzero(new)
                    tails.append((rows[at], np.full(len(at), kind, np.int32), keys[at], np.diff(np.append(at, len(keys)))))
                rows, kinds, keys, times = (np.concatenate(x) for x in zip(*tails, strict=True))
                order = np.argsort(rows, kind="stable")
                tail = pa.StructArray.from_arrays([pa.array(kinds[order]), signed(keys[order]), pa.array(times[order].astype(np.int64))], ["kind", "key", "times"])
                yield pa.record_batch(
                    [
                        *(b.column(k).slice(i, size) for k in (0, 1, 3)),
                        pa.array(np.diff(unit)),
                        pa.array(np.bincount(wrow, known & (c > 0), minlength=size).astype(np.int64)),
                        pa.array(base),
                        pa.array(gs),
                        pa.array(np.diff(edges)),
                        pa.ListArray.from_arrays(pa.array(np.searchsorted(rows[order], np.arange(size + 1)).astype(np.int32)), tail),
                    ],
                    ["doc_id", "held_out", "row", "n_tokens", "n_known", "base_score", "score", "n_bytes", "tail"],
                )

    kinds = "doc_id long, held_out boolean, row long, n_tokens long, n_known long, base_score double, score double, n_bytes long, tail array<struct<kind:int,key:long,times:long>>"
    part = scratch.table("texts", own.select("doc_id", "held_out", "text", "row").mapInArrow(of, kinds))
    # Equal rows have equal tails: their sums are divided by the number of such rows.
    same = part.groupBy("row").agg(F.count("*").alias("copies"))
    rest = part.select("row", F.explode("tail").alias("t")).select("row", "t.*")
    known = lp.select("kind", "key", "lp", F.lit(None).cast("long").alias("n")).unionByName(vocabulary.select("kind", "key", F.lit(None).cast("double").alias("lp"), "n"))
    c = F.coalesce("n", F.lit(0))
    unit = F.log10((c + 0.1) / F.lit(n + 0.1 * (v + 1)))
    word = F.col("kind") == WORD
    found = rest.join(known, ["kind", "key"], "left").groupBy("row").agg(
        F.sum(F.when(word & (c > 0), F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.when(word, unit * F.col("times")).otherwise(0.0)).alias("more_base"),
        F.sum(F.when(~word, F.col("lp") * F.col("times")).otherwise(0.0)).alias("more_score"),
    )
    found = found.join(same, "row")
    more = lambda name: F.coalesce(F.col(f"more_{name}") / F.col("copies"), F.lit(0.0))
    out = part.drop("tail").join(found, "row", "left")
    total_score = F.col("score") + more("score")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + more("known")).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") + more("base")).alias("base_score"), total_score.alias("score"), "n_bytes", (-total_score * F.lit(np.log2(10).item()) / F.col("n_bytes")).alias("bits_per_byte"),
    )
