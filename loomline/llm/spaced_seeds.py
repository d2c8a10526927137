"""Benchmark decontamination by spaced seeds.

Texts are taken as runs of letters and digits, A-Z in lower case. A seed is a fixed mask of up to
`SPAN` tokens; tokens where it has 0 are ignored, so a hit survives substitutions there. Hashes of
every place of the benchmark under every seed are joined with those of the documents. A hit names
a diagonal, on which a document's tokens face an item's; on it the longest part is taken of which
`MIN_MATCH` of the tokens agree, over the whole length of the item. A document is contaminated by an item
if such a part has at least min(`MIN_OVERLAP`, tokens of the item) tokens. The masks hit every part of
12 tokens or more that agrees so far (a test goes through all patterns), so the result is that of
looking at all diagonals. Items of fewer than `SPAN` tokens are looked up whole, with no token
ignored; items of fewer than `MIN_ITEM` tokens say too little and contaminate nothing.

Documents' hashes are tested in the task against a bitmap of the benchmark's hashes, of a fixed
size whatever the benchmark's; what passes is joined exactly. A larger benchmark makes the bitmap
let more through, and loses nothing. Around its hits a document sends as many tokens as the longest
item has, in either direction. Equal items are one class and equal stretches of documents are
another: each pair of classes is verified once, however many items and documents have it.

Edge cases: null and empty texts have no tokens, so nothing is found in them; null document or
item ids are kept as ids; repeated rows are each found; of ties in length the part with most matches is
reported; an empty benchmark or table gives no rows; other columns are passed over. A document is
held whole in its task, in about 60 bytes for each of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import bounded, buffers, flat, LOWER, mix, Scratch, signed, trimmed, U, word_hashes, words

#: Masks of weight 6, each with its first and last token; items of fewer tokens than SPAN are looked up whole.
SEEDS = ("10110111", "11101000101", "10000101111", "11011000011")
SPAN = 12
MIN_ITEM = 5
MIN_OVERLAP = 13
MIN_MATCH = 0.8
#: Bits of the bitmap.
BITMAP_BITS = 1 << 26

TOKEN_GAP = np.ones(256, bool)
TOKEN_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each text's tokens, and the texts' bounds among them."""
    low = LOWER[buf]
    starts, ends, unit = words(low, off, TOKEN_GAP)
    return word_hashes(low, starts, ends), unit


def _weights(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def seeded(h: np.ndarray, unit: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each seed, the places within a text where it fits and its hashes there."""
    wt = _weights(SPAN)
    out = []
    for k, seed in enumerate(SEEDS):
        n = len(h) - len(seed) + 1
        if n <= 0:
            continue
        fits = np.zeros(n + 1, np.int32)
        lo, hi = unit[:-1], np.maximum(unit[1:] - len(seed) + 1, unit[:-1])
        np.add.at(fits, np.minimum(lo, n), 1)
        np.add.at(fits, np.minimum(hi, n), -1)
        at = np.flatnonzero(np.cumsum(fits[:n]) > 0)
        total = np.full(n, k + 1, U)
        for i, bit in enumerate(seed):
            if bit == "1":
                total += h[i : n + i] * wt[i]
        out.append((at, mix(total[at])))
    return out


def whole_runs(h: np.ndarray, unit: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of all runs of `size` tokens, none ignored."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    text_end = np.repeat(unit[1:], np.diff(unit))
    at = np.flatnonzero(np.arange(n) + size <= text_end[:n])
    wt, total = _weights(size), np.full(n, 1000 + size, U)
    for i in range(size):
        total += h[i : n + i] * wt[i]
    return at, mix(total[at])


def _items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, n, toks, item): the tokens of every item, and a hash of them."""

    @trimmed

    def of(batches):
        for b in batches:
            for i, j, buf, off in buffers(b.column(1)):
                h, unit = tokens(buf, off)
                toks = pa.ListArray.from_arrays(pa.array(unit.astype(np.int32)), signed(h))
                yield pa.record_batch([b.column(0).slice(i, j - i), pa.array(np.diff(unit)), toks], ["item_id", "n", "toks"])

    own = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(of, "item_id long, n long, toks array<long>").filter(F.col("n") >= MIN_ITEM).withColumn("item", F.xxhash64("n", "toks"))


def _benchmark(classes: DataFrame) -> DataFrame:
    """(h, item, at, n): every hash of every class of items, and its place."""

    @trimmed

    def of(batches):
        for b in batches:
            unit, h = flat(b.column(1))
            h, size = h.view(U), np.diff(unit)
            long = np.repeat(size >= SPAN, size)
            found = [(at[ok], x[ok]) for at, x in seeded(h, unit) for ok in (long[at],)]
            for short in range(MIN_ITEM, SPAN):
                for r in np.flatnonzero(size == short):
                    at, x = whole_runs(h[unit[r] : unit[r + 1]], np.array([0, short]), short)
                    found.append((at + unit[r], x))
            for at, x in found:
                row = np.searchsorted(unit, at, side="right") - 1
                yield pa.record_batch([signed(x), b.column(0).take(pa.array(row)), pa.array(at - unit[row]), pa.array(size[row])], ["h", "item", "at", "n"])

    return classes.select("item", "toks").mapInArrow(of, "h long, item long, at long, n long")


def _cells(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return h & U(BITMAP_BITS - 1), (h >> U(32)) & U(BITMAP_BITS - 1)


def _bitmap(bench: DataFrame) -> np.ndarray:
    """Words of 64 bits, of which each hash sets two; at most BITMAP_BITS / 64 rows are collected."""
    first, second = F.col("h").bitwiseAND(BITMAP_BITS - 1), F.shiftrightunsigned("h", 32).bitwiseAND(BITMAP_BITS - 1)
    cell = bench.select(F.explode(F.array(first, second)).alias("c"))
    rows = cell.groupBy((F.col("c") / 64).cast("long").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(c % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(BITMAP_BITS // 64, U)
    out[np.asarray(rows["w"]).astype(np.int64)] = np.asarray(rows["bits"]).view(U)
    return out


def _set(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    a, b = _cells(h)
    ok = (bitmap[(a >> U(6)).astype(np.int64)] >> (a & U(63))) & U(1) > 0
    at = np.flatnonzero(ok)
    ok[at] = (bitmap[(b[at] >> U(6)).astype(np.int64)] >> (b[at] & U(63))) & U(1) > 0
    return ok


def longest(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int]:
    """(tokens, matches) of the longest part of a diagonal of which MIN_MATCH agree; doc[q + shift] faces item[q]."""
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    if hi <= lo:
        return 0, 0
    same = doc[lo + shift : hi + shift] == item[lo:hi]
    count = np.concatenate([[0], np.cumsum(same)])
    total = count - MIN_MATCH / (1 - MIN_MATCH) * (np.arange(len(count)) - count)
    above = np.maximum.accumulate(total[::-1])[::-1]  # falls, so the last end that will do is found by bisection
    end = np.searchsorted(-above, 1e-6 - total, side="right") - 1
    length, match = end - np.arange(len(end)), count[end] - count
    best = np.flatnonzero(length == length.max())
    return int(length.max()), int(match[best].max())


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_overlap, n_match): for each document and item the longest overlap that counts."""
    scratch = Scratch(bounded(docs).sparkSession)
    every = scratch.table("items", _items(items, item_id, item_text))
    classes = scratch.table("classes", every.groupBy("item").agg(F.first("n").alias("n"), F.first("toks").alias("toks")))
    bench = scratch.table("bench", _benchmark(classes))
    reach = int(classes.agg(F.max("n")).first()[0] or 0)
    shorts = sorted(r.n for r in bench.filter(F.col("n") < SPAN).select("n").distinct().collect())
    sent = docs.sparkSession.sparkContext.broadcast(_bitmap(bench))

    @trimmed

    def hits(batches):
        bitmap = sent.value
        for b in batches:
            for i, j, buf, off in buffers(b.column(1)):
                h, unit = tokens(buf, off)
                found = seeded(h, unit) + [whole_runs(h, unit, s) for s in shorts]
                kept = [(at[ok], x[ok]) for at, x in found for ok in (_set(bitmap, x),)]
                at, x = (np.concatenate([k[i] for k in kept]) if kept else np.zeros(0, U) for i in (0, 1))
                at = at.astype(np.int64)
                order = np.argsort(at, kind="stable")
                at, x = at[order], x[order]
                if not len(at):
                    continue
                row = np.searchsorted(unit, at, side="right") - 1
                new = np.ones(len(at), bool)  # a stretch ends where no diagonal of its hits can meet one of the next
                new[1:] = (row[1:] != row[:-1]) | (at[1:] - at[:-1] > SPAN + 2 * reach)
                stretch = np.cumsum(new) - 1
                head = np.flatnonzero(new)
                tail = np.append(head[1:], len(at)) - 1
                a = np.maximum(at[head] - reach, unit[row[head]])
                z = np.minimum(at[tail] + SPAN + reach, unit[row[head] + 1])
                n = z - a
                src = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                toks = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), signed(h[src]))
                pairs = pa.StructArray.from_arrays([signed(x), pa.array(at - a[stretch])], ["h", "at"])
                own = pa.ListArray.from_arrays(pa.array(np.append(head, len(at)).astype(np.int32)), pairs)
                ids = b.column(0).slice(i, j - i).take(pa.array(row[head]))
                yield pa.record_batch([ids, toks, own], ["doc_id", "toks", "hits"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    stretches = own.mapInArrow(hits, "doc_id long, toks array<long>, hits array<struct<h:long,at:long>>")
    stretches = scratch.table("stretches", stretches.withColumn("of", F.xxhash64("toks")))
    each = stretches.select("of", F.explode("hits").alias("hit")).select("of", "hit.h", F.col("hit.at").alias("place")).distinct()
    diagonals = each.join(bench.select("h", "item", "at"), "h").select("of", "item", (F.col("place") - F.col("at")).alias("shift")).distinct()
    one = stretches.groupBy("of").agg(F.first("toks").alias("toks"))
    faced = diagonals.join(one, "of").join(classes.select("item", F.col("toks").alias("facing")), "item")

    @trimmed

    def verified(batches):
        for b in batches:
            (d_at, d), (i_at, t) = flat(b.column("toks")), flat(b.column("facing"))
            shift = np.asarray(b.column("shift")).tolist()
            got = [longest(d[d_at[r] : d_at[r + 1]], t[i_at[r] : i_at[r + 1]], shift[r]) for r in range(b.num_rows)]
            got = np.array(got, np.int64).reshape(b.num_rows, 2)
            out = pa.record_batch([b.column("of"), b.column("item"), pa.array(got[:, 0]), pa.array(got[:, 1])], ["of", "item", "n_overlap", "n_match"])
            yield out.filter(pa.array(got[:, 0] >= np.minimum(MIN_OVERLAP, np.diff(i_at))))

    found = faced.select("of", "item", "shift", "toks", "facing").mapInArrow(verified, "of long, item long, n_overlap long, n_match long")
    best = scratch.table("best", found.groupBy("of", "item").agg(F.max(F.struct("n_overlap", "n_match")).alias("best")))
    pairs = best.join(stretches.select("of", "doc_id").distinct(), "of").join(every.select("item", "item_id").distinct(), "item")
    out = pairs.groupBy("doc_id", "item_id").agg(F.max("best").alias("best")).select("doc_id", "item_id", "best.n_overlap", "best.n_match")
    return out
