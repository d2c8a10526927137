"""Quality classifier: a factorisation machine over words, structure and metadata.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), where the pairwise sum is taken
in linear time as half of |sum v_i x_i|^2 - sum |v_i|^2 x_i^2. Features of a text: its words,
hashed to `BUCKETS` columns and weighted by 1 + log(count) at unit length; statistics of its
structure; and its length, its only metadata. Labels, lang, source and id are never inputs.

The machine is fitted on the driver to at most `SAMPLE` labelled rows, those with the least
hashes of their id; their features, not their texts, come to the driver. Scoring covers all rows
in one pass without a shuffle.

Edge cases: a null or empty text is scored by its statistics, all zero; without labels of both
kinds every score is the share of good labels, or 0.5; null ids are kept; repeated rows score
alike; an empty table gives no rows; other columns are passed over.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import bounded, buffers, fold_of, LOWER, trimmed, U, word_hashes, words

BUCKETS = 1 << 12
FACTORS = 8
SAMPLE = 8_000

#: The statistics, in order.
STATS = (
    "log_words", "log_bytes", "mean_word", "upper", "digit", "symbol", "punctuation", "non_ascii",
    "lines_per_word", "distinct_words", "top_word", "repeated_lines", "no_text",
)

_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[ord(c) for c in "#*$%&|<>=+~^_\\{}[]"]] = 3
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 4
_CLASS[128:] = 5
_CLASS[10] = 6


@dataclass
class Features:
    """Sparse rows: bounds, columns and values; and dense statistics."""

    bounds: np.ndarray
    cols: np.ndarray
    vals: np.ndarray
    stats: np.ndarray


def features(buf: np.ndarray, off: np.ndarray) -> Features:
    """Features of the texts between the offsets."""
    n = len(off) - 1
    starts, ends, unit = words(buf, off)
    h = word_hashes(LOWER[buf], starts, ends)
    n_words, n_bytes = np.diff(unit), np.diff(off)
    row = np.repeat(np.arange(n), n_words)
    key, count = np.unique(row.astype(U) * U(BUCKETS) + (h >> U(20)) % U(BUCKETS), return_counts=True)
    owner, cols = (key // U(BUCKETS)).astype(np.int64), (key % U(BUCKETS)).astype(np.int32)
    vals = 1 + np.log(count)
    norm = np.sqrt(np.bincount(owner, vals * vals, minlength=n))
    vals = (vals / norm[owner]).astype(np.float32)
    bounds = np.searchsorted(owner, np.arange(n + 1))
    kinds = np.stack([np.concatenate([[0], np.cumsum(_CLASS[buf] == k)]) for k in range(1, 7)])
    per = (kinds[:, off[1:]] - kinds[:, off[:-1]]).astype(float)
    share = per / np.maximum(n_bytes, 1)
    order = np.lexsort((h, row))
    same = np.zeros(len(h), bool)
    if len(h) > 1:
        same[1:] = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
    distinct = n_words - np.bincount(row[order][same], minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, owner, count)
    lines = buf.copy()
    gap = np.zeros(256, bool)
    gap[10] = True
    ls, le, lu = words(lines, off, gap)
    lh = word_hashes(lines, ls, le)
    lrow = np.repeat(np.arange(n), np.diff(lu))
    lo = np.lexsort((lh, lrow))
    again = np.zeros(len(lh), bool)
    if len(lh) > 1:
        again[1:] = (lh[lo][1:] == lh[lo][:-1]) & (lrow[lo][1:] == lrow[lo][:-1])
    rep = np.bincount(lrow[lo][again], minlength=n) / np.maximum(np.diff(lu), 1)
    size = np.bincount(row, ends - starts, minlength=n)
    w = np.maximum(n_words, 1)
    stats = np.stack(
        [
            np.log1p(n_words), np.log1p(n_bytes), size / w, share[0], share[1], share[2], share[3], share[4],
            np.minimum(per[5] / w, 4), distinct / w, top / w, rep, n_words == 0,
        ],
        axis=1,
    )
    return Features(bounds, cols, vals, stats.astype(np.float32))


@dataclass
class Machine:
    """w0, the linear weights and the factors of hashed words and standardised statistics."""

    mean: np.ndarray
    spread: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def scaled(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.spread, -4, 4).astype(np.float32)

    def rows(self, f: Features, at: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owner, column, value) of every nonzero of the chosen rows."""
        pick = np.arange(len(f.bounds) - 1)[at]
        n = np.diff(f.bounds)[pick]
        own = np.repeat(np.arange(len(pick)), n)
        src = np.repeat(f.bounds[:-1][pick], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        s = self.scaled(f.stats[pick])
        k = s.shape[1]
        owner = np.concatenate([own, np.repeat(np.arange(len(pick)), k)])
        col = np.concatenate([f.cols[src], np.tile(BUCKETS + np.arange(k), len(pick))])
        return owner, col, np.concatenate([f.vals[src], 0.3 * s.ravel()])

    def forward(self, owner: np.ndarray, col: np.ndarray, val: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Raw scores, and the sums of factors that the gradient needs."""
        linear = np.bincount(owner, self.w[col] * val, minlength=n)
        vx = self.v[col] * val[:, None]
        sums = np.stack([np.bincount(owner, vx[:, k], minlength=n) for k in range(vx.shape[1])], 1)
        squares = np.bincount(owner, (vx * vx).sum(1), minlength=n)
        return self.w0 + linear + 0.5 * ((sums * sums).sum(1) - squares), sums

    def score(self, f: Features) -> np.ndarray:
        z, _ = self.forward(*self.rows(f), len(f.bounds) - 1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(f: Features, good: np.ndarray, least_steps: int = 400, batch: int = 256, rate: float = 0.01, decay: float = 1e-4) -> Machine:
    """Adam on the log loss, over all rows until there were `least_steps` steps; the same rows in the same order give the same machine."""
    rng = np.random.default_rng(7)
    n, size = len(good), BUCKETS + len(STATS)
    share = float(good.mean()) if n else 0.5
    m = Machine(f.stats.mean(0) if n else np.zeros(len(STATS)), f.stats.std(0) + 1e-3 if n else np.ones(len(STATS)), 0.0, np.zeros(size), np.zeros((size, FACTORS)))
    if n == 0 or share in (0.0, 1.0):
        edge = min(max(share, 1e-3), 1 - 1e-3)
        m.w0 = float(np.log(edge / (1 - edge)))
        return m
    m.w0 = float(np.log(share / (1 - share)))
    m.v = rng.normal(0, 0.01, (size, FACTORS))
    step = 0
    first, second = ([np.zeros_like(x) for x in (np.zeros(1), m.w, m.v)] for _ in range(2))
    for _ in range(-(-least_steps * batch // max(n, batch))):
        order = rng.permutation(n)
        for a in range(0, n, batch):
            at = order[a : a + batch]
            owner, col, val = m.rows(f, at)
            z, sums = m.forward(owner, col, val, len(at))
            err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - good[at]
            e = err[owner] / len(at)
            gw = np.bincount(col, e * val, minlength=size) + decay * m.w
            gv = np.zeros_like(m.v)
            for k in range(FACTORS):
                g = e * val * (sums[owner, k] - m.v[col, k] * val)
                gv[:, k] = np.bincount(col, g, minlength=size)
            gv += decay * m.v
            step += 1
            for i, (x, g) in enumerate(((None, np.array([err.mean()])), (m.w, gw), (m.v, gv))):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                move = rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
                if x is None:
                    m.w0 -= float(move[0])
                else:
                    x -= move
    return m


def _sample(labels: DataFrame, column: str, sample: int, folds: int) -> DataFrame:
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    return (
        rows.groupBy("doc_id").agg((F.avg(column) >= 0.5).cast("double").alias("good"))
        .filter(fold_of("doc_id", folds) != 0)
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )


def learn(docs: DataFrame, labels: DataFrame, column: str = "quality", sample: int = SAMPLE, folds: int = 5) -> Machine:
    """A machine fitted to a bounded sample of the labelled rows whose fold isn't 0."""
    chosen = _sample(labels, column, sample, folds)

    @trimmed

    def of(batches):
        for b in batches:
            for i, j, buf, off in buffers(b.column(2)):
                f = features(buf, off)
                yield pa.record_batch(
                    [
                        b.column(0).slice(i, j - i),
                        b.column(1).slice(i, j - i),
                        pa.ListArray.from_arrays(pa.array(f.bounds.astype(np.int32)), pa.array(f.cols)),
                        pa.ListArray.from_arrays(pa.array(f.bounds.astype(np.int32)), pa.array(f.vals)),
                        pa.FixedSizeListArray.from_arrays(pa.array(f.stats.ravel()), len(STATS)).cast(pa.list_(pa.float32())),
                    ],
                    ["doc_id", "good", "cols", "vals", "stats"],
                )

    own = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = own.join(F.broadcast(chosen), "doc_id").select("doc_id", "good", "text")
    got = rows.mapInArrow(of, "doc_id long, good double, cols array<int>, vals array<float>, stats array<float>").toArrow().sort_by("doc_id")
    if got.num_rows == 0:
        return fit(Features(np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros((0, len(STATS)), np.float32)), np.zeros(0))
    cols = got["cols"].combine_chunks()
    n = np.asarray(pa.compute.list_value_length(cols)).astype(np.int64)
    f = Features(
        np.concatenate([[0], np.cumsum(n)]), np.asarray(cols.flatten()), np.asarray(got["vals"].combine_chunks().flatten()),
        np.asarray(got["stats"].combine_chunks().flatten()).reshape(-1, len(STATS)),
    )
    return fit(f, np.asarray(got["good"]))


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every text."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    @trimmed

    def of(batches):
        m = sent.value
        for b in batches:
            for i, j, buf, off in buffers(b.column(1)):
                yield pa.record_batch([b.column(0).slice(i, j - i), pa.array(m.score(features(buf, off)))], ["doc_id", "score"])

    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(of, "doc_id long, score double")


def keep(docs: DataFrame, machine: Machine, least: float) -> DataFrame:
    """The documents, all columns, whose text scores `least` or more."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index("text")

    @trimmed

    def of(batches):
        m = sent.value
        for b in batches:
            for i, j, buf, off in buffers(b.column(at)):
                yield b.slice(i, j - i).filter(pa.array(m.score(features(buf, off)) >= least))

    return bounded(docs).mapInArrow(of, docs.schema)
