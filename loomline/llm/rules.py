"""Quality rules as a learned decision list.

The list is learned by sequential covering from labelled statistics. A rule is a conjunction of
threshold tests; it is grown test by test for the largest information gain over two thirds of
the examples not yet covered, then pruned on the other third, and kept while it is precise there.
The ordered rules become one Spark conditional expression. Scoring is native throughout.

Learning uses a sample of at most `SAMPLE` labelled rows, those with the least hashes of their
id; everything else covers all rows.

Edge cases: null and empty texts have all statistics zero and fail the base rule; with no
labelled rows, or labels of one kind, the list is empty and only the base rule decides; null ids
are kept; repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm import text_stats as ts
from loomline.llm.common import fold_of

SAMPLE = 20_000

#: Statistics that the learned tests may use, by expressions over those of `statistics`.
RATIOS: dict[str, str] = {
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "stop_share": "n_ends / greatest(n_words, 1)",
    "n_words": "cast(n_words as double)",
}


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts for each text, by built-in functions in one pass and without a shuffle."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    s = ts.let(
        ts.words(F.col("text")),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            ts.repeat_words(w).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        ),
    )
    count = lambda rx: F.regexp_count("text", F.lit(rx)).cast("long")
    out = base.select(
        "doc_id",
        s.alias("s"),
        count(ts.SYMBOLS).alias("n_symbols"),
        ts.duplicate_lines(F.col("text")).alias("n_dup_lines"),
        (count("\n") + 1).alias("n_lines"),
        count("[A-Z]").alias("n_upper"),
        count("[0-9]").alias("n_digits"),
        count("[.!?]").alias("n_ends"),
    )
    names = ("n_symbols", "n_dup_lines", "n_lines", "n_upper", "n_digits", "n_ends")
    return out.select("doc_id", "s.n_words", "s.word_chars", "s.n_repeat_words", "s.n_distinct", *names)


@dataclass(frozen=True)
class Test:
    name: str
    least: bool  # value >= bound, else value <= bound
    bound: float

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.least else '<='} {self.bound!r}"

    def of(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        v = x[:, names.index(self.name)]
        return v >= self.bound if self.least else v <= self.bound


Rule = tuple[Test, ...]


def _covers(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for t in rule:
        out &= t.of(x, names)
    return out


def _grow(x: np.ndarray, bad: np.ndarray, names: list[str], longest: int) -> Rule:
    rule: list[Test] = []
    on = np.ones(len(x), bool)
    while len(rule) < longest and bad[on].any() and not bad[on].all():
        p0, n0 = bad[on].sum(), on.sum()
        best, gain = None, 1e-9
        for k, name in enumerate(names):
            v = x[on, k]
            cuts = np.unique(np.quantile(v, np.linspace(0.005, 0.995, 67)))
            for least in (True, False):
                hit = v[:, None] >= cuts if least else v[:, None] <= cuts
                p, n = (hit & bad[on, None]).sum(0), hit.sum(0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(p > 0, p * (np.log2(p / np.maximum(n, 1)) - np.log2(p0 / n0)), 0)
                if g.max() > gain:
                    gain, best = g.max(), Test(name, least, round(float(cuts[g.argmax()]), 6))
        if best is None:
            break
        rule.append(best)
        on &= best.of(x, names)
    return tuple(rule)


def _worth(rule: Rule, x: np.ndarray, bad: np.ndarray, names: list[str]) -> float:
    on = _covers(rule, x, names)
    p, n = int(bad[on].sum()), int(on.sum())
    return (2 * p - n) / n if n else -1.0


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], precision: float = 0.9, most_rules: int = 12, longest: int = 4) -> list[Rule]:
    """Ordered rules that pick out the bad rows; the third of the rows for pruning is every third."""
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    third = np.arange(len(x)) % 3 == 2
    while len(rules) < most_rules and (bad & left & ~third).sum() >= 5:
        grow, prune = left & ~third, left & third
        rule = _grow(x[grow], bad[grow], names, longest)
        if not rule:
            break
        worth = _worth(rule, x[prune], bad[prune], names)
        while len(rule) > 1:
            shorter = max((rule[:k] + rule[k + 1 :] for k in range(len(rule))), key=lambda r: _worth(r, x[prune], bad[prune], names))
            if (w := _worth(shorter, x[prune], bad[prune], names)) < worth:
                break
            rule, worth = shorter, w
        on = _covers(rule, x, names) & left
        if not on.any() or bad[on].mean() < precision or (worth + 1) / 2 < precision - 0.1:
            break
        rules.append(rule)
        left &= ~on
    return rules


def expression(rules: list[Rule]) -> Column:
    """kept: the ordered rules as one conditional expression over the ratios' names."""
    out = F.lit(True)
    for rule in reversed(rules):
        test = F.expr(" and ".join(f"({RATIOS[t.name]}) {'>=' if t.least else '<='} {t.bound:.6f}d" for t in rule))
        out = F.when(test, F.lit(False)).otherwise(out)
    return out


def examples(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = 5) -> DataFrame:
    """(doc_id, good): at most `sample` labelled rows outside fold 0, by the hash of their id."""
    good = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("good"))
    return good.filter(fold_of("doc_id", folds) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def learn_from(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """A list learned from the statistics of a bounded sample; the sample's ids are broadcast."""
    ids = examples(docs, labels, sample)
    own = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    rows = statistics(own).join(F.broadcast(ids), "doc_id").select("doc_id", "good", *(F.expr(e).alias(n) for n, e in RATIOS.items()))
    rows = sorted(map(tuple, rows.collect()))
    if not rows:
        return []
    x, bad = np.array([r[2:] for r in rows], float), np.array([not r[1] for r in rows])
    order = np.random.default_rng(0).permutation(len(x))
    return learn(x[order], bad[order], list(RATIOS))


def judge(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The statistics of every text with base_failed and kept."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return statistics(docs, id_col, text_col).withColumn("base_failed", failed).withColumn("kept", ~failed & expression(rules))
