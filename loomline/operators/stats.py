"""Statistics of score groups and cells, in two-level aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomline.functions import predicates as P


def r6(x: Column) -> Column:
    return F.round(x, 6)


def group_stats(scores: DataFrame, keys: tuple[str, ...] = ("scenario_id", "category", "theme"), min_std: float = P.EFFECTIVE_MIN_STD) -> DataFrame:
    """One row a group: size, moments, range, first score, and what they say of the group."""
    g = scores.groupBy(*keys).agg(
        F.count("score").alias("n"),
        F.sum("score").alias("total"),
        F.avg("score").alias("mean"),
        F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("std"),
        F.coalesce(F.stddev_pop("score"), F.lit(0.0)).alias("std_pop"),
        F.min("score").alias("lo"),
        F.max("score").alias("hi"),
        F.min_by("score", "sample").alias("first_score"),
        F.count_distinct(F.round("score", 3)).alias("n_distinct"),
    )
    return g.withColumns(
        {
            "effective": P.effective(F.col("std"), min_std),
            "solved": (F.col("n") > 0) & P.solved(F.col("mean"), min_std),
            "any_variance": F.col("n_distinct") > 1,
            "class": P.group_class(F.col("n"), F.col("lo"), F.col("hi"), F.col("first_score")),
        }
    )


def lacks_gradient(stats: DataFrame, include_solved: bool = False) -> DataFrame:
    """Groups that teach nothing: not effective, and unless asked for not solved."""
    return stats.filter(~F.col("effective") & (F.lit(include_solved) | ~F.col("solved")))


def bucket_label() -> Column:
    """The class, with the score's value where a group is stuck at one."""
    stuck = F.concat(F.lit("stuck_partial ("), F.round("first_score", 2).cast("string"), F.lit(")"))
    return F.when(F.col("class") == "stuck_partial", stuck).otherwise(F.col("class"))


def cells(stats: DataFrame) -> DataFrame:
    """The scorecard: each cell's yield, headroom and signal; means are over all samples."""
    c = stats.groupBy("category", "theme").agg(
        F.count("*").alias("n"),
        (F.sum("total") / F.sum("n")).alias("mean"),
        F.count_if(F.col("class") == "usable").alias("usable"),
        F.count_if(F.col("class") == "cold_start").alias("cold_start"),
        F.count_if(F.col("class") == "already_solved").alias("already_solved"),
        F.count_if(F.col("class") == "stuck_partial").alias("stuck_partial"),
        F.count_if("effective").alias("n_effective"),
    )
    return c.withColumns(
        {"yield": F.col("n_effective") / F.col("n"), "any_yield": F.col("usable") / F.col("n"), "headroom": F.greatest(F.lit(0.0), 1 - F.col("mean"))}
    ).withColumns({"signal": F.col("yield") * F.col("headroom"), "low_yield": F.col("yield") < P.LOW_YIELD})


def category_signal(cards: DataFrame) -> DataFrame:
    return cards.groupBy("category").agg((F.sum(F.col("signal") * F.col("n")) / F.sum("n")).alias("signal"))


def recommend_mix(signal: DataFrame, relevance: dict[str, float], floor: float = P.MIX_FLOOR) -> DataFrame:
    """Shares by signal times relevance, floored and normalised again; by relevance alone where nothing has signal.

    There are as many rows as categories, so the windows over all rows are small.
    """
    every = W.partitionBy()
    rel = F.create_map(*(F.lit(x) for kv in relevance.items() for x in kv))[F.col("category")]
    m = signal.withColumn("rel", F.coalesce(rel, F.lit(0.0))).withColumn("raw", F.col("signal") * F.col("rel"))
    m = m.withColumns({"total": F.sum("raw").over(every), "rel_total": F.sum("rel").over(every)})
    m = m.withColumn("floored", F.greatest(F.col("raw") / F.nullif("total", F.lit(0.0)), F.lit(floor)))
    share = F.round(F.col("floored") / F.sum("floored").over(every), 4)
    return m.select("category", F.when(F.col("total") <= 0, F.col("rel") / F.col("rel_total")).otherwise(share).alias("share"))


def variance_summary(stats: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    s = stats.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(~F.col("any_variance")).alias("zero"), F.count_if("effective").alias("effective"))
    ratio = lambda c: F.coalesce(F.col(c) / F.nullif("n", F.lit(0)), F.lit(0.0))
    return s.withColumn("micro", F.col("n") - F.col("zero") - F.col("effective")).withColumns({"zero_share": ratio("zero"), "effective_share": ratio("effective")})


def histogram(scores: DataFrame) -> DataFrame:
    return scores.groupBy(F.round("score", 1).alias("bucket")).agg(F.count("*").alias("n"))


def advantages(rewards: DataFrame, tol: float = P.PREFILTER_TOL) -> DataFrame:
    """Rewards less their group's mean, and a mask that is off for flat, complete groups."""
    g = W.partitionBy("task_id")
    flat = (F.max("reward").over(g) - F.min("reward").over(g) <= tol) & (F.count("reward").over(g) == F.count("*").over(g))
    return rewards.withColumns({"advantage": F.col("reward") - F.avg("reward").over(g), "mask": F.when(flat, 0).otherwise(1)})


def moving_average(series: DataFrame, order: str, value: str, width: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    w = W.partitionBy(*by).orderBy(order).rowsBetween(-(width - 1), 0)
    return series.withColumn("smoothed", F.avg(value).over(w))
