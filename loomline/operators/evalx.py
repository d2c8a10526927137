"""Evaluation analytics: pass^k, run summaries, paired comparisons, bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pass_hat(trials: DataFrame) -> DataFrame:
    """(k, pass_k): the mean over tasks of C(c, k) / C(n, k), for k up to the fewest trials of a task."""
    c = trials.groupBy("task_id").agg(F.count("*").alias("n"), F.count_if("success").alias("c"))
    least = c.agg(F.min("n").alias("least"))
    ks = c.join(F.broadcast(least), how="cross").select("n", "c", F.explode(F.sequence(F.lit(1), F.col("least").cast("int"))).alias("k"))
    falling = F.aggregate(F.sequence(F.lit(0), F.col("k") - 1), F.lit(1.0), lambda a, i: a * (F.col("c") - i) / (F.col("n") - i))
    return ks.groupBy(F.col("k").cast("long").alias("k")).agg(F.round(F.avg(F.when(F.col("c") < F.col("k"), 0.0).otherwise(falling)), 4).alias("pass_k"))


def run_summary(sims: DataFrame) -> DataFrame:
    """Overall and by termination: how many, tokens, and minutes from first to last."""
    secs = lambda c: F.unix_timestamp(c)
    return sims.rollup("termination").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("tokens"), F.round((secs(F.max("ts")) - secs(F.min("ts"))) / 60, 4).alias("minutes")
    )


def paired(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many tasks gained, lost or kept their rate; a task of one run only counts in none."""
    both = before.withColumnRenamed("rate", "a").join(after.withColumnRenamed("rate", "b"), "task_id", "full_outer")
    return both.agg(F.count_if(F.expr("b > a")).alias("gained"), F.count_if(F.expr("b < a")).alias("lost"), F.count_if(F.expr("b = a")).alias("same"))


def bootstrap(before: DataFrame, after: DataFrame, rounds: int = 1000, seed: int = 0) -> DataFrame:
    """(low, high): the 95 % interval of the mean difference, tasks redrawn by Poisson weights from hashes."""
    both = before.withColumnRenamed("rate", "a").join(after.withColumnRenamed("rate", "b"), "task_id").select("task_id", (F.col("b") - F.col("a")).alias("diff"))
    draws = both.select("task_id", "diff", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    u = F.pmod(F.xxhash64(F.lit(seed), "round", "task_id"), F.lit(1 << 30)) / float(1 << 30)
    weight = sum((F.when(u >= edge, 1).otherwise(0) for edge in (0.367879, 0.735759, 0.919699, 0.981012, 0.996340, 0.999406)), F.lit(0))
    means = draws.groupBy("round").agg((F.sum(F.col("diff") * weight) / F.nullif(F.sum(weight), F.lit(0))).alias("m"))
    return means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
