"""Roll-ups over grouping sets: audits, validation summaries, rollouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def records(samples: DataFrame, keys: tuple[str, ...], tol: float = 1e-9, min_std: float = 0.05) -> DataFrame:
    """One record a task from its samples (reward, success): mean, population std, success rate, flatness."""
    g = samples.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg("reward").alias("mean"),
        F.coalesce(F.stddev_pop("reward"), F.lit(0.0)).alias("std"),
        F.avg(F.col("success").cast("int")).alias("success_rate"),
        F.min("reward").alias("lo"),
        F.max("reward").alias("hi"),
        F.bool_and("success").alias("all_ok"),
        F.bool_or("success").alias("any_ok"),
        F.count_distinct("reward").alias("n_distinct"),
    )
    return g.withColumns({"effective": F.col("std") >= min_std - tol, "flat": F.col("n_distinct") == 1})


def _summary() -> list[Column]:
    share = lambda c: F.avg(F.col(c).cast("int"))
    return [
        F.count("*").alias("tasks"),
        F.round(F.avg("mean"), 6).alias("mean"),
        F.round(F.avg("success_rate"), 6).alias("success"),
        F.round(share("effective"), 6).alias("effective"),
        F.round(share("flat"), 6).alias("flat"),
    ]


def audit(recs: DataFrame) -> DataFrame:
    """Overall, by template, and by (template, knob, value) of the open map `difficulty`.

    The first two are taken before the map is exploded, so a task counts once in them. Knobs of
    floating value aren't rolled up.
    """
    plain = recs.rollup("template").agg(*_summary()).select(F.lit(None).cast("string").alias("knob"), F.lit(None).cast("string").alias("value"), "*")
    knobs = recs.select("*", F.explode("difficulty").alias("knob", "value")).filter(~F.col("value").rlike(r"^-?\d+\.\d*$"))
    return plain.unionByName(knobs.groupBy("template", "knob", "value").agg(*_summary()))


def validation(rows: DataFrame) -> DataFrame:
    """Overall and by template, null rewards passed over."""
    return rows.filter("reward is not null").rollup("template").agg(F.count("*").alias("n"), F.round(F.avg("reward"), 6).alias("mean"), F.round(F.avg(F.col("success").cast("int")), 6).alias("success"))


def rollout(rows: DataFrame, group_size: int, tol: float = 1e-9) -> DataFrame:
    """Groups that are flat and complete, and the share of those judged."""
    g = rows.groupBy("task_id").agg(F.count("*").alias("n"), F.count("reward").alias("judged"), F.max("reward").alias("hi"), F.min("reward").alias("lo"))
    complete = (F.col("n") == group_size) & (F.col("judged") == F.col("n"))
    return g.agg(
        F.count("*").alias("groups"),
        F.count_if(complete).alias("complete"),
        F.count_if(complete & (F.col("hi") - F.col("lo") <= tol)).alias("flat"),
        F.sum("n").alias("episodes"),
    )


def trajectory(turns: DataFrame) -> DataFrame:
    """Mean and least score over an episode's turns; 0 for none."""
    return turns.groupBy("episode_id").agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean"), F.coalesce(F.min("score"), F.lit(0.0)).alias("least"))
