"""Task supply and grading over turns: grids, funnels, plans, length checks, masks, trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: The scenario grid.
CATEGORIES = ("happy_path", "context", "policy", "ambiguous", "out_of_scope")


def grid(spark: SparkSession, themes: tuple[str, ...]) -> DataFrame:
    """(category, theme, cell) in fixed order."""
    c = spark.range(1).select(F.posexplode(F.array(*map(F.lit, CATEGORIES))).alias("i", "category"))
    t = spark.range(1).select(F.posexplode(F.array(*map(F.lit, themes))).alias("j", "theme"))
    return c.join(F.broadcast(t), how="cross").select((F.col("i") * len(themes) + F.col("j")).alias("place"), "category", "theme", F.concat_ws("__", "category", "theme").alias("cell"))


def funnel(attempts: DataFrame) -> DataFrame:
    """By template: where attempts end. Reasons are tried in this order, and the first counts."""
    reason = (
        F.when(~F.col("candidate"), "no_candidate")
        .when(F.col("duplicate"), "duplicate")
        .when(F.col("held_out_user"), "decontam_user")
        .when(~F.col("verified"), "verify_failed")
        .when(F.col("held_out_hash"), "decontam_gold_hash")
        .otherwise("accepted")
    )
    kinds = ("no_candidate", "duplicate", "decontam_user", "verify_failed", "decontam_gold_hash", "accepted")
    return attempts.withColumn("reason", reason).groupBy("template").agg(F.count("*").alias("attempts"), *(F.count_if(F.col("reason") == k).alias(k) for k in kinds))


def cancel_candidates(orders: DataFrame, hints: DataFrame) -> DataFrame:
    """Pending orders that a product tells from the user's others."""
    return orders.filter("status = 'pending'").join(hints.select("order_id", "hint"), "order_id").select("order_id", "user_id", "hint")


def exchange_plans(items: DataFrame, variants: DataFrame, status: str = "delivered") -> DataFrame:
    """(order_id, items, options): orders of that status with items, named once in the order, that have a variant."""
    w = W.partitionBy("order_id", "product")
    once = items.filter(F.col("status") == status).withColumn("_n", F.count("*").over(w)).filter("_n = 1")
    v = variants.groupBy("item_id").agg(F.count("*").alias("n"))
    return once.join(v, "item_id").groupBy("order_id").agg(F.count("*").alias("items"), F.sum("n").alias("options"))


def split_integrity(base: DataFrame, train: DataFrame, val: DataFrame) -> DataFrame:
    """One row: sizes, overlap of the parts, ids of the base that neither has, ids that the base doesn't have."""
    flags = base.select("id", F.lit(1).alias("b")).join(train.select("id", F.lit(1).alias("t")), "id", "full_outer").join(val.select("id", F.lit(1).alias("v")), "id", "full_outer")
    has = lambda c: F.col(c).isNotNull()
    return flags.agg(
        F.count_if(has("t")).alias("train"), F.count_if(has("v")).alias("val"), F.count_if(has("t") & has("v")).alias("overlap"),
        F.count_if(has("b") & ~has("t") & ~has("v")).alias("missing"), F.count_if(~has("b")).alias("unknown"),
    )


def length_check(lengths: DataFrame, limit: int, new: int) -> DataFrame:
    """(least, upper_median, most, n_over): lengths against a limit that also holds `new` tokens.

    The upper median is found from counts by length, so no task sorts all rows.
    """
    by = lengths.groupBy("n").agg(F.count("*").alias("m"))
    run = F.sum("m").over(W.orderBy("n").rowsBetween(W.unboundedPreceding, 0))
    total = by.agg(F.sum("m").alias("all"))
    placed = by.withColumn("upto", run).join(F.broadcast(total), how="cross")
    return placed.agg(
        F.min("n").alias("least"), F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("n"))).alias("upper_median"), F.max("n").alias("most"),
        F.sum(F.when(F.col("n") + new > limit, F.col("m")).otherwise(0)).alias("n_over"),
    )


def revived(before_after: DataFrame) -> DataFrame:
    """Groups without variance by raw score and by shaped score, and how many shaping revives."""
    g = before_after.groupBy("group").agg((F.count_distinct(F.round("raw", 3)) > 1).alias("a"), (F.count_distinct(F.round("shaped", 3)) > 1).alias("b"))
    return g.agg(F.count_if(~F.col("a")).alias("zero_raw"), F.count_if(~F.col("b")).alias("zero_shaped"), F.count_if(~F.col("a") & F.col("b")).alias("revived"))


def trajectory(gold: DataFrame, made: DataFrame, score: Column) -> DataFrame:
    """(id, mean, least): turn by turn scores of (id, turn, g) and (id, turn, p); a turn that only one side has is 0."""
    j = gold.join(made, ["id", "turn"], "full_outer")
    s = F.when(F.col("g").isNull() | F.col("p").isNull(), 0.0).otherwise(score)
    return j.groupBy("id").agg(F.avg(s).alias("mean"), F.min(s).alias("least"))


def noisy(actions: DataFrame, seed: int = 0) -> DataFrame:
    """Actions spoilt for a self-check: of each six by hash one dropped, one with another tool, one with a broken argument."""
    h = F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("/", F.lit(str(seed)), F.col("id").cast("string"), F.col("turn").cast("string")), 256), 1, 8), 16, 10).cast("long"), F.lit(6))
    a = actions.withColumn("_h", h).filter("_h <> 0")
    return a.withColumns({"tool": F.when(F.col("_h") == 1, "other").otherwise(F.col("tool")), "argument": F.when(F.col("_h") == 2, F.concat("argument", F.lit("x"))).otherwise(F.col("argument"))}).drop("_h")


def trimmed(masks: DataFrame) -> DataFrame:
    """(first, last): the first and last column, from 1, that any row of (mask array) attends."""
    first = F.array_position("mask", 1)
    last = F.size("mask") + 1 - F.array_position(F.reverse("mask"), 1)
    return masks.agg(F.min(F.when(first > 0, first)).alias("first"), F.max(F.when(first > 0, last)).alias("last"))


def spans_mask(n_env: Column, n_sampled: Column, end: Column) -> Column:
    """A mask of zeros for given tokens, then ones for sampled ones, cut at `end` tokens."""
    whole = F.concat(F.array_repeat(F.lit(0), n_env), F.array_repeat(F.lit(1), n_sampled))
    return F.slice(whole, 1, F.least(end, F.size(whole)))


def call_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls with their results by (conv_id, call_id), failed ones left out."""
    return calls.join(results.filter("not failed").drop("failed"), ["conv_id", "call_id"])


def earned(messages: DataFrame, value: str) -> DataFrame:
    """The turns with `earned`: whether the user's words so far, this turn's included, hold the value.

    The first user turn that holds it is found for each conversation; no text is gathered.
    """
    holds = F.when((F.col("role") == "user") & F.contains(F.lower("text"), F.lower(F.col(value))), F.col("turn"))
    first = F.min(holds).over(W.partitionBy("conv_id"))
    return messages.withColumn("earned", F.coalesce(first <= F.col("turn"), F.lit(False)))
