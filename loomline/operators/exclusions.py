"""Exclusion sets by reason, their tables, shifts and fingerprints; id reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve(corpus: DataFrame, label_defects: DataFrame, zero_variance: DataFrame) -> DataFrame:
    """The corpus with a flag for each reason; ids outside the corpus don't count."""
    flag = lambda df, name: df.select("id").distinct().withColumn(name, F.lit(True))
    out = corpus.join(flag(label_defects, "label"), "id", "left").join(flag(zero_variance, "zero"), "id", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("label", "zero")})
    return out.withColumn("excluded", F.col("label") | F.col("zero"))


def table(flagged: DataFrame) -> DataFrame:
    """By category and in total: rows, those excluded by label, by zero variance alone, and what remains."""
    return flagged.rollup("category").agg(
        F.count("*").alias("total"),
        F.count_if("label").alias("label_defects"),
        F.count_if(F.col("zero") & ~F.col("label")).alias("zero_variance"),
        F.count_if(~F.col("excluded")).alias("remaining"),
    )


def emptied_cells(flagged: DataFrame) -> DataFrame:
    """Cells of which the exclusions leave nothing."""
    return flagged.groupBy("category", "theme").agg(F.count("*").alias("n"), F.count_if("excluded").alias("gone")).filter("n = gone").select("category", "theme", "n")


def shift(flagged: DataFrame) -> DataFrame:
    """Each category's share before and after."""
    by = flagged.groupBy("category").agg(F.count("*").alias("n"), F.count_if(~F.col("excluded")).alias("m"))
    total = by.agg(F.sum("n").alias("all_n"), F.sum("m").alias("all_m"))
    share = lambda a, b: F.round(F.coalesce(F.col(a) / F.nullif(b, F.lit(0)), F.lit(0.0)), 6)
    return by.join(F.broadcast(total), how="cross").select("category", share("n", "all_n").alias("before"), share("m", "all_m").alias("after"))


def defect_kinds(audit: DataFrame) -> DataFrame:
    """How many scenarios have each kind of defect; the kind is what stands before the colon."""
    kinds = F.array_distinct(F.transform("blocking", lambda b: F.split_part(b, F.lit(":"), F.lit(1))))
    return audit.select(F.explode(kinds).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def fingerprint(ids: DataFrame) -> DataFrame:
    """12 hex digits that tell a set of ids, whatever their order: the root of a tree of hashes."""
    hashes = ids.select(F.sha2(F.col("id").cast("string"), 256).alias("hash")).distinct()
    return hash_tree(hashes).select(F.substring("root", 1, 12).alias("fingerprint"))


def hash_tree(hashes: DataFrame) -> DataFrame:
    """(root): one hash of all hex hashes in `hash`, repeats included: each level hashes what a bucket holds, in order.

    The lowest level has 16 million buckets, by the first six digits; an inner node has 4,096 children at most.
    """
    joined = lambda rows: F.sha2(F.array_join(F.transform(F.sort_array(rows), lambda x: x["hash"]), ""), 256)
    out = hashes.select(F.col("hash").alias("at"), "hash")
    for n in (6, 3, 0):
        held = F.collect_list(F.struct("at", "hash"))
        out = out.select(F.substring("at", 1, n).alias("to"), "at", "hash").groupBy("to").agg(joined(held).alias("hash")).withColumnRenamed("to", "at")
    return out.select(F.col("hash").alias("root"))


def reconcile(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(id, problem): ids missing from the findings, unknown to the corpus, or found twice."""
    f = found.groupBy("id").agg(F.count("*").alias("n"))
    both = expected.select("id", F.lit(True).alias("known")).join(f, "id", "full_outer")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("known").isNull(), "unknown").when(F.col("n") > 1, "duplicate")
    return both.select("id", problem.alias("problem")).filter("problem is not null")


def without_users(tasks: DataFrame, users: DataFrame) -> DataFrame:
    """Tasks none of whose involved users is excluded."""
    bad = tasks.select("id", F.explode("involved_users").alias("user_id")).join(users, "user_id", "left_semi").select("id").distinct()
    return tasks.join(bad, "id", "left_anti")
