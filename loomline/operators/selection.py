"""Deterministic sampling, splitting and mixing, ordered by hashes of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


MOST_THEMES = 100_000


def hash_key(seed: str | int, *ids: str) -> Column:
    """A sort key that any engine with SHA-256 gives."""
    return F.sha2(F.concat_ws("/", F.lit(str(seed)), *(F.col(i).cast("string") for i in ids)), 256)


def uniform(seed: str | int, *ids: str) -> Column:
    """A number from 0 to 1 from the first 32 bits of the hash."""
    return F.conv(F.substring(hash_key(seed, *ids), 1, 8), 16, 10).cast("double") / 4294967295.0


def ranked(df: DataFrame, strata: tuple[str, ...], id_col: str, seed: str | int, rank: str = "_r", size: str = "_n") -> DataFrame:
    """The rows with their rank, from 1, in their stratum by the hash of their id, and the stratum's size.

    Ranks come from counts by ranges of the hash: a task sorts one of 4,096 ranges of a stratum, and the
    counts before it are sums over at most as many rows. Null strata are strata like others.
    """
    key = F.struct(*strata)
    keyed = df.withColumns({"_s": F.xxhash64(F.to_json(key)), "_h": hash_key(seed, id_col)}).withColumn("_b", F.substring("_h", 1, 3))
    each = keyed.groupBy("_s", "_b").agg(F.count("*").alias("_m"))
    w = W.partitionBy("_s")
    before = F.coalesce(F.sum("_m").over(w.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = each.withColumns({"_start": before, size: F.sum("_m").over(w)}).drop("_m")
    place = F.row_number().over(W.partitionBy("_s", "_b").orderBy("_h", id_col))
    return keyed.withColumn("_p", place).join(starts, ["_s", "_b"]).withColumn(rank, F.col("_start") + F.col("_p")).drop("_s", "_h", "_b", "_p", "_start")


def per_stratum(df: DataFrame, strata: tuple[str, ...], id_col: str, n: Column | int, seed: str | int = 42) -> DataFrame:
    """The n rows of least hash in each stratum."""
    r = F.row_number().over(W.partitionBy(*strata).orderBy(hash_key(seed, id_col), id_col))
    return df.withColumn("_r", r).filter(F.col("_r") <= n).drop("_r")


def review_sample(df: DataFrame, flagged: DataFrame, strata: tuple[str, ...], id_col: str, base: int = 4, extra: int = 3, seed: int = 42) -> DataFrame:
    """A base sample of each stratum, then up to `extra` flagged rows that it left out."""
    first = per_stratum(df, strata, id_col, base, seed)
    rest = df.join(flagged.select(id_col).distinct(), id_col, "left_semi").join(first.select(id_col), id_col, "left_anti")
    more = per_stratum(rest, strata, id_col, extra, f"{seed}-flagged")
    return first.withColumn("picked", F.lit("base")).unionByName(more.withColumn("picked", F.lit("flagged")))


def fraction(df: DataFrame, strata: tuple[str, ...], id_col: str, share: Column | float, seed: str | int = 0) -> DataFrame:
    """floor(share * n + 1e-9) rows of each stratum, share held to 0..1."""
    keep = F.floor(F.least(F.greatest(F.lit(share) if isinstance(share, float) else share, F.lit(0.0)), F.lit(1.0)) * F.col("_n") + 1e-9)
    return ranked(df, strata, id_col, seed).filter(F.col("_r") <= keep).select(df.columns)


def mixture(df: DataFrame, mix: dict[str, float], id_col: str = "id", seed: int = 0) -> DataFrame:
    """A downsample whose category shares are `mix`, taking themes in turn within a category.

    A row's place in its category's turns follows from its rank in its theme and the sizes of the
    category's themes, so no window spans a category. The themes' sizes are broadcast; more than
    `MOST_THEMES` of them are an error.
    """
    share = F.create_map(*(F.lit(x) for kv in mix.items() for x in kv))
    known = df.filter(F.col("category").isin(*mix))
    sizes = known.groupBy("category", "theme").agg(F.count("*").alias("n"))
    if sizes.limit(MOST_THEMES + 1).count() > MOST_THEMES:
        raise ValueError(f"more than {MOST_THEMES} themes")
    cats = sizes.groupBy("category").agg(F.sum("n").alias("avail"), F.collect_list(F.struct("theme", "n")).alias("themes"))
    budget = F.min(F.col("avail") / share[F.col("category")]).over(W.partitionBy())
    cats = cats.withColumn("target", F.bround(budget * share[F.col("category")]))
    placed = ranked(known, ("category", "theme"), id_col, seed).join(F.broadcast(cats), "category")
    before = F.aggregate(
        "themes", F.lit(0).cast("long"), lambda a, t: a + F.least(t["n"], F.col("_r") - 1) + F.when((t["theme"] <= F.col("theme")) & (t["n"] >= F.col("_r")), 1).otherwise(0)
    )
    return placed.filter(before <= F.col("target")).select(df.columns)


def split(df: DataFrame, strata: tuple[str, ...], id_col: str, val: float, seed: int = 0) -> DataFrame:
    """The rows with `part`: round(n * val) of each stratum for validation, one at least and n - 1 at most where n > 1."""
    n = F.col("_n")
    want = F.bround(n * val).cast("long")
    target = F.when(F.lit(val) <= 0, 0).when(n >= 2, F.least(F.greatest(want, F.lit(1)), n - 1)).otherwise(want)
    return ranked(df, strata, id_col, seed).withColumn("part", F.when(F.col("_r") <= target, "val").otherwise("train")).select(*df.columns, "part")


def holdout(df: DataFrame, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """The rows with `held_out`: exactly n of them, or all there are, chosen by the hash of their id before anything else."""
    return ranked(df.withColumn("_all", F.lit(0)), ("_all",), id_col, seed).withColumn("held_out", F.col("_r") <= n).select(*df.columns, "held_out")


def top(df: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """(key, n): the k most frequent values; of equals the one seen first, by the least `order`."""
    g = df.groupBy(key).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return g.orderBy(F.desc("n"), "_first", key).limit(k).select(key, "n")


def is_val_user(user: str, share: float = 0.15) -> Column:
    """Whether a user falls in the validation share, by the hash of its id."""
    return uniform("val", user) < share


def quota(df: DataFrame, weights: dict[str, float], size: int, key: str, id_col: str, seed: int = 0) -> DataFrame:
    """round(size * weight / sum of weights) rows of each template, or all it has."""
    total = sum(weights.values())
    n = F.create_map(*(F.lit(x) for k, v in weights.items() for x in (k, round(size * v / total))))[F.col(key)]
    return ranked(df.filter(F.col(key).isin(*weights)), (key,), id_col, seed).filter(F.col("_r") <= n).select(df.columns)


def prefilter(classed: DataFrame, keep_dead: float = 0.2, keep_solved: float = 0.0, drop_flat_other: bool = False, id_col: str = "id", seed: int = 0) -> DataFrame:
    """Live and unjudged tasks, and a fraction of the dead and the solved of each template."""
    whole = ["live", "unjudged"] + ([] if drop_flat_other else ["flat_other"])
    share = F.when(F.col("class").isin(*whole), 1.0).when(F.col("class") == "dead", keep_dead).when(F.col("class") == "solved", keep_solved).otherwise(0.0)
    return fraction(classed, ("template", "class"), id_col, share, seed)


def weighted_choice(df: DataFrame, options: dict[str, float], seed: str | int, *ids: str) -> DataFrame:
    """The rows with `choice`, drawn by weight from the hash of their ids."""
    total, at, out = sum(options.values()), 0.0, F.lit(None).cast("string")
    u, cases = uniform(seed, *ids), []
    for k, v in options.items():
        at += v / total
        cases.append((at, k))
    for edge, k in reversed(cases):
        out = F.when(u < edge, k).otherwise(out)
    return df.withColumn("choice", F.coalesce(out, F.lit(cases[-1][1])))


def knobs(df: DataFrame, space: dict[str, list[str]], seed: int, *ids: str) -> DataFrame:
    """A column for each knob, its value chosen from a list by hash; repeated values weigh more."""
    pick = lambda k, vs: F.element_at(F.array(*map(F.lit, vs)), (F.floor(uniform(f"{seed}/{k}", *ids) * len(vs) * (1 - 1e-12)) + 1).cast("int"))
    return df.withColumns({k: pick(k, vs) for k, vs in space.items()})


def group_seed(task: str, step: Column | int, seed: int) -> Column:
    """crc32 of seed:task:step, of 31 bits."""
    return F.crc32(F.concat_ws(":", F.lit(str(seed)), F.col(task).cast("string"), F.lit(step).cast("string")).cast("binary")).bitwiseAND(2147483647)


def replicate(df: DataFrame, times: int) -> DataFrame:
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def first_of(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The first row of each key, in order."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def shard(df: DataFrame, id_col: str, rank: int, world: int) -> DataFrame:
    """Rows rank, rank + world, ... by place in the order of ids.

    Places come from a range sort and partition sizes: rows are counted by range, not gathered.
    """
    placed = with_place(df, id_col)
    return placed.filter(F.col("place") % world == rank).drop("place")


def with_place(df: DataFrame, id_col: str) -> DataFrame:
    """The rows with `place`, from 0, in the order of a unique numeric id, without a window over all rows."""
    spread = df.withColumn("_b", F.floor(F.col(id_col) / 4096))
    sizes = spread.groupBy("_b").agg(F.count("*").alias("_n"))
    upper = sizes.withColumn("_u", F.floor(F.col("_b") / 4096))
    tops = upper.groupBy("_u").agg(F.sum("_n").alias("_m")).withColumn("_base", F.coalesce(F.sum("_m").over(W.orderBy("_u").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_u").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = upper.join(tops.select("_u", "_base"), "_u").select("_b", (F.col("_base") + before).alias("_start"))
    place = F.col("_start") + F.row_number().over(W.partitionBy("_b").orderBy(id_col)) - 1
    return spread.join(starts, "_b").withColumn("place", place).drop("_b", "_start")
