"""Diagnoses and totals: stuck groups, judge reports, difficulties, verdicts, simulated mixtures; and filters of pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomline.operators.selection import mixture, split


def band(completions: DataFrame, gold: DataFrame, stats: DataFrame, target: float, tol: float) -> DataFrame:
    """The completions of groups whose scores all lie within tol of the target, with their gold call; those without one are left out."""
    stuck = stats.filter((F.col("n") > 0) & (F.abs(F.col("lo") - target) <= tol) & (F.abs(F.col("hi") - target) <= tol)).select("scenario_id")
    return completions.join(stuck, "scenario_id", "left_semi").join(gold, "scenario_id")


def diagnosis(graded: DataFrame, most: dict[str, int] | None = None) -> DataFrame:
    """(kind, value, n): how often each category, expected tool, reason and argument fault occurs, the most frequent of each kind.

    graded: category, gold_tool, pred_tool, reason, and arrays missing, extra and typed (`key:type`). pred_tool counts
    where it isn't the expected one. Of equals the first by value.
    """
    most = most or {"pred_tool": 10, "missing": 8, "extra": 8, "typed": 8}
    wrong = F.when(~F.col("pred_tool").eqNullSafe(F.col("gold_tool")), F.coalesce("pred_tool", F.lit("(no call)")))
    one = lambda kind, value: F.array(F.struct(F.lit(kind).alias("kind"), value.alias("value")))
    some = lambda kind: F.transform(kind, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    facts = F.concat(one("category", F.col("category")), one("gold_tool", F.col("gold_tool")), one("reason", F.col("reason")), one("pred_tool", wrong), some("missing"), some("extra"), some("typed"))
    n = graded.select(F.explode(facts).alias("f")).select("f.*").filter("value is not null").groupBy("kind", "value").agg(F.count("*").alias("n"))
    limit = F.coalesce(F.create_map(*(F.lit(x) for kv in most.items() for x in kv))[F.col("kind")], F.lit(1_000))
    r = F.row_number().over(W.partitionBy("kind").orderBy(F.desc("n"), "value"))
    return n.withColumn("_r", r).filter(F.col("_r") <= limit).drop("_r")


def severities(findings: DataFrame) -> DataFrame:
    """The findings with `major`, `minor` and `flagged` (any severity but none)."""
    s = F.col("severity")
    return findings.withColumns({"major": s == "major", "minor": s == "minor", "flagged": s != "none"})


def report_totals(findings: DataFrame, by: str) -> DataFrame:
    """By group and in all: findings, major ones, minor ones, flagged ones, issues."""
    g = severities(findings).rollup(by)
    return g.agg(F.count("*").alias("n"), F.count_if("major").alias("major"), F.count_if("minor").alias("minor"), F.count_if("flagged").alias("flagged"), F.coalesce(F.sum(F.size("issues")), F.lit(0)).alias("issues"))


def difficulty_totals(scores: DataFrame) -> DataFrame:
    """(kind, key, n, mean, least, most): by label, and by category with the range of scores."""
    spread = [F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.min("score"), 6).alias("least"), F.round(F.max("score"), 6).alias("most")]
    by = lambda kind: scores.groupBy(F.col(kind).alias("key")).agg(*spread).select(F.lit(kind).alias("kind"), "key", "n", "mean", "least", "most")
    return by("label").unionByName(by("category"))


def simulated_mix(groups: DataFrame, mix: dict[str, float], seed: int = 0) -> DataFrame:
    """(category, class, before, after): groups (id, category, theme, class) of a pool and of what a mixture would take of it, by class; with totals."""
    taken = mixture(groups, mix, "id", seed)
    both = groups.select("category", "class", F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(taken.select("category", "class", F.lit(0).alias("b"), F.lit(1).alias("a")))
    return both.groupingSets([["category", "class"], ["class"], []], "category", "class").agg(F.sum("b").alias("before"), F.sum("a").alias("after"))


def training_sets(scenarios: DataFrame, excluded: DataFrame, mix: dict[str, float] | None, val: float, seed: int = 0) -> DataFrame:
    """The scenarios left by the exclusions, mixed, with `part`: train or val by cell."""
    kept = scenarios.join(excluded.select("id").distinct(), "id", "left_anti")
    return split(mixture(kept, mix, "id", seed) if mix else kept, ("category", "theme"), "id", val, seed)


def selected(parts: DataFrame, which: str) -> DataFrame:
    """Rows of a recorded split (id, part, excluded): train or val without the excluded, or all with them."""
    if which not in ("train", "val", "all"):
        raise ValueError(f"unknown split {which}")
    return parts if which == "all" else parts.filter((F.col("part") == which) & ~F.col("excluded"))


def picked(tasks: DataFrame, prefixes: tuple[str, ...] = (), ids: DataFrame | None = None, templates: tuple[str, ...] = ()) -> DataFrame:
    """Tasks whose id begins with one of the prefixes, is among the ids, and whose template is one of those; what isn't given doesn't filter."""
    out = tasks
    if prefixes:
        out = out.filter(F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(F.col("id"), p)))
    if templates:
        out = out.filter(F.col("template").isin(*templates))
    return out if ids is None else out.join(ids.select("id").distinct(), "id", "left_semi")


def prefixes(turns: DataFrame, messages: DataFrame) -> DataFrame:
    """(task, sample, m, said): each labelled turn with the messages before it; none where the transcript lacks them.

    turns: (task, sample, m); messages: (task, sample, pos, role, content).
    """
    m = messages.select("task", "sample", "pos", F.struct("pos", "role", "content").alias("x"))
    j = turns.join(m, ["task", "sample"], "left").groupBy("task", "sample", "m")
    before = F.sort_array(F.collect_list(F.when(F.col("pos") < F.col("m"), F.col("x"))))
    return j.agg(F.transform(before, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("said"))


def supported(config: Column, known: tuple[str, ...]) -> tuple[Column, Column]:
    """The entries of a configuration map whose keys are known, and the other keys."""
    names = F.array(*map(F.lit, known))
    return F.map_filter(config, lambda k, _: F.array_contains(names, k)), F.array_sort(F.array_except(F.map_keys(config), names))


def top_k(value: Column) -> Column:
    """A count of candidates, or null where it says that all count: null, zero or less."""
    return F.when(value > 0, value)


def id_values(arguments: Column, keys: tuple[str, ...]) -> Column:
    """The values, as text, of the id arguments of a JSON object, or of their plurals; lists are opened, booleans are left out."""
    names = [x for k in keys for x in (k, f"{k}s")]
    of = lambda k: F.get_json_object(arguments, f"$.{k}")
    listed = lambda v: F.when(F.startswith(v, F.lit("[")), F.from_json(v, "array<string>")).otherwise(F.array(v))
    values = F.flatten(F.array(*(F.coalesce(listed(of(k)), F.array().cast("array<string>")) for k in names)))
    return F.filter(values, lambda v: v.isNotNull() & ~v.isin("true", "false"))


def field_or(document: Column, path: str, default: str) -> Column:
    """A field of an open JSON document, or a default where the document or the field is missing."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(document), path, "string"), F.lit(default))
