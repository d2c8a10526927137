"""Checks of scenario corpora and judge reports, and the tables of reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEVERITIES = ("none", "minor", "major")


def rule_findings(scenarios: DataFrame) -> DataFrame:
    """(id, severity, message): each rule that a scenario (id, category, theme, text, n_calls, distractor, expected) breaks.

    A scenario without text or category has that finding alone.
    """
    c = F.col
    err, warn = (lambda m, s=s: F.struct(F.lit(s).alias("severity"), F.lit(m).alias("message")) for s in ("error", "warning"))
    missing = F.coalesce(c("text"), F.lit("")).eqNullSafe("") | c("category").isNull()
    rest = F.array_compact(
        F.array(
            F.when(c("n_calls") > 1, err("more than one call")),
            F.when((c("category") == "happy_path") & (c("n_calls") != 1), err("a happy path has one call")),
            F.when((c("category") == "out_of_scope") & (c("n_calls") > 0), err("out of scope has no call")),
            F.when(c("distractor").eqNullSafe(c("expected")) & c("distractor").isNotNull(), err("the distractor is the expected tool")),
            F.when(F.length("text") < 40, warn("very short")),
        )
    )
    all_of = F.when(missing, F.array(err("missing keys"))).otherwise(rest)
    return scenarios.select("id", F.explode(all_of).alias("f")).select("id", "f.severity", "f.message")


def report_problems(findings: DataFrame) -> DataFrame:
    """(id, problem): severities out of the vocabulary, or that don't fit the issues."""
    n = F.size("issues")
    problem = (
        F.when(~F.col("severity").isin(*SEVERITIES), "unknown severity")
        .when((F.col("severity") == "none") & (n > 0), "issues without severity")
        .when((F.col("severity") != "none") & (n == 0), "severity without issues")
    )
    return findings.select("id", problem.alias("problem")).filter("problem is not null")


def rule_report(findings: DataFrame, scenarios: DataFrame) -> DataFrame:
    """By category: scenarios, failing ones, findings."""
    f = findings.groupBy("id").agg(F.bool_or(F.col("severity") == "error").alias("failed"), F.count("*").alias("k"))
    j = scenarios.select("id", "category").join(f, "id", "left")
    return j.groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.coalesce("failed", F.lit(False))).alias("failing"), F.coalesce(F.sum("k"), F.lit(0)).alias("findings"))


def verdict_stubs(sample: DataFrame, existing: DataFrame) -> DataFrame:
    """The verdicts there are, and pending ones for sampled ids that have none."""
    new = sample.select("scenario_id").distinct().join(existing, "scenario_id", "left_anti").withColumn("verdict", F.lit("pending"))
    return existing.select("scenario_id", "verdict").unionByName(new.select("scenario_id", "verdict"))


def record_verdict(verdicts: DataFrame, scenario_id: int, verdict: str) -> DataFrame:
    """The verdicts with one set anew; an unknown id or verdict is an error."""
    if verdict not in ("accept", "reject", "fix", "pending"):
        raise ValueError(f"unknown verdict {verdict}")
    if not verdicts.filter(F.col("scenario_id") == scenario_id).limit(1).count():
        raise KeyError(scenario_id)
    return verdicts.withColumn("verdict", F.when(F.col("scenario_id") == scenario_id, F.lit(verdict)).otherwise(F.col("verdict")))


def manifest(sample: DataFrame) -> DataFrame:
    """(cell, ids): a cell's sampled ids, of which sampling allows few."""
    return sample.groupBy("cell").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def nlu_accuracy(rows: DataFrame) -> DataFrame:
    """Accuracy by field and by (template, field) of (template, field, gold, pred, applicable)."""
    ok = F.col("gold").eqNullSafe(F.col("pred")).cast("int")
    g = rows.filter("applicable").groupingSets([["field"], ["template", "field"]], "template", "field")
    return g.agg(F.count("*").alias("n"), F.round(F.avg(ok), 6).alias("accuracy"))


def confusions(rows: DataFrame) -> DataFrame:
    return rows.filter("applicable and not (gold <=> pred)").groupBy("field", "gold", "pred").agg(F.count("*").alias("n"))
