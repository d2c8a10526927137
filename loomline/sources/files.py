"""Readers of the corpus's file formats: JSON arrays, JSON lines, judge reports, audits, id lists and logs."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCENARIO = "id string, category string, theme string, user_message string, prior_turns array<struct<role:string,content:string>>, expected_tool_calls array<struct<name:string,arguments:string>>, distractor_tool string"


def scenario_files(spark: SparkSession, path: str, schema: str = SCENARIO) -> DataFrame:
    """Files that each hold a JSON array, with the file's name as `cell`."""
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return df.withColumn("cell", F.regexp_extract("_metadata.file_name", r"^(.*?)\.json$", 1))


def json_lines(spark: SparkSession, path: str, schema: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """JSON lines; unknown fields are passed over, missing ones take their defaults.

    A line that isn't JSON is a row of nulls with the line in `bad`; blank lines give no row.
    """
    df = spark.read.schema(f"{schema}, bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad").json(path)
    return df.fillna(defaults) if defaults else df


def judge_reports(spark: SparkSession, path: str) -> DataFrame:
    """(scenario_id, issues, severity) of report files; a file that isn't JSON is one row with `bad` set."""
    text = spark.read.text(path, wholetext=True)
    kind = "struct<findings:array<struct<scenario_id:string,issues:array<string>,severity:string>>>"
    got = text.select(F.col("_metadata.file_name").alias("file"), F.try_parse_json("value").isNull().alias("bad"), F.from_json("value", kind).alias("r"))
    return got.select("file", "bad", F.explode_outer("r.findings").alias("f")).select("file", "bad", "f.*")


def cell_findings(spark: SparkSession, path: str) -> DataFrame:
    """(cell, severity, message): a finding for each file of a cell that doesn't hold a JSON array."""
    text = spark.read.text(path, wholetext=True)
    array = F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("ARRAY"), F.lit(False))
    cell = F.regexp_extract("_metadata.file_name", r"^(.*?)\.json$", 1)
    return text.filter(~array).select(cell.alias("cell"), F.lit("error").alias("severity"), F.lit("not a JSON array").alias("message"))


def id_list(spark: SparkSession, path: str, needed: bool = False) -> DataFrame:
    """(id): the lines of a file but blank ones and comments; an error if there are none and some are needed."""
    ids = spark.read.text(path).select(F.trim("value").alias("id")).filter("id <> '' and not startswith(id, '#')")
    if needed and ids.isEmpty():
        raise ValueError(f"no ids in {path}")
    return ids


def zero_variance_ids(spark: SparkSession, path: str, min_std: float = 0.05) -> tuple[DataFrame, str]:
    """(id) of groups without variance, and where that comes from: the scores of an audit, or a list of ids.

    A file whose first line that isn't blank begins an object holds audit rows.
    """
    first = spark.read.text(path).filter(F.trim("value") != "").select(F.startswith(F.ltrim("value"), F.lit("{")).alias("audit")).first()
    if first is None or not first.audit:
        return id_list(spark, path), "list"
    std = F.coalesce(F.stddev_samp("score"), F.lit(0.0))
    groups = audit_scores(spark, path).groupBy(F.col("scenario_id").alias("id")).agg(std.alias("std"), F.avg("score").alias("mean"))
    return groups.filter((F.col("std") < min_std - 1e-9) & (F.col("mean") < 1 - min_std)).select("id"), "audit"


def blocking_labels(spark: SparkSession, path: str) -> DataFrame | None:
    """(id, blocking) as an audit recorded them with its rows; None if it has none."""
    rows = spark.read.schema("scenario_id string, blocking array<string>").json(path).filter("blocking is not null")
    found = rows.select(F.col("scenario_id").alias("id"), F.array_sort("blocking").alias("blocking")).distinct()
    return None if found.isEmpty() else found


def resolve_blocking(spark: SparkSession, audit: str, labels: str | None) -> tuple[DataFrame | None, str]:
    """Blocking labels from the audit, else from the label audit's file, else none; and which it was."""
    recorded = blocking_labels(spark, audit)
    if recorded is not None:
        return recorded, "recorded"
    return (label_audit(spark, labels), "label audit") if labels else (None, "none")


TRUSTED = "id string, user_scenario string, evaluation_criteria struct<actions:array<struct<name:string,arguments:string,requestor:string>>>"


def trusted_tasks(spark: SparkSession, path: str) -> DataFrame:
    """(id, user_scenario, actions) of a JSON array of tasks: only the actions that the assistant has to take."""
    df = spark.read.schema(TRUSTED).option("multiLine", True).json(path)
    mine = F.filter("evaluation_criteria.actions", lambda a: a["requestor"] == "assistant")
    return df.select("id", "user_scenario", F.coalesce(F.transform(mine, lambda a: F.struct(a["name"].alias("name"), a["arguments"].alias("arguments"))), F.array().cast("array<struct<name:string,arguments:string>>")).alias("actions"))


class Snapshot:
    """The tables of a database, written once; what they were can be read again whatever became of them."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def take(self, tables: dict[str, DataFrame]) -> Snapshot:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")


def gold_turns(spark: SparkSession, turns: str, labels: str) -> DataFrame:
    """The labelled turns of two files of JSON lines, by turn_id; turns without a label are left out."""
    t = spark.read.schema("turn_id string, task string, sample long, m long, template string, text string").json(turns)
    return t.join(spark.read.schema("turn_id string, labels map<string,string>").json(labels), "turn_id")


def histories(spark: SparkSession, path: str) -> DataFrame:
    """(task, sample, pos, role, content): the messages of transcripts, system turns left out, places counted without them."""
    t = spark.read.schema("task string, sample long, messages array<struct<role:string,content:string>>").json(path)
    said = F.filter("messages", lambda m: m["role"] != "system")
    return t.select("task", "sample", F.posexplode(said).alias("pos", "m")).select("task", "sample", "pos", "m.role", "m.content")


def resolved(path: str, root: str) -> str:
    """The path as it is if something is there, else under the root."""
    return path if os.path.isabs(path) or os.path.exists(path) else os.path.join(root, path)


def label_audit(spark: SparkSession, path: str) -> DataFrame:
    """(id, blocking) of a JSON object keyed by id."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,struct<blocking:array<string>>>")).alias("id", "v")).select("id", F.coalesce("v.blocking", F.array().cast("array<string>")).alias("blocking"))


def audit_scores(spark: SparkSession, path: str, prefer_shaped: bool = True) -> DataFrame:
    """(scenario_id, sample, score) of audit rows; shaped scores if the audit has any, for all rows alike."""
    rows = spark.read.schema("scenario_id string, sample long, score double, shaped_score double").json(path)
    has = rows.agg((F.count("shaped_score") > 0).alias("shaped"))
    use = F.lit(prefer_shaped) & F.col("shaped")
    return rows.join(F.broadcast(has), how="cross").select("scenario_id", "sample", F.when(use, F.coalesce("shaped_score", "score")).otherwise(F.col("score")).alias("score"))


def training_log(spark: SparkSession, path: str) -> DataFrame:
    """(line, metrics map): the dict literals with a loss in a log's text."""
    found = F.regexp_extract_all("value", F.lit(r"\{'loss'.*?\}"), F.lit(0))
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(found).alias("line", "d"))
    values = F.from_json(F.translate("d", "'", '"'), "map<string,string>")
    return rows.select("file", (F.col("line") + 1).alias("line"), F.transform_values(values, lambda _, v: v.try_cast("double")).alias("metrics"))


def simulations(spark: SparkSession, path: str) -> DataFrame:
    """One row a simulation of result files."""
    sim = "struct<task_id:string,reward_info:struct<reward:double>,termination_reason:string,messages:array<struct<role:string,content:string>>,start_time:timestamp,end_time:timestamp,duration:double>"
    return spark.read.schema(f"simulations array<{sim}>").option("multiLine", True).json(path).select(F.explode("simulations").alias("s")).select("s.*")
