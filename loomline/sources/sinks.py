"""Writers: JSON lines without defaults, sidecars by cell, manifests, id lists and mix strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, defaults: dict[str, object] | None = None) -> None:
    """Rows as JSON lines; nulls and fields at their default are left out."""
    cols = [F.when(~F.col(c).eqNullSafe(F.lit(defaults[c])), F.col(c)).alias(c) if defaults and c in defaults else F.col(c) for c in df.columns]
    df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "true"}).alias("value")).write.mode("overwrite").text(path)


def by_cell(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("cell").json(path)


def manifest(df: DataFrame, key: str, **about: object) -> DataFrame:
    """One JSON document: what was asked, and how many rows each key has."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    by = F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "n"))))
    return counts.agg(by.alias("counts")).select(F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in about.items()), "counts")).alias("manifest"))


def mix_string(mix: DataFrame) -> DataFrame:
    """category=share joined by commas, in order of category; there are few categories."""
    one = F.concat("category", F.lit("="), F.col("share").cast("string"))
    return mix.agg(F.array_join(F.sort_array(F.collect_list(one)), ",").alias("mix"))


def parse_mix(spec: str) -> dict[str, float]:
    """a=0.4,b=0.1 as a dict; shares must be positive."""
    out = {k.strip(): float(v) for k, _, v in (p.partition("=") for p in spec.split(","))}
    if not out or min(out.values()) <= 0:
        raise ValueError(f"not a mix: {spec}")
    return out


#: Shares of categories that go by a name.
NAMED_MIXES = {"even": "happy_path=0.2,context=0.2,policy=0.2,ambiguous=0.2,out_of_scope=0.2", "hard": "policy=0.4,ambiguous=0.4,out_of_scope=0.2"}


def named_mix(spec: str) -> dict[str, float]:
    """A mix by its name, or as it is written."""
    return parse_mix(NAMED_MIXES.get(spec, spec))


def append_summaries(stream: DataFrame, path: str, checkpoint: str):
    """A stream of (step, reward, success): each batch adds one row of JSON for each of its steps. A batch done twice writes its folder anew."""

    def write(batch: DataFrame, number: int) -> None:
        g = batch.groupBy("step").agg(F.count("*").alias("n"), F.round(F.avg("reward"), 6).alias("mean"), F.round(F.avg(F.col("success").cast("int")), 6).alias("success"))
        g.write.mode("overwrite").json(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def save_verdicts(verdicts: DataFrame, path: str) -> None:
    verdicts.select("scenario_id", "verdict", "note").write.mode("overwrite").json(path)


def load_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """(scenario_id, verdict, note); without a verdict it is pending."""
    df = spark.read.schema("scenario_id string, verdict string, note string").json(path)
    return df.fillna({"verdict": "pending", "note": ""})
