"""Training examples and prompts: projection, narratives, rendering, parity, budgets, review pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def example(scenarios: DataFrame, system: str) -> DataFrame:
    """(id, messages, expected_tool, expected_arguments) of (id, prior_turns, user_message, calls array of (name, arguments)).

    Without an expected call the tool is null and the arguments are empty.
    """
    turn = lambda role, text: F.array(F.struct(F.lit(role).alias("role"), text.alias("content")))
    first = F.get("calls", F.lit(0))
    messages = F.concat(turn("system", F.lit(system)), F.coalesce("prior_turns", F.array().cast("array<struct<role:string,content:string>>")), turn("user", F.col("user_message")))
    return scenarios.select("id", messages.alias("messages"), first["name"].alias("expected_tool"), F.coalesce(first["arguments"], F.lit("{}")).alias("expected_arguments"))


def narrative(turns: Column, message: Column) -> Column:
    """The contents that aren't empty and the message, by lines."""
    said = F.concat(F.transform(F.coalesce(turns, F.array().cast("array<struct<role:string,content:string>>")), lambda t: t["content"]), F.array(message))
    return F.array_join(F.filter(said, lambda x: F.coalesce(x, F.lit("")) != ""), "\n")


def with_suffix(prompt: Column, suffix: str) -> Column:
    """The prompt with the suffix once."""
    return F.when(F.endswith(prompt, F.lit(suffix)), prompt).otherwise(F.concat(prompt, F.lit(suffix)))


def parity(prompts: DataFrame) -> DataFrame:
    """(n, same): how many prompts of training and evaluation (train, test) agree byte for byte."""
    return prompts.agg(F.count("*").alias("n"), F.count_if(F.sha2("train", 256) == F.sha2("test", 256)).alias("same"))


def budget(prompts: DataFrame, limit: int, new: int) -> DataFrame:
    """The prompts with `finish`: context where the prompt and what may be said don't fit."""
    return prompts.withColumn("finish", F.when(F.col("n_tokens") + new > limit, "context").otherwise("ok"))


#: Tools whose rewards are all or nothing, and those with few levels.
BINARY, COARSE = ("transfer_to_human_agents", "calculate"), ("cancel_pending_order", "get_order_details", "get_user_details", "get_product_details")


def granularity(tool: Column) -> Column:
    return F.when(tool.isNull() | tool.isin(*BINARY), "binary").when(tool.isin(*COARSE), "coarse").otherwise("graded")


def environment_delta(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, delta): what the environment adds; tool responses in a row share one user turn."""
    w = W.partitionBy("conv_id").orderBy("turn")
    tool, role = F.col("role") == "tool", F.col("role")
    opens = ~F.coalesce(F.lag(role).over(w) == "tool", F.lit(False))
    closes = ~F.coalesce(F.lead(role).over(w) == "tool", F.lit(False))
    body = F.concat(F.lit("\n<tool_response>\n"), F.col("text"), F.lit("\n</tool_response>"))
    as_tool = F.concat(F.when(opens, "<|im_start|>user").otherwise(""), body, F.when(closes, "<|im_end|>\n").otherwise(""))
    plain = F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), F.col("text"), F.lit("<|im_end|>\n"))
    return messages.select("conv_id", "turn", F.when(tool, as_tool).otherwise(plain).alias("delta"))


def first_difference(a: Column, b: Column) -> Column:
    """The place, from 0, where two arrays first differ; -1 where they are equal."""
    n = F.greatest(F.size(a), F.size(b))
    at = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: ~F.get(a, i).eqNullSafe(F.get(b, i)))
    return F.coalesce(F.get(at, F.lit(0)), F.lit(-1))


def page(sample: DataFrame) -> DataFrame:
    """(cell, markdown): a review page for each cell of (cell, id, text, flagged)."""
    mark = F.when(F.col("flagged"), " (flagged)").otherwise("")
    one = F.concat(F.lit("## "), F.col("id").cast("string"), mark, F.lit("\n\n> "), F.replace("text", F.lit("\n"), F.lit("\n> ")), F.lit("\n"))
    rows = F.sort_array(F.collect_list(F.struct("id", one.alias("m"))))
    return sample.groupBy("cell").agg(F.concat(F.lit("# "), F.first("cell"), F.lit("\n\n"), F.array_join(F.transform(rows, lambda r: r["m"]), "\n")).alias("markdown"))


def byte_ids(text: Column, special: dict[str, int]) -> Column:
    """A text as the ids of its UTF-8 bytes, control strings as one id each: the tokenizer that is there without a vocabulary.

    Each control string must be one id, and none may be a part of another.
    """
    names = sorted(special, key=len, reverse=True)
    if len(set(special.values())) < len(special) or any(a != b and a in b for a in names for b in names) or any(v < 256 for v in special.values()):
        raise ValueError("control strings must have ids of their own and not hold each other")
    octets = lambda s: F.transform(F.regexp_extract_all(F.hex(F.encode(s, "UTF-8")), F.lit(".."), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("int"))
    ids = F.create_map(*(F.lit(x) for kv in special.items() for x in kv)) if special else F.create_map().cast("map<string,int>")
    cut = F.split(F.regexp_replace(text, "(" + "|".join(map(_quoted, names)) + ")", "\u0000$1\u0000"), "\u0000") if special else F.array(text)
    part = lambda x: F.when(F.map_contains_key(ids, x), F.array(ids[x])).when(F.length(x) > 0, octets(x)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(cut, part))


def _quoted(s: str) -> str:
    return f"\\Q{s}\\E"
