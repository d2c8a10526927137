"""Replay of conversations: each one folded in turn order, in parallel over conversations."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions import fold

RESULT = "conv_id long, turns long, calls long, malformed long, writes long, confirmed long, authed string, end_reason string"


def replay(messages: DataFrame, max_turns: int = 30, max_calls: int = 30) -> DataFrame:
    """(conv_id, ...): what each conversation of (conv_id, turn, role, text) comes to.

    A conversation is the unit of state and is gathered whole; null roles and texts are empty.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        s = fold.opened(max_turns, max_calls)
        for role, text in rows.sort_values("turn", kind="stable")[["role", "text"]].itertuples(index=False):
            s = fold.step(s, role or "", text or "")
        key = rows["conv_id"].iloc[0]
        return pd.DataFrame([[key, s["turns"], s["calls"], s["malformed"], s["writes"], s["confirmed"], s["authed"], s["end"] or "open"]], columns=[c.split()[0] for c in RESULT.split(", ")])

    return messages.select("conv_id", "turn", "role", "text").groupBy("conv_id").applyInPandas(one, RESULT)


def consent_ledger(events: DataFrame) -> DataFrame:
    """(id, granted, suspended) after all events (id, seq, slot, event), as a native fold."""
    ordered = F.sort_array(F.collect_list(F.struct("seq", "slot", "event")))
    empty = F.struct(F.array().cast("array<string>").alias("g"), F.array().cast("array<string>").alias("s"))

    def step(a, x):
        slot, e = F.array(x["slot"]), x["event"]
        had, held = F.array_contains(a["g"], x["slot"]), F.array_contains(a["s"], x["slot"])
        add, drop = (lambda c: F.array_union(c, slot)), (lambda c: F.array_except(c, slot))
        g = F.when((e == "yes") | ((e == "fallback") & held), add(a["g"])).when(e.isin("success", "failure", "revoke"), drop(a["g"])).otherwise(a["g"])
        s = F.when((e == "failure") & had, add(a["s"])).when(e.isin("yes", "revoke") | ((e == "fallback") & held), drop(a["s"])).otherwise(a["s"])
        return F.struct(g.alias("g"), s.alias("s"))

    out = events.groupBy("id").agg(ordered.alias("e")).select("id", F.aggregate("e", empty, step).alias("a"))
    return out.select("id", F.array_join(F.sort_array("a.g"), ",").alias("granted"), F.array_join(F.sort_array("a.s"), ",").alias("suspended"))


def token_trace(messages: DataFrame) -> DataFrame:
    """(conv_id, n_sampled, n_env): words said by the assistant, and words it was given."""
    n = F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))
    own = F.col("role") == "assistant"
    return messages.groupBy("conv_id").agg(F.sum(F.when(own, n).otherwise(0)).alias("n_sampled"), F.sum(F.when(own, 0).otherwise(n)).alias("n_env"))


def state_json(state: dict) -> str:
    return json.dumps(state, sort_keys=True)
