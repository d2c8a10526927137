"""Rollouts: one episode a row, of a scripted user and a named agent."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions import scripted

RESULT = "id string, agent string, end_reason string, turns int, calls int, writes int, confirmed int, authed boolean, matched boolean, reward double, messages int"


def tasks(orders: DataFrame, users: DataFrame) -> DataFrame:
    """(id, task): JSON of a task for each user with orders: to cancel the least one, and to return the greatest if that is another.

    Orders in another status must be refused. A user has few orders; those that the task names are its database.
    """
    row = F.struct("order_id", "status", "pm_id")
    two = orders.groupBy("user_id").agg(F.min(row).alias("a"), F.max(row).alias("z"), F.count("*").alias("n")).join(users.select("user_id", "email"), "user_id")
    request = lambda o, action, status, ask: F.struct(o["order_id"].alias("order_id"), F.lit(action).alias("action"), F.lit(status).alias("status"), F.concat(F.lit(ask), o["order_id"], F.lit(".")).alias("ask"))
    first, last = request(F.col("a"), "cancel", "pending", "I want to cancel order "), request(F.col("z"), "return", "delivered", "I want to return order ")
    several = F.col("a.order_id") != F.col("z.order_id")
    requests = F.when(several, F.array(first, last)).otherwise(F.array(first))
    status = lambda o, need, then: F.when(o["status"] == need, F.lit(then)).otherwise(o["status"])
    ends = F.map_from_entries(F.array_compact(F.array(F.struct(F.col("a.order_id"), status(F.col("a"), "pending", "cancelled")), F.when(several, F.struct(F.col("z.order_id"), status(F.col("z"), "delivered", "return requested"))))))
    kept = lambda o: F.struct(o["order_id"], F.struct(o["order_id"].alias("order_id"), o["status"].alias("status")))
    db = F.struct(F.map_from_entries(F.array_compact(F.array(kept(F.col("a")), F.when(several, kept(F.col("z")))))).alias("orders"), "email", "user_id")
    task = F.struct(
        F.col("user_id").cast("string").alias("id"), "email", F.concat(F.lit("My email is "), "email", F.lit(".")).alias("identity"), F.concat(F.lit("Hi! "), first["ask"]).alias("opening"),
        requests.alias("requests"), F.lit("#W9999999").alias("other_order"), db.alias("db"), ends.alias("ends"), F.struct(F.array("a.order_id", "z.order_id").alias("orders")).alias("facts"),
    )
    return two.select(F.col("user_id").cast("string").alias("id"), F.to_json(task).alias("task"))


def rollouts(tasks: DataFrame, agents: tuple[str, ...] = ("oracle",), most_turns: int = 30) -> DataFrame:
    """The episode of each task (id, task JSON) with each named agent. Rows are apart, so it doesn't matter how many run at once; one that fails is a row with the failure as its end."""
    unknown = set(agents) - set(scripted.AGENTS)
    if unknown:
        raise ValueError(f"unknown agents {sorted(unknown)}")
    each = tasks.select("id", "task", F.explode(F.array(*map(F.lit, agents))).alias("agent"))
    names = [c.split()[0] for c in RESULT.split(", ")]

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t, a in b[["id", "task", "agent"]].itertuples(index=False):
                try:
                    got = scripted.episode(json.loads(t), scripted.AGENTS[a], most_turns)
                except Exception as e:  # noqa: BLE001
                    got = {"end_reason": f"error: {type(e).__name__}", "turns": 0, "calls": 0, "writes": 0, "confirmed": 0, "authed": False, "matched": False, "reward": 0.0, "messages": 0}
                rows.append({"id": i, "agent": a, **got})
            yield pd.DataFrame(rows, columns=names)

    return each.mapInPandas(of, RESULT)
