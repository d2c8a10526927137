"""Tool calls against the database: the registry, ordered replay, permutations, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The tools' names, whether they write, and their arguments.
TOOLS: dict[str, tuple[bool, tuple[str, ...]]] = {
    "find_user_id_by_email": (False, ("email",)),
    "find_user_id_by_name_zip": (False, ("first_name", "last_name", "zip")),
    "get_user_details": (False, ("user_id",)),
    "get_order_details": (False, ("order_id",)),
    "get_product_details": (False, ("product_id",)),
    "get_item_details": (False, ("item_id",)),
    "list_all_product_types": (False, ()),
    "calculate": (False, ("expression",)),
    "cancel_pending_order": (True, ("order_id", "reason")),
    "exchange_delivered_order_items": (True, ("order_id", "item_ids", "new_item_ids", "payment_method_id")),
    "return_delivered_order_items": (True, ("order_id", "item_ids", "payment_method_id")),
    "modify_pending_order_items": (True, ("order_id", "item_ids", "new_item_ids", "payment_method_id")),
    "modify_pending_order_address": (True, ("order_id", "address1", "address2", "city", "state", "country", "zip")),
    "modify_pending_order_payment": (True, ("order_id", "payment_method_id")),
    "modify_user_address": (True, ("user_id", "address1", "address2", "city", "state", "country", "zip")),
    "transfer_to_human_agents": (False, ("summary",)),
}


def checked(calls: DataFrame) -> DataFrame:
    """Calls (tool, arguments map) with `known`, `mutates`, `unknown` and `missing` argument names."""
    spec = F.lit(None).cast("struct<mutates:boolean,args:array<string>>")
    for name, (writes, args) in TOOLS.items():
        names = F.array(*map(F.lit, args)) if args else F.array().cast("array<string>")
        spec = F.when(F.col("tool") == name, F.struct(F.lit(writes).alias("mutates"), names.alias("args"))).otherwise(spec)
    keys = F.map_keys("arguments")
    return calls.withColumn("_s", spec).select(
        "*", F.col("_s").isNotNull().alias("known"), F.coalesce("_s.mutates", F.lit(False)).alias("mutates"), F.array_except(keys, "_s.args").alias("unknown"), F.array_except("_s.args", keys).alias("missing")
    ).drop("_s")


def transition(status: Column, tool: Column) -> Column:
    """An order's status after a write; as it was where the write isn't allowed."""
    return (
        F.when((tool == "cancel_pending_order") & (status == "pending"), "cancelled")
        .when((tool == "return_delivered_order_items") & (status == "delivered"), "return requested")
        .when((tool == "exchange_delivered_order_items") & (status == "delivered"), "exchange requested")
        .when((tool == "modify_pending_order_items") & (status == "pending"), "pending (items modified)")
        .otherwise(status)
    )


def prefixes(steps: DataFrame) -> DataFrame:
    """(order_id, states): an order's status before each of its steps (order_id, status, seq, tool) and at the end.

    A step that fails carries the state forward. Each order's few steps are folded in order.
    """
    tools = F.transform(F.sort_array(F.collect_list(F.struct("seq", "tool"))), lambda x: x["tool"])
    g = steps.groupBy("order_id").agg(F.first("status").alias("status"), tools.alias("tools"))
    zero = F.array(F.col("status"))
    return g.select("order_id", F.aggregate("tools", zero, lambda a, t: F.concat(a, F.array(transition(F.element_at(a, -1), t)))).alias("states"))


def end_states(steps: DataFrame) -> DataFrame:
    """(order_id, finals): the end states that the steps of an order lead to, over all their orders.

    Orders of steps aren't listed. What is kept is, for each multiset of steps done, the states that it can
    lead to; equal steps are one kind, so an order with k kinds of n steps has at most (n / k + 1)^k multisets.
    """
    kinds = steps.groupBy("order_id", "tool").agg(F.count("*").cast("int").alias("n"), F.first("status").alias("status"))
    g = kinds.groupBy("order_id").agg(F.first("status").alias("status"), F.sort_array(F.collect_list(F.struct("tool", "n"))).alias("kinds"))
    total = F.aggregate("kinds", F.lit(0), lambda a, k: a + k["n"])
    none = F.transform("kinds", lambda _: F.lit(0))
    state = lambda left, status: F.struct(left.alias("done"), status.alias("status"))

    def further(reached: Column, _: Column) -> Column:
        def each(s: Column) -> Column:
            options = F.transform(
                "kinds", lambda k, i: F.when(F.get(s["done"], i) < k["n"], state(F.transform(s["done"], lambda d, j: d + (j == i).cast("int")), transition(s["status"], k["tool"])))
            )
            return F.array_compact(options)

        return F.array_distinct(F.flatten(F.transform(reached, each)))

    rounds = F.sequence(F.lit(1), total)
    finals = F.aggregate(rounds, F.array(state(none, F.col("status"))), further, lambda a: F.array_distinct(F.transform(a, lambda s: s["status"])))
    return g.select("order_id", F.sort_array(finals).alias("finals"))


def touched_users(actions: DataFrame, orders: DataFrame) -> DataFrame:
    """(user_id): users that held-out actions (user_id, order_id) name or whose orders they name."""
    named = actions.select("user_id").filter("user_id is not null")
    owners = actions.select("order_id").join(orders.select("order_id", "user_id"), "order_id").select("user_id")
    return named.unionByName(owners).distinct()


def memoised(calls: DataFrame, outcome: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Calls with the outcome of their gold call, worked out once for each distinct one."""
    return calls.join(outcome.dropDuplicates(list(keys)), list(keys), "left")


