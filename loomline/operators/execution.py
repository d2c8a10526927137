"""Tool calls executed against the database as joins: results that never raise, and the records that writes leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.operators.replay import checked
from loomline.operators.retail import CANCEL_REASONS

SUM = r"^\s*(-?\d+(?:\.\d+)?)\s*([-+*/])\s*(\d+(?:\.\d+)?)\s*$"


def calculated(expression: Column) -> Column:
    """The value of one sum, difference, product or quotient, to two places; null for anything else."""
    a, b = (F.regexp_extract(expression, SUM, i).try_cast("double") for i in (1, 3))
    op = F.regexp_extract(expression, SUM, 2)
    return F.round(F.when(op == "+", a + b).when(op == "-", a - b).when(op == "*", a * b).when((op == "/") & (b != 0), a / b), 2)


def executed(calls: DataFrame, orders: DataFrame, users: DataFrame, methods: DataFrame) -> DataFrame:
    """(call_id, ok, value, error_type, error, schema_valid, mutates) of calls (call_id, tool, arguments map).

    Each call meets the database as it stands. orders: (order_id, user_id, status, pm_id); users: (user_id, first,
    last, zip, email); methods: (user_id, pm_id). Keys are looked up by joins, whatever the call asks for; a call
    that lacks a key takes one of its own that nothing has, so that such calls don't meet in one task.
    """
    a = lambda k: F.col("arguments")[k]
    c = checked(calls).withColumn("_none", F.concat(F.lit("\0"), F.xxhash64("call_id").cast("string")))
    key = lambda k: F.coalesce(k.cast("string"), "_none")
    o = orders.select(F.col("order_id").alias("o_id"), F.col("user_id").alias("o_user"), "status", F.col("pm_id").alias("paid"))
    u = users.select(F.col("user_id").alias("u_id"), "first", "last", "zip")
    mail = users.select(F.lower("email").alias("mail"), F.col("user_id").alias("by_mail"))
    name = users.groupBy("first", "last", "zip").agg(F.min("user_id").alias("by_name")).select(F.lower("first").alias("f"), F.lower("last").alias("l"), F.col("zip").alias("z"), "by_name")
    m = methods.select(F.col("user_id").alias("m_user"), F.col("pm_id").alias("m_id"))
    j = c.join(o, key(a("order_id")) == F.col("o_id"), "left").join(u, key(a("user_id").try_cast("long")) == F.col("u_id").cast("string"), "left").join(mail, key(F.lower(a("email"))) == F.col("mail"), "left")
    j = j.join(name, (key(F.lower(a("first_name"))) == F.col("f")) & (F.lower(a("last_name")) == F.col("l")) & (a("zip") == F.col("z")), "left")
    j = j.join(m, (key(a("payment_method_id")) == F.col("m_id")) & (F.col("o_user") == F.col("m_user")), "left")
    t, none = F.col("tool"), F.lit(None).cast("string")
    no_order, no_user, no_method = F.col("o_id").isNull(), F.col("u_id").isNull(), F.col("m_id").isNull()
    status, pays = F.col("status"), t.isin("return_delivered_order_items", "exchange_delivered_order_items", "modify_pending_order_items", "modify_pending_order_payment")
    has = lambda k: F.map_contains_key("arguments", k)
    problem = (
        F.when(~F.col("known"), F.lit("unknown tool"))
        .when((F.size("unknown") > 0) | (F.size("missing") > 0), "invalid arguments")
        .when(has("order_id") & no_order, "order not found")
        .when((t == "find_user_id_by_email") & F.col("by_mail").isNull(), "user not found")
        .when((t == "find_user_id_by_name_zip") & F.col("by_name").isNull(), "user not found")
        .when(t.isin("get_user_details", "modify_user_address") & no_user, "user not found")
        .when((t == "calculate") & calculated(a("expression")).isNull(), "invalid expression")
        .when(t.isin("cancel_pending_order", "modify_pending_order_items", "modify_pending_order_payment", "modify_pending_order_address") & (status != "pending"), "non-pending order")
        .when(t.isin("return_delivered_order_items", "exchange_delivered_order_items") & (status != "delivered"), "non-delivered order")
        .when((t == "cancel_pending_order") & ~a("reason").isin(*CANCEL_REASONS), "invalid reason")
        .when(pays & no_method, "payment method not found")
        .when((t == "modify_pending_order_payment") & (F.col("m_id") == F.col("paid")), "same payment method")
    )
    kind = F.when(F.col("problem").isin("unknown tool"), "unknown_tool").when(F.col("problem") == "invalid arguments", "invalid_arguments").otherwise("tool_error")
    value = (
        F.when(t == "get_order_details", F.to_json(F.struct(F.col("o_id").alias("order_id"), F.col("o_user").alias("user_id"), "status")))
        .when(t == "get_user_details", F.to_json(F.struct(F.col("u_id").alias("user_id"), "first", "last", "zip")))
        .when(t == "find_user_id_by_email", F.col("by_mail").cast("string"))
        .when(t == "find_user_id_by_name_zip", F.col("by_name").cast("string"))
        .when(t == "calculate", calculated(a("expression")).cast("string"))
        .when(t == "transfer_to_human_agents", "Transfer successful")
        .when(F.col("mutates"), "done")
    )
    out = j.withColumn("problem", problem)
    ok = F.col("problem").isNull()
    return out.select(
        "call_id", ok.alias("ok"), F.when(ok, value).alias("value"), F.when(~ok, kind).alias("error_type"), F.coalesce("problem", none).alias("error"),
        (F.col("known") & ~F.coalesce(F.col("problem") == "invalid arguments", F.lit(False))).alias("schema_valid"), "mutates",
    )


def exchanged(orders: DataFrame, plans: DataFrame) -> DataFrame:
    """The orders after exchanges (order_id, item_ids, new_item_ids, difference, pm_id): what is stored, sorted, and the status."""
    ids = lambda c: F.array_join(F.sort_array(F.split(c, ",")), ",")
    p = plans.select("order_id", ids("item_ids").alias("exchange_items"), ids("new_item_ids").alias("exchange_new_items"), F.col("pm_id").alias("exchange_payment_method_id"), F.col("difference").alias("exchange_price_difference"))
    done = (F.col("status") == "delivered") & F.col("exchange_items").isNotNull()
    return orders.join(p.hint("merge"), "order_id", "left").withColumn("status", F.when(done, "exchange requested").otherwise(F.col("status")))


def items_modified(orders: DataFrame, plans: DataFrame) -> DataFrame:
    """The orders after item changes: a pending order is marked as modified, so a second change finds it no longer pending."""
    p = plans.select("order_id", F.lit(True).alias("_changed"))
    done = (F.col("status") == "pending") & F.coalesce("_changed", F.lit(False))
    return orders.join(p, "order_id", "left").withColumn("status", F.when(done, "pending (item modified)").otherwise(F.col("status"))).drop("_changed")


def payment_moved(orders: DataFrame, moves: DataFrame) -> DataFrame:
    """(order_id, history): the orders whose payment moves (order_id, target), with what was paid and refunded, in order."""
    j = orders.join(moves.select("order_id", "target"), "order_id")
    entry = lambda kind, pm: F.struct(F.lit(kind).alias("type"), F.col("amount"), pm.alias("pm_id"))
    return j.select("order_id", F.array(entry("payment", F.col("pm_id")), entry("payment", F.col("target")), entry("refund", F.col("pm_id"))).alias("history"))


def balances_after(methods: DataFrame, orders: DataFrame, moves: DataFrame) -> DataFrame:
    """(pm_id, balance): gift cards after payments move: what moves to one is taken off, what moves away comes back."""
    j = orders.select("order_id", "amount", "pm_id").join(moves.select("order_id", "target"), "order_id")
    change = j.select(F.col("target").alias("pm_id"), (-F.col("amount")).alias("d")).unionByName(j.select("pm_id", F.col("amount").alias("d"))).groupBy("pm_id").agg(F.sum("d").alias("d"))
    return methods.filter("source = 'gift_card'").join(change, "pm_id", "left").select("pm_id", F.round(F.col("balance") + F.coalesce("d", F.lit(0.0)), 2).alias("balance"))


def address_changed(orders: DataFrame, new: DataFrame) -> DataFrame:
    """The orders with the addresses of (order_id, new_address) where they are pending, by any of its marks."""
    j = orders.join(new.select("order_id", "new_address"), "order_id", "left")
    return j.withColumn("address1", F.when(F.startswith("status", F.lit("pending")), F.coalesce("new_address", "address1")).otherwise(F.col("address1"))).drop("new_address")
