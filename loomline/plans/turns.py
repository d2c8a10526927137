"""Queries on what agents' turns say, and on rollouts of scripted episodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.functions import analyzer
from loomline.operators import facts, rollouts
from loomline.registry import CORE
from loomline.session import spread
from loomline.sources import bind

OP, PM, RI = bind.ORDER_PAYMENTS, bind.PAYMENTS, bind.RETAIL_ITEMS


def _facts(spark, d):
    o = bind.order_payments(spark, d)
    p = bind.table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("product"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size"))
    return o, facts.task_facts(o.select(F.col("order_id").alias("id"), "user_id", "order_id"), o, bind.retail_items(spark, d), bind.payment_methods(spark, d)), p


@CORE.query(
    "task_facts",
    f"""with m as (select user_id, string_agg(pm_id, ',' order by pm_id) as methods from {PM} p group by 1), c as (select user_id, count(*) as n from {OP} o group by 1), i as (select order_id, string_agg(cast(item_id as varchar), ',' order by item_id) as items from {RI} i group by 1)
    select o.order_id as id, methods, pm_id as original, n as n_orders, items from {OP} o join m using (user_id) join c using (user_id) left join i on i.order_id = o.order_id""",
)
def task_facts(spark, d):
    _, f, _ = _facts(spark, d)
    kind = "struct<methods:array<struct<pm_id:string>>,original:string,orders:array<string>,items:array<struct<item_id:long,name:string>>>"
    x = f.select("id", F.from_json("facts", kind).alias("f"))
    return x.select("id", F.array_join(F.transform("f.methods", lambda m: m["pm_id"]), ",").alias("methods"), F.col("f.original").alias("original"), F.size("f.orders").cast("long").alias("n_orders"), F.array_join(F.transform("f.items", lambda i: i["item_id"].cast("string")), ",").alias("items"))


_K = "cast(substr(order_id, 3) as bigint) % 8"


@CORE.query(
    "analyzed_turns",
    f"""select order_id as id, case {_K} when 0 then 'identity' when 4 then 'payment,address' when 6 then 'order,reason' else '' end as asks, {_K} in (1, 7) as consent, case {_K} when 2 then 'policy' when 5 then 'inability' else 'none' end as refusal, {_K} = 3 as done,
    case {_K} when 1 then 'cancel' when 3 then 'cancel' when 7 then 'modify' end as action, case when {_K} in (1, 7) then case when {_K} = 1 then pm_id else 'credit_card_' || lpad(cast(user_id as varchar), 7, '0') end else '' end as payments,
    case {_K} when 7 then '#W9999999: not the user''s' else '' end as problems from {OP} o""",
)
def analyzed_turns(spark, d):
    """Turns of eight kinds about each order; the SQL has what each kind says."""
    o, f, p = _facts(spark, d)
    oid, k = F.col("order_id"), F.substring("order_id", 3, 7).cast("long") % 8
    card = F.concat(F.lit("credit_card_"), F.lpad(F.col("user_id").cast("string"), 7, "0"))
    other = F.concat(F.lit("I'll move the payment of "), oid, F.lit(" and #W9999999 from your gift card to "), card, F.lit(": is that okay?"))
    said = [
        F.lit("Thanks for reaching out! Could you share your email and zip code?"), F.concat(F.lit("I can cancel order "), oid, F.lit(" and send the money to the original payment method.\n\nDo you confirm (yes/no)?")),
        F.concat(F.lit("I'm sorry, I cannot return order "), oid, F.lit(". Per our policy only delivered orders can go back.")), F.lit("Your order has now been cancelled. You don't need to share your email."),
        F.lit("Which payment method should it be? Please tell me the new address too."), F.lit("I am not able to help with lost parcels."), F.lit("Please give me the order id and the reason."), F.regexp_replace(other, "move the payment of", "update the payment of"),
    ]
    text = said[-1]
    for n, x in enumerate(said[:-1]):
        text = F.when(k == n, x).otherwise(text)
    turns = facts.with_variants(o.select(oid.alias("id"), text.alias("text")).join(f, "id"), p)
    s = turns.select("id", analyzer.analyzed("text", "facts").alias("s"))
    csv = lambda c: F.array_join(f"s.{c}", ",").alias(c)
    return s.select("id", csv("asks"), "s.consent", "s.refusal", "s.done", "s.action", csv("payments"), csv("problems"))


@CORE.query(
    "oracle_rollouts",
    f"""with u as (select user_id, min(order_id) as a, max(order_id) as z, arg_min(status, order_id) as sa, arg_max(status, order_id) as sz from {OP} o group by 1), w as (select *, (sa = 'pending')::int + (a <> z and sz = 'delivered')::int as writes from u)
    select cast(user_id as varchar) as id, 'user_stop' as end_reason, writes, writes as confirmed, true as matched, 1.0 as reward from w""",
)
def oracle_rollouts(spark, d):
    t = rollouts.tasks(bind.order_payments(spark, d), bind.users(spark, d))
    return rollouts.rollouts(spread(t, "id", 5000)).select("id", "end_reason", "writes", "confirmed", "matched", "reward")


@CORE.query("near_miss_rollouts")
def near_miss_rollouts(spark, d):
    """What each way of missing costs, on average."""
    t = rollouts.tasks(bind.order_payments(spark, d), bind.users(spark, d))
    r = rollouts.rollouts(spread(t, "id", 5000), ("oracle", "no_identity", "no_consent", "wrong_order", "two_calls", "stops", "transfers", "repeats"))
    return r.groupBy("agent", "end_reason").agg(F.count("*").alias("n"), F.round(F.avg("reward"), 6).alias("reward"))
