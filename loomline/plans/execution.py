"""Queries on executed tool calls and the records that writes leave."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.operators import execution as x
from loomline.operators import templates as t
from loomline.plans import templates as tp
from loomline.registry import CORE
from loomline.sources import bind

OP, PM, US = bind.ORDER_PAYMENTS, bind.PAYMENTS, bind.USERS
_OID = "'#W' || lpad(cast(event_id * 2 as varchar), 7, '0')"
_CARD = "'credit_card_' || lpad(cast(user_id as varchar), 7, '0')"
_CALLS = f"""(select event_id as call_id, event_id % 9 as k, {_OID} as oid, user_id, {_CARD} as card, case when event_type = 'view' then 'no longer needed' when event_type = 'error' then 'ordered by mistake' else event_type end as reason, props, value from events)"""
_EXEC = f"""with c as {_CALLS}, j as (select c.*, o.user_id as owner, o.status, o.pm_id as paid, u.first, u.last, u.zip, m.user_id as by_mail from c left join {OP} o on o.order_id = oid left join {US} u on u.user_id = c.user_id
      left join {US} m on m.email = 'customer.' || lpad(cast(c.user_id as varchar), 9, '0') || '@example.com'),
    p as (select *, case k when 0 then case when owner is null then 'order not found' end when 1 then case when first is null then 'user not found' end when 2 then case when by_mail is null then 'user not found' end
      when 3 then case when user_id % 4 = 0 then 'invalid expression' end when 4 then case when owner is null then 'order not found' when status <> 'pending' then 'non-pending order' when reason not in ('no longer needed', 'ordered by mistake') then 'invalid reason' end
      when 5 then 'invalid arguments' when 6 then 'unknown tool' when 7 then case when owner is null then 'order not found' when status <> 'pending' then 'non-pending order' when 'credit_card_' || lpad(cast(owner as varchar), 7, '0') <> card then 'payment method not found' when card = paid then 'same payment method' end end as problem from j)
    select call_id, problem is null as ok, case when problem is null then case k when 0 then '{{"order_id":"' || oid || '","user_id":' || owner || ',"status":"' || status || '"}}' when 1 then '{{"user_id":' || user_id || ',"first":"' || first || '","last":"' || last || '","zip":"' || zip || '"}}'
      when 2 then cast(by_mail as varchar) when 3 then cast(round(cast(user_id * 3 as double), 2) as varchar) when 8 then 'Transfer successful' else 'done' end end as value,
      case problem when 'unknown tool' then 'unknown_tool' when 'invalid arguments' then 'invalid_arguments' else case when problem is not null then 'tool_error' end end as error_type, problem as error, k not in (5, 6) as schema_valid, k in (4, 5, 7) as mutates from p"""


@CORE.query("executed_calls", _EXEC)
def executed_calls(spark, d):
    i, u = F.col("event_id"), F.col("user_id")
    oid = F.concat(F.lit("#W"), F.lpad((i * 2).cast("string"), 7, "0"))
    card = F.concat(F.lit("credit_card_"), F.lpad(u.cast("string"), 7, "0"))
    reason = F.when(F.col("event_type") == "view", "no longer needed").when(F.col("event_type") == "error", "ordered by mistake").otherwise(F.col("event_type"))
    mail = F.concat(F.lit("Customer."), F.lpad(u.cast("string"), 9, "0"), F.lit("@example.com"))
    sums = F.when(u % 4 == 0, F.concat(u.cast("string"), F.lit(" to the 3"))).otherwise(F.concat(u.cast("string"), F.lit(" * 3")))
    made = lambda **kv: F.create_map(*(y for k, v in kv.items() for y in (F.lit(k), v)))
    kinds = [
        ("get_order_details", made(order_id=oid)), ("get_user_details", made(user_id=u.cast("string"))), ("find_user_id_by_email", made(email=mail)), ("calculate", made(expression=sums)),
        ("cancel_pending_order", made(order_id=oid, reason=reason)), ("cancel_pending_order", made(order_id=oid)), ("open_door", made(order_id=oid)),
        ("modify_pending_order_payment", made(order_id=oid, payment_method_id=card)), ("transfer_to_human_agents", made(summary=F.col("props"))),
    ]
    tool, args = F.lit(None).cast("string"), F.lit(None).cast("map<string,string>")
    for k, (name, a) in enumerate(kinds):
        tool, args = F.when(i % 9 == k, name).otherwise(tool), F.when(i % 9 == k, a).otherwise(args)
    calls = bind.table(spark, d, "events").select(i.alias("call_id"), tool.alias("tool"), args.alias("arguments"))
    return x.executed(calls, bind.order_payments(spark, d), bind.users(spark, d), bind.payment_methods(spark, d))


_SORTED = lambda c: f"array_to_string(list_sort(str_split({c}, ',')), ',')"


@CORE.query(
    "exchanged_orders",
    f"""with p as ({tp._changes_sql('delivered', 3)}) select o.order_id, case when p.order_id is not null then 'exchange requested' else status end as status, {_SORTED('item_ids')} as exchange_items, {_SORTED('new_item_ids')} as exchange_new_items,
    p.pm_id as exchange_payment_method_id, difference as exchange_price_difference from {OP} o left join p using (order_id)""",
)
def exchanged_orders(spark, d):
    out = x.exchanged(bind.order_payments(spark, d).select("order_id", "status"), tp._changes(spark, d, "delivered", 3))
    return out


@CORE.query("modified_orders", f"with p as ({tp._changes_sql('pending', 2)}) select status, count(*) as n from (select case when status = 'pending' and order_id in (select order_id from p) then 'pending (item modified)' else status end as status from {OP} o) t group by 1")
def modified_orders(spark, d):
    o = x.items_modified(bind.order_payments(spark, d).select("order_id", "status"), tp._changes(spark, d, "pending", 2))
    return o.groupBy("status").agg(F.count("*").alias("n"))


_MOVES = CORE.sql["modify_payment_candidates"]


@CORE.query("moved_payments", f"with m as ({_MOVES}) select order_id, 'payment ' || o.pm_id || ',payment ' || target || ',refund ' || o.pm_id as history from m join {OP} o using (order_id) where mode = 'plain'")
def moved_payments(spark, d):
    o = bind.order_payments(spark, d)
    h = x.payment_moved(o, t.modify_payment(o, bind.payment_methods(spark, d)).filter("mode = 'plain'"))
    return h.select("order_id", F.array_join(F.transform("history", lambda e: F.concat(e["type"], F.lit(" "), e["pm_id"])), ",").alias("history"))


@CORE.query(
    "balances_after_moves",
    f"""with m as (select * from ({_MOVES}) q where mode = 'plain'), j as (select o.amount, o.pm_id, target from m join {OP} o using (order_id)), c as (select pm_id, sum(d) as d from (select target as pm_id, -amount as d from j union all select pm_id, amount from j) y group by 1)
    select pm_id, round(balance + coalesce(d, 0), 2) as balance from {PM} p left join c using (pm_id) where source = 'gift_card'""",
)
def balances_after_moves(spark, d):
    o, m = bind.order_payments(spark, d), bind.payment_methods(spark, d)
    return x.balances_after(m, o, t.modify_payment(o, m).filter("mode = 'plain'"))


@CORE.query("changed_addresses", f"with j as ({CORE.sql['modify_address_candidates']}) select o.order_id, coalesce(j.address1, o.address1) as address1 from {OP} o left join j on j.order_id = o.order_id and mode = 'dictated'")
def changed_addresses(spark, d):
    o = bind.order_payments(spark, d)
    new = t.modify_address(o, bind.users(spark, d)).filter("mode = 'dictated'").select("order_id", F.col("address1").alias("new_address"))
    return x.address_changed(o, new).select("order_id", "address1")
