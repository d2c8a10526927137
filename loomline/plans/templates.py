"""Queries on task templates: candidates, grounding, verification, composition."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.operators import retail as r
from loomline.operators import templates as t
from loomline.registry import CORE
from loomline.sources import bind

RO, RI, OP, PM, US = bind.RETAIL_ORDERS, bind.RETAIL_ITEMS, bind.ORDER_PAYMENTS, bind.PAYMENTS, bind.USERS
_PHRASE = "case source when 'credit_card' then 'the ' || upper(left(brand, 1)) || substr(brand, 2) || ' card ending in ' || last_four when 'gift_card' then 'my gift card' else 'my PayPal account' end"
MU = f'(select *, count(*) over (partition by user_id, {_PHRASE}) = 1 as "unique" from {PM} p)'
ONCE = f"(select * from {RI} i qualify count(*) over (partition by order_id, product) = 1)"


@CORE.query("unique_payment_phrases", f"select pm_id, {_PHRASE} as phrase, count(*) over (partition by user_id, {_PHRASE}) = 1 as \"unique\" from {PM} p")
def unique_payment_phrases(spark, d):
    return t.told_apart(bind.payment_methods(spark, d)).select("pm_id", "phrase", "unique")


@CORE.query(
    "return_fallback_candidates",
    f"""with m as {MU}, n as (select order_id, count(*) as n_items from {ONCE} i group by 1)
    select o.order_id, o.user_id, o.pm_id as original, min(a.pm_id) as asked, any_value(n_items) as n_items from {OP} o join m p on p.user_id = o.user_id and p.pm_id = o.pm_id and p.source <> 'gift_card'
    join m a on a.user_id = o.user_id and a.pm_id <> o.pm_id and a.source <> 'gift_card' and a."unique" join n on n.order_id = o.order_id where o.status = 'delivered' group by 1, 2, 3""",
)
def return_fallback_candidates(spark, d):
    return t.return_fallback(bind.order_payments(spark, d), bind.payment_methods(spark, d), bind.retail_items(spark, d))


@CORE.query(
    "modify_payment_candidates",
    f"""with m as {MU}, o as (select * from {OP} o where status = 'pending' and n_payments = 1), x as (select order_id, amount, o.pm_id as orig, m.pm_id, source, balance from o join m using (user_id) where "unique" and m.pm_id <> o.pm_id),
    c as (select user_id, min(pm_id) as card, min(balance) as balance from m where source = 'gift_card' group by 1 having count(*) = 1)
    select order_id, 'plain' as mode, min(pm_id) as asked, min(pm_id) as target from x where source <> 'gift_card' or balance >= amount group by 1
    union all select o.order_id, 'gift_card_short', any_value(card), min(x.pm_id) from o join c using (user_id) join x on x.order_id = o.order_id and x.source <> 'gift_card' where card <> o.pm_id and c.balance < o.amount group by 1""",
)
def modify_payment_candidates(spark, d):
    return t.modify_payment(bind.order_payments(spark, d), bind.payment_methods(spark, d))


_P = "(select p_partkey as item_id, p_name as product, p_brand as brand, p_type as type, p_size as size, p_retailprice as price from part)"
_V = f"""(with a as (select * from {_P} p), b as (select product, brand, type, size, min(item_id) as item_id from a group by all having count(*) = 1)
  select a.item_id, b.item_id as other_id, c.price as new_price from a join b on a.product = b.product and (cast(a.brand <> b.brand as int) + cast(a.type <> b.type as int) + cast(a.size <> b.size as int)) = 1 join a c on c.item_id = b.item_id)"""


def _changes_sql(status: str, n: int) -> str:
    return f"""with v as (select item_id, list(other_id order by other_id, new_price) as ids, list(new_price order by other_id, new_price) as prices from {_V} v group by 1), m as {MU},
    p as (select o.*, ids, prices, row_number() over (partition by order_id order by pos, o.item_id) as r from (select * from {RI} i where status = '{status}' qualify count(*) over (partition by order_id, product) = 1) o join v on v.item_id = o.item_id),
    g as (select order_id, user_id, string_agg(cast(item_id as varchar), ',' order by r) as item_ids, string_agg(cast(ids[1] as varchar), ',' order by r) as new_item_ids, round(sum(prices[1] - price), 2) as difference,
      {'max(case when r = 1 then ids[2] end)' if n < 3 else 'cast(null as bigint)'} as corrected from p where r <= {n} group by 1, 2 having count(*) = {n})
    select g.*, min(pm_id) as pm_id from g join m using (user_id) where "unique" and (source <> 'gift_card' or balance >= greatest(difference, 0)) group by all"""


def _changes(spark, d, status: str, n: int):
    p = bind.table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("product"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    items = bind.retail_items(spark, d, t.told_by_id(bind.retail_orders(spark, d), status))
    return t.item_changes(items, r.least_variants(p), p, bind.payment_methods(spark, d), status, n)


@CORE.query("modify_items_candidates", _changes_sql("pending", 2))
def modify_items_candidates(spark, d):
    return _changes(spark, d, "pending", 2)


@CORE.query("exchange_items_candidates", _changes_sql("delivered", 3))
def exchange_items_candidates(spark, d):
    return _changes(spark, d, "delivered", 3)


def _made(user: str, zip_: str) -> tuple[str, str]:
    part = lambda at, n: f"cast(('0x' || substr(sha256('address/' || cast({user} as varchar)), {at}, 4)) as int) % {n}"
    z = f"10000 + {part(9, 50000)}"
    street = f"{list(t.STREETS)!r}[{part(5, len(t.STREETS))} + 1]"
    return f"(100 + {part(1, 9900)}) || ' ' || {street} || ' Street'", f"cast(case when cast({z} as varchar) = {zip_} then {z} + 1 else {z} end as varchar)"


_A, _Z = _made("user_id", "zip")


@CORE.query(
    "modify_address_candidates",
    f"""with j as (select order_id, user_id, o.address1 as there, u.address1, zip from {OP} o join {US} u using (user_id) where status = 'pending')
    select order_id, 'profile' as mode, address1, zip from j where there <> address1 union all select order_id, 'dictated', {_A}, {_Z} from j""",
)
def modify_address_candidates(spark, d):
    return t.modify_address(bind.order_payments(spark, d), bind.users(spark, d))


@CORE.query("modify_user_address_candidates", f"select user_id, {_A} as address1, {_Z} as zip from (select *, count(*) over (partition by first, last, zip) as n from {US} u) x where n = 1")
def modify_user_address_candidates(spark, d):
    return t.modify_user_address(bind.users(spark, d))


# --- grounding ----------------------------------------------------------------------------


@CORE.query(
    "identify_user",
    f"""with t as (select user_id as id, 'I am ' || first || ' ' || upper(last) || ', zip ' || zip || ' or 01999.' as text, [zip, '01999'] as zips from {US} u),
    h as (select id, u.zip, count(*) as n, min(user_id) as user_id from (select id, text, unnest(list_distinct(zips)) as zip from t) t join {US} u using (zip) where contains(lower(text), lower(first)) and contains(lower(text), lower(last)) group by 1, 2)
    select id, arg_min(user_id, zip) as user_id from h where n = 1 group by 1""",
)
def identify_user(spark, d):
    u = bind.users(spark, d)
    text = F.concat(F.lit("I am "), "first", F.lit(" "), F.upper("last"), F.lit(", zip "), "zip", F.lit(" or 01999."))
    return t.identified(u.select(F.col("user_id").alias("id"), text.alias("text")), u)


_W = lambda k: f"'W' || lpad(cast({k} as varchar), 7, '0')"


@CORE.query(
    "orders_named",
    f"""with t as (select event_id as id, [{_W('event_id * 3')}, {_W('event_id + 9000000')}, {_W('user_id')}, {_W('event_id * 3')}] as w from events),
    e as (select id, '#' || w[i] as order_id, i - 1 as pos from t, unnest(range(1, 5)) as u(i))
    select id, order_id, min(pos) as pos from e where order_id in (select order_id from {RO} o) group by 1, 2""",
)
def orders_named(spark, d):
    w = lambda k: F.concat(F.lit("W"), F.lpad(k.cast("string"), 7, "0"))
    i = F.col("event_id")
    text = F.concat(F.lit("about #"), w(i * 3), F.lit(", not "), w(i + 9_000_000), F.lit(" but "), w(F.col("user_id")), F.lit(" or "), w(i * 3), F.lit("."))
    return t.orders_named(bind.table(spark, d, "events").select(i.alias("id"), text.alias("text")), bind.retail_orders(spark, d))


@CORE.query(
    "verify_tasks",
    f"""with o as (select *, cast(substr(order_id, 3) as bigint) as k from {OP} o)
    select order_id as id, array_to_string(list_filter([case when k % 11 = 0 then 'a line leaks ids' end, case when k % 3 = 0 then 'get_order_details uses ids not revealed' end, case when k % 5 = 0 and k % 11 <> 0 then 'write uses ids not revealed' end,
      case when status <> 'pending' then 'write failed' end, case when k % 7 = 0 and status = 'pending' then 'a refusal changed the state' end, case when k % 7 <> 0 and status <> 'pending' then 'the state is unchanged' end], lambda x: x is not null), '; ') as problems from o""",
)
def verify_tasks(spark, d):
    o = bind.order_payments(spark, d)
    k, ok = F.substring("order_id", 3, 7).cast("long"), F.col("status") == "pending"
    lines = F.array(F.concat(F.lit("about order "), F.when(k % 3 == 0, "mine").otherwise(F.col("order_id"))), F.when(k % 11 == 0, F.lit("pay with paypal_9999999")).otherwise("thanks"))
    action = lambda *xs: F.struct(*(x.alias(n) for x, n in zip(xs, ("name", "arguments", "ok", "output", "mutates"), strict=True)))
    read = action(F.lit("get_order_details"), F.to_json(F.struct("order_id")), F.lit(True), F.to_json(F.struct("order_id", "pm_id")), F.lit(False))
    write = action(F.lit("write"), F.concat("order_id", F.lit(" "), F.when(k % 5 == 0, F.lit("paypal_9999999")).otherwise(F.col("pm_id"))), ok, F.lit(""), F.lit(True))
    tasks = o.select(F.col("order_id").alias("id"), lines.alias("lines"), F.array(read, write).alias("actions"), (k % 7 == 0).alias("expect_no_write"), ok.alias("changed"))
    return t.verify(tasks).select("id", F.array_join("problems", "; ").alias("problems"))


@CORE.query(
    "composed_tasks",
    f"""with s as (select *, row_number() over (partition by user_id order by order_id) - 1 as i from {OP} o where status = 'pending')
    select user_id, 'auth>user>' || string_agg('read ' || order_id || '>write ' || order_id, '>' order by order_id) as actions, string_agg(order_id, ',' order by order_id) as targets, bool_and(n_payments > 1) as expect_no_write, cast(14 + 8 * count(*) as int) as max_turns,
      coalesce(string_agg(case when n_payments = 1 then 's' || i || ':cancel:order:' || order_id end, ',' order by order_id), '') as slots from s group by 1 having count(*) > 1""",
)
def composed_tasks(spark, d):
    o = bind.order_payments(spark, d).filter("status = 'pending'")
    actions = F.array(F.lit("auth"), F.lit("user"), F.concat(F.lit("read "), "order_id"), F.concat(F.lit("write "), "order_id"))
    subs = o.select("user_id", F.col("order_id").alias("seq"), actions.alias("actions"), F.col("order_id").alias("target"), (F.col("n_payments") > 1).alias("expect_no_write"), F.lit("cancel").alias("tool"))
    c = t.composed(subs)
    return c.select("user_id", F.array_join("actions", ">").alias("actions"), F.array_join("targets", ",").alias("targets"), "expect_no_write", "max_turns", F.array_join("slots", ",").alias("slots"))


@CORE.query(
    "consent_slots",
    f"""select conv_id, turn, case when turn % 3 = 0 then 's0' when turn % 3 = 1 and conv_id % 2 = 0 then 's1' end as slot from conversations""",
)
def consent_slots(spark, d):
    c = bind.table(spark, d, "conversations")
    tool = F.when(F.col("turn") % 3 == 0, "cancel").when(F.col("turn") % 3 == 1, "exchange").otherwise("return")
    w = c.select("conv_id", "turn", tool.alias("tool"), F.concat(F.lit("order:"), F.col("conv_id")).alias("record"))
    own = c.select("conv_id").distinct()
    slot = lambda df, tool, name: df.select("conv_id", F.lit(tool).alias("tool"), F.concat(F.lit("order:"), F.col("conv_id")).alias("record"), F.lit(name).alias("slot"))
    slots = slot(own, "cancel", "s0").unionByName(slot(own.filter("conv_id % 2 = 0"), "exchange", "s1"))
    return t.consent_slots(w, slots).select("conv_id", "turn", "slot")


@CORE.query(
    "grounding_plan",
    f"""with m as (select user_id, min(order_id) as a, max(order_id) as z from {RO} o group by 1), t as (select u.user_id as id, 'I am ' || first || ' ' || last || ', zip ' || zip as text, u.zip, a, z from {US} u join m on m.user_id = u.user_id),
    h as (select id, any_value(a) as a, any_value(z) as z from t join {US} u using (zip) where contains(lower(text), lower(first)) and contains(lower(text), lower(last)) group by 1 having count(*) = 1),
    x as (select id, 3 as "at", 0 as rank, 'find_user_id_by_name_zip' as tool, cast(id as varchar) as argument from h union all select id, 3, 1, 'get_user_details', cast(id as varchar) from h
      union all select id, 3, 2, 'get_order_details', z from h where id % 2 = 1 union all select id, 5, 2, 'get_order_details', a from h where a <> z)
    select id, "at", cast(row_number() over (partition by id, "at" order by rank) as int) as seq, tool, argument from x""",
)
def grounding_plan(spark, d):
    """Each user tells who they are and names orders; the reads that the assistant's turns need."""
    u, o = bind.users(spark, d), bind.retail_orders(spark, d)
    mine = o.groupBy("user_id").agg(F.min("order_id").alias("a"), F.max("order_id").alias("z"))
    who = F.concat(F.lit("I am "), "first", F.lit(" "), "last", F.lit(", zip "), "zip")
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    said = F.array(
        turn("user", F.concat(F.lit("about "), "z")), turn("assistant", F.lit("Who are you?")), turn("user", who), turn("assistant", F.lit("I see.")),
        turn("user", F.concat(F.lit("and "), "a")), turn("assistant", F.concat(F.lit("On "), "a")),
    )
    turns = u.join(mine.hint("merge"), "user_id").select(F.col("user_id").alias("id"), F.posexplode(said).alias("i", "t")).select("id", "i", "t.role", "t.content")
    gold = mine.filter("user_id % 2 = 0").select(F.col("user_id").alias("id"), F.lit("get_order_details").alias("tool"), F.col("z").alias("argument"))
    return t.lookups(turns, u, o, gold)
