"""Queries on the retail database: task candidates and transitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.operators import retail as r
from loomline.registry import CORE, tree_sql
from loomline.sources import bind

RO, RI = bind.RETAIL_ORDERS, bind.RETAIL_ITEMS


@CORE.query("unique_identity", 'select c_custkey, count(*) over (partition by c_nationkey, c_mktsegment) = 1 as "unique" from customer')
def unique_identity(spark, d):
    return r.unique_identity(bind.table(spark, d, "customer"), ("c_nationkey", "c_mktsegment")).select("c_custkey", "unique")


@CORE.query("order_hint", f"select order_id, user_id, arg_min(product, (pos, item_id)) as hint from (select *, count(*) over (partition by user_id, product) as n from {RI} i) t where n = 1 group by 1, 2")
def order_hint(spark, d):
    return r.order_hint(bind.retail_items(spark, d))


_P = "(select p_partkey as item_id, p_name as product, p_brand as brand, p_type as type, p_size as size from part)"


@CORE.query(
    "one_option_variants",
    f"""with a as (select * from {_P} p), b as (select product, brand, type, size, min(item_id) as item_id from a group by 1, 2, 3, 4 having count(*) = 1)
    select a.item_id, b.item_id as other_id, case when a.brand <> b.brand then 'brand' when a.type <> b.type then 'type' else 'size' end as option,
      case when a.brand <> b.brand then a.brand when a.type <> b.type then a.type else cast(a.size as varchar) end as old,
      case when a.brand <> b.brand then b.brand when a.type <> b.type then b.type else cast(b.size as varchar) end as new
    from a join b on a.product = b.product and (cast(a.brand <> b.brand as int) + cast(a.type <> b.type as int) + cast(a.size <> b.size as int)) = 1""",
)
def one_option_variants(spark, d):
    p = bind.table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("product"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size"))
    return r.one_option_variants(p)


@CORE.query("status_refusal_candidates", f"select order_id, user_id, status, 'cancel' as action from {RO} o where status in ('delivered', 'processed') union all select order_id, user_id, status, 'return' from {RO} o where status in ('pending', 'processed')")
def status_refusal_candidates(spark, d):
    o = bind.retail_orders(spark, d).select("order_id", "user_id", "status")
    return r.status_refusals(o, "cancel").unionByName(r.status_refusals(o, "return"))


_K = lambda c: f"sha256('foreign/' || cast({c} as varchar))"


@CORE.query(
    "foreign_order_candidates",
    f"""with u as (select c_custkey as user_id, {_K('c_custkey')} as uh from customer), o as (select order_id, user_id as owner, {_K('order_id')} as oh from {RO} x)
    select user_id, coalesce(arg_min(order_id, oh) filter (where oh > uh), arg_min(order_id, oh)) as order_id from u join o on owner <> user_id group by 1""",
)
def foreign_order_candidates(spark, d):
    return r.foreign_orders(bind.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")), bind.retail_orders(spark, d))


@CORE.query(
    "refund_totals",
    f"""with i as (select *, row_number() over (partition by order_id order by pos, item_id) as r from {RI} i where status = 'delivered')
    select order_id, round(sum(price) filter (where r <= 2), 2) as total, round(sum(price), 2) as distractor from i group by 1 having count(*) >= 2""",
)
def refund_totals(spark, d):
    return r.refund_totals(bind.retail_items(spark, d)).select("order_id", F.round("total", 2).alias("total"), F.round("distractor", 2).alias("distractor"))


@CORE.query("compose_pairs", f"select x.user_id, x.order_id as a, y.order_id as b from {RO} x join {RO} y on x.user_id = y.user_id and x.order_id < y.order_id and x.status = 'pending' and y.status = 'pending'")
def compose_pairs(spark, d):
    return r.composable(bind.retail_orders(spark, d).filter("status = 'pending'"))


@CORE.query(
    "unique_owner",
    f"""with m as (select doc_id as mention_id, '#W' || lpad(cast(doc_id as varchar), 7, '0') as order_id from documents union all select doc_id, '#W' || lpad(cast(doc_id + doc_id % 3 as varchar), 7, '0') from documents)
    select mention_id, case when count(distinct user_id) = 1 then min(user_id) end as owner from m join {RO} o using (order_id) group by 1""",
)
def unique_owner(spark, d):
    docs = bind.table(spark, d, "documents")
    named = lambda c: F.concat(F.lit("#W"), F.lpad(c.cast("string"), 7, "0"))
    i = F.col("doc_id")
    m = docs.select(i.alias("mention_id"), F.explode(F.array(named(i), named(i + i % 3))).alias("order_id"))
    return r.unique_owner(m, bind.retail_orders(spark, d))


@CORE.query("own_orders", f"select user_id, array_to_string(list(order_id order by order_id), ',') as orders from {RO} o where status = 'pending' group by 1")
def own_orders(spark, d):
    return r.own_orders(bind.retail_orders(spark, d), "pending").select("user_id", F.array_join("orders", ",").alias("orders"))


@CORE.query("order_reads", f"select user_id, order_id, row_number() over (partition by user_id order by order_id) as reads from {RO} o")
def order_reads(spark, d):
    o = bind.retail_orders(spark, d)
    return r.own_orders(o).select("user_id", "orders", F.explode("orders").alias("order_id")).select("user_id", "order_id", F.size(r.reads_until(F.col("orders"), F.col("order_id"))).alias("reads"))


@CORE.query("cancel_orders", f"select order_id, case when status = 'pending' and user_id % 3 <> 0 then 'cancelled' else status end as status, case when status = 'pending' and user_id % 3 <> 0 then total else 0 end as refund from {RO} o")
def cancel_orders(spark, d):
    reason = F.when(F.col("user_id") % 3 == 0, "changed my mind").when(F.col("user_id") % 3 == 1, "no longer needed").otherwise("ordered by mistake")
    return r.cancelled(bind.retail_orders(spark, d), reason).select("order_id", "status", "refund")


@CORE.query("return_orders", f"select order_id, case when status = 'delivered' then 'return requested' else status end as status, status = 'delivered' as ok from {RO} o")
def return_orders(spark, d):
    return r.requested(bind.retail_orders(spark, d), "return").select("order_id", "status", "ok")


@CORE.query("modify_items", f"select order_id, pos, item_id, case when status = 'pending' then last_value(price) over (partition by order_id order by pos, item_id rows between unbounded preceding and unbounded following) else price end as price from {RI} i where (order_id, pos, item_id) in (select order_id, pos, item_id from {RI} j group by all having count(*) = 1)")
def modify_items(spark, d):
    i = bind.retail_items(spark, d)
    once = i.groupBy("order_id", "pos", "item_id").agg(F.count("*").alias("_n"), F.max("price").alias("price"), F.max("status").alias("status")).filter("_n = 1")
    return r.modified(once).select("order_id", "pos", "item_id", "price")


@CORE.query("state_overlay", f"select status, count(*) as n from (select case when status = 'pending' and user_id % 2 = 0 then 'cancelled' else status end as status from {RO} o) t group by 1")
def state_overlay(spark, d):
    o = bind.retail_orders(spark, d)
    delta = r.cancelled(o.filter("user_id % 2 = 0 and status = 'pending'"), F.lit("no longer needed")).select(o.columns)
    return r.overlay(o, delta, "order_id").groupBy("status").agg(F.count("*").alias("n"))


@CORE.query("end_state_hash", f"""select root as state_hash from {tree_sql(f"select sha256(order_id || '|' || status) as hash from {RO} o")}""")
def end_state_hash(spark, d):
    return r.state_hash(r.record_hashes(bind.retail_orders(spark, d), "order_id", ("order_id", "status")))
