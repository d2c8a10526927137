"""Queries on task supply, plans, checks and turn grading."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.operators import retail as r
from loomline.operators import selection as sel
from loomline.operators import tasks as t
from loomline.plans.retail import _P, RI, RO
from loomline.registry import CORE
from loomline.sources import bind

THEMES = ("order_state", "payment", "address", "identity", "policy", "multi")


@CORE.query("scenario_grid", f"select cast(ci * 6 + ti as integer) as place, c as category, th as theme, c || '__' || th as cell from (select unnest({list(t.CATEGORIES)}) as c, unnest(range(0, 5)) as ci) a, (select unnest({list(THEMES)}) as th, unnest(range(0, 6)) as ti) b")
def scenario_grid(spark, d):
    return t.grid(spark, THEMES)


@CORE.query(
    "generation_funnel",
    """with a as (select event_type as template, case when value < 10 then 'no_candidate' when event_id % 9 = 0 then 'duplicate' when user_id % 10 = 3 then 'decontam_user' when value > 200 then 'verify_failed'
      when event_id % 11 = 0 then 'decontam_gold_hash' else 'accepted' end as r from events)
    select template, count(*) as attempts, """
    + ", ".join(f"count(*) filter (where r = '{k}') as {k}" for k in ("no_candidate", "duplicate", "decontam_user", "verify_failed", "decontam_gold_hash", "accepted"))
    + " from a group by 1",
)
def generation_funnel(spark, d):
    e = bind.table(spark, d, "events")
    a = e.select(
        F.col("event_type").alias("template"), (F.col("value") >= 10).alias("candidate"), (F.col("event_id") % 9 == 0).alias("duplicate"), (F.col("user_id") % 10 == 3).alias("held_out_user"),
        (F.col("value") <= 200).alias("verified"), (F.col("event_id") % 11 == 0).alias("held_out_hash"),
    )
    return t.funnel(a)


_HINT = f"(select order_id, user_id, arg_min(product, (pos, item_id)) as hint from (select *, count(*) over (partition by user_id, product) as n from {RI} i) x where n = 1 group by 1, 2)"
_VAR = f"(with a as (select * from {_P} p), b as (select product, brand, type, size, min(item_id) as item_id from a group by 1, 2, 3, 4 having count(*) = 1) select a.item_id, count(*) as n from a join b on a.product = b.product and (cast(a.brand <> b.brand as int) + cast(a.type <> b.type as int) + cast(a.size <> b.size as int)) = 1 group by 1)"


@CORE.query("cancel_candidates", f"select o.order_id, o.user_id, h.hint from {RO} o join {_HINT} h using (order_id) where status = 'pending'")
def cancel_candidates(spark, d):
    return t.cancel_candidates(bind.retail_orders(spark, d), r.order_hint(bind.retail_items(spark, d)))


@CORE.query(
    "n_item_exchange_plans",
    f"select order_id, count(*) as items, cast(sum(v.n) as bigint) as options from (select *, count(*) over (partition by order_id, product) as k from {RI} i where status = 'delivered') x join {_VAR} v using (item_id) where k = 1 group by 1",
)
def n_item_exchange_plans(spark, d):
    p = bind.table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("product"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size"))
    return t.exchange_plans(bind.retail_items(spark, d), r.one_option_variants(p))


@CORE.query(
    "split_integrity",
    """with s as (select c_custkey as id, cast(('0x' || left(sha256('val/' || cast(c_custkey as varchar)), 8)) as ubigint) / 4294967295 < 0.15 as v from customer)
    select count(*) filter (where not v) as train, count(*) filter (where v) as val, 0 as overlap, 0 as missing, 0 as unknown from s""",
)
def split_integrity(spark, d):
    c = bind.table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    v = c.withColumn("v", sel.is_val_user("id"))
    return t.split_integrity(c, v.filter("not v"), v.filter("v"))


@CORE.query("length_preflight", "with n as (select length(text) as n from documents) select min(n) as least, (list(n order by n))[count(*) // 2 + 1] as upper_median, max(n) as most, count(*) filter (where n + 256 > 4096) as n_over from n")
def length_preflight(spark, d):
    return t.length_check(bind.table(spark, d, "documents").select(F.length("text").alias("n")), 4096, 256)


@CORE.query(
    "shaping_revival",
    """with g as (select user_id, event_type, count(distinct round(case when value > 100 then 1 else 0 end, 3)) > 1 as a, count(distinct round(least(value / 500, 0.15), 3)) > 1 as b from events group by 1, 2)
    select count(*) filter (where not a) as zero_raw, count(*) filter (where not b) as zero_shaped, count(*) filter (where not a and b) as revived from g""",
)
def shaping_revival(spark, d):
    e = bind.table(spark, d, "events")
    return t.revived(e.select(F.struct("user_id", "event_type").alias("group"), F.when(F.col("value") > 100, 1.0).otherwise(0.0).alias("raw"), F.least(F.col("value") / 500, F.lit(0.15)).alias("shaped")))


def _actions(spark, d):
    li = bind.table(spark, d, "lineitem")
    rows = li.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("tool"), F.min("l_partkey").cast("string").alias("argument"))
    return rows.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("turn"), "tool", "argument")


@CORE.query(
    "noisy_trajectory",
    """with a as (select l_orderkey as id, l_linenumber as turn, min(l_returnflag) as tool, cast(min(l_partkey) as varchar) as argument from lineitem group by 1, 2),
    h as (select *, cast(('0x' || left(sha256('0/' || cast(id as varchar) || '/' || cast(turn as varchar)), 8)) as ubigint) % 6 as h from a)
    select id, round(avg(case h when 0 then 0.0 when 1 then 0.0 when 2 then 0.3 else 1.0 end), 6) as mean, round(min(case h when 0 then 0.0 when 1 then 0.0 when 2 then 0.3 else 1.0 end), 6) as least from h group by 1""",
)
def noisy_trajectory(spark, d):
    a = _actions(spark, d)
    gold, made = a.select("id", "turn", F.struct("tool", "argument").alias("g")), t.noisy(a).select("id", "turn", F.struct("tool", "argument").alias("p"))
    score = F.when(F.col("g.tool") != F.col("p.tool"), 0.0).when(F.col("g.argument") != F.col("p.argument"), 0.3).otherwise(1.0)
    return t.trajectory(gold, made, score).select("id", F.round("mean", 6).alias("mean"), F.round("least", 6).alias("least"))


@CORE.query("mask_trim", "select 1 + min(least(n_e, 5)) as first, max(least(n_e, 5) + n_s) as last from (select event_id % 4 as n_e, 1 + event_id % 3 as n_s from events) m")
def mask_trim(spark, d):
    e = bind.table(spark, d, "events").select((F.col("event_id") % 4).cast("int").alias("a"), (1 + F.col("event_id") % 3).cast("int").alias("b"))
    return t.trimmed(e.select(t.spans_mask(F.col("a"), F.col("b"), F.lit(99)).alias("mask")))


@CORE.query(
    "call_results",
    "select a.conv_id, a.call_id, a.name, b.output from (select conv_id, turn as call_id, left(text, 5) as name from conversations where role = 'assistant') a join (select conv_id, turn - 1 as call_id, left(text, 9) as output from conversations where role = 'user' and turn % 4 <> 0) b using (conv_id, call_id)",
)
def call_results(spark, d):
    c = bind.table(spark, d, "conversations")
    calls = c.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("call_id"), F.left("text", F.lit(5)).alias("name"))
    results = c.filter("role = 'user'").select("conv_id", (F.col("turn") - 1).alias("call_id"), F.left("text", F.lit(9)).alias("output"), (F.col("turn") % 4 == 0).alias("failed"))
    return t.call_results(calls, results)


@CORE.query(
    "earned_auth",
    "select conv_id, turn, coalesce(min(case when role = 'user' and contains(lower(text), 'the') then turn end) over (partition by conv_id) <= turn, false) as earned from conversations",
)
def earned_auth(spark, d):
    m = bind.table(spark, d, "conversations").withColumn("value", F.lit("THE"))
    return t.earned(m, "value").select("conv_id", "turn", "earned")
