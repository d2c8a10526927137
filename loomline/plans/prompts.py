"""Queries on prompts, tool registries and replay."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomline.operators import prompts as p
from loomline.operators import replay as rp
from loomline.plans.retail import RO
from loomline.registry import CORE
from loomline.sources import bind


@CORE.query(
    "training_examples",
    """select doc_id as id, 2 + case when doc_id % 3 = 0 then 1 else 0 end as n_messages, case when doc_id % 4 = 0 then null else 'get_order_details' end as expected_tool,
    case when doc_id % 4 = 0 then '{}' else '{"order_id":"' || cast(doc_id as varchar) || '"}' end as expected_arguments, case when doc_id % 4 = 0 then 'binary' else 'coarse' end as granularity from documents""",
)
def training_examples(spark, d):
    i = F.col("doc_id")
    call = F.array(F.struct(F.lit("get_order_details").alias("name"), F.to_json(F.struct(i.cast("string").alias("order_id"))).alias("arguments")))
    prior = F.when(i % 3 == 0, F.array(F.struct(F.lit("user").alias("role"), F.lit("hi").alias("content"))))
    s = bind.table(spark, d, "documents").select(i.alias("id"), prior.alias("prior_turns"), F.col("text").alias("user_message"), F.when(i % 4 != 0, call).otherwise(F.array().cast("array<struct<name:string,arguments:string>>")).alias("calls"))
    e = p.example(s, "be brief")
    return e.select("id", F.size("messages").alias("n_messages"), "expected_tool", "expected_arguments", p.granularity(F.col("expected_tool")).alias("granularity"))


@CORE.query("narratives", "select conv_id, sha256(string_agg(text, chr(10) order by turn) filter (where text <> '')) as narrative from conversations where role <> 'system' group by 1 having count(*) filter (where text <> '') > 0")
def narratives(spark, d):
    c = bind.table(spark, d, "conversations").filter("role <> 'system'")
    rows = F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    g = c.groupBy("conv_id").agg(F.transform(rows, lambda r: F.struct(r["role"].alias("role"), r["content"].alias("content"))).alias("t"))
    return g.select("conv_id", p.narrative(F.col("t"), F.lit("")).alias("n")).filter("n <> ''").select("conv_id", F.sha2("n", 256).alias("narrative"))


@CORE.query(
    "prompt_parity",
    """with t as (select case when doc_id % 2 = 0 then text || chr(10) || 'END' else text end as a, case when doc_id % 7 = 0 then text || ' ' else text end as b from documents),
    s as (select case when a like '%' || chr(10) || 'END' then a else a || chr(10) || 'END' end as a, case when b like '%' || chr(10) || 'END' then b else b || chr(10) || 'END' end as b from t) select count(*) as n, count(*) filter (where a = b) as same from s""",
)
def prompt_parity(spark, d):
    i, t = F.col("doc_id"), F.col("text")
    train, test = F.when(i % 2 == 0, F.concat(t, F.lit("\nEND"))).otherwise(t), F.when(i % 7 == 0, F.concat(t, F.lit(" "))).otherwise(t)
    return p.parity(bind.table(spark, d, "documents").select(p.with_suffix(train, "\nEND").alias("train"), p.with_suffix(test, "\nEND").alias("test")))


@CORE.query("context_budget", "select doc_id, case when length(text) // 4 + 256 > 1024 then 'context' else 'ok' end as finish from documents")
def context_budget(spark, d):
    t = bind.table(spark, d, "documents").select("doc_id", F.floor(F.length("text") / 4).alias("n_tokens"))
    return p.budget(t, 1024, 256).select("doc_id", "finish")


@CORE.query(
    "environment_delta",
    r"""with m as (select conv_id, turn, case when turn % 3 = 0 then 'user' else 'tool' end as role, text from conversations),
    w as (select *, coalesce(lag(role) over (partition by conv_id order by turn) = 'tool', false) as after, coalesce(lead(role) over (partition by conv_id order by turn) = 'tool', false) as before from m)
    select conv_id, turn, sha256(case when role = 'tool' then case when after then '' else '<|im_start|>user' end || chr(10) || '<tool_response>' || chr(10) || text || chr(10) || '</tool_response>' || case when before then '' else '<|im_end|>' || chr(10) end
      else '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) end) as delta from w""",
)
def environment_delta(spark, d):
    m = bind.table(spark, d, "conversations").withColumn("role", F.when(F.col("turn") % 3 == 0, "user").otherwise("tool"))
    return p.environment_delta(m).withColumn("delta", F.sha2("delta", 256))


@CORE.query(
    "first_difference",
    """with w as (select event_id, str_split(props, '') as a, str_split(lag(props) over (partition by user_id order by event_id), '') as b from events)
    select event_id, coalesce(list_min(list_filter(range(0, greatest(len(a), len(b))), lambda i: a[i + 1] is distinct from b[i + 1])), -1) as at from w where b is not null""",
)
def first_difference(spark, d):
    before = F.lag("props").over(W.partitionBy("user_id").orderBy("event_id"))
    e = bind.table(spark, d, "events").select("event_id", F.split("props", "").alias("a"), F.split(before, "").alias("b")).filter("b is not null")
    return e.select("event_id", p.first_difference(F.col("a"), F.col("b")).cast("long").alias("at"))


@CORE.query(
    "review_pages",
    "select cell, sha256('# ' || cell || chr(10) || chr(10) || string_agg('## ' || cast(id as varchar) || case when id % 7 = 0 then ' (flagged)' else '' end || chr(10) || chr(10) || '> ' || replace(text, chr(10), chr(10) || '> ') || chr(10), chr(10) order by id)) as page from (select doc_id as id, text, lang || '__' || source || '__' || cast(doc_id // 256 as varchar) as cell from documents) s group by 1",
)
def review_pages(spark, d):
    """Every document, on pages of 256 ids of a cell, so that a page is bounded."""
    part = F.floor(F.col("doc_id") / 256).cast("string")
    rows = bind.table(spark, d, "documents").select(F.concat_ws("__", "lang", "source", part).alias("cell"), F.col("doc_id").alias("id"), "text", (F.col("doc_id") % 7 == 0).alias("flagged"))
    return p.page(rows).select("cell", F.sha2("markdown", 256).alias("page"))


_TOOLS = "(values " + ", ".join(f"('{n}', {str(w).lower()}, {list(a)!r}::varchar[])" for n, (w, a) in rp.TOOLS.items()) + ") as s(tool, mutates, args)"


@CORE.query(
    "tool_registry_check",
    f"""with c as (select event_id, case event_id % 5 when 0 then 'open_door' when 1 then 'cancel_pending_order' when 2 then 'get_order_details' when 3 then 'modify_user_address' else 'calculate' end as tool,
      case event_id % 3 when 0 then ['order_id', 'reason'] when 1 then ['order_id', event_type] else ['expression', 'user_id', 'zip'] end as keys from events)
    select event_id, s.tool is not null as known, coalesce(mutates, false) as mutates, case when s.tool is not null then array_to_string(list_filter(keys, lambda k: not list_contains(args, k)), ',') end as unknown,
      case when s.tool is not null then array_to_string(list_filter(args, lambda k: not list_contains(keys, k)), ',') end as missing
    from c left join {_TOOLS} on c.tool = s.tool""",
)
def tool_registry_check(spark, d):
    i, x = F.col("event_id"), F.lit("x")
    tool = F.when(i % 5 == 0, "open_door").when(i % 5 == 1, "cancel_pending_order").when(i % 5 == 2, "get_order_details").when(i % 5 == 3, "modify_user_address").otherwise("calculate")
    made = lambda *ks: F.create_map(*(y for k in ks for y in (k if not isinstance(k, str) else F.lit(k), x)))
    args = F.when(i % 3 == 0, made("order_id", "reason")).when(i % 3 == 1, made("order_id", F.col("event_type"))).otherwise(made("expression", "user_id", "zip"))
    c = rp.checked(bind.table(spark, d, "events").select("event_id", tool.alias("tool"), args.alias("arguments")))
    return c.select("event_id", "known", "mutates", F.array_join("unknown", ",").alias("unknown"), F.array_join("missing", ",").alias("missing"))


def _steps(spark, d):
    li = bind.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("k"))
    tools = F.array(*map(F.lit, ("cancel_pending_order", "return_delivered_order_items", "exchange_delivered_order_items", "modify_pending_order_items")))
    steps = li.select(F.concat(F.lit("#W"), F.lpad(F.col("l_orderkey").cast("string"), 7, "0")).alias("order_id"), F.col("l_linenumber").alias("seq"), F.element_at(tools, (F.col("k") % 4 + 1).cast("int")).alias("tool"))
    return steps.join(bind.retail_orders(spark, d).select("order_id", "status"), "order_id")


_ALLOW = lambda s, k: f"case when {k} = 0 and {s} = 'pending' then 'cancelled' when {k} = 1 and {s} = 'delivered' then 'return requested' when {k} = 2 and {s} = 'delivered' then 'exchange requested' when {k} = 3 and {s} = 'pending' then 'pending (items modified)' else {s} end"
_STEP = f"(select s.*, o.status from (select '#W' || lpad(cast(l_orderkey as varchar), 7, '0') as order_id, l_linenumber as seq, min(l_partkey) % 4 as k from lineitem group by 1, 2) s join {RO} o using (order_id))"


@CORE.query(
    "replay_prefixes",
    f"""with recursive s as (select order_id, status, k, row_number() over (partition by order_id order by seq) as n from {_STEP} x),
    r as (select order_id, 0 as n, status as state from (select distinct order_id, status from s) y union all select r.order_id, s.n, {_ALLOW('r.state', 's.k')} from r join s on s.order_id = r.order_id and s.n = r.n + 1)
    select order_id, string_agg(state, '>' order by n) as states from r group by 1""",
)
def replay_prefixes(spark, d):
    return rp.prefixes(_steps(spark, d)).select("order_id", F.array_join("states", ">").alias("states"))


@CORE.query(
    "permuted_end_states",
    f"""with recursive s as (select order_id, status, k, row_number() over (partition by order_id order by seq) as n from {_STEP} x),
    r as (select order_id, status as state, cast(0 as bigint) as done, 0 as d from (select distinct order_id, status from s) y
      union select r.order_id, {_ALLOW('r.state', 's.k')}, r.done + (1 << (s.n - 1)), r.d + 1 from r join s on s.order_id = r.order_id and (r.done >> (s.n - 1)) & 1 = 0),
    t as (select order_id, count(*) as n from s group by 1)
    select order_id, string_agg(distinct state, ',' order by state) as finals from r join t using (order_id) where d = n group by 1""",
)
def permuted_end_states(spark, d):
    return rp.end_states(_steps(spark, d)).select("order_id", F.array_join("finals", ",").alias("finals"))


@CORE.query("held_out_users", f"select distinct user_id from (select item_id * 7 as user_id from benchmark where item_id % 2 = 0 union all select o.user_id from benchmark b join {RO} o on o.order_id = '#W' || lpad(cast(b.item_id as varchar), 7, '0')) u")
def held_out_users(spark, d):
    i = F.col("item_id")
    a = bind.table(spark, d, "benchmark").select(F.when(i % 2 == 0, i * 7).alias("user_id"), F.concat(F.lit("#W"), F.lpad(i.cast("string"), 7, "0")).alias("order_id"))
    return rp.touched_users(a, bind.retail_orders(spark, d))
