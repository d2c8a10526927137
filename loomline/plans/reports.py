"""Queries on diagnoses, report totals and filters of pools."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.operators import reports as rp
from loomline.operators import stats
from loomline.plans.analytics import GS
from loomline.registry import CORE
from loomline.sources import bind

_GOLD = "(select distinct scenario_id, 'tool' || length(scenario_id) % 3 as gold_tool from {g} g where length(scenario_id) % 5 <> 0)"
_DIAG = f"""(select g.category, d.gold_tool, case when g.sample % 4 = 0 then null else 'tool' || g.sample % 3 end as pred_tool, case when g.sample % 2 = 0 then 'args' else 'schema' end as reason,
  case when g.sample % 3 = 0 then ['id', 'zip'] when g.sample % 3 = 1 then ['id'] else [] end as missing, case when g.sample % 5 = 0 then ['note'] else [] end as extra, ['k' || g.sample % 11 || ':int'] as typed
  from {bind.SCORE_GROUPS} g join {_GOLD.format(g=bind.SCORE_GROUPS)} d using (scenario_id) where scenario_id in (select scenario_id from {GS} s where abs(lo) <= 0.45 and abs(hi) <= 0.45))"""


@CORE.query(
    "stuck_diagnosis",
    f"""with f as (select 'category' as kind, category as value from {_DIAG} a union all select 'gold_tool', gold_tool from {_DIAG} a union all select 'reason', reason from {_DIAG} a
      union all select 'pred_tool', coalesce(pred_tool, '(no call)') from {_DIAG} a where pred_tool is distinct from gold_tool union all select 'missing', unnest(missing) from {_DIAG} a union all select 'extra', unnest(extra) from {_DIAG} a
      union all select 'typed', unnest(typed) from {_DIAG} a), n as (select kind, value, count(*) as n from f group by 1, 2)
    select kind, value, n from n qualify row_number() over (partition by kind order by n desc, value) <= case kind when 'pred_tool' then 10 when 'missing' then 8 when 'extra' then 8 when 'typed' then 8 else 1000 end""",
)
def stuck_diagnosis(spark, d):
    g = bind.score_groups(spark, d)
    gold = g.select("scenario_id").distinct().filter(F.length("scenario_id") % 5 != 0).withColumn("gold_tool", F.concat(F.lit("tool"), (F.length("scenario_id") % 3).cast("string")))
    s, none = F.col("sample"), F.array().cast("array<string>")
    made = g.select(
        "scenario_id", "category", F.when(s % 4 != 0, F.concat(F.lit("tool"), (s % 3).cast("string"))).alias("pred_tool"), F.when(s % 2 == 0, "args").otherwise("schema").alias("reason"),
        F.when(s % 3 == 0, F.array(F.lit("id"), F.lit("zip"))).when(s % 3 == 1, F.array(F.lit("id"))).otherwise(none).alias("missing"), F.when(s % 5 == 0, F.array(F.lit("note"))).otherwise(none).alias("extra"),
        F.array(F.concat(F.lit("k"), (s % 11).cast("string"), F.lit(":int"))).alias("typed"),
    )
    return rp.diagnosis(rp.band(made, gold, stats.group_stats(g), 0.0, 0.45))


_SEV = "case when toxic = 1 then 'major' when quality = 0 then 'minor' else 'none' end"


@CORE.query("judge_report_totals", f"select case doc_id % 3 when 0 then 'a' when 1 then 'b' else 'c' end as cell, count(*) as n, count(*) filter (where {_SEV} = 'major') as major, count(*) filter (where {_SEV} = 'minor') as minor, count(*) filter (where {_SEV} <> 'none') as flagged, cast(sum((quality = 0)::int + (toxic = 1)::int) as bigint) as issues from labels group by rollup (cell)")
def judge_report_totals(spark, d):
    la = bind.table(spark, d, "labels")
    sev = F.when(F.col("toxic") == 1, "major").when(F.col("quality") == 0, "minor").otherwise("none")
    issues = F.array_compact(F.array(F.when(F.col("quality") == 0, "low"), F.when(F.col("toxic") == 1, "toxic")))
    k = F.col("doc_id") % 3
    return rp.report_totals(la.select(F.when(k == 0, "a").when(k == 1, "b").otherwise("c").alias("cell"), sev.alias("severity"), issues.alias("issues")), "cell")


@CORE.query("difficulty_summary", "with s as (select o_orderpriority as category, round(o_totalprice / 600000, 6) as score, case when o_totalprice < 150000 then 'easy' when o_totalprice < 300000 then 'medium' else 'hard' end as label from orders) select 'label' as kind, label as key, count(*) as n, round(avg(score), 4) as mean, min(score) as least, max(score) as most from s group by 2 union all select 'category', category, count(*), round(avg(score), 4), min(score), max(score) from s group by 2")
def difficulty_summary(spark, d):
    p = F.col("o_totalprice")
    s = bind.table(spark, d, "orders").select(F.col("o_orderpriority").alias("category"), F.round(p / 600000, 6).alias("score"), F.when(p < 150000, "easy").when(p < 300000, "medium").otherwise("hard").alias("label"))
    return rp.difficulty_totals(s).withColumn("mean", F.round("mean", 4))


_MIX = {"purchase": 0.4, "view": 0.3, "click": 0.2, "signup": 0.1}


@CORE.query(
    "simulated_mix",
    f"""with g as (select scenario_id as id, category, theme, class, {' '.join(['case category', *(f"when '{k}' then {v}" for k, v in _MIX.items()), 'end'])} as share from {GS} s), c as (select category, share, count(*) as avail from g where share is not null group by 1, 2),
    t as (select category, round_even(min(avail / share) over () * share, 0) as target from c), r as (select g.*, row_number() over (partition by category, theme order by sha256('0/' || id), id) as r from g where share is not null),
    k as (select id from r join t using (category) qualify row_number() over (partition by category order by r, theme) <= target)
    select category, class, count(*) as before, count(*) filter (where id in (select id from k)) as after from g group by grouping sets ((category, class), (class), ())""",
)
def simulated_mix(spark, d):
    g = stats.group_stats(bind.score_groups(spark, d)).select(F.col("scenario_id").alias("id"), "category", "theme", "class")
    return rp.simulated_mix(g, _MIX)


@CORE.query(
    "training_sets",
    f"""with k as (select id, category, theme from {bind.SCENARIOS} s where id not in (select doc_id from labels where quality = 0)), n as (select *, count(*) over (partition by category, theme) as n, row_number() over (partition by category, theme order by sha256('0/' || cast(id as varchar)), id) as r from k)
    select id, case when r <= (case when n >= 2 then least(greatest(round_even(n * 0.1, 0), 1), n - 1) else round_even(n * 0.1, 0) end) then 'val' else 'train' end as part from n""",
)
def training_sets(spark, d):
    out = rp.training_sets(bind.scenarios(spark, d).select("id", "category", "theme"), bind.table(spark, d, "labels").filter("quality = 0").select(F.col("doc_id").alias("id")), None, 0.1)
    return out.select("id", "part")


@CORE.query("split_rows", "select doc_id as id, case when doc_id % 5 = 0 then 'val' else 'train' end as part from documents where doc_id % 5 <> 0 and doc_id not in (select doc_id from labels where toxic = 1)")
def split_rows(spark, d):
    i = F.col("doc_id")
    bad = bind.table(spark, d, "labels").filter("toxic = 1").select("doc_id", F.lit(True).alias("bad"))
    parts = bind.table(spark, d, "documents").join(bad, "doc_id", "left").select(i.alias("id"), F.when(i % 5 == 0, "val").otherwise("train").alias("part"), F.coalesce("bad", F.lit(False)).alias("excluded"))
    return rp.selected(parts, "train").select("id", "part")


@CORE.query("picked_tasks", "select scenario_id as id, template from (select distinct event_type || '__' || user_id as scenario_id, event_type as template, user_id from events) t where (scenario_id like 'view__1%' or scenario_id like 'click__2%') and template in ('view', 'click', 'error') and user_id in (select c_custkey from customer where c_nationkey < 20)".replace("__", "--"))
def picked_tasks(spark, d):
    e = bind.table(spark, d, "events").select(F.concat("event_type", F.lit("--"), "user_id").alias("id"), F.col("event_type").alias("template")).distinct()
    u = bind.table(spark, d, "customer").filter("c_nationkey < 20").select(F.col("c_custkey").alias("u"))
    ids = u.select("u", F.explode(F.array(F.lit("view"), F.lit("click"), F.lit("error"))).alias("t")).select(F.concat("t", F.lit("--"), "u").alias("id"))
    return rp.picked(e, ("view--1", "click--2"), ids, ("view", "click", "error"))


@CORE.query("turn_prefixes", "select a.conv_id, a.turn, sha256(coalesce(string_agg(b.role || ':' || b.text, chr(10) order by b.turn), '')) as said from conversations a left join conversations b on b.conv_id = a.conv_id and b.turn < a.turn where a.role = 'assistant' group by 1, 2")
def turn_prefixes(spark, d):
    c = bind.table(spark, d, "conversations")
    turns = c.filter("role = 'assistant'").select(F.col("conv_id").alias("task"), F.lit(0).alias("sample"), F.col("turn").alias("m"))
    out = rp.prefixes(turns, c.select(F.col("conv_id").alias("task"), F.lit(0).alias("sample"), F.col("turn").alias("pos"), "role", F.col("text").alias("content")))
    said = F.array_join(F.transform("said", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "\n")
    return out.select(F.col("task").alias("conv_id"), F.col("m").alias("turn"), F.sha2(said, 256).alias("said"))


@CORE.query("supported_config", "select event_id, array_to_string(list_sort(list_filter(['beta', 'k', event_type], lambda x: x in ('beta', 'k', 'view'))), ',') as kept, array_to_string(list_sort(list_filter(['beta', 'k', event_type], lambda x: x not in ('beta', 'k', 'view'))), ',') as dropped, case when user_id % 3 > 0 then user_id % 3 end as top_k from events")
def supported_config(spark, d):
    x = F.lit("x")
    config = F.create_map(F.lit("beta"), x, F.lit("k"), x, F.col("event_type"), x)
    kept, dropped = rp.supported(config, ("beta", "k", "view"))
    e = bind.table(spark, d, "events")
    return e.select("event_id", F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("kept"), F.array_join(dropped, ",").alias("dropped"), rp.top_k(F.col("user_id") % 3).alias("top_k"))


@CORE.query("id_values", """select event_id, array_to_string(list_filter([case when event_id % 3 = 0 then 'u' || user_id end, case when event_id % 2 = 0 then 'a' when event_id % 5 = 0 then null else cast(event_id as varchar) end, case when event_id % 2 = 0 then 'b' end], lambda x: x is not null), ',') as ids from events""")
def id_values(spark, d):
    i = F.col("event_id")
    items = F.when(i % 2 == 0, '"item_ids":["a","b"]').when(i % 5 == 0, '"item_ids":true').otherwise(F.concat(F.lit('"item_id":'), i.cast("string")))
    args = F.concat(F.lit("{"), F.when(i % 3 == 0, F.concat(F.lit('"user_id":"u'), F.col("user_id").cast("string"), F.lit('",'))).otherwise(""), items, F.lit(',"note":"n"}'))
    return bind.table(spark, d, "events").select("event_id", F.array_join(rp.id_values(args, ("user_id", "item_id")), ",").alias("ids"))


@CORE.query("open_fields", "select event_id, coalesce(json_extract_string(case when event_id % 4 = 0 then null else props end, '$.k'), 'none') as k from events")
def open_fields(spark, d):
    doc = F.when(F.col("event_id") % 4 == 0, F.when(F.col("event_id") % 8 == 0, "{nope")).otherwise(F.col("props"))
    return bind.table(spark, d, "events").select("event_id", rp.field_or(doc, "$.k", "none").alias("k"))
