"""Queries on shaped, composite and memoised rewards, and on the small functions around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.functions import grading as G
from loomline.functions import predicates as P
from loomline.functions import text as T
from loomline.operators import prompts, replay, tasks
from loomline.registry import CORE
from loomline.sources import bind

_SHAPED = """(select event_id, user_id, least(case when event_id % 2 = 0 then 0.02 else 0 end + case when event_id % 3 = 0 then 0.03 else 0 end + case when event_id % 5 = 0 then 0.03 else 0 end + case when event_id % 7 = 0 then 0.02 else 0 end + case when event_id % 11 = 0 then 0.05 else 0 end,
  case when user_id % 4 = 0 then 0.05 else 0.15 end) - case when event_id % 6 > 1 then 0.05 else 0 end as shaped, least(value / 200, 1.0) as raw from events)"""


def _shaping():
    i = F.col("event_id")
    return G.shaping(i % 2 == 0, i % 3 == 0, i % 5 == 0, i % 7 == 0, i % 11 == 0, F.col("user_id") % 4 == 0, i % 6)


@CORE.query("shaped_rewards", f"select event_id, round(shaped, 6) as shaped from {_SHAPED} s")
def shaped_rewards(spark, d):
    return bind.table(spark, d, "events").select("event_id", F.round(_shaping(), 6).alias("shaped"))


@CORE.query("pooled_scores", f"select user_id, count(*) as n, round(avg(raw), 5) as raw, round(avg(shaped), 6) as shaped, round(max(raw), 5) as best from {_SHAPED} s group by 1")
def pooled_scores(spark, d):
    e = bind.table(spark, d, "events").select("user_id", F.least(F.col("value") / 200, F.lit(1.0)).alias("raw"), _shaping().alias("shaped"))
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("raw"), 5).alias("raw"), F.round(F.avg("shaped"), 6).alias("shaped"), F.round(F.max("raw"), 5).alias("best"))


@CORE.query(
    "composite_rewards",
    """select o_orderkey as id, round(case when o_orderkey % 3 = 0 and o_orderkey % 2 = 0 then greatest(0.4, 1 - (o_orderkey % 4) * 0.3) else least(0.3, 0.3 * (o_orderkey % 5) / greatest(o_orderkey % 6, 1) + case when o_orderkey % 7 = 0 then 0.05 else 0 end) end, 3) as reward from orders""",
)
def composite_rewards(spark, d):
    i = F.col("o_orderkey")
    return bind.table(spark, d, "orders").select(i.alias("id"), G.composite_reward(i % 3 == 0, i % 2 == 0, (i % 4) * 0.3, i % 5, i % 6, i % 7 == 0).alias("reward"))


@CORE.query("memoised_outcomes", "select e.event_id, o.v as outcome from events e left join (select user_id, event_type, max(value) as v from events where value > 100 group by 1, 2) o using (user_id, event_type)")
def memoised_outcomes(spark, d):
    e = bind.table(spark, d, "events")
    gold = e.filter("value > 100").groupBy("user_id", "event_type").agg(F.max("value").alias("outcome"))
    return replay.memoised(e.select("event_id", "user_id", "event_type"), gold, ("user_id", "event_type")).select("event_id", "outcome")


@CORE.query("list_matches", "select o_orderkey as id, case when o_orderkey % 3 = 0 then 1.0 when o_orderkey % 3 = 1 then 0.5 else 0.0 end as score from orders where o_custkey % 9 <> o_orderkey % 9")
def list_matches(spark, d):
    a, b = (F.col("a") % 9).cast("string"), (F.col("b") % 9).cast("string")
    o = bind.table(spark, d, "orders").select(F.col("o_orderkey").alias("b"), F.col("o_custkey").alias("a")).filter(a != b)
    pred = F.when(F.col("b") % 3 == 0, F.array(a, b)).when(F.col("b") % 3 == 1, F.array(b, a)).otherwise(F.array(a, a))
    return o.select(F.col("b").alias("id"), G.list_field(pred, F.array(a, b)).alias("score"))


@CORE.query("canonical_arguments", """select event_id, '{"a":"' || event_type || '","k":"' || user_id || '","z":"x"}' as arguments from events""")
def canonical_arguments(spark, d):
    m = F.create_map(F.lit("z"), F.lit("x"), F.lit("k"), F.col("user_id").cast("string"), F.lit("a"), F.col("event_type"))
    return bind.table(spark, d, "events").select("event_id", G.canonical(m).alias("arguments"))


@CORE.query("flat_groups", "select l_orderkey as id, max(abs(l_discount - 0.05)) <= 0.02 as flat from lineitem group by 1")
def flat_groups(spark, d):
    return bind.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(P.flat_at(F.col("l_discount"), 0.05, 0.02).alias("flat"))


_ENDS = ("truncated", "user_stop", "context_budget", "gave_up", "runner_error")


@CORE.query("masked_episodes", "select conv_id, turn, turn % 5 in (0, 2, 4) as masked from conversations")
def masked_episodes(spark, d):
    end = F.element_at(F.array(*map(F.lit, _ENDS)), (F.col("turn") % 5 + 1).cast("int"))
    return bind.table(spark, d, "conversations").select("conv_id", "turn", P.masked(end).alias("masked"))


@CORE.query("span_masks", "select event_id, left(repeat('0', cast(event_id % 5 as int)) || repeat('1', cast(user_id % 4 as int)), cast(event_id % 7 as int)) as mask from events")
def span_masks(spark, d):
    mask = tasks.spans_mask((F.col("event_id") % 5).cast("int"), (F.col("user_id") % 4).cast("int"), (F.col("event_id") % 7).cast("int"))
    return bind.table(spark, d, "events").select("event_id", F.array_join(F.transform(mask, lambda x: x.cast("string")), "").alias("mask"))


@CORE.query("reward_granularity", "select event_id, case when event_id % 6 < 2 then 'binary' when event_id % 6 = 5 then 'graded' when event_id % 6 = 2 then 'binary' else 'coarse' end as granularity from events")
def reward_granularity(spark, d):
    names = ("transfer_to_human_agents", "calculate", "cancel_pending_order", "get_order_details", "modify_pending_order_items")
    tool = F.get(F.array(*map(F.lit, names)), (F.col("event_id") % 6 - 1).cast("int"))
    return bind.table(spark, d, "events").select("event_id", prompts.granularity(tool).alias("granularity"))


@CORE.query("last_words", "select event_id, event_id % 4 = 1 as confirmed from events")
def last_words(spark, d):
    said = F.element_at(F.array(*map(F.lit, ("STOP", "Yes, go ahead. STOP", "Thank you, yes. STOP", "Yes, please proceed."))), (F.col("event_id") % 4 + 1).cast("int"))
    return bind.table(spark, d, "events").select("event_id", T.confirmed_and_stopped(said).alias("confirmed"))


@CORE.query("byte_tokens", "select doc_id, octet_length(encode(text)) as n_tokens, len(regexp_extract_all(text, 'th')) as n_special from documents")
def byte_tokens(spark, d):
    t = prompts.byte_ids(F.regexp_replace("text", "th", "\u0001"), {"\u0001": 256})
    return bind.table(spark, d, "documents").select("doc_id", (F.size(t) + F.regexp_count("text", F.lit("th"))).cast("long").alias("n_tokens"), F.size(F.filter(t, lambda x: x == 256)).cast("long").alias("n_special"))


@CORE.query("opening_bodies", "select user_id, 'I want to cancel order ' || user_id || '.' as body from (select distinct user_id from events)")
def opening_bodies(spark, d):
    hello = F.when(F.col("user_id") % 2 == 0, F.lit("Hi, I'm Ada Lovelace. ")).otherwise(F.lit("Hello! My email is a@b.cc. "))
    text = F.concat(hello, F.lit("I want to cancel order "), F.col("user_id").cast("string"), F.lit("."))
    return bind.table(spark, d, "events").select("user_id").distinct().select("user_id", T.opening_body(text).alias("body"))
