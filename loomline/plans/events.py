"""Queries on event streams and replayed conversations; the streams run over the tables as batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.operators import episodes
from loomline.registry import CORE
from loomline.sources import bind
from loomline.streaming import events as st


@CORE.query("stream_windows", "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def stream_windows(spark, d):
    return st.windows(bind.table(spark, d, "events")).withColumn("total", F.round("total", 4))


@CORE.query(
    "stream_sessions",
    """with g as (select *, case when ts - lag(ts) over w < interval 6 hours then 0 else 1 end as new from events window w as (partition by user_id order by ts, event_id)),
    s as (select *, sum(new) over (partition by user_id order by ts, event_id) as k from g)
    select user_id, min(ts) as start, max(ts) + interval 6 hours as "end", count(*) as n from s group by user_id, k""",
)
def stream_sessions(spark, d):
    return st.sessions(bind.table(spark, d, "events"))


@CORE.query("episode_fold")
def episode_fold(spark, d):
    return episodes.replay(bind.table(spark, d, "conversations"))


@CORE.query("consent_ledger")
def consent_ledger(spark, d):
    kinds = {"purchase": "success", "error": "failure", "signup": "fallback", "view": "revoke", "click": "yes"}
    event = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))[F.col("event_type")]
    e = bind.table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.concat(F.lit("s"), (F.col("event_id") % 3).cast("string")).alias("slot"), event.alias("event"))
    return episodes.consent_ledger(e)


@CORE.query("token_trace", r"select conv_id, cast(sum(case when role = 'assistant' then n else 0 end) as bigint) as n_sampled, cast(sum(case when role = 'assistant' then 0 else n end) as bigint) as n_env from (select conv_id, role, len(regexp_extract_all(text, '[^\t\n\v\f\r ]+')) as n from conversations) t group by 1")
def token_trace(spark, d):
    return episodes.token_trace(bind.table(spark, d, "conversations"))
