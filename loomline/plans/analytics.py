"""Queries on score groups, cells, audits and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomline.functions import predicates as P
from loomline.operators import evalx, rollup, stats
from loomline.operators.stats import r6
from loomline.registry import CORE
from loomline.sources import bind

#: A mixture prior over the event types, by which categories matter.
RELEVANCE = {"purchase": 0.36, "click": 0.36, "view": 0.15, "signup": 0.08, "error": 0.05}

GS = f"""(select *, std >= 0.05 - 1e-9 as effective, mean >= 0.95 - 1e-9 as solved, n_distinct > 1 as any_variance,
  case when n = 0 then 'empty' when hi - lo > 1e-3 then 'usable' when first_score <= 1e-3 then 'cold_start'
    when first_score >= 1 - 1e-3 then 'already_solved' else 'stuck_partial' end as class
  from (select scenario_id, category, theme, count(score) as n, sum(score) as total, avg(score) as mean, coalesce(stddev_samp(score), 0) as std,
    coalesce(stddev_pop(score), 0) as std_pop, min(score) as lo, max(score) as hi, arg_min(score, sample) as first_score,
    count(distinct round(score, 3)) as n_distinct from {bind.SCORE_GROUPS} g group by all) s)"""
CELLS = f"""(select *, usable / n as any_yield, n_effective / n as yld, greatest(0, 1 - mean) as headroom, n_effective / n * greatest(0, 1 - mean) as signal from
  (select category, theme, count(*) as n, sum(total) / sum(n) as mean, count(*) filter (where class = 'usable') as usable,
   count(*) filter (where class = 'cold_start') as cold_start, count(*) filter (where class = 'already_solved') as already_solved,
   count(*) filter (where class = 'stuck_partial') as stuck_partial, count(*) filter (where effective) as n_effective from {GS} t group by 1, 2) c)"""


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return stats.group_stats(bind.score_groups(spark, d))


@CORE.query("group_std", f"select scenario_id, n, round(mean, 6) as mean, round(std, 6) as std, round(std_pop, 6) as std_pop from {GS} t")
def group_std(spark, d):
    return _groups(spark, d).select("scenario_id", "n", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"), r6(F.col("std_pop")).alias("std_pop"))


@CORE.query(
    "classify_groups",
    f"""select scenario_id, class, case when class = 'stuck_partial' then 'stuck_partial (' || cast(round(first_score, 2) as varchar) || ')' else class end as bucket from {GS} t""",
)
def classify_groups(spark, d):
    return _groups(spark, d).select("scenario_id", "class", stats.bucket_label().alias("bucket"))


@CORE.query("effective_variance", f"select scenario_id, effective, solved, any_variance from {GS} t")
def effective_variance(spark, d):
    return _groups(spark, d).select("scenario_id", "effective", "solved", "any_variance")


@CORE.query("lacks_gradient_ids", f"select scenario_id from {GS} t where not effective and not solved")
def lacks_gradient_ids(spark, d):
    return stats.lacks_gradient(_groups(spark, d)).select("scenario_id")


@CORE.query(
    "cell_scorecard",
    f"""select category, theme, n, round(mean, 6) as mean, usable, cold_start, already_solved, stuck_partial, n_effective, round(yld, 6) as yield,
    round(any_yield, 6) as any_yield, round(headroom, 6) as headroom, round(signal, 6) as signal, yld < 0.25 as low_yield from {CELLS} c""",
)
def cell_scorecard(spark, d):
    c = stats.cells(_groups(spark, d))
    return c.withColumns({k: r6(F.col(k)) for k in ("mean", "yield", "any_yield", "headroom", "signal")})


@CORE.query("category_signal", f"select category, round(sum(signal * n) / sum(n), 6) as signal from {CELLS} c group by 1")
def category_signal(spark, d):
    return stats.category_signal(stats.cells(_groups(spark, d))).select("category", r6(F.col("signal")).alias("signal"))


_REL = "case category " + " ".join(f"when '{k}' then {v}" for k, v in RELEVANCE.items()) + " else 0 end"


@CORE.query(
    "recommend_mix",
    f"""with s as (select category, sum(signal * n) / sum(n) as signal, {_REL} as rel from {CELLS} c group by 1),
    m as (select *, signal * rel as raw, sum(signal * rel) over () as total, sum(rel) over () as rel_total from s),
    f as (select *, greatest(raw / nullif(total, 0), 0.03) as fl from m)
    select category, case when total <= 0 then rel / rel_total else round(fl / sum(fl) over (), 4) end as share from f""",
)
def recommend_mix(spark, d):
    return stats.recommend_mix(stats.category_signal(stats.cells(_groups(spark, d))), RELEVANCE)


_DISC = f"""(select l_shipmode as category, k % 40 as theme, count(*) filter (where sd >= 0.05 - 1e-9) / count(*) as yld from (select l_orderkey as k, l_returnflag as l_shipmode, coalesce(stddev_samp(l_discount), 0) as sd from lineitem group by 1, 2) t group by 1, 2)"""


@CORE.query("low_yield_cells", f"select category, theme from {_DISC} c where yld < 0.25")
def low_yield_cells(spark, d):
    """Cells of orders' lines of one flag: most groups have few lines, so many cells yield little."""
    li = bind.table(spark, d, "lineitem")
    rows = li.select(F.concat_ws("/", "l_orderkey", "l_returnflag").alias("scenario_id"), F.col("l_returnflag").alias("category"), (F.col("l_orderkey") % 40).alias("theme"), F.col("l_linenumber").alias("sample"), F.col("l_discount").alias("score"))
    return stats.cells(stats.group_stats(rows)).filter("low_yield").select("category", "theme")


_VS = """count(*) as n, count(*) filter (where not any_variance) as zero, count(*) filter (where effective) as effective,
  count(*) - count(*) filter (where not any_variance) - count(*) filter (where effective) as micro,
  round(count(*) filter (where not any_variance) / count(*), 6) as zero_share, round(count(*) filter (where effective) / count(*), 6) as effective_share"""


def _rounded(v: DataFrame) -> DataFrame:
    return v.withColumns({k: r6(F.col(k)) for k in ("zero_share", "effective_share")})


@CORE.query("variance_summary", f"select {_VS} from {GS} t")
def variance_summary(spark, d):
    return _rounded(stats.variance_summary(_groups(spark, d)))


@CORE.query(
    "variance_by_label",
    f"""select case when coalesce(l.blocked, false) then 'label_defect' else 'clean' end as status, {_VS}
    from {GS} t left join {bind.LABEL_AUDIT} l on l.id = cast(split_part(scenario_id, '__', 3) as bigint) group by 1""",
)
def variance_by_label(spark, d):
    g = _groups(spark, d).withColumn("id", F.element_at(F.split("scenario_id", "__"), 3).cast("long"))
    audit = bind.label_audit(spark, d).select("id", (F.size("blocking") > 0).alias("blocked"))
    status = F.when(F.coalesce("blocked", F.lit(False)), "label_defect").otherwise("clean")
    return _rounded(stats.variance_summary(g.join(audit, "id", "left").withColumn("status", status), ("status",)))


@CORE.query("score_histogram", f"select round(score, 1) as bucket, count(*) as n from {bind.SCORE_GROUPS} g group by 1")
def score_histogram(spark, d):
    return stats.histogram(bind.score_groups(spark, d))


@CORE.query(
    "bucket_report",
    f"""with b as (select category, case when class = 'stuck_partial' then 'stuck_partial (' || cast(round(first_score, 2) as varchar) || ')' else class end as bucket from {GS} t)
    select bucket, category, count(*) as n from b group by grouping sets ((bucket), (bucket, category))""",
)
def bucket_report(spark, d):
    b = _groups(spark, d).withColumn("bucket", stats.bucket_label())
    return b.groupingSets([["bucket"], ["bucket", "category"]], "bucket", "category").agg(F.count("*").alias("n"))


@CORE.query(
    "group_advantage",
    f"""select task_id, sample, tie, round(reward - avg(reward) over g, 6) + 0.0 as advantage,
    case when max(reward) over g - min(reward) over g <= 1e-9 and count(reward) over g = count(*) over g then 0 else 1 end as mask
    from {bind.DISCOUNT_GROUPS} r window g as (partition by task_id)""",
)
def group_advantage(spark, d):
    a = stats.advantages(bind.discount_groups(spark, d))
    return a.select("task_id", "sample", "tie", (r6(F.col("advantage")) + 0.0).alias("advantage"), "mask")


@CORE.query(
    "rollout_stats",
    f"""with g as (select task_id, count(*) as n, count(reward) as j, max(reward) as hi, min(reward) as lo from {bind.DISCOUNT_GROUPS} r group by 1)
    select count(*) as groups, count(*) filter (where n = 4 and j = n) as complete, count(*) filter (where n = 4 and j = n and hi - lo <= 1e-9) as flat, cast(sum(n) as bigint) as episodes from g""",
)
def rollout_stats(spark, d):
    return rollup.rollout(bind.discount_groups(spark, d), 4)


_REC = f"""(select *, std >= 0.05 - 1e-9 as effective, nd = 1 as flat from (select task_id, template, any_value(props) as props, count(*) as n, avg(reward) as mean, coalesce(stddev_pop(reward), 0) as std,
  avg(cast(success as int)) as success_rate, min(reward) as lo, max(reward) as hi, bool_and(success) as all_ok, bool_or(success) as any_ok, count(distinct reward) as nd
  from (select user_id as task_id, event_type as template, first_value(props) over (partition by user_id, event_type order by ts, event_id) as props,
    least(floor(value / 50) / 10, 1.0) as reward, value >= 100 as success from events) e group by 1, 2) s)"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    e = bind.table(spark, d, "events")
    first = F.first("props").over(W.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    rows = e.select(
        F.col("user_id").alias("task_id"), F.col("event_type").alias("template"), first.alias("props"),
        F.least(F.floor(F.col("value") / 50) / 10, F.lit(1.0)).alias("reward"), (F.col("value") >= 100).alias("success"),
    )
    return rollup.records(rows, ("task_id", "template", "props")).withColumn("difficulty", F.from_json("props", "map<string,string>"))


_SUM = """count(*) as tasks, round(avg(mean), 6) as mean, round(avg(success_rate), 6) as success, round(avg(cast(effective as int)), 6) as effective, round(avg(cast(flat as int)), 6) as flat"""


@CORE.query(
    "audit_rollup",
    f"""select null as knob, null as value, template, {_SUM} from {_REC} r group by rollup (template)
    union all select 'k' as knob, json_extract_string(props, '$.k') as value, template, {_SUM} from {_REC} r group by all""",
)
def audit_rollup(spark, d):
    return rollup.audit(_records(spark, d))


_CLASS = "case when n < 2 then 'unjudged' when hi - lo > 1e-9 then 'live' when all_ok then 'solved' when not any_ok then 'dead' else 'flat_other' end"


@CORE.query("classify_audit_records", f"select task_id, template, {_CLASS} as class from {_REC} r")
def classify_audit_records(spark, d):
    c = P.record_class(F.col("n"), F.col("lo"), F.col("hi"), F.col("all_ok"), F.col("any_ok"))
    return _records(spark, d).select("task_id", "template", c.alias("class"))


@CORE.query(
    "val_summary_rollup",
    """select event_type as template, count(*) as n, round(avg(value / 500), 6) as mean, round(avg(cast(value >= 100 as int)), 6) as success
    from events where value >= 10 group by rollup (event_type)""",
)
def val_summary_rollup(spark, d):
    e = bind.table(spark, d, "events").select(F.col("event_type").alias("template"), F.when(F.col("value") >= 10, F.col("value") / 500).alias("reward"), (F.col("value") >= 100).alias("success"))
    return rollup.validation(e)


@CORE.query("trajectory_score", "select user_id as episode_id, round(coalesce(avg(value), 0), 6) as mean, coalesce(min(value), 0) as least from events group by 1")
def trajectory_score(spark, d):
    t = rollup.trajectory(bind.table(spark, d, "events").select(F.col("user_id").alias("episode_id"), F.col("value").alias("score")))
    return t.withColumn("mean", r6(F.col("mean")))


@CORE.query(
    "moving_average",
    """with s as (select date_trunc('day', ts) as day, event_type as metric, count(*) as n from events group by 1, 2)
    select cast(day as date) as day, metric, n, round(avg(n) over (partition by metric order by day rows between 9 preceding and current row), 6) as smoothed from s""",
)
def moving_average(spark, d):
    s = bind.table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("metric")).agg(F.count("*").alias("n"))
    return stats.moving_average(s, "day", "n", 10, ("metric",)).withColumn("smoothed", r6(F.col("smoothed")))


@CORE.query(
    "pass_hat_k",
    f"""with t as (select task_id, trial, bool_or(success) as success from {bind.SIMULATIONS} s group by 1, 2),
    c as (select task_id, count(*) as n, count(*) filter (where success) as c from t group by 1),
    k as (select unnest(range(1, 1 + (select min(n) from c))) as k)
    select k, round(avg(case when c.c < k then 0 else (select product((c.c - i) / (c.n - i)) from unnest(range(0, k)) as r(i)) end), 4) as pass_k from c, k group by 1""",
)
def pass_hat_k(spark, d):
    t = bind.simulations(spark, d).groupBy("task_id", "trial").agg(F.bool_or("success").alias("success"))
    return evalx.pass_hat(t)


@CORE.query(
    "run_summary",
    f"""select termination, count(*) as n, round(sum(value), 2) as tokens, round(date_diff('second', min(date_trunc('second', ts)), max(date_trunc('second', ts))) / 60, 4) as minutes from {bind.SIMULATIONS} s group by rollup (termination)""",
)
def run_summary(spark, d):
    return evalx.run_summary(bind.simulations(spark, d))


@CORE.query(
    "sign_test_pairs",
    f"""with t as (select task_id, avg(cast(success as int)) filter (where trial in (0, 1)) as a, avg(cast(success as int)) filter (where trial in (2, 3)) as b from {bind.SIMULATIONS} s group by 1)
    select count(*) filter (where b > a) as gained, count(*) filter (where b < a) as lost, count(*) filter (where b = a) as same from t""",
)
def sign_test_pairs(spark, d):
    s = bind.simulations(spark, d)
    run = lambda ts: s.filter(F.col("trial").isin(*ts)).groupBy("task_id").agg(F.avg(F.col("success").cast("int")).alias("rate"))
    return evalx.paired(run((0, 1)), run((2, 3)))
