"""Queries on rule checks, judge reports, reviews and label accuracy."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.operators import review as rv
from loomline.operators import selection as sel
from loomline.registry import CORE
from loomline.sources import bind


def _scenarios(spark, d):
    i = F.col("id")
    return bind.scenarios(spark, d).select(
        "id", F.when(i % 4 == 0, "happy_path").when(i % 4 == 1, "out_of_scope").otherwise(F.col("category")).alias("category"), "theme", "text",
        (i % 3).alias("n_calls"), F.when(i % 5 == 0, "a").otherwise("b").alias("distractor"), F.lit("a").alias("expected"),
    )


SC = """(select doc_id as id, case when doc_id % 4 = 0 then 'happy_path' when doc_id % 4 = 1 then 'out_of_scope' else lang end as category, text, doc_id % 3 as n_calls, doc_id % 5 = 0 as same from documents)"""
FIND = f"""(select id, category, unnest(list_filter([case when n_calls > 1 then 'error/more than one call' end, case when category = 'happy_path' and n_calls <> 1 then 'error/a happy path has one call' end,
  case when category = 'out_of_scope' and n_calls > 0 then 'error/out of scope has no call' end, case when same then 'error/the distractor is the expected tool' end, case when length(text) < 40 then 'warning/very short' end], lambda x: x is not null)) as f from {SC} s where text <> ''
  union all select id, category, 'error/missing keys' from {SC} s where text = '')"""


@CORE.query("rule_findings", f"select id, split_part(f, '/', 1) as severity, split_part(f, '/', 2) as message from {FIND} f")
def rule_findings(spark, d):
    return rv.rule_findings(_scenarios(spark, d))


@CORE.query("rule_report", f"select category, count(*) as n, count(*) filter (where failed) as failing, cast(coalesce(sum(k), 0) as bigint) as findings from {SC} s left join (select id, bool_or(f like 'error%') as failed, count(*) as k from {FIND} f group by 1) f using (id) group by 1")
def rule_report(spark, d):
    s = _scenarios(spark, d)
    return rv.rule_report(rv.rule_findings(s), s)


@CORE.query("report_problems", "select doc_id as id, case when quality = 0 and toxic = 0 then 'issues without severity' else 'severity without issues' end as problem from labels where (toxic = 0 and quality = 0) or (toxic = 1 and quality = 1)")
def report_problems(spark, d):
    la = bind.table(spark, d, "labels")
    issues = F.when(F.col("quality") == 0, F.array(F.lit("low"))).otherwise(F.array().cast("array<string>"))
    return rv.report_problems(la.select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "major").otherwise("none").alias("severity"), issues.alias("issues")))


@CORE.query(
    "verdict_stubs",
    """with have as (select doc_id from labels where quality = 1), s as (select doc_id from documents qualify row_number() over (partition by lang, source order by sha256('42/' || cast(doc_id as varchar)), doc_id) <= 4)
    select doc_id as scenario_id, 'accept' as verdict from documents where doc_id in (from have) union all select doc_id, 'pending' from s where doc_id not in (from have)""",
)
def verdict_stubs(spark, d):
    docs, la = bind.table(spark, d, "documents"), bind.table(spark, d, "labels")
    have = docs.join(la.filter("quality = 1"), "doc_id", "left_semi").select(F.col("doc_id").alias("scenario_id"), F.lit("accept").alias("verdict"))
    sample = sel.per_stratum(bind.scenarios(spark, d), ("category", "theme"), "id", 4)
    return rv.verdict_stubs(sample.select(F.col("id").alias("scenario_id")), have)


@CORE.query("sample_manifest", "with s as (select doc_id as id, lang || '__' || source as cell from documents qualify row_number() over (partition by lang, source order by sha256('42/' || cast(doc_id as varchar)), doc_id) <= 4) select cell, array_to_string(list(cast(id as varchar) order by id), ',') as ids from s group by 1")
def sample_manifest(spark, d):
    s = sel.per_stratum(bind.scenarios(spark, d), ("category", "theme"), "id", 4)
    m = rv.manifest(s.select(F.concat_ws("__", "category", "theme").alias("cell"), "id"))
    return m.select("cell", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


_NLU = "(select event_type as template, 'big' as field, value > 100 as gold, value > 90 as pred, true as applicable from events union all select event_type, 'even', user_id % 2 = 0, event_id % 2 = 0, value > 10 from events)"


def _nlu(spark, d):
    e = bind.table(spark, d, "events")
    a = e.select(F.col("event_type").alias("template"), F.lit("big").alias("field"), (F.col("value") > 100).alias("gold"), (F.col("value") > 90).alias("pred"), F.lit(True).alias("applicable"))
    b = e.select(F.col("event_type").alias("template"), F.lit("even").alias("field"), (F.col("user_id") % 2 == 0).alias("gold"), (F.col("event_id") % 2 == 0).alias("pred"), (F.col("value") > 10).alias("applicable"))
    return a.unionByName(b)


@CORE.query("nlu_accuracy", f"select template, field, count(*) as n, round(avg(cast(gold = pred as int)), 6) as accuracy from {_NLU} t where applicable group by grouping sets ((field), (template, field))")
def nlu_accuracy(spark, d):
    return rv.nlu_accuracy(_nlu(spark, d))


@CORE.query("nlu_confusions", f"select field, gold, pred, count(*) as n from {_NLU} t where applicable and gold <> pred group by 1, 2, 3")
def nlu_confusions(spark, d):
    return rv.confusions(_nlu(spark, d))
