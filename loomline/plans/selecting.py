"""Queries on sampling, splitting, mixing and exclusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.operators import exclusions as ex
from loomline.operators import selection as sel
from loomline.plans.analytics import _CLASS, _REC, _records
from loomline.functions import predicates as P
from loomline.registry import CORE, tree_sql
from loomline.sources import bind

SC, LA = bind.SCENARIOS, bind.LABEL_AUDIT
_H = lambda seed, i="id": f"sha256('{seed}/' || cast({i} as varchar))"


@CORE.query("stratified_sample", f"select id, category, theme from {SC} s qualify row_number() over (partition by category, theme order by {_H(42)}, id) <= 4")
def stratified_sample(spark, d):
    return sel.per_stratum(bind.scenarios(spark, d), ("category", "theme"), "id", 4).select("id", "category", "theme")


@CORE.query(
    "oversample_flagged",
    f"""with b as (select id, category, theme from {SC} s qualify row_number() over (partition by category, theme order by {_H(42)}, id) <= 4),
    m as (select s.id, category, theme from {SC} s where id in (select id from {LA} l where blocked) and id not in (select id from b)
      qualify row_number() over (partition by category, theme order by {_H('42-flagged')}, id) <= 3)
    select *, 'base' as picked from b union all select *, 'flagged' as picked from m""",
)
def oversample_flagged(spark, d):
    flagged = bind.label_audit(spark, d).filter(F.size("blocking") > 0)
    return sel.review_sample(bind.scenarios(spark, d).select("id", "category", "theme"), flagged, ("category", "theme"), "id")


MIX = {"en": 0.5, "fr": 0.2, "de": 0.2, "es": 0.1}


@CORE.query(
    "apply_mixture",
    f"""with s as (select id, category, theme, {' '.join(['case category', *(f"when '{k}' then {v}" for k, v in MIX.items()), 'end'])} as share from {SC} s),
    c as (select category, share, count(*) as avail from s group by 1, 2), t as (select category, round_even(min(avail / share) over () * share, 0) as target from c),
    r as (select *, row_number() over (partition by category, theme order by {_H(0)}, id) as r from s)
    select id, category, theme from r join t using (category) qualify row_number() over (partition by category order by r, theme) <= target""",
)
def apply_mixture(spark, d):
    return sel.mixture(bind.scenarios(spark, d).select("id", "category", "theme"), MIX)


@CORE.query(
    "stratified_split",
    f"""with n as (select id, category, theme, count(*) over (partition by category, theme) as n, row_number() over (partition by category, theme order by {_H(0)}, id) as r from {SC} s)
    select id, case when r <= (case when n >= 2 then least(greatest(round_even(n * 0.2, 0), 1), n - 1) else round_even(n * 0.2, 0) end) then 'val' else 'train' end as part from n""",
)
def stratified_split(spark, d):
    return sel.split(bind.scenarios(spark, d).select("id", "category", "theme"), ("category", "theme"), "id", 0.2).select("id", "part")


@CORE.query("hash_split_users", "select c_custkey as user_id, cast(('0x' || left(sha256('val/' || cast(c_custkey as varchar)), 8)) as ubigint) / 4294967295 < 0.15 as val from customer")
def hash_split_users(spark, d):
    return bind.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")).select("user_id", sel.is_val_user("user_id").alias("val"))


QUOTA = {"pending": 0.5, "delivered": 0.3, "processed": 0.2}


@CORE.query(
    "pool_quota",
    f"""select order_id, status from {bind.RETAIL_ORDERS} o qualify row_number() over (partition by status order by {_H(0, 'order_id')}, order_id)
    <= case status when 'pending' then 500 when 'delivered' then 300 else 200 end""",
)
def pool_quota(spark, d):
    return sel.quota(bind.retail_orders(spark, d), QUOTA, 1000, "status", "order_id").select("order_id", "status")


@CORE.query(
    "prefilter_tasks",
    f"""with r as (select template || '/' || cast(task_id as varchar) as id, template, {_CLASS} as class from {_REC} r),
    k as (select *, row_number() over (partition by template, class order by {_H(0)}, id) as r, count(*) over (partition by template, class) as n,
      case when class in ('live', 'unjudged', 'flat_other') then 1.0 when class = 'dead' then 0.2 else 0.0 end as share from r)
    select id, template, class from k where r <= floor(share * n + 1e-9)""",
)
def prefilter_tasks(spark, d):
    return sel.prefilter(_classed(spark, d))


def _classed(spark, d):
    c = P.record_class(F.col("n"), F.col("lo"), F.col("hi"), F.col("all_ok"), F.col("any_ok"))
    return _records(spark, d).select(F.concat_ws("/", "template", F.col("task_id").cast("string")).alias("id"), "template", c.alias("class"))


@CORE.query(
    "prefilter_report",
    f"select template, count(*) as n, {', '.join(f'''count(*) filter (where class = '{c}') as {c}''' for c in ('live', 'solved', 'dead', 'flat_other', 'unjudged'))} from (select template, {_CLASS} as class from {_REC} r) t group by rollup (template)",
)
def prefilter_report(spark, d):
    kinds = ("live", "solved", "dead", "flat_other", "unjudged")
    return _classed(spark, d).rollup("template").agg(F.count("*").alias("n"), *(F.count_if(F.col("class") == k).alias(k) for k in kinds))


@CORE.query(
    "weighted_choice",
    "select c_custkey as id, case when u < 0.5 then 'two' when u < 0.8 then 'three' else 'mixed' end as choice from (select c_custkey, cast(('0x' || left(sha256('7/' || cast(c_custkey as varchar)), 8)) as ubigint) / 4294967295 as u from customer) t",
)
def weighted_choice(spark, d):
    return sel.weighted_choice(bind.table(spark, d, "customer").select(F.col("c_custkey").alias("id")), {"two": 5, "three": 3, "mixed": 2}, 7, "id")


@CORE.query("knob_sampling")
def knob_sampling(spark, d):
    space = {"late_correction": ["yes", "no", "no"], "id_mode": ["email", "name_zip"], "n_items": ["1", "2", "3"]}
    return sel.knobs(bind.table(spark, d, "customer").select(F.col("c_custkey").alias("id")), space, 3, "id")


@CORE.query("group_seed")
def group_seed(spark, d):
    return bind.table(spark, d, "customer").select(F.col("c_custkey").alias("id")).withColumn("seed", sel.group_seed("id", 5, 42))


@CORE.query("replicate_groups", "select c_custkey as id, cast(g as integer) as copy from customer, unnest(range(0, 4)) as t(g)")
def replicate_groups(spark, d):
    return sel.replicate(bind.table(spark, d, "customer").select(F.col("c_custkey").alias("id")), 4)


@CORE.query("rank_shard", "select doc_id from documents qualify (row_number() over (order by doc_id) - 1) % 4 = 1")
def rank_shard(spark, d):
    return sel.shard(bind.table(spark, d, "documents").select("doc_id"), "doc_id", 1, 4)


@CORE.query("held_out_fold", "select doc_id, (row_number() over (order by doc_id) - 1) % 5 = 0 as held_out from documents")
def held_out_fold(spark, d):
    return sel.with_place(bind.table(spark, d, "documents").select("doc_id"), "doc_id").select("doc_id", (F.col("place") % 5 == 0).alias("held_out"))


@CORE.query("first_occurrence", "select event_id, user_id, event_type from events qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1")
def first_occurrence(spark, d):
    return sel.first_of(bind.table(spark, d, "events"), ("user_id", "event_type"), ("ts", "event_id")).select("event_id", "user_id", "event_type")


# --- exclusions -------------------------------------------------------------------------


def _flagged(spark, d):
    sc = bind.scenarios(spark, d).select("id", "category", "theme")
    defects = bind.label_audit(spark, d).filter(F.size("blocking") > 0)
    return ex.resolve(sc, defects, sc.filter("id % 7 = 0"))


FL = f"(select id, category, theme, coalesce(blocked, false) as label, id % 7 = 0 as zero, coalesce(blocked, false) or id % 7 = 0 as excluded from {SC} s left join {LA} l using (id))"


@CORE.query("exclusion_table", f"select category, count(*) as total, count(*) filter (where label) as label_defects, count(*) filter (where zero and not label) as zero_variance, count(*) filter (where not excluded) as remaining from {FL} f group by rollup (category)")
def exclusion_table(spark, d):
    return ex.table(_flagged(spark, d))


@CORE.query("exclude_ids", f"select id from {FL} f where not excluded")
def exclude_ids(spark, d):
    return _flagged(spark, d).filter("not excluded").select("id")


@CORE.query("emptied_cells", f"select category, theme, count(*) as n from (select *, theme || '/' || id % 40 as theme_ from {FL} f) g group by category, theme_, theme having bool_and(excluded)".replace("select category, theme,", "select category, theme_ as theme,"))
def emptied_cells(spark, d):
    """Cells of a category, a theme and one of 40 parts of it."""
    f = _flagged(spark, d)
    return ex.emptied_cells(f.withColumn("theme", F.concat_ws("/", "theme", (F.col("id") % 40).cast("string"))))


@CORE.query("exclusion_shift", f"select category, round(count(*) / sum(count(*)) over (), 6) as before, round(count(*) filter (where not excluded) / sum(count(*) filter (where not excluded)) over (), 6) as after from {FL} f group by 1")
def exclusion_shift(spark, d):
    return ex.shift(_flagged(spark, d))


@CORE.query("defect_kinds", f"select 'low_quality' as kind, count(*) as n from {LA} l where quality = 0 having count(*) > 0 union all select 'toxic', count(*) from {LA} l where toxic = 1 having count(*) > 0")
def defect_kinds(spark, d):
    return ex.defect_kinds(bind.label_audit(spark, d))


@CORE.query("exclusion_fingerprint", f"""select left(root, 12) as fingerprint from {tree_sql(f"select distinct sha256(cast(id as varchar)) as hash from {FL} f where excluded")} t""")
def exclusion_fingerprint(spark, d):
    return ex.fingerprint(_flagged(spark, d).filter("excluded"))


@CORE.query(
    "reconcile_ids",
    """with f as (select doc_id as id, count(*) as n from labels group by 1 union all select item_id * 3 - 1, count(*) + 1 from benchmark group by 1), e as (select doc_id as id from documents), g as (select id, sum(n) as n from f group by 1)
    select * from (select coalesce(e.id, g.id) as id, case when n is null then 'missing' when e.id is null then 'unknown' when n > 1 then 'duplicate' end as problem from e full join g on e.id = g.id) where problem is not null""",
)
def reconcile_ids(spark, d):
    b = bind.table(spark, d, "benchmark").select((F.col("item_id") * 3 - 1).alias("id"))
    found = bind.table(spark, d, "labels").select(F.col("doc_id").alias("id")).unionByName(b).unionByName(b.distinct())
    return ex.reconcile(bind.table(spark, d, "documents").select(F.col("doc_id").alias("id")), found)


@CORE.query("holdout_exact", f"select order_id, row_number() over (order by {_H(0, 'order_id')}, order_id) <= 100 as held_out from {bind.RETAIL_ORDERS} o")
def holdout_exact(spark, d):
    return sel.holdout(bind.retail_orders(spark, d), "order_id", 100).select("order_id", "held_out")


@CORE.query("top_products", f"select product as value, count(*) as n from {bind.RETAIL_ITEMS} i group by 1 order by n desc, min(order_id), 1 limit 10")
def top_products(spark, d):
    return sel.top(bind.retail_items(spark, d), "product", "order_id", 10).withColumnRenamed("product", "value")


@CORE.query(
    "users_decontaminated",
    "select o_orderkey as id from orders where o_custkey % 10 <> 3 and (o_custkey + 1) % 10 <> 3",
)
def users_decontaminated(spark, d):
    tasks = bind.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.array("o_custkey", F.col("o_custkey") + 1).alias("involved_users"))
    users = bind.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")).unionByName(bind.table(spark, d, "customer").select((F.col("c_custkey") + 1).alias("user_id")))
    return ex.without_users(tasks, users.filter("user_id % 10 = 3").distinct()).select("id")


@CORE.query(
    "corpus_summary",
    f"select category, count(*) as n, count(distinct theme) as n_cells, round(avg(cast(text = '' as int)), 6) as empty_share from {SC} s group by rollup (category)",
)
def corpus_summary(spark, d):
    return bind.scenarios(spark, d).rollup("category").agg(F.count("*").alias("n"), F.count_distinct("theme").alias("n_cells"), F.round(F.avg((F.col("text") == "").cast("int")), 6).alias("empty_share"))


