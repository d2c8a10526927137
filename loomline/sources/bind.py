"""Entity views over the star-schema tables: score groups, scenarios, simulations, a retail database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def score_groups(spark: SparkSession, d: str) -> DataFrame:
    """(scenario_id, category, theme, sample, score): a group is a user's events of one type."""
    e = table(spark, d, "events")
    order = W.partitionBy("event_type", "user_id").orderBy("ts", "event_id")
    theme = (F.col("user_id") % 6).cast("string")
    return e.select(
        F.concat_ws("__", "event_type", theme, F.col("user_id").cast("string")).alias("scenario_id"),
        F.col("event_type").alias("category"),
        theme.alias("theme"),
        F.row_number().over(order).cast("long").alias("sample"),
        F.least(F.floor(F.col("value") / 50) / 10, F.lit(1.0)).alias("score"),
    )


SCORE_GROUPS = """(select concat_ws('__', event_type, cast(user_id % 6 as varchar), cast(user_id as varchar)) as scenario_id,
  event_type as category, cast(user_id % 6 as varchar) as theme,
  row_number() over (partition by event_type, user_id order by ts, event_id) as sample,
  least(floor(value / 50) / 10, 1.0) as score from events)"""


def discount_groups(spark: SparkSession, d: str) -> DataFrame:
    """(task_id, sample, reward): an order's lines, with many flat groups."""
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("sample"), F.col("l_partkey").alias("tie"), F.col("l_discount").alias("reward"))


DISCOUNT_GROUPS = "(select l_orderkey as task_id, l_linenumber as sample, l_partkey as tie, l_discount as reward from lineitem)"


def scenarios(spark: SparkSession, d: str) -> DataFrame:
    """(id, category, theme, text): documents as scenarios."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("category"), F.col("source").alias("theme"), "text")


SCENARIOS = "(select doc_id as id, lang as category, source as theme, text from documents)"


def label_audit(spark: SparkSession, d: str) -> DataFrame:
    """(id, blocking array): defects that block a scenario."""
    blocking = F.array_compact(F.array(F.when(F.col("quality") == 0, "low_quality"), F.when(F.col("toxic") == 1, "toxic:text")))
    return table(spark, d, "labels").select(F.col("doc_id").alias("id"), blocking.alias("blocking"))


LABEL_AUDIT = "(select doc_id as id, quality, toxic, (quality = 0 or toxic = 1) as blocked from labels)"

STATUS = {"P": "pending", "F": "delivered", "O": "processed"}


def retail_orders(spark: SparkSession, d: str) -> DataFrame:
    """(order_id, user_id, status, total)"""
    status = F.create_map(*(F.lit(x) for kv in STATUS.items() for x in kv))[F.col("o_orderstatus")]
    return table(spark, d, "orders").select(
        F.concat(F.lit("#W"), F.lpad(F.col("o_orderkey").cast("string"), 7, "0")).alias("order_id"), F.col("o_custkey").alias("user_id"), status.alias("status"), F.col("o_totalprice").alias("total")
    )


RETAIL_ORDERS = """(select '#W' || lpad(cast(o_orderkey as varchar), 7, '0') as order_id, o_custkey as user_id,
  case o_orderstatus when 'P' then 'pending' when 'F' then 'delivered' when 'O' then 'processed' end as status, o_totalprice as total from orders)"""


def retail_items(spark: SparkSession, d: str, orders: DataFrame | None = None) -> DataFrame:
    """(order_id, user_id, status, pos, tie, item_id, product, price, brand, type, size); of those orders only, if given.

    Parts and orders grow with the items and are small on disk only: they are merged, not broadcast.
    """
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    items = li.select(
        F.concat(F.lit("#W"), F.lpad(F.col("l_orderkey").cast("string"), 7, "0")).alias("order_id"),
        F.col("l_linenumber").alias("pos"),
        F.col("l_partkey").alias("item_id"),
        F.col("l_extendedprice").alias("price"),
    )
    products = p.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("product"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size"))
    if orders is not None:
        return items.join(orders.hint("merge"), "order_id").join(products.hint("merge"), "item_id")
    return items.join(products.hint("merge"), "item_id").join(retail_orders(spark, d).hint("merge"), "order_id")


RETAIL_ITEMS = f"""(select o.order_id, o.user_id, o.status, o.total, l.l_linenumber as pos, l.l_partkey as item_id, p.p_name as product,
  l.l_extendedprice as price, p.p_brand as brand, p.p_type as type, p.p_size as size
  from lineitem l join part p on l.l_partkey = p.p_partkey join {RETAIL_ORDERS} o on o.order_id = '#W' || lpad(cast(l.l_orderkey as varchar), 7, '0'))"""


def simulations(spark: SparkSession, d: str) -> DataFrame:
    """(task_id, trial, success, termination, tokens, ts): four trials a user."""
    e = table(spark, d, "events")
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select("event_id", F.col("user_id").alias("task_id"), n.alias("n"), "event_type", "value", "ts").select(
        "event_id", "task_id", (F.col("n") % 4).alias("trial"), (F.col("event_type") == "purchase").alias("success"), F.col("event_type").alias("termination"), "value", "ts"
    )


SIMULATIONS = """(select event_id, user_id as task_id, (row_number() over (partition by user_id order by ts, event_id) - 1) % 4 as trial,
  event_type = 'purchase' as success, event_type as termination, value, ts from events)"""


def users(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, first, last, zip, email, address1, city)"""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k.alias("user_id"), F.concat(F.lit("N"), F.col("c_nationkey")).alias("first"), F.col("c_mktsegment").alias("last"),
        F.lpad((k % 50 * 1999).cast("string"), 5, "0").alias("zip"), F.concat(F.replace(F.lower("c_name"), F.lit("#"), F.lit(".")), F.lit("@example.com")).alias("email"),
        F.concat((100 + k % 900).cast("string"), F.lit(" Main Street")).alias("address1"), F.concat(F.lit("City "), F.col("c_nationkey")).alias("city"),
    )


USERS = """(select c_custkey as user_id, 'N' || c_nationkey as first, c_mktsegment as last, lpad(cast(c_custkey % 50 * 1999 as varchar), 5, '0') as zip,
  replace(lower(c_name), '#', '.') || '@example.com' as email, (100 + c_custkey % 900) || ' Main Street' as address1, 'City ' || c_nationkey as city from customer)"""


def payment_methods(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, pm_id, source, brand, last_four, balance): a card for all, and a second one, PayPal or a gift card for some."""
    k, none = F.col("c_custkey"), F.lit(None).cast("string")
    name = lambda kind, n: F.concat(F.lit(f"{kind}_"), F.lpad(n.cast("string"), 7, "0"))
    four = lambda n: F.lpad((n % 10000).cast("string"), 4, "0")
    pm = lambda i, source, brand, last, balance: F.struct(*(x.alias(n) for x, n in zip((i, F.lit(source), brand, last, balance), ("pm_id", "source", "brand", "last_four", "balance"), strict=True)))
    brand, zero = F.when(k % 2 == 0, "visa").otherwise("mastercard"), F.lit(0.0)
    methods = F.array(
        pm(name("credit_card", k), "credit_card", brand, four(k), zero),
        F.when(k % 5 == 0, pm(name("credit_card", 5_000_000 + k), "credit_card", brand, F.when(k % 10 == 0, four(k)).otherwise(four(k * 3)), zero)),
        F.when(k % 3 == 0, pm(name("paypal", k), "paypal", none, none, zero)),
        F.when(k % 2 == 0, pm(name("gift_card", k), "gift_card", none, none, F.greatest(F.col("c_acctbal") * 20, zero))),
    )
    return table(spark, d, "customer").select(k.alias("user_id"), F.explode(F.array_compact(methods)).alias("m")).select("user_id", "m.*")


_PM = lambda kind, n: f"'{kind}_' || lpad(cast({n} as varchar), 7, '0')"
_FOUR = lambda n: f"lpad(cast(({n}) % 10000 as varchar), 4, '0')"
_BRAND = "case when c_custkey % 2 = 0 then 'visa' else 'mastercard' end"
PAYMENTS = f"""(select c_custkey as user_id, {_PM('credit_card', 'c_custkey')} as pm_id, 'credit_card' as source, {_BRAND} as brand, {_FOUR('c_custkey')} as last_four, 0.0::double as balance from customer
  union all select c_custkey, {_PM('credit_card', '5000000 + c_custkey')}, 'credit_card', {_BRAND}, case when c_custkey % 10 = 0 then {_FOUR('c_custkey')} else {_FOUR('c_custkey * 3')} end, 0 from customer where c_custkey % 5 = 0
  union all select c_custkey, {_PM('paypal', 'c_custkey')}, 'paypal', null, null, 0 from customer where c_custkey % 3 = 0
  union all select c_custkey, {_PM('gift_card', 'c_custkey')}, 'gift_card', null, null, greatest(c_acctbal * 20, 0) from customer where c_custkey % 2 = 0)"""


def order_payments(spark: SparkSession, d: str) -> DataFrame:
    """(order_id, user_id, status, amount, pm_id, n_payments, address1): how an order was paid, and where it goes."""
    k, u = F.col("o_orderkey"), F.col("o_custkey")
    name = lambda kind: F.concat(F.lit(f"{kind}_"), F.lpad(u.cast("string"), 7, "0"))
    pm = F.when((k % 4 == 0) & (u % 3 == 0), name("paypal")).when((k % 6 == 0) & (u % 2 == 0), name("gift_card")).otherwise(name("credit_card"))
    place = F.when(k % 3 == 0, F.concat((100 + k % 900).cast("string"), F.lit(" Oak Lane"))).otherwise(F.concat((100 + u % 900).cast("string"), F.lit(" Main Street")))
    more = table(spark, d, "orders").select(F.concat(F.lit("#W"), F.lpad(k.cast("string"), 7, "0")).alias("order_id"), pm.alias("pm_id"), F.when(k % 7 == 0, 2).otherwise(1).alias("n_payments"), place.alias("address1"))
    return retail_orders(spark, d).withColumnRenamed("total", "amount").join(more.hint("merge"), "order_id")


ORDER_PAYMENTS = f"""(select order_id, user_id, status, total as amount, pm_id, n_payments, address1 from {RETAIL_ORDERS} r join (select '#W' || lpad(cast(o_orderkey as varchar), 7, '0') as order_id,
  case when o_orderkey % 4 = 0 and o_custkey % 3 = 0 then {_PM('paypal', 'o_custkey')} when o_orderkey % 6 = 0 and o_custkey % 2 = 0 then {_PM('gift_card', 'o_custkey')} else {_PM('credit_card', 'o_custkey')} end as pm_id,
  case when o_orderkey % 7 = 0 then 2 else 1 end as n_payments, case when o_orderkey % 3 = 0 then (100 + o_orderkey % 900) || ' Oak Lane' else (100 + o_custkey % 900) || ' Main Street' end as address1 from orders) m using (order_id))"""
