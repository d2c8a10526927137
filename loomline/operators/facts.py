"""The facts of a task that its conversation is read with: one row joined from user, orders, items and payments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPTIONS = ("brand", "type", "size")


def task_facts(tasks: DataFrame, orders: DataFrame, items: DataFrame, methods: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """(id, facts): JSON for each task (id, user_id, order_id): the user's methods and orders, the order's items, and variants of their products.

    items: (order_id, item_id, product, options...); products: (item_id, product, options...). With products, each task
    holds all variants of its products, which is tasks x variants. Without, facts have none: they belong to
    the product, and `with_variants` gives them to the turns that name it.
    """
    options = F.to_json(F.struct(*(F.col(o).cast("string").alias(o) for o in OPTIONS)))
    opts = lambda: F.from_json(options, "map<string,string>").alias("options")
    m = methods.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("pm_id", "source", "brand", "last_four"))).alias("methods"))
    mine = orders.groupBy("user_id").agg(F.sort_array(F.collect_list("order_id")).alias("orders"))
    own = items.select("order_id", F.struct("item_id", F.col("product").alias("name"), opts()).alias("i"), "product", "item_id")
    i = own.groupBy("order_id").agg(F.array_sort(F.collect_list("i"), lambda a, b: F.signum(a["item_id"] - b["item_id"]).cast("int")).alias("items"))
    j = tasks.join(m, "user_id", "left").join(mine, "user_id", "left").join(orders.select("order_id", F.col("pm_id").alias("original")), "order_id", "left").join(i, "order_id", "left")
    if products is None:
        return j.select("id", F.to_json(F.struct("methods", "original", "orders", "items")).alias("facts"))
    v = products.select("product", F.struct("item_id", F.col("product").alias("name"), opts()).alias("v"))
    near = own.select("order_id", "product").distinct().join(v, "product").groupBy("order_id").agg(F.array_sort(F.collect_list("v"), lambda a, b: F.signum(a["item_id"] - b["item_id"]).cast("int")).alias("variants"))
    j = j.join(near, "order_id", "left")
    return j.select("id", F.to_json(F.struct("methods", "original", "orders", "items", "variants")).alias("facts"))


def with_variants(turns: DataFrame, products: DataFrame) -> DataFrame:
    """Turns (id, text, facts JSON without variants), one for each id, with the variants of those of their items' products that the text names.

    The analyzer reads variants of named items only, so its results are those of facts that hold all variants.
    """
    options = F.to_json(F.struct(*(F.col(o).cast("string").alias(o) for o in OPTIONS)))
    v = products.select("product", F.struct("item_id", F.col("product").alias("name"), F.from_json(options, "map<string,string>").alias("options")).alias("v"))
    names = F.from_json("facts", "struct<items:array<struct<name:string>>>")["items"]["name"]
    said = F.filter(F.array_distinct(names), lambda n: F.contains(F.lower("text"), F.lower(n)))
    named = turns.select("id", F.explode(said).alias("product"))
    near = named.join(v, "product").groupBy("id").agg(F.to_json(F.array_sort(F.collect_list("v"), lambda a, b: F.signum(a["item_id"] - b["item_id"]).cast("int"))).alias("_v"))
    whole = F.concat(F.regexp_replace("facts", r"\}$", ""), F.lit(',"variants":'), "_v", F.lit("}"))
    return turns.join(near, "id", "left").withColumn("facts", F.coalesce(whole, "facts")).drop("_v")
