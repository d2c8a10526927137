"""Constraint queries over a retail database, and its state transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomline.operators.exclusions import hash_tree

#: The statuses in which each action is refused, and those in which it may be done.
REFUSED = {"cancel": ("delivered", "processed"), "return": ("pending", "processed")}
ALLOWED = {"cancel": "pending", "modify": "pending", "return": "delivered", "exchange": "delivered"}
CANCEL_REASONS = ("no longer needed", "ordered by mistake")


def unique_identity(users: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The rows with `unique`: no other row has the same keys. Counted and joined, so a common name makes no large task."""
    n = users.groupBy(*keys).agg(F.count("*").alias("_n"))
    return users.join(n, list(keys)).withColumn("unique", F.col("_n") == 1).drop("_n")


def order_hint(items: DataFrame) -> DataFrame:
    """(order_id, user_id, hint): a product that an order has once and no other order of its user has; the first by place."""
    w = W.partitionBy("user_id", "product")
    alone = items.withColumn("_n", F.count("*").over(w)).filter("_n = 1")
    return alone.groupBy("order_id", "user_id").agg(F.min_by("product", F.struct("pos", "item_id")).alias("hint"))


def one_option_variants(products: DataFrame) -> DataFrame:
    """(item_id, other_id, option): variants of one product that differ in a single option, where that change names one variant.

    Pairs are found by equality on the options left, once for each option, not by pairing a product's variants.
    """
    options = ("brand", "type", "size")
    out: DataFrame | None = None
    same = products.groupBy("product", *options).agg(F.min("item_id").alias("other_id"), F.count("*").alias("_n")).filter("_n = 1")
    for o in options:
        rest = [x for x in options if x != o]
        b = same.select("product", *rest, F.col(o).alias("new"), "other_id")
        pair = products.join(b, ["product", *rest]).filter(F.col(o) != F.col("new")).select("item_id", "other_id", F.lit(o).alias("option"), F.col(o).cast("string").alias("old"), F.col("new").cast("string"))
        out = pair if out is None else out.unionByName(pair)
    return out


def least_variants(products: DataFrame, k: int = 2) -> DataFrame:
    """(item_id, other_id): of each item's one-option variants the k least.

    Of the variants that share the options left, at most one has the item's own option, so the k + 1 least hold
    the k least others: only those are kept, and an item meets them once for each option.
    """
    options = ("brand", "type", "size")
    same = products.groupBy("product", *options).agg(F.min("item_id").alias("other_id"), F.count("*").alias("_n")).filter("_n = 1")
    out, found = products.select("item_id", "product", *options), []
    for o in options:
        rest = ["product", *(x for x in options if x != o)]
        few = same.filter(F.col(o).isNotNull()).withColumn("_r", F.row_number().over(W.partitionBy(*rest).orderBy("other_id"))).filter(F.col("_r") <= k + 1)
        few = few.groupBy(*rest).agg(F.collect_list(F.struct("other_id", F.col(o).alias("new"))).alias(f"_{o}"))
        out = out.join(few.hint("merge"), rest, "left")
        own = F.col(o)
        others = F.transform(F.filter(f"_{o}", lambda x: x["new"] != own), lambda x: x["other_id"])  # noqa: B023
        found.append(F.coalesce(others, F.array().cast("array<bigint>")))
    return out.select("item_id", F.explode(F.slice(F.sort_array(F.concat(*found)), 1, k)).alias("other_id"))


def status_refusals(orders: DataFrame, action: str) -> DataFrame:
    """Orders for which the action must be refused."""
    return orders.filter(F.col("status").isin(*REFUSED[action])).withColumn("action", F.lit(action))


def foreign_orders(users: DataFrame, orders: DataFrame, seed: str = "foreign") -> DataFrame:
    """(user_id, order_id): for each user the first order, in the order of hashes after the user's own, that another user has.

    After the greatest hash comes the least again; null where no other user has an order. Users aren't
    paired with orders: both are put in 65,536 ranges of the hash. A range's first order and the first
    after it of another owner stand for it to the ranges before; windows span a range, or these two
    orders of all ranges.
    """
    key = lambda c: F.sha2(F.concat(F.lit(f"{seed}/"), F.col(c).cast("string")), 256)
    back = lambda part: W.partitionBy(part).orderBy(F.desc("at"))
    order = F.struct("order_id", "owner")

    def with_next(df: DataFrame, part: str) -> DataFrame:
        """Orders in sequence `at` with `nxt`, the first after them of another owner; windows run from the end."""
        run = df.withColumn("_run", F.when(~F.lead("owner").over(back(part)).eqNullSafe(F.col("owner")), order))
        return run.withColumn("nxt", F.last("_run", True).over(back(part).rowsBetween(W.unboundedPreceding, -1))).drop("_run")

    o = orders.select(key("order_id").alias("at"), "order_id", F.col("user_id").alias("owner")).withColumn("b", F.substring("at", 1, 4))
    own = with_next(o, "b").groupBy("b").agg(F.min_by(F.struct(order.alias("o"), "nxt"), "at").alias("f"))
    two = own.select("b", F.posexplode(F.array("f.o", "f.nxt")).alias("k", "o")).filter("o is not null")
    ring = two.unionByName(two.withColumn("b", F.concat(F.lit("g"), "b"))).select(F.concat("b", F.col("k").cast("string")).alias("at"), "o.order_id", "o.owner", F.lit(0).alias("all"))
    ring = with_next(ring, "all").select("at", "all", F.struct(order.alias("o"), "nxt").alias("f"))
    every = orders.sparkSession.range(1 << 16).select(F.lower(F.lpad(F.hex("id"), 4, "0")).alias("b"))
    spine = every.select(F.concat("b", F.lit("~")).alias("at"), F.lit(0).alias("all"), F.lit(None).cast(ring.schema["f"].dataType).alias("f")).unionByName(ring)
    ahead = spine.withColumn("f", F.coalesce("f", F.last("f", True).over(back("all").rowsBetween(W.unboundedPreceding, -1)))).filter("at like '____~'")
    carried = ahead.select(F.substring("at", 1, 4).alias("b"), F.posexplode(F.array("f.o", "f.nxt")).alias("k", "o")).filter("o is not null")
    seq = o.unionByName(carried.select(F.concat(F.lit("~"), F.col("k").cast("string")).alias("at"), "o.order_id", "o.owner", "b"))
    u = users.select(key("user_id").alias("at"), F.lit(None).cast("string").alias("order_id"), F.lit(None).cast("long").alias("owner"), F.col("user_id").alias("user_id")).withColumn("b", F.substring("at", 1, 4))
    both = with_next(seq, "b").withColumn("f", F.struct(order.alias("o"), "nxt")).unionByName(u, allowMissingColumns=True)
    met = both.withColumn("f", F.last("f", True).over(back("b").rowsBetween(W.unboundedPreceding, -1))).filter("user_id is not null")
    return met.select("user_id", F.when(F.col("f.o.owner") != F.col("user_id"), F.col("f.o.order_id")).otherwise(F.col("f.nxt.order_id")).alias("order_id"))


def refund_totals(items: DataFrame, n: int = 2) -> DataFrame:
    """(order_id, total, distractor): what the first n items of a delivered order cost, and the whole order."""
    w = W.partitionBy("order_id").orderBy("pos", "item_id")
    d = items.filter("status = 'delivered'").withColumn("_r", F.row_number().over(w))
    g = d.groupBy("order_id").agg(F.sum(F.when(F.col("_r") <= n, F.col("price"))).alias("total"), F.sum("price").alias("distractor"), F.count("*").alias("n_items"))
    return g.filter(F.col("n_items") >= n)


def composable(tasks: DataFrame) -> DataFrame:
    """(user_id, a, b): pairs of a user's tasks on different orders, each pair once; a user has few tasks."""
    a, b = tasks.select("user_id", F.col("order_id").alias("a")), tasks.select("user_id", F.col("order_id").alias("b"))
    return a.join(b, "user_id").filter("a < b")


def unique_owner(mentions: DataFrame, orders: DataFrame) -> DataFrame:
    """(mention_id, owner): the owner of the orders that a text names, if they have one."""
    m = mentions.join(orders.select("order_id", "user_id"), "order_id")
    g = m.groupBy("mention_id").agg(F.count_distinct("user_id").alias("n"), F.min("user_id").alias("owner"))
    return g.select("mention_id", F.when(F.col("n") == 1, F.col("owner")).alias("owner"))


def own_orders(orders: DataFrame, status: str | None = None) -> DataFrame:
    """(user_id, orders array): each user's orders in order."""
    o = orders if status is None else orders.filter(F.col("status") == status)
    return o.groupBy("user_id").agg(F.sort_array(F.collect_list("order_id")).alias("orders"))


def reads_until(orders: Column, target: Column) -> Column:
    """The orders read up to the target."""
    return F.slice(orders, 1, F.array_position(orders, target).cast("int"))


# --- transitions ------------------------------------------------------------------------


def cancelled(orders: DataFrame, reason: Column) -> DataFrame:
    """The orders after a cancellation, with `ok`; only a pending order is cancelled, for a known reason."""
    ok = (F.col("status") == "pending") & reason.isin(*CANCEL_REASONS)
    return orders.withColumns({"ok": ok, "status": F.when(ok, "cancelled").otherwise(F.col("status")), "refund": F.when(ok, F.col("total")).otherwise(0.0)})


def requested(orders: DataFrame, action: str) -> DataFrame:
    """The orders after a return or exchange request, with `ok`; only delivered ones."""
    ok = F.col("status") == ALLOWED[action]
    return orders.withColumns({"ok": ok, "status": F.when(ok, F.lit(f"{action} requested")).otherwise(F.col("status"))})


def modified(items: DataFrame) -> DataFrame:
    """Every modified item takes the price of the last of its order's pairs; pending orders only.

    The last pairs are aggregated and met by a join, for pending orders alone; no task holds a window's rows.
    """
    last = items.filter("status = 'pending'").groupBy("order_id").agg(F.max_by(F.struct(F.col("price").alias("p")), F.struct("pos", "item_id")).alias("_last"))
    j = items.join(last.hint("merge"), "order_id", "left")
    return j.withColumn("price", F.when(F.col("_last").isNotNull() & (F.col("status") == "pending"), F.col("_last.p")).otherwise(F.col("price"))).drop("_last")


def overlay(base: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """The base with the delta's rows in place of its own."""
    return base.join(delta.select(key), key, "left_anti").unionByName(delta)


def record_hashes(df: DataFrame, key: str, cols: tuple[str, ...]) -> DataFrame:
    return df.select(key, F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols)), 256).alias("hash"))


def state_hash(hashes: DataFrame) -> DataFrame:
    """One hash of all records' hashes, whatever their order: the root of a tree whose nodes are bounded."""
    return hash_tree(hashes).withColumnRenamed("root", "state_hash")
