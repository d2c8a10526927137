"""Task templates: for each kind of request, the orders and users that admit it, and what they would ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomline.functions.text import payment_phrase

#: Parts of the addresses that are made up.
STREETS = ("Alder", "Beech", "Clover", "Dogwood", "Fern", "Hazel", "Juniper", "Linden")


def told_apart(methods: DataFrame) -> DataFrame:
    """Payment methods with their phrase, and `unique`: no other method of the user is called the same."""
    phrase = payment_phrase(F.col("source"), F.col("brand"), F.col("last_four"))
    return methods.withColumn("phrase", phrase).withColumn("unique", F.count("*").over(W.partitionBy("user_id", "phrase")) == 1)


def once_in_order(items: DataFrame) -> DataFrame:
    """Items whose product their order has once."""
    return items.withColumn("_n", F.count("*").over(W.partitionBy("order_id", "product"))).filter("_n = 1").drop("_n")


def told_by_id(orders: DataFrame, status: str) -> DataFrame:
    """(order_id, user_id, status): the orders of that status of which no two have the id.

    Seven digits hold ten million ids; beyond, ids are cut and shared. An order with the id of another has each of its
    products twice, so it has no items that `once_in_order` keeps, and its lines needn't meet those of all orders of the id.
    """
    n = orders.filter(F.col("status") == status).groupBy("order_id").agg(F.count("*").alias("_n"), F.min("user_id").alias("user_id"))
    return n.filter("_n = 1").select("order_id", "user_id", F.lit(status).alias("status"))


def n_once(items: DataFrame) -> DataFrame:
    """(order_id, n_items): how many products an order has once, from counts, so no task sorts the items."""
    return items.groupBy("order_id", "product").agg(F.count("*").alias("_n")).filter("_n = 1").groupBy("order_id").agg(F.count("*").alias("n_items"))


def return_fallback(orders: DataFrame, methods: DataFrame, items: DataFrame, n: int = 1) -> DataFrame:
    """(order_id, user_id, original, asked, n_items): delivered orders whose refund can be asked to a method that it can't go to.

    The order was not paid with a gift card; the method asked for, of which the least is taken, is another one
    but a gift card, and called like no other; n items at least are told by their product.
    """
    m = told_apart(methods)
    paid = m.filter("source <> 'gift_card'").select("user_id", "pm_id")
    other = m.filter("source <> 'gift_card' and unique").select("user_id", F.col("pm_id").alias("asked"))
    o = orders.filter("status = 'delivered'").join(paid, ["user_id", "pm_id"]).join(other, "user_id").filter("asked <> pm_id")
    o = o.groupBy("order_id", "user_id", F.col("pm_id").alias("original")).agg(F.min("asked").alias("asked"))
    named = n_once(items.join(o.select("order_id").distinct().hint("merge"), "order_id", "left_semi")).filter(F.col("n_items") >= n)
    return o.join(named, "order_id").select("order_id", "user_id", "original", "asked", "n_items")


def modify_payment(orders: DataFrame, methods: DataFrame) -> DataFrame:
    """(order_id, mode, asked, target): pending orders, paid once, whose payment can move.

    plain: to another method called like no other, of which a gift card must cover the amount. gift_card_short:
    the user's one gift card is asked for and doesn't cover it, so another method takes its place. Of several the
    least is taken.
    """
    m = told_apart(methods)
    o = orders.filter("status = 'pending' and n_payments = 1").select("order_id", "user_id", "amount", F.col("pm_id").alias("original"))
    other = o.join(m, "user_id").filter("unique and pm_id <> original")
    plain = other.filter("source <> 'gift_card' or balance >= amount").groupBy("order_id").agg(F.min("pm_id").alias("target"))
    cards = m.filter("source = 'gift_card'").groupBy("user_id").agg(F.count("*").alias("k"), F.min("pm_id").alias("card"), F.min("balance").alias("balance")).filter("k = 1")
    short = o.join(cards, "user_id").filter("card <> original and balance < amount").select("order_id", F.col("card").alias("asked"))
    instead = other.filter("source <> 'gift_card'").groupBy("order_id").agg(F.min("pm_id").alias("target"))
    return plain.select("order_id", F.lit("plain").alias("mode"), F.col("target").alias("asked"), "target").unionByName(
        short.join(instead, "order_id").select("order_id", F.lit("gift_card_short").alias("mode"), "asked", "target")
    )


def item_changes(items: DataFrame, variants: DataFrame, prices: DataFrame, methods: DataFrame, status: str, n: int) -> DataFrame:
    """(order_id, user_id, item_ids, new_item_ids, difference, pm_id, corrected): n items of an order, each changed in one option.

    For orders of that status: a modification if pending, an exchange if delivered. Items are those told by their
    product, by place; each takes its least variant. The method is the least that is called like no other and,
    if a gift card, covers a positive difference. corrected is another variant of the first item, for a change of
    mind, where it has one and n < 3. Of variants (item_id, other_id) an item's two least are enough, as
    `retail.least_variants` gives them, and items of orders that share an id may be left out (`told_by_id`). Parts and
    methods grow with the orders, so no side is broadcast by its size on disk.
    """
    v = variants.join(prices.select(F.col("item_id").alias("other_id"), F.col("price").alias("new_price")).hint("merge"), "other_id")
    v = v.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("other_id", "new_price"))).alias("v"))
    plan = once_in_order(items.filter(F.col("status") == status).join(v.hint("merge"), "item_id", "left")).filter("v is not null")
    plan = plan.withColumn("r", F.row_number().over(W.partitionBy("order_id").orderBy("pos", "item_id"))).filter(F.col("r") <= n)
    g = plan.groupBy("order_id", "user_id").agg(
        F.count("*").alias("k"), F.sort_array(F.collect_list(F.struct("r", "item_id", F.col("v")[0]["other_id"].alias("new_id")))).alias("x"),
        F.round(F.sum(F.col("v")[0]["new_price"] - F.col("price")), 2).alias("difference"), F.min(F.when(F.col("r") == 1, F.get("v", F.lit(1))["other_id"])).alias("corrected"),
    ).filter(F.col("k") == n)
    m = told_apart(methods).filter("unique").select("user_id", "pm_id", "source", "balance")
    able = g.join(m.hint("merge"), "user_id").filter("source <> 'gift_card' or balance >= greatest(difference, 0)")
    ids = lambda f: F.array_join(F.transform("x", lambda s: s[f].cast("string")), ",")
    return able.groupBy("order_id", "user_id", ids("item_id").alias("item_ids"), ids("new_id").alias("new_item_ids"), "difference", F.when(F.lit(n < 3), F.col("corrected")).alias("corrected")).agg(F.min("pm_id").alias("pm_id"))


def made_address(user: Column, zip_: Column, seed: str = "address") -> Column:
    """A made-up address (address1, zip) for a user, by the hash of its id; its zip isn't the user's."""
    h = F.sha2(F.concat(F.lit(f"{seed}/"), user.cast("string")), 256)
    part = lambda at, n: F.conv(F.substring(h, at, 4), 16, 10).cast("int") % n
    street = F.element_at(F.array(*map(F.lit, STREETS)), part(5, len(STREETS)) + 1)
    z = 10_000 + part(9, 50_000)
    other = F.when(z.cast("string") == zip_, z + 1).otherwise(z)
    return F.struct(F.concat((100 + part(1, 9_900)).cast("string"), F.lit(" "), street, F.lit(" Street")).alias("address1"), other.cast("string").alias("zip"))


def modify_address(orders: DataFrame, users: DataFrame) -> DataFrame:
    """(order_id, mode, address1, zip): pending orders sent to a dictated address, or to the profile's where that is another."""
    o = orders.filter("status = 'pending'").select("order_id", "user_id", F.col("address1").alias("at"))
    j = o.join(users.select("user_id", "address1", "zip"), "user_id")
    new = made_address(F.col("user_id"), F.col("zip"))
    own = j.filter("at <> address1").select("order_id", F.lit("profile").alias("mode"), "address1", "zip")
    return own.unionByName(j.select("order_id", F.lit("dictated").alias("mode"), new["address1"].alias("address1"), new["zip"].alias("zip")))


def modify_user_address(users: DataFrame) -> DataFrame:
    """(user_id, address1, zip): users whom name and zip tell, with a dictated address."""
    n = users.groupBy("first", "last", "zip").agg(F.count("*").alias("_n"), F.min("user_id").alias("user_id")).filter("_n = 1")
    new = made_address(F.col("user_id"), F.col("zip"))
    return n.select("user_id", new["address1"].alias("address1"), new["zip"].alias("zip"))


# --- who a text is about ------------------------------------------------------------------


#: Names that are broadcast, at most.
FEW_NAMES = 20_000

#: Beginnings of first names, of so many characters, that sieve a text's substrings, and how many of them at most.
HEAD, FEW_HEADS = 3, 4_096


def identified(texts: DataFrame, users: DataFrame, most: int = FEW_NAMES) -> DataFrame:
    """(id, user_id): the one user whose zip a text names together with the first and last name.

    Texts meet the distinct names of a zip, not its users; names are then looked for in the text. Where these are more than
    `FEW_NAMES`, texts meet by zip and those of their substrings that are as long as a first name, so that only
    names found in the text are paired with it; substrings move without their text, which meets the names found, and
    only those that begin as some name does, unless names begin in more than `FEW_HEADS` ways.
    """
    names = users.groupBy("zip", F.lower("first").alias("first"), F.lower("last").alias("last")).agg(F.count("*").alias("n"), F.min("user_id").alias("user_id"))
    named = texts.select("id", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b\d{5}\b"), F.lit(0)))).alias("zip")).withColumn("text", F.lower("text"))
    if names.limit(most + 1).count() <= most:
        j = named.join(F.broadcast(names), "zip").filter(F.contains("text", "first"))
    else:
        sizes = F.lit([r.n for r in names.filter("first is not null").select(F.length("first").alias("n")).distinct().collect()]).cast("array<int>")
        cut = lambda n: F.transform(F.sequence(F.lit(1), F.length("text") - n + 1), lambda i: F.substr(F.col("text"), i, n))
        parts = F.flatten(F.transform(F.filter(sizes, lambda n: n <= F.length("text")), cut))
        heads = [r.h for r in names.filter("first is not null").select(F.left("first", F.lit(HEAD)).alias("h")).distinct().limit(FEW_HEADS + 1).collect()]
        if len(heads) <= FEW_HEADS:
            parts = F.filter(parts, lambda s: F.left(s, F.lit(HEAD)).isin(heads))
        named = named.repartition("id")  # a few megabytes of texts, which one task may have read, have very many substrings
        found = named.select("id", "zip", F.explode(F.array_distinct(parts)).alias("first")).join(names.hint("merge"), ["zip", "first"])
        j = named.join(found.hint("merge"), ["id", "zip"])
    hit = j.filter(F.contains("text", "last"))
    one = hit.groupBy("id", "zip").agg(F.sum("n").alias("n"), F.min("user_id").alias("user_id")).filter("n = 1")
    return one.groupBy("id").agg(F.min_by("user_id", "zip").alias("user_id"))


def mentions(texts: DataFrame, *keys: str) -> DataFrame:
    """(*keys, pos, order_id): the order ids in each text, from the left."""
    found = F.transform(F.regexp_extract_all("text", F.lit(r"#?\bW\d{7}\b"), F.lit(0)), lambda x: F.concat(F.lit("#"), F.ltrim(x, F.lit("#"))))
    return texts.select(*keys, F.posexplode(found).alias("pos", "order_id"))


def orders_named(texts: DataFrame, orders: DataFrame) -> DataFrame:
    """(id, pos, order_id): the orders that a text names and that exist, each once, in order of their first naming."""
    e = mentions(texts, "id").groupBy("id", "order_id").agg(F.min("pos").alias("pos"))
    return e.join(orders.select("order_id").hint("merge"), "order_id", "left_semi").select("id", "pos", "order_id")


def lookups(turns: DataFrame, users: DataFrame, orders: DataFrame, gold: DataFrame) -> DataFrame:
    """(id, at, seq, tool, argument): reads to insert before turns that narrate them, in order.

    turns: (id, i, role, content); gold: (id, tool, argument), the call that must not be answered ahead. The first
    user turn that tells one user is looked up before the next assistant turn, then the user's details, then
    each of that user's orders: before the assistant turn that names it, or before the next one, but not before
    the user is known. Conversations, users and orders grow together, so no side is broadcast by its size on disk;
    orders are met by id and owner, so that an id which several orders share multiplies nothing.
    """
    said = turns.select(F.struct("id", "i").alias("id"), "content", "role").withColumnRenamed("content", "text")
    ahead = W.partitionBy("id").orderBy(F.desc("i")).rangeBetween(W.unboundedPreceding, -1)
    places = turns.select("id", "i", "role").withColumn("at", F.min(F.when(F.col("role") == "assistant", F.col("i"))).over(ahead))
    who = identified(said.filter("role = 'user'"), users).select("id.id", "id.i", "user_id").join(places.filter("at is not null").hint("merge"), ["id", "i"])
    who = who.groupBy("id").agg(F.min_by(F.struct("at", "user_id"), "i").alias("w")).select("id", F.col("w.at").alias("auth_at"), F.col("w.user_id").alias("user_id"))
    text = lambda c: c.cast("string").alias("argument")
    step = lambda rank, tool: F.struct(F.lit(rank).alias("rank"), F.lit(-1).alias("i"), F.lit(0).alias("pos"), F.lit(tool).alias("tool"))
    auth = who.select("id", F.col("auth_at").alias("at"), F.inline(F.array(step(0, "find_user_id_by_name_zip"), step(1, "get_user_details"))), text(F.col("user_id")))
    named = mentions(turns.withColumnRenamed("content", "text"), "id", "i").join(who.hint("merge"), "id")
    own = named.join(orders.select("order_id", "user_id").hint("merge"), ["order_id", "user_id"], "left_semi").join(places.hint("merge"), ["id", "i"])
    at = F.when(F.col("i") < F.col("auth_at"), F.col("auth_at")).when(F.col("role") == "assistant", F.col("i")).when(F.col("role") != "assistant", F.col("at"))
    reads = own.withColumn("at", at).filter("at is not null").groupBy("id", "order_id").agg(F.min_by(F.struct("at", "i", "pos"), F.struct("i", "pos")).alias("x"))
    reads = reads.select("id", "x.at", F.lit(2).alias("rank"), "x.i", "x.pos", F.lit("get_order_details").alias("tool"), text(F.col("order_id")))
    every = auth.unionByName(reads).join(gold.select("id", "tool", "argument").hint("merge"), ["id", "tool", "argument"], "left_anti")
    seq = F.row_number().over(W.partitionBy("id", "at").orderBy("rank", "i", "pos"))
    return every.select("id", "at", seq.alias("seq"), "tool", "argument")


# --- verification and composition -----------------------------------------------------------

#: Fixed value: the ids that a task may only use once they were said or read.
ID = r"#W\d{7}|(?:credit_card|gift_card|paypal)_\d{7}|[a-z]+_[a-z]+_\d{4}|\b\d{10}\b"


def verify(tasks: DataFrame) -> DataFrame:
    """The problems of each task, in order: (id, problems array).

    tasks: lines array of what the user says; actions array of (name, arguments, ok, output, mutates), as executed;
    expect_no_write; changed (whether the end state differs). What the user says or a read gives is revealed.
    """
    ids = lambda text: F.array_distinct(F.regexp_extract_all(text, F.lit(ID), F.lit(0)))
    said = F.array_distinct(F.flatten(F.transform("lines", ids)))
    leaked = F.transform(F.filter("lines", lambda x: F.exists(ids(x), lambda i: ~F.startswith(i, F.lit("#W")))), lambda _: F.lit("a line leaks ids"))
    start = F.struct(said.alias("known"), leaked.alias("problems"))

    def step(a: Column, x: Column) -> Column:
        hidden = F.size(F.array_except(ids(x["arguments"]), a["known"])) > 0
        found = F.array_compact(F.array(F.when(hidden, F.concat(x["name"], F.lit(" uses ids not revealed"))), F.when(~x["ok"], F.concat(x["name"], F.lit(" failed")))))
        read = F.when(x["ok"] & ~x["mutates"], ids(x["output"])).otherwise(F.array().cast("array<string>"))
        return F.struct(F.array_union(a["known"], read).alias("known"), F.concat(a["problems"], found).alias("problems"))

    ends = F.array_compact(F.array(F.when(F.col("expect_no_write") & F.col("changed"), "a refusal changed the state"), F.when(~F.col("expect_no_write") & ~F.col("changed"), "the state is unchanged")))
    return tasks.select("id", F.concat(F.aggregate("actions", start, step, lambda a: a["problems"]), ends).alias("problems"))


#: Turns and calls that a conversation of several requests may have.
TURNS, MORE_TURNS = 14, 8


def composed(subs: DataFrame) -> DataFrame:
    """(user_id, actions, targets, expect_no_write, max_turns, slots) of a user's tasks (user_id, seq, actions array, target, expect_no_write, tool).

    The first two actions, which identify the user, come once; slots are renumbered by place.
    """
    row = F.struct("seq", "actions", "target", "expect_no_write", "tool")
    g = subs.groupBy("user_id").agg(F.sort_array(F.collect_list(row)).alias("s")).filter(F.size("s") > 1)
    rest = F.flatten(F.transform("s", lambda x: F.slice(x["actions"], 3, F.greatest(F.size(x["actions"]) - 2, F.lit(0)))))
    slot = lambda x, i: F.when(~x["expect_no_write"], F.concat(F.lit("s"), i.cast("string"), F.lit(":"), x["tool"], F.lit(":order:"), x["target"]))
    return g.select(
        "user_id", F.concat(F.slice(F.col("s")[0]["actions"], 1, 2), rest).alias("actions"), F.transform("s", lambda x: x["target"]).alias("targets"),
        F.forall("s", lambda x: x["expect_no_write"]).alias("expect_no_write"), (TURNS + MORE_TURNS * F.size("s")).alias("max_turns"), F.array_compact(F.transform("s", slot)).alias("slots"),
    )


def consent_slots(writes: DataFrame, slots: DataFrame) -> DataFrame:
    """Writes (conv_id, seq, tool, record) with the slot that their consent belongs to, or null."""
    return writes.join(slots.select("conv_id", "tool", "record", "slot"), ["conv_id", "tool", "record"], "left")
