"""What must not grow: broadcasts, rows of one key, pairs."""

from __future__ import annotations

import difflib
import json
import random

import pytest
from pyspark.sql import functions as F

from loomline.functions import analyzer, grading
from loomline.operators import decontam, execution, facts, retail, templates
from loomline import session
from loomline.plans import catalog

CORE = catalog.load()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["modify_items_candidates", "modify_items"])
def test_growing_tables_are_not_broadcast(spark, small, name):
    assert "Broadcast" not in plan(CORE.queries[name](spark, small))


def test_least_variants_are_the_least_of_all(spark):
    rows = [(i, f"p{i % 2}", f"b{i * 7 % 5}", f"t{i * 3 % 4}", i * 11 % 6) for i in range(90)] + [(90, "p0", None, "t0", 1), (91, "p0", "b9", "t0", 1)]
    p = spark.createDataFrame(rows, "item_id long, product string, brand string, type string, size int")
    want = {}
    for r in retail.one_option_variants(p).collect():
        want.setdefault(r.item_id, []).append(r.other_id)
    got = {}
    for r in retail.least_variants(p).collect():
        got.setdefault(r.item_id, []).append(r.other_id)
    assert max(map(len, want.values())) > 2
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:2] for k, v in want.items()}


def test_names_are_met_by_what_a_text_holds(spark):
    u = spark.createDataFrame([(1, "Ann", "Lee", "01000"), (2, "Jo", "Ray", "01000"), (3, "Jo", "Ray", "02000"), (4, "", "Fox", "02000"), (5, None, "Fox", "02000"), (6, "Bo", "Kim", "03000"), (7, "BO", "kim", "03000")], "user_id long, first string, last string, zip string")
    said = ["Joanne Lee, zip 01000", "jo ray 02000 or 01000", "Fox at 02000", "Bo Kim 03000", "x 01000", "Jo", None]
    t = spark.createDataFrame(list(enumerate(said)), "id long, text string")
    want = {0: 1, 1: 2, 2: 4}
    assert all({r.id: r.user_id for r in templates.identified(t, u, most).collect()} == want for most in (0, 100))


def test_calls_without_a_key_are_spread(spark):
    users = spark.createDataFrame([(1, "A", "B", "0", "a@x")], "user_id long, first string, last string, zip string, email string")
    orders = spark.createDataFrame([("#W1", 1, "pending", "c1")], "order_id string, user_id long, status string, pm_id string")
    methods = spark.createDataFrame([(1, "c1"), (1, "c2")], "user_id long, pm_id string")
    calls = spark.range(400).select(F.col("id").alias("call_id"), F.lit("get_user_details").alias("tool"), F.create_map(F.lit("user_id"), F.lit("01")).alias("arguments"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = execution.executed(calls, orders, users, methods)
        n = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert len(n) == 4 and out.filter("ok").count() == 400
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_ratio_is_that_of_the_library_and_bounded(monkeypatch):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcd ") for _ in range(rng.randrange(n)))
    for _ in range(300):
        x, y = text(50), text(50)
        y += x[5:25] if rng.random() < 0.4 else ""
        r = difflib.SequenceMatcher(None, x.strip(), y.strip(), autojunk=False).ratio()
        assert grading.text_ratio(x, y) == max(0.0, (r - 0.3) / (1 - 0.3))
    monkeypatch.setattr(difflib.SequenceMatcher, "find_longest_match", lambda *_: pytest.fail("matched, although the lengths decide"))
    assert grading.text_ratio("ab " * 1000, "ab " * 50) == 0.0


def test_variants_reach_the_turns_that_name_their_product(spark):
    items = [(1, "ring", "b1", "t1", 1), (2, "Ring", "b1", "t1", 1), (3, "cup", "b1", "t1", 1)]
    products = spark.createDataFrame([(1, "ring", "b1", "t1", 1), (4, "ring", "b2", "t1", 1), (5, "ring", "b3", "t1", 1), (3, "cup", "b1", "t1", 1), (6, "cup", "b2", "t1", 1)], "item_id long, product string, brand string, type string, size int")
    own = spark.createDataFrame([("#W0000001", *x) for x in items], "order_id string, item_id long, product string, brand string, type string, size int")
    orders = spark.createDataFrame([("#W0000001", 1, "c")], "order_id string, user_id long, pm_id string")
    methods = spark.createDataFrame([(1, "c", "paypal", None, None)], "user_id long, pm_id string, source string, brand string, last_four string")
    said = ["I can exchange the RING for the b2 one.", "A ring in b3 or a cup in b2?", "Nothing.", None]
    tasks = spark.createDataFrame([(k, 1, "#W0000001") for k in range(4)], "id long, user_id long, order_id string")
    turns = spark.createDataFrame(list(enumerate(said)), "id long, text string")
    whole = turns.join(facts.task_facts(tasks, orders, own, methods, products), "id")
    lean = facts.with_variants(turns.join(facts.task_facts(tasks, orders, own, methods), "id"), products)
    got = {r.id: json.loads(r.facts) for r in lean.collect()}
    assert "variants" not in got[2] and [v["item_id"] for v in got[1]["variants"]] == [1, 3, 4, 5, 6]
    want = {r.id: analyzer.analyze(r.text, json.loads(r.facts)) for r in whole.collect()}
    assert {k: analyzer.analyze(said[k], f) for k, f in got.items()} == want and want[0]["changes"] != "[]"


def test_weights_of_the_held_out_side_and_norms(spark):
    docs = spark.createDataFrame([(1, "a b c a"), (2, "b c d"), (3, None), (4, "zz zz a")], "id long, text string")
    held = spark.createDataFrame([(1, "a b x"), (2, "q")], "id long, text string")
    rows = lambda df: sorted((r.id, r.tok, round(r.weight, 12)) for r in df.collect())
    want = rows(decontam.weights(docs, held).filter("side = 1"))
    assert want == rows(decontam.held_weights(docs, held)) == rows(decontam.held_weights(docs, held, 1))
    best = lambda most: {r.id: (r.match_id, r.similarity) for r in decontam.best_match(docs, held, most).collect()}
    assert best(100) == best(1)


def test_a_worker_gives_tokens_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(decontam, "MOST_ROWS", 10)
    docs = spark.createDataFrame([(i, "a b c d") for i in range(50)], "id long, text string").coalesce(1)
    assert decontam.counts(docs, "id", "text").count() == 350


def test_matches_are_made_once_for_the_flags(spark, small):
    assert "InMemory" in plan(CORE.queries["decontam_report"](spark, small))


def test_a_text_is_read_once_whatever_its_ids(monkeypatch):
    texts = ["I can cancel order #W000000%d. Do you confirm (yes/no)?", "Refund to credit_card_000000%d, is that okay?\n1. a\n2. b", "%d. Please share your email. It has been cancelled: W000000%d"]
    for t in texts:
        for k in range(3):
            x = t.replace("%d", str(k))
            got = analyzer.analyze(x, {})
            assert (tuple(got["asks"]), got["consent"], got["refusal"], got["done"], got["action"]) == analyzer.told(x)
    analyzer.analyze(texts[0] % 1, {})
    monkeypatch.setattr(analyzer, "units", lambda _: pytest.fail("read again"))
    assert analyzer.analyze(texts[0] % 7, {})["consent"]


def test_rows_are_spread_by_their_number(spark):
    assert session.spread(spark.range(1000), "id", 10).rdd.getNumPartitions() == 100


@pytest.mark.parametrize("name", ["grounding_plan", "orders_named", "identify_user"])
def test_of_what_grounding_meets_only_few_names_are_broadcast(spark, small, name):
    sides = [x for x in plan(CORE.queries[name](spark, small)).splitlines() if "BroadcastExchange" in x]
    assert len(sides) <= {"grounding_plan": 2, "orders_named": 0, "identify_user": 1}[name], sides


def test_lookups_are_those_of_a_walk_through_each_conversation(spark):
    rng = random.Random(8)
    people = [(1, "Ann", "Lee", "01000"), (2, "Jo", "Ray", "01000"), (3, "Jo", "Ray", "02000")]
    orders = [(f"#W000000{k}", k % 3 + 1) for k in range(6)] + [("#W0000001", 1), ("#W0000001", 2)]
    said = ["I'm Ann Lee, 01000", "jo ray 02000", "Jo Ray or Ann Lee, 01000", "hello", None]
    talks = {}
    for c in range(60):
        text = lambda: " ".join(x for x in [rng.choice(said), *(f"#W000000{rng.randrange(7)}" for _ in range(rng.randrange(3)))] if x)
        talks[c] = [(i, rng.choice(["user", "user", "assistant", None]), text() if rng.random() < 0.9 else None) for i in range(0, 2 * rng.randrange(1, 12), 2)]
    who = {said[0]: 1, said[1]: 3}
    gold = [(c, "get_order_details", f"#W000000{c % 6}") for c in range(0, 60, 2)]
    want = []
    for c, turns in talks.items():
        after = lambda i: min((j for j, r, _ in turns if j > i and r == "assistant"), default=None)  # noqa: B023, E731
        told = [(i, u, after(i)) for i, r, x in turns if r == "user" and x for t, u in who.items() if x.startswith(t) and after(i) is not None]
        if not told:
            continue
        _, user, auth = min(told)
        reads = {}
        for i, r, x in turns:
            at = auth if i < auth else i if r == "assistant" else after(i) if r else None
            for pos, o in enumerate(w for w in (x or "").split() if w.startswith("#W")):
                if at is not None and (o, user) in orders:
                    reads.setdefault(o, (at, 2, i, pos, "get_order_details", o))
        steps = [(auth, 0, -1, 0, "find_user_id_by_name_zip", str(user)), (auth, 1, -1, 0, "get_user_details", str(user)), *reads.values()]
        seen = {}
        for at, *_, tool, argument in sorted(s for s in steps if (c, s[4], s[5]) not in gold):
            seen[at] = seen.get(at, 0) + 1
            want.append((c, at, seen[at], tool, argument))
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = templates.lookups(
        df([(c, *t) for c, ts in talks.items() for t in ts], "id long, i int, role string, content string"), df(people, "user_id long, first string, last string, zip string"),
        df(orders, "order_id string, user_id long"), df(gold, "id long, tool string, argument string"),
    )
    assert len(want) > 60 and sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("few", [0, 4096])
def test_the_sieve_of_substrings_loses_no_name(spark, monkeypatch, few):
    monkeypatch.setattr(templates, "FEW_HEADS", few)
    u = spark.createDataFrame([(1, "Änn", "Lee", "01000"), (2, "J", "Ray", "01000"), (3, "", "Fox", "02000"), (4, "Joan", "Ray", "03000"), (5, None, "Ray", "03000")], "user_id long, first string, last string, zip string")
    said = ["änn lee 01000", "J ray 01000", "Fox 02000", "x joan RAY, 03000 02000", "joa Ray 03000"]
    j = templates.identified(spark.createDataFrame(list(enumerate(said)), "id long, text string"), u, 0)
    assert {r.id: r.user_id for r in j.collect()} == {0: 1, 1: 2, 2: 3, 3: 4}


@pytest.mark.parametrize("name", ["exchange_items_candidates", "exchanged_orders"])
def test_exchanges_broadcast_no_growing_table(spark, small, name):
    assert "BroadcastExchange" not in plan(CORE.queries[name](spark, small))


def test_orders_that_share_an_id_are_not_multiplied(spark):
    o = [("#W1000000", 1, "delivered"), ("#W1000000", 2, "delivered"), ("#W1000001", 1, "delivered"), ("#W1000001", 2, "pending"), ("#W1000002", 3, "delivered")]
    orders = spark.createDataFrame(o, "order_id string, user_id long, status string")
    alone = templates.told_by_id(orders, "delivered")
    assert sorted(map(tuple, alone.collect())) == [o[2], o[4]]
    lines = spark.createDataFrame([(i, k, p) for i in sorted({x[0] for x in o}) for k, p in enumerate(["ring", "cup", "cup", "bolt"])], "order_id string, pos int, product string")
    kept = lambda orders: sorted(map(tuple, templates.once_in_order(lines.join(orders.filter("status = 'delivered'"), "order_id")).collect()))
    assert kept(alone) == kept(orders) and len(kept(alone)) == 4


def test_changes_meet_orders_told_by_id_only(spark, tmp_path, monkeypatch):
    orders = [(10_000_000 + k, 1, "F", 1.0) for k in range(10)] + [(7, 1, "F", 1.0)]
    save = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    save(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double", "orders")
    save([(o[0], k, k, 5.0) for o in orders for k in range(3)], "l_orderkey long, l_linenumber int, l_partkey long, l_extendedprice double", "lineitem")
    save([(k + 3 * v, f"p{k}", f"b{v}", "t", 1, 2.0) for k in range(3) for v in range(2)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double", "part")
    save([(1, 0.0)], "c_custkey long, c_acctbal double", "customer")
    df = CORE.queries["exchange_items_candidates"](spark, str(tmp_path))
    assert [(r.order_id, r.item_ids, r.new_item_ids, r.difference) for r in df.collect()] == [("#W0000007", "0,1,2", "3,4,5", -9.0)]
    monkeypatch.setattr(templates, "item_changes", lambda items, *_: items)
    assert CORE.queries["exchange_items_candidates"](spark, str(tmp_path)).count() == 3


def test_substrings_are_made_in_more_than_the_task_that_read_the_texts(spark):
    u = spark.createDataFrame([(1, "Ann", "Lee", "01000")], "user_id long, first string, last string, zip string")
    t = spark.createDataFrame([(1, "ann lee 01000")], "id long, text string").coalesce(1)
    assert "REPARTITION_BY_COL" in plan(templates.identified(t, u, 0))
