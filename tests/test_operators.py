"""Literal and invariant tests of the operators."""

from __future__ import annotations

import difflib
import json

import pytest
from pyspark.sql import functions as F

from loomline.functions import analyzer, fold, scripted
from loomline.functions import grading as G
from loomline.functions import text as T
from loomline.operators import decontam, episodes, evalx, exclusions, retail, review, rollouts, rollup, selection, stats
from loomline.sources import files, sinks
from loomline.streaming import events as st


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def scores(spark, **groups):
    rows = [(f"c__t__{k}", "c", "t", i, float(s)) for k, v in groups.items() for i, s in enumerate(v)]
    return spark.createDataFrame(rows, "scenario_id string, category string, theme string, sample long, score double")


def test_group_classes_and_boundaries(spark):
    g = {r.scenario_id[6:]: r for r in stats.group_stats(scores(spark, up=[0, 1], cold=[0, 0], done=[1, 1], stuck=[0.3, 0.3], lone=[0.5], near=[0.95] * 16)).collect()}
    assert [g[k]["class"] for k in ("up", "cold", "done", "stuck")] == ["usable", "cold_start", "already_solved", "stuck_partial"]
    assert g["lone"]["std"] == 0.0 and not g["lone"]["effective"]
    assert g["near"]["solved"]


def test_all_zero_signal_falls_back_to_relevance(spark):
    s = spark.createDataFrame([("a", 0.0), ("b", 0.0)], "category string, signal double")
    assert {r.category: r.share for r in stats.recommend_mix(s, {"a": 3.0, "b": 1.0}).collect()} == {"a": 0.75, "b": 0.25}


def test_pass_hat_never_gives_negative_zero(spark):
    t = spark.createDataFrame([(1, i, i == 0) for i in range(4)] + [(2, i, True) for i in range(4)], "task_id long, trial long, success boolean")
    assert {r.k: r.pass_k for r in evalx.pass_hat(t).collect()} == {1: 0.625, 2: 0.5, 3: 0.5, 4: 0.5}


def test_bootstrap_holds_the_mean(spark):
    a = spark.createDataFrame([(i, 0.0) for i in range(50)], "task_id long, rate double")
    b = spark.createDataFrame([(i, float(i % 2)) for i in range(50)], "task_id long, rate double")
    r = evalx.bootstrap(a, b, 200).first()
    assert r.low < 0.5 < r.high


def test_flat_group_is_masked_and_a_null_reward_keeps_it(spark):
    rows = spark.createDataFrame([(1, 0.5), (1, 0.5), (2, 0.0), (2, 1.0), (3, 0.5), (3, None)], "task_id long, reward double")
    assert {(r.task_id, r.mask) for r in stats.advantages(rows).collect()} == {(1, 0), (2, 1), (3, 1)}


def test_audit_counts_a_task_once_overall(spark):
    s = spark.createDataFrame([(1, "t", 1.0, True), (1, "t", 0.0, False), (2, "t", 1.0, True)], "task_id long, template string, reward double, success boolean")
    recs = rollup.records(s, ("task_id", "template")).withColumn("difficulty", F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("True"), F.lit("c"), F.lit("0.5")))
    out = rollup.audit(recs).collect()
    assert [r.tasks for r in out if r.template is None] == [2]
    assert {r.knob for r in out if r.knob} == {"a", "b"}


def test_mixture_never_upsamples_and_is_deterministic(spark):
    df = spark.createDataFrame([(i, "a" if i < 80 else "b", f"t{i % 3}") for i in range(100)], "id long, category string, theme string")
    got = [sorted(r.id for r in selection.mixture(x, {"a": 0.5, "b": 0.5}).collect()) for x in (df, df.repartition(7))]
    assert got[0] == got[1] and len(got[0]) == 40 == len(set(got[0]))


def test_split_covers_every_cell(spark):
    df = spark.createDataFrame([(i, f"c{i % 4}", "t") for i in range(22)] + [(99, "lone", "t")], "id long, category string, theme string")
    parts = {(r.category, r.part): r.n for r in selection.split(df, ("category", "theme"), "id", 0.2).groupBy("category", "part").agg(F.count("*").alias("n")).collect()}
    assert all(parts[(f"c{k}", "val")] >= 1 and parts[(f"c{k}", "train")] >= 1 for k in range(4)) and ("lone", "val") not in parts


def test_review_sample_adds_flagged_only(spark):
    df = spark.createDataFrame([(i, "c") for i in range(20)], "id long, cell string")
    out = selection.review_sample(df, df.filter("id % 2 = 0"), ("cell",), "id").collect()
    assert len(out) == 7 and len({r.id for r in out}) == 7 and all(r.id % 2 == 0 for r in out if r.picked == "flagged")


def test_exclusions_count_a_double_reason_once(spark):
    c = spark.createDataFrame([(1, "a", "t"), (2, "a", "t"), (3, "b", "t")], "id long, category string, theme string")
    f = exclusions.resolve(c, c.filter("id = 1"), c.filter("id in (1, 3)").unionByName(c.selectExpr("id + 100 as id", "category", "theme")))
    t = {r.category: r for r in exclusions.table(f).collect()}
    assert (t[None].label_defects, t[None].zero_variance, t[None].remaining) == (1, 1, 1)
    assert [r.category for r in exclusions.emptied_cells(f).collect()] == ["b"]


def test_no_shared_token_matches_the_first_item_at_zero(spark):
    d = spark.createDataFrame([(1, "alpha beta"), (2, "zzz"), (3, "alpha beta")], "id long, text string")
    h = spark.createDataFrame([(7, "gamma"), (8, "alpha beta")], "id long, text string")
    got = {r.id: (r.match_id, round(r.similarity, 6)) for r in decontam.best_match(d, h).collect()}
    assert got == {1: (8, 1.0), 2: (7, 0.0), 3: (8, 1.0)}


def test_tokens_and_sentences(spark):
    assert one(spark, T.tokens(F.lit("Hé llo, A1"))) == ["h", "llo", "a1", "h_llo", "llo_a1"]
    assert one(spark, T.tokens(F.lit(""))) == []
    assert one(spark, T.sentences(F.lit('He said "Stop." Then left. 3 more\nnext'))) == ['He said "Stop.', "Then left.", "3 more", "next"]
    assert one(spark, T.money(F.lit("it was $1,234.50, not 12.30 or 7"))) == [1234.5, 12.3]
    assert one(spark, T.order_id(F.lit("##W1"))) == "#W1"
    assert one(spark, T.joined(F.array(F.lit("a"), F.lit("b"), F.lit("c")))) == "a, b and c"


@pytest.mark.parametrize(
    ("said", "n", "malformed"),
    [
        ('ok <tool_call>{"name": "a", "arguments": {}}</tool_call>', 1, False),
        ('<tool_call>{"name": "a", "arguments": {}}', 1, False),
        ('<tool_call>{"name": "a"}</tool_call><tool_call>nope</tool_call>', 0, True),
        ("plain", 0, False),
    ],
)
def test_call_parsing_by_columns_and_by_fold(spark, said, n, malformed):
    p = one(spark, G.parse_calls(F.lit(said)))
    calls, bad = fold.parsed(said)
    assert (len(p.calls), p.malformed) == (n, malformed) == (len(calls), bad)


def test_bare_calls():
    assert fold.bare_call('then {"name": "a", "arguments": {"x": 1}} ok') and not fold.bare_call('{"name": 3} {')


def test_arguments_and_text_scores(spark):
    m = lambda **k: F.create_map(*(F.lit(x) for kv in k.items() for x in kv))
    assert one(spark, G.arguments(m(a="X ", n="100"), m(a="x", n="102"))) == pytest.approx((1 + 1 - 2 / 102 / 0.05) / 2)
    assert one(spark, G.arguments(m(a="x", z="y"), m(a="x"))) == pytest.approx(0.85)
    ratio = difflib.SequenceMatcher(None, "abcd", "abxd", autojunk=False).ratio()
    assert spark.createDataFrame([("ABCD ", "abxd")], "a string, b string").select(G.text_similarity("a", "b").alias("x")).first().x == pytest.approx((ratio - 0.3) / 0.7)


def test_shaping_stays_below_a_right_tool(spark):
    t, f = F.lit(True), F.lit(False)
    assert one(spark, G.shaping(t, t, t, t, t, f, F.lit(1))) == pytest.approx(0.15)
    assert one(spark, G.shaping(t, t, t, t, t, t, F.lit(2))) == pytest.approx(0.0)


def test_consent_ledger_matches_the_fold(spark):
    steps = [("a", "yes"), ("b", "yes"), ("a", "failure"), ("b", "success"), ("a", "fallback"), ("c", "yes"), ("c", "revoke"), ("d", "yes"), ("d", "failure")]
    state = fold.opened()
    for slot, event in steps:
        state = fold.consent(state, slot, event)
    got = episodes.consent_ledger(spark.createDataFrame([(1, i, s, e) for i, (s, e) in enumerate(steps)], "id long, seq long, slot string, event string")).first()
    assert (got.granted, got.suspended) == (",".join(state["granted"]), ",".join(state["suspended"])) == ("a", "d")


def test_transitions(spark):
    o = spark.createDataFrame([("#W1", 1, "pending", 9.0), ("#W2", 1, "delivered", 5.0)], "order_id string, user_id long, status string, total double")
    assert [r.status for r in retail.cancelled(o, F.lit("no longer needed")).orderBy("order_id").collect()] == ["cancelled", "delivered"]
    assert not any(r.ok for r in retail.cancelled(o, F.lit("bored")).collect())
    h = retail.record_hashes(o, "order_id", ("order_id", "status"))
    assert retail.state_hash(h).first() == retail.state_hash(h.repartition(3)).first()


def test_verdicts(spark):
    v = spark.createDataFrame([(1, "accept"), (2, "pending")], "scenario_id long, verdict string")
    assert {tuple(r) for r in review.record_verdict(v, 2, "reject").collect()} == {(1, "accept"), (2, "reject")}
    with pytest.raises(KeyError):
        review.record_verdict(v, 3, "reject")
    with pytest.raises(ValueError):
        review.record_verdict(v, 1, "maybe")


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("# note\n\na1\n b2 \n")
    assert [r.id for r in files.id_list(spark, str(tmp_path / "ids.txt")).collect()] == ["a1", "b2"]
    (tmp_path / "log.txt").write_text("x {'loss': '0.5', 'step': 3} y\n{'loss': 1.25}\n")
    assert [r.metrics["loss"] for r in files.training_log(spark, str(tmp_path / "log.txt")).orderBy("line").collect()] == [0.5, 1.25]
    reports = tmp_path / "reports"
    reports.mkdir()
    (reports / "a.json").write_text('{"findings": [{"scenario_id": "s1", "issues": [], "severity": "none"}]}')
    (reports / "b.json").write_text("{nope")
    assert sorted((r.scenario_id or "", r.bad) for r in files.judge_reports(spark, str(reports)).collect()) == [("", True), ("s1", False)]
    df = spark.createDataFrame([(1, "x", None), (2, "d", "k")], "id long, kind string, note string")
    sinks.json_lines(df, str(tmp_path / "out"), {"kind": "d"})
    back = files.json_lines(spark, str(tmp_path / "out"), "id long, kind string, note string", {"kind": "d"})
    assert sorted(map(tuple, back.drop("bad").collect())) == sorted(map(tuple, df.collect()))
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\n{nope\n\n')
    assert sorted((r.id or 0, r.bad) for r in files.json_lines(spark, str(tmp_path / "bad.jsonl"), "id long").collect()) == [(0, "{nope"), (1, None)]
    assert sinks.parse_mix("a=0.4,b=0.1") == {"a": 0.4, "b": 0.1}


def test_streams_give_what_batches_give(spark, small, tmp_path):
    schema = spark.read.parquet(f"{small}/events.parquet").schema
    src = tmp_path / "in"
    spark.read.parquet(f"{small}/events.parquet").repartition(3).write.parquet(str(src))
    s = st.source(spark, str(src), schema.simpleString()[7:-1].replace(":", " "), 3)
    q = st.windows(s, late="40 days").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    want = st.windows(spark.read.parquet(str(src)))
    key = lambda r: (str(r.start), r.event_type, r.n, round(r.total, 6))
    assert sorted(map(key, spark.table("w").collect())) == sorted(map(key, want.collect()))


def test_stream_completes_audits_and_folds_conversations(spark, tmp_path):
    rows = spark.createDataFrame([(t, k, float(k), f"2024-01-0{1 + k} 00:00:00") for t in (1, 2) for k in range(3 if t == 1 else 2)], "task_id long, sample long, reward double, ts string")
    later = spark.createDataFrame([(3, 0, 9.0, "2024-02-01 00:00:00")], rows.schema)
    for part in (rows, later):
        part.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = st.source(spark, str(tmp_path / "in"), "task_id long, sample long, reward double, ts timestamp", 1)
    q = st.audit_completion(s, 3).writeStream.format("memory").queryName("a").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert sorted((r.task_id, r.rewards, r.complete) for r in spark.table("a").collect()) == [(1, [0.0, 1.0, 2.0], True), (2, [0.0, 1.0], False)]
    said = spark.createDataFrame([(1, 0, "user", "please cancel"), (1, 1, "assistant", '<tool_call>{"name": "cancel", "arguments": {}}</tool_call>'), (1, 2, "user", "STOP")], "conv_id long, turn long, role string, text string")
    said.coalesce(1).write.parquet(str(tmp_path / "c"))
    q = st.conversations(st.source(spark, str(tmp_path / "c"), "conv_id long, turn long, role string, text string")).writeStream.format("memory").queryName("c").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    live, batch = spark.table("c").collect()[-1], episodes.replay(said).first()
    assert (live.turns, live.calls, live.end_reason) == (batch.turns, batch.calls, batch.end_reason) == (1, 1, "user_stop")
    assert batch.confirmed == 1


def test_audits_tasks_and_transcripts(spark, tmp_path):
    w = lambda name, text: ((tmp_path / name).write_text(text), str(tmp_path / name))[1]
    audit = w("audit.jsonl", "\n".join(f'{{"scenario_id": "{i}", "sample": {k}, "score": {v}, "blocking": ["x"]}}' for i, vs in (("a", (0, 0)), ("b", (0, 1)), ("c", (1, 1))) for k, v in enumerate(vs)))
    ids, basis = files.zero_variance_ids(spark, audit)
    assert ([r.id for r in ids.collect()], basis) == (["a"], "audit")
    ids, basis = files.zero_variance_ids(spark, w("ids.txt", "\n# note\nq\n"))
    assert ([r.id for r in ids.collect()], basis) == (["q"], "list")
    with pytest.raises(ValueError):
        files.id_list(spark, w("none.txt", "# nothing\n"), needed=True)
    assert {r.id: r.blocking for r in files.blocking_labels(spark, audit).collect()} == {"a": ["x"], "b": ["x"], "c": ["x"]}
    plain, labels = w("plain.jsonl", '{"scenario_id": "a", "score": 1}'), w("labels.json", '{"a": {"blocking": ["y"]}}')
    assert files.blocking_labels(spark, plain) is None
    assert [files.resolve_blocking(spark, *x)[1] for x in ((audit, labels), (plain, labels), (plain, None))] == ["recorded", "label audit", "none"]
    tasks = w("tasks.json", '[{"id": "1", "user_scenario": "s", "evaluation_criteria": {"actions": [{"name": "n", "arguments": {"a": 1}, "requestor": "assistant"}, {"name": "u", "requestor": "user"}]}}, {"id": "2"}]')
    assert {r.id: [(a.name, a.arguments.replace(' ', '')) for a in r.actions] for r in files.trusted_tasks(spark, tasks).collect()} == {"1": [("n", '{"a":1}')], "2": []}
    gold = files.gold_turns(spark, w("turns.jsonl", '{"turn_id": "t1", "task": "1", "sample": 0, "m": 2, "text": "x"}\n{"turn_id": "t2"}'), w("gold.jsonl", '{"turn_id": "t1", "labels": {"refusal": "no"}}'))
    assert [(r.turn_id, r.labels) for r in gold.collect()] == [("t1", {"refusal": "no"})]
    said = files.histories(spark, w("said.jsonl", '{"task": "1", "sample": 0, "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}, {"role": "assistant", "content": "a"}]}'))
    assert sorted(map(tuple, said.collect())) == [("1", 0, 0, "user", "u"), ("1", 0, 1, "assistant", "a")]
    cells = tmp_path / "cells"
    cells.mkdir()
    for name, text in (("good.json", "[]"), ("bad.json", "{nope"), ("odd.json", "{}")):
        (cells / name).write_text(text)
    assert sorted(r.cell for r in files.cell_findings(spark, str(cells)).collect()) == ["bad", "odd"]
    snap = files.Snapshot(spark, str(tmp_path / "snap")).take({"t": spark.range(3).toDF("id")})
    assert snap.table("t").count() == 3 and files.resolved("/x", "/y") == "/x" and files.resolved("nowhere/x", "/y") == "/y/nowhere/x"
    v = spark.createDataFrame([("a", "accept", None), ("b", None, "n")], "scenario_id string, verdict string, note string")
    sinks.save_verdicts(v, str(tmp_path / "v"))
    assert sorted(map(tuple, sinks.load_verdicts(spark, str(tmp_path / "v")).collect())) == [("a", "accept", ""), ("b", "pending", "n")]
    assert sum(sinks.named_mix("even").values()) == pytest.approx(1) and sinks.named_mix("a=1") == {"a": 1.0}


def test_summaries_are_appended_by_batch(spark, tmp_path):
    spark.createDataFrame([(1, 0.5, True), (1, 1.0, False), (2, 0.0, False)], "step long, reward double, success boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("step long, reward double, success boolean").parquet(str(tmp_path / "in"))
    q = sinks.append_summaries(s, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert q.awaitTermination(60)
    got = spark.read.json(str(tmp_path / "out"))
    assert sorted((r.step, r.n, r.mean, r.success) for r in got.collect()) == [(1, 2, 0.75, 0.5), (2, 1, 0.0, 0.0)]


def test_bare_calls():
    yes = ['{"name": "f", "arguments": {}}', 'so {"function": {"parameters": [1], "name": "g"}} it is', 'x { y {"name": "f", "arguments": {"a": [1, {"b": null}]}}', '[{"name":"f","arguments":"s"}]', '{"arguments": {"q": "}"}, "name": "f", "more": [true, -1.5e3]}']
    no = ["", "{}", '{"name": "f"}', '{"name": "", "arguments": {}}', '{"name": 3, "arguments": {}}', '{"name": "f", "arguments": {}', 'name and arguments', '{"a": "name"}, {"arguments": 1}', '{"name" "f", "arguments": {}}']
    assert [fold.bare_call(x) for x in yes] == [True] * len(yes) and [fold.bare_call(x) for x in no] == [False] * len(no) and fold.bare_call(None) is False


def test_texts_are_cleaned_and_split(spark):
    text = "## Plan\n* **Cancel** credit_card_1234567 — now. \"Really?\" (Yes.) it costs $ 1,200.50"
    r = spark.createDataFrame([(text,)], "t string").select(T.clean(F.col("t")).alias("c"), T.sentences(F.col("t")).alias("s"), T.money(F.col("t")).alias("m"), T.claims_done(F.lit("Your order has now been cancelled")).alias("d"), T.claims_done(F.lit("I can cancel it")).alias("n")).first()
    assert r.c.startswith("Plan\nCancel credit_card_1234567  --  now.") and r.s[:2] == ["Plan", "Cancel credit_card_1234567  --  now."] and r.m == [1200.5] and r.d and not r.n


def test_turns_are_analyzed():
    m = [{"pm_id": "credit_card_0000001", "source": "credit_card", "brand": "visa", "last_four": "0001"}, {"pm_id": "paypal_0000001", "source": "paypal"}]
    named = analyzer.payment_mentions("I'll move it from your Visa ending in 0001 to PayPal, e.g. a gift card. The original payment method works.", m, "credit_card_0000001")
    assert [(pm, proposed) for _, _, pm, proposed in named] == [("credit_card_0000001", False), ("credit_card_0000001", False), ("paypal_0000001", True), ("credit_card_0000001", True)]
    assert analyzer.units("Here is the plan:\n- return the lamp\n- refund it\nDo you confirm? Please share your zip.") == ["Here is the plan: return the lamp; refund it;", "Do you confirm?", "Please share your zip."]
    ring = [{"item_id": k, "name": "small ring", "options": {"color": c, "size": "3"}} for k, c in ((1, "red"), (2, "blue"), (3, "dark blue"))]
    facts = {"methods": m, "original": "paypal_0000001", "items": ring[:1], "variants": ring, "orders": ["#W0000001"]}
    s = analyzer.analyze("I can exchange the small ring for the dark blue one on #W0000002 and charge your Visa. Do you confirm (yes/no)?", facts)
    assert s["consent"] and s["action"] == "exchange" and s["payments"] == ["credit_card_0000001"] and s["problems"] == ["#W0000002: not the user's"] and '"item_id": 3' in s["changes"]
    assert analyzer.analyze("Your small ring can be had in green.", facts)["changes"] == "[]" and analyzer.options_said("two reds", {"color": ["red", "blue"]}) == {"color": "red"}
    assert analyzer.option_check(ring[0], {"color": "green"}, ring) == ("none", None) and analyzer.item_spans("", ["x"]) == []
    assert analyzer.analyze("", {})["asks"] == [] and analyzer.analyze(None, {})["action"] is None


def test_scripted_users_and_agents(spark):
    db = {"orders": {"#W0000001": {"order_id": "#W0000001", "status": "pending"}, "#W0000002": {"order_id": "#W0000002", "status": "delivered"}}, "email": "a@b.cc", "user_id": 1}
    requests = [{"order_id": o, "action": a, "status": s, "ask": f"I want to {a} order {o}."} for o, a, s in (("#W0000001", "cancel", "pending"), ("#W0000002", "return", "delivered"))]
    task = {"id": "1", "email": "a@b.cc", "identity": "My email is a@b.cc.", "opening": "Hi! I want to cancel order #W0000001.", "requests": requests, "other_order": "#W9999999", "db": db, "ends": {"#W0000001": "cancelled", "#W0000002": "return requested"}, "facts": {"orders": list(db["orders"])}}
    got = {a: scripted.episode(task, f) for a, f in scripted.AGENTS.items()}
    assert {a: r["reward"] for a, r in got.items()} == {"oracle": 1.0, "no_identity": 0.7, "no_consent": 0.7, "wrong_order": 0.0, "two_calls": 0.7, "stops": 0.0, "transfers": 0.0, "repeats": 0.0}
    assert got["repeats"]["end_reason"] == "gave_up" and got["transfers"]["end_reason"] == "transfer" and got["oracle"]["writes"] == got["oracle"]["confirmed"] == 2
    df = spark.createDataFrame([("1", json.dumps(task)), ("2", "{}")], "id string, task string")
    rows = {(r.id, r.agent): r for r in rollouts.rollouts(df, ("oracle", "stops")).collect()}
    assert rows["1", "oracle"].reward == 1.0 and rows["2", "oracle"].end_reason.startswith("error") and len(rows) == 4
    with pytest.raises(ValueError):
        rollouts.rollouts(df, ("nobody",))
