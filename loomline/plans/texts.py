"""Queries on text matching, conversations, parsing and grading."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomline.functions import grading as G
from loomline.functions import text as T
from loomline.operators import decontam as dc
from loomline.registry import CORE
from loomline.session import spread
from loomline.sources import bind


def _two(spark, d):
    docs = bind.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return docs, bind.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")


TOK = """(select id, unnest(list_concat(ws, case when len(ws) > 1 then list_transform(range(1, len(ws)), lambda i: ws[i] || '_' || ws[i + 1]) else [] end)) as tok
  from (select id, regexp_extract_all(lower(text), '[a-z0-9]+') as ws from {src}) w)"""
DOCS, BENCH = "(select doc_id as id, text from documents)", "(select item_id as id, text from benchmark)"
TF = f"""tf as (select 0 as side, id, tok, count(*) as tf from {TOK.format(src=DOCS)} a group by all union all select 1, id, tok, count(*) from {TOK.format(src=BENCH)} b group by all),
  df as (select tok, count(*) as df from tf group by 1), n as (select (select count(*) from documents) + (select count(*) from benchmark) as n),
  w as (select side, id, tok, tf * (ln((1.0 + n) / (1 + df)) + 1) as w from tf join df using (tok), n),
  wt as (select side, id, tok, w / sqrt(sum(w * w) over (partition by side, id)) as weight from w)"""
BEST = f"""{TF}, s as (select a.id, b.id as match_id, round(sum(a.weight * b.weight), 9) as similarity from wt a join wt b on a.tok = b.tok and a.side = 0 and b.side = 1 group by 1, 2),
  m as (select * from s qualify row_number() over (partition by id order by similarity desc, match_id) = 1),
  best as (select d.doc_id as id, coalesce(m.match_id, (select min(item_id) from benchmark)) as match_id, coalesce(m.similarity, 0) as similarity from documents d left join m on m.id = d.doc_id)"""


@CORE.query("tokenize_ngrams", f"select id, count(*) as n, count(distinct tok) as n_distinct from {TOK.format(src=BENCH)} t group by 1")
def tokenize_ngrams(spark, d):
    t = dc.counts(_two(spark, d)[1], "id", "text")
    return t.groupBy("id").agg(F.sum("tf").alias("n"), F.count("*").alias("n_distinct"))


@CORE.query("tfidf_weights", f"with {TF} select id, tok, round(weight, 6) as weight from wt where side = 1")
def tfidf_weights(spark, d):
    return dc.held_weights(*_two(spark, d)).select("id", "tok", F.round("weight", 6).alias("weight"))


@CORE.query("decontam_best_match", f"with {BEST} select id, match_id, round(similarity, 6) as similarity from best")
def decontam_best_match(spark, d):
    return dc.best_match(*_two(spark, d)).withColumn("similarity", F.round("similarity", 6))


@CORE.query(
    "decontam_flags",
    f"with {BEST}, t as (select avg(similarity) + 3 * stddev_pop(similarity) as t from best) select id, match_id, round(similarity, 6) as similarity from best, t where similarity >= t - 1e-9",
)
def decontam_flags(spark, d):
    return dc.flags(dc.best_match(*_two(spark, d))).filter("flagged").select("id", "match_id", F.round("similarity", 6).alias("similarity"))


@CORE.query(
    "decontam_report",
    f"""with {BEST}, t as (select avg(similarity) + 3 * stddev_pop(similarity) as t from best), f as (select id, match_id, round(similarity, 4) as similarity from best, t where similarity >= t - 1e-9)
    select cast(0 as bigint) as rank, cast(null as bigint) as id, cast(null as bigint) as match_id, round(t, 4) as similarity from t
    union all select row_number() over (order by similarity desc, id), id, match_id, similarity from f""",
)
def decontam_report(spark, d):
    return dc.report(dc.flags(dc.best_match(*_two(spark, d))))


@CORE.query(
    "embedding_best_match",
    """with c as (select label, list(x order by pos) as c from (select label, pos, avg(x) as x from (select label, unnest(range(1, len(embedding) + 1)) as pos, unnest(embedding)::double as x from embeddings) e group by 1, 2) a group by 1)
    select vec_id, c.label as match_label, round(list_cosine_similarity(embedding::double[], c), 6) as similarity from embeddings, c
    qualify row_number() over (partition by vec_id order by round(list_cosine_similarity(embedding::double[], c), 6) desc, c.label) = 1""",
)
def embedding_best_match(spark, d):
    return dc.centroid_match(bind.table(spark, d, "embeddings"))


@CORE.query("excerpts", "select doc_id, case when length(trim(text)) <= 300 then trim(text) else rtrim(left(trim(text), 299)) || '…' end as excerpt from documents")
def excerpts(spark, d):
    return bind.table(spark, d, "documents").select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


@CORE.query("email_mentions", "select doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}')) as email from documents")
def email_mentions(spark, d):
    return bind.table(spark, d, "documents").select("doc_id", F.explode(T.emails(F.col("text"))).alias("email"))


@CORE.query("sentence_split")
def sentence_split(spark, d):
    return bind.table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(T.clean(F.col("text")))).alias("pos", "sentence"))


@CORE.query(
    "money_mentions",
    r"select o_orderkey, len(v) as n, round(v[1], 2) as first_amount from (select o_orderkey, [cast(o_totalprice as double)] as v from orders) t",
)
def money_mentions(spark, d):
    said = F.concat(F.lit("The total is $"), F.format_number("o_totalprice", 2), F.lit(" today"))
    return bind.table(spark, d, "orders").select("o_orderkey", T.money(said).alias("v")).select("o_orderkey", F.size("v").cast("long").alias("n"), F.round(F.col("v")[0], 2).alias("first_amount"))


@CORE.query(
    "joined_names",
    "select user_id, case when len(n) = 1 then n[1] else array_to_string(n[1:len(n) - 1], ', ') || ' and ' || n[len(n)] end as names from (select user_id, list(distinct event_type order by event_type) as n from events group by 1) t",
)
def joined_names(spark, d):
    n = bind.table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("n"))
    return n.select("user_id", T.joined(F.col("n")).alias("names"))


@CORE.query("turn_acts")
def turn_acts(spark, d):
    t = F.col("text")
    return bind.table(spark, d, "conversations").select("conv_id", "turn", T.request(t).alias("request"), T.consent(t).alias("consent"), T.refusal(t).alias("refusal"), T.claims_done(t).alias("claims_done"), T.action(t).alias("action"))


# --- conversations ----------------------------------------------------------------------


@CORE.query("last_user_message", "select conv_id, arg_max(text, turn) as text, max(turn) as turn from conversations where role = 'user' group by 1")
def last_user_message(spark, d):
    u = bind.table(spark, d, "conversations").filter("role = 'user'")
    return u.groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"), F.max("turn").alias("turn"))


@CORE.query(
    "next_assistant_turn",
    "select conv_id, turn, min(case when role = 'assistant' then turn end) over (partition by conv_id order by turn rows between 1 following and unbounded following) as next_turn from conversations",
)
def next_assistant_turn(spark, d):
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(1, W.unboundedFollowing)
    return bind.table(spark, d, "conversations").select("conv_id", "turn", F.min(F.when(F.col("role") == "assistant", F.col("turn"))).over(w).alias("next_turn"))


@CORE.query(
    "turn_numbering",
    "select conv_id, turn, row_number() over w as number, cast(count(*) filter (where role = 'user') over w as bigint) as user_turns from conversations window w as (partition by conv_id order by turn)",
)
def turn_numbering(spark, d):
    w = W.partitionBy("conv_id").orderBy("turn")
    return bind.table(spark, d, "conversations").select("conv_id", "turn", F.row_number().over(w).alias("number"), F.count_if(F.col("role") == "user").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("user_turns"))


@CORE.query(
    "writes_since_user_turn",
    """with s as (select *, count(*) filter (where event_type = 'view') over (partition by user_id order by ts, event_id) as session from events)
    select user_id, session, count(*) filter (where event_type = 'purchase') as writes from s group by 1, 2""",
)
def writes_since_user_turn(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    s = bind.table(spark, d, "events").withColumn("session", F.count_if(F.col("event_type") == "view").over(w))
    return s.groupBy("user_id", "session").agg(F.count_if(F.col("event_type") == "purchase").alias("writes"))


@CORE.query(
    "answer_streaks",
    """with c as (select *, case when event_type is distinct from lag(event_type) over (partition by user_id order by ts, event_id) then 1 else 0 end as new from events),
    s as (select *, sum(new) over (partition by user_id order by ts, event_id) as streak from c)
    select user_id, event_type, max(n) as longest, bool_or(n >= 3) as gives_up from (select user_id, event_type, streak, count(*) as n from s group by 1, 2, 3) t group by 1, 2""",
)
def answer_streaks(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    new = (~F.col("event_type").eqNullSafe(F.lag("event_type").over(w))).cast("int")
    s = bind.table(spark, d, "events").withColumn("new", new).withColumn("streak", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    n = s.groupBy("user_id", "event_type", "streak").agg(F.count("*").alias("n"))
    return n.groupBy("user_id", "event_type").agg(F.max("n").alias("longest"), F.bool_or(F.col("n") >= 3).alias("gives_up"))


@CORE.query(
    "revealed_ids_prefix",
    """with f as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, min(l_linenumber) over (partition by l_orderkey, l_suppkey) as first_line from lineitem)
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, first_line < l_linenumber as revealed from f""",
)
def revealed_ids_prefix(spark, d):
    w = W.partitionBy("l_orderkey", "l_suppkey")
    li = bind.table(spark, d, "lineitem").withColumn("first_line", F.min("l_linenumber").over(w))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("first_line") < F.col("l_linenumber")).alias("revealed"))


@CORE.query(
    "prompt_render",
    "select conv_id, sha256(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' order by turn)) as prompt_sha256 from conversations group by 1",
)
def prompt_render(spark, d):
    one = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n"))
    rows = F.sort_array(F.collect_list(F.struct("turn", one.alias("t"))))
    return bind.table(spark, d, "conversations").groupBy("conv_id").agg(F.sha2(F.array_join(F.transform(rows, lambda r: r["t"]), ""), 256).alias("prompt_sha256"))


# --- parsing and grading, over calls made from events -----------------------------------


def _calls(spark, d):
    e = bind.table(spark, d, "events")
    block = F.concat(F.lit('<tool_call>{"name": "'), "event_type", F.lit('", "arguments": '), "props", F.lit("}"), F.when(F.col("event_id") % 3 != 0, "</tool_call>").otherwise(""))
    text = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("plain "), "event_type")).when(F.col("event_id") % 7 == 0, F.concat(F.lit("ok "), F.regexp_replace(block, r"\}\}", "}"))).otherwise(F.concat(F.lit("ok "), block))
    return e.select("event_id", text.alias("text"))


@CORE.query(
    "parse_tool_calls",
    """select event_id, case when event_id % 5 = 0 or event_id % 7 = 0 then 0 else 1 end as n_calls, case when event_id % 5 = 0 or event_id % 7 = 0 then null else event_type end as name,
    case when event_id % 5 = 0 or event_id % 7 = 0 then null else json_extract_string(props, '$.k') end as k, event_id % 5 <> 0 and event_id % 7 = 0 as malformed from events""",
)
def parse_tool_calls(spark, d):
    p = _calls(spark, d).select("event_id", G.parse_calls(F.col("text")).alias("p"))
    first = F.get("p.calls", F.lit(0))
    return p.select("event_id", F.size("p.calls").alias("n_calls"), first["name"].alias("name"), F.get_json_object(first["arguments"], "$.k").alias("k"), "p.malformed")


_BLOCKS = """(select event_id, event_type || repeat('<tool_call>' || props || case when event_id % 3 = 0 then '</tool_call> ' else '' end, cast(event_id % 4 as int)) || case when event_id % 5 = 0 then '<tool_cal>' else '' end as text from events)"""


@CORE.query("count_call_blocks", f"select event_id, cast((length(text) - length(replace(text, '<tool_call>', ''))) / 11 as bigint) as blocks from {_BLOCKS} b")
def count_call_blocks(spark, d):
    i = F.col("event_id")
    block = F.concat(F.lit("<tool_call>"), F.col("props"), F.when(i % 3 == 0, "</tool_call> ").otherwise(""))
    text = F.concat("event_type", F.repeat(block, (i % 4).cast("int")), F.when(i % 5 == 0, "<tool_cal>").otherwise(""))
    return bind.table(spark, d, "events").select("event_id", G.count_blocks(text).cast("long").alias("blocks"))


@CORE.query(
    "argument_match",
    """with e as (select event_id, cast(json_extract_string(props, '$.k') as double) as g, cast(json_extract_string(props, '$.k') as double) + event_id % 4 as p from events)
    select event_id, round(greatest(0, case when g = 0 then case when abs(p) < 1e-6 then 1 else 0 end else greatest(0, 1 - abs(p - g) / abs(g) / 0.05) end - case when event_id % 3 = 0 then 0.15 else 0 end), 6) as score from e""",
)
def argument_match(spark, d):
    e = bind.table(spark, d, "events")
    g = F.get_json_object("props", "$.k")
    pred = F.create_map(F.lit("k"), (g.cast("double") + F.col("event_id") % 4).cast("string"), F.lit("extra"), F.when(F.col("event_id") % 3 == 0, "x").otherwise(""))
    return e.select("event_id", F.round(G.arguments(pred, F.create_map(F.lit("k"), g)), 6).alias("score"))


@CORE.query(
    "jaccard_keys",
    """with u as (select user_id, list(distinct event_type) filter (where value < 50) as a, list(distinct event_type) filter (where value >= 50) as b from events group by 1)
    select user_id, round(case when len(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))) = 0 then 0 else len(list_intersect(coalesce(a, []), coalesce(b, []))) / len(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))) end, 6) as jaccard from u""",
)
def jaccard_keys(spark, d):
    u = bind.table(spark, d, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("value") < 50, F.col("event_type"))).alias("a"), F.collect_set(F.when(F.col("value") >= 50, F.col("event_type"))).alias("b"))
    return u.select("user_id", F.round(dc.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


_SEV = "case when toxic = 1 then 'major' when quality = 0 then 'minor' else 'none' end"


@CORE.query(
    "difficulty_scores",
    f"""with s as (select doc_id as id, case lang when 'en' then 0.20 when 'fr' then 0.30 when 'de' then 0.55 else 0.75 end as c, doc_id % 5 / 4 as a, doc_id % 3 / 2 as x,
      case coalesce({_SEV}, 'none') when 'major' then 0.15 when 'minor' then 0.07 else 0 end as b from documents left join labels using (doc_id)),
    t as (select id, least(greatest(0.40 * c + 0.30 * a + 0.20 * x + b, 0), 1) as score from s)
    select id, round(score, 6) as score, case when round(score, 9) < 0.40 then 'easy' when round(score, 9) < 0.65 then 'medium' else 'hard' end as label from t""",
)
def difficulty_scores(spark, d):
    sev = F.when(F.col("toxic") == 1, 0.15).when(F.col("quality") == 0, 0.07).otherwise(0.0)
    s = bind.table(spark, d, "documents").join(bind.table(spark, d, "labels"), "doc_id", "left")
    base = F.when(F.col("lang") == "en", 0.20).when(F.col("lang") == "fr", 0.30).when(F.col("lang") == "de", 0.55).otherwise(0.75)
    score = G.difficulty(base, F.col("doc_id") % 5 / 4, F.col("doc_id") % 3 / 2, sev)
    return s.select(F.col("doc_id").alias("id"), score.alias("s")).select("id", F.round("s", 6).alias("score"), G.difficulty_label(F.round("s", 9)).alias("label"))


@CORE.query("text_similarity_ratio")
def text_similarity_ratio(spark, d):
    """Each whole document against the benchmark item of its number."""
    b = bind.table(spark, d, "benchmark").select("item_id", F.col("text").alias("gold"))
    docs = bind.table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 40).alias("item_id"), F.col("text").alias("said"))
    return spread(docs, "doc_id", 1000).join(F.broadcast(b), "item_id").select("doc_id", "item_id", F.round(G.text_similarity("said", "gold"), 6).alias("score"))


_ACT = """(select event_id, case when event_id % 13 = 0 then null when event_id % 3 = 0 then 'transfer_to_human_agents' when event_id % 3 = 1 then 'get_order_details' else 'cancel_pending_order' end as gold,
  case when event_id % 17 < 2 then null when event_id % 19 = 0 then 'cancel_pending_order' when event_id % 13 = 0 and event_id % 2 = 0 then null when event_id % 13 = 0 then 'calculate' when event_id % 3 = 0 then 'transfer_to_human_agents' when event_id % 3 = 1 then 'get_order_details' else 'cancel_pending_order' end as pred,
  case event_id % 5 when 0 then '  ' || chr(10) when 1 then null else event_type end as said, event_id % 23 <> 0 as known, event_type <> 'error' as schema_ok, user_id % 4 = 0 as gold_fails, user_id % 3 = 0 as pred_fails,
  user_id % 8 = 0 as same_error, value / 1000 as sim, value > 60 as output_same, user_id % 7 <> 0 as decides, value > 150 as state_exact, least(value / 400, 1.0) as state, least(value / 200, 1.0) as args,
  event_id % 3 = 2 as mutates, case when value > 80 then 'the caller wants a person' when value > 40 then ' a  b c d e f g h i j ' else props end as summary from events)"""


@CORE.query(
    "action_reward",
    f"""select event_id, round(case when gold is null then case when pred is not null then 0.0 when trim(translate(said, chr(10), ' ')) = '' then 0.0 else 1.0 end
      when pred is null or pred <> gold or not known then 0.0 when not schema_ok then 0.2
      when gold = 'transfer_to_human_agents' then case when length(regexp_replace(summary, '\\s', '', 'g')) >= 20 then 1.0 else 0.6 end
      when gold_fails then case when not pred_fails then 0.2 when same_error then 1.0 else 0.3 + 0.7 * sim end when pred_fails then 0.2
      when not mutates then case when decides and output_same then 1.0 else 0.3 + 0.7 * args end when state_exact then 1.0 else 0.3 + 0.7 * state end, 8) as reward from {_ACT} a""",
)
def action_reward(spark, d):
    e = bind.table(spark, d, "events")
    i, u, v = F.col("event_id"), F.col("user_id"), F.col("value")
    tool = F.when(i % 3 == 0, "transfer_to_human_agents").when(i % 3 == 1, "get_order_details").otherwise("cancel_pending_order")
    none = F.lit(None).cast("string")
    pred = F.when(i % 17 < 2, none).when(i % 19 == 0, "cancel_pending_order").when((i % 13 == 0) & (i % 2 == 0), none).when(i % 13 == 0, "calculate").otherwise(tool)
    c = {
        "gold_tool": F.when(i % 13 == 0, none).otherwise(tool), "pred_tool": pred, "text": F.when(i % 5 == 0, "  \n").when(i % 5 == 1, none).otherwise(F.col("event_type")),
        "known": i % 23 != 0, "schema_ok": F.col("event_type") != "error", "gold_fails": u % 4 == 0, "pred_fails": u % 3 == 0, "same_error": u % 8 == 0, "similar": v / 1000,
        "output_same": v > 60, "output_decides": u % 7 != 0, "state_exact": v > 150, "state": F.least(v / 400, F.lit(1.0)), "args": F.least(v / 200, F.lit(1.0)), "mutates": i % 3 == 2,
        "summary": F.when(v > 80, "the caller wants a person").when(v > 40, " a  b c d e f g h i j ").otherwise(F.col("props")),
    }
    return e.select("event_id", F.round(G.action_reward(c), 8).alias("reward"))


_KEPT = ("items", "exchange_items", "exchange_new_items", "exchange_payment_method_id", "return_items", "return_payment_method_id", "payment_history", "address")


@CORE.query(
    "state_match",
    f"""with g as (select o_orderkey as id, o_custkey as who, o_orderstatus as status, o_orderpriority as reason, o_totalprice as diff from orders),
    p as (select o_orderkey as id, o_custkey as who, case when o_orderkey % 5 = 0 then 'cancelled' else o_orderstatus end as status, case when o_orderkey % 2 = 0 then 'other' else o_orderpriority end as reason,
      case when o_orderkey % 3 = 0 then null else o_totalprice * (1 + (o_orderkey % 9) / 100) end as diff, case when o_orderkey % 7 = 0 then 'changed' else 'x' end as kept, o_orderkey % 11 <> 0 as there from orders)
    select id, round(case when id % 13 = 0 or not there then 0 when id % 4 = 0 then case when kept = 'x' then 1 else 0 end when p.status <> g.status or kept <> 'x' then 0
      else 0.7 + 0.3 * (case when p.reason = g.reason then 1.0 else 0.5 end + case when p.diff is null then 0.0 when g.diff = 0 then cast(abs(p.diff) < 1e-6 as int) else greatest(0, 1 - abs(p.diff - g.diff) / abs(g.diff) / 0.05) end) / 2 end, 5) as score
    from g join p using (id)""",
)
def state_match(spark, d):
    i = F.col("o_orderkey")
    kept = lambda x: [x.alias(n) for n in _KEPT]
    rest = lambda reason, diff: [reason.alias("cancel_reason"), diff.cast("string").alias("exchange_price_difference")]
    gold = F.struct(F.col("o_orderstatus").alias("status"), *kept(F.lit("x")), *rest(F.col("o_orderpriority"), F.col("o_totalprice")))
    diff = F.when(i % 3 != 0, F.col("o_totalprice") * (1 + (i % 9) / 100))
    pred = F.struct(F.when(i % 5 == 0, "cancelled").otherwise(F.col("o_orderstatus")).alias("status"), *kept(F.when(i % 7 == 0, "changed").otherwise("x")), *rest(F.when(i % 2 == 0, "other").otherwise(F.col("o_orderpriority")), diff))
    o = bind.table(spark, d, "orders").select(i.alias("id"), F.when(i % 11 != 0, pred).alias("pred"), gold.alias("gold"))
    return o.select("id", F.round(G.state_match(F.col("pred"), F.col("gold"), F.col("id") % 13 != 0, F.col("id") % 4 == 0), 5).alias("score"))


@CORE.query(
    "episode_reward",
    """with e as (select user_id, bool_or(event_type = 'signup' and value > 100) as authed, bool_or(event_type = 'purchase' and value > 200) as wrote, bool_or(event_type = 'error' and value > 150) as denied,
      bool_or(event_type = 'view' and value > 200) as rd from events group by 1)
    select user_id, round(case when user_id % 2 = 0 then case when wrote then 0.0 when denied and authed then 1.0 when denied then 0.7 when authed and rd then 0.4 else 0.1 end
      when wrote and rd then 1.0 - case when authed then 0 else 0.3 end
      else least(0.2, case when authed then 0.05 else 0 end + case when rd then 0.05 else 0 end + case when wrote then 0.1 else 0 end) end, 3) as reward from e""",
)
def episode_reward(spark, d):
    any_of = lambda k, v: F.bool_or((F.col("event_type") == k) & (F.col("value") > v))
    e = bind.table(spark, d, "events").groupBy("user_id").agg(any_of("signup", 100).alias("authed"), any_of("purchase", 200).alias("wrote"), any_of("error", 150).alias("denied"), any_of("view", 200).alias("rd"))
    no = F.lit(False)
    return e.select("user_id", G.episode_reward(F.col("wrote") & F.col("rd"), F.col("user_id") % 2 == 0, F.col("authed"), no, F.col("wrote"), F.col("denied"), no, F.col("rd"), no).alias("reward"))
