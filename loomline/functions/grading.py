"""Grading of tool calls: parsing, argument matches, rewards, shaping."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the reward.
FLOOR, ARG_BASE, TOLERANCE, EXTRA_KEY, TEXT_FLOOR, SHORT, TRANSFER_CHARS, TRANSFER_SHORT = 0.2, 0.3, 0.05, 0.15, 0.3, 40, 20, 0.6
SHAPING = {"named": 0.02, "family": 0.03, "ids": 0.03, "keys": 0.02, "exact": 0.05}
SHAPING_CAP, SHAPING_MULTI, PREMATURE = 0.15, 0.05, 0.05

CALL = "struct<name:string,arguments:string>"


def call_blocks(text: Column) -> Column:
    """The bodies of the tool-call blocks, an unclosed one up to the end."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>.*?</tool_call>|<tool_call>.*"), F.lit(0))
    return F.transform(found, lambda b: F.trim(F.regexp_replace(b, r"(?s)^<tool_call>|</tool_call>$", "")))


def count_blocks(text: Column) -> Column:
    return F.regexp_count(text, F.lit("<tool_call>"))


def parse_calls(text: Column) -> Column:
    """(calls, content, malformed): one invalid block makes the whole turn text."""
    blocks = call_blocks(text)
    one = lambda b: F.from_json(b, CALL)
    valid = lambda b: F.coalesce(F.get_json_object(b, "$.name").isNotNull() & F.coalesce(F.get_json_object(b, "$.arguments"), F.lit("{}")).startswith("{"), F.lit(False))

    def of(bs: Column) -> Column:
        ok = F.forall(bs, valid) & (F.size(bs) > 0)
        none = F.array().cast(f"array<{CALL}>")
        content = F.trim(F.regexp_extract(text, r"(?s)^(.*?)<tool_call>", 1))
        return F.struct(
            F.when(ok, F.transform(bs, one)).otherwise(none).alias("calls"), F.when(ok, content).otherwise(text).alias("content"), ((F.size(bs) > 0) & ~F.forall(bs, valid)).alias("malformed")
        )

    return F.element_at(F.transform(F.array(blocks), of), 1)


def canonical(args: Column) -> Column:
    """A flat map as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(args))))


def numeric(pred: Column, gold: Column) -> Column:
    """1 at equality, falling to 0 at a relative error of 5 %."""
    p, g = pred.try_cast("double"), gold.try_cast("double")
    near = F.greatest(F.lit(0.0), 1 - F.abs(p - g) / F.abs(g) / TOLERANCE)
    return F.when(pred.isNull() & gold.isNull(), 1.0).when(p.isNull() | g.isNull(), 0.0).when(g == 0, (F.abs(p) < 1e-6).cast("double")).otherwise(near)


def field(pred: Column, gold: Column) -> Column:
    """A field's score by what the values are: nothing, numbers, or short strings."""
    both = pred.try_cast("double").isNotNull() & gold.try_cast("double").isNotNull()
    same = (F.lower(F.trim(pred)) == F.lower(F.trim(gold))).cast("double")
    return F.when(pred.isNull() & gold.isNull(), 1.0).when(pred.isNull() | gold.isNull(), 0.0).when(both, numeric(pred, gold)).otherwise(same)


def arguments(pred: Column, gold: Column) -> Column:
    """The mean over gold keys of field scores, less 0.15 for each unexpected key with a value; 0 at least."""
    keys = F.map_keys(gold)
    each = F.transform(keys, lambda k: field(pred[k], gold[k]))
    mean = F.when(F.size(keys) == 0, 1.0).otherwise(F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(keys), F.lit(1)))
    extra = F.size(F.filter(F.array_except(F.map_keys(pred), keys), lambda k: F.coalesce(F.trim(pred[k]), F.lit("")) != ""))
    return F.greatest(F.lit(0.0), mean - EXTRA_KEY * extra)


def list_field(pred: Column, gold: Column) -> Column:
    """Lists: 1 in order, half for the same values in another order."""
    return F.when(pred == gold, 1.0).when(F.sort_array(pred) == F.sort_array(gold), 0.5).otherwise(0.0)


def transfer(summary: Column) -> Column:
    said = F.length(F.regexp_replace(F.coalesce(summary, F.lit("")), r"\s", "")) >= TRANSFER_CHARS
    return F.when(said, 1.0).otherwise(TRANSFER_SHORT)


def action_reward(c: dict[str, Column]) -> Column:
    """The reward of a turn against the expected one; the order of the branches is its meaning.

    c: pred_tool, gold_tool (null: no call), text (what was said), known (the tool exists), schema_ok,
    gold_fails, pred_fails, same_error, similar (of the errors), output_same, output_decides (the tool's
    output tells right from wrong), state_exact, state (share of the end state), args, mutates, summary.
    """
    graded = lambda share: ARG_BASE + (1 - ARG_BASE) * share
    none, said = c["pred_tool"].isNull(), F.coalesce(F.trim(F.regexp_replace(c["text"], r"\s", " ")), F.lit("-")) != ""
    return (
        F.when(c["gold_tool"].isNull() & none, said.cast("double"))
        .when(c["gold_tool"].isNull() | none | (c["pred_tool"] != c["gold_tool"]) | ~c["known"], 0.0)
        .when(~c["schema_ok"], FLOOR)
        .when(c["gold_tool"] == "transfer_to_human_agents", transfer(c["summary"]))
        .when(c["gold_fails"] & ~c["pred_fails"], FLOOR)
        .when(c["gold_fails"], F.when(c["same_error"], 1.0).otherwise(graded(c["similar"])))
        .when(c["pred_fails"], FLOOR)
        .when(~c["mutates"] & c["output_decides"] & c["output_same"], 1.0)
        .when(~c["mutates"], graded(c["args"]))
        .when(c["state_exact"], 1.0)
        .otherwise(graded(c["state"]))
    )


#: The fields of an order in which any difference makes another outcome, and what the rest is worth.
CRITICAL = (
    "status", "items", "exchange_items", "exchange_new_items", "exchange_payment_method_id", "return_items", "return_payment_method_id",
    "payment_history", "address",
)
STATE_BASE, OTHER_REASON = 0.7, 0.5


def state_match(pred: Column, gold: Column, same_target: Column, of_user: Column) -> Column:
    """How close the record that a write left is to the expected one.

    pred and gold are structs of the `CRITICAL` fields as text, cancel_reason and exchange_price_difference;
    null where there is no such record. Another target, no record, or another critical field is 0; a user's
    record has its address alone. The rest is 0.7, and 0.3 times the mean of the other fields' scores.
    """
    same = lambda names: F.forall(F.array(*(pred[n].eqNullSafe(gold[n]) for n in names)), lambda x: x)
    reason = F.when(pred["cancel_reason"].eqNullSafe(gold["cancel_reason"]), 1.0).otherwise(OTHER_REASON)
    difference = numeric(pred["exchange_price_difference"], gold["exchange_price_difference"])
    return (
        F.when(~same_target | pred.isNull() | gold.isNull(), 0.0)
        .when(of_user, same(("address",)).cast("double"))
        .when(~same(CRITICAL), 0.0)
        .otherwise(STATE_BASE + (1 - STATE_BASE) * (reason + difference) / 2)
    )


def shaping(named: Column, family: Column, ids: Column, keys: Column, exact: Column, premature: Column, n_calls: Column) -> Column:
    """Small credit for a wrong tool: a ladder, capped; a premature write stops at 0.05; several calls cost."""
    ladder = sum((F.when(x, SHAPING[k]).otherwise(0.0) for k, x in zip(SHAPING, (named, family, ids, keys, exact), strict=True)), F.lit(0.0))
    capped = F.when(premature, F.least(ladder, F.lit(PREMATURE))).otherwise(F.least(ladder, F.lit(SHAPING_CAP)))
    return capped - F.when(n_calls > 1, SHAPING_MULTI).otherwise(0.0)


#: Fixed values of the difficulty score.
CATEGORY_BASE = {"happy_path": 0.20, "context": 0.30, "policy": 0.55, "ambiguous": 0.70, "out_of_scope": 0.75}
BUMP = {"none": 0.0, "minor": 0.07, "major": 0.15}


def difficulty(category: Column, action: Column, distractor: Column, severity: Column) -> Column:
    return F.least(F.greatest(0.40 * category + 0.30 * action + 0.20 * distractor + severity, F.lit(0.0)), F.lit(1.0))


def difficulty_label(score: Column) -> Column:
    return F.when(score < 0.40, "easy").when(score < 0.65, "medium").otherwise("hard")


def text_ratio(a: str | None, b: str | None) -> float:
    """Ratcliff-Obershelp similarity of trimmed lower-case texts, scaled from a floor of 0.3."""
    x, y = (a or "").strip().lower(), (b or "").strip().lower()
    m = difflib.SequenceMatcher(None, x, y, autojunk=False)
    # Lengths, then counts of characters, bound the ratio from above: at or below the floor the score is 0 whatever matches.
    if m.real_quick_ratio() <= TEXT_FLOOR or m.quick_ratio() <= TEXT_FLOOR:
        return 0.0
    # The matching blocks are those of `ratio`; what is matched and what the stretches left can match at most bound it on the way.
    total, matched, bound, left = len(x) + len(y), 0, min(len(x), len(y)), [(0, len(x), 0, len(y))]
    while left:
        alo, ahi, blo, bhi = left.pop()
        i, j, k = m.find_longest_match(alo, ahi, blo, bhi)
        bound -= min(ahi - alo, bhi - blo)
        if k:
            matched += k
            bound += k + min(i - alo, j - blo) + min(ahi - i - k, bhi - j - k)
            left += [s for s in ((alo, i, blo, j), (i + k, ahi, j + k, bhi)) if s[0] < s[1] and s[2] < s[3]]
        if total and 2.0 * bound / total <= TEXT_FLOOR:
            return 0.0
    r = 2.0 * matched / total if total else 1.0
    return max(0.0, (r - TEXT_FLOOR) / (1 - TEXT_FLOOR))


def text_similarity(a: str, b: str) -> Column:
    """The same over columns. No built-in function has this measure; use it on the pairs that need it only."""

    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([text_ratio(p, q) for p, q in zip(x, y, strict=True)])

    of.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(of, "double")(a, b)


#: Fixed values of the episode reward.
GATES = {"unauthenticated": 0.3, "unconfirmed": 0.3, "multi_call": 0.3}
REFUSAL = {"clean": 1.0, "denied_after_write": 0.7, "late": 0.4, "transfer": 0.3, "silent": 0.1, "acted": 0.0}


def episode_reward(match: Column, expect_no_write: Column, authed: Column, unconfirmed: Column, wrote: Column, denied: Column, transferred: Column, read_target: Column, other_record: Column) -> Column:
    """End-state match less gates; a ladder for refusal tasks; little for failures that came near."""
    gated = 1.0 - F.when(~authed, 0.3).otherwise(0.0) - F.when(unconfirmed, 0.3).otherwise(0.0)
    refused = F.when(wrote, 0.0).when(transferred, 0.3).when(denied & authed, 1.0).when(denied, 0.7).when(authed & read_target, 0.4).otherwise(0.1)
    near = F.least(F.lit(0.2), F.when(authed, 0.05).otherwise(0.0) + F.when(read_target, 0.05).otherwise(0.0) + F.when(wrote, 0.1).otherwise(0.0))
    return F.round(F.when(expect_no_write, refused).when(match, gated).when(other_record, 0.0).otherwise(near), 3)


def composite_reward(all_denied: Column, match: Column, gates: Column, correct: Column, n: Column, authed: Column) -> Column:
    """Several requests at once: at least 0.4 when all ends well, at most 0.3 otherwise."""
    part = F.least(F.lit(0.3), 0.3 * correct / F.greatest(n, F.lit(1)) + F.when(authed, 0.05).otherwise(0.0))
    return F.round(F.when(all_denied & match, F.greatest(F.lit(0.4), 1 - gates)).otherwise(part), 3)
