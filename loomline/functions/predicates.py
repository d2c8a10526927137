"""Fixed values and row predicates of the score analytics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Thresholds that results must share.
EFFECTIVE_MIN_STD = 0.05
EPSILON = 1e-9
LOW_YIELD = 0.25
MIX_FLOOR = 0.03
RANGE_TOL = 1e-3
PREFILTER_TOL = 1e-9
MASKED_END_REASONS = ("truncated", "context_budget", "runner_error")


def effective(std: Column, min_std: float = EFFECTIVE_MIN_STD) -> Column:
    """A sample std of at least min_std, but for rounding."""
    return F.coalesce(std, F.lit(0.0)) >= min_std - EPSILON


def solved(mean: Column, min_std: float = EFFECTIVE_MIN_STD) -> Column:
    return mean >= 1 - max(min_std, 1e-3) - EPSILON


def group_class(n: Column, lo: Column, hi: Column, first: Column, tol: float = RANGE_TOL) -> Column:
    """empty, usable, cold_start, already_solved or stuck_partial."""
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, "empty")
        .when(hi - lo > tol, "usable")
        .when(first <= tol, "cold_start")
        .when(first >= 1 - tol, "already_solved")
        .otherwise("stuck_partial")
    )


def record_class(n: Column, lo: Column, hi: Column, all_ok: Column, any_ok: Column, tol: float = PREFILTER_TOL) -> Column:
    """unjudged, live, solved, dead or flat_other."""
    return F.when(n < 2, "unjudged").when(hi - lo > tol, "live").when(all_ok, "solved").when(~any_ok, "dead").otherwise("flat_other")


def masked(end_reason: Column) -> Column:
    return end_reason.isin(*MASKED_END_REASONS)


def flat_at(scores: Column, target: float, tol: float) -> Column:
    """Every score of a group within tol of the target; an aggregate."""
    return F.bool_and(F.abs(scores - target) <= tol)


def cell(category: Column, theme: Column) -> Column:
    return F.concat_ws("__", category, theme)


def split_cell(scenario_id: Column) -> Column:
    """(category, theme) of an id; without two separators the theme is unknown."""
    parts = F.split(scenario_id, "__")
    return F.struct(parts[0].alias("category"), F.when(F.size(parts) > 2, parts[1]).otherwise("unknown").alias("theme"))
