"""Loads every module that registers queries."""

from __future__ import annotations

import importlib

from loomline.registry import CORE, Registry

MODULES = [f"loomline.plans.{m}" for m in ("analytics", "selecting", "texts", "retail", "reviews", "events", "supply", "prompts", "templates", "execution", "reports", "turns", "rewards")]


def load() -> Registry:
    for m in MODULES:
        importlib.import_module(m)
    return CORE
