"""The conversation state machine as a pure fold: state and message in, new state and rows out.

Batch replay and streaming use the same function. The state is a plain dict of JSON values.
"""

from __future__ import annotations

import json
import re

#: Limits and tool names.
GIVE_UP = 3
WRITES = ("cancel", "exchange", "return", "modify", "purchase")
CALL = re.compile(r"<tool_call>(.*?)(?:</tool_call>|\Z)", re.S)


def opened(max_turns: int = 30, max_calls: int = 30) -> dict:
    """The state before the first message."""
    return {
        "turns": 0, "calls": 0, "malformed": 0, "multi": 0, "authed": None, "granted": [], "suspended": [], "writes": 0,
        "confirmed": 0, "last": None, "streak": 0, "end": None, "max_turns": max_turns, "max_calls": max_calls,
    }


def parsed(text: str) -> tuple[list[dict], bool]:
    """The calls of a turn, and whether it is malformed; one bad block spoils all."""
    calls = []
    for body in CALL.findall(text or ""):
        try:
            c = json.loads(body)
        except ValueError:
            return [], True
        if not isinstance(c, dict) or not isinstance(c.get("name"), str) or not isinstance(c.get("arguments", {}), dict):
            return [], True
        calls.append(c)
    return calls, False


#: The words of JSON, for text inside an object.
WORD = re.compile(r'\s*(?:(?P<text>"(?:[^"\\\x00-\x1f]|\\.)*")|(?P<mark>[{}\[\],:])|(?P<rest>-?\d[\d.eE+-]*|true|false|null))')


def bare_call(text: str) -> bool:
    """Whether a text holds a JSON object, nested or not, with a name and arguments or parameters, outside any block.

    One pass with a stack of the objects and lists that are open. What isn't JSON closes all of them, and
    the search for the next object goes on from there.
    """
    text, at = text or "", 0
    open_: list[dict] = []
    while True:
        if not open_:
            at = text.find("{", at)
            if at < 0:
                return False
        m = WORD.match(text, at)
        top = open_[-1] if open_ else None
        if m is None or not _fits(top, m):
            open_, at = [], at + (m is None or not open_)
            continue
        at = m.end()
        mark = m["mark"]
        if mark in ("{", "["):
            open_.append({"list": mark == "[", "want": "value" if mark == "[" else "key", "empty": True})
        elif mark in ("}", "]"):
            done = open_.pop()
            if done.get("name") and done.get("arguments"):
                return True
            if open_:
                open_[-1]["want"] = "next"
        elif mark == ",":
            top["want"] = "value" if top["list"] else "key"
        elif mark == ":":
            top["want"] = "value"
            top["arguments"] = top.get("arguments") or top["key"] in ('"arguments"', '"parameters"')
        elif top["want"] == "key":
            top.update(key=m["text"], want="colon", empty=False)
        else:
            if not top["list"] and top["key"] == '"name"':
                top["name"] = m["text"] not in (None, '""')
            top.update(want="next", empty=False)


def _fits(top: dict | None, m: re.Match) -> bool:
    """Whether a word may stand where the innermost open object or list is."""
    mark = m["mark"]
    if top is None:
        return mark == "{"
    want, closing = top["want"], "]" if top["list"] else "}"
    if mark == closing:
        return want == "next" or top["empty"]
    if want == "next":
        return mark == ","
    if want == "colon":
        return mark == ":"
    if want == "key":
        return m["text"] is not None
    top["empty"] = False
    return mark in (None, "{", "[")


def consent(state: dict, slot: str, event: str) -> dict:
    """The ledger of consents: yes grants, success uses up, failure suspends, fallback restores, revoke clears."""
    granted, held = set(state["granted"]), set(state["suspended"])
    if event == "yes":
        granted.add(slot)
        held.discard(slot)
    elif event == "success":
        granted.discard(slot)
    elif event == "failure" and slot in granted:
        granted.discard(slot)
        held.add(slot)
    elif event == "fallback" and slot in held:
        held.discard(slot)
        granted.add(slot)
    elif event == "revoke":
        granted.discard(slot)
        held.discard(slot)
    return {**state, "granted": sorted(granted), "suspended": sorted(held)}


def step(state: dict, role: str, text: str) -> dict:
    """The state after a message; an ended conversation stays as it is."""
    if state["end"]:
        return state
    s = dict(state)
    text = text or ""
    if role == "assistant":
        s["turns"] += 1
        calls, bad = parsed(text)
        s["malformed"] += bad
        s["multi"] += len(calls) > 1
        s["calls"] += len(calls)
        for c in calls:
            name = c["name"]
            if name == "lookup" and c.get("arguments", {}).get("user"):
                s["authed"] = str(c["arguments"]["user"])
            if name in WRITES:
                s["writes"] += 1
                s["confirmed"] += name in s["granted"]
                s = consent(s, name, "success")
        key = re.sub(r"\W+", " ", text.lower()).strip()
        s["streak"] = s["streak"] + 1 if key == s["last"] else 1
        s["last"] = key
        if s["streak"] >= GIVE_UP:
            s["end"] = "gave_up"
        elif s["turns"] >= s["max_turns"]:
            s["end"] = "max_turns"
        elif s["calls"] >= s["max_calls"]:
            s["end"] = "max_calls"
    elif role == "user":
        low = text.lower()
        for w in WRITES:
            if w in low:
                s = consent(s, w, "revoke" if re.search(r"\b(no|don't|stop)\b", low) else "yes")
        if "STOP" in text:
            s["end"] = "user_stop"
    return s
