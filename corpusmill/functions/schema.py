"""Contracts of answers: a small schema language compiled to checks, and the contracts themselves.

A schema is built from the functions below; ``problem`` gives the path and rule of the first failure in the order of the
schema, or None. Integers may be written as 1.0; true and false are no numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from corpusmill.functions import fixed

#: (path, rule) of the first failure, or None.
Check = Callable[[object, str], "tuple[str, str] | None"]


def string(least: int = 0, one_of: tuple[str, ...] = ()) -> Check:
    def check(v, at):
        if not isinstance(v, str):
            return at, "type string"
        if len(v) < least:
            return at, f"length {least} or more"
        return (at, "one of " + ", ".join(one_of)) if one_of and v not in one_of else None

    return check


def number(least: float | None = None, whole: bool = False) -> Check:
    def check(v, at):
        if isinstance(v, bool) or not isinstance(v, (int, float)) or whole and v != int(v):
            return at, "type integer" if whole else "type number"
        return (at, f"{least} or more") if least is not None and v < least else None

    return check


def boolean() -> Check:
    return lambda v, at: None if isinstance(v, bool) else (at, "type boolean")


def null() -> Check:
    return lambda v, at: None if v is None else (at, "type null")


def array(of: Check, least: int = 0) -> Check:
    def check(v, at):
        if not isinstance(v, list):
            return at, "type array"
        if len(v) < least:
            return at, f"{least} entries or more"
        return next((p for i, x in enumerate(v) if (p := of(x, f"{at}[{i}]"))), None)

    return check


def obj(fields: dict[str, Check] | None = None, required: tuple[str, ...] = (), closed: bool = True) -> Check:
    fields = fields or {}

    def check(v, at):
        if not isinstance(v, dict):
            return at, "type object"
        for k in required:
            if k not in v:
                return at, f"field {k}"
        for k, f in fields.items():
            if k in v and (p := f(v[k], f"{at}.{k}")):
                return p
        extra = next((k for k in v if k not in fields), None) if closed else None
        return (at, f"no field {extra}") if extra is not None else None

    return check


def either(*checks: Check) -> Check:
    return lambda v, at: None if any(c(v, at) is None for c in checks) else (at, "one of several types")


_EXTRA = {"extra": obj(closed=False)}
_MONEY = obj({"currency": string(), "amount": number(0)})

ENVELOPE = obj(
    {
        "summary": string(1), "assumptions": array(string(1)), "uncertainty_notes": string(), "next_steps": array(string(1)), "verification_steps": array(string(1)),
        "payload_type": string(one_of=fixed.PAYLOAD_TYPES), "payload": obj(closed=False), "metadata": obj(closed=False),
    },
    fixed.ENVELOPE_KEYS,
)

PAYLOADS: dict[str, Check] = {
    "itinerary": obj(
        {
            "title": string(1),
            "trip_days": array(
                obj(
                    {
                        "day": number(1, whole=True), "summary": string(),
                        "items": array(
                            obj(
                                {
                                    "time_block": string(), "activity": string(), "location": string(), "transport": obj({"mode": string(one_of=fixed.TRANSPORT_MODES), "details": string()}),
                                    "cost_estimate": _MONEY, "booking_needed": boolean(), "warnings": array(string()),
                                },
                                ("time_block", "activity"),
                            ),
                            1,
                        ),
                    },
                    ("day", "summary", "items"),
                ),
                1,
            ),
            "timezone": string(), "total_budget": _MONEY, "notes": string(), **_EXTRA,
        },
        ("title", "trip_days"),
    ),
    "checklist": obj(
        {
            "title": string(1),
            "groups": array(
                obj({"name": string(), "items": array(obj({"text": string(), "priority": string(one_of=("must", "should", "nice_to_have")), "when": string(), "done": boolean(), "notes": string()}, ("text",)), 1)}, ("name", "items")), 1
            ),
            **_EXTRA,
        },
        ("title", "groups"),
    ),
    "decision_tree": obj(
        {
            "title": string(1), "root_question": string(1),
            "nodes": array(
                obj(
                    {
                        "id": string(1), "type": string(one_of=("question", "decision", "outcome")), "text": string(), "question": string(),
                        "options": array(either(string(), obj({"choice": string(), "next_node_id": either(string(), null()), "outcome": either(string(), null())}))), "action": string(),
                    },
                    ("id",),
                ),
                1,
            ),
            "edges": array(obj({"from": string(), "to": string(), "condition": string()}, ("from", "to"))), **_EXTRA,
        },
        ("title", "nodes"),
    ),
    "procedure": obj(
        {
            "title": string(1), "steps": array(obj({"step": number(1, whole=True), "instruction": string(), "why": string(), "warning": string(), "requires": array(string())}, ("step", "instruction")), 1),
            "estimated_time": string(), "preconditions": array(string()), "postchecks": array(string()), **_EXTRA,
        },
        ("title", "steps"),
    ),
}


def problem(check: Check, value: object) -> tuple[str, str] | None:
    return check(value, "$")
