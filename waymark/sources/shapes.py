"""Shapes of configuration objects, read by one generic parser.

A shape is a table of entries: key, rule and default. A rule is a predicate with
the words for what it accepts. Everything wrong with an object is reported at
once, each with its place.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

REQUIRED = object()


@dataclass(frozen=True)
class Rule:
    accepts: str
    holds: Callable[[Any], bool]


@dataclass(frozen=True)
class Entry:
    """A key that an object may have; without a default it must."""

    key: str
    rule: Rule
    default: Any = REQUIRED


class Malformed(ValueError):
    """What was expected and found, by place."""

    def __init__(self, faults: Sequence[tuple[str, str, Any]]) -> None:
        lines = [f"{place}: {accepts} expected, {found!r} found" for place, accepts, found in faults]
        super().__init__("; ".join(lines))


def _is_number(value: Any) -> bool:
    try:
        return not isinstance(value, bool) and float(value) == float(value)
    except (TypeError, ValueError):
        return False


ANY = Rule("anything", lambda value: True)
TEXT = Rule("a text", lambda value: isinstance(value, str) and bool(value.strip()))
TEXTS = Rule(
    "a list of texts",
    lambda value: isinstance(value, list) and bool(value) and all(map(TEXT.holds, value)),
)
NUMBER = Rule("a number", _is_number)
NUMBERS = Rule(
    "a list of numbers",
    lambda value: isinstance(value, list) and bool(value) and all(map(_is_number, value)),
)
SHARE = Rule("a number from 0 to 1", lambda value: _is_number(value) and 0 <= float(value) <= 1)
WHOLE = Rule("a whole number", lambda value: _is_number(value) and float(value).is_integer())
OBJECT = Rule("an object", lambda value: isinstance(value, Mapping))
ARRAY = Rule("a list", lambda value: isinstance(value, list))


def one_of(table: Mapping[str, Any]) -> Rule:
    """A rule for the keys of a table, which may grow later."""
    return Rule("a known name", lambda value: isinstance(value, str) and value in table)


def parsed(value: Any, shape: Sequence[Entry], place: str) -> dict[str, Any]:
    """The entries of ``shape`` in ``value``, defaults filled in."""
    expect(value, OBJECT, place)
    found = {e.key: value.get(e.key, e.default) for e in shape}
    faults = [
        (f"{place}.{e.key}", e.rule.accepts, None if found[e.key] is REQUIRED else found[e.key])
        for e in shape
        if found[e.key] is not e.default or e.default is REQUIRED
        if found[e.key] is REQUIRED or not e.rule.holds(found[e.key])
    ]
    if faults:
        raise Malformed(faults)
    return found


def expect(value: Any, rule: Rule, place: str) -> Any:
    if not rule.holds(value):
        raise Malformed([(place, rule.accepts, value)])
    return value
