"""Secret scans by one combined deterministic automaton.

The marks of all rules are compiled into one minimal automaton that runs over
every byte once. Bytes that always lead back to its start let a slice of texts
be cut into short lanes, which then move through the transition array together.
Only texts with a mark are looked at again: the rule's backward automaton reads
the text once from its end and tells where matches begin, and its forward one
reads from there, so matches are leftmost, longest and do not overlap, and no
text is read again from starts that lead to nothing.

Edge cases: a null or empty text has no spans; repeated rows are scanned each;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.automaton import Automaton, compile_rules
from waymark.llm.spans import SPAN_SCHEMA, SPAN_TYPE, code_points
from waymark.llm.words import slices, text_bytes


@dataclass(frozen=True)
class SecretRule:
    """``mark`` is a shorter regex that each match of ``pattern`` contains.

    A match of fewer than ``least`` bytes is dropped, as is one whose last
    group, counted from the first byte that could end the match, has fewer than
    ``least_value``.
    """

    kind: str
    pattern: str
    mark: str
    least: int = 1
    least_value: int = 1
    any_case: bool = False
    base: bool = False


_ASSIGN = (
    "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]"
)
# The base rules, then published formats of access tokens.
RULES = (
    SecretRule("assign", _ASSIGN + "+", _ASSIGN, least_value=6, any_case=True, base=True),
    SecretRule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]", least=20, base=True),
    SecretRule("hex", "[0-9a-f]+", "[0-9a-f]{24}", least=24, base=True),
    SecretRule("github", "gh[pousr]_[A-Za-z0-9]{36,}", "gh[pousr]_[A-Za-z0-9]"),
    SecretRule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", "xox[abprs]-[A-Za-z0-9]"),
    SecretRule("google", "AIza[A-Za-z0-9_-]{35,}", "AIza[A-Za-z0-9_-]"),
    SecretRule(
        "jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", "\\.eyJ"
    ),
    SecretRule(
        "key",
        "-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY( BLOCK)?-----",
        "-----BEGIN ",
    ),
)
LANE_BYTES = 256
SCAN_BYTES = 1 << 21


@lru_cache(maxsize=4)
def marks_automaton(rules: tuple[SecretRule, ...]) -> Automaton:
    return compile_rules([(r.mark, r.any_case) for r in rules], anywhere=True)


@lru_cache(maxsize=64)
def rule_automaton(rule: SecretRule) -> Automaton:
    return compile_rules([(rule.pattern, rule.any_case)], anywhere=False)


@lru_cache(maxsize=64)
def begins_automaton(rule: SecretRule) -> tuple[list[int], int, int]:
    """Transitions, start and first accepting state of the backward automaton."""
    found = compile_rules([(rule.pattern, rule.any_case)], anywhere=True, backward=True)
    return found.table.tolist(), found.start, found.accepting


def match_begins(raw: bytes, rule: SecretRule) -> list[int]:
    """Where a match of the rule can begin, in order."""
    table, state, accepting = begins_automaton(rule)
    found = []
    for at in range(len(raw) - 1, -1, -1):
        state = table[state << 8 | raw[at]]
        if state >= accepting:
            found.append(at)
    found.reverse()
    return found


def marked(data: np.ndarray, offsets: np.ndarray, automaton: Automaton) -> np.ndarray:
    """Per text, the bits of the rules whose mark it holds."""
    out = np.zeros(len(offsets) - 1, np.int64)
    if len(data) == 0:
        return out
    resets = np.flatnonzero(automaton.resets[data]) + 1
    resets = resets[resets < len(data)]
    block = resets // LANE_BYTES
    new = np.ones(len(resets), bool)
    new[1:] = block[1:] != block[:-1]
    begins = np.union1d(offsets[:-1], resets[new])
    begins = begins[begins < len(data)]
    lengths = np.diff(np.append(begins, len(data)))
    order = np.argsort(-lengths, kind="stable")
    at, left = begins[order], lengths[order]
    state = np.full(len(at), automaton.start, np.int32)
    active = np.searchsorted(-left, -np.arange(left[0]), "left")
    for step in range(left[0]):
        n = active[step]
        state = state[:n]
        state = automaton.table.take((state << 8) | data.take(at[:n] + step))
        hit = np.flatnonzero(state >= automaton.accepting)
        if len(hit):
            texts = np.searchsorted(offsets, at[hit] + step, "right") - 1
            np.bitwise_or.at(out, texts, automaton.rules[state[hit]])
    return out


def matches(data: np.ndarray, rule: SecretRule) -> list[tuple[int, int]]:
    """Leftmost longest matches of a rule in one text, as byte ranges."""
    automaton = rule_automaton(rule)
    table, accepting = automaton.table, automaton.accepting
    raw = data.tobytes()
    out, free = [], 0
    for begin in match_begins(raw, rule):
        if begin < free:
            continue
        state, end, value = automaton.start, -1, 0
        for at in range(begin, len(raw)):
            state = int(table[(state << 8) | raw[at]])
            if state == 0:
                break
            if state >= accepting:
                end = at + 1
                value += 1
        if end > 0:
            free = end
            if end - begin >= rule.least and value >= rule.least_value:
                out.append((begin, end))
    return out


def find_secrets(
    documents: DataFrame, rules: tuple[SecretRule, ...] = RULES
) -> DataFrame:
    """doc_id and spans (kind, start, end in code points, base) of each text.

    Spans are in order of start, then of their rule. A span of a further rule
    is left out where a span of its own kind and place is already there.
    """

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = marks_automaton(rules)
        for part in slices(batches, limit=SCAN_BYTES):
            data, offsets = text_bytes(part.column("text"))
            found: list[list[dict]] = [[] for _ in range(part.num_rows)]
            bits = marked(data, offsets, automaton)
            for row in np.flatnonzero(bits).tolist():
                text = data[offsets[row] : offsets[row + 1]]
                points = code_points(text)
                spans = [
                    (int(points[b]), k, int(points[e]))
                    for k, rule in enumerate(rules)
                    if bits[row] >> k & 1
                    for b, e in matches(text, rule)
                ]
                found[row] = [
                    {"kind": rules[k].kind, "start": b, "end": e, "base": rules[k].base}
                    for b, k, e in sorted(spans)
                ]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(found, SPAN_TYPE)], ["doc_id", "spans"]
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        scan, f"doc_id long, spans {SPAN_SCHEMA}"
    )
