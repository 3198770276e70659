"""Deterministic automata over bytes, compiled from several regexes at once.

The regexes go through Thompson's construction, subset construction and
minimisation by partition refinement. The result is one transition array, a
row of 256 for each state, with accepting states last.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from re import _constants as op
from re import _parser as parser

DEAD = 0


class _Nfa:
    """Byte transitions and empty moves; every state is a number."""

    def __init__(self, backward: bool = False) -> None:
        self.backward = backward
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def add(self, items, begin: int) -> int:
        """Hang the parsed ``items`` on ``begin``; return where they end."""
        for kind, value in reversed(items) if self.backward else items:
            if kind in (op.LITERAL, op.IN, op.NOT_LITERAL, op.ANY):
                end = self.state()
                self.moves[begin].append((_bytes(kind, value), end))
            elif kind is op.SUBPATTERN:
                end = self.add(value[3], begin)
            elif kind is op.BRANCH:
                end = self.state()
                for choice in value[1]:
                    self.empty[self.add(choice, self._fork(begin))].append(end)
            elif kind is op.MAX_REPEAT:
                end = self._repeat(*value, begin)
            else:
                raise ValueError(f"A rule uses {kind}, which has no automaton.")
            begin = end
        return begin

    def _fork(self, state: int) -> int:
        new = self.state()
        self.empty[state].append(new)
        return new

    def _repeat(self, least: int, most, items, begin: int) -> int:
        for _ in range(least):
            begin = self.add(items, begin)
        end = self._fork(begin)
        if most is op.MAXREPEAT:
            loop = self._fork(begin)
            self.empty[self.add(items, loop)] += [loop, end]
        else:
            for _ in range(most - least):
                begin = self.add(items, begin)
                self.empty[begin].append(end)
        return end

    def closure(self, states) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for other in self.empty[todo.pop()]:
                if other not in found:
                    found.add(other)
                    todo.append(other)
        return frozenset(found)


def _bytes(kind, value) -> frozenset[int]:
    if kind is op.LITERAL:
        return frozenset([value])
    if kind is op.ANY:
        return frozenset(range(256)) - {10}
    if kind is op.NOT_LITERAL:
        return frozenset(range(256)) - {value}
    out: set[int] = set()
    negated = False
    for inner, given in value:
        if inner is op.NEGATE:
            negated = True
        elif inner is op.LITERAL:
            out.add(given)
        elif inner is op.RANGE:
            out.update(range(given[0], given[1] + 1))
        else:
            raise ValueError(f"A rule's class uses {inner}, which has no automaton.")
    return frozenset(range(256)) - out if negated else frozenset(out)


def _both_cases(members: frozenset[int]) -> frozenset[int]:
    letters = [b for b in members if chr(b).isascii() and chr(b).isalpha()]
    return members | {b ^ 32 for b in letters}


@dataclass(frozen=True)
class Automaton:
    """``table[state * 256 + byte]`` is the next state; state 0 is dead.

    ``rules[state]`` holds a bit for each rule that ends there, and states from
    ``accepting`` on hold at least one. ``resets`` are the bytes that lead to
    ``start`` from wherever the automaton is.
    """

    table: np.ndarray
    start: int
    rules: np.ndarray
    accepting: int
    resets: np.ndarray


def compile_rules(
    patterns: list[tuple[str, bool]], *, anywhere: bool, backward: bool = False
) -> Automaton:
    """One automaton of all ``(pattern, any_case)``.

    With ``anywhere`` a match may begin at each byte, so the automaton says
    after each byte which rules end there; otherwise it reads from a fixed
    start and dies where no rule can go on. With ``backward`` it reads texts from
    their ends, and a rule ends where its matches begin.
    """
    nfa = _Nfa(backward)
    begin = nfa.state()
    ends: dict[int, int] = {}
    for rule, (pattern, any_case) in enumerate(patterns):
        first = len(nfa.moves)
        end = nfa.add(parser.parse(pattern, re.ASCII), nfa._fork(begin))
        ends[end] = 1 << rule
        if any_case:
            for state in range(first, len(nfa.moves)):
                nfa.moves[state] = [(_both_cases(m), t) for m, t in nfa.moves[state]]
    again = nfa.closure([begin]) if anywhere else frozenset()
    start = nfa.closure([begin])
    dead = frozenset()
    number = {dead: 0, start: 1}
    order = [dead, start]
    rows: list[np.ndarray] = []
    for subset in order:
        reach: list[set[int]] = [set() for _ in range(256)]
        for state in subset:
            for members, target in nfa.moves[state]:
                for byte in members:
                    reach[byte].add(target)
        known: dict[frozenset[int], int] = {}
        row = np.zeros(256, np.int64)
        for byte, targets in enumerate(reach):
            key = frozenset(targets)
            if key not in known:
                after = nfa.closure(key) | again if subset or anywhere else dead
                if after not in number:
                    number[after] = len(order)
                    order.append(after)
                known[key] = number[after]
            row[byte] = known[key]
        rows.append(row)
    mask = np.array([sum(ends.get(s, 0) for s in subset) for subset in order])
    return _minimal(np.array(rows), mask, 1)


def _minimal(rows: np.ndarray, mask: np.ndarray, start: int) -> Automaton:
    """Merge states that no text tells apart; order them by acceptance."""
    _, block = np.unique(mask, return_inverse=True)
    while True:
        signature = np.column_stack([block, block[rows]])
        _, finer = np.unique(signature, axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == block.max():
            break
        block = finer
    _, first = np.unique(block, return_index=True)
    # Dead first, accepting last.
    rank = np.lexsort((first, mask[first] != 0, first != 0))
    place = np.empty(len(rank), np.int64)
    place[rank] = np.arange(len(rank))
    table = place[block[rows[first[rank]]]].astype(np.int32)
    mask = mask[first[rank]]
    accepting = int(np.searchsorted(mask != 0, True))
    begin = int(place[block[start]])
    live = table if anywhere_state(table) else table[1:]
    resets = (live == begin).all(axis=0)
    return Automaton(table.ravel(), begin, mask, accepting, resets)


def anywhere_state(table: np.ndarray) -> bool:
    """Whether state 0 is an ordinary state rather than a dead end."""
    return bool((table[0] != 0).any())
