"""Byte-level BPE by a deterministic tokenization automaton.

The automaton reads tokens and accepts exactly the sequences that the merge
list produces. It starts as one state with a loop for each byte. Each merge
``u v -> w``, in order, is a gadget: ``v`` may no longer follow ``u``, and ``w``
leads wherever ``u v`` led. All arcs of one token end in one state, so a state
is named by its last token; a gadget then only copies arcs, and whether an arc
exists can be told from the gadgets of its two tokens:

* the state of ``w`` starts as a copy of the state of ``v``;
* an arc ``w`` leaves each state that an arc ``u`` leaves;
* the arc ``v`` of the state of ``u`` is removed.

A word has one accepted path, so each of its prefixes has one last token. That
gives a second automaton, over bytes: its state is the longest text at hand
that begins some token, with the last tokens of the prefixes that end inside
it. Its transition table is filled as words need it; encoding a word is one
table look-up a byte, and decoding writes the labels of the arcs.

Edge cases: a null or empty text has no tokens and decodes to empty; special
tokens in a text are single tokens; repeated rows are encoded each; further
columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.words import release, slices

# Fixed value: how byte-level tokenizers split a text into words.
WORD_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


def ascii_pattern() -> str:
    """The same for texts of ASCII alone, with the classes spelt out."""
    plain = [chr(k) for k in range(128)]
    space, letter, digit = (
        "".join(re.escape(c) for c in plain if regex.match(kind, c))
        for kind in (r"\s", r"\p{L}", r"\p{N}")
    )
    return (
        f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{digit}]+| ?[^{space}{letter}{digit}]+"
        f"|[{space}]+(?![^{space}])|[{space}]+"
    )


#: Words whose tokens a task remembers; it starts anew when there are more.
REMEMBERED_WORDS = 500_000
#: Transitions that a task holds; it starts anew when there are more.
REMEMBERED_MOVES = 400_000
_WIDE = 20
_START = -2


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    stand_ins = {chr(b): b for b in plain}
    return stand_ins | {chr(256 + k): b for k, b in enumerate(others)}


class TokenAutomaton:
    """States and arcs compiled from a vocabulary and its merges."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        of = byte_characters()
        self.label = {i: bytes(of[c] for c in t) for t, i in vocabulary.items()}
        self.token = {label: i for i, label in self.label.items()}
        size = max(self.label, default=-1) + 1
        self.length = [len(self.label.get(i, b"")) for i in range(size)]
        self.gadget = [0] * size
        self.first = [-1] * size
        self.second = [-1] * size
        self.removed: dict[int, int] = {}
        self.live = [True] * size
        self.table: dict[int, bool] = {}
        for order, (u, v) in enumerate(merges, 1):
            left, right, made = vocabulary[u], vocabulary[v], vocabulary[u + v]
            # Without an arc to remove the gadget has nothing to act on.
            self.live[made] = self._arc(left, right, order - 1)
            self.gadget[made] = order
            self.first[made], self.second[made] = left, right
            self.removed[left << _WIDE | right] = order
        self.beginnings = {t[:k] for t in self.token for k in range(1, len(t) + 1)}
        self.forget()

    def _arc(self, state: int, token: int, order: int) -> bool:
        """Whether ``token`` leaves ``state`` after the first ``order`` gadgets."""
        gadget, removed = self.gadget, self.removed
        while True:
            if removed.get(state << _WIDE | token, order + 1) <= order:
                return False
            of_state, of_token = gadget[state], gadget[token]
            if of_token > of_state:
                if not self.live[token]:
                    return False
                token, order = self.first[token], of_token
            elif of_state == 0:
                return True
            else:
                if of_token == of_state:
                    token = self.first[token]
                state, order = self.second[state], of_state - 1

    def follows(self, state: int, token: int) -> bool:
        key = state << _WIDE | token
        known = self.table.get(key)
        if known is None:
            known = self.table[key] = self._arc(state, token, len(self.removed))
        return known

    def forget(self) -> None:
        """Empty the transition tables."""
        self.table.clear()
        self.moves: dict[int, int] = {}
        # Of each state over bytes: its text, the last tokens of the prefixes
        # from the text's begin to its end, and the last of these.
        self.texts = [b""]
        self.windows: list[tuple[int, ...]] = [(_START,)]
        self.last = [_START]
        self.number = {(b"", (_START,)): 0}

    def _arc_into(self, text: bytes, window: tuple[int, ...]) -> int:
        """The last token of the prefix that ends with ``text``, or -1.

        ``window`` holds the last tokens of the prefixes before it.
        """
        for size in range(len(text), 0, -1):
            arc = self.token.get(text[-size:])
            if arc is not None and self.live[arc]:
                before = window[-size]
                if before == _START or (before >= 0 and self.follows(before, arc)):
                    return arc
        return -1

    def _move(self, state: int, byte: int) -> int:
        text = self.texts[state] + bytes([byte])
        while text and text not in self.beginnings:
            text = text[1:]
        arc = self._arc_into(text, self.windows[state])
        window = (*self.windows[state], arc)[-len(text) - 1 :]
        after = self.number.setdefault((text, window), len(self.texts))
        if after == len(self.texts):
            self.texts.append(text)
            self.windows.append(window)
            self.last.append(arc)
        self.moves[state << 8 | byte] = after
        return after

    def path(self, word: bytes) -> tuple[int, ...]:
        """The tokens on the accepted path of ``word``."""
        moves, last, length = self.moves, self.last, self.length
        states = []
        state = 0
        for byte in word:
            try:
                state = moves[state << 8 | byte]
            except KeyError:
                state = self._move(state, byte)
            states.append(state)
        out, at = [], len(word) - 1
        while at >= 0:
            arc = last[states[at]]
            out.append(arc)
            at -= length[arc]
        out.reverse()
        return tuple(out)


class _Known(dict):
    """Words already encoded; a new one goes through the automaton."""

    def __init__(self, automaton: TokenAutomaton, special: dict[str, int]):
        super().__init__()
        self.automaton, self.special = automaton, special

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = self.automaton.path(word.encode())
        self[word] = found
        return found

    def trim(self) -> None:
        if len(self) > REMEMBERED_WORDS:
            self.clear()
        if len(self.automaton.moves) > REMEMBERED_MOVES:
            self.automaton.forget()


class Tokenizer:
    """A tokenizer file of the byte-level BPE kind."""

    def __init__(self, definition: str):
        content = json.loads(definition)
        model = content["model"]
        merges = [
            tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m)
            for m in model["merges"]
        ]
        self.special = {t["content"]: t["id"] for t in content.get("added_tokens", [])}
        vocabulary = {t: i for t, i in model["vocab"].items() if t not in self.special}
        self.automaton = TokenAutomaton(vocabulary, merges)
        self._known = _Known(self.automaton, self.special)
        self._words = regex.compile(WORD_PATTERN)
        self._ascii_words = re.compile(ascii_pattern())
        marks = sorted(map(regex.escape, self.special), key=len, reverse=True)
        self._marks = regex.compile("|".join(marks)) if marks else None
        labels = dict(self.automaton.label)
        labels |= {i: t.encode() for t, i in self.special.items()}
        size = max(labels, default=-1) + 1
        parts = [labels.get(i, b"") for i in range(size)]
        self._lengths = np.array([len(p) for p in parts], np.int64)
        self._starts = np.cumsum(self._lengths) - self._lengths
        self._labels = np.frombuffer(b"".join(parts), np.uint8)

    def encode(self, text: str) -> Iterable[int]:
        if self._marks is not None and self._marks.search(text):
            return self._encode_marked(text)
        words = self._ascii_words if text.isascii() else self._words
        return chain.from_iterable(map(self._known.__getitem__, words.findall(text)))

    def _encode_marked(self, text: str) -> list[int]:
        out: list[int] = []
        at = 0
        for mark in self._marks.finditer(text):
            for word in self._words.findall(text[at : mark.start()]):
                out += self._known[word]
            out.append(self.special[mark[0]])
            at = mark.end()
        for word in self._words.findall(text[at:]):
            out += self._known[word]
        return out

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and each text's offsets."""
        self._known.trim()
        parts = [np.fromiter(self.encode(t), np.int32) for t in texts]
        offsets = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(p) for p in parts], out=offsets[1:])
        return np.concatenate(parts) if parts else np.zeros(0, np.int32), offsets

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of ids; broken UTF-8 becomes replacement characters."""
        lengths = self._lengths[ids]
        ends = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(lengths, out=ends[1:])
        at = np.arange(ends[-1]) + np.repeat(self._starts[ids] - ends[:-1], lengths)
        data = self._labels[at]
        bounds = ends[offsets]
        whole = pa.LargeStringArray.from_buffers(
            len(bounds) - 1, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data.tobytes())
        )
        try:
            whole.validate(full=True)
        except pa.ArrowInvalid:
            content = data.tobytes()
            return pa.array(
                [content[a:b].decode(errors="replace") for a, b in zip(bounds, bounds[1:])],
                pa.string(),
            )
        return whole.cast(pa.string())


@lru_cache(maxsize=1)
def _compiled(definition: str) -> Tokenizer:
    return Tokenizer(definition)


def encode_documents(documents: DataFrame, tokenizer_file: str | Path) -> DataFrame:
    """Token ids of each whole text and the text decoded from them again.

    Returns doc_id, token_ids array<int> and decoded string. The tokenizer file
    is read on the driver and sent to the workers: its size is fixed.
    """
    definition = Path(tokenizer_file).read_text(encoding="utf-8")
    shared = documents.sparkSession.sparkContext.broadcast(definition)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _compiled(shared.value)
        for part in slices(batches):
            texts = part.column("text").fill_null("").to_pylist()
            ids, offsets = tokenizer.encode_all(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids)),
                    tokenizer.decode_all(ids, offsets),
                ],
                ["doc_id", "token_ids", "decoded"],
            )
        del tokenizer
        release(_compiled)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        encode, "doc_id long, token_ids array<int>, decoded string"
    )
