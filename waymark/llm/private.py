"""Personal data: exact base patterns, extended by a skip-chain field.

The base patterns find e-mail and IP addresses, payment cards and phone numbers
wherever they are well formed. The field then looks at all tokens with a digit
or an at sign. It learns from the base spans of a bounded sample which tokens
look like parts of them, and skip edges carry a label from one mention to a
repeated or similar one, so that a malformed mention is found as well. Its spans
are added; base spans always stay.

Edge cases: a null or empty text has no spans; repeated rows are searched each;
an empty table gives an empty result; further columns are ignored by
``find_private`` and kept by ``redacted``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.crf import Field, fit_features, marginals, pair_weights
from waymark.llm.spans import SPAN_SCHEMA, SPAN_TYPE, code_points
from waymark.llm.words import Words, slices

KINDS = ("email", "ip", "card", "phone")
#: Documents, about, that the field learns from at most; all their tokens count.
SAMPLE_DOCUMENTS = 20_000
#: Chance from which a token of the field's counts as personal.
CERTAIN = 0.9
_LABELS = len(KINDS) + 1
_FEATURES = 1 << 12

# The base patterns. A digit before an address would only start
# the same attempt again, so it is not tried.
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = np.zeros(256, bool)
_LOCAL[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")] = True
_IP = re.compile(rb"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(rb"[^0-9]+")
_MARK = np.zeros(256, bool)
_MARK[list(b"0123456789@")] = True


def luhn(digits: bytes) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = (digit - 48) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _emails(text: bytes) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find(b"@")
    while at >= 0:
        begin = at
        while begin > free and _LOCAL[text[begin - 1]]:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1)
        if begin < at and domain:
            free = domain.end()
            yield begin, free
        else:
            free = max(free, at + 1)
        at = text.find(b"@", max(free, at + 1))


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """Start, kind and end of each well-formed item, in bytes, in order."""
    out = [(b, 0, e) for b, e in _emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip(b"0") or b"0" for p in m[0].split(b".")]
        if all(len(p) < 4 and int(p) <= 255 for p in parts):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub(b"", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub(b"", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


@dataclass
class Doubtful:
    """The tokens of one text that may be personal."""

    spans: list[tuple[int, int]]
    features: list[list[int]]
    labels: list[int]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


def _feature(kind: str, value: object) -> int:
    return zlib.crc32(f"{kind}={value}".encode()) % _FEATURES


_SHAPES = [(re.compile(rb"[0-9]+"), b"9"), (re.compile(rb"[A-Za-z\x80-\xff]+"), b"a")]
_PLAIN = re.compile(rb"[^0-9A-Za-z]+")


def _shape(token: bytes) -> bytes:
    for pattern, sign in _SHAPES:
        token = pattern.sub(sign, token)
    return token[:24]


def doubtful(text: bytes, words: list[tuple[int, int]], marked: list[int], base) -> Doubtful:
    """Features, base labels and edges of the ``marked`` words."""
    out = Doubtful([], [], [], [], [])
    tokens = [text[slice(*words[w])] for w in marked]
    digits = [_NOT_DIGIT.sub(b"", t) for t in tokens]
    near = [k > 0 and marked[k] - marked[k - 1] == 1 for k in range(len(marked))]
    runs = np.cumsum([not n for n in near]).tolist()
    total: dict[int, bytes] = {}
    left: dict[int, int] = {}
    for run, own in zip(runs, digits):
        total[run] = (total.get(run, b"") + own)[-40:]
        left[run] = left.get(run, 0) + 1
    last: dict[tuple, int] = {}
    at = 0
    for k, (w, token) in enumerate(zip(marked, tokens)):
        begin, end = words[w]
        while at < len(base) and base[at][2] <= begin:
            at += 1
        label = next(
            (b[1] + 1 for b in base[at : at + 4] if b[0] < end and begin < b[2]), 0
        )
        before = text[slice(*words[w - 1])] if w else b""
        after = text[slice(*words[w + 1])] if w + 1 < len(words) else b""
        whole = total[runs[k]]
        left[runs[k]] -= 1
        out.spans.append((begin, end))
        out.labels.append(label)
        out.features.append(
            [
                _feature("bias", ""),
                _feature("shape", _shape(token)),
                _feature("digits", min(len(digits[k]), 20)),
                _feature("length", min(len(token), 40) // 4),
                _feature("run", min(len(whole), 24)),
                _feature("at", token.count(b"@")),
                _feature("dots", min(token.count(b"."), 5)),
                _feature("before", _shape(before)),
                _feature("after", _shape(after)),
            ]
        )
        if near[k]:
            out.chain.append((k - 1, k))
        # Tokens of two runs that end in the same digits pair up from the end.
        keys = [("same", _PLAIN.sub(b"", token).lower())]
        if len(whole) >= 7:
            keys.append(("tail", whole[-7:], left[runs[k]]))
        linked = {last[key] for key in keys if key in last}
        out.skip += [(other, k) for other in sorted(linked)]
        last |= dict.fromkeys(keys, k)
    return out


def _texts(part: pa.RecordBatch) -> Iterator[tuple[int, bytes, list, Doubtful | None]]:
    """Of each row with a mark: position, text, base spans, doubtful tokens."""
    words = Words.of(part.column("text"))
    marks = np.zeros(len(words.data) + 1, np.int64)
    np.cumsum(_MARK[words.data], out=marks[1:])
    flagged = marks[words.ends] > marks[words.starts]
    for row in np.unique(words.texts[flagged]).tolist():
        low, high = words.offsets[row], words.offsets[row + 1]
        text = words.data[low:high].tobytes()
        first, end = words.bounds[row], words.bounds[row + 1]
        own = list(zip((words.starts[first:end] - low).tolist(), (words.ends[first:end] - low).tolist()))
        base = base_spans(text)
        yield row, text, base, doubtful(text, own, np.flatnonzero(flagged[first:end]).tolist(), base)


def learn_field(documents: DataFrame, total: int) -> Field | None:
    """The field, from the base spans of a sample picked by hash of the id."""
    share = min(1.0, SAMPLE_DOCUMENTS / max(total, 1))

    def nodes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for _, _, _, found in _texts(part):
                chain = {b: found.labels[a] for a, b in found.chain}
                skip = {b: found.labels[a] for a, b in found.skip}
                rows += [
                    (f, y, chain.get(k, -1), skip.get(k, -1))
                    for k, (f, y) in enumerate(zip(found.features, found.labels))
                ]
            columns = zip(*rows) if rows else ([], [], [], [])
            kinds = (pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, kinds)],
                ["features", "label", "chain", "skip"],
            )

    place = F.pmod(F.xxhash64(F.lit("field"), "doc_id"), F.lit(1_000_000))
    sample = (
        documents.filter(place < int(share * 1_000_000) + 1)
        .select("text")
        .mapInArrow(nodes, "features array<int>, label int, chain int, skip int")
        .groupBy("features", "label", "chain", "skip")
        .count()
        .toPandas()
        .sort_values(["label", "chain", "skip", "features"], key=_sortable)
    )
    if len(sample) == 0:
        return None
    times = sample["count"].to_numpy(float)
    features = np.stack(sample["features"].to_numpy())
    label, chain, skip = (sample[c].to_numpy() for c in ("label", "chain", "skip"))

    def pairs(other: np.ndarray) -> np.ndarray:
        met = other >= 0
        return pair_weights(other[met], label[met], _LABELS, times[met])

    return Field(
        fit_features(features, label, _FEATURES, _LABELS, times), pairs(chain), pairs(skip)
    )


def _sortable(column: pd.Series) -> pd.Series:
    return column.map(tuple) if column.name == "features" else column


_TRIM_LEFT, _TRIM_RIGHT = b"\"'<[{,;:", b"\"'>]}.,;:!?"


def _added(text: bytes, found: Doubtful, chance: np.ndarray, base) -> list[tuple[int, int, int]]:
    """Runs of tokens with one certain label that no base span touches."""
    label = chance.argmax(axis=1)
    sure = (label > 0) & (chance.max(axis=1) >= CERTAIN)
    out: list[list[int]] = []
    joined = {b for _, b in found.chain}
    previous = -2
    for k in np.flatnonzero(sure).tolist():
        begin, end = found.spans[k]
        if found.labels[k]:
            continue
        if out and previous == k - 1 and k in joined and out[-1][1] == label[k] - 1:
            out[-1][2] = end
        else:
            out.append([begin, int(label[k]) - 1, end])
        previous = k
    trimmed = []
    for begin, kind, end in out:
        part = text[begin:end]
        begin += len(part) - len(part.lstrip(_TRIM_LEFT))
        end -= len(part) - len(part.rstrip(_TRIM_RIGHT))
        if begin < end:
            trimmed.append((begin, kind, end))
    return trimmed


def _found(part: pa.RecordBatch, field: Field | None) -> Iterator[tuple[int, bytes, list]]:
    """Of each row with spans: position, text, (start, kind, end, base)."""
    texts = list(_texts(part))
    chance = None
    begins = np.cumsum([0, *[len(t[3].spans) for t in texts]])
    if field is not None and begins[-1]:
        def edges(name: str) -> np.ndarray:
            parts = [
                np.array(getattr(t[3], name), np.int64).reshape(-1, 2) + b
                for t, b in zip(texts, begins)
            ]
            return np.concatenate(parts)

        features = np.array([f for t in texts for f in t[3].features])
        chance = marginals(field, features, edges("chain"), edges("skip"))
    for (row, text, base, found), begin, end in zip(texts, begins, begins[1:]):
        spans = [(*b, True) for b in base]
        if chance is not None:
            spans += [(*a, False) for a in _added(text, found, chance[begin:end], base)]
        if spans:
            yield row, text, sorted(spans)


def find_private(documents: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end in code points, base) of each text."""
    field = learn_field(documents, documents.count())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows: list[list[dict]] = [[] for _ in range(part.num_rows)]
            for row, text, spans in _found(part, field):
                points = code_points(np.frombuffer(text, np.uint8))
                rows[row] = [
                    {"kind": KINDS[k], "start": int(points[b]), "end": int(points[e]), "base": own}
                    for b, k, e, own in spans
                ]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(rows, SPAN_TYPE)], ["doc_id", "spans"]
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, f"doc_id long, spans {SPAN_SCHEMA}"
    )


def redacted(documents: DataFrame) -> DataFrame:
    """The documents with each personal item replaced by its kind in brackets.

    Overlapping spans become one, named by the first. ``n_chars`` follows the
    new text; a null text stays null.
    """
    field = learn_field(documents, documents.count())
    columns = documents.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            new: dict[int, str] = {}
            for row, text, spans in _found(part, field):
                out, free = [], 0
                for begin, kind, end, _ in spans:
                    if begin >= free:
                        out += [text[free:begin], f"[{KINDS[kind].upper()}]".encode()]
                    free = max(free, end)
                new[row] = b"".join([*out, text[free:]]).decode()
            texts = part.column("text").to_pylist()
            for row, text in new.items():
                texts[row] = text
            place = part.schema.get_field_index("text")
            yield part.set_column(place, "text", pa.array(texts, part.schema.field(place).type))

    return (
        documents.mapInArrow(run, documents.schema)
        .withColumn("n_chars", F.length("text").cast("long"))
        .select(*columns)
    )
