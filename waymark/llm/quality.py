"""Quality rules: boosted trees over document statistics, and base rules.

One pass turns each whole text into counts and shares. The trees learn from a
bounded sample of labelled documents and then judge every document.

Edge cases: a null or empty text has no words and fails the base rules; a label
that is not 0 or 1 is ignored, and without labels of both kinds the base rules
decide alone; repeated rows are judged each; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.boosting import FlatTrees, fit_trees
from waymark.llm.storage import written
from waymark.llm.words import (
    IS_SPACE,
    LEADS,
    Words,
    mix,
    per_text,
    slices,
    span_hashes,
)

#: Words in a window that is searched for repeats.
WINDOW = 8
#: Labelled documents that the trees learn from, the first by hash of the id.
SAMPLE_ROWS = 20_000
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Features and the direction in which each may move the score; 0 is free.
FEATURES = {
    "log_words": 0,
    "mean_word": 0,
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "upper_share": 0,
    "letter_share": 0,
    "digit_share": 0,
    "shout_share": -1,
    "words_per_line": 0,
    "ended_lines": 0,
    "distinct_share": 0,
    "short_share": 0,
}


def _mask(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters.encode())] = True
    return out


_SYMBOL = _mask("#*$%&|<>")
_SHOUT = _mask("!?")
_STOP = _mask(".!?:;\"')")
_DIGIT = _mask("0123456789")
_UPPER = _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER | _mask("abcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 128)
_TEXT_ODD = np.uint64(0xA24BAED4963EE407)
_STEP = np.uint64(0x9FB21C651E98DF25)


def _in_text(hashes: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Make equal hashes of different texts differ."""
    return mix(hashes + texts.astype(np.uint64) * _TEXT_ODD)


def repeated_words(words: Words, window: int = WINDOW) -> np.ndarray:
    """Per text, words inside windows that occur twice or more in it."""
    n = len(words.starts)
    if n < window:
        return np.zeros(len(words.counts), np.int64)
    value = np.zeros(n - window + 1, np.uint64)
    for k in range(window):
        value = value * _STEP + words.hashes[k : n - window + 1 + k]
    at = np.arange(n - window + 1)
    inside = words.texts[at] == words.texts[at + window - 1]
    at = at[inside]
    if len(at) == 0:
        return np.zeros(len(words.counts), np.int64)
    _, which, count = np.unique(
        _in_text(value[at], words.texts[at]), return_inverse=True, return_counts=True
    )
    twice = at[count[which] > 1]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + window, -1)
    return per_text(np.cumsum(cover)[:n] > 0, words.bounds)


def line_counts(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: lines with a word, those equal to an earlier one, ended ones."""
    data, offsets = words.data, words.offsets
    if len(data) == 0:
        none = np.zeros(len(offsets) - 1, np.int64)
        return none, none, none
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))
    # A line ends before its line feed; the last of a text has none.
    ends = ends - (data[np.maximum(ends - 1, 0)] == 10)
    held = np.searchsorted(words.starts, ends) - np.searchsorted(words.starts, starts)
    starts, ends = starts[held > 0], ends[held > 0]
    texts = np.searchsorted(offsets, starts, "right") - 1
    size = len(offsets) - 1
    lines = np.bincount(texts, minlength=size)
    _, first = np.unique(_in_text(span_hashes(data, starts, ends), texts), return_index=True)
    distinct = np.bincount(texts[first], minlength=size)
    last = words.ends[np.searchsorted(words.ends, ends, "right") - 1] if len(ends) else ends
    ended = np.bincount(texts, weights=_STOP[data[last - 1]], minlength=size)
    return lines, lines - distinct, ended


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """Counts and features of each text of a slice."""
    words = Words.of(column)
    data, offsets = words.data, words.offsets
    solid = ~IS_SPACE[data]
    chars = per_text(solid & LEADS[data], offsets)
    size = per_text(solid, offsets)
    count = words.counts
    symbols = per_text(_SYMBOL[data], offsets)
    lines, dups, ended = line_counts(words)
    repeats = repeated_words(words)
    _, first = np.unique(_in_text(words.hashes, words.texts), return_index=True)
    distinct = np.bincount(words.texts[first], minlength=len(count))
    short = per_text(words.ends - words.starts <= 3, words.bounds)

    def share(part, whole):
        return np.asarray(part, float) / np.maximum(whole, 1)

    letters = per_text(_LETTER[data], offsets)
    return {
        "n_words": count,
        "word_chars": chars,
        "n_symbols": symbols,
        "n_dup_lines": dups,
        "n_repeat_words": repeats,
        "log_words": np.log1p(count),
        "mean_word": share(chars, count),
        "symbol_share": share(symbols, count),
        "dup_line_share": share(dups, lines),
        "repeat_share": share(repeats, count),
        "upper_share": share(per_text(_UPPER[data], offsets), letters),
        "letter_share": share(letters, size),
        "digit_share": share(per_text(_DIGIT[data], offsets), size),
        "shout_share": share(per_text(_SHOUT[data], offsets), count),
        "words_per_line": share(count, lines),
        "ended_lines": share(ended, lines),
        "distinct_share": share(distinct, count),
        "short_share": share(short, count),
    }


def document_statistics(documents: DataFrame) -> DataFrame:
    """doc_id, the counts and the features of every document."""
    wide = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, " + ", ".join(
        [f"{c} long" for c in COUNTS] + [f"{c} double" for c in FEATURES]
    )

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = statistics(part.column("text"))
            arrays = [part.column("doc_id")]
            arrays += [pa.array(found[c].astype(np.int64)) for c in COUNTS]
            arrays += [pa.array(found[c].astype(float)) for c in FEATURES]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *COUNTS, *FEATURES])

    return wide.mapInArrow(measure, schema)


def fit_quality(
    measured: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS
) -> FlatTrees | None:
    """Trees from at most ``sample_rows`` labelled documents, or None."""
    known = labels.filter(F.col("quality").isin(0, 1)).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")
    )
    # A little more than the sample by hash, so that each task hands on its share.
    share = min(1.0, 1.2 * sample_rows / max(known.count(), 1))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    sample = (
        measured.join(known.filter(place <= int(share * 1_000_000)), "doc_id")
        .orderBy(F.md5(F.col("doc_id").cast("string")), "quality", *COUNTS)
        .limit(sample_rows)
        .select("quality", *FEATURES)
        .toPandas()
    )
    if sample["quality"].nunique() < 2:
        return None
    return fit_trees(
        sample[list(FEATURES)].to_numpy(),
        sample["quality"].to_numpy(),
        list(FEATURES.values()),
    )


def judge_quality(
    documents: DataFrame,
    labels: DataFrame,
    *,
    threshold: float = 0.5,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Per document: counts, base_failed, the trees' score, kept.

    ``score`` is the chance of good quality, 1 where no trees could be learnt.
    """
    measured = written(document_statistics(documents), "quality-statistics")
    trees = fit_quality(measured, labels, sample_rows)
    base = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")
    )
    names = ["doc_id", *COUNTS]

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy() for c in FEATURES], axis=1)
            chance = np.ones(len(rows)) if trees is None else trees.probability(rows)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(chance)], [*names, "score"]
            )

    schema = ", ".join(f"{c} long" for c in names) + ", score double"
    return (
        measured.mapInArrow(score, schema)
        .withColumn("base_failed", base)
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
        .select(*names, "base_failed", "kept", "score")
    )
