"""Repeated passages, found by relative Lempel-Ziv parsing against reference blocks.

A window is ``window`` consecutive words of one document. A word goes if a window
that covers it also stands in a document with a smaller id.

1. Texts that are equal are one class, led by its smallest id. In the others of
   a class all windows stand in the leader, so only leaders go on.
2. Each window picks an anchor: of its short word sequences the one with the
   least hash. Equal windows pick equal anchors, and neighbouring windows mostly
   share one. Only anchors of two or more leaders can hold a repeated window.
3. The stretch of text whose windows share an anchor is a segment. Equal segments
   become one, with the smallest id that has it: any later document repeats that
   segment whole. So a passage that a third of all documents hold is one row
   before anything is compared.
4. Anchors are dealt out to blocks of bounded size. A block's segments are its
   reference, indexed by window, and are parsed in the order of their ids: from
   each word on, the longest stretch of an earlier document is a factor; no
   factor of at least a window there makes the word a literal. After a factor the
   parse goes on with the first window that lies across its end, so windows over
   factor boundaries are looked up too. Factors are the repeated spans.
5. An anchor with more than ``crowd`` segments would overfill its block. There
   every window is a segment of its own, so step 3 alone already finds which
   document has it first, and such segments are dealt out by their words.

Passages are compared as words, not as hashes; classes and segments are known by
128-bit digests.

Edge cases: a null, empty or blank text and texts shorter than a window lose
nothing; a null id counts as larger than all others; rows with one id never
remove each other's words; repeated rows have the same result; an empty table
gives an empty result; further columns are ignored. A passage repeated within one
document only stays.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.storage import dropped, written
from waymark.llm.words import Words, mix, release, slices

WINDOW = 13
#: Words of an anchor.
ANCHOR = 5
#: Segments beyond which an anchor is a crowd; segments of one block.
CROWD, BLOCK_SEGMENTS = 2_000, 40_000
_STEP = np.uint64(0x9FB21C651E98DF25)
_LAST = (1 << 63) - 1
RANGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_RANGES = "array<struct<start:long,end:long>>"


def picked(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, where each one's anchor starts, and its hash."""
    n = len(words.starts)
    if n < window:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    values = np.zeros(n - anchor + 1, np.uint64)
    for k in range(anchor):
        values = values * _STEP + words.hashes[k : n - anchor + 1 + k]
    values = mix(values)
    starts = np.flatnonzero(words.texts[: n - window + 1] == words.texts[window - 1 :])
    at, least = starts.copy(), values[starts]
    for k in range(1, window - anchor + 1):
        other = values[starts + k]
        less = other < least
        at[less], least[less] = starts[less] + k, other[less]
    return starts, at, least


def stretches(starts: np.ndarray, at: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """First window of each segment: neighbours with one anchor stay together.

    Windows marked in ``alone`` are segments of their own.
    """
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(starts) != 1) | (np.diff(at) != 0) | alone[1:]
    return np.flatnonzero(new)


def _anchors(leaders: DataFrame, window: int, anchor: int) -> DataFrame:
    """row, id and the anchors of each text, once for each segment."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = Words.of(part.column("text"))
            starts, at, values = picked(words, window, anchor)
            first = stretches(starts, at, np.zeros(len(starts), bool))
            text = words.texts[starts[first]]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("row").take(pa.array(text)),
                    part.column("id").take(pa.array(text)),
                    pa.array(values[first].view(np.int64)),
                ],
                ["row", "id", "anchor"],
            )
        release()

    return leaders.select("row", "id", "text").mapInArrow(run, "row long, id long, anchor long")


def _segments(chosen: DataFrame, window: int, anchor: int) -> DataFrame:
    """The segments of the wanted anchors: place in the text, and the words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = Words.of(part.column("text"))
            starts, at, values = picked(words, window, anchor)
            values = values.view(np.int64)
            bounds = np.searchsorted(starts, words.bounds)
            wanted, alone = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
            for k in range(part.num_rows):
                of = slice(bounds[k], bounds[k + 1])
                wanted[of] = np.isin(values[of], part.column("anchors")[k].values.to_numpy())
                alone[of] = np.isin(values[of], part.column("crowds")[k].values.to_numpy())
            starts, at, values, alone = (x[wanted] for x in (starts, at, values, alone))
            first = stretches(starts, at, alone)
            last = np.append(first[1:], len(starts))[: len(first)] - 1
            begin, end = starts[first], starts[last] + window
            text = words.texts[begin]
            line = words.joined(np.arange(len(words.starts)))
            place = np.concatenate([[0], np.cumsum(words.ends - words.starts + 1)])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("row").take(pa.array(text)),
                    part.column("id").take(pa.array(text)),
                    pa.array(begin - words.bounds[text]),
                    pa.array(end - words.bounds[text]),
                    pa.array(values[first]),
                    pa.array(alone[first]),
                    pa.array(
                        [line[a:b] for a, b in zip(place[begin].tolist(), (place[end] - 1).tolist())],
                        pa.binary(),
                    ).cast(pa.string()),
                ],
                ["row", "id", "start", "end", "anchor", "alone", "body"],
            )
        release()

    found = chosen.select("row", "id", "text", "anchors", "crowds").mapInArrow(
        run, "row long, id long, start long, end long, anchor long, alone boolean, body string"
    )
    # A window of its own is compared with equal ones only: any block will do.
    block = F.when(F.col("alone"), F.xxhash64("body")).otherwise(F.col("anchor"))
    return found.withColumn("anchor", block).drop("alone")


class Reference:
    """Segments met so far, indexed by window; ids must not decrease."""

    def __init__(self, window: int) -> None:
        self.window = window
        self._texts: list[bytes] = []
        self._index: dict[bytes, tuple[int, int, int]] = {}

    def parse(self, text: bytes, id_: int) -> list[tuple[int, int]]:
        """Spans of words that stand in a smaller document; then index ``text``."""
        words, size = text.split(b" "), self.window
        windows = [b" ".join(words[p : p + size]) for p in range(len(words) - size + 1)]
        spans: list[tuple[int, int]] = []
        p = 0
        while p < len(windows):
            met = self._index.get(windows[p])
            if met is None or met[0] >= id_:
                p += 1
                continue
            source = self._texts[met[1]].split(b" ")[met[2] :]
            end = p + size
            while end < len(words) and end - p < len(source) and words[end] == source[end - p]:
                end += 1
            if spans and spans[-1][1] >= p:
                spans[-1] = (spans[-1][0], end)
            else:
                spans.append((p, end))
            p = end - size + 1
        for p, key in enumerate(windows):
            self._index.setdefault(key, (id_, len(self._texts), p))
        self._texts.append(text)
        return spans


def _parsed(blocks: DataFrame, window: int) -> DataFrame:
    """Parse each block's segments in the order of their ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reference = Reference(window)
        for batch in batches:
            bodies = batch.column("body").cast(pa.binary()).to_pylist()
            spans = [
                [{"start": a, "end": b} for a, b in reference.parse(body, first)]
                for body, first in zip(bodies, batch.column("first").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("segment", "first", "n")), pa.array(spans, RANGES)],
                ["segment", "first", "n", "spans"],
            )
        del reference
        release()

    return blocks.mapInArrow(run, f"segment binary, first long, n long, spans {_RANGES}")


def _digest(text: str):
    return F.unhex(F.md5(F.col(text).cast("binary")))


def repeated_spans(
    documents: DataFrame,
    *,
    window: int = WINDOW,
    anchor: int = ANCHOR,
    crowd: int = CROWD,
    block_segments: int = BLOCK_SEGMENTS,
) -> DataFrame:
    """Of each different text its digest, leading id, and repeated spans of words.

    Texts that lead no other row and repeat nothing are left out. Spans are in no
    order and may overlap.
    """
    if not 1 <= anchor <= window:
        raise ValueError("An anchor has from one word to all of a window.")
    leaders = written(
        documents.filter("text is not null")
        .select(
            F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"),
            F.col("text").cast("string").alias("text"),
        )
        .withColumn("digest", _digest("text"))
        .groupBy("digest")
        .agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("text").alias("text"))
        .withColumn("row", F.monotonically_increasing_id()),
        "passages-leaders",
    )
    anchors = written(_anchors(leaders, window, anchor), "passages-anchors")
    shared = written(
        anchors.groupBy("anchor")
        .agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n"))
        .filter("low < high")
        .select("anchor", (F.col("n") > crowd).alias("crowded")),
        "passages-shared",
    )
    wanted = written(
        anchors.join(shared, "anchor")
        .groupBy("row")
        .agg(
            F.collect_set("anchor").alias("anchors"),
            F.collect_set(F.when(F.col("crowded"), F.col("anchor"))).alias("crowds"),
        ),
        "passages-wanted",
    )
    dropped(anchors, shared)
    segments = written(
        _segments(leaders.join(wanted, "row"), window, anchor).withColumn(
            "segment", _digest("body")
        ),
        "passages-segments",
    )
    dropped(wanted)
    blocks = max(1, -(-segments.count() // block_segments))
    firsts = (
        segments.groupBy("segment", "anchor", "body")
        .agg(F.min("id").alias("first"), F.count("*").alias("n"))
        .repartition(blocks, "anchor")
        .sortWithinPartitions("first")
    )
    verdicts = written(
        _parsed(firsts, window).filter((F.col("n") > 1) | (F.size("spans") > 0)),
        "passages-verdicts",
    )
    whole = F.array(F.struct("start", "end"))
    own = F.transform(
        "spans",
        lambda s: F.struct(
            (s["start"] + F.col("start")).alias("start"), (s["end"] + F.col("start")).alias("end")
        ),
    )
    spans = written(
        segments.select("segment", "row", "id", "start", "end")
        .join(verdicts.select("segment", "first", "spans"), "segment")
        .select("row", F.when(F.col("id") > F.col("first"), whole).otherwise(own).alias("spans"))
        .filter(F.size("spans") > 0)
        .groupBy("row")
        .agg(F.flatten(F.collect_list("spans")).alias("spans")),
        "passages-spans",
    )
    dropped(segments, verdicts)
    found = written(
        leaders.select("row", "digest", "id", "n")
        .join(spans, "row", "left")
        .filter((F.col("n") > 1) | F.col("spans").isNotNull())
        .select("digest", F.col("id").alias("leader"), "spans"),
        "passages-found",
    )
    dropped(leaders, spans)
    return found


def without_repeats(documents: DataFrame, *, window: int = WINDOW, **settings) -> DataFrame:
    """doc_id, n_words, the removed spans of words, and the text that is left.

    Spans are ordered, apart from each other and count words from 0; the words
    left are joined by one space. One row per row of ``documents``.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = Words.of(part.column("text"))
            repeats = part.column("repeats").to_pylist()
            texts, removed = [], []
            for k, (whole, found) in enumerate(zip(repeats, part.column("spans"))):
                n = int(words.counts[k])
                if whole:
                    ranges = [(0, n)] if n >= window else []
                else:
                    ranges = merged(found)
                keep = np.ones(n, bool)
                for a, b in ranges:
                    keep[a:b] = False
                removed.append([{"start": a, "end": b} for a, b in ranges])
                texts.append(words.joined(np.flatnonzero(keep) + words.bounds[k]))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(words.counts, pa.int64()),
                    pa.array(removed, RANGES),
                    pa.array(texts, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n_words", "spans", "text"],
            )
        release()

    found = repeated_spans(documents, window=window, **settings)
    doc_id = F.col("doc_id").cast("long")
    return (
        documents.select(
            doc_id.alias("doc_id"),
            F.col("text").cast("string").alias("text"),
            F.coalesce(doc_id, F.lit(_LAST)).alias("id"),
        )
        .withColumn("digest", _digest("text"))
        .join(found, "digest", "left")
        .select(
            "doc_id",
            "text",
            (F.col("id") > F.col("leader")).alias("repeats"),
            "spans",
        )
        .mapInArrow(run, f"doc_id long, n_words long, spans {_RANGES}, text string")
    )


def merged(found: pa.ListScalar) -> list[tuple[int, int]]:
    """The spans in order, those that touch or overlap made one."""
    if found.values is None:
        return []
    out: list[tuple[int, int]] = []
    starts, ends = (found.values.field(k).to_pylist() for k in (0, 1))
    for a, b in sorted(zip(starts, ends)):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
