"""Periodic runs of words, found by block convolution at dyadic scales.

A run is a longest stretch of words with least period q that is at least
``max(least, repeats * q)`` words long. At scale b = 1, 2, 4, ... the words are
cut into aligned blocks of b; an exact transform tells at which distances from b
to 2b - 1 each block occurs again (see ``convolution``). A run of period q has,
at the scale with b <= q < 2b, several blocks in a row that recur at distance q,
so chains of such blocks are the seeds. A seed is extended word by word in both
directions; of stretches with the same ends the one of least period is the run.

Before that, words that occur fewer than ``repeats`` times in a text part it into
pieces, again and again within each piece: every word of a run occurs at least
that often in it, so no run crosses such a word.

Words are compared by a keyed 64-bit hash of their bytes. Edge cases: a null,
empty or blank text has no words and no runs; a null id is never altered by the
query's rewriting; repeated rows are judged one by one; an empty table gives an
empty result; further columns are ignored. Texts of any length are read whole; a
piece of more than 2**25 words would exceed the transforms and is refused.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.convolution import recurrences
from waymark.llm.words import Words, release, slices

RUN_TYPE = pa.list_(
    pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
)
#: Of the words' hashes and the document's id, which word to read at each place.
Rewrite = Callable[[int, int | None], "np.ndarray | None"]


def dense_pieces(values: np.ndarray, repeats: int, least: int) -> list[tuple[int, np.ndarray]]:
    """Pieces, with their starts, whose words all occur often enough in them.

    Their words are numbered from 1.
    """
    found, open_ = [], [(0, values)]
    while open_:
        start, piece = open_.pop()
        if len(piece) < least:
            continue
        _, numbers, counts = np.unique(piece, return_inverse=True, return_counts=True)
        rare = counts[numbers] < repeats
        if not rare.any():
            found.append((start, numbers + 1))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[True], rare, [True]])))
        for begin, end in zip(edge[::2], edge[1::2]):
            open_.append((start + begin, piece[begin:end]))
    return found


def _agreement(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading values agree."""
    done, step = 0, 64
    while done < len(a):
        differ = np.flatnonzero(a[done : done + step] != b[done : done + step])
        if len(differ):
            return done + int(differ[0])
        done += step
        step *= 2
    return len(a)


def piece_runs(values: np.ndarray, repeats: int, least: int) -> dict[tuple[int, int], int]:
    """Start and end of each run, with its period."""
    n = len(values)
    runs: dict[tuple[int, int], int] = {}
    b = 1
    while repeats * b <= n:
        starts, distances = recurrences(values, b)
        order = np.lexsort((starts, distances))
        starts, distances = starts[order], distances[order]
        joined = (np.diff(starts) == b) & (np.diff(distances) == 0)
        first = np.flatnonzero(np.concatenate([[True], ~joined])) if len(starts) else starts
        blocks = np.diff(np.concatenate([first, [len(starts)]]))
        # Of the places that equal the word q later, a run has (repeats - 1) q.
        needed = ((repeats - 1) * distances[first] - b + 1) // b
        for k, count in zip(first[blocks >= needed], blocks[blocks >= needed]):
            x, q = int(starts[k]), int(distances[k])
            y = x + int(count) * b
            begin = x - _agreement(values[:x][::-1], values[q : x + q][::-1])
            end = y + q + _agreement(values[y : n - q], values[y + q :])
            if end - begin >= max(least, repeats * q):
                runs[begin, end] = min(q, runs.get((begin, end), q))
        b *= 2
    return runs


def runs_of(values: np.ndarray, repeats: int = 4, least: int = 6) -> np.ndarray:
    """Rows of start, length and period, ordered by start, then period."""
    found = [
        (start + begin, end - begin, period)
        for start, piece in dense_pieces(values, repeats, least)
        for (begin, end), period in piece_runs(piece, repeats, least).items()
    ]
    found.sort(key=lambda run: (run[0], run[2]))
    return np.array(found, np.int64).reshape(-1, 3)


def collapsed(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay when a run keeps its first period only."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(depth)[:n] == 0


def periodic_runs(
    documents: DataFrame,
    *,
    repeats: int = 4,
    least: int = 6,
    rewrite: Rewrite | None = None,
) -> DataFrame:
    """doc_id, n_words, the runs, and the text with each run cut to one period.

    ``rewrite`` may choose, from a text's number of words and its document id,
    which words stand at which place before runs are sought.
    """
    if repeats < 2:
        raise ValueError("A run repeats its period at least twice.")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = Words.of(part.column("text"))
            hashes, bounds = words.hashes, words.bounds
            sizes, runs, texts = [], [], []
            for row, doc_id in enumerate(part.column("doc_id").to_pylist()):
                at = np.arange(bounds[row], bounds[row + 1])
                order = rewrite(len(at), doc_id) if rewrite else None
                if order is not None:
                    at = at[order]
                found = runs_of(hashes[at], repeats, least)
                if len(found):
                    at = at[collapsed(len(at), found)]
                sizes.append(int(bounds[row + 1] - bounds[row]))
                runs.append(found)
                texts.append(words.joined(at))
            ends = np.cumsum([0] + [len(r) for r in runs])
            columns = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(
                        pa.array(ends, pa.int32()),
                        pa.StructArray.from_arrays(
                            [pa.array(c) for c in columns.T], fields=list(RUN_TYPE.value_type)
                        ),
                    ),
                    pa.array(texts, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n_words", "runs", "text"],
            )
        release()

    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).mapInArrow(
        run,
        "doc_id long, n_words long, "
        "runs array<struct<start:long,length:long,period:long>>, text string",
    )


def run_digests(found: DataFrame) -> DataFrame:
    """Per document the number of runs, the longest one, and two digests."""
    longest = F.get(
        F.array_sort(
            "runs",
            lambda a, b: F.when(
                a["length"] != b["length"], F.when(a["length"] > b["length"], -1).otherwise(1)
            )
            .when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1))
            .otherwise(F.signum(a["period"] - b["period"]).cast("int")),
        ),
        F.lit(0),
    )
    line = F.array_join(
        F.transform(
            "runs",
            lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]),
        ),
        "",
    )
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.sha2(line, 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
        longest.alias("longest"),
    ).select(
        "doc_id",
        "n_runs",
        *[F.col(f"longest.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(F.col("longest.length") * 1000 / F.col("longest.period"))
        .cast("long")
        .alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
