"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point, so
letters of all scripts are told apart. A three-letter gram binds the
vectors of its letters, rotated by their place, into one vector by
multiplication; a text bundles its grams by addition, and so does a language
over its training texts. A text gets the language whose bundle is nearest by
cosine.

Counts of grams are summed by Spark; each task bundles the grams that it has
counted, a language's bundles are added up, and only one vector for each language
reaches the driver.

Edge cases: a null text, or one without a letter, is ``und`` with score 0, and
so is every text if no language can be learnt; training skips a null lang or
doc_id; repeated rows count each; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.words import release, slices

GRAM = 3
DIMENSIONS = 2048
UNKNOWN = "und"
#: Bits of a code point in a gram's code.
_BITS = 21
#: Texts bundled at once, and grams whose vectors are held meanwhile.
_TEXTS, _BLOCK = 256, 4096
#: Letters whose vectors a worker keeps; grams that a training task holds.
_LETTERS, _HELD_GRAMS = 16_384, 4_000_000


@lru_cache(maxsize=1)
def _lowered() -> np.ndarray:
    """The lower-case code point of each letter; 0 for all but letters."""
    out = np.zeros(0x110000, np.int64)
    for point in range(0x110000):
        letter = chr(point)
        if letter.isalpha():
            out[point] = ord(letter.lower()[0])
    return out


def text_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams of all texts, each gram's text, and whether each text has a letter.

    A gram is the code of three letters or gaps. A run of other characters is one
    gap; a text begins and ends with a gap.
    """
    # The separator is not a letter, so each text ends with a gap of its own.
    joined = "\0".join(["", *texts, ""])
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    letters = _lowered()[points]
    lengths = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths + 1)
    owner = np.concatenate([[0], owner])[: len(letters)]
    letter = letters > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    letters, owner = letters[keep], owner[keep]
    lettered = np.bincount(owner, weights=letters > 0, minlength=len(texts)) > 0
    if len(letters) < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), lettered
    codes = (letters[:-2] << _BITS | letters[1:-1]) << _BITS | letters[2:]
    # The letter in the middle belongs to the gram's text; a gap there would
    # join two words, or two texts.
    inside = letters[1:-1] > 0
    return codes[inside], owner[1:-1][inside], lettered


@lru_cache(maxsize=_LETTERS)
def letter_vector(point: int, seed: int) -> np.ndarray:
    """The random signs of a code point, of its own whatever else occurs."""
    rng = np.random.default_rng([seed, point])
    return rng.integers(0, 2, DIMENSIONS, np.int8) * 2 - 1


def gram_vectors(codes: np.ndarray, seed: int) -> np.ndarray:
    """Bind the rotated vectors of each gram's letters."""
    parts = np.stack([codes >> 2 * _BITS, codes >> _BITS, codes]) & ((1 << _BITS) - 1)
    points, at = np.unique(parts, return_inverse=True)
    letters = np.array([letter_vector(p, seed) for p in points.tolist()], np.int8)
    first, second, third = at.reshape(3, -1)
    return (
        np.roll(letters, 2, axis=1)[first]
        * np.roll(letters, 1, axis=1)[second]
        * letters[third]
    )


def bundles(texts: list[str], seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bundle of each text, how many grams it has, and whether a letter."""
    codes, owner, lettered = text_grams(texts)
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    met, at = np.unique(codes, return_inverse=True)
    for begin in range(0, len(met), _BLOCK):
        block = met[begin : begin + _BLOCK]
        own = (at >= begin) & (at < begin + len(block))
        cells = owner[own] * len(block) + at[own] - begin
        counts = np.bincount(cells, minlength=len(texts) * len(block))
        counts = counts.reshape(len(texts), len(block)).astype(np.float32)
        out += counts @ gram_vectors(block, seed).astype(np.float32)
    return out, np.bincount(owner, minlength=len(texts)), lettered


def compared(
    column: pa.Array, matrix: np.ndarray, seed: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of some texts at a time: cosines with unit vectors, grams, letters."""
    texts = column.fill_null("").to_pylist()
    for begin in range(0, len(texts), _TEXTS):
        found, grams, lettered = bundles(texts[begin : begin + _TEXTS], seed)
        size = np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)
        yield (found / size) @ matrix, grams, lettered


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training, by the checksum of its id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def learn_profiles(training: DataFrame, seed: int = 11) -> dict[str, np.ndarray]:
    """A unit vector for each ``lang``, from all rows of ``lang`` and ``text``."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                grams, counts = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams)), pa.array(grams), pa.array(counts)],
                    ["lang", "gram", "n"],
                )
            held.clear()

        for part in slices(batches):
            codes, owner, _ = text_grams(part.column("text").fill_null("").to_pylist())
            langs = part.column("lang").to_pylist()
            bounds = np.searchsorted(owner, np.arange(len(langs) + 1))
            for lang, begin, end in zip(langs, bounds[:-1], bounds[1:]):
                held.setdefault(lang, []).append(codes[begin:end])
            size += len(codes)
            if size > _HELD_GRAMS:
                yield from flush()
                size = 0
        yield from flush()

    def bundle(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, rows in batch.groupby("lang"):
                codes, counts = rows["gram"].to_numpy(), rows["n"].to_numpy(float)
                total = sums.setdefault(lang, np.zeros(DIMENSIONS))
                for at in range(0, len(codes), _BLOCK):
                    vectors = gram_vectors(codes[at : at + _BLOCK], seed)
                    total += counts[at : at + _BLOCK] @ vectors.astype(float)
        for lang, total in sums.items():
            yield pd.DataFrame({"lang": [lang], "vector": [total]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.sum(np.stack(rows["vector"].to_list()), axis=0)
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "vector": [total]})

    kind = "lang string, vector array<double>"
    # A task bundles the grams it counts; a language is a row for each of them.
    profiles = (
        training.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
        .select("lang", "text")
        .mapInArrow(count, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .mapInPandas(bundle, kind)
        .groupBy("lang")
        .applyInPandas(add, kind)
        .collect()
    )
    out = {}
    for row in sorted(profiles):
        vector = np.array(row["vector"])
        size = np.linalg.norm(vector)
        if size > 0:
            out[row["lang"]] = vector / size
    return out


def predict_languages(
    documents: DataFrame, profiles: dict[str, np.ndarray], seed: int = 11
) -> DataFrame:
    """doc_id, lang_pred and score (cosine, from 0 to 1) of each whole text."""
    names = [*profiles, UNKNOWN]
    matrix = np.array([*profiles.values(), np.zeros(DIMENSIONS)], np.float32).T

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = list(compared(part.column("text"), matrix, seed))
            cosine = np.concatenate([c for c, _, _ in found])
            lettered = np.concatenate([has for _, _, has in found])
            cosine[:, -1] = 0.0
            if len(profiles):
                best = cosine[:, :-1].argmax(axis=1)
            else:
                best = np.zeros(len(cosine), np.int64)
            best = np.where(lettered, best, len(profiles))
            score = np.clip(cosine[np.arange(len(best)), best], 0.0, 1.0)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([names[b] for b in best], pa.string()),
                    pa.array(score.astype(np.float64)),
                ],
                ["doc_id", "lang_pred", "score"],
            )
        release(letter_vector)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        predict, "doc_id long, lang_pred string, score double"
    )


def in_known_languages(
    documents: DataFrame, *, least_score: float = 0.2, spread: float = 2.0, seed: int = 11
) -> DataFrame:
    """The documents whose text is in one of the languages they are labelled with.

    A text without a letter goes, and so does one that is less like every language
    than ``least_score`` even if its cosine lies ``spread`` standard errors below
    the true one: with n grams the standard error is 1 / sqrt(n). If no language
    can be learnt, only texts without a letter go.
    """
    training = documents.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    profiles = learn_profiles(training, seed)
    matrix = np.array([*profiles.values(), np.zeros(DIMENSIONS)], np.float32).T

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = list(compared(part.column("text"), matrix, seed))
            best = np.concatenate([c.max(axis=1) for c, _, _ in found])
            grams = np.maximum(np.concatenate([n for _, n, _ in found]), 1)
            lettered = np.concatenate([has for _, _, has in found])
            like = (best + spread / np.sqrt(grams) >= least_score) | (not profiles)
            yield part.filter(pa.array(lettered & like))
        release(letter_vector)

    return documents.mapInArrow(keep, documents.schema)


def identify_languages(documents: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, predict all of them."""
    training = documents.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    profiles = learn_profiles(training)
    return predict_languages(documents, profiles).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )
