"""Near-duplicates by circulant MinHash, banding and exact verification.

A document is its set of word shingles. Two permutations make all signature
coordinates: the shingle hash places a shingle in a circle of cells (the first
permutation), and coordinate ``k`` is the least value of one random permutation
table read ``k`` cells further on. Neighbouring coordinates therefore read
neighbouring cells. Bands of coordinates give bucket keys; at 80 % similarity
40 bands of 5 miss a pair with a chance of about 1e-7.

1. Documents with equal sets are one class; only classes go on.
2. In each bucket, every class is compared with the bucket's smallest class.
   That joins a group of near copies, however large, by one link a member.
3. Where a bucket still holds several components, its classes outside the
   smallest class's component are compared with all others of the bucket, in
   blocks of bounded size. An exact upper bound on the intersection, from
   counts of shingles in as many cells as a set has members, drops most pairs.
   Of a class's pairs with one component, the likeliest is tried first: if it
   holds, the others cannot change anything. A second turn tries all pairs that
   are then still between components.
4. Pairs are verified on the full sets of both texts.

Within a component, further links cannot change it, so they are not sought.

Edge cases: a null, empty or blank text has no shingles and links with nothing;
a text shorter than a shingle is one shingle; rows with one doc_id are joined
only by their texts, and a null doc_id never is a component's smallest unless
all ids are null; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.components import connected_components, joined_components
from waymark.llm.storage import dropped, written
from waymark.llm.words import Words, mix, release, slices

BANDS, BAND_ROWS = 40, 5
CIRCLE = 1 << 22
#: Cells of the counts, as powers of two; a long text's cells hold more each.
LEAST_CELLS, MOST_CELLS = 6, 16
#: Most classes on the two sides of a block that one task compares at once.
BLOCK_LEFT, BLOCK_RIGHT = 256, 2048
_STEP = np.uint64(0x9FB21C651E98DF25)
_WINDOW_ROWS = 4096


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes."""
    words = Words.of(column, lower=True)
    hashes, bounds = words.hashes, words.bounds
    n = len(hashes)
    values = np.zeros(max(n - size + 1, 0), np.uint64)
    for k in range(size):
        values = values * _STEP + hashes[k : n - size + 1 + k]
    values = mix(values)
    out = []
    for begin, end in zip(bounds[:-1], bounds[1:]):
        if end - begin >= size:
            out.append(np.unique(values[begin : end - size + 1]))
        elif end > begin:
            whole = np.zeros(1, np.uint64)
            for h in hashes[begin:end]:
                whole = whole * _STEP + h
            out.append(mix(whole))
        else:
            out.append(values[:0])
    return out


@lru_cache(maxsize=1)
def _circle(coordinates: int, seed: int) -> np.ndarray:
    """All windows of the permutation table, one for each starting cell."""
    table = np.random.default_rng(seed).permutation(CIRCLE).astype(np.uint32)
    ring = np.concatenate([table, table[: coordinates - 1]])
    return np.lib.stride_tricks.sliding_window_view(ring, coordinates)


def signature(shingles: np.ndarray, coordinates: int, seed: int) -> np.ndarray:
    windows = _circle(coordinates, seed)
    cells = (shingles % np.uint64(CIRCLE)).astype(np.int64)
    least = windows[cells[0]].copy()
    for at in range(0, len(cells), _WINDOW_ROWS):
        np.minimum(least, windows[cells[at : at + _WINDOW_ROWS]].min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.arange(bands, dtype=np.uint64) + np.uint64(1)
    for column in least.reshape(bands, rows).T:
        keys = mix(keys * _STEP + column)
    return keys.view(np.int64)


def cell_counts(shingles: np.ndarray) -> bytes:
    """Shingles per cell as bytes; empty where a count is too large."""
    power = min(max((len(shingles) - 1).bit_length(), LEAST_CELLS), MOST_CELLS)
    cells = (shingles >> np.uint64(64 - power)).astype(np.int64)
    counts = np.bincount(cells, minlength=1 << power)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def folded(counts: np.ndarray, cells: int) -> np.ndarray:
    """Counts over fewer cells; neighbouring cells fall together."""
    if counts.shape[-1] == cells:
        return counts
    *rows, size = counts.shape
    parts = counts.reshape(*rows, cells, size // cells)
    return parts.sum(axis=-1, dtype=np.uint16)


def shingled(
    documents: DataFrame, size: int, bands: int, rows: int, seed: int
) -> DataFrame:
    """doc_id, text hash, n_shingles, class key ``node``, band keys, cell counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            nodes, keys, cells, counts = [], [], [], []
            for found in shingle_sets(part.column("text"), size):
                counts.append(len(found))
                if len(found) == 0:
                    nodes.append(None)
                    keys.append([])
                    cells.append(b"")
                    continue
                digest = blake2b(found.tobytes(), digest_size=8).digest()
                nodes.append(int.from_bytes(digest, "big", signed=True))
                keys.append(band_keys(signature(found, bands * rows, seed), bands, rows))
                cells.append(cell_counts(found))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("text_hash"),
                    pa.array(counts, pa.int64()),
                    pa.array(nodes, pa.int64()),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array(cells, pa.binary()),
                ],
                ["doc_id", "text_hash", "n_shingles", "node", "keys", "cells"],
            )
        release(_circle)

    return _hashed(documents).mapInArrow(
        run,
        "doc_id long, text_hash long, n_shingles long, node long, keys array<long>, cells binary",
    )


def _hashed(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_hash"),
        "text",
    )


def _similar_sizes(a, b, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _most_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An upper bound on the shared shingles, from counts per cell."""
    cells = min(a.shape[-1], b.shape[-1])
    return np.minimum(folded(a, cells), folded(b, cells)).sum(axis=-1, dtype=np.int64)


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs ``a``, ``b`` whose full shingle sets are similar enough."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text_b"):
            # A class met again, as the centre of its group, is cut up once.
            of: dict[int, np.ndarray] = {}
            for node, text in (("a", "text_a"), ("b", "text_b")):
                ids = part.column(node).to_numpy()
                new, at = np.unique(ids, return_index=True)
                fresh = [(i, p) for i, p in zip(new, at) if i not in of]
                rows = pa.array([p for _, p in fresh], pa.int64())
                sets = shingle_sets(part.column(text).take(rows), size)
                of.update((i, s) for (i, _), s in zip(fresh, sets))
            a, b = part.column("a").to_numpy(), part.column("b").to_numpy()
            keep = []
            for x, y in zip(a, b):
                s, t = of[x], of[y]
                shared = len(np.intersect1d(s, t, assume_unique=True))
                keep.append((100 + percent) * shared >= percent * (len(s) + len(t)))
            keep = np.array(keep, bool)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    texts_a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    texts_b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(texts_a, "a").join(texts_b, "b").mapInArrow(run, "a long, b long")


def _bounded(pairs: DataFrame, cells: DataFrame, percent: int) -> DataFrame:
    """Drop pairs that the counts per cell rule out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            columns = [batch.column(c).to_pylist() for c in ("cells_a", "cells_b", "sizes")]
            for x, y, sizes in zip(*columns):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                known = len(x) and len(y)
                keep.append(not known or (100 + percent) * _most_shared(x, y) >= percent * sizes)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    cells_a = cells.select(F.col("node").alias("a"), F.col("cells").alias("cells_a"))
    cells_b = cells.select(F.col("node").alias("b"), F.col("cells").alias("cells_b"))
    return pairs.join(cells_a, "a").join(cells_b, "b").mapInArrow(run, "a long, b long")


def _between_components(
    shared: DataFrame, labels: DataFrame, cells: DataFrame, percent: int, *, likeliest: bool
) -> DataFrame:
    """Pairs of one bucket that lie in different components, within the bound.

    ``likeliest`` keeps, of a class's pairs with one component that a task
    compares, the one with the highest bound.
    """
    labels = labels.withColumnRenamed("component", "found")
    placed = shared.join(labels, "node", "left").withColumn(
        "component", F.coalesce("found", "node")
    )
    center = F.max(F.when(F.col("node") == F.col("center"), F.col("component")))
    mixed = (
        placed.groupBy("key")
        .agg(
            center.alias("main"),
            F.count("*").alias("members"),
            F.min("component").alias("low"),
            F.max("component").alias("high"),
        )
        .filter("low != high")
        .drop("low", "high")
    )
    aside = placed.join(mixed, "key").withColumn(
        "aside", F.col("component") != F.col("main")
    )
    many = aside.groupBy("key").agg(F.count_if("aside").alias("strays"))
    wide = (
        aside.join(many, "key")
        .join(cells.select("node", "cells"), "node")
        .withColumn("lefts", F.ceil(F.col("strays") / BLOCK_LEFT).cast("int"))
        .withColumn("rights", F.ceil(F.col("members") / BLOCK_RIGHT).cast("int"))
        .withColumn("place", F.xxhash64("node"))
    )
    each = ["key", "node", "n", "component", "aside", "cells"]
    left = wide.filter("aside").select(
        *each,
        F.pmod("place", F.col("lefts")).cast("int").alias("l"),
        F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("r"),
        F.lit(True).alias("on_left"),
    )
    right = wide.select(
        *each,
        F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("l"),
        F.pmod("place", F.col("rights")).cast("int").alias("r"),
        F.lit(False).alias("on_left"),
    )
    blocks = (
        left.union(right)
        .groupBy("key", "l", "r")
        .agg(F.collect_list(F.struct("on_left", "node", "n", "component", "aside", "cells")).alias("rows"))
        .select("rows")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("rows")
            offsets, flat = column.offsets.to_numpy(), column.values
            on_left = flat.field("on_left").to_numpy(zero_copy_only=False)
            node, n = flat.field("node").to_numpy(), flat.field("n").to_numpy()
            component = flat.field("component").to_numpy()
            apart = flat.field("aside").to_numpy(zero_copy_only=False)
            packed = [np.frombuffer(c, np.uint8) for c in flat.field("cells").to_pylist()]
            width = np.array([len(c) for c in packed])
            firsts, seconds = [], []
            for begin, end in zip(offsets[:-1], offsets[1:]):
                at = np.arange(begin, end)
                rights = at[~on_left[at]]
                stacks = {
                    w: np.stack([packed[j] for j in rights[width[rights] == w]])
                    for w in np.unique(width[rights]).tolist()
                }
                for i in at[on_left[at]]:
                    ok = (component[rights] != component[i]) & (
                        ~apart[rights] | (node[rights] > node[i])
                    )
                    small, large = np.minimum(n[rights], n[i]), np.maximum(n[rights], n[i])
                    ok &= 100 * small >= percent * large
                    bound = np.ones(len(rights))
                    for w, stack in stacks.items():
                        if w and width[i]:
                            own = width[rights] == w
                            of = np.flatnonzero(ok & own)
                            shared = _most_shared(stack[ok[own]], packed[i])
                            both = n[rights[of]] + n[i]
                            ok[of] = (100 + percent) * shared >= percent * both
                            bound[of] = shared / both
                    j = rights[ok]
                    if likeliest:
                        j = j[np.lexsort((node[j], -bound[ok], component[j]))]
                        j = j[np.unique(component[j], return_index=True)[1]]
                    firsts.append(np.full(len(j), node[i]))
                    seconds.append(node[j])
            if firsts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(firsts)), pa.array(np.concatenate(seconds))], ["a", "b"]
                )

    return blocks.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(
    documents: DataFrame,
    *,
    shingle: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    band_rows: int = BAND_ROWS,
    seed: int = 7,
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row per document row.

    Documents are linked if the Jaccard similarity of their shingle sets is
    ``percent`` or more; ``component_id`` is the smallest doc_id reachable.
    """
    return _decided(documents, shingle, percent, bands, band_rows, seed).select(
        "doc_id", "n_shingles", "component_id", "kept"
    )


def _decided(
    documents: DataFrame,
    shingle: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    band_rows: int = BAND_ROWS,
    seed: int = 7,
) -> DataFrame:
    """The rows of ``near_duplicates`` with ``text_hash`` and ``stays``.

    Of a component only the row least by id and text stays, rows equal to it too.
    """
    nodes = written(shingled(documents, shingle, bands, band_rows, seed), "minhash-nodes")
    held = nodes.filter(F.col("node").isNotNull())
    classes = held.groupBy("node").agg(
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))).alias("first"),
    )
    # Any row of a class stands for it: their keys and cells are equal.
    one = written(
        held.select("node", F.col("n_shingles").alias("n"), "keys", "cells").dropDuplicates(["node"]),
        "minhash-classes",
    )
    banded = one.select("node", "n", F.explode("keys").alias("key"))
    buckets = (
        banded.groupBy("key")
        .agg(F.min(F.struct("node", "n")).alias("least"), F.count("*").alias("members"))
        .filter("members > 1")
        .select("key", F.col("least.node").alias("center"), F.col("least.n").alias("center_n"))
    )
    shared = written(banded.join(buckets, "key"), "minhash-buckets")
    stars = (
        shared.filter(F.col("node") != F.col("center"))
        .filter(_similar_sizes(F.col("n"), F.col("center_n"), percent))
        .select(
            F.col("node").alias("a"),
            F.col("center").alias("b"),
            (F.col("n") + F.col("center_n")).alias("sizes"),
        )
        .distinct()
    )
    texts = _texts_of(documents, held.join(shared.select("node").distinct(), "node", "left_semi"))
    cells = one.select("node", "cells")
    links = written(
        verified(_bounded(stars, cells, percent), texts, shingle, percent), "minhash-links"
    )
    labels = connected_components(links)
    dropped(links)
    for likeliest in (True, False):
        pairs = _between_components(shared, labels, cells, percent, likeliest=likeliest)
        links = written(verified(pairs, texts, shingle, percent), "minhash-links")
        labels = joined_components(labels, links)
        dropped(links)
    dropped(one, shared, texts)
    return _with_components(nodes, classes, labels)


def one_of_each(documents: DataFrame, **settings) -> DataFrame:
    """One document of each component, with all its columns.

    Each row follows its own decision, also where an id has several texts. Rows
    equal in id and text become one; rows without an id stay.
    """
    decided = written(
        _decided(documents, **settings)
        .filter(F.col("doc_id").isNotNull())
        .groupBy("doc_id", "text_hash")
        .agg(F.min("stays").alias("stays"), F.count("*").alias("copies")),
        "minhash-decisions",
    ).withColumnsRenamed({"doc_id": "of_id", "text_hash": "of_hash"})
    leaving = decided.filter(~F.col("stays"))
    repeated = decided.filter("stays AND copies > 1")
    same = (F.col("doc_id") == F.col("of_id")) & (F.xxhash64("text") == F.col("of_hash"))
    kept = documents.join(leaving, same, "left_anti")
    single = kept.join(repeated, same, "left_anti")
    several = kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return single.union(several).select(*documents.columns)


def _texts_of(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """``node`` and the text of one of its documents."""
    chosen = (
        rows.groupBy("node")
        .agg(F.min(F.struct("doc_id", "text_hash")).alias("row"))
        .select(
            "node",
            F.col("row.doc_id").alias("row_id"),
            F.col("row.text_hash").alias("row_hash"),
        )
    )
    found = _hashed(documents).join(
        chosen,
        F.col("doc_id").eqNullSafe(F.col("row_id")) & (F.col("text_hash") == F.col("row_hash")),
    )
    return written(found.select("node", "text").dropDuplicates(["node"]), "minhash-texts")


def _with_components(nodes: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    rooted = classes.join(labels, "node", "left").select(
        "node", "first", F.coalesce("component", "node").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    found = rooted.join(least, "root").select(F.col("node").alias("of_node"), "least")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id"))
    own = F.struct("doc_id", "text_hash")
    return (
        nodes.select("doc_id", "text_hash", "n_shingles", "node")
        .join(found, F.col("node") == F.col("of_node"), "left")
        .select(
            "doc_id",
            "text_hash",
            "n_shingles",
            component.alias("component_id"),
            (F.col("node").isNull() | own.eqNullSafe(F.col("least"))).alias("stays"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
