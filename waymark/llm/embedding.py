"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine ``t`` or more are at most ``2 - 2t`` apart in squared
distance. After a random rotation the coordinates are cut into blocks, each
with a budget in proportion to its width: a close pair must keep within the
budget in at least one block. Each block is joined by range: vectors go to
cells of its first coordinate, as wide as the block's radius, and a cell meets
itself and the next one. Cells are split into parts of bounded size, so a hot
cell becomes many tasks. Within a task, sorted tiles skip what is out of range,
block distances pick candidates, and the cosine in double precision decides. A
pair counts in the first block whose budget it keeps, so it counts once.

A task hands on counts of links and a spanning forest of what it found, never
the pairs: a group of copies costs rows in proportion to its size.

Edge cases: a vector that is null, empty, zero or holds null or non-finite
components links with nothing, nor does one with a null vec_id; vectors of
different length never link; equal rows are one vector, as are further vectors
of one vec_id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.components import connected_components
from waymark.llm.storage import written

BLOCKS = 4
#: Vectors on each side of a task's comparison.
PART_ROWS = 8192
_TILE, _STRIP = 512, 2048
_CHUNK = 1 << 15
_SLACK = 1e-6


def rotation(size: int, seed: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))[0]


def block_ranges(size: int, blocks: int) -> list[tuple[int, int]]:
    cuts = np.linspace(0, size, min(blocks, size) + 1).round().astype(int)
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)


def _unit(rows: np.ndarray) -> np.ndarray:
    # Scaling by the largest part first keeps the length from overflowing.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest position that each of ``n`` nodes reaches over links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _in_cells(classes: DataFrame, threshold: float, blocks: int, seed: int) -> DataFrame:
    """A row for each class and block: its cell of the first coordinate."""

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                turned = _unit(_matrix(part.column("embedding"), size)) @ rotation(size, seed)
                for block, (low, high) in enumerate(block_ranges(size, blocks)):
                    width = np.sqrt((2 - 2 * threshold) * (high - low) / size) * 1.001
                    cell = np.floor(turned[:, low] / max(width, 1e-3)).astype(np.int32)
                    n = part.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [
                            *[part.column(c) for c in ("node", "many", "size", "embedding")],
                            pa.array(np.full(n, block, np.int32)),
                            pa.array(cell),
                        ],
                        ["node", "many", "size", "embedding", "block", "cell"],
                    )

    kind = classes.schema["embedding"].dataType.simpleString()
    return classes.mapInArrow(
        place, f"node long, many long, size int, embedding {kind}, block int, cell int"
    )


def _comparisons(cells: DataFrame, part_rows: int) -> DataFrame:
    """Rows by comparison: cell, with the next one or itself, and two parts."""
    # At most blocks x (2 / width + 2) rows for each length of vector.
    parts = cells.groupBy("size", "block", "cell").agg(
        F.ceil(F.count("*") / part_rows).cast("int").alias("parts")
    )
    key = ["size", "block", "cell"]
    own = cells.join(F.broadcast(parts), key).withColumn(
        "part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    )

    def near(step: int, name: str) -> DataFrame:
        moved = parts.select("size", "block", (F.col("cell") - step).alias("cell"), F.col("parts").alias(name))
        return F.broadcast(moved)

    row = ["node", "many", "embedding", "size", "block"]
    others = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    inside = own.withColumn("other", others).select(
        *row,
        "cell",
        F.lit(False).alias("next"),
        F.least("part", "other").alias("i"),
        F.greatest("part", "other").alias("j"),
        (F.col("part") <= F.col("other")).alias("left"),
    )
    lower = (
        own.join(near(1, "beyond"), key)
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("beyond") - 1)))
        .select(*row, "cell", F.lit(True).alias("next"), F.col("part").alias("i"), "j", F.lit(True).alias("left"))
    )
    upper = (
        own.join(near(-1, "before"), key)
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("before") - 1)))
        .select(*row, (F.col("cell") - 1).alias("cell"), F.lit(True).alias("next"), "i", F.col("part").alias("j"), F.lit(False).alias("left"))
    )
    return inside.union(lower).union(upper)


def _spread(turned: np.ndarray, left: bool) -> np.ndarray:
    """Rows whose products, left with right, are squared distances."""
    size = (turned * turned).sum(axis=1)
    one = np.ones(len(turned))
    parts = (turned, size, one) if left else (-2 * turned, one, size)
    return np.column_stack(parts).astype(np.float32)


def _close_pairs(u, v, near, low, high, budget, threshold, ranges, block, same):
    """Positions in ``u`` and ``v`` of the tile's pairs that count here.

    ``near`` marks the pairs whose block distance, in single precision and with
    room for its rounding, keeps the budget; all else is in double precision.
    """
    (unit_u, turn_u), (unit_v, turn_v) = u, v
    i, j = np.divmod(np.flatnonzero(near), near.shape[1])
    if len(i) == 0:
        return i, j
    if len(i) * 8 > near.size:
        ok = (unit_u @ unit_v.T)[i, j] >= threshold
        i, j = i[ok], j[ok]
    else:
        ok = [
            (unit_u[i[k : k + _CHUNK]] * unit_v[j[k : k + _CHUNK]]).sum(1) >= threshold
            for k in range(0, len(i), _CHUNK)
        ]
        i, j = i[np.concatenate(ok)], j[np.concatenate(ok)]
    if same is not None and len(i):
        ok = same(i, j)
        i, j = i[ok], j[ok]
    keep = np.ones(len(i), bool)
    total = ranges[-1][1]
    for k in range(0, len(i), _CHUNK):
        gap = turn_u[i[k : k + _CHUNK]] - turn_v[j[k : k + _CHUNK]]
        gap *= gap
        for a, b in ranges[:block]:
            share = budget * (b - a) / (high - low)
            keep[k : k + _CHUNK] &= gap[:, a:b].sum(1) > share * (1 + _SLACK)
        own = gap[:, low:high].sum(1) <= budget * (1 + _SLACK)
        keep[k : k + _CHUNK] &= own
    assert total == unit_u.shape[1]
    return i[keep], j[keep]


def compare_parts(rows: pa.Table, threshold: float, blocks: int, seed: int) -> pa.Table:
    """Links of one comparison: counts per node and a spanning forest."""
    size, block = rows["size"][0].as_py(), rows["block"][0].as_py()
    across = rows["next"][0].as_py() or rows["i"][0].as_py() != rows["j"][0].as_py()
    ranges = block_ranges(size, blocks)
    low, high = ranges[block]
    budget = (2 - 2 * threshold) * (high - low) / size
    node, many = rows["node"].to_numpy(), rows["many"].to_numpy()
    unit = _unit(_matrix(rows["embedding"].combine_chunks(), size))
    turned = unit @ rotation(size, seed)
    first = turned[:, low]
    on_left = rows["left"].to_numpy()
    left = np.flatnonzero(on_left)
    right = np.flatnonzero(~on_left) if across else left
    left = left[np.argsort(first[left], kind="stable")]
    right = right[np.argsort(first[right], kind="stable")]
    radius = np.sqrt(budget) * 1.001
    limit = np.float32(budget * (1 + 1e-3) + 1e-5)
    of_left = _spread(turned[left, low:high], True)
    of_right = _spread(turned[right, low:high], False).T
    links = np.zeros(len(node), np.int64)
    ends: list[np.ndarray] = []
    for at in range(0, len(left), _TILE):
        tile = left[at : at + _TILE]
        begin = np.searchsorted(first[right], first[tile[0]] - radius)
        end = np.searchsorted(first[right], first[tile[-1]] + radius, "right")
        for strip in range(begin, end, _STRIP):
            until = min(strip + _STRIP, end)
            other = right[strip:until]
            near = of_left[at : at + _TILE] @ of_right[:, strip:until] <= limit
            if not near.any():
                continue
            # Within one part each pair is met from its smaller position.
            same = None if across else (lambda i, j, t=tile, o=other: t[i] < o[j])
            i, j = _close_pairs(
                (unit[tile], turned[tile]), (unit[other], turned[other]), near,
                low, high, budget, threshold, ranges, block, same,
            )
            a, b = tile[i], other[j]
            ok = node[a] != node[b]
            a, b = a[ok], b[ok]
            if len(a):
                links += np.bincount(a, many[b], len(node)).astype(np.int64)
                links += np.bincount(b, many[a], len(node)).astype(np.int64)
                met, place = np.unique(np.concatenate([a, b]), return_inverse=True)
                root = met[forest(place[: len(a)], place[len(a) :], len(met))]
                ends.append(np.stack([met, root])[:, met != root])
    if ends:
        a, b = np.concatenate(ends, axis=1)
        root = forest(a, b, len(node))
    else:
        root = np.arange(len(node))
    held = np.flatnonzero((links > 0) | (root != np.arange(len(node))))
    return pa.table({"node": node[held], "links": links[held], "root": node[root[held]]})


def near_vectors(
    vectors: DataFrame,
    *,
    threshold: float = 0.9,
    blocks: int = BLOCKS,
    part_rows: int = PART_ROWS,
    seed: int = 5,
) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row per row of ``vectors``.

    Two vectors are linked if their cosine is ``threshold`` or more;
    ``component_id`` is the smallest vec_id reachable.
    """
    numbers = F.col("embedding")
    usable = (
        F.col("vec_id").isNotNull()
        & (F.size(numbers) > 0)
        & F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(numbers, lambda x: x != 0)
    )
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    classes = written(
        rows.filter(usable)
        .groupBy("embedding")
        .agg(F.min("vec_id").alias("node"), F.count_distinct("vec_id").alias("many"))
        .select("node", "many", F.size("embedding").alias("size"), "embedding"),
        "vector-classes",
    )
    cells = written(_in_cells(classes, threshold, blocks, seed), "vector-cells")

    def compare(table: pa.Table) -> pa.Table:
        return compare_parts(table, threshold, blocks, seed)

    found = written(
        _comparisons(cells, part_rows)
        .groupBy("size", "block", "cell", "next", "i", "j")
        .applyInArrow(compare, "node long, links long, root long"),
        "vector-links",
    )
    counts = found.groupBy(F.col("node").alias("counted")).agg(F.sum("links").alias("links"))
    labels = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = (
        classes.join(counts, F.col("node") == F.col("counted"), "left")
        .join(labels, "node", "left")
        .select(
            F.col("embedding").alias("of_embedding"),
            (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"),
            F.coalesce("component", "node").alias("component_id"),
        )
    )
    return (
        rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
        .join(known, F.col("usable") & (F.col("embedding") == F.col("of_embedding")), "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
