"""Connected components of a link table by alternating star contractions.

Each round hangs every node's larger neighbours on its smallest neighbour, then
does the same from below. The links end as stars around the smallest node of
each component; a table that already consists of stars is done in one round.
Nothing but a row count and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from waymark.llm.storage import dropped, written


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) from links ``a``, ``b``.

    The smallest node of a component has no row of its own; nor has a node
    without links. Links of a node to itself and repeated links are harmless.
    """
    edges, before = _written_edges(
        links.filter("a != b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    while True:
        stars, after = _written_edges(_small_star(_large_star(edges)))
        dropped(edges)
        edges = stars
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = after


def joined_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The components of ``labels`` once further links join some of them.

    Only whole components are linked anew, so the work follows the new links.
    """
    ends = links
    for end in ("a", "b"):
        known = labels.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
        ends = ends.join(known, end, "left").withColumn(f"of_{end}", F.coalesce(f"of_{end}", end))
    joins = connected_components(ends.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))
    moved = joins.select(F.col("node").alias("component"), F.col("component").alias("into"))
    return written(
        labels.join(moved, "component", "left")
        .select("node", F.coalesce("into", "component").alias("component"))
        .union(joins),
        "labels",
    )


def _written_edges(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The written edges with their number and checksums, from one job."""
    seen = Observation()
    table = written(
        edges.observe(
            seen,
            F.count(F.lit(1)).alias("rows"),
            F.bit_xor(F.xxhash64("u", "v")).alias("mixed"),
            F.sum(F.hash("u", "v").cast("long")).alias("total"),
        ),
        "links",
    )
    return table, tuple(seen.get[name] for name in ("rows", "mixed", "total"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.filter("v > u")
        .join(least, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return (
        edges.join(least, "u")
        .filter("v != m")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(least.select("u", F.col("m").alias("v")))
        .distinct()
    )
