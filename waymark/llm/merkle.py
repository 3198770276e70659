"""A Merkle manifest of a dataset, and proofs by descent from its root.

Every row of a table is a leaf: the SHA-256 of its fields. Within a source the
leaves stand in the order of their ids; sixteen neighbours at a time are hashed
into one node until one is left, the source's subroot. The subroots, in order of
their sources, are hashed together likewise into the root.

A node's place is its path from the root, one hexadecimal digit a level: first
the digits of its source's number, then those of its number in the source. So a
path's prefixes are its ancestors, and one loop from the longest paths up builds
all trees. What is stored is content-addressed: a record has a digest and the
digests of its children.

Requests descend from the root. At each level the digests reached are looked up
in the records, the digit of the rank picks the child, and the children beside
it are collected as one path segment (what is left and what is right of it).
Requests travel together as long as they share a prefix, so a level has at most a
sixteenth of the rows of the next, and no digest is asked for by a crowd. At the
leaves the segments are reversed: they are then the proof from leaf to root.

Ranks come from a sort by key ranges: each row's place in its range, plus the
rows of the ranges before it. Digests, not texts, are shuffled; groups have at
most sixteen rows.

Edge cases: null fields are hashed as ``-``; a null source is a source of its own
and first; null ids come first in a source; rows with the same id are ordered by
leaf, and equal rows are leaves of their own, in any order; a lone leaf is its
source's subroot; an empty table has no root and no proofs; further columns are
neither hashed nor in the way.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.storage import written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 16
_HEX = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 of the fields, each with its length, as lowercase hex."""

    def framed(field: Column) -> Column:
        value = field.cast("string")
        return F.coalesce(
            F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")
        )

    return F.sha2(F.concat(*[framed(f) for f in fields]), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Add ``number``, a row's place in the whole order, counted from 0.

    The rows are sorted in key ranges; a range begins after all rows of the
    ranges before it. Of each range only its count is added up in one place.
    """
    tie = written(df.withColumn("tie", F.monotonically_increasing_id()), f"{name}-keys")
    keys = [*order, "tie"]
    placed = written(
        tie.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .drop("tie")
        .withColumn("at", F.monotonically_increasing_id()),
        f"{name}-ranges",
    )
    # The upper bits of ``at`` are the range, the lower 33 the place in it.
    ranged = placed.withColumn("range", F.shiftright("at", 33)).withColumn(
        "at", F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    )
    counts = ranged.groupBy("range").agg(F.count("*").alias("rows"))
    begins = counts.select(
        "range",
        (F.sum("rows").over(Window.orderBy("range")) - F.col("rows")).alias("begin"),
    )
    return ranged.join(begins, "range").select(
        *df.columns, (F.col("begin") + F.col("at")).alias("number")
    )


def _digits(number: Column, count: Column) -> Column:
    """The last ``count`` hexadecimal digits; none if the count is 0."""
    return F.when(count == 0, F.lit("")).otherwise(
        F.lpad(F.lower(F.hex(number)), count, F.lit("0"))
    )


def _height(rows: Column) -> Column:
    """Levels until one node is left."""
    powers = F.array(*[F.lit(FAN**k).cast("long") for k in range(15)])
    return F.size(F.filter(powers, lambda p: p < rows))


@dataclass
class Manifest:
    """``leaves`` with their paths, ``records`` by digest, and the root.

    ``leaves`` has group, doc_id, leaf, carried columns, path and depth;
    ``records`` has digest and children, the children's digests run together.
    ``top`` is the number of digits of a path that tell the source.
    """

    leaves: DataFrame
    records: DataFrame
    root: str | None
    top: int


def build_manifest(documents: DataFrame, *, carry: Sequence[Column] = ()) -> Manifest:
    """Hash all rows of ``documents`` into one tree; ``carry`` adds columns."""
    hashed = documents.select(
        F.col("source").cast("string").alias("group"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf_digest([F.col(f) for f in FIELDS]).alias("leaf"),
        *carry,
    )
    placed = written(numbered(hashed, ["group", "doc_id", "leaf"], "merkle-leaves"), "merkle-placed")
    groups = written(
        numbered(
            placed.groupBy("group").agg(
                F.min("number").alias("first"), F.count("*").alias("rows")
            ),
            ["group"],
            "merkle-groups",
        ).select(
            F.col("group").alias("of_group"),
            F.col("number").alias("group_number"),
            "first",
            _height(F.col("rows")).alias("height"),
        ),
        "merkle-groups",
    )
    heights = {r["height"]: r["count"] for r in groups.groupBy("height").count().collect()}
    top, n_groups = 0, sum(heights.values())
    while FAN**top < n_groups:
        top += 1
    path = F.concat(
        _digits(F.col("group_number"), F.lit(top)),
        _digits(F.col("number") - F.col("first"), F.col("height")),
    )
    leaves = written(
        placed.join(groups, F.col("group").eqNullSafe(F.col("of_group"))).select(
            *hashed.columns,
            path.alias("path"),
            (F.col("height") + top).alias("depth"),
        ),
        "merkle-tree",
    )
    levels: list[DataFrame] = []
    nodes = None
    for depth in range(top + max(heights, default=0), 0, -1):
        parts = [] if nodes is None else [nodes.select("path", "digest")]
        if depth - top in heights:
            parts.append(
                leaves.filter(F.col("depth") == depth).select("path", F.col("leaf").alias("digest"))
            )
        nodes = written(_parents(reduce(DataFrame.union, parts), depth), "merkle-level")
        levels.append(nodes.select("digest", "children"))
    if nodes is not None:
        root = nodes.first()["digest"]
        records = reduce(DataFrame.union, levels).groupBy("digest").agg(
            F.first("children").alias("children")
        )
    else:
        only = leaves.first()
        root = only["leaf"] if only else None
        records = leaves.limit(0).select(
            F.col("leaf").alias("digest"), F.col("leaf").alias("children")
        )
    return Manifest(leaves, records, root, top)


def _parents(nodes: DataFrame, depth: int) -> DataFrame:
    """Hash the nodes of one depth into the nodes above."""
    return (
        nodes.groupBy(F.substring("path", 1, depth - 1).alias("path_above"))
        .agg(F.array_sort(F.collect_list(F.struct("path", "digest"))).alias("nodes"))
        .select(
            F.col("path_above").alias("path"),
            F.array_join("nodes.digest", "").alias("children"),
        )
        .withColumn("digest", F.sha2("children", 256))
    )


def _chosen(digit: Column) -> tuple[Column, Column]:
    """The child that the digit picks, and the path segment beside it."""
    children = F.col("children")
    at = F.conv(digit, 16, 10).cast("int") * _HEX
    segment = F.struct(
        F.substring(children, F.lit(1), at).alias("left"),
        F.substring(children, at + (_HEX + 1), F.length(children)).alias("right"),
    )
    return F.substring(children, at + 1, F.lit(_HEX)), segment


def descend(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """Look up leaves by their paths, each requested once, from the root down.

    ``requests`` has path, depth and columns of its own. Added are ``found`` (the
    digest at the path), ``subroot`` and ``segments``, the siblings from the leaf
    up: of each level those left and those right of the node, run together.
    """
    own = list(requests.columns)
    spark = requests.sparkSession
    kind = "path string, digest string, subroot string, segments array<struct<left:string,right:string>>"
    root = manifest.root
    start = [] if root is None else [("", root, root if manifest.top == 0 else None, [])]
    frontier = spark.createDataFrame(start, kind)
    depths = sorted(r[0] for r in requests.select("depth").distinct().collect())
    parents = written(
        requests.filter("depth > 0")
        .select(F.expr("substring(path, 1, depth - 1)").alias("path"))
        .distinct(),
        "merkle-wanted",
    )
    answers = []
    if 0 in depths:
        answers.append(
            requests.filter("depth = 0").crossJoin(F.broadcast(frontier.drop("path"))).select(
                *own, F.col("digest").alias("found"), F.col("digest").alias("subroot"), "segments"
            )
        )
    for depth in range(max(depths, default=0)):
        opened = frontier.withColumnRenamed("path", "above").join(manifest.records, "digest")
        child, segment = _chosen(F.substring("path", depth + 1, 1))
        segments = F.concat(F.array(segment), "segments").alias("segments")
        subroot = child if depth + 1 == manifest.top else F.col("subroot")
        if depth + 1 in depths:
            # A lone leaf of its source is the subroot itself.
            answers.append(
                requests.filter(F.col("depth") == depth + 1)
                .withColumn("above", F.substring("path", 1, depth))
                .join(opened, "above")
                .select(*own, child.alias("found"), subroot.alias("subroot"), segments)
            )
        if depth + 1 < max(depths):
            wanted = (
                parents.filter(F.length("path") > depth)
                .select(F.substring("path", 1, depth + 1).alias("path"))
                .distinct()
                .withColumn("above", F.substring("path", 1, depth))
            )
            frontier = written(
                opened.join(wanted, "above").select(
                    "path", child.alias("digest"), subroot.alias("subroot"), segments
                ),
                "merkle-frontier",
            )
    if not answers:
        nothing = F.lit(None).cast("string")
        return requests.limit(0).select(
            *own,
            nothing.alias("found"),
            nothing.alias("subroot"),
            F.array().cast("array<struct<left:string,right:string>>").alias("segments"),
        )
    return reduce(DataFrame.union, answers)


def folded(leaf: Column, segments: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(
        segments, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256)
    )


def proof_digest(segments: Column) -> Column:
    """SHA-256 of all siblings, level by level from the leaf, left to right."""
    each = F.transform(segments, lambda s: F.concat(s["left"], s["right"]))
    return F.sha2(F.array_join(each, ""), 256)


def verify_rows(documents: DataFrame, *, tampered: Column | None = None) -> DataFrame:
    """Prove every row of ``documents`` and verify what has arrived of it.

    ``tampered`` is the text that has arrived in place of ``text``; without it
    the rows arrived as they were. Returns doc_id, source, leaf, subroot, root,
    segments (the proof), folded_root and verified.
    """
    text = F.col("text") if tampered is None else tampered
    fields = [text if f == "text" else F.col(f) for f in FIELDS]
    manifest = build_manifest(documents, carry=(leaf_digest(fields).alias("arrived"),))
    proven = descend(manifest, manifest.leaves)
    root = F.lit(manifest.root).cast("string")
    return proven.select(
        "doc_id",
        F.col("group").alias("source"),
        "leaf",
        "subroot",
        root.alias("root"),
        "segments",
        folded(F.col("arrived"), F.col("segments")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
