"""Mix sources to target weights by distributed prefix sums of word counts.

Each document gets a hash-random key, the MD5 of a seed, its id, text and source and the
number of its copy, so rows that repeat one id or one document are as spread out
as others. Within a source, documents are sorted by key: the key space is cut into
ranges, the words of each range are summed, and a running sum over ranges tells
where each range begins, so no task sorts more than one range. A document is taken whole
as often as whole passes over its source fit into the target; the last pass is
cut at the exact word.

Edge cases: a null or empty text has size 0 and takes nothing; a null source is
a source of its own, last in order; repeated rows count as separate documents;
an empty table gives an empty result; further columns are ignored by
``mix_sources`` and kept by ``mixed_documents``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.storage import written

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (5, 2, 1)
#: Documents of one key range; a range is sorted by one task.
RANGE_ROWS = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _copies_numbered(rows: DataFrame) -> DataFrame:
    """Add ``copy``: rows with one ``same`` are numbered from 0.

    They are numbered within the part of the table they lie in, after those in
    the parts before, so many copies are no single task's work.
    """
    per_part = rows.groupBy("same", "part").agg(F.count("*").alias("here"))
    begins = per_part.select(
        "same",
        "part",
        (F.sum("here").over(Window.partitionBy("same").orderBy("part")) - F.col("here")).alias(
            "begin"
        ),
    )
    inside = Window.partitionBy("same", "part").orderBy(F.lit(0))
    return (
        rows.withColumn("at", F.row_number().over(inside) - 1)
        .join(begins, ["same", "part"])
        .withColumn("copy", F.col("begin") + F.col("at"))
        .drop("begin", "at", "part")
    )


def source_targets(
    sizes: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
) -> DataFrame:
    """Add each source's target to a table of one row per source.

    Sources share ``share`` times all words in proportion to their weights, but
    none more than ``most`` times its own. Sources are capped in the order of
    capacity per weight: if the fair level exceeds that of the k-th source, it
    and all before it are capped, so one running sum finds the level.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn(
        "weight", F.get(cycle, (F.row_number().over(order) - 1) % len(weights))
    ).withColumn("room", F.col("source_size") * most)
    by_level = Window.orderBy(F.col("room") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (
        F.sum("source_size").over(everything) * share
        - F.coalesce(F.sum("room").over(before), F.lit(0.0))
    ) / (
        F.sum("weight").over(everything)
        - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    # The level that holds is the one of the first source that it does not fill.
    first = F.min_by(
        "level",
        F.when(F.col("level") * F.col("weight") < F.col("room"), F.col("place")),
    ).over(everything)
    return (
        weighed.withColumn("level", level)
        .withColumn("place", F.row_number().over(by_level))
        .withColumn("level", first)
        .select(
            *sizes.columns,
            F.coalesce(
                F.least("room", F.col("level") * F.col("weight")), F.col("room")
            ).alias("target"),
        )
    )


def mix_sources(
    documents: DataFrame,
    *,
    weights: Sequence[int] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
    range_rows: int = RANGE_ROWS,
    carry: Sequence[Column] = (),
) -> DataFrame:
    """Words that the mix takes of each document.

    Returns doc_id, size, source, source_size, target and taken, one row per
    row of ``documents``. ``taken`` adds up to the floor of the target in each
    source and is at most ``most`` times the size. ``carry`` adds columns that
    are computed from the documents.
    """
    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    text = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("-"))
    source = F.coalesce(F.concat(F.lit(":"), F.col("source").cast("string")), F.lit(""))
    sized = written(
        documents.select(
            "doc_id",
            F.col("source").cast("string").alias("source"),
            word_count(F.col("text")).alias("size"),
            F.md5(F.concat(doc_id, F.lit(":"), text, source)).alias("same"),
            F.spark_partition_id().alias("part"),
            *carry,
        ),
        "mix-sizes",
    )
    totals = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("source_rows")
    )
    plan = written(
        source_targets(totals, weights, share, most).select(
            F.col("source").alias("plan_source"),
            "source_size",
            "target",
            F.ceil(F.col("source_rows") / range_rows).alias("ranges"),
        ),
        "mix-targets",
    )
    key = F.md5(F.concat_ws(":", F.lit(seed), "same", F.col("copy").cast("string")))
    keyed = _copies_numbered(sized).withColumn("key", key).drop("same", "copy")
    # The leading 32 bits of the key, as a fraction, tell its range.
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / 4294967296.0
    carried = [c for c in keyed.columns if c != "source"]
    ranged = keyed.join(plan, F.col("source").eqNullSafe(F.col("plan_source"))).select(
        "source",
        *carried,
        "source_size",
        "target",
        F.floor(place * F.col("ranges")).alias("range"),
    )
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size")
    begins = (
        ranged.groupBy("source", "range")
        .agg(F.sum("size").alias("words"))
        .select(
            F.col("source").alias("of_source"),
            F.col("range").alias("of_range"),
            (
                F.sum("words").over(Window.partitionBy("source").orderBy("range"))
                - F.col("words")
            ).alias("begin"),
        )
    )
    running = ranged.withColumn(
        "before",
        F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
        - F.col("size"),
    )
    budget = F.floor("target").cast("long")
    passes = F.when(
        F.col("source_size") > 0, F.floor(budget / F.col("source_size"))
    ).otherwise(F.lit(0))
    rest = budget - passes * F.col("source_size")
    last = F.greatest(
        F.lit(0).cast("long"),
        F.least(F.col("size"), rest - F.col("begin") - F.col("before")),
    )
    return running.join(
        begins,
        F.col("source").eqNullSafe(F.col("of_source"))
        & (F.col("range") == F.col("of_range")),
    ).select(
        *[c for c in carried if c != "key"],
        "source",
        "source_size",
        "target",
        (passes * F.col("size") + last).cast("long").alias("taken"),
    )


def mixed_documents(documents: DataFrame, **settings) -> DataFrame:
    """The mixed corpus itself: each document repeated and cut as ``taken`` says.

    A document that is taken in full comes once per pass; the text of a partial
    pass ends with its last taken word. Documents without words are kept once.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("__mix_row")
    taken = mix_sources(documents, carry=(row,), **settings).select(
        "__mix_row",
        F.col("size").alias("__mix_words"),
        F.col("taken").alias("__mix_taken"),
    )
    passes = F.transform(
        F.sequence(F.lit(0), F.ceil(F.col("__mix_taken") / F.greatest("__mix_words", F.lit(1))).cast("int")),
        lambda k: F.least(F.col("__mix_words"), F.col("__mix_taken") - k * F.col("__mix_words")),
    )
    # Pieces end with a word each, so the first k of them hold k words.
    pieces = F.split("text", "(?<=[^\\x20\\x09-\\x0D])(?=[\\x20\\x09-\\x0D])")
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("__mix_pass").cast("int")), "")
    return (
        taken.select("__mix_row.*", "__mix_words", "__mix_taken")
        .withColumn(
            "__mix_pass",
            F.explode(
                F.when(F.col("__mix_words") == 0, F.array(F.lit(0).cast("long"))).otherwise(
                    F.filter(passes, lambda n: n > 0)
                )
            ),
        )
        .withColumn(
            "text",
            F.when(F.col("__mix_pass") == F.col("__mix_words"), F.col("text")).otherwise(cut),
        )
        .withColumn("n_chars", F.length("text").cast("long"))
        .select(*documents.columns)
    )
