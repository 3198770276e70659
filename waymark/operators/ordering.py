"""Exact ranks and cumulative counts without a single-task global sort.

Everything here follows one scheme. Rows are first reduced to one row per
(group, value), so a value held by a third of the table costs one row. The
value axis is then cut into buckets, each bucket is summed and sorted on its
own task, and the small per-bucket totals give every bucket its starting
offset. A bucket follows from the value itself: an interval of a logarithmic axis,
cut finer where it is crowded. So nothing runs before the query does, and
results do not depend on the cuts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import written

BUCKET = "__bucket"
_CELL = "__cell"

#: Different values of one group from which a bucket is cut finer.
BUCKET_ROWS = 1_000_000
#: Intervals of a bucket per unit of ``log(1 + |value|)``. Of the fine ones, one
#: holds at most some four million different doubles.
COARSE, FINE = 64.0, 2.0**30
#: Leading hex digits of a hash that make its bucket: 65,536 buckets.
HASH_DIGITS = 4
LARGEST_LONG = 2**63 - 1


def bucket_of(value: Column, scale: float) -> Column:
    """The interval of a value, which never falls as the value rises; NaN is last."""
    x = value.cast("double")
    place = F.floor(F.signum(x) * F.log1p(F.abs(x)) * F.lit(scale))
    return F.when(F.isnan(x), F.lit(LARGEST_LONG)).otherwise(place)


def _bucketed(counts: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Add the bucket of each row: a coarse interval, and a fine one in crowds."""
    coarse = counts.withColumn("__coarse", bucket_of(F.col(value), COARSE))
    # At most one row for every ``BUCKET_ROWS`` rows of ``counts``.
    crowds = (
        coarse.groupBy(*groups, "__coarse")
        .agg(F.count(F.lit(1)).alias("__rows"))
        .filter(F.col("__rows") > BUCKET_ROWS)
        .select("__coarse")
        .distinct()
        .withColumn("__crowd", F.lit(True))
    )
    fine = F.when(F.col("__crowd"), bucket_of(F.col(value), FINE)).otherwise(F.lit(0))
    bucket = F.struct(F.col("__coarse").alias("coarse"), fine.cast("long").alias("fine"))
    return (
        coarse.join(F.broadcast(crowds), "__coarse", "left")
        .withColumn(BUCKET, bucket)
        .drop("__coarse", "__crowd")
    )


def cumulative_counts(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    weights: Mapping[str, Column],
) -> DataFrame:
    """One row per (groups, value) with running and total weights per group.

    For each weight ``w`` the result has ``w`` (sum at this value), ``w_upto``
    (sum over values up to and including it) and ``w_total``. NULL values must
    be removed by the caller; NaN sorts last. Groups may be NULL.
    """
    if isinstance(df.schema[value].dataType, T.DecimalType):
        df = df.withColumn(value, F.col(value).cast("double"))
    counts = df.groupBy(*groups, value).agg(
        *[F.sum(weight).alias(name) for name, weight in weights.items()]
    )
    return _running(_bucketed(counts, groups, value), groups, [value], list(weights))


def value_ranks(
    df: DataFrame, groups: Sequence[str], value: str, *, rank: str, total: str
) -> DataFrame:
    """Add the 1-based rank of a number within each group, and the group's rows.

    The rows keep their columns on the way, so nothing is joined back. The number
    must not be NULL and should differ within a group.
    """
    keyed = _bucketed(df, groups, value).withColumn(rank, F.lit(1).cast("long"))
    ranked = _running(keyed, groups, [value], [rank])
    return (
        ranked.withColumn(rank, F.col(f"{rank}_upto"))
        .withColumn(total, F.col(f"{rank}_total"))
        .drop(f"{rank}_upto", f"{rank}_total")
    )


def hash_ranks(
    df: DataFrame,
    groups: Sequence[str],
    order: Column,
    tie_breaker: str,
    *,
    rank: str,
    total: str | None = None,
) -> DataFrame:
    """Add the 1-based rank of an md5 hex column within each group.

    The leading hex digits of a hash are uniform, so they are the buckets.
    """
    keyed = df.withColumn("__order", order).withColumn(
        BUCKET, F.substring("__order", 1, HASH_DIGITS)
    ).withColumn(rank, F.lit(1).cast("long"))
    ranked = _running(keyed, groups, ["__order", tie_breaker], [rank])
    ranked = ranked.withColumn(rank, F.col(f"{rank}_upto"))
    if total is not None:
        ranked = ranked.withColumn(total, F.col(f"{rank}_total"))
    return ranked.drop("__order", f"{rank}_upto", f"{rank}_total")


def numbered(df: DataFrame, key: str, number: str) -> tuple[DataFrame, int]:
    """Add ``number``, the place of each row by ``key``, from 0 without gaps; the
    second result is how many rows there are.

    Rows are sorted in key ranges and written; a range's rows are numbered on from
    the counts of the ranges before it, one number a range.
    """
    placed = written(
        df.repartitionByRange(key)
        .sortWithinPartitions(key)
        .withColumn("__at", F.monotonically_increasing_id()),
        "numbered",
    )
    # The upper bits of the id tell the range, the lower 33 the place in it.
    ranged = placed.withColumn("__range", F.shiftright("__at", 33)).withColumn(
        "__at", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    )
    counts = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__rows"))
    begins = counts.select(
        "__range",
        (F.sum("__rows").over(Window.orderBy("__range")) - F.col("__rows")).alias("__begin"),
    )
    rows = ranged.join(begins, "__range").select(
        *df.columns, (F.col("__begin") + F.col("__at")).alias(number)
    )
    return rows, placed.count()


def leading_share(
    df: DataFrame, key: str, tie_breaker: str, size: int, weight: str | None = None
) -> Column | None:
    """Predicate of the first rows by a hash key whose weights reach ``size``.

    Counts per leading digits tell the bucket in which the sum is reached, and only
    that bucket, one of 65,536, is ordered. None means that all rows are needed.
    ``key`` and ``tie_breaker`` must tell the rows apart.
    """
    digits = F.substring(key, 1, HASH_DIGITS)
    amount = F.lit(1) if weight is None else F.col(weight)
    upto = Window.orderBy("__digits")
    cut = (
        df.groupBy(digits.alias("__digits"))
        .agg(F.sum(amount).alias("__sum"))
        .withColumn("__upto", F.sum("__sum").over(upto))
        .filter(F.col("__upto") >= size)
        .orderBy("__digits")
        .first()
    )
    if cut is None:
        return None
    missing = size - (cut["__upto"] - cut["__sum"])
    inside = Window.orderBy(key, tie_breaker).rowsBetween(Window.unboundedPreceding, -1)
    last = (
        df.filter(digits == cut["__digits"])
        .select(key, tie_breaker, F.coalesce(F.sum(amount).over(inside), F.lit(0)).alias("__before"))
        .filter(F.col("__before") < missing)
        .agg(F.max(F.struct(key, tie_breaker)).alias("last"))
        .first()["last"]
    )
    return (F.col(key) < last[0]) | (
        (F.col(key) == last[0]) & (F.col(tie_breaker) <= F.lit(last[1]))
    )


def _running(
    counts: DataFrame,
    groups: Sequence[str],
    order: Sequence[str],
    weights: Sequence[str],
) -> DataFrame:
    # A struct is never NULL and compares NULL groups as equal. Using it as the
    # key of the window and of the join lets both share one exchange.
    cell = F.struct(*[F.col(g).alias(f"g{i}") for i, g in enumerate(groups)], BUCKET)
    kept = [c for c in counts.columns if c != BUCKET]
    celled = counts.select(*kept, cell.alias(_CELL))
    inside = (
        Window.partitionBy(_CELL)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    upto = {w: F.sum(w).over(inside) for w in weights}
    # At most one row per group and bucket.
    per_cell = celled.groupBy(_CELL).agg(*[F.sum(w).alias(w) for w in weights])
    group = [F.col(f"{_CELL}.g{i}") for i in range(len(groups))]
    across = (
        Window.partitionBy(*group)
        .orderBy(f"{_CELL}.{BUCKET}")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    everything = Window.partitionBy(*group)
    offsets = per_cell.select(
        _CELL,
        *[
            (F.sum(w).over(across) - F.col(w)).alias(f"__{w}_before")
            for w in weights
        ],
        *[F.sum(w).over(everything).alias(f"{w}_total") for w in weights],
    )
    local = celled.select(
        "*", *[column.alias(f"__{w}_local") for w, column in upto.items()]
    )
    return local.join(offsets, _CELL, "inner").select(
        *kept,
        *[
            (F.col(f"__{w}_local") + F.col(f"__{w}_before")).alias(f"{w}_upto")
            for w in weights
        ],
        *[F.col(f"{w}_total") for w in weights],
    )


def value_at(index: Column, value: str, weight: str) -> Column:
    """Aggregate picking the value at a 0-based position of the sorted group."""
    upto = F.col(f"{weight}_upto")
    covers = (upto - F.col(weight) <= index) & (index < upto)
    return F.max(F.when(covers, F.col(value)))


def nearest_index(total: Column, share: float) -> Column:
    """0-based nearest-rank position of a quantile, halves rounding up."""
    return F.floor((total - 1) * F.lit(share) + F.lit(0.5)).cast("long")


def median_of(value: str, weight: str) -> Column:
    """Aggregate giving the interpolated median of cumulative counts."""
    total = F.col(f"{weight}_total")
    lower = F.floor((total - 1) / 2).cast("long")
    upper = F.floor(total / 2).cast("long")
    return (value_at(lower, value, weight) + value_at(upper, value, weight)) / 2
