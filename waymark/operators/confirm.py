"""First confirmation times, latched points and their summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import Columns
from .ordering import (
    cumulative_counts,
    median_of,
    nearest_index,
    value_at,
)
from .rollup import first_known

DEFAULT_TIME = "default_first_confirmation_time"
CANDIDATE_TIME = "candidate_first_confirmation_time"

# (logic, shown path name, column holding its 0/1 flags)
PathColumn = tuple[str, str, str]


def track_cells(
    points: DataFrame,
    columns: Columns = Columns(),
    *,
    paths: Sequence[PathColumn] = (),
) -> DataFrame:
    """Reduce points to one row per track and label in a single pass.

    Everything the per-track and per-path summaries need is summed before the
    shuffle, so a long track costs a few rows per map task. The label is a
    grouping key, not an aggregate: all buffers have a fixed width and stay in
    a hash aggregate.
    """
    time = F.col(columns.time)
    return points.groupBy(columns.track, columns.label).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(columns.row).alias("first_row"),
        F.min(F.when(F.col("default_triggered"), time)).alias(DEFAULT_TIME),
        F.min(F.when(F.col("candidate_triggered"), time)).alias(CANDIDATE_TIME),
        *[
            F.coalesce(F.sum((F.col(column).cast("tinyint") == 1).cast("long")), F.lit(0)).alias(
                f"hits_{i}"
            )
            for i, (_, _, column) in enumerate(paths)
        ],
    )


def first_confirmation_times(
    cells: DataFrame, columns: Columns = Columns()
) -> DataFrame:
    """One row per track: label, both first times, their change, newly confirmed."""
    default, candidate = F.col(DEFAULT_TIME), F.col(CANDIDATE_TIME)
    return (
        cells.groupBy(columns.track)
        .agg(
            first_known(columns.label, F.col("first_row")).alias(columns.label),
            F.min(DEFAULT_TIME).alias(DEFAULT_TIME),
            F.min(CANDIDATE_TIME).alias(CANDIDATE_TIME),
        )
        .withColumn("first_confirmation_time_change", candidate - default)
        .withColumn("newly_confirmed_track", default.isNull() & candidate.isNotNull())
    )


def latch_points(
    points: DataFrame,
    first_times: DataFrame,
    columns: Columns = Columns(),
) -> DataFrame:
    """Mark every row at or after the first confirmation of its track.

    Rows with a NULL track join nothing and stay unconfirmed.
    """
    lookup = first_times.select(
        columns.track, DEFAULT_TIME, CANDIDATE_TIME, "newly_confirmed_track"
    )
    joined = points.join(lookup, columns.track, "left")

    def reached(first: str) -> Column:
        return F.col(first).isNotNull() & (F.col(columns.time) >= F.col(first))

    return (
        joined.withColumn("default_confirmed", reached(DEFAULT_TIME))
        .withColumn("candidate_confirmed", reached(CANDIDATE_TIME))
        .withColumn(
            "newly_confirmed",
            F.col("candidate_confirmed") & ~F.col("default_confirmed"),
        )
        .select(
            *points.columns,
            DEFAULT_TIME,
            CANDIDATE_TIME,
            "newly_confirmed_track",
            "default_confirmed",
            "candidate_confirmed",
            "newly_confirmed",
        )
    )


def label_summary(latched: DataFrame, columns: Columns = Columns()) -> DataFrame:
    """Measurement and track counts per label; a NULL label is a row of its own.

    Distinct tracks are counted as groups of a first aggregate by label and
    track, so nothing is de-duplicated in one task.
    """

    def hits(flag: str) -> Column:
        return F.coalesce(F.sum(F.col(flag).cast("long")), F.lit(0))

    per_track = latched.groupBy(columns.label, columns.track).agg(
        F.count(F.lit(1)).alias("rows"),
        hits("default_confirmed").alias("default_rows"),
        hits("candidate_confirmed").alias("candidate_rows"),
        hits("newly_confirmed").alias("new_rows"),
        F.coalesce(F.bool_or("newly_confirmed_track"), F.lit(False)).alias("new_track"),
    )
    return per_track.groupBy(columns.label).agg(
        F.sum("rows").alias("measurements"),
        F.count(F.lit(1)).alias("tracks"),
        F.sum("default_rows").alias("default_confirmed_measurements"),
        F.sum("candidate_rows").alias("candidate_confirmed_measurements"),
        F.sum("new_rows").alias("new_confirmed_measurements"),
        F.count_if(F.col("default_rows") > 0).alias("default_confirmed_tracks"),
        F.count_if(F.col("candidate_rows") > 0).alias("candidate_confirmed_tracks"),
        F.count_if("new_track").alias("new_confirmed_tracks"),
    )


def path_summary(
    cells: DataFrame,
    paths: Sequence[PathColumn],
    columns: Columns = Columns(),
    *,
    matched: str = "matched",
) -> DataFrame:
    """Triggering rows and distinct tracks per path and cohort, zero rows kept."""
    spark = cells.sparkSession
    schema = (
        "logic string, confirmation_path string, cohort string, "
        "confirmed_measurements long, confirmed_tracks long"
    )
    if not paths:
        return spark.createDataFrame([], schema)
    # A track with several other labels counts once in the false cohort.
    cohorts = (
        cells.withColumn("cohort", F.col(columns.label) == matched)
        .filter(F.col("cohort").isNotNull())
        .groupBy(columns.track, "cohort")
        .agg(*[F.sum(f"hits_{i}").alias(f"hits_{i}") for i in range(len(paths))])
    )
    # A global aggregate always returns its one row, so empty paths show as 0.
    sums = []
    for i in range(len(paths)):
        for cohort, member in (("matched", F.col("cohort")), ("false", ~F.col("cohort"))):
            hits = F.when(member, F.col(f"hits_{i}"))
            sums.append(F.coalesce(F.sum(hits), F.lit(0)).alias(f"rows_{i}_{cohort}"))
            sums.append(F.count_if(hits > 0).alias(f"tracks_{i}_{cohort}"))
    entries = [
        F.struct(
            F.lit(logic).alias("logic"),
            F.lit(path).alias("confirmation_path"),
            F.lit(cohort).alias("cohort"),
            F.col(f"rows_{i}_{cohort}").alias("confirmed_measurements"),
            F.col(f"tracks_{i}_{cohort}").alias("confirmed_tracks"),
        )
        for i, (logic, path, _) in enumerate(paths)
        for cohort in ("matched", "false")
    ]
    return cohorts.agg(*sums).select(F.inline(F.array(*entries)))


def headline_metrics(
    labels: DataFrame,
    first_times: DataFrame,
    columns: Columns = Columns(),
    *,
    matched: str = "matched",
) -> DataFrame:
    """One row of confirmed, new and false-alarm figures.

    Row figures are read off the label summary, track figures off the first
    times; points are not scanned again.
    """
    label = F.col(columns.label)

    def rate(part: Column, whole: Column) -> Column:
        return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)

    confirmed = F.col("candidate_confirmed_measurements")
    rows = labels.agg(
        _total(F.col("new_confirmed_measurements")).alias("new_confirmed_measurements"),
        _total(F.when(label == matched, confirmed)).alias(
            "matched_confirmed_measurements"
        ),
        _total(F.when(label != matched, confirmed)).alias("false_rows"),
        _total(confirmed).alias("confirmed_rows"),
    )
    has_candidate = F.col(CANDIDATE_TIME).isNotNull()
    tracks = first_times.agg(
        F.count_if(F.col(DEFAULT_TIME).isNotNull()).alias("default_confirmed_tracks"),
        F.count_if(has_candidate).alias("candidate_confirmed_tracks"),
        F.count_if("newly_confirmed_track").alias("new_confirmed_tracks"),
        F.count_if(has_candidate & (label != matched)).alias("false_tracks"),
    )
    # Two one-row tables become one row.
    both = rows.unionByName(tracks, allowMissingColumns=True)
    merged = both.agg(*[F.max(name).alias(name) for name in both.columns])
    return merged.select(
        "default_confirmed_tracks",
        "candidate_confirmed_tracks",
        "new_confirmed_tracks",
        "new_confirmed_measurements",
        "matched_confirmed_measurements",
        rate(F.col("false_rows"), F.col("confirmed_rows")).alias(
            "point_false_alarm_rate"
        ),
        rate(F.col("false_tracks"), F.col("candidate_confirmed_tracks")).alias(
            "track_false_alarm_rate"
        ),
    )


def _total(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast("long")


def confirmation_change() -> Column:
    """Lost, Added, Earlier or Later; NULL where the two first times agree."""
    default, candidate = F.col(DEFAULT_TIME), F.col(CANDIDATE_TIME)
    return (
        F.when(default.eqNullSafe(candidate), F.lit(None).cast("string"))
        .when(candidate.isNull(), F.lit("Lost"))
        .when(default.isNull(), F.lit("Added"))
        .when(candidate < default, F.lit("Earlier"))
        .otherwise(F.lit("Later"))
    )


def changed_tracks(first_times: DataFrame) -> DataFrame:
    changed = first_times.withColumn("confirmation_change", confirmation_change())
    return changed.filter(F.col("confirmation_change").isNotNull())


def lost_track_count(first_times: DataFrame) -> DataFrame:
    return first_times.agg(
        F.count_if(confirmation_change() == "Lost").alias("lost_tracks")
    )


def changed_track_points(
    latched: DataFrame,
    columns: Columns = Columns(),
    *,
    features: Sequence[str] = (),
    label: str | None = None,
    sort: bool = True,
) -> DataFrame:
    """Confirmed rows of changed tracks, once per logic that confirms them.

    The latched rows already carry both first times, so the change class is an
    expression and each row is duplicated in place: no join, no second scan.
    """
    shown = [columns.track, columns.time, *([label] if label else []), *features]
    slices = F.array(
        F.struct(
            F.col(DEFAULT_TIME).alias("first_confirmation_time"),
            F.lit("Default").alias("confirmation_logic"),
            F.col("default_confirmed").alias("__keep"),
        ),
        F.struct(
            F.col(CANDIDATE_TIME).alias("first_confirmation_time"),
            F.lit("Candidate").alias("confirmation_logic"),
            F.col("candidate_confirmed").alias("__keep"),
        ),
    )
    result = (
        latched.withColumn("confirmation_change", confirmation_change())
        .filter(F.col("confirmation_change").isNotNull())
        .select(*dict.fromkeys(shown), "confirmation_change", F.inline(slices))
        .filter("__keep")
        .drop("__keep")
    )
    if not sort:
        return result
    return result.orderBy(columns.track, columns.time, "confirmation_logic")


def timing_slices(
    first_times: DataFrame, columns: Columns = Columns(), *, cohorts: bool
) -> DataFrame:
    """Long table of confirmed first times by logic, and by cohort if asked.

    A label valued ``Overall`` shares its cohort with the whole table.
    """
    logics = (("Default", DEFAULT_TIME), ("Candidate", CANDIDATE_TIME))
    groups: list[Column | None] = [None]
    if cohorts:
        groups = [F.lit("Overall"), F.col(columns.label).cast("string")]
    entries = []
    for logic, time in logics:
        for group in groups:
            fields = [F.lit(logic).alias("logic")]
            if group is not None:
                fields.append(group.alias("cohort"))
            fields.append(F.col(time).alias("first_confirmation_time"))
            entries.append(F.struct(*fields))
    return first_times.select(F.inline(F.array(*entries))).filter(
        F.col("first_confirmation_time").isNotNull()
    )


def first_confirmation_summary(
    first_times: DataFrame,
    columns: Columns = Columns(),
) -> DataFrame:
    """Count, range, nearest-rank quantiles, median and mean by cohort and logic."""
    value = "first_confirmation_time"
    running = cumulative_counts(
        timing_slices(first_times, columns, cohorts=True),
        ["logic", "cohort"],
        value,
        {"n": F.lit(1)},
    )
    total = F.col("n_total")

    def quantile(share: float) -> Column:
        return value_at(nearest_index(total, share), value, "n")

    weighted = F.sum(F.col(value).cast("double") * F.col("n"))
    return (
        running.groupBy("logic", "cohort")
        .agg(
            F.sum("n").alias("confirmed_tracks"),
            F.min(value).alias("minimum"),
            quantile(0.25).alias("p25"),
            median_of(value, "n").alias("median"),
            (weighted / F.sum("n")).alias("mean"),
            quantile(0.75).alias("p75"),
            quantile(0.90).alias("p90"),
            F.max(value).alias("maximum"),
        )
        .orderBy("cohort", "logic")
    )


def first_confirmation_cdf(
    first_times: DataFrame,
    columns: Columns = Columns(),
) -> DataFrame:
    """Cumulative share of confirmed tracks per logic, one row per distinct time."""
    running = cumulative_counts(
        timing_slices(first_times, columns, cohorts=False),
        ["logic"],
        "first_confirmation_time",
        {"n": F.lit(1)},
    )
    return running.select(
        "logic",
        "first_confirmation_time",
        F.col("n").alias("tracks"),
        (F.col("n_upto") / F.col("n_total")).alias("cdf"),
    )
