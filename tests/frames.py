"""Small literal frames; the row id is the position in the list."""

from waymark.columns import ROW_ID


def frame(spark, schema, rows):
    numbered = [(i, *row) for i, row in enumerate(rows)]
    return spark.createDataFrame(numbered, f"{ROW_ID} long, {schema}")


def tracks_small(spark):
    return frame(
        spark,
        "track_id long, snr double, label string",
        [(1, 1.0, "a"), (1, 3.0, "a"), (2, 10.0, "b"), (2, 14.0, "b")],
    )


def filters_small(spark):
    return frame(
        spark,
        "track_id long, score double, label string",
        [(1, 1.0, "keep"), (2, 2.0, "reject"), (3, 3.0, "keep")],
    )


def confirm_small(spark):
    return frame(
        spark,
        "track_id long, time double, snr double, residual double, label string",
        [
            (1, 0.0, 5.0, 2.0, "matched"),
            (1, 1.0, 10.0, 1.0, "matched"),
            (2, 0.0, 4.0, 0.5, "unmatched"),
            (2, 1.0, 6.0, 0.4, "unmatched"),
            (3, 0.0, 12.0, 2.0, "matched"),
            (3, 1.0, 13.0, 2.0, "matched"),
        ],
    )


def features_small(spark):
    return frame(
        spark,
        "track_id long, signal double, noise double, label string",
        [
            (1, 9.0, 1.0, "matched"),
            (1, 10.0, 3.0, "matched"),
            (2, 8.0, 2.0, "matched"),
            (2, 9.0, 4.0, "matched"),
            (3, 1.0, 1.5, "unmatched"),
            (3, 2.0, 3.5, "unmatched"),
            (4, 2.0, 2.5, "unmatched"),
            (4, 1.0, 4.5, "unmatched"),
        ],
    )


def incremental(spark):
    return frame(
        spark,
        "track_id long, signal double, noise double, outcome string",
        [
            (i // 4, float(i >= 50), float((i * 17) % 23), "yes" if i >= 50 else "no")
            for i in range(100)
        ],
    )


def column(df, name, row=ROW_ID):
    """Values of one column in row order."""
    return [r[name] for r in df.orderBy(row).select(name).collect()]
