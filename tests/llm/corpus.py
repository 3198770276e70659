"""Small document tables for the operators' tests."""

EDGES = [
    (1, None, "a", "en"),
    (2, "", "a", "en"),
    (3, " \t\n\x0b", None, None),
    (4, "one", "b", "en"),
    (4, "one", "b", "en"),
    (None, "null id here", "b", "de"),
    (5, "tie word " * 3000, "b", "en"),
    (6, "ünï çödé — “quotes” 中文", "c", "fr"),
]
CLASHING = "node", "key", "size", "kept", "copy", "words", "taken", "score", "spans", "component"


def documents(spark, rows=EDGES):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")


def with_clashes(df):
    """Add columns whose names the operators use inside."""
    return df.selectExpr("*", *[f"'x' AS `{name}`" for name in CLASHING])


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
