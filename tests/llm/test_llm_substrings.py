import random
import re

import pytest
from corpus import EDGES, documents, rows_of, with_clashes
from oracle import connect, differences
from pyspark.sql import functions as F

from waymark.llm.queries import ORACLES, QUERIES
from waymark.llm.substrings import Reference, without_repeats

SF = "/root/testdata/sf0.001"


def plain(rows, window):
    """doc_id, n_words, removed word numbers, kept words."""
    cut = [(d, re.findall("[^\x20\x09-\x0d]+", t or "")) for d, t in rows]
    order = [float("inf") if d is None else d for d, _ in cut]
    first = {}
    for d, (_, w) in zip(order, cut):
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            first[key] = min(d, first.get(key, d))
    out = []
    for d, (doc_id, w) in zip(order, cut):
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < d:
                gone.update(range(p, p + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((doc_id, len(w), sorted(gone), kept))
    return sorted(out, key=repr)


def found(df, **settings):
    rows = without_repeats(df.select("doc_id", "text"), **settings).collect()
    return sorted(
        (
            (r.doc_id, r.n_words, [k for s in r.spans for k in range(s.start, s.end)], r.text)
            for r in rows
        ),
        key=repr,
    )


@pytest.mark.parametrize("crowd", [5_000, 3])
@pytest.mark.parametrize("seed", range(2))
def test_equals_plain_code(spark, seed, crowd):
    rng = random.Random(seed)
    passages = [[f"w{rng.randrange(300)}" for _ in range(rng.randrange(3, 40))] for _ in range(12)]
    line = [f"c{k}" for k in range(15)]
    rows = []
    for k in range(120):
        words = []
        for _ in range(rng.randrange(0, 9)):
            passage = list(rng.choice([*passages, line, line]))
            if rng.random() < 0.4:
                passage[rng.randrange(len(passage))] = f"x{rng.randrange(9)}"
            words += passage + [f"u{rng.randrange(10_000)}"] * rng.randrange(3)
        doc_id = None if rng.random() < 0.05 else rng.randrange(100)
        rows.append((doc_id, rng.choice([" ", "\n", "  "]).join(words)))
    rows += rows[:10]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    settings = {"crowd": crowd, "block_segments": 60}
    assert found(df, window=13, **settings) == plain(rows, 13)
    if seed == 0:
        assert found(df, window=6, anchor=2, **settings) == plain(rows, 6)


def test_windows_across_factors_are_found():
    reference = Reference(3)
    assert reference.parse(b"a b c d e", 1) == []
    assert reference.parse(b"d e f g h", 2) == []
    assert reference.parse(b"c d e f", 3) == [(0, 4)]
    assert reference.parse(b"x a b c y d e f", 3) == [(1, 4), (5, 8)]
    assert reference.parse(b"p q r p q r", 4) == []


def test_query_agrees_with_sql(spark):
    name = "op13_substring_dedup"
    assert differences(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) == ""


def test_edges(spark):
    rows = [*EDGES, (9, EDGES[6][1] + " tail", "b", "en"), (None, None, None, None)]
    df = documents(spark, rows)
    result = found(df)
    assert result == plain([r[:2] for r in rows], 13)
    assert rows_of(without_repeats(with_clashes(df)).select("doc_id", "text")) == rows_of(
        without_repeats(df).select("doc_id", "text")
    )
    assert without_repeats(df.limit(0)).count() == 0


def test_many_copies_of_one_text(spark):
    df = spark.range(3, 600).select(
        F.col("id").alias("doc_id"), F.lit("to be or not " * 9).alias("text")
    )
    rows = without_repeats(df).agg(F.sum(F.size("spans")), F.min("doc_id")).first()
    assert tuple(rows) == (596, 3)
    kept = without_repeats(df).filter("text != ''").select("doc_id").collect()
    assert [r[0] for r in kept] == [3]
