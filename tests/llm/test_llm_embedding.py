import math
import random

import numpy as np
import pytest
from corpus import rows_of
from oracle import connect, differences

from waymark.llm.embedding import near_vectors
from waymark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def by_brute_force(rows, threshold=0.9):
    vectors = [(k, np.array(v, float)) for k, v, _ in rows if v and None not in v]
    vectors = [(k, v / np.sqrt(v @ v)) for k, v in vectors if np.isfinite(v).all() and v.any()]
    links = {k: 0 for k, _, _ in rows}
    group = {k: k for k in links}
    for a, (k, v) in enumerate(vectors):
        for m, w in vectors[:a]:
            if len(v) == len(w) and v @ w >= threshold:
                links[k] += 1
                links[m] += 1
                low, high = sorted((group[k], group[m]))
                group = {x: low if g == high else g for x, g in group.items()}
    return sorted(((k, links[k], group[k], k == group[k]) for k in links), key=repr)


def clusters(seed, size):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(12):
        center = rng.standard_normal(size)
        for _ in range(20):
            noise = rng.uniform(0, 0.7) * rng.standard_normal(size)
            rows.append((len(rows), (center + noise).astype(np.float32).tolist(), 0))
    rows += [(len(rows) + k, rows[5][1], 1) for k in range(30)]
    random.Random(seed).shuffle(rows)
    return rows


@pytest.mark.parametrize("size, part_rows", [(64, 8192), (24, 16), (3, 16), (1, 64)])
def test_links_agree_with_all_pairs(spark, size, part_rows):
    rows = clusters(size, size)
    found = near_vectors(spark.createDataFrame(rows, SCHEMA), part_rows=part_rows)
    assert rows_of(found) == by_brute_force(rows)


def test_edges(spark):
    nan, inf = math.nan, math.inf
    rows = [
        (1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [nan, 1.0], 0), (5, [inf, 1.0], 0),
        (6, [1.0, None], 0), (7, [1.0, 2.0], 0), (8, [2.0, 4.0], 1), (9, [1.0, 2.0, 0.0], 1),
        (10, [-1.0, -2.0], 1), (11, [1e30, 2e30], 1), (12, [1e-30, 2e-30], 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    expected = by_brute_force([(k, v, y) for k, v, y in rows])
    assert rows_of(near_vectors(df)) == expected
    extra = df.selectExpr("*", "'x' AS node", "'x' AS many", "'x' AS size", "'x' AS links")
    assert rows_of(near_vectors(extra.union(extra.filter("vec_id = 7")))) == sorted(
        expected + [r for r in expected if r[0] == 7], key=repr
    )
    assert near_vectors(df.limit(0)).count() == 0


def test_query_agrees_with_sql(spark):
    name = "op2_embedding_dedup"
    assert differences(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) == ""
