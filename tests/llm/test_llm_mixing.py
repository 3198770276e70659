from collections import defaultdict

from corpus import documents, rows_of, with_clashes
from oracle import connect, differences

from waymark.llm.mixing import mix_sources, mixed_documents, source_targets
from waymark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def level_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by filling round after round."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(sizes), share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= most * sizes[s]}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        open_ -= full
    return target


def test_targets_fill_up_in_rounds(spark):
    sizes = {None: 40, "a": 3, "b": 500, "c": 0, "d": 70, "e": 1000, "f": 9}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r.source: r.target for r in source_targets(df).collect()}
    expected = level_targets(sizes)
    assert found.keys() == expected.keys()
    assert all(abs(found[s] - expected[s]) < 1e-9 for s in sizes)


def test_ranges_of_any_size_take_the_same(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = rows_of(mix_sources(docs, range_rows=10_000))
    assert rows_of(mix_sources(docs, range_rows=3)) == one


def test_edges(spark):
    df = documents(spark)
    plain = mix_sources(df)
    assert rows_of(mix_sources(with_clashes(df))) == rows_of(plain)
    taken = defaultdict(int)
    for row in plain.collect():
        assert 0 <= row.taken <= 2 * row["size"]
        taken[row.source] += row.taken
    for row in plain.select("source", "target").distinct().collect():
        assert taken[row.source] == int(row.target)
    assert mix_sources(df.limit(0)).count() == 0


def test_mixed_texts_hold_the_taken_words(spark):
    rows = [(k, " ".join(f" w{k}.{j}\n" for j in range(k % 7)), "ab"[k % 2], "en") for k in range(60)]
    df = documents(spark, rows + rows[:3])
    mixed = mixed_documents(with_clashes(df))
    assert mixed.columns == with_clashes(df).columns
    found = defaultdict(int)
    for row in mixed.collect():
        text = rows[row.doc_id][1]
        assert text.startswith(row.text) and row.n_chars == len(row.text) if "n_chars" in row else True
        assert text.startswith(row.text) and row.copy == "x"
        found[row.doc_id] += len(row.text.split())
    expected = defaultdict(int)
    for row in mix_sources(df).collect():
        expected[row.doc_id] += row.taken
    assert {k: v for k, v in found.items() if v} == {k: v for k, v in expected.items() if v}
    assert mixed_documents(df.limit(0)).count() == 0


def test_query_agrees_with_sql(spark):
    name = "op9_mix_sources"
    assert differences(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) == ""


def test_rows_of_one_id_are_spread(spark):
    """A third of the rows repeat one id, another third one document."""
    rows = [(k if k % 3 == 0 else 7, f"text {k}" if k % 3 < 2 else "same words here", "a", "en") for k in range(6000)]
    rows += [(None, None, "a", "en")] * 900
    df = documents(spark, rows).repartition(9)
    mixed = mix_sources(df, range_rows=100)
    once = rows_of(mixed)
    assert rows_of(mix_sources(df.repartition(4), range_rows=100)) == once
    assert sum(r.taken for r in mixed.collect()) == int(mixed.first().target)
    # Keys of copies differ, so each range holds its share of them.
    from pyspark.sql import functions as F

    from waymark.llm.mixing import _copies_numbered

    same = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.coalesce("text", F.lit("-"))))
    numbered = _copies_numbered(
        df.select(same.alias("same"), F.spark_partition_id().alias("part"))
    )
    for row in numbered.groupBy("same").agg(F.collect_set("copy").alias("s"), F.count("*").alias("n")).collect():
        assert sorted(row.s) == list(range(row.n))
