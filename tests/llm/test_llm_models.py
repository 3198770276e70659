"""Quality rules, language model and the pipeline, against plain code."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from corpus import documents, rows_of, with_clashes

import corpus_pipeline
from waymark.llm.boosting import fit_trees
from waymark.llm.eliasfano import EliasFano
from waymark.llm.lm import score_corpus
from waymark.llm.quality import COUNTS, document_statistics, judge_quality
from waymark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# Quality


def counts_of(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often = Counter(windows)
    inside = {j for k, w in enumerate(windows) if often[w] > 1 for j in range(k, k + 8)}
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, dups, len(inside)


def test_counts_equal_plain_code(spark):
    rows = [(k, t) for k, t in table(spark, "documents").select("doc_id", "text").collect()]
    rows += [(-1, None), (-2, ""), (-3, "\na\na b\n a b\na b"), (-4, "a " * 9), (-5, "é\xa0\nx\n\nx"), (-6, "w " * 30_000)]
    df = documents(spark, [(*r, "a", "en") for r in rows])
    found = {r.doc_id: tuple(r[c] for c in COUNTS) for r in document_statistics(with_clashes(df)).collect()}
    assert found == {k: counts_of(t) for k, t in rows}


def test_trees_learn_and_stay_monotonic():
    rng = np.random.default_rng(1)
    rows = rng.uniform(size=(2000, 3))
    target = (rows[:, 0] + 0.3 * rng.standard_normal(2000) > 0.5).astype(int)
    trees = fit_trees(rows, target, [1, 0, -1])
    assert ((trees.probability(rows) > 0.5) == target).mean() > 0.75
    grid = np.linspace(0, 1, 50)
    for fixed in rng.uniform(size=(20, 3)):
        for feature, sign in ((0, 1), (2, -1)):
            line = np.repeat(fixed[None], 50, axis=0)
            line[:, feature] = grid
            assert (sign * np.diff(trees.margin(line)) >= -1e-12).all()


def test_quality_query_finds_bad_held_out_documents(spark):
    labels = table(spark, "labels")
    half = labels.filter("doc_id % 2 = 0")
    found = {r.doc_id: r for r in judge_quality(table(spark, "documents"), half).collect()}
    other = [r for r in labels.filter("doc_id % 2 = 1").collect() if not found[r.doc_id].base_failed]
    right = sum(found[r.doc_id].kept == bool(r.quality) for r in other)
    assert right >= 0.9 * len(other) > 0
    rows = QUERIES["op4_quality_rules"](spark, SF).collect()
    for r in rows:
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)


def test_quality_edges(spark):
    df = documents(spark)
    labels = spark.createDataFrame([(1, None, 0), (4, 7, 0)], "doc_id long, quality int, toxic int")
    found = judge_quality(with_clashes(df), labels).collect()
    assert len(found) == df.count() and all(r.score == 1.0 for r in found)
    assert all(r.kept == (not r.base_failed) for r in found)
    assert judge_quality(df.limit(0), labels).count() == 0


# Language model


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 7 == 2


def plain_scores(rows, least):
    """Interpolated absolute discounting of words, pairs and triples, exact."""
    lower = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})
    texts = [(k, [*WORD.findall((t or "").translate(lower)), None]) for k, t in rows]
    training = [t for k, t in texts if k is not None and not held(k)]
    one = Counter(w for t in training for w in t)
    two = Counter(p for t in training for p in zip(["<s>", *t], t))
    two = {p: n for p, n in two.items() if n >= least}
    three = Counter(p for t in training for p in zip(["<s>", *t], t, t[1:]) if p[:2] in two and p[1:] in two)
    three = {p: n for p, n in three.items() if n >= least}
    kept = Counter()
    for level in (two, three):
        for p, n in level.items():
            kept[p[:-1]] += n - 0.75
    size = sum(one.values()) + len(one) + 1

    def chance(p):
        if len(p) == 1:
            return (one[p[0]] + 1) / size
        if p[:-1] not in kept:
            return chance(p[1:])
        context = {1: len(training) if p[0] == "<s>" else one[p[0]], 2: two.get(p[:2])}[len(p) - 1]
        own = {2: two, 3: three}[len(p)].get(p)
        left = max(1 - kept[p[:-1]] / context, 1e-9)
        return ((own - 0.75) / context if own else 0) + left * chance(p[1:])

    out = {}
    for k, t in texts:
        base = sum(math.log10((one[w] + 1) / size) for w in t)
        begun = ["<s>", *t]
        score = sum(math.log10(chance(tuple(begun[max(0, j - 1) : j + 2]))) for j in range(len(t)))
        known = sum(one[w] > 0 for w in t)
        out[k] = (k is not None and held(k), len(t), known, sum(one.values()), base, score)
    return out


def close(found, expected):
    """Scores are quantised; all else is exact."""
    assert found[:4] == expected[:4]
    assert math.isclose(found[4], expected[4], rel_tol=1e-9)
    assert abs(found[5] - expected[5]) <= 0.02 * expected[1]


def test_scores_equal_plain_code(spark):
    docs = table(spark, "documents").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    for least, found in (
        (1, QUERIES["op10_lm_score"](spark, SF)),
        (2, score_corpus(docs, (2, 2))),
    ):
        expected = plain_scores(rows, least)
        for row in found.collect():
            close(tuple(row)[1:], expected[row.doc_id])


def test_small_files_give_the_same_scores(spark, monkeypatch):
    from waymark.llm import lm

    df = table(spark, "documents")
    whole = {r.doc_id: r for r in score_corpus(df, (2, 2)).collect()}
    monkeypatch.setattr(lm, "PART_ENTRIES", 500)
    for row in score_corpus(df, (2, 2)).collect():
        other = whole[row.doc_id]
        assert (row.n_tokens, row.n_known, row.train_tokens) == (other.n_tokens, other.n_known, other.train_tokens)
        assert abs(row.score - other.score) <= 0.02 * row.n_tokens


def test_language_model_edges(spark):
    df = documents(spark)
    expected = plain_scores([(r.doc_id, r.text) for r in df.dropDuplicates(["doc_id"]).collect()], 2)
    found = score_corpus(with_clashes(df.dropDuplicates(["doc_id"])), (2, 2)).collect()
    for row in found:
        close(tuple(row)[1:], expected[row.doc_id])
    assert score_corpus(df.limit(0)).count() == 0
    alone = score_corpus(df.filter("doc_id IS NULL")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.score) for r in alone] == [(4, 0, 0, 0.0)]


@pytest.mark.parametrize("size, most", [(0, 1), (1, 5), (10, 12), (3000, 1 << 20), (3000, 1 << 62), (5000, 6000)])
def test_elias_fano_round_trip(size, most):
    rng = np.random.default_rng(size)
    values = np.unique(rng.integers(0, most, size))
    sequence = EliasFano(EliasFano.build(values))
    assert (sequence.value(np.arange(len(values))) == values).all()
    assert (sequence.find(values) == np.arange(len(values))).all()
    held_ = set(values.tolist())
    others = np.array([x for x in rng.integers(0, most + 3, 500).tolist() if x not in held_], np.int64)
    assert (sequence.find(others) == -1).all()


# Pipeline


def test_pipeline_stages(spark):
    base = " ".join(f"word{k % 50}x{k}" for k in range(60))
    rows = [
        (1, f"{base} the end of it", "a", "en"),
        (2, f"{base} the end of them", "a", "en"),
        (3, "12345 67890", "a", "en"),
        (4, "write to me at a.b@c.org or to nobody", "b", "en"),
        (5, None, "b", "en"),
        (6, "le texte est tout autre et il reste", "c", "fr"),
        (6, "le texte est tout autre et il reste", "c", "fr"),
    ]
    docs = with_clashes(documents(spark, rows)).selectExpr("*", "CAST(length(text) AS long) AS n_chars")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF)
        if name != "bpe":
            assert after.columns == docs.columns
            kept[name] = sorted((r.doc_id, r.text) for r in after.collect())
            docs = after
    assert [k for k, _ in kept["language_id"]] == [1, 2, 4, 6, 6]
    assert [k for k, _ in kept["minhash_dedup"]] == [1, 4, 6]
    assert dict(kept["personal_data"])[4] == "write to me at [EMAIL] or to nobody"
    words = Counter()
    for k, text in kept["mix_sources"]:
        words[k] += len(text.split())
    sizes = {k: len(t.split()) for k, t in kept["personal_data"]}
    # 1.5 times all words, at weights 5, 2 and 1, none above twice its own.
    assert set(words) <= set(sizes) and all(words[k] <= 2 * sizes[k] for k in words)
    assert abs(sum(words.values()) - 1.5 * sum(sizes.values())) <= 3
    assert rows_of(after.select("doc_id")) == sorted([(k,) for k, _ in kept["mix_sources"]], key=repr)
    assert all(r.n_tokens == len(r.token_ids) > 0 for r in after.collect())


def test_pipeline_query_runs(spark):
    found = corpus_pipeline.run(spark, SF)
    assert found.count() > 0 and found.columns == ["doc_id", "n_tokens", "token_ids"]
