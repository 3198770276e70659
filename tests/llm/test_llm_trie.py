"""Levels of the trie that lie in several files."""

import numpy as np

from waymark.llm.trie import NodeLevel, build_nodes


def test_weight_of_a_parent_that_begins_a_file(tmp_path):
    nodes = [(0, 5), (1, 2), (3, 7), (3, 9), (3, 12), (4, 1)]
    weights = {0: -0.5, 1: -0.25, 3: -2.0, 4: -1.0}
    for cut in range(1, len(nodes)):
        parts = []
        for begin, end in ((0, cut), (cut, len(nodes))):
            parents, children = np.array(nodes[begin:end]).T
            place = build_nodes(
                str(tmp_path), parents, children, np.ones(end - begin, np.int64),
                -1.0 - children, np.array([weights[k] for k in parents.tolist()]),
            )
            parts.append((*nodes[begin], begin, place))
        level = NodeLevel(parts, len(nodes))
        asked = [(p, c) for p in range(6) for c in range(14)]
        node, score, weight = level.find(*np.array(asked).T)
        for k, pair in enumerate(asked):
            assert node[k] == (nodes.index(pair) if pair in nodes else -1)
            assert np.isclose(weight[k], weights.get(pair[0], 0), atol=0.05)
            assert np.isclose(score[k], -1.0 - pair[1] if pair in nodes else 0, atol=0.05)


def test_packed_counts_round_trip():
    from waymark.llm.lm import pack, unpack

    rng = np.random.default_rng(1)
    for keys in ([], [0], [5], np.unique(rng.integers(0, 1 << 62, 999)), np.arange(300)):
        keys = np.array(keys, np.int64)
        counts = rng.integers(1, 70_000, len(keys))
        back = unpack(pack(keys, counts))
        assert (back[0] == keys).all() and (back[1] == counts).all()


def test_four_levels_in_shared_ranges(spark, monkeypatch):
    """Contexts with more tokens than a range are cut and weigh the same."""
    from waymark.llm import lm

    rows = [(k, " ".join("abcdefgh"[(k * j * j + j // 3) % 8] for j in range(60))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r.doc_id: r.score for r in lm.score_corpus(docs, (1, 1, 2)).collect()}
    shared = []
    counted = lm._counted
    monkeypatch.setattr(lm, "PART_ENTRIES", 40)
    monkeypatch.setattr(
        lm, "_counted", lambda *a: shared.append(len(a)) or counted(*a)
    )
    for row in lm.score_corpus(docs, (1, 1, 2)).collect():
        assert abs(row.score - whole[row.doc_id]) <= 0.02 * 61
    assert 4 in shared


def test_lookups_in_blocks_of_rare_bits():
    """A dense run of values must not make a look-up walk its words one by one."""
    from waymark.llm.eliasfano import EliasFano

    rng = np.random.default_rng(4)
    dense = np.arange(400_000)
    sparse = np.sort(rng.integers(1 << 20, 1 << 44, 2000))
    values = np.concatenate([dense, sparse])
    sequence = EliasFano(EliasFano.build(values))
    reads = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            reads.append(1)
            return np.asarray(self)[at]

    sequence.ones = sequence.ones.view(Counted)
    asked = np.concatenate([values[::97], sparse + 1, [-1, 1 << 50]])
    expected = {int(v): k for k, v in enumerate(values.tolist())}
    assert sequence.find(asked).tolist() == [expected.get(int(v), -1) for v in asked]
    assert len(reads) < 100
    at = np.arange(0, len(values) - 1, 89)
    first, after = sequence.value_and_next(at)
    assert (first == values[at]).all() and (after == values[at + 1]).all()


def test_pairs_beyond_one_key():
    """Parents and children whose product passes 63 bits keep their order and counts."""
    from waymark.llm.lm import _counts_of_pairs
    from waymark.llm.trie import distinct

    parent = np.array([1 << 40, 3, 1 << 40, 3, 1 << 40])
    child = np.array([1 << 30, 5, 2, 5, 1 << 30])
    found = [x.tolist() for x in _counts_of_pairs(parent, child)]
    assert found == [[3, 1 << 40, 1 << 40], [5, 2, 1 << 30], [2, 1, 2]]
    assert distinct(parent, child)[2].tolist() == [2, 0, 1, 0, 2]
