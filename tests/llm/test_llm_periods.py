import hashlib
import random
from zlib import crc32

import numpy as np
import pytest
from corpus import documents, rows_of, with_clashes

from waymark.llm.convolution import PRIMES, agreeing, restored, transform
from waymark.llm.periods import collapsed, periodic_runs, run_digests, runs_of
from waymark.llm.queries import QUERIES
from waymark.llm.words import span_hashes

SF = "/root/testdata/sf0.001"


def plain_runs(words, repeats=4, least=6):
    """All stretches by every period, the smallest of equal ones."""
    n, found = len(words), {}
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, repeats * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(60))
def test_runs_equal_plain_code(seed):
    rng = random.Random(seed)
    words = []
    while len(words) < rng.choice([5, 40, 200, 500]):
        unit = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(1, 30))]
        words += unit * rng.randrange(1, 9) + unit[: rng.randrange(len(unit))]
    found = runs_of(np.array(words, np.uint64))
    assert [tuple(r) for r in found.tolist()] == plain_runs(words)


def test_transform_and_back():
    rng = np.random.default_rng(5)
    for prime, generator in PRIMES:
        for size in (1, 2, 8, 64):
            rows = rng.integers(0, prime, (3, size)).astype(np.uint64)
            assert (restored(transform(rows, prime, generator), prime, generator) == rows).all()


def test_blocks_agree_only_where_equal():
    rng = np.random.default_rng(6)
    for b in (1, 2, 8, 32):
        for most in (3, 1 << 29):
            blocks = rng.integers(1, most, (20, b))
            windows = rng.integers(1, most, (20, 2 * b))
            for k in range(20):
                at = int(rng.integers(0, b))
                windows[k, at : at + b] = blocks[k]
            found = agreeing(blocks, windows)
            for k in range(20):
                for d in range(b):
                    assert found[k, d] == (windows[k, d : d + b] == blocks[k]).all()


def plain_row(doc_id, text):
    words = [w for w in __import__("re").findall("[^\x20\x09-\x0d]+", text or "")]
    n, h = len(words), crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words) if n < 3000 else None
    if runs is None:
        return None
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    listed = "".join("%d,%d,%d\n" % r for r in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    return (
        doc_id,
        len(runs),
        *best,
        1000 * best[1] // best[2] if runs else None,
        hashlib.sha256(listed.encode()).hexdigest(),
        hashlib.sha256(kept.encode()).hexdigest(),
    )


def test_query_equals_plain_code(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: tuple(r) for r in QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert len(found) == len(docs)
    compared = [plain_row(*row) for row in docs]
    assert sum(r is not None and r[1] > 0 for r in compared) > 10
    assert all(found[r[0]] == r for r in compared if r is not None)


def test_edges(spark):
    df = documents(spark)
    plain = rows_of(run_digests(periodic_runs(df)))
    assert rows_of(run_digests(periodic_runs(with_clashes(df)))) == plain
    by_id = {r[0]: r for r in plain}
    assert by_id[5][1:6] == (1, 0, 6000, 2, 3_000_000)
    assert by_id[1][1:6] == (0, None, None, None, None) and by_id[1][6:] == by_id[2][6:]
    assert len(plain) == 8
    assert run_digests(periodic_runs(df.limit(0))).count() == 0


def test_long_text_in_parts():
    words = np.tile(np.arange(1, 30_001, dtype=np.uint64), 5)
    assert runs_of(words).tolist() == [[0, 150_000, 30_000]]
    assert collapsed(150_000, runs_of(words)).sum() == 30_000


def test_hash_tells_complementary_words_apart():
    """Sums over powers of an odd base agree on these."""
    for power in (10, 11):
        bits = [bin(k).count("1") & 1 for k in range(1 << power)]
        a = bytes(97 + b for b in bits)
        data = np.frombuffer(a + bytes(98 - b for b in bits), np.uint8)
        n = 1 << power
        x, y = span_hashes(data, np.array([0, n]), np.array([n, 2 * n]))
        assert x != y
    short = np.frombuffer(b"abcdefghijabcdefghik", np.uint8)
    x, y, z = span_hashes(short, np.array([0, 10, 0]), np.array([9, 19, 10]))
    assert x == y != z
