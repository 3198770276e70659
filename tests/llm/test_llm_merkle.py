import hashlib
from zlib import crc32

import pytest
from corpus import EDGES, documents, rows_of, with_clashes
from oracle import connect, differences
from pyspark.sql import functions as F

from waymark.llm.merkle import build_manifest, descend, folded, lower_ascii, proof_digest, verify_rows
from waymark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(nodes, proofs, members):
    """Hash runs of 16 and append siblings to the proofs of each node's members."""
    while len(nodes) > 1:
        above, holds = [], []
        for at in range(0, len(nodes), 16):
            run = nodes[at : at + 16]
            for k, node in enumerate(run):
                for m in members[at + k]:
                    proofs[m].append((run[:k], run[k + 1 :]))
            above.append(h(*run))
            holds.append([m for k in range(len(run)) for m in members[at + k]])
        nodes, members = above, holds
    return nodes[0], members[0]


def plain_proofs(rows):
    """rows of (doc_id, source, lang, n_chars, text); all ids distinct."""
    proofs = {r[0]: [] for r in rows}
    order = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    subroots, members, sub_of = [], [], {}
    for source in order:
        mine = sorted((r for r in rows if r[1] == source), key=lambda r: r[0])
        subroot, _ = climb([plain_leaf(r) for r in mine], proofs, [[r[0]] for r in mine])
        subroots.append(subroot)
        members.append([r[0] for r in mine])
        sub_of[source] = subroot
    root, _ = climb(subroots, proofs, members)
    out = []
    for r in rows:
        text = r[4]
        if crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        node = plain_leaf((*r[:4], text))
        for left, right in proofs[r[0]]:
            node = h(*left, node, *right)
        siblings = [x for left, right in proofs[r[0]] for x in left + right]
        out.append(
            (r[0], plain_leaf(r), sub_of[r[1]], root, h(*siblings), node, node == root)
        )
    return sorted(out, key=repr)


def table_of(spark, rows):
    return spark.createDataFrame(
        rows, "doc_id long, source string, lang string, n_chars long, text string"
    )


def queried(df):
    fifth = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    text = F.when(fifth, lower_ascii(F.col("text"))).otherwise(F.col("text"))
    return verify_rows(df, tampered=text).select(
        "doc_id", "leaf", "subroot", "root",
        proof_digest(F.col("segments")), "folded_root", "verified",
    )


def made(count, source_of):
    return [
        (k, source_of(k), "en" if k % 3 else None, k, None if k % 7 == 2 else f"Text Ä{k}")
        for k in range(count)
    ]


@pytest.mark.parametrize(
    "rows",
    [
        made(1, lambda k: "a"),
        made(2, lambda k: None),
        made(17, lambda k: "a"),
        made(40, lambda k: f"s{k}"),
        made(700, lambda k: [None, "big", "big", "big", "é", "z"][k % 6] if k % 50 else f"lone{k}"),
    ],
    ids=["one", "two", "run_of_one", "lone_leaves", "mixed"],
)
def test_proofs_equal_plain_code(spark, rows):
    assert rows_of(queried(table_of(spark, rows))) == plain_proofs(rows)


def test_query_agrees_with_sql(spark):
    name = "op11_merkle_manifest"
    assert differences(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) == ""


def test_some_requests_only(spark):
    rows = made(300, lambda k: "ab"[k % 2])
    manifest = build_manifest(table_of(spark, rows))
    some = manifest.leaves.filter("doc_id in (0, 7, 299)")
    found = descend(manifest, some)
    root = folded(F.col("found"), F.col("segments"))
    assert found.filter(F.col("leaf") == F.col("found")).select("doc_id", root).distinct().count() == 3
    assert {r[0] for r in found.select(root).collect()} == {manifest.root}


def test_edges(spark):
    df = documents(spark, [*EDGES, (None, None, None, None)]).withColumn("n_chars", F.lit(1))
    plain = rows_of(verify_rows(df))
    assert rows_of(verify_rows(with_clashes(df))) == plain
    assert len(plain) == len(EDGES) + 1 and all(r[-1] for r in plain)
    assert verify_rows(df.limit(0)).count() == 0
    # Equal rows are leaves of their own and change the root.
    once = verify_rows(df.dropDuplicates()).first()["root"]
    assert once != verify_rows(df).first()["root"]


def test_many_rows_of_one_id(spark):
    rows = [(4, "a", "en", 1, "same")] * 400 + [(5, "a", "en", 1, "other")]
    found = verify_rows(table_of(spark, rows)).collect()
    assert len(found) == 401 and all(r.verified for r in found)
