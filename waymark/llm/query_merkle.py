"""Query of the Merkle manifest, over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.merkle import lower_ascii, proof_digest, verify_rows
from waymark.llm.registry import query, table

#: Levels the SQL twin spells out: up to 16**5 rows a source, 16**2 sources.
_ROW_LEVELS, _SOURCE_LEVELS = 5, 2

_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda i: 0::BIGINT)),
      lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""


def _framed(text: str) -> str:
    fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(
        f"coalesce(strlen({f})::VARCHAR || ':' || {f}, '-')" for f in fields
    ) + ")"


def _sql() -> str:
    lower = f"translate(text, '{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'}', '{'abcdefghijklmnopqrstuvwxyz'}')"
    parts = [
        f"""WITH hashed AS (
  SELECT *, {_framed("text")} AS leaf,
    CASE WHEN ({_CRC}) % 5 = 0 THEN {_framed(lower)} ELSE {_framed("text")} END AS arrived
  FROM documents),
n0 AS (
  SELECT doc_id, source AS s, leaf, arrived, leaf AS d, arrived AS f, '' AS proof,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
  FROM hashed)"""
    ]

    def level(k: int, scope: str) -> None:
        """Hash runs of 16 distinct nodes within ``scope`` and lengthen each proof."""
        on = f"a.i = b.i AND {'a.s IS NOT DISTINCT FROM b.s' if scope else 'true'}"
        parts.append(
            f"""t{k} AS (SELECT DISTINCT {'s, ' if scope else ''}i, d FROM n{k}),
z{k} AS (SELECT {'s, ' if scope else ''}i, d, count(*) OVER ({scope}) AS size FROM t{k}),
g{k} AS (
  SELECT *, coalesce(string_agg(d, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(d, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM z{k}
  WINDOW run AS (PARTITION BY {'s, ' if scope else ''}i // 16 ORDER BY i)),
n{k + 1} AS (
  SELECT doc_id, a.s, leaf, arrived, a.i // 16 AS i,
    CASE WHEN size > 1 THEN sha256(l || a.d || r) ELSE a.d END AS d,
    CASE WHEN size > 1 THEN sha256(l || f || r) ELSE f END AS f,
    CASE WHEN size > 1 THEN proof || l || r ELSE proof END AS proof
    {', sub' if not scope else ''}
  FROM {f'n{k}' if scope else f'm{k}'} a JOIN g{k} b ON {on})"""
        )

    for k in range(_ROW_LEVELS):
        level(k, "PARTITION BY s")
    k = _ROW_LEVELS
    # From here on a node is numbered by its source.
    for _ in range(_SOURCE_LEVELS):
        if k == _ROW_LEVELS:
            parts.append(
                f"m{k} AS (SELECT * REPLACE (dense_rank() OVER (ORDER BY s NULLS FIRST) - 1 AS i), "
                f"d AS sub FROM n{k})"
            )
        else:
            parts.append(f"m{k} AS (SELECT * FROM n{k})")
        before = len(parts)
        level(k, "")
        parts[before] = parts[before].replace(f"FROM n{k}),\nz", f"FROM m{k}),\nz")
        k += 1
    return (
        ",\n".join(parts)
        + f"""
SELECT doc_id, leaf, sub AS subroot, d AS root, sha256(proof) AS proof_sha256,
  f AS folded_root, f = d AS verified
FROM n{k}"""
    )


@query(_sql())
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fifth = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    text = F.when(fifth, lower_ascii(F.col("text"))).otherwise(F.col("text"))
    proven = verify_rows(table(spark, sf_dir, "documents"), tampered=text)
    return proven.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        proof_digest(F.col("segments")).alias("proof_sha256"),
        "folded_root",
        "verified",
    )
