"""The language model of the query: words, pairs and triples, all that occur."""

import math
import zlib
from collections import Counter

from waymark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def test_query_knows_triples_and_what_occurs_once(spark):
    from test_llm_models import WORD

    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    texts = {r.doc_id: [*WORD.findall((r.text or "").translate(LOWER)), None] for r in rows}
    training = [t for k, t in texts.items() if zlib.crc32(str(k).encode()) % 7 != 2]
    assert len(texts) == len(rows)
    grams = [Counter(), Counter(), Counter()]
    for t in training:
        grams[0].update((w,) for w in t)
        grams[1].update(zip(["<s>", *t], t))
        grams[2].update(zip(["<s>", *t], t, t[1:]))
    kinds = Counter(g[:-1] for level in grams[1:] for g in level)
    size = sum(grams[0].values()) + len(grams[0]) + 1

    def chance(gram):
        if len(gram) == 1:
            return (grams[0][gram] + 1) / size
        shorter, context = chance(gram[1:]), gram[:-1]
        if context not in kinds:
            return shorter
        held = len(training) if context == ("<s>",) else grams[len(context) - 1][context]
        own = max(grams[len(gram) - 1][gram] - 0.75, 0) / held
        left = 1 - (sum_of[context] - 0.75 * kinds[context]) / held
        return own + max(left, 1e-9) * shorter

    sum_of = Counter()
    for level in grams[1:]:
        for gram, n in level.items():
            sum_of[gram[:-1]] += n
    for row in QUERIES["op10_lm_score"](spark, SF).collect():
        begun = ["<s>", *texts[row.doc_id]]
        grams_of = [tuple(begun[max(0, j - 2) : j + 1]) for j in range(1, len(begun))]
        expected = sum(math.log10(chance(g)) for g in grams_of)
        assert abs(row.score - expected) <= 0.02 * row.n_tokens
