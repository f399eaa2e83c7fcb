"""The stored postings: rows as by scoring everything, with blocks left unread."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from taskweave.functions.text import words
from taskweave.operators import sparse_index as S


def by_hand(docs, queries, k, k1=1.2, b=0.75):
    terms = {i: (t or "").split() for i, t in docs}
    counts = {i: Counter(ts) for i, ts in terms.items()}
    df = Counter(t for c in counts.values() for t in c)
    n, average = len(docs), sum(map(len, terms.values())) / len(docs) or 1.0
    out = set()
    for q, text in queries:
        scored = []
        for i, c in counts.items():
            shared = [t for t in dict.fromkeys((text or "").split()) if t in c]
            if shared:
                idf = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for t in shared}
                score = sum(idf[t] * c[t] * (k1 + 1) / (c[t] + k1 * (1 - b + b * len(terms[i]) / average)) for t in shared)
                scored.append((-round(score, 6), i))
        out |= {(q, i, -s, r) for r, (s, i) in enumerate(sorted(scored)[:k], 1)}
    return out


def collection(seed, n):
    rng = random.Random(seed)
    common, rare = [f"c{i}" for i in range(8)], [f"r{i}" for i in range(400)]
    text = lambda: " ".join(rng.choices(common, k=rng.randint(0, 25)) + rng.choices(rare, k=rng.randint(0, 3)))
    docs = [(f"d{i:05d}", rng.choice([None, "", "c0 c1"] + [text()] * 12)) for i in range(n)]
    queries = [(i, " ".join(rng.choices(common, k=3) + rng.choices(rare, k=2))) for i in range(12)] + [(98, None), (99, "unheard of")]
    return docs, queries


def tables(spark, docs, queries, partitions=4):
    d = spark.createDataFrame(docs, "id string, text string").repartition(partitions)
    return d, spark.createDataFrame(queries, "query_id int, text string")


def rows(df):
    return {(r.query_id, r.id, r.score, r.rank) for r in df.collect()}


def close(got, want):
    assert {(q, i, r) for q, i, _, r in got} == {(q, i, r) for q, i, _, r in want}
    scores = {(q, i): s for q, i, s, _ in want}
    assert all(abs(s - scores[q, i]) < 2e-6 for q, i, s, _ in got)


@pytest.mark.parametrize("block, tokens, scores", [(1, 10**6, 10**6), (17, 10**6, 1), (50, 60, 10**6), (4096, 10**6, 10**6)])
def test_search_is_exact_whatever_the_blocks(spark, tmp_path, block, tokens, scores):
    docs, queries = collection(1, 400)
    d, q = tables(spark, docs, queries)
    index = S.write_index(d, str(tmp_path / "ix"), words, block=block, block_tokens=tokens)
    close(rows(S.search_index(index, q, 5, words, scores=scores)), by_hand(docs, queries, 5))


def test_stored_index_serves_other_parameters(spark, tmp_path):
    docs, queries = collection(2, 300)
    d, q = tables(spark, docs, queries)
    S.write_index(d, str(tmp_path / "ix"), words, block=30)
    index = S.read_index(spark, str(tmp_path / "ix"))
    for k, k1, b in ((1, 0.9, 0.4), (20, 2.0, 1.0), (400, 1.2, 0.0)):
        close(rows(S.search_index(index, q, k, words, k1=k1, b=b)), by_hand(docs, queries, k, k1, b))


def test_blocks_without_a_chance_are_not_scored(spark, tmp_path):
    rng = random.Random(3)
    plain = [(f"d{i:05d}", " ".join(rng.choices(["of", "the", "and"], k=20))) for i in range(3000)]
    docs = [(i, t + " needle " * 3 if n in (700, 701, 702, 2100) else t) for n, (i, t) in enumerate(plain)]
    queries = [(0, "the needle of")]
    d, q = tables(spark, docs, queries, 1)
    index = S.write_index(d.orderBy("id"), str(tmp_path / "ix"), words, block=100)
    bounds, weights, average = S.query_bounds(index, q, words, 1.2, 0.75)
    assert bounds.count() == 30
    close(rows(S.search_index(index, q, 3, words)), by_hand(docs, queries, 3))
    result = "query_id int, id string, score double"
    first = S._scored(index, S.most_promising(bounds, 3), weights, 3, 1.2, 0.75, average, 1, result)
    assert S.reaching(bounds, first, 3).count() <= 1  # of 29 other blocks


def test_postings_lie_by_term_and_split_by_block(spark, tmp_path):
    docs = [(f"d{i:03d}", "everywhere " * (1 + i % 3)) for i in range(200)]
    d, _ = tables(spark, docs, [], 2)
    index = S.write_index(d, str(tmp_path / "ix"), words, block=32)
    posted = index.postings.select("block", "term", F.size("docs").alias("n"), "max_tf", "min_len").collect()
    assert len(posted) == index.blocks.count() >= 7 and max(r.n for r in posted) <= 32 and sum(r.n for r in posted) == 200
    assert {r.max_tf for r in posted} == {3} and {r.min_len for r in posted} <= {1, 2}


def test_empty_collections(spark, tmp_path):
    d, q = tables(spark, [], [(0, "a")])
    assert S.search_index(S.write_index(d, str(tmp_path / "a"), words), q, 3, words).count() == 0
    d, _ = tables(spark, [("x", None), ("y", "")], [])
    assert S.search_index(S.write_index(d, str(tmp_path / "b"), words), q, 3, words).count() == 0
    d, none = tables(spark, [("x", "a")], [])
    assert S.search_index(S.write_index(d, str(tmp_path / "c"), words), none, 3, words).count() == 0
