import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from taskweave.functions.text import words
from taskweave.operators import retrieval
from taskweave.operators.inference import encode, hashed_embedding, predict
from taskweave.operators.retrieval import bm25_top_k, dense_top_k, final_top_k, rescore, with_metadata
from taskweave.plans.model_retrieval import lower_tokens, retrieve_models

MODELS = [
    ("gpt2", "unidirectional autoregressive language model", "800000000", 100), ("t5-base", "text to text generator", "800000000", 10000),
    ("xlnet-base-cased", "bidirectional autoregressive language model", "1600000000", 100000),
]


@pytest.fixture
def models(spark):
    return spark.createDataFrame(MODELS, "name string, description string, size_bytes string, downloads bigint")


def vectors(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} string, embedding array<double>")


def test_one_hot_vectors(spark):
    corpus = vectors(spark, [(n, [0.9 if i == j else 0.0 for j in range(3)]) for i, n in enumerate("xyz")], "id")
    best = dense_top_k(vectors(spark, [("q", [0.0, 0.0, 1.0])], "query_id"), corpus, 1).collect()
    assert [(r["id"], r["score"], r["rank"]) for r in best] == [("z", 0.9, 1)]
    identity = vectors(spark, [(n, [float(i == j) for j in range(4)]) for i, n in enumerate("abcd")], "id")
    top = dense_top_k(vectors(spark, [("q", [0.0, 0.0, 1.0, 0.0])], "query_id"), identity, 3).orderBy("rank").collect()
    assert [r["id"] for r in top] == ["c", "a", "b"]
    assert dense_top_k(vectors(spark, [("q", [0.0, 0.0, 1.0, 0.0])], "query_id"), identity, 100).count() == 4


def brute(q, c, k):
    out = set()
    for i, row in enumerate(np.round(q @ c.T, 6) + 0.0):
        order = sorted(range(len(c)), key=lambda j: (-row[j], f"d{j:04d}"))[:k]
        out |= {(f"q{i:03d}", f"d{j:04d}", row[j], r + 1) for r, j in enumerate(order)}
    return out


@pytest.mark.parametrize("limit", [retrieval.QUERY_BYTES, 700])
def test_dense_search_is_exact_by_broadcast_and_by_blocks(spark, monkeypatch, limit):
    monkeypatch.setattr(retrieval, "_BLOCK", 16)
    rnd = np.random.default_rng(3)
    q, c = rnd.integers(-2, 3, (23, 5)).astype(float), rnd.integers(-2, 3, (900, 5)).astype(float)  # many ties
    queries = vectors(spark, [(f"q{i:03d}", v.tolist()) for i, v in enumerate(q)], "query_id").repartition(3)
    corpus = vectors(spark, [(f"d{i:04d}", v.tolist()) for i, v in enumerate(c)], "id").repartition(5)
    got = {tuple(r) for r in dense_top_k(queries, corpus, 7, broadcast_limit=limit).collect()}
    assert got == brute(q, c, 7)


def test_bm25_returns_only_documents_that_share_a_term(spark, models):
    docs = models.select(F.col("name").alias("id"), F.col("description").alias("text"))
    queries = spark.createDataFrame([(0, "text generator"), (1, "nothing shared here")], "query_id int, text string")
    assert [(r["query_id"], r["id"]) for r in bm25_top_k(queries, docs, 10, lower_tokens).collect()] == [(0, "t5-base")]


@pytest.mark.parametrize("cells", [retrieval.WEIGHT_CELLS, 0])
def test_bm25_scores(spark, monkeypatch, cells):
    """Scored in the tasks, two documents at a time, and by join."""
    monkeypatch.setattr(retrieval, "_TF_CELLS", 6)
    docs = ["a b b c", "a a", "c d e f g h", "b", ""]
    queries = ["b a", "c c z", "q"]
    df = {t: sum(t in d.split() for d in docs) for t in "abcdefgh"}
    n, avg = len(docs), sum(len(d.split()) for d in docs) / len(docs)
    expected = {}
    for qi, q in enumerate(queries):
        for di, d in enumerate(docs):
            ts = d.split()
            shared = [t for t in dict.fromkeys(q.split()) if t in ts]
            if shared:
                idf = lambda t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                expected[qi, di] = sum(
                    idf(t) * ts.count(t) * 2.2 / (ts.count(t) + 1.2 * (0.25 + 0.75 * len(ts) / avg)) for t in shared
                )
    q = spark.createDataFrame(list(enumerate(queries)), "query_id int, text string")
    d = spark.createDataFrame(list(enumerate(docs)), "id int, text string").repartition(3)
    got = {(r["query_id"], r["id"]): r["score"] for r in bm25_top_k(q, d, 10, words, weight_cells=cells).collect()}
    assert got.keys() == expected.keys()
    assert all(abs(got[k] - expected[k]) < 2e-6 for k in got)


def test_rescoring_and_size_limit(spark, models):
    found = spark.createDataFrame([(m[0], 1.0) for m in MODELS], "name string, score double")
    ranked = with_metadata(found, models.withColumn("size_bytes", F.col("size_bytes").cast("bigint")))
    got = {r["name"]: r["score"] for r in rescore(ranked, 10**9).collect()}
    assert got == pytest.approx({"gpt2": math.log10(102), "t5-base": math.log10(10002)})
    kept = {r["name"]: r["score"] for r in rescore(ranked, 10**9, keep_oversize=True).collect()}
    assert kept["xlnet-base-cased"] == float("-inf") and len(kept) == 3
    assert [r["name"] for r in final_top_k(rescore(ranked, 10**10), 2).collect()] == ["xlnet-base-cased", "t5-base"]


def test_model_retrieval_sparse_dense_and_expanded(spark, models):
    queries = spark.createDataFrame([(0, "text generator")], "query_id int, text string")
    sparse = retrieve_models(queries, models, 10**10).collect()
    assert [(r["query_id"], r["rank"], r["name"]) for r in sparse] == [(0, 1, "t5-base")]
    dense = retrieve_models(queries, models, 10**10, encoder=hashed_embedding).collect()
    assert dense[0]["name"] == "t5-base" and len(dense) == 3
    imagine = lambda: lambda prompt, n, temperature, max_tokens: ["a bidirectional model"]
    expanded = retrieve_models(queries, models, 10**10, expand_with=imagine).collect()
    assert expanded[0]["name"] == "xlnet-base-cased"


def test_hashed_embedding(spark):
    df = spark.createDataFrame([("a b a",), ("",), ("A B a",)], "text string")
    rows = [np.array(r[0]) for r in df.select(hashed_embedding(F.col("text"), 16)).collect()]
    assert rows[0] == pytest.approx(rows[2]) and np.linalg.norm(rows[0]) == pytest.approx(1) and not rows[1].any()
    cut = df.select(hashed_embedding(F.lit("a b c d"), 16, 1), hashed_embedding(F.lit("a"), 16)).first()
    assert cut[0] == cut[1]


def test_predict_and_encode_in_batches(spark):
    def load():
        def model(texts):
            assert 0 < len(texts) <= 10
            return [t + "!" for t in texts]

        return model

    df = spark.range(57).select(F.col("id").cast("string").alias("model_input")).repartition(3)
    got = predict(df, load).collect()
    assert all(r["prediction"]["prediction"] == r["model_input"] + "!" and r["prediction"]["aux"] == {"input_text": r["model_input"]} for r in got)
    assert len(got) == 57
    shapes = encode(df.withColumnRenamed("model_input", "text"), lambda: lambda ts: np.array([[len(t), 1.0] for t in ts])).collect()
    assert all(r["embedding"] == [len(r["text"]), 1.0] for r in shapes)
