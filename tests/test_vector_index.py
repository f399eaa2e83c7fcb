"""The stored vectors: rows as by multiplying everything, with files left unread."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from taskweave.contracts import TaskSpec
from taskweave.operators import vector_index as V
from taskweave.operators.inference import hashed_embedding
from taskweave.operators.retrieval import dense_top_k
from taskweave.operators.sparse_index import write_index
from taskweave.plans.dataset_retrieval import search_datasets
from taskweave.plans.model_retrieval import lower_tokens, retrieve_models


def brute(queries, corpus, k):
    out = set()
    for name, q in queries:
        scored = sorted((-round(float(np.dot(q, v)), 6) + 0.0, i) for i, v in corpus)
        out |= {(name, i, -s + 0.0, r) for r, (s, i) in enumerate(scored[:k], 1)}
    return out


def tables(spark, queries, corpus, partitions=4):
    q = spark.createDataFrame([(n, v.tolist()) for n, v in queries], "query_id int, embedding array<double>").repartition(2)
    c = spark.createDataFrame([(i, v.tolist()) for i, v in corpus], "id string, embedding array<double>").repartition(partitions)
    return q, c


def rows(df):
    return {(r.query_id, r.id, r.score, r.rank) for r in df.collect()}


def clustered(seed, n, dim, spread, centres=12):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim)) * 5
    corpus = [(f"v{i:05d}", np.round(middle[i % centres] + rng.normal(size=dim) * spread, 3)) for i in range(n)]
    queries = [(i, np.round(middle[i % centres] + rng.normal(size=dim) * spread, 3)) for i in range(9)]
    return queries, corpus


@pytest.mark.parametrize("cells, pack, query_bytes, k", [(1, 7, 1 << 20, 5), (13, 16, 1 << 20, 1), (40, 64, 200, 9), (None, 1024, 1 << 20, 700)])
def test_search_is_exact_whatever_the_cells(spark, tmp_path, cells, pack, query_bytes, k):
    for queries, corpus in (clustered(1, 600, 6, 0.5), clustered(2, 300, 3, 9.0)):
        # ties: whole numbers, repeated and zero vectors
        corpus += [(f"t{i}", np.array(v)) for i, v in enumerate([corpus[0][1]] * 4 + [np.zeros(len(corpus[0][1]))] * 3)]
        q, c = tables(spark, queries, corpus)
        index = V.write_vector_index(c, str(tmp_path / f"ix{len(corpus)}"), cells=cells, pack=pack)
        assert rows(V.search_vectors(index, q, k, query_bytes)) == brute(queries, corpus, k)
        assert rows(V.scan(q, c, k, query_bytes, pack)) == brute(queries, corpus, k)


def test_files_that_cannot_hold_a_result_are_not_opened(spark, tmp_path, monkeypatch):
    queries, corpus = clustered(3, 2400, 8, 0.2, centres=40)
    q, c = tables(spark, queries[:2], corpus)
    index = V.write_vector_index(c, str(tmp_path / "ix"), cells=120, pack=32)
    opened, open_ = set(), V._open

    def seen(index, wanted, *rest, **more):
        opened.update(r["cell"] for r in wanted.select("cell").distinct().collect())
        return open_(index, wanted, *rest, **more)

    monkeypatch.setattr(V, "_open", seen)
    assert rows(V.search_vectors(index, q, 10)) == brute(queries[:2], corpus, 10)
    files = {f: int(f.parent.name.removeprefix("cell=")) for f in (tmp_path / "ix" / "packs").glob("cell=*/*.parquet")}
    skipped = [f for f, cell in files.items() if cell not in opened]
    assert len(files) >= 100 and len(skipped) > 0.6 * len(files)
    for f in skipped:  # reading one of them would fail now
        f.write_bytes(b"no parquet")
    assert rows(V.search_vectors(V.read_vector_index(spark, str(tmp_path / "ix")), q, 10)) == brute(queries[:2], corpus, 10)


def test_a_crowded_cell_is_many_files_tasks_wide(spark, tmp_path):
    same = [(f"s{i:05d}", np.array([1.0, 2.0])) for i in range(3000)]
    q, c = tables(spark, [(0, np.array([1.0, 0.0]))], same + [("far", np.array([9.0, 9.0]))])
    index = V.write_vector_index(c, str(tmp_path / "ix"), cells=4, pack=100)
    assert max(r.n for r in index.packs.select(F.size("ids").alias("n")).collect()) <= 100
    assert rows(V.search_vectors(index, q, 2)) == {(0, "far", 9.0, 1), (0, "s00000", 1.0, 2)}


def test_missing_vectors_and_empty_tables(spark, tmp_path):
    q, c = tables(spark, [(0, np.array([1.0, 0.0]))], [("a", np.array([1.0, 1.0]))])
    holes = c.unionByName(spark.createDataFrame([("none", None)], c.schema))
    asked = q.unionByName(spark.createDataFrame([(7, None)], q.schema))
    index = V.write_vector_index(holes, str(tmp_path / "a"))
    assert rows(V.search_vectors(index, asked, 3)) == rows(V.scan(asked, holes, 3)) == {(0, "a", 1.0, 1)}
    nothing = V.write_vector_index(c.limit(0), str(tmp_path / "b"))
    assert V.search_vectors(nothing, q, 3).count() == 0 == V.scan(q, c.limit(0), 3).count()
    assert V.search_vectors(index, q.limit(0), 3).count() == 0 == V.scan(q.limit(0), c, 3).count()


def test_jobs_read_stored_indexes(spark, tmp_path):
    words = ["red", "green", "blue", "deep", "wide", "tall"]
    rows_ = [(f"m{i:02d}", " ".join(words[j] for j in range(6) if i >> j & 1), "1000", i) for i in range(1, 64)]
    models = spark.createDataFrame(rows_, "name string, description string, size_bytes string, downloads bigint")
    queries = spark.createDataFrame([(0, "red tall"), (1, "blue")], "query_id int, text string")
    texts = models.select(F.col("name").alias("id"), F.col("description").alias("text"))
    coded = texts.select("id", hashed_embedding(F.col("text")).alias("embedding"))
    sparse = write_index(texts, str(tmp_path / "sparse"), lower_tokens, block=8)
    dense = V.write_vector_index(coded, str(tmp_path / "dense"))
    found = lambda **k: sorted(tuple(r) for r in retrieve_models(queries, models, 10**6, **k).collect())
    assert found(index=sparse) == found()
    assert found(index=dense, encoder=hashed_embedding) == found(encoder=hashed_embedding)
    with pytest.raises(ValueError):
        found(index=dense)
    spec = TaskSpec("deep blue texts")
    tasks = spark.createDataFrame([(0, spec.instruction, "")], "task_id int, instruction string, examples string")
    datasets = models.select("name", "description")
    plain = search_datasets(tasks, datasets, hashed_embedding, depth=9).collect()
    for vectors in (coded, dense):
        assert search_datasets(tasks, datasets, hashed_embedding, depth=9, vectors=vectors).collect() == plain
    assert dense_top_k(coded.limit(3).withColumnRenamed("id", "query_id"), dense, 2).count() == 6


def test_scores_are_made_in_slices(spark, monkeypatch):
    queries, corpus = [(i, np.array([i % 97, 1.0])) for i in range(6000)], [(f"v{i:04d}", np.array([1.0, i])) for i in range(700)]
    q, c = tables(spark, queries, corpus, 1)
    whole = V.candidates

    def small(scores, *rest):
        if scores.size > 2_000_000:
            raise MemoryError(scores.shape)
        return whole(scores, *rest)

    monkeypatch.setattr(V, "candidates", small)
    assert {(r.query_id, r.id, r.score) for r in V.scan(q, c, 1).collect()} == {(i, "v0699", i % 97 + 699.0) for i in range(6000)}


def test_candidates_of_a_cell_do_not_grow_with_its_packs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "_KEPT", 600)
    _, corpus = clustered(4, 500, 4, 0.5)
    queries = [(i, v) for i, (_, v) in enumerate(corpus[:400])]
    q, c = tables(spark, queries, corpus)
    index = V.write_vector_index(c, str(tmp_path / "ix"), cells=1, pack=10)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        first, rest = V.search_parts(index, q, 5, 48 * 50)  # eight blocks of about fifty queries
        assert first.count() + rest.count() <= 400 * 5 * 2
        assert rows(V.best(first.unionByName(rest), 5)) == brute(queries, corpus, 5)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
