"""Search: dense, sparse, with metadata, with popularity."""

from __future__ import annotations

from pyspark.sql import functions as F

from taskweave.operators.inference import hashed_embedding
from taskweave.operators.positions import head_per_group
from taskweave.operators.retrieval import bm25_top_k, dense_top_k, rescore, with_metadata
from taskweave.operators.vector_index import temporary_vector_index
from taskweave.plans.model_retrieval import lower_tokens, retrieve_models
from taskweave.queries.registry import query, sql_draw, sql_tokens, spread_table, table

_DOT = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


_NEAREST = f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round({_DOT}, 6) AS score FROM embeddings a CROSS JOIN embeddings b),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, id, score, rank::INTEGER AS rank FROM r WHERE rank <= 10"""


@query(_NEAREST)
def dense_topk_per_query(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return dense_top_k(vectors.withColumnRenamed("vec_id", "query_id"), vectors.withColumnRenamed("vec_id", "id"), 10)


@query(_NEAREST)
def dense_topk_indexed(spark, sf_dir):
    """The same rows through a stored index of four cells."""
    vectors = table(spark, sf_dir, "embeddings")
    index = temporary_vector_index(vectors.withColumnRenamed("vec_id", "id"), cells=4)
    return dense_top_k(vectors.withColumnRenamed("vec_id", "query_id"), index, 10)


@query(f"""WITH q AS (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label),
s AS (SELECT q.label AS query_id, b.vec_id AS id, round({_DOT}, 6) AS score FROM q JOIN embeddings a ON a.vec_id = q.vec_id CROSS JOIN embeddings b),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS first_rank FROM s),
m AS (SELECT query_id, id AS name, score, d.lang, d.source FROM r JOIN documents d ON d.doc_id = r.id WHERE first_rank <= 1000),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name) AS rank FROM m)
SELECT * REPLACE (rank::INTEGER AS rank) FROM f WHERE rank <= 25""")
def dense_retrieve_join(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.groupBy(F.col("label").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("embedding"))
    found = dense_top_k(queries, vectors.withColumnRenamed("vec_id", "id"), 1000)
    catalog = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), "lang", "source")
    ranked = with_metadata(found.select("query_id", F.col("id").alias("name"), "score"), catalog)
    return head_per_group(ranked, ["query_id"], [F.desc("score"), F.asc("name")], 25, rank="rank")


def _bm25(query_sql: str, doc_sql: str) -> str:
    """``query_sql``: (query_id, text); ``doc_sql``: (id, text)."""
    return f"""q AS (SELECT DISTINCT query_id, unnest({sql_tokens('lower(text)')}) AS term FROM ({query_sql})),
t AS (SELECT id, {sql_tokens('lower(text)')} AS terms FROM ({doc_sql})),
st AS (SELECT count(*) AS n, avg(len(terms)) AS avgl FROM t),
x AS (SELECT id, len(terms) AS dl, unnest(terms) AS term FROM t),
tf AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM x WHERE term IN (SELECT term FROM q) GROUP BY id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT q.query_id, q.term, ln(1 + (st.n - df.df + 0.5::DOUBLE) / (df.df + 0.5::DOUBLE)) AS idf FROM q JOIN df ON q.term = df.term CROSS JOIN st),
sc AS (SELECT w.query_id, tf.id, round(sum(w.idf * tf.tf * 2.2::DOUBLE / (tf.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * tf.dl / st.avgl))), 6) AS score
  FROM tf JOIN w ON tf.term = w.term CROSS JOIN st GROUP BY w.query_id, tf.id)"""


@query(f"""WITH {_bm25('SELECT item_id AS query_id, text FROM benchmark', 'SELECT doc_id AS id, text FROM documents')},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc)
SELECT query_id, id, score, rank::INTEGER AS rank FROM r WHERE rank <= 10""")
def bm25_topk(spark, sf_dir):
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    docs = spread_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return bm25_top_k(queries, docs, 10, lower_tokens)


_SIZE = 64


def sql_embedding(rows: str) -> str:
    """Long form (id, slot, weight) of the stand-in encoder over ``rows``: (id, text)."""
    return f"""(SELECT id, slot, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS weight FROM (
  SELECT id, slot, count(*)::DOUBLE AS n FROM (
    SELECT id, {sql_draw(str(_SIZE), 'slot', 't')} AS slot FROM (SELECT id, unnest({sql_tokens('lower(text)')}) AS t FROM ({rows})))
  GROUP BY id, slot))"""


@query(f"SELECT id AS doc_id, slot::INTEGER AS slot, round(weight, 6) AS weight FROM {sql_embedding('SELECT doc_id AS id, text FROM documents')}")
def encode_texts(spark, sf_dir):
    docs = spread_table(spark, sf_dir, "documents")
    vectors = docs.select("doc_id", hashed_embedding(F.col("text"), _SIZE).alias("embedding"))
    # the outer form: of a plain explode the optimizer infers a filter that would run the encoder again
    long = vectors.select("doc_id", F.posexplode_outer("embedding").alias("slot", "weight")).where(F.col("weight") > 0)
    return long.select("doc_id", "slot", F.round("weight", 6).alias("weight"))


@query(f"""WITH d AS (SELECT * FROM {sql_embedding('SELECT doc_id AS id, text FROM documents')}),
b AS (SELECT * FROM {sql_embedding('SELECT item_id AS id, text FROM benchmark')}),
s AS (SELECT b.id AS query_id, d.id, round(sum(b.weight * d.weight), 6) AS score FROM b JOIN d ON b.slot = d.slot GROUP BY b.id, d.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, id, score, rank::INTEGER AS rank FROM r WHERE rank <= 25""")
def text_search(spark, sf_dir):
    embed = lambda df, key, name: df.select(F.col(key).alias(name), hashed_embedding(F.col("text"), _SIZE).alias("embedding"))
    queries = embed(table(spark, sf_dir, "benchmark"), "item_id", "query_id")
    return dense_top_k(queries, embed(spread_table(spark, sf_dir, "documents"), "doc_id", "id"), 25)


_SIZE_LIMIT = 4_000_000_000


def _part_models(spark, sf_dir):
    sold = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("downloads"))
    parts = table(spark, sf_dir, "part").join(sold, "p_partkey", "left")
    return parts.select(
        F.format_string("%s/%06d", "p_brand", "p_partkey").alias("name"), F.concat_ws(" ", "p_name", "p_type").alias("description"),
        (F.col("p_size") * F.lit(100_000_000).cast("bigint")).cast("string").alias("size_bytes"), "downloads",
    )


_MODELS = """m AS (SELECT p_brand || '/' || printf('%06d', p_partkey) AS name, p_name || ' ' || p_type AS description,
  p_size * 100000000::BIGINT AS size_bytes, coalesce(s.n, 0) AS downloads FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) s ON l_partkey = p_partkey)"""


@query(f"""WITH {_MODELS}, {_bm25("SELECT p_brand AS query_id, min(p_name) AS text FROM part GROUP BY p_brand", "SELECT name AS id, description AS text FROM m")},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS first_rank FROM sc),
p AS (SELECT query_id, m.name, round(r.score * log10(m.downloads + 2), 6) AS score FROM r JOIN m ON m.name = r.id WHERE first_rank <= 1000 AND m.size_bytes <= {_SIZE_LIMIT}),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, name, score FROM f WHERE rank <= 5""")
def model_retrieval(spark, sf_dir):
    queries = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("query_id")).agg(F.min("p_name").alias("text"))
    return retrieve_models(queries, _part_models(spark, sf_dir), _SIZE_LIMIT)


@query(f"""WITH {_MODELS}, p AS (SELECT p_brand || '/' || printf('%06d', p_partkey) AS name, 1.0::DOUBLE / (1 + p_retailprice) AS s FROM part)
SELECT name, round(s * log10(downloads + 2), 9) AS score FROM m JOIN p USING (name) WHERE size_bytes <= {_SIZE_LIMIT}
ORDER BY score DESC, name LIMIT 25""")
def popularity_rescore(spark, sf_dir):
    found = table(spark, sf_dir, "part").select(
        F.format_string("%s/%06d", "p_brand", "p_partkey").alias("name"), (1.0 / (1 + F.col("p_retailprice"))).alias("score")
    )
    models = _part_models(spark, sf_dir).withColumn("size_bytes", F.col("size_bytes").cast("bigint"))
    scored = rescore(with_metadata(found, models), _SIZE_LIMIT).withColumn("score", F.round("score", 9))
    return scored.orderBy(F.desc("score"), "name").limit(25).select("name", "score")
