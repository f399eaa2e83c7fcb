"""Scoring predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from taskweave.operators.metrics import chrf, containment_accuracy, detach_echo, evaluate, exact_match, greedy_match, pair_with_references
from taskweave.operators.sampling import sample_rows
from taskweave.queries.registry import SPACE_CLASS, TURN_PAIRS, lit, query, sql_mark, sql_strip, sql_words, spread_table, table, turn_pairs

# predictions: some repeat the input, some are the reference, some are cut
_PREDICTED = f"""{TURN_PAIRS}, p AS (SELECT conv_id * 1000 + turn AS row_id, conv_id, turn, input_col AS model_input, output_col AS reference,
  CASE conv_id % 3 WHEN 0 THEN input_col || ' ' || output_col WHEN 1 THEN output_col ELSE left(output_col, 25) END AS prediction FROM turn_pairs),
e AS (SELECT row_id, conv_id, turn, model_input, reference,
  CASE WHEN contains(prediction, model_input) AND NOT contains(reference, model_input) THEN replace(prediction, model_input, '') ELSE prediction END AS prediction, prediction AS raw FROM p)"""


def _predictions(spark, sf_dir):
    pairs = turn_pairs(spark, sf_dir).withColumn("row_id", F.col("conv_id") * 1000 + F.col("turn"))
    said = (
        F.when(F.col("conv_id") % 3 == 0, F.concat_ws(" ", "input_col", "output_col"))
        .when(F.col("conv_id") % 3 == 1, F.col("output_col")).otherwise(F.left("output_col", F.lit(25)))
    )
    predictions = pairs.select("row_id", said.alias("prediction"))
    references = pairs.select("row_id", "conv_id", "turn", F.col("input_col").alias("model_input"), F.col("output_col").alias("reference"))
    return pair_with_references(predictions, references)


@query(f"WITH {_PREDICTED} SELECT row_id, prediction FROM e", name="detach_echo")
def detached(spark, sf_dir):
    cleaned = detach_echo(F.col("prediction"), F.col("model_input"), F.col("reference"))
    return _predictions(spark, sf_dir).select("row_id", cleaned.alias("prediction"))


@query(f"WITH {_PREDICTED} SELECT turn, avg((raw = reference)::INTEGER::DOUBLE) AS value FROM e GROUP BY turn", name="exact_match")
def exact_match_by_turn(spark, sf_dir):
    return exact_match(_predictions(spark, sf_dir), by=["turn"])


@query(f"""WITH {_PREDICTED}, s AS (SELECT * FROM e ORDER BY {sql_mark(42, 'row_id')}, row_id LIMIT 100)
SELECT avg(contains({sql_strip("lower(replace(raw, model_input, ''))")}, {sql_strip('lower(reference)')})::INTEGER::DOUBLE) AS value FROM s""", name="containment_accuracy")
def containment_of_sample(spark, sf_dir):
    return containment_accuracy(sample_rows(_predictions(spark, sf_dir), ["row_id"], 100, 42))


_MARK = lit(r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]""")


def _sql_chrf(rows: str) -> str:
    """CTEs ending in ``chrf`` (g, value) over ``rows``: (rid, g, p, r)."""
    piece = (
        f"CASE WHEN length(w) = 1 THEN [w] WHEN regexp_matches(right(w, 1), {_MARK}) THEN [left(w, length(w) - 1), right(w, 1)] "
        f"WHEN regexp_matches(left(w, 1), {_MARK}) THEN [left(w, 1), right(w, length(w) - 1)] ELSE [w] END"
    )
    chars = ", ".join(
        "{'n': %d, 'gram': %s}" % (n, " || ".join(["c", *[f"lead(c, {i}) OVER o" for i in range(1, n)]])) for n in range(1, 7)
    )
    return f"""sides AS (SELECT rid, g, 0 AS side, p AS t FROM ({rows}) UNION ALL SELECT rid, g, 1, r FROM ({rows})),
cs AS (SELECT rid, g, side, string_split(regexp_replace(t, {lit(SPACE_CLASS + '+')}, '', 'g'), '') AS l FROM sides),
ch AS (SELECT rid, g, side, unnest(l) AS c, generate_subscripts(l, 1) AS i FROM cs),
cg AS (SELECT rid, g, side, unnest([{chars}]) AS x FROM ch WHERE c <> '' WINDOW o AS (PARTITION BY rid, side ORDER BY i)),
ws AS (SELECT rid, g, side, flatten(list_transform({sql_words('t')}, lambda w: {piece})) AS l FROM sides),
wd AS (SELECT rid, g, side, unnest(l) AS c, generate_subscripts(l, 1) AS i FROM ws),
wg AS (SELECT rid, g, side, unnest([{{'n': 7, 'gram': c}}, {{'n': 8, 'gram': c || ' ' || lead(c, 1) OVER o}}]) AS x FROM wd WINDOW o AS (PARTITION BY rid, side ORDER BY i)),
gr AS (SELECT rid, g, x.n AS n, x.gram AS gram, count(*) FILTER (side = 0) AS h, count(*) FILTER (side = 1) AS r
  FROM (SELECT * FROM cg UNION ALL SELECT * FROM wg) WHERE x.gram IS NOT NULL GROUP BY 1, 2, 3, 4),
pr AS (SELECT rid, g, n, sum(least(h, r)) AS m, sum(h) AS h, sum(r) AS r FROM gr GROUP BY 1, 2, 3),
tt AS (SELECT g, n, sum(m)::DOUBLE AS m, sum(CASE WHEN r > 0 THEN h ELSE 0 END) AS h, sum(r) AS r FROM pr GROUP BY 1, 2),
av AS (SELECT g, avg(m / h) AS p, avg(m / r) AS r FROM tt WHERE h > 0 AND r > 0 GROUP BY g),
chrf AS (SELECT g, coalesce(500 * p * r / nullif(4 * p + r, 0), 0) AS value FROM av)"""


@query(f"""WITH {_sql_chrf("SELECT doc_id AS rid, lang AS g, lower(text) AS p, text AS r FROM documents")}
SELECT g AS lang, round(value, 4) AS value FROM chrf""")
def chrf_pp(spark, sf_dir):
    docs = spread_table(spark, sf_dir, "documents").select("lang", F.lower("text").alias("prediction"), F.col("text").alias("reference"))
    return chrf(docs, by=["lang"]).select("lang", F.round("value", 4).alias("value"))


@query(f"""WITH {_PREDICTED}, {_sql_chrf("SELECT row_id AS rid, 0 AS g, prediction AS p, reference AS r FROM e")}
SELECT 'chr_f++' AS metric, round(value, 4) AS value FROM chrf
UNION ALL SELECT 'exact_match', round(avg((prediction = reference)::INTEGER::DOUBLE), 4) FROM e""")
def evaluation_report(spark, sf_dir):
    report = evaluate(_predictions(spark, sf_dir), ["chr_f", "exact_match"], model_input="model_input")
    return report.select("metric", F.round("value", 4).alias("value"))


@query("""WITH t AS (SELECT vec_id // 10 AS pair_id, vec_id % 2 AS side, (vec_id % 10) // 2 AS token, embedding::DOUBLE[] AS v FROM embeddings),
c AS (SELECT a.pair_id, a.token AS i, b.token AS j, list_cosine_similarity(a.v, b.v) AS s FROM t a JOIN t b ON a.pair_id = b.pair_id WHERE a.side = 0 AND b.side = 1),
p AS (SELECT pair_id, avg(m) AS p FROM (SELECT pair_id, i, max(s) AS m FROM c GROUP BY 1, 2) GROUP BY 1),
r AS (SELECT pair_id, avg(m) AS r FROM (SELECT pair_id, j, max(s) AS m FROM c GROUP BY 1, 2) GROUP BY 1)
SELECT p.pair_id, round(p.p, 6) AS precision, round(r.r, 6) AS recall, round(coalesce(2 * p.p * r.r / nullif(p.p + r.r, 0), 0), 6) AS f1 FROM p JOIN r ON p.pair_id = r.pair_id""")
def greedy_match_f1(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    tokens = vectors.select(
        F.floor(F.col("vec_id") / 10).alias("pair_id"), (F.col("vec_id") % 2).cast("int").alias("side"),
        F.floor((F.col("vec_id") % 10) / 2).cast("bigint").alias("token"), "embedding",
    )
    scored = greedy_match(tokens)
    return scored.select("pair_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])
