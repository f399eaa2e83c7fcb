"""Token ids, pad runs, budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from taskweave.functions import arrays
from taskweave.functions.text import token_count
from taskweave.operators.pairs import format_pairs
from taskweave.operators.positions import batch_number, with_position
from taskweave.operators.textualize import textualize
from taskweave.operators.tokenize import batch_budgets, BORDERS, hashed_ids, longest_texts, padding_share, tokenize_bucketed, tokenize_causal, tokenize_rows
from taskweave.queries.registry import LABELLED, TURN_PAIRS, labelled, query, sql_draw, sql_strip, sql_token_count, sql_tokens, spread_table, table, turn_pairs

_MAX = 512
_EOS = " <end>"


def _sql_ids(x: str) -> str:
    return f"list_transform({sql_tokens(x)}, lambda t: ({sql_draw('31997', 'token', 't')} + 3)::INTEGER)"


def _joined(df, keys):
    """Arrays as text, so that both engines compare the same."""
    return df.select(*keys, *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("input_ids", "attention_mask", "labels")])


@query(f"""WITH r AS (SELECT doc_id, list_concat(list_transform(range(n_chars % 7), lambda x: 0), {_sql_ids('text')}, list_transform(range(n_chars % 5), lambda x: 0)) AS ids FROM documents),
f AS (SELECT doc_id, ids, list_position(list_transform(ids, lambda x: x <> 0), true) AS a, list_position(list_transform(list_reverse(ids), lambda x: x <> 0), true) AS b FROM r)
SELECT doc_id, (CASE WHEN coalesce(a, 0) = 0 THEN len(ids) ELSE a - 1 END)::INTEGER AS leading, (CASE WHEN coalesce(b, 0) = 0 THEN len(ids) ELSE b - 1 END)::INTEGER AS trailing FROM f""")
def pad_runs(spark, sf_dir):
    docs = spread_table(spark, sf_dir, "documents")
    zeros = lambda n: F.array_repeat(F.lit(0), (F.col("n_chars") % n).cast("int"))
    ids = docs.select("doc_id", F.concat(zeros(7), hashed_ids()(F.col("text")), zeros(5)).alias("ids"))
    return ids.select("doc_id", arrays.leading_run(F.col("ids"), 0).alias("leading"), arrays.trailing_run(F.col("ids"), 0).alias("trailing"))


def _model_rows(spark, sf_dir, has_encoder):
    rows = labelled(spark, sf_dir, spread_table).withColumn("split", F.lit("train"))
    return textualize(rows, "Judge.", has_encoder, _EOS).drop("split")


_TEXT = "'<task 0>Judge.' || chr(10) || 'Example:' || chr(10) || input_col || chr(10) || 'Label:' || chr(10)"
_ZEROS = "list_transform(range({0}), lambda x: 0)"
_ONES = "list_transform(range({0}), lambda x: 1)"
_SKIP = "list_transform(range({0}), lambda x: -100)"


@query(f"""WITH {LABELLED}, t AS (SELECT doc_id, {_sql_ids(f"{_TEXT} || output_col || '{_EOS}'")}[1:{_MAX}] AS i, {_sql_ids(f"output_col || '{_EOS}'")}[1:{_MAX}] AS o FROM labelled),
w AS (SELECT *, max(len(i)) OVER () AS w FROM t),
p AS (SELECT doc_id, list_concat({_ZEROS.format('w - len(i)')}, i) AS ids, list_concat({_ZEROS.format('w - len(i)')}, {_ONES.format('len(i)')}) AS mask, len(o) AS k, w FROM w)
SELECT doc_id, array_to_string(ids, ',') AS input_ids, array_to_string(mask, ',') AS attention_mask,
  array_to_string(list_concat({_SKIP.format('w - k')}, ids[w - k + 1:w]), ',') AS labels FROM p""")
def tokenize_decoder_only(spark, sf_dir):
    return _joined(tokenize_rows(_model_rows(spark, sf_dir, False), has_encoder=False, max_length=_MAX), ["doc_id"])


_BUCKETED = f"""{LABELLED}, t AS (SELECT doc_id, {_sql_ids(f"{_TEXT} || output_col || '{_EOS}'")}[1:{_MAX}] AS i, {_sql_ids(f"output_col || '{_EOS}'")}[1:{_MAX}] AS o FROM labelled),
b AS (SELECT *, len(list_filter({list(BORDERS)}, lambda b: b < len(i)))::INTEGER AS bucket FROM t),
w AS (SELECT *, max(len(i)) OVER (PARTITION BY bucket) AS w FROM b)"""


@query(f"""WITH {_BUCKETED}, p AS (SELECT doc_id, bucket, list_concat({_ZEROS.format('w - len(i)')}, i) AS ids, list_concat({_ZEROS.format('w - len(i)')}, {_ONES.format('len(i)')}) AS mask, len(o) AS k, w FROM w)
SELECT doc_id, bucket, array_to_string(ids, ',') AS input_ids, array_to_string(mask, ',') AS attention_mask,
  array_to_string(list_concat({_SKIP.format('w - least(k, w)')}, ids[w - least(k, w) + 1:w]), ',') AS labels FROM p""")
def tokenize_by_length(spark, sf_dir):
    rows = tokenize_bucketed(_model_rows(spark, sf_dir, False), has_encoder=False, max_length=_MAX)
    return _joined(rows, ["doc_id", "bucket"])


@query(f"""WITH {_BUCKETED} SELECT bucket, count(*) AS n_rows, max(w)::INTEGER AS width, round(1 - sum(len(i)) / sum(w), 6) AS padding FROM w GROUP BY bucket""")
def padding_by_length(spark, sf_dir):
    rows = tokenize_bucketed(_model_rows(spark, sf_dir, False), has_encoder=False, max_length=_MAX)
    return padding_share(rows, ["bucket"]).withColumn("padding", F.round("padding", 6))


@query(f"""WITH {LABELLED}, t AS (SELECT doc_id, {_sql_ids(_TEXT)}[1:{_MAX}] AS i, {_sql_ids('output_col::VARCHAR')}[1:{_MAX}] AS o FROM labelled),
w AS (SELECT *, max(len(i)) OVER () AS wi, max(len(o)) OVER () AS wo FROM t)
SELECT doc_id, array_to_string(list_concat(i, {_ZEROS.format('wi - len(i)')}), ',') AS input_ids,
  array_to_string(list_concat({_ONES.format('len(i)')}, {_ZEROS.format('wi - len(i)')}), ',') AS attention_mask,
  array_to_string(list_concat(o, {_SKIP.format('wo - len(o)')}), ',') AS labels FROM w""")
def tokenize_encoder_decoder(spark, sf_dir):
    return _joined(tokenize_rows(_model_rows(spark, sf_dir, True), has_encoder=True, max_length=_MAX), ["doc_id"])


@query(f"""WITH {TURN_PAIRS}, t AS (SELECT conv_id, turn, {_sql_ids(f"{sql_strip('input_col')} || ' ' || {sql_strip('output_col')}")}[1:{_MAX}] AS i FROM turn_pairs),
p AS (SELECT conv_id, turn, list_concat({_ZEROS.format(f'{_MAX} - len(i)')}, i) AS ids, list_concat({_ZEROS.format(f'{_MAX} - len(i)')}, {_ONES.format('len(i)')}) AS mask FROM t)
SELECT conv_id, turn, array_to_string(ids, ',') AS input_ids, array_to_string(mask, ',') AS attention_mask, array_to_string(ids, ',') AS labels FROM p""", name="tokenize_causal")
def causal_rows(spark, sf_dir):
    return _joined(tokenize_causal(format_pairs(turn_pairs(spark, sf_dir)), width=_MAX), ["conv_id", "turn"])


@query(f"""WITH b AS (SELECT 'text' AS c, arg_max(doc_id, (length(text), -doc_id)) AS k FROM documents
  UNION ALL SELECT 'source', arg_max(doc_id, (length(source), -doc_id)) FROM documents),
v AS (SELECT b.c, d.doc_id, CASE b.c WHEN 'text' THEN d.text ELSE d.source END AS x FROM b JOIN documents d ON d.doc_id = b.k)
SELECT c AS "column", doc_id, length(x)::BIGINT AS n_chars, {sql_token_count('x')} AS n_tokens, {sql_token_count('x')} > {_MAX} AS truncated FROM v""")
def longest_and_truncation(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return longest_texts(docs, ["text", "source"], token_count, _MAX, "doc_id")


@query(f"""WITH t AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS batch_id, {sql_token_count('text')} AS n FROM documents)
SELECT batch_id, max(n) AS n_tokens, count(*) AS n_prompts, 4000 - max(n) - 300 AS budget FROM t GROUP BY 1""")
def token_budgets(spark, sf_dir):
    docs = spread_table(spark, sf_dir, "documents").select("doc_id", token_count(F.col("text")).alias("n_tokens"))
    batches = with_position(docs, ["doc_id"]).select(batch_number("pos", 100).alias("batch_id"), "n_tokens")
    return batch_budgets(batches, max_tokens=4000)
