"""Pairs: text building, splits, filters, canonical form, combining, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from taskweave.contracts import INPUT, OUTPUT
from taskweave.operators.assemble import assemble
from taskweave.operators.pairs import canonicalize, combine, contributions, format_pairs, pairs_from_samples, selection_problem
from taskweave.operators.sampling import holdout, sample_rows, shuffle
from taskweave.operators.shapes import flatten_with_unique_names, row_preview
from taskweave.operators.splits import split_table, split_tasks
from taskweave.operators.textualize import drop_empty_pairs, process_tasks, wrap_input
from taskweave.queries.registry import LABELLED, TURN_PAIRS, labelled, lit, query, sql_mark, sql_strip, spread_table, table, turn_pairs

INSTRUCTION = "Tell whether the text is of good quality (1) or not (0)."
CAPS = {"train": 3500, "val": 500, "test": 1000}
EOS = "<|endoftext|>"


def _sql_split(pos: str = "pos", n: str = "n", train: float = 0.7, val: float = 0.1, caps: dict[str, int] = CAPS) -> tuple[str, str]:
    """CASE expression of the split name, and the condition that a row is within the caps."""
    t, v = f"floor({train}::DOUBLE * {n})::BIGINT", f"floor({val}::DOUBLE * {n})::BIGINT"
    a = f"least({t}, {caps['train']})"
    b = f"{a} + least({v}, {caps['val']})"
    c = f"{b} + least({n} - {t} - {v}, {caps['test']})"
    return f"CASE WHEN {pos} < {a} THEN 'train' WHEN {pos} < {b} THEN 'val' ELSE 'test' END", f"{pos} < {c}"


_SPLIT, _INSIDE = _sql_split()
_PROMPT = "'<task 0>' || " + lit(INSTRUCTION) + " || chr(10) || 'Example:' || chr(10) || input_col || chr(10) || 'Label:' || chr(10)"


def flagship(spark, sf_dir):
    """Labelled documents to split model text."""
    split = split_table(labelled(spark, sf_dir), ["doc_id"], 0.7, 0.1, CAPS)
    return process_tasks(split, INSTRUCTION, has_encoder=True)


@query(f"""WITH {LABELLED}, s AS (SELECT *, {_SPLIT} AS split FROM labelled WHERE {_INSIDE})
SELECT doc_id, split, {_PROMPT} AS model_input, output_col::VARCHAR AS model_output FROM s""")
def textualize_encoder_decoder(spark, sf_dir):
    return flagship(spark, sf_dir)


@query(f"""WITH {LABELLED}, s AS (SELECT *, {_SPLIT} AS split FROM labelled WHERE {_INSIDE})
SELECT doc_id, split,
  {_PROMPT} || CASE WHEN split = 'train' THEN output_col::VARCHAR || '{EOS}' ELSE '' END AS model_input,
  output_col::VARCHAR || CASE WHEN split = 'train' THEN '{EOS}' ELSE '' END AS model_output FROM s""")
def textualize_decoder_only(spark, sf_dir):
    split = split_table(labelled(spark, sf_dir), ["doc_id"], 0.7, 0.1, CAPS)
    return process_tasks(split, INSTRUCTION, has_encoder=False, eos_token=EOS)


@query("""SELECT conv_id, turn, '<task 0>Answer.' || chr(10) || 'Example:' || chr(10) || text || chr(10) || 'Label:' || chr(10) AS model_input
FROM conversations WHERE role = 'user'""")
def wrap_inputs(spark, sf_dir):
    users = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return users.select("conv_id", "turn", wrap_input("Answer.", F.col("text")).alias("model_input"))


def _blanked(pairs):
    return pairs.withColumns(
        {
            INPUT: F.when(F.col("conv_id") % 7 == 0, "").otherwise(F.col(INPUT)),
            OUTPUT: F.when(F.col("turn") == 2, "").when(F.col("turn") == 4, None).otherwise(F.col(OUTPUT)),
        }
    )


@query(f"""WITH {TURN_PAIRS}, b AS (SELECT conv_id, turn, CASE WHEN conv_id % 7 = 0 THEN '' ELSE input_col END AS input_col,
  CASE WHEN turn = 2 THEN '' WHEN turn = 4 THEN NULL ELSE output_col END AS output_col FROM turn_pairs)
SELECT * FROM b WHERE length(coalesce(input_col, 'None')) > 0 AND length(coalesce(output_col, 'None')) > 0""")
def drop_empty(spark, sf_dir):
    return drop_empty_pairs(_blanked(turn_pairs(spark, sf_dir)))


_MULTI, _MULTI_INSIDE = _sql_split(train=0.6, val=0.2, caps={"train": 25, "val": 5, "test": 8})


@query(f"""WITH r AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos,
  count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, source, n_chars, {_MULTI} AS split FROM r WHERE {_MULTI_INSIDE}""")
def split_with_caps_per_task(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return split_tasks(docs, ["doc_id"], 0.6, 0.2, {"train": 25, "val": 5, "test": 8}, task="source")


@query(f"""WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, o_totalprice, {_SPLIT} AS split FROM r WHERE {_INSIDE}""")
def split_with_caps(spark, sf_dir):
    return split_table(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 0.7, 0.1, CAPS)


@query("""WITH r AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'val' ELSE 'test' END AS split FROM orders),
h AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY o_orderkey) AS rn FROM r)
SELECT split, o_orderkey,
  'o_totalprice: ' || o_totalprice::VARCHAR || chr(10) || 'o_custkey: ' || o_custkey::VARCHAR || chr(10) || 'o_orderstatus: ' || o_orderstatus AS input_col,
  o_orderpriority AS output_col FROM h WHERE rn <= 3000""")
def canonicalize_columns(spark, sf_dir):
    status = F.col("o_orderstatus")
    orders = table(spark, sf_dir, "orders").withColumn("split", F.when(status == "F", "train").when(status == "O", "val").otherwise("test"))
    return canonicalize(
        orders, ["o_totalprice", "o_custkey", "o_orderstatus"], "o_orderpriority", ["o_orderkey"], max_rows=3000, split="split", keep=["o_orderkey"]
    )


@query("""SELECT d.doc_id, d.text AS input_col, l.quality AS output_col FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE d.text IS NOT NULL AND l.quality IS NOT NULL""")
def samples_to_pairs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marks = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return pairs_from_samples(docs.join(marks, "doc_id", "left"), "text", "quality")


@query(f"""WITH {TURN_PAIRS}, u AS (
  SELECT 'turn' AS kind, conv_id * 1000 + turn AS id, input_col, output_col FROM turn_pairs
  UNION ALL SELECT 'document', doc_id, text, lang FROM documents)
SELECT kind, id, {sql_strip('input_col')} || ' ' || {sql_strip('output_col')} AS text FROM u""")
def combine_and_format(spark, sf_dir):
    turns = turn_pairs(spark, sf_dir).select(F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), INPUT, OUTPUT)
    docs = table(spark, sf_dir, "documents").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias(INPUT), F.col("lang").alias(OUTPUT)
    )
    return format_pairs(combine([turns, docs], keep=["kind", "id"]))


@query("""SELECT event_id AS event_id, user_id AS who_id, event_type AS what_kind, value AS what_amount_value, props AS what_kind_1, value * 2 AS who_id_1
FROM events""")
def flatten_unique_names(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    nested = events.select(
        "event_id",
        F.struct(F.col("user_id").alias("id")).alias("who"),
        F.struct(F.col("event_type").alias("kind"), F.struct("value").alias("amount")).alias("what"),
        F.col("props").alias("what_kind"),
        (F.col("value") * 2).alias("who_id"),
    )
    return flatten_with_unique_names(nested)


def _sql_json_string(x: str) -> str:
    """A JSON string with everything beyond ASCII escaped; surrogate pairs above the basic plane."""
    char = (
        "CASE WHEN unicode(c) BETWEEN 32 AND 126 THEN c "
        "WHEN unicode(c) > 65535 THEN '\\u' || printf('%04x', 55296 + ((unicode(c) - 65536) >> 10)) || '\\u' || printf('%04x', 56320 + ((unicode(c) - 65536) & 1023)) "
        "ELSE '\\u' || printf('%04x', unicode(c)) END"
    )
    return f"array_to_string(list_transform(string_split(to_json({x})::VARCHAR, ''), lambda c: {char}), '')"


def _sql_cut(x: str, n: int = 50) -> str:
    return f"CASE WHEN length({x}) <= {n - 3} THEN {x} ELSE left({x}, {n}) || '...' END"


@query(f"""WITH v AS (SELECT doc_id, {_sql_json_string('text')} AS t, {_sql_json_string('lang')} AS l, {_sql_json_string('source')} AS s, n_chars::VARCHAR AS n FROM documents),
c AS (SELECT doc_id, {_sql_cut('doc_id::VARCHAR')} AS d, {_sql_cut('t')} AS t, {_sql_cut('l')} AS l, {_sql_cut('s')} AS s, {_sql_cut('n')} AS n FROM v)
SELECT doc_id, '{{"doc_id": ' || to_json(d)::VARCHAR || ', "text": ' || to_json(t)::VARCHAR || ', "lang": ' || to_json(l)::VARCHAR
  || ', "source": ' || to_json(s)::VARCHAR || ', "n_chars": ' || to_json(n)::VARCHAR || '}}' AS preview FROM c""")
def row_previews(spark, sf_dir):
    docs = spread_table(spark, sf_dir, "documents")
    return docs.select("doc_id", row_preview(docs, ["doc_id", "text", "lang", "source", "n_chars"]).alias("preview"))


@query("""WITH p AS (SELECT doc_id, CASE WHEN n_chars % 5 = 0 THEN [] WHEN n_chars % 5 = 1 THEN ['text', 'tone'] ELSE ['text'] END AS i,
  CASE WHEN n_chars % 3 = 0 THEN ['lang', 'source'] ELSE [CASE WHEN lang = 'de' THEN 'language' ELSE 'lang' END] END AS o FROM documents),
u AS (SELECT *, list_sort(list_filter(list_distinct(list_concat(i, o)), lambda c: NOT list_contains(['text', 'lang', 'source'], c))) AS bad FROM p)
SELECT doc_id, CASE WHEN len(i) < 1 OR len(o) <> 1 THEN 'wrong number of columns'
  WHEN len(bad) > 0 THEN 'unknown columns: ' || array_to_string(bad, ', ') END AS problem FROM u""")
def validate_columns(spark, sf_dir):
    n, text = F.col("n_chars"), F.lit("text")
    docs = table(spark, sf_dir, "documents")
    inputs = F.when(n % 5 == 0, F.array().cast("array<string>")).when(n % 5 == 1, F.array(text, F.lit("tone"))).otherwise(F.array(text))
    lang = F.when(F.col("lang") == "de", "language").otherwise("lang")
    outputs = F.when(n % 3 == 0, F.array(F.lit("lang"), F.lit("source"))).otherwise(F.array(lang))
    columns = F.array(*[F.lit(c) for c in ("text", "lang", "source")])
    return docs.select("doc_id", selection_problem(inputs, outputs, columns).alias("problem"))


_TARGET, _SOURCES = 120, 3


@query(f"""WITH z AS (SELECT source, count(*) AS n, sum(n_chars) AS weight FROM documents GROUP BY source),
k AS (SELECT source, n, row_number() OVER (ORDER BY weight DESC, source) AS rank FROM z),
c AS (SELECT source, rank, coalesce(sum(n) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS already FROM k WHERE rank <= {_SOURCES}),
d AS (SELECT d.doc_id, d.source, c.already + row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) AS place FROM documents d JOIN c ON d.source = c.source WHERE c.already < {_TARGET})
SELECT doc_id, source FROM d WHERE place <= {_TARGET}""")
def assemble_to_target(spark, sf_dir):
    return _assembled(spark, sf_dir)


def _assembled(spark, sf_dir):
    from pyspark.sql import Window

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    weights = docs.groupBy("source").agg(F.sum("n_chars").alias("weight"))
    # one row per source of the catalogue
    best = weights.orderBy(F.desc("weight"), "source").limit(_SOURCES)
    ranked = best.select("source", F.row_number().over(Window.orderBy(F.desc("weight"), "source")).alias("rank"))
    return assemble(docs.select("doc_id", "source"), ranked, ["doc_id"], _TARGET, _SOURCES)


@query(f"""WITH z AS (SELECT source, count(*) AS n, sum(n_chars) AS weight FROM documents GROUP BY source),
k AS (SELECT source, n, row_number() OVER (ORDER BY weight DESC, source) AS rank FROM z),
c AS (SELECT source, n, coalesce(sum(n) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS already FROM k WHERE rank <= {_SOURCES})
SELECT source, least(n, {_TARGET} - already)::BIGINT AS n_rows FROM c WHERE already < {_TARGET}""")
def contribution_counts(spark, sf_dir):
    return contributions(_assembled(spark, sf_dir))


@query(f"""SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY {sql_mark(2023, 'o_orderkey')}, o_orderkey) - 1 AS pos FROM orders""")
def shuffle_rows(spark, sf_dir):
    return shuffle(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderkey"], 2023)


@query(f"""SELECT o_orderkey, o_orderpriority FROM orders ORDER BY {sql_mark(42, 'o_orderkey')}, o_orderkey LIMIT 100""")
def sample_100(spark, sf_dir):
    return sample_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderkey"], 100, 42)


@query(f"""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {sql_mark(2023, 'o_orderkey')}, o_orderkey) AS rn, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN rn <= ceil(0.15::DOUBLE * n) THEN 'val' ELSE 'train' END AS split FROM r""")
def random_holdout(spark, sf_dir):
    return holdout(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 0.15, 2023)
