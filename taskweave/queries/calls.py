"""Jobs around a model, run with stub clients."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from taskweave.contracts import INPUT, OUTPUT, TaskSpec
from taskweave.functions import prompts as P
from taskweave.functions.text import py_str
from taskweave.operators.catalog import sorted_map
from taskweave.operators.completion import CallSettings, complete
from taskweave.operators.inference import encode, hashed_embedding, predict
from taskweave.operators.positions import head_per_group, with_position
from taskweave.plans.dataset_retrieval import retrieve_dataset
from taskweave.plans.generation import GenerationSettings, generate, with_sampled_lines
from taskweave.plans.rerank import config_prompts, dataset_prompts, rerank
from taskweave.plans.transform import transform_table
from taskweave.plans.understanding import expand_queries, parse_prompts, select_columns
from taskweave.queries import stubs
from taskweave.queries.retrieval import sql_embedding
from taskweave.queries.registry import (
    TURN_PAIRS, lit, query, sql_draw, sql_draw_distinct, sql_fill, sql_mark, spread_table, sql_strip, sql_token_count, table, turn_pairs,
)

FREE = CallSettings(responses=1, requests_per_minute=None, wait_seconds=0.0)


@query("""SELECT item_id AS prompt_id, i::INTEGER AS choice, md5(text) || '~' || i AS content, NULL::VARCHAR AS error FROM benchmark, range(3) r(i)""")
def batch_completion(spark, sf_dir):
    prompts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("prompt_id"), F.col("text").alias("prompt"))
    return complete(prompts, stubs.echo_client, CallSettings(responses=3, requests_per_minute=None))


@query("SELECT doc_id, replace(text, 'e', 'E') AS prediction, text AS input_text FROM documents")
def batch_predict(spark, sf_dir):
    docs = spread_table(spark, sf_dir, "documents").select("doc_id", "text")
    said = predict(docs, stubs.loud_model, "text")
    return said.select("doc_id", "prediction.prediction", F.col("prediction.aux")["input_text"].alias("input_text"))


@query("""SELECT doc_id, length(text)::DOUBLE AS n_chars, (length(text) - length(replace(text, 'e', '')))::DOUBLE AS n_e,
  (length(text) - length(replace(text, chr(10), '')))::DOUBLE AS n_lines FROM documents""")
def batch_encode(spark, sf_dir):
    docs = encode(spread_table(spark, sf_dir, "documents").select("doc_id", "text"), stubs.shape_model)
    return docs.select("doc_id", *[F.get("embedding", F.lit(i)).alias(n) for i, n in enumerate(("n_chars", "n_e", "n_lines"))])


_SHOWN = [P.PARSE_CASE.format(prompt=p) + a for p, a in P.PARSE_SHOWN]
_PARSING = lit(P.SECTION.join([P.PARSE_LEAD, *_SHOWN]) + P.SECTION) + " || " + sql_fill(P.PARSE_CASE, prompt="text")


@query(f"""WITH p AS (SELECT conv_id * 1000 + turn AS prompt_id, md5({_PARSING}) AS h FROM conversations WHERE role = 'user')
SELECT prompt_id, CASE WHEN h[1] <> 'f' THEN h END AS instruction, CASE WHEN h[1] <> 'f' THEN 'N/A' END AS examples FROM p""")
def parse_instructions(spark, sf_dir):
    users = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    prompts = users.select((F.col("conv_id") * 1000 + F.col("turn")).alias("prompt_id"), "text")
    return parse_prompts(prompts, stubs.parse_client, tries=2, calls=FREE)


@query(f"SELECT item_id AS query_id, 'A model about ' || md5({sql_fill(P.IMAGINE, instruction='text')}) || '.' AS text FROM benchmark", name="expand_queries")
def imagined_queries(spark, sf_dir):
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return expand_queries(queries, stubs.imagine_client, calls=FREE)


_CASES = [P.SELECT_CASE.format(**case) + "\n" + answer for case, answer in P.SELECT_SHOWN]
_SELECTING = lit(P.SECTION.join([P.SELECT_LEAD, *_CASES]) + P.SECTION) + " || " + sql_fill(
    P.SELECT_CASE, instruction="'Find the language.'", name="source", description="'Texts of ' || source", columns="'text, lang, source, doc_id'", sample_row="'{\"doc_id\": \"' || doc_id || '\"}'"
)


def _selection_tables(spark, sf_dir):
    return spread_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("prompt_id"), F.lit("Find the language.").alias("instruction"), F.col("source").alias("name"),
        F.concat(F.lit("Texts of "), "source").alias("description"), F.array(*[F.lit(c) for c in ("text", "lang", "source", "doc_id")]).alias("columns"),
        F.concat(F.lit('{"doc_id": "'), F.col("doc_id").cast("string"), F.lit('"}')).alias("sample_row"),
    )


@query(f"""WITH p AS (SELECT doc_id AS prompt_id, md5({_SELECTING})[1] AS h FROM documents)
SELECT prompt_id, CASE WHEN h NOT IN ('0', '1', '2') THEN 'text' END AS inputs, CASE WHEN h NOT IN ('0', '1', '2') THEN 'lang' END AS output,
  CASE WHEN h IN ('0', '1') THEN 'wrong number of columns' WHEN h = '2' THEN 'unknown columns: tone' END AS problem FROM p""", name="select_columns")
def selected_columns(spark, sf_dir):
    chosen = select_columns(_selection_tables(spark, sf_dir), stubs.columns_client, calls=FREE)
    return chosen.withColumn("inputs", F.array_join("inputs", ","))


# --- prompt texts --------------------------------------------------------------

_ITEM = "'[' || pos || '] **' || source || '** ' || 'Texts of ' || source || chr(10) || '    tags: ' || tags"


def _sql_rank_prompt(items: str, count: str) -> str:
    return sql_fill(P.RANK_DATASETS, count=count, instruction="'Find texts in ' || lang", examples="'N/A'", items=items)


_CANDIDATES = """g AS (SELECT lang, source, count(*) AS n, string_agg(DISTINCT (n_chars % 3)::VARCHAR, ', ' ORDER BY (n_chars % 3)::VARCHAR) AS tags, min(doc_id) AS first_id FROM documents GROUP BY lang, source),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS pos FROM g), k AS (SELECT * FROM r WHERE pos <= 25)"""


def _rank_tables(spark, sf_dir):
    """Tasks: one per language. Candidates: sources by their number of documents in that language."""
    docs = table(spark, sf_dir, "documents")
    tasks = docs.select("lang").distinct().select(
        F.col("lang").alias("task_id"), F.concat(F.lit("Find texts in "), "lang").alias("instruction"), F.lit("N/A").alias("examples")
    )
    groups = docs.groupBy(F.col("lang").alias("task_id"), F.col("source").alias("name")).agg(
        F.count("*").alias("n"), F.array_sort(F.collect_set((F.col("n_chars") % 3).cast("string"))).alias("tags")
    )
    best = head_per_group(groups, ["task_id"], [F.desc("n"), F.asc("name")], 25, rank="pos")
    candidates = best.select("task_id", "pos", "name", F.concat(F.lit("Texts of "), "name").alias("description"), "tags")
    # a source's configs are the lengths modulo 12 that occur in it; more than ten are sampled
    configs = docs.groupBy(F.col("source").alias("dataset"), F.format_string("part_%02d", F.col("n_chars") % 12).alias("config")).agg(
        F.min("doc_id").cast("string").alias("sample_row")
    ).withColumn("columns", F.array(F.lit("text"), F.lit("lang")))
    return tasks, candidates, configs


_RANKED = f"""{_CANDIDATES}, pr AS (SELECT lang, {_sql_rank_prompt(f"string_agg({_ITEM}, chr(10) ORDER BY pos)", "count(*)")} AS prompt, list(source ORDER BY pos) AS names FROM k GROUP BY lang)"""


@query(f"""WITH {_RANKED}, c AS (SELECT doc_id, source, lang, text FROM documents)
SELECT 'rank' AS kind, lang AS id, prompt FROM pr
UNION ALL SELECT 'explain', doc_id::VARCHAR, {sql_fill(P.EXPLAIN, instruction='text', examples="'N/A'")} FROM c
UNION ALL SELECT 'imagine', doc_id::VARCHAR, {sql_fill(P.IMAGINE, instruction='text')} FROM c
UNION ALL SELECT 'parse', doc_id::VARCHAR, {_PARSING} FROM c
UNION ALL SELECT 'select', doc_id::VARCHAR, {_SELECTING} FROM c""")
def catalog_prompts(spark, sf_dir):
    docs = spread_table(spark, sf_dir, "documents").withColumn("id", F.col("doc_id").cast("string"))
    tasks, candidates, _ = _rank_tables(spark, sf_dir)
    text = F.col("text")
    each = lambda kind, prompt: docs.select(F.lit(kind).alias("kind"), "id", prompt.alias("prompt"))
    selection = _selection_tables(spark, sf_dir).select(
        F.lit("select").alias("kind"), F.col("prompt_id").cast("string").alias("id"),
        P.column_selection_prompt(*[F.col(c) for c in ("instruction", "name", "description", "columns", "sample_row")]).alias("prompt"),
    )
    return (
        dataset_prompts(tasks, candidates).select(F.lit("rank").alias("kind"), F.col("prompt_id").alias("id"), "prompt")
        .unionByName(each("explain", P.explanation_prompt(text, F.lit("N/A"))))
        .unionByName(each("imagine", P.imagined_model_prompt(text)))
        .unionByName(each("parse", P.parsing_prompt(text)))
        .unionByName(selection)
    )


@query(f"""WITH o AS (SELECT o_orderstatus, o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS rn FROM orders),
r AS (SELECT o_orderstatus, string_agg('{{''o_orderkey'': ' || o_orderkey || ', ''o_custkey'': ' || o_custkey || ', ''o_orderstatus'': ''' || o_orderstatus || '''}}' || chr(10), chr(10) ORDER BY rn) AS rows FROM o WHERE rn <= 5 GROUP BY 1)
SELECT o_orderstatus, {sql_fill(P.PLAN, task="'Guess.'", examples="'N/A'", rows='rows')} AS prompt FROM r""")
def plan_prompts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    head = head_per_group(orders, ["o_orderstatus"], [F.col("o_orderkey")], P.PLAN_ROWS)
    row = F.struct("o_orderkey", "o_custkey", "o_orderstatus")
    text = py_str(row, orders.select(row.alias("r")).schema["r"].dataType)
    rows = head.groupBy("o_orderstatus").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", text.alias("t")))).alias("rows"))
    return rows.select("o_orderstatus", P.plan_prompt(F.lit("Guess."), F.lit("N/A"), F.col("rows.t")).alias("prompt"))


# --- few-shot prompts ------------------------------------------------------------

_SEED = 2023
_LINE = "'input=\"' || input_col || '\"' || chr(10) || 'output=\"' || output_col || '\"' || chr(10)"
_TEXTS = "[" + ", ".join(lit(t) for t in P.SOLVED_TASKS) + "]"


def _sql_head(shown: int) -> str:
    return (
        lit(P.GENERATE_LEAD + P.SECTION) + f" || array_to_string(list_transform(solved[1:{shown}], lambda i: {_TEXTS}[i + 1]), chr(10) || chr(10)) || " + lit(P.SECTION)
    )


_SHOWN_FOR = P.SHOWN_BY_REMAINDER
_FIXED = sql_fill(P.GENERATE_TASK, instruction="instruction", examples="'N/A'", sampled="''")
_FULL = sql_fill(P.GENERATE_TASK, instruction="instruction", examples="'N/A'", sampled="CASE WHEN m = 0 THEN 'N/A' || chr(10) ELSE array_to_string(lines[1:m], '') END")
_CUTOFF = 900


@query(f"""WITH {TURN_PAIRS}, pool AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS pos, {_LINE} AS line FROM turn_pairs),
c AS (SELECT count(*) AS n FROM pool),
p AS (SELECT conv_id * 1000 + turn AS prompt_id, text AS instruction, c.n, 1 + {sql_draw('least(c.n, 10)', f'{_SEED}-k', 'conv_id * 1000 + turn')} AS k FROM conversations CROSS JOIN c WHERE role = 'user'),
d AS (SELECT *, {sql_draw_distinct('k', 'n', f'{_SEED}-draw', 'prompt_id')} AS draws, {sql_draw_distinct('4', str(len(P.SOLVED_TASKS)), f'{_SEED}-solved', 'prompt_id')} AS solved FROM p),
x AS (SELECT prompt_id, unnest(draws) AS pos, generate_subscripts(draws, 1) AS slot FROM d),
l AS (SELECT x.prompt_id, list(pool.line ORDER BY slot) AS lines FROM x JOIN pool ON pool.pos = x.pos GROUP BY 1),
h AS (SELECT d.*, l.lines, {_sql_head(_SHOWN_FOR[0])} AS h0, {_sql_head(_SHOWN_FOR[1])} AS h1, {_sql_head(_SHOWN_FOR[2])} AS h2,
  list_transform(l.lines, lambda s: {sql_token_count('s')}) AS lt, {sql_token_count(_FIXED)} AS fixed FROM d JOIN l ON l.prompt_id = d.prompt_id),
z AS (SELECT *, {sql_token_count('h0')} AS t0, {sql_token_count('h1')} AS t1, {sql_token_count('h2')} AS t2 FROM h),
f AS (SELECT *, list_filter(range(0, k + 1), lambda m: fixed + CASE m % 3 WHEN 0 THEN t0 WHEN 1 THEN t1 ELSE t2 END
  + CASE WHEN m = 0 THEN {sql_token_count("'N/A' || chr(10)")} ELSE list_sum(lt[1:m]) END < {_CUTOFF}) AS fit FROM z),
g AS (SELECT *, coalesce(list_max(fit), 0) AS m FROM f)
SELECT prompt_id, CASE m % 3 WHEN 0 THEN h0 WHEN 1 THEN h1 ELSE h2 END || {_FULL} AS prompt, m::INTEGER AS n_used, len(fit) > 0 AS fits FROM g""")
def few_shot_prompts(spark, sf_dir):
    pool = with_position(turn_pairs(spark, sf_dir), ["conv_id", "turn"]).select(
        F.lit(0).alias("task_id"), "pos", P.example_line(F.col(INPUT), F.col(OUTPUT)).alias("line")
    )
    users = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    prompts = users.select(
        F.lit(0).alias("task_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("prompt_id"), F.col("text").alias("instruction"), F.lit("N/A").alias("examples"),
        pool.agg(F.count("*")).scalar().alias("have"),
    )
    built = P.with_generation_prompt(with_sampled_lines(prompts, pool, _SEED), _CUTOFF, _SEED)
    return built.select("prompt_id", "prompt", "n_used", "fits")


# --- whole jobs --------------------------------------------------------------------

_SPEC = TaskSpec("Guess the priority of an order.", 'input="1"\noutput="2"')
_MAX_FAILED = 300
_ROW = """'{''o_orderkey'': ' || o_orderkey || ', ''o_custkey'': ' || o_custkey || ', ''o_orderstatus'': ''' || o_orderstatus || ''', ''o_orderpriority'': ''' || o_orderpriority || '''}'"""
_EX = lit(_SPEC.examples)


@query(f"""WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, {_ROW} AS row FROM orders),
e AS (SELECT 'text ' || md5({sql_fill(P.EXPLAIN, instruction=lit(_SPEC.instruction), examples=_EX)}) AS task),
pl AS (SELECT any_value(e.task) AS task, 'text ' || md5({sql_fill(P.PLAN, task='any_value(e.task)', examples=_EX, rows="string_agg(row || chr(10), chr(10) ORDER BY pos)")}) AS plan FROM o CROSS JOIN e WHERE pos < 5),
h AS (SELECT pos, md5({sql_fill(P.TRANSFORM, task='pl.task', examples=_EX, plan='pl.plan', row='row')}) AS h FROM o CROSS JOIN pl),
j AS (SELECT pos, h, h[1] = '1' AS failed FROM h WHERE h[1] <> '0'),
c AS (SELECT *, sum(failed::INTEGER) OVER (ORDER BY pos) AS n_failed FROM j)
SELECT pos, h AS input_col, left(h, 4) AS output_col FROM c WHERE NOT failed AND n_failed <= {_MAX_FAILED}""")
def row_transform(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    placed = with_position(orders, ["o_orderkey"])
    return transform_table(placed, _SPEC, stubs.transform_client, orders.count(), _MAX_FAILED, calls=FREE)


_PICK = "'[' || chr((96 + pos)::INTEGER) || '] **' || config || '**' || chr(10) || '    columns: text, lang' || chr(10) || '    first row: ' || sample_row"


def _sql_winner(votes: str) -> str:
    """The most voted name of ``votes``: (lang, prompt, names), five votes each."""
    pick = "names[(('0x' || substr(md5(prompt || '~' || i), 1, 15))::BIGINT % len(names)) + 1]"
    return f"""(SELECT lang, name FROM (SELECT lang, name, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, min(i)) AS rn
  FROM (SELECT lang, i, {pick} AS name FROM {votes}, range(5) v(i)) GROUP BY lang, name) WHERE rn = 1)"""


@query(f"""WITH {_RANKED}, w AS {_sql_winner('pr')},
cf AS (SELECT source, printf('part_%02d', n_chars % 12) AS config, min(doc_id)::VARCHAR AS sample_row FROM documents GROUP BY 1, 2),
op AS (SELECT w.lang, w.name, cf.config, cf.sample_row, row_number() OVER (PARTITION BY w.lang ORDER BY {sql_mark(42, 'w.lang', 'cf.config')}, cf.config) AS dr FROM w JOIN cf ON cf.source = w.name),
nu AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY config) AS pos FROM op WHERE dr <= 10),
cp AS (SELECT lang, name, list(config ORDER BY pos) AS names, {sql_fill(P.RANK_CONFIGS, count='count(*)', dataset='name', description="'Texts of ' || name",
  instruction="'Find texts in ' || lang", examples="'N/A'", items=f'string_agg({_PICK}, chr(10) ORDER BY pos)')} AS prompt FROM nu GROUP BY lang, name),
cw AS {_sql_winner('cp')}
SELECT w.lang AS task_id, w.name AS dataset, CASE WHEN len(cp.names) = 1 THEN cp.names[1] ELSE cw.name END AS config FROM w JOIN cp ON cp.lang = w.lang JOIN cw ON cw.lang = w.lang""")
def rerank_datasets(spark, sf_dir):
    tasks, candidates, configs = _rank_tables(spark, sf_dir)
    return rerank(tasks, candidates, configs, stubs.choose_client, 5, FREE)


_ROUNDS = 6  # a round spends a call at least, and a task has six


def _sql_round(r: int) -> str:
    """CTEs of one round: from status ``s{r}`` and pool ``p{r}`` to ``s{r+1}`` and ``p{r+1}``."""
    fixed = sql_fill(P.GENERATE_TASK, instruction="instruction", examples="'N/A'", sampled="''")
    heads = ", ".join(f"{_sql_head(_SHOWN_FOR[m])} AS h{m}" for m in range(3))
    none = sql_token_count("'N/A' || chr(10)")
    answers = " UNION ALL ".join(f"SELECT * FROM g{i}" for i in range(r + 1))
    return f"""q{r} AS MATERIALIZED (SELECT task_id, instruction, have, number, task_id || '~{r}~' || number AS prompt_id
  FROM s{r}, unnest(range(least(2, ceil((num - have) / 3.0), 6 - calls)::BIGINT)) t(number) WHERE have < num AND calls < 6 AND NOT too_long),
k{r} AS (SELECT *, CASE WHEN have > 0 THEN 1 + {sql_draw('least(have, 10)', f'{_SEED}-k', 'prompt_id')} ELSE 0 END AS k FROM q{r}),
d{r} AS MATERIALIZED (SELECT *, {sql_draw_distinct('k', 'have', f'{_SEED}-draw', 'prompt_id')} AS draws, {sql_draw_distinct('4', str(len(P.SOLVED_TASKS)), f'{_SEED}-solved', 'prompt_id')} AS solved FROM k{r}),
x{r} AS (SELECT task_id, prompt_id, unnest(draws) AS pos, generate_subscripts(draws, 1) AS slot FROM d{r}),
l{r} AS (SELECT x.prompt_id, list({_LINE} ORDER BY slot) AS lines FROM x{r} x JOIN p{r} p ON p.task_id = x.task_id AND p.pos = x.pos GROUP BY 1),
h{r} AS MATERIALIZED (SELECT d.* EXCLUDE (draws), coalesce(l.lines, []) AS lines, {heads}, list_transform(coalesce(l.lines, []), lambda s: {sql_token_count('s')}) AS lt,
  {sql_token_count(fixed)} AS fixed FROM d{r} d LEFT JOIN l{r} l ON l.prompt_id = d.prompt_id),
z{r} AS MATERIALIZED (SELECT *, {sql_token_count('h0')} AS t0, {sql_token_count('h1')} AS t1, {sql_token_count('h2')} AS t2 FROM h{r}),
f{r} AS (SELECT *, list_filter(range(0, k + 1), lambda m: fixed + CASE m % 3 WHEN 0 THEN t0 WHEN 1 THEN t1 ELSE t2 END + CASE WHEN m = 0 THEN {none} ELSE list_sum(lt[1:m]) END < 3500) AS fit FROM z{r}),
e{r} AS MATERIALIZED (SELECT task_id, number, len(fit) > 0 AS fits, CASE m % 3 WHEN 0 THEN h0 WHEN 1 THEN h1 ELSE h2 END || {_FULL} AS prompt FROM (SELECT *, coalesce(list_max(fit), 0) AS m FROM f{r})),
g{r} AS MATERIALIZED (SELECT task_id, 'case ' || (('0x' || substr(h, 2, 3))::BIGINT % 40) AS input_col, CASE WHEN h[5] < '8' THEN h[5] ELSE 'x' END AS output_col, ({r}::BIGINT << 40) + (number << 20) + i AS seen
  FROM (SELECT task_id, number, i, md5(prompt || '~' || i) AS h FROM e{r}, range(3) a(i) WHERE fits) WHERE h[1] <> '0'),
v{r} AS (SELECT task_id, input_col, output_col, count(*) AS n, min(seen) AS seen FROM ({answers}) GROUP BY ALL),
w{r} AS (SELECT task_id, input_col, output_col, min(seen) OVER (PARTITION BY task_id, input_col) AS first_seen,
  row_number() OVER (PARTITION BY task_id, input_col ORDER BY n DESC, length(output_col), seen, output_col) AS rn FROM v{r}),
p{r + 1} AS MATERIALIZED (SELECT task_id, input_col, output_col, row_number() OVER (PARTITION BY task_id ORDER BY first_seen, input_col) - 1 AS pos FROM w{r} WHERE rn = 1),
s{r + 1} AS MATERIALIZED (SELECT s.task_id, instruction, num, coalesce(p.n, 0) AS have, calls + coalesce(e.n, 0) AS calls, too_long OR coalesce(e.n = 0, false) AS too_long
  FROM s{r} s LEFT JOIN (SELECT task_id, count(*) AS n FROM p{r + 1} GROUP BY 1) p ON p.task_id = s.task_id
  LEFT JOIN (SELECT task_id, count(*) FILTER (fits) AS n FROM e{r} GROUP BY 1) e ON e.task_id = s.task_id)"""


@query(f"""WITH s0 AS (SELECT conv_id AS task_id, arg_min(text, turn) AS instruction, count(*) AS num, 0::BIGINT AS have, 0::BIGINT AS calls, false AS too_long FROM conversations GROUP BY 1),
p0 AS (SELECT 0::BIGINT AS task_id, 0::BIGINT AS pos, '' AS input_col, '' AS output_col WHERE false),
{', '.join(_sql_round(r) for r in range(_ROUNDS))}
SELECT p.* FROM p{_ROUNDS} p JOIN s{_ROUNDS} s ON s.task_id = p.task_id WHERE p.pos < s.num""")
def synthetic_rounds(spark, sf_dir):
    """One task per conversation; as many pairs as it has turns, in at most six calls."""
    turns = table(spark, sf_dir, "conversations")
    tasks = turns.groupBy(F.col("conv_id").alias("task_id")).agg(
        F.min_by("text", "turn").alias("instruction"), F.lit("N/A").alias("examples"), F.count("*").alias("num_examples"), F.lit(6).cast("bigint").alias("max_calls")
    )
    settings = GenerationSettings(max_batch_size=2, responses_per_request=3, requests_per_minute=None, wait_seconds=0.0)
    return generate(tasks, stubs.pair_client, settings)


def _retrieval_tables(spark, sf_dir):
    """Languages as catalogue entries, even and odd lengths as their configs, documents as rows."""
    docs = table(spark, sf_dir, "documents")
    part = F.concat(F.lit("part_"), (F.col("n_chars") % 2).cast("string"))
    about = F.concat(F.lit("Texts of many sources in "), "lang")
    entry = docs.groupBy("lang", part.alias("part")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    columns = ("doc_id", "text", "source")
    config = F.struct(
        F.col("part").alias("config_name"), F.concat(F.lit('{"doc_id": "'), F.col("first_id").cast("string"), F.lit('"}')).alias("sample_row"),
        F.array(*[F.lit(c) for c in columns]).alias("columns"),
        F.create_map(*[F.lit(c) for name in columns for c in (name, name)]).alias("columns_mapping"),
        about.alias("dataset_description"), F.col("lang").alias("dataset_name"),
    )
    catalog = entry.groupBy(F.col("lang").alias("name"), about.alias("description")).agg(
        sorted_map(F.col("part"), config).alias("configs"), F.sum("n").alias("downloads")
    ).withColumns({"tags": F.array(F.lit("text")), "is_gated": F.lit(False)})

    def loader(dataset: str, config_name: str):
        rows = docs.where((F.col("lang") == dataset) & (part == config_name))
        split = F.when(F.col("doc_id") % 10 < 8, "train").when(F.col("doc_id") % 10 == 8, "val").otherwise("test")
        return rows.select("doc_id", "text", "source", split.alias("split"), F.col("doc_id").alias("row_key"))

    return catalog.select("name", "description"), catalog, loader


# prompts list whole catalogues, so a prompt's own length sets its budget
_ROOMY = replace(FREE, max_tokens=None)
_QUICK = dict(votes=_ROOMY, single=_ROOMY, row_calls=_ROOMY)
_SOURCE_SPEC = TaskSpec("Tell the source of a text.", "N/A")
_ASKED = dict(instruction=lit(_SOURCE_SPEC.instruction), examples="'N/A'")
_ABOUT = "'Texts of many sources in ' || lang"
# catalogue entries by inner product with the instruction, numbered; all rows with their config, split and place in the shuffle
_FOUND = f"""d AS (SELECT doc_id, text, lang, source, 'part_' || (n_chars % 2) AS part,
    CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'val' ELSE 'test' END AS split, {sql_mark(2023, 'doc_id')} AS m FROM documents),
cf AS (SELECT lang, part, min(doc_id) AS first_id FROM d GROUP BY 1, 2),
qe AS (SELECT * FROM {sql_embedding(f"SELECT 0 AS id, {lit(_SOURCE_SPEC.instruction)} AS text")}),
de AS (SELECT * FROM {sql_embedding(f"SELECT DISTINCT lang AS id, {_ABOUT} AS text FROM d")}),
sc AS (SELECT l.lang, round(coalesce(sum(qe.weight * de.weight), 0), 6) AS score FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN de ON de.id = l.lang LEFT JOIN qe ON qe.slot = de.slot GROUP BY 1),
found AS (SELECT lang, row_number() OVER (ORDER BY score DESC, lang) AS pos FROM sc)"""


def _sql_choice(r: int) -> str:
    """CTE ``u{r}``: (lang, part) chosen by votes among the configs that earlier rounds left."""
    used = "".join(f" AND (lang, part) NOT IN (SELECT (lang, part) FROM u{i})" for i in range(r))
    item = f"'[' || pos || '] **' || lang || '** ' || {_ABOUT} || chr(10) || '    tags: text'"
    pick = """'[' || chr((96 + pos)::INTEGER) || '] **' || part || '**' || chr(10) || '    columns: doc_id, text, source' || chr(10) || '    first row: {"doc_id": "' || first_id || '"}'"""
    return f"""left{r} AS (SELECT * FROM cf WHERE true{used}),
pr{r} AS (SELECT 0 AS lang, {sql_fill(P.RANK_DATASETS, count='count(*)', items=f'string_agg({item}, chr(10) ORDER BY pos)', **_ASKED)} AS prompt, list(lang ORDER BY pos) AS names
  FROM found WHERE lang IN (SELECT lang FROM left{r})),
w{r} AS {_sql_winner(f'pr{r}')},
nu{r} AS (SELECT lang, part, first_id, row_number() OVER (ORDER BY part) AS pos FROM left{r} WHERE lang IN (SELECT name FROM w{r})),
cp{r} AS (SELECT lang, {sql_fill(P.RANK_CONFIGS, count='count(*)', dataset='lang', description=_ABOUT, items=f'string_agg({pick}, chr(10) ORDER BY pos)', **_ASKED)} AS prompt, list(part ORDER BY pos) AS names
  FROM nu{r} GROUP BY lang),
cw{r} AS {_sql_winner(f'cp{r}')},
u{r} AS (SELECT cp{r}.lang, CASE WHEN len(names) = 1 THEN names[1] ELSE name END AS part FROM cp{r} JOIN cw{r} ON cw{r}.lang = cp{r}.lang)"""


_ESCAPED = "replace(replace(replace(replace(text, '\\', '\\\\'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"
_REPR = f"""CASE WHEN contains(text, '''') AND NOT contains(text, '"') THEN '"' || {_ESCAPED} || '"' ELSE '''' || replace({_ESCAPED}, '''', '\\''') || '''' END"""
_TARGET = 3000
_MOST_FAILED = int(_TARGET * 0.333)


def _sql_rewritten(r: int) -> str:
    """CTE ``t{r}``: the pairs that the rows of choice ``r`` are rewritten to."""
    row = f"""'{{''text'': ' || {_REPR} || ', ''source'': ''' || source || '''}}'"""
    have = " - ".join([str(_TARGET), *(f"(SELECT count(*) FROM t{i})" for i in range(r))])
    plan = sql_fill(P.PLAN, task="any_value(task)", examples="'N/A'", rows="string_agg(row || chr(10), chr(10) ORDER BY pos)")
    return f"""o{r} AS (SELECT doc_id, {row} AS row, row_number() OVER (ORDER BY m, doc_id) - 1 AS pos FROM d WHERE split = 'train' AND (lang, part) IN (SELECT (lang, part) FROM u{r})),
pl{r} AS (SELECT any_value(task) AS task, 'text ' || md5({plan}) AS plan FROM o{r} CROSS JOIN e WHERE pos < {P.PLAN_ROWS}),
h{r} AS (SELECT pos, md5({sql_fill(P.TRANSFORM, task='task', examples="'N/A'", plan='plan', row='row')}) AS h FROM o{r} CROSS JOIN pl{r} WHERE pos < {have}),
c{r} AS (SELECT *, h[1] = '1' AS failed, sum((h[1] = '1')::INTEGER) OVER (ORDER BY pos) AS n_failed FROM h{r} WHERE h[1] <> '0'),
t{r} AS (SELECT 'train' AS split, u{r}.lang || '_' || u{r}.part AS source, h AS input_col, left(h, 4) AS output_col FROM c{r} CROSS JOIN u{r}
  WHERE NOT failed AND n_failed <= {_MOST_FAILED})"""


@query(f"""WITH {_FOUND}, {_sql_choice(0)},
r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY m, doc_id) AS rn FROM d WHERE (lang, part) IN (SELECT (lang, part) FROM u0))
SELECT split, lang || '_' || part AS source, {sql_strip("'text: ' || text")} AS input_col, source AS output_col FROM r WHERE rn <= 3000""")
def dataset_retrieval(spark, sf_dir):
    datasets, catalog, loader = _retrieval_tables(spark, sf_dir)
    return retrieve_dataset(_SOURCE_SPEC, datasets, catalog, hashed_embedding, stubs.dataset_client, loader, **_QUICK)


@query(f"""WITH {_FOUND}, e AS (SELECT 'text ' || md5({sql_fill(P.EXPLAIN, **_ASKED)}) AS task),
{', '.join(f'{_sql_choice(r)}, {_sql_rewritten(r)}' for r in range(3))}
SELECT * FROM t0 UNION ALL SELECT * FROM t1 WHERE (SELECT count(*) FROM t0) < {_TARGET}
UNION ALL SELECT * FROM t2 WHERE (SELECT count(*) FROM t0) + (SELECT count(*) FROM t1) < {_TARGET}""")
def dataset_retrieval_transformed(spark, sf_dir):
    datasets, catalog, loader = _retrieval_tables(spark, sf_dir)
    return retrieve_dataset(_SOURCE_SPEC, datasets, catalog, hashed_embedding, stubs.dataset_client, loader, transform=True, **_QUICK)
