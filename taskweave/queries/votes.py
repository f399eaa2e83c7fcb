"""Voting and reading answers, in batch and on a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from taskweave.contracts import INPUT, OUTPUT
from taskweave.functions.parsing import chosen_name, last_object, strict_pair
from taskweave.operators.voting import multi_vote, plurality, winners
from taskweave.queries.registry import TURN_PAIRS, query, sql_strip, table, turn_pairs
from taskweave.staging import shared_folder
from taskweave.streaming.incremental import current_totals, parse_stream, vote_totals_stream


def _sql_vote(rows: str, pos: bool) -> str:
    """Winners of ``rows``: (input_col, output_col, pos)."""
    order = "n DESC, length(output_col), first_seen, output_col" if pos else "n DESC, length(output_col), output_col"
    return f"""v AS (SELECT input_col, output_col, count(*) AS n, min(pos) AS first_seen FROM ({rows}) GROUP BY 1, 2),
w AS (SELECT input_col, output_col, min(first_seen) OVER (PARTITION BY input_col) AS first_seen,
  row_number() OVER (PARTITION BY input_col ORDER BY {order}) AS rn FROM v)"""


@query(f"""WITH {_sql_vote("SELECT l_partkey AS input_col, l_returnflag AS output_col, NULL::BIGINT AS pos FROM lineitem", False)}
SELECT input_col, output_col FROM w WHERE rn = 1""")
def multi_vote_parts(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias(INPUT), F.col("l_returnflag").alias(OUTPUT))
    return multi_vote(lines).select(INPUT, OUTPUT)


@query(f"""WITH {_sql_vote("SELECT user_id AS input_col, event_type AS output_col, event_id AS pos FROM events", True)}
SELECT input_col, output_col, first_seen FROM w WHERE rn = 1 ORDER BY first_seen LIMIT 1000""")
def multi_vote_first(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias(INPUT), F.col("event_type").alias(OUTPUT), "event_id")
    return multi_vote(rows, F.col("event_id"), limit=1000)


_ANSWER = """CASE event_id % 4 WHEN 0 THEN 'I choose **' || event_type || '** here.' WHEN 1 THEN 'The answer is ' || event_type || '.'
  WHEN 2 THEN event_type ELSE '**unlisted**' END"""


@query(f"""WITH a AS (SELECT user_id AS item, event_id AS vote, {_ANSWER} AS content FROM events),
n AS (SELECT item, vote, CASE WHEN regexp_matches(content, '\\*\\*([^\\n]*?)\\*\\*') THEN regexp_extract(content, '\\*\\*([^\\n]*?)\\*\\*', 1)
  ELSE replace(list_last(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> '')), '.', '') END AS name FROM a),
c AS (SELECT DISTINCT user_id AS item, event_type AS name FROM events WHERE value > 20),
k AS (SELECT n.item, n.vote, c.name FROM n LEFT JOIN c ON n.item = c.item AND n.name = c.name),
t AS (SELECT item, name, count(*) AS n, min(vote) AS first FROM k GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY n DESC, first) AS rn FROM t)
SELECT item, name AS winner, n AS votes FROM r WHERE rn = 1""")
def rerank_votes(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    kind, which = F.col("event_type"), F.col("event_id") % 4
    answer = (
        F.when(which == 0, F.concat(F.lit("I choose **"), kind, F.lit("** here.")))
        .when(which == 1, F.concat(F.lit("The answer is "), kind, F.lit(".")))
        .when(which == 2, kind).otherwise(F.lit("**unlisted**"))
    )
    votes = events.select(F.col("user_id").alias("item"), F.col("event_id").alias("vote"), chosen_name(answer).alias("name"))
    candidates = events.where(F.col("value") > 20).select(F.col("user_id").alias("item"), kind.alias("name"))
    return plurality(votes, candidates)


# answers as a model might give them: well formed, cut off, with a wrong key, with words around, with an empty side
_BROKEN = """CASE (conv_id + turn) % 6 WHEN 0 THEN left(j, length(j) - 1) WHEN 1 THEN replace(j, '"output":', '"label":')
  WHEN 2 THEN 'Sure: ' || j WHEN 3 THEN j || ' done' ELSE j END"""
_ANSWERS = f"""{TURN_PAIRS}, o AS (SELECT conv_id, turn, '{{"input":' || to_json(' ' || input_col || chr(10))::VARCHAR || ',"output":'
  || to_json(CASE WHEN turn = 6 THEN ' ' ELSE output_col END)::VARCHAR || '}}' AS j FROM turn_pairs),
a AS (SELECT conv_id, turn, {_BROKEN} AS content FROM o)"""


def _answers(spark, sf_dir):
    pairs = turn_pairs(spark, sf_dir)
    out = F.when(F.col("turn") == 6, " ").otherwise(F.col(OUTPUT))
    j = F.to_json(F.struct(F.concat(F.lit(" "), F.col(INPUT), F.lit("\n")).alias("input"), out.alias("output")))
    kind = (F.col("conv_id") + F.col("turn")) % 6
    content = (
        F.when(kind == 0, F.left(j, F.length(j) - 1)).when(kind == 1, F.replace(j, F.lit('"output":'), F.lit('"label":')))
        .when(kind == 2, F.concat(F.lit("Sure: "), j)).when(kind == 3, F.concat(j, F.lit(" done"))).otherwise(j)
    )
    return pairs.select("conv_id", "turn", content.alias("content"))


_FIELDS = f"""SELECT conv_id, turn, {sql_strip("json_extract_string(content, '$.input')")} AS input_col, {sql_strip("json_extract_string(content, '$.output')")} AS output_col"""


@query(f"""WITH {_ANSWERS}, p AS ({_FIELDS} FROM a WHERE json_valid(content))
SELECT * FROM p WHERE length(input_col) > 0 AND length(output_col) > 0""")
def parse_pairs_strict(spark, sf_dir):
    parsed = _answers(spark, sf_dir).withColumn("p", strict_pair(F.col("content"))).where(F.col("p").isNotNull())
    return parsed.select("conv_id", "turn", F.col("p.input").alias(INPUT), F.col("p.output").alias(OUTPUT))


# the brace that closes the object is found by a running count of braces from the right
@query(f"""WITH {_ANSWERS}, s AS (SELECT conv_id, turn, content AS whole, regexp_extract(content, '(?s)^.*\\}}') AS body FROM a),
ch AS (SELECT conv_id, turn, body, unnest(string_split(body, '')) AS c, generate_subscripts(string_split(body, ''), 1) AS i FROM s WHERE body <> ''),
dp AS (SELECT *, sum(CASE c WHEN '}}' THEN 1 WHEN '{{' THEN -1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY i DESC) AS depth FROM ch),
st AS (SELECT conv_id, turn, any_value(body) AS body, max(i) AS opening FROM dp WHERE c = '{{' AND depth = 0 GROUP BY 1, 2),
ob AS (SELECT conv_id, turn, substr(body, opening) AS content FROM st), p AS ({_FIELDS}, content FROM ob WHERE json_valid(content))
SELECT conv_id, turn, input_col, output_col FROM p WHERE json_exists(content, '$.input') AND json_exists(content, '$.output')""")
def parse_last_json(spark, sf_dir):
    parsed = _answers(spark, sf_dir).withColumn("f", last_object(F.col("content"), ["input", "output"])).where(F.col("f").isNotNull())
    return parsed.select("conv_id", "turn", F.col("f")["input"].alias(INPUT), F.col("f")["output"].alias(OUTPUT))


@query(f"""WITH {_sql_vote("SELECT user_id::VARCHAR AS input_col, event_type AS output_col, event_id AS pos FROM events", True)}
SELECT input_col, output_col, first_seen FROM w WHERE rn = 1""")
def streaming_votes(spark, sf_dir):
    """The events as a stream of answers in two parts: parse each, keep vote totals in the state, stop, go on, pick the winners."""
    import uuid

    folder = f"{shared_folder(spark)}/taskweave/stream-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events")
    for part in range(2):
        events.where(F.col("event_id") % 2 == part).write.mode("append").parquet(f"{folder}/events")
        arrived = spark.readStream.schema(events.schema).parquet(f"{folder}/events")
        answers = arrived.select(
            F.to_json(F.struct(F.col("user_id").alias("input"), F.col("event_type").alias("output"))).alias("content"), F.col("event_id").alias("seen")
        )
        run = (
            vote_totals_stream(parse_stream(answers), f"{folder}/totals", F.col("seen"))
            .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        )
        run.awaitTermination()
    return winners(current_totals(spark, f"{folder}/totals"))
