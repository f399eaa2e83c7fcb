"""Named queries on the test tables, each with the SQL that says the same, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskweave.functions.text import PY_SPACES, SPACE_CLASS, TOKEN
from taskweave.shipping import ship_package
from taskweave.sources.tables import spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = lambda spark, sf_dir: fn(ship_package(spark), sf_dir)
        if sql is not None:
            SQL[key] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """For queries that work hard on every row."""
    return spread(table(spark, sf_dir, name))


# SQL spellings of the text and draw expressions ------------------------------


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_strip(x: str) -> str:
    return f"trim({x}, {lit(PY_SPACES)})"


def sql_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {lit(SPACE_CLASS + '+')}), lambda w: w <> '')"


def sql_tokens(x: str) -> str:
    return f"regexp_extract_all({x}, {lit(TOKEN)})"


def sql_token_count(x: str) -> str:
    return f"len({sql_tokens(x)})::BIGINT"


def sql_mark(seed: object, *keys: str) -> str:
    return f"md5(concat_ws('~', {lit(str(seed))}, {', '.join(f'({k})::VARCHAR' for k in keys)}))"


def sql_draw(limit: str, seed: object, *keys: str) -> str:
    return f"(('0x' || substr({sql_mark(seed, *keys)}, 1, 15))::BIGINT % ({limit}))"


def sql_draw_distinct(k: str, n: str, seed: object, *keys: str) -> str:
    t = sql_draw("e[1] + 1", seed, *keys, "e[1]")
    return (
        f"list_reduce(list_transform(range(({n})::BIGINT - ({k})::BIGINT, ({n})::BIGINT), lambda j: [j]), "
        f"lambda acc, e: list_append(acc, CASE WHEN list_contains(acc, {t}) THEN e[1] ELSE {t} END), []::BIGINT[])"
    )


def sql_fill(template: str, **fields: str) -> str:
    parts, rest = [], template
    while True:
        hits = [(rest.index("{" + k + "}"), k) for k in fields if "{" + k + "}" in rest]
        if not hits:
            break
        at, key = min(hits)
        if at:
            parts.append(lit(rest[:at]))
        parts.append(f"({fields[key]})")
        rest = rest[at + len(key) + 2 :]
    if rest or not parts:
        parts.append(lit(rest))
    return " || ".join(parts)


# table pieces used by many queries --------------------------------------------

# a user turn and the assistant turn right after it
TURN_PAIRS = """turn_pairs AS (
  SELECT u.conv_id, u.turn, u.text AS input_col, a.text AS output_col
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""

# labelled documents with their position in key order
LABELLED = """labelled AS (
  SELECT d.doc_id, d.text AS input_col, l.quality AS output_col,
         row_number() OVER (ORDER BY d.doc_id) - 1 AS pos, count(*) OVER () AS n
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    users = turns.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("input_col"))
    replies = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output_col")
    )
    return users.join(replies, ["conv_id", "turn"])


def labelled(spark: SparkSession, sf_dir: str, read=table) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("input_col"))
    marks = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("output_col"))
    return docs.join(marks, "doc_id")
