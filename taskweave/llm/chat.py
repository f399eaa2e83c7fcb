"""Operator 2, chat formatting: one training example for every assistant turn.

Only built-in expressions are used. Every assistant turn becomes an example of its own: all turns before it as
context, the turn itself as the only text under the loss mask. Turns that follow the last assistant turn (or a
conversation without any) become one more example with an empty mask, so that nothing of the input is lost.

The template is ``<|turn|>role<|text|>text<|end|>`` for each turn. A backslash is put inside every control string
that occurs in a role or a text and backslashes are doubled, so that markers are found by plain search and the
original comes back by dropping one backslash of each pair.

Defined results: a null role or text counts as empty; rows of one conversation are ordered by turn (null first),
then role, then text, repeated rows stay; conversations with a null id form one conversation; other columns are
ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taskweave.contracts import require_columns
from taskweave.llm.registry import query, table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# fixed values: control strings of common chat templates, which a text must not be able to imitate
CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chat(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv_id, example, formatted, loss_start, loss_end`` (code points, end exclusive; equal for an empty mask)."""
    require_columns(turns, conv, turn, role, text)
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    body = escape(F.col("text"))
    shown = rows.select(
        "*",
        F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT), body, F.lit(END)).alias("shown"),
        F.length(body).cast("long").alias("body"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = shown.select(
        "conv_id",
        F.struct(
            F.row_number().over(order).cast("long").alias("example"),
            (F.col("role") == "assistant").alias("trained"),
            F.sum(F.length("shown")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("end"),
            "body",
            "shown",
        ).alias("t"),
    )
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    n = F.size("ts")
    examples = whole.select(
        "conv_id",
        F.array_join(F.transform("ts", lambda t: t["shown"]), "").alias("whole"),
        F.explode(
            F.transform(
                F.filter("ts", lambda t: t["trained"] | (t["example"] == n)),
                lambda t: F.struct(t["example"], t["trained"], t["end"], t["body"]),
            )
        ).alias("t"),
    )
    stop = F.when(F.col("t.trained"), F.col("t.end") - len(END)).otherwise(F.lit(0))
    return examples.select(
        "conv_id",
        F.col("t.example").alias("example"),
        F.substring("whole", F.lit(1), F.col("t.end").cast("int")).alias("formatted"),
        F.when(F.col("t.trained"), stop - F.col("t.body")).otherwise(F.lit(0)).cast("long").alias("loss_start"),
        stop.cast("long").alias("loss_end"),
    )


def masked_text(formatted: Column, start: Column, end: Column) -> Column:
    return unescape(F.substring(formatted, (start + 1).cast("int"), (end - start).cast("int")))


def parse_chat(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    parts = F.slice(F.split(formatted, r"<\|end\|>"), F.lit(1), F.size(F.split(formatted, r"<\|end\|>")) - 1)

    def turn(part: Column) -> Column:
        at = F.locate(TEXT, part)
        role = F.substring(part, F.lit(len(TURN) + 1), at - len(TURN) - 1)
        return F.struct(
            unescape(role).alias("role"), unescape(F.substring(part, at + len(TEXT), F.length(part))).alias("text")
        )

    return F.transform(parts, turn)


def read_back(examples: DataFrame) -> DataFrame:
    """Digests of each conversation, from the formatted examples alone."""
    per = examples.select(
        "conv_id",
        "example",
        "formatted",
        masked_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss"),
    )
    whole = per.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda e: e["loss"]), ""
        ).alias("loss"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    parsed = whole.select("*", parse_chat(F.col("longest")).alias("turns"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table and one planted conversation that imitates control strings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.sql(
        "SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]')"
        " AS t(conv_id, turn, role, text)"
    )
    return turns.unionByName(planted)


_ESCAPED = "replace({x}, '\\', '\\\\')"
for _m in CONTROL:
    _ESCAPED = f"replace({_ESCAPED}, '{_m}', '{_m[0]}\\{_m[1:]}')"

OP2_SQL = f"""
WITH all_turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
placed AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
         sum({len(TURN + TEXT + END)} + length({_ESCAPED.format(x="role")}) + length({_ESCAPED.format(x="text")}))
           OVER (w ROWS UNBOUNDED PRECEDING) AS stop
  FROM all_turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(stop) FILTER (role = 'assistant' OR i = n))::BIGINT AS formatted_chars
FROM placed GROUP BY conv_id
"""


@query(OP2_SQL)
def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(format_chat(conversations(spark, sf_dir)))
