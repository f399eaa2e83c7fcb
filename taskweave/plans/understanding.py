"""Jobs that turn one model answer per row into fields: parse prompts, expand queries, choose columns (M8-M10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskweave.functions import prompts as P
from taskweave.functions.parsing import last_object
from taskweave.operators.completion import CallSettings, ClientFactory, complete_until_parsed
from taskweave.operators.pairs import selection_problem

SINGLE = CallSettings(responses=1, temperature=0.01)


def parse_prompts(prompts: DataFrame, factory: ClientFactory, tries: int = 5, calls: CallSettings = SINGLE) -> DataFrame:
    """(prompt_id, instruction, examples) from (prompt_id, text)."""
    asked = prompts.select("prompt_id", P.parsing_prompt(F.col("text")).alias("prompt"))
    parsed = complete_until_parsed(
        asked, factory, lambda c: last_object(c, ["Instruction", "Demonstrations"]), tries, calls
    )
    return parsed.select("prompt_id", F.col("parsed")["Instruction"].alias("instruction"), F.col("parsed")["Demonstrations"].alias("examples"))


def expand_queries(queries: DataFrame, factory: ClientFactory, tries: int = 5, calls: CallSettings = SINGLE) -> DataFrame:
    """(query_id, text) where the text is an imagined description instead of the instruction."""
    asked = queries.select(F.col("query_id").alias("prompt_id"), P.imagined_model_prompt(F.col("text")).alias("prompt"))
    answered = complete_until_parsed(asked, factory, lambda c: F.when(c != "", c), tries, calls)
    return answered.select(F.col("prompt_id").alias("query_id"), F.col("parsed").alias("text"))


def _names(text):
    return F.from_json(text, "array<string>")


def select_columns(tables: DataFrame, factory: ClientFactory, tries: int = 5, calls: CallSettings = SINGLE) -> DataFrame:
    """(prompt_id, inputs, output, problem) from (prompt_id, instruction, name, description, columns, sample_row).

    ``problem`` says why a proposal cannot be used; ``inputs`` and ``output`` are NULL then.
    """
    asked = tables.select(
        "prompt_id",
        P.column_selection_prompt(*[F.col(c) for c in ("instruction", "name", "description", "columns", "sample_row")]).alias("prompt"),
    )
    parsed = complete_until_parsed(
        asked, factory, lambda c: last_object(c, ["input", "output"], ["ambiguous", "irrelevant"]), tries, calls
    )
    proposal = parsed.join(tables.select("prompt_id", "columns"), "prompt_id").select(
        "prompt_id", _names(F.col("parsed")["input"]).alias("i"), _names(F.col("parsed")["output"]).alias("o"), "columns"
    )
    problem = selection_problem(F.col("i"), F.col("o"), F.col("columns"))
    fine = problem.isNull()
    return proposal.select(
        "prompt_id", F.when(fine, F.col("i")).alias("inputs"), F.when(fine, F.get("o", F.lit(0))).alias("output"), problem.alias("problem")
    )
