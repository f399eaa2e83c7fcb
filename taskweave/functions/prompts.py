"""Prompt texts as column expressions: F5-F12.

The wording is a parameter everywhere: templates are plain strings with named holes, filled by ``fill``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskweave.functions.draws import draw_distinct
from taskweave.functions.text import fill, let, token_count

SECTION = "\n\n======\n\n"

# --- synthetic examples ------------------------------------------------------

GENERATE_LEAD = (
    "You write new examples for a task. Study the solved tasks below, then the task at the end, and answer with one "
    'JSON object that has the keys "input" and "output" and nothing else.'
)

# Each shows one solved task; every prompt draws four of them and shows two, three or four.
SOLVED_TASKS = (
    'task: Name the continent a country lies on.\ninput="Kenya"\noutput="Africa"',
    'task: Rewrite the sentence in the past tense.\ninput="She walks to the station."\noutput="She walked to the station."',
    'task: Say whether the review is happy or unhappy.\ninput="Broke after two days."\noutput="unhappy"',
    'task: Give the next number of the series.\ninput="2, 4, 8, 16"\noutput="32"',
    'task: Pick the word that does not belong.\ninput="oak, maple, granite, birch"\noutput="granite"',
    'task: Turn the measure into metres.\ninput="3 km"\noutput="3000 m"',
)

GENERATE_TASK = (
    "task: {instruction}\nGood examples:\n{examples}\nFurther examples, of mixed quality:\n{sampled}\nNew example as JSON:"
)

MAX_SAMPLED = 10
NO_LINES = "N/A\n"
# Solved tasks shown by the number of sampled examples modulo three.
SHOWN_BY_REMAINDER = {0: 2, 2: 3, 1: 4}


def example_line(input_col: Column, output_col: Column) -> Column:
    return F.concat(F.lit('input="'), input_col, F.lit('"\noutput="'), output_col, F.lit('"\n'))


def _shown_tasks(count: int, drawn: Column, solved: Sequence[str]) -> Column:
    """The first ``count`` of the four solved tasks drawn for a prompt."""
    texts = F.array(*[F.lit(t) for t in solved])
    return F.array_join(F.transform(F.slice(drawn, 1, count), lambda i: F.get(texts, i.cast("int"))), "\n\n")


def with_generation_prompt(
    df: DataFrame, cutoff: int, seed: int | str,
    lead: str = GENERATE_LEAD, solved: Sequence[str] = SOLVED_TASKS, task: str = GENERATE_TASK,
) -> DataFrame:
    """Add ``prompt``, ``n_used`` and ``fits`` to (prompt_id, instruction, examples, lines).

    Takes the largest number of the sampled example lines whose prompt stays below ``cutoff`` tokens. ``fits`` is
    false when even the prompt without sampled examples is too long; the prompt is then that one.
    """
    case = lambda sampled: fill(task, instruction=F.col("instruction"), examples=F.col("examples"), sampled=sampled)
    heads = [
        F.concat(F.lit(lead + SECTION), _shown_tasks(SHOWN_BY_REMAINDER[r], F.col("_solved"), solved), F.lit(SECTION)) for r in range(3)
    ]
    head_for = lambda heads, m: F.get(heads, m % 3)
    # pieces meet at line ends, where no token spans both sides, so counts add up
    sized = (
        df.withColumn("_solved", draw_distinct(F.lit(4), F.lit(len(solved)), f"{seed}-solved", F.col("prompt_id")))
        .withColumn("_heads", F.array(*heads))
    )
    # counted once per row: a column used inside a lambda would be counted again for every element
    counts = F.struct(
        token_count(case(F.lit(""))).alias("fixed"),
        F.transform("_heads", token_count).alias("heads"),
        F.transform("lines", token_count).alias("lines"),
    )

    def fitting(c: Column) -> Column:
        def size_with(m: Column) -> Column:
            used = F.aggregate(F.slice(c["lines"], F.lit(1), m), F.lit(0).cast("bigint"), lambda a, x: a + x)
            return c["fixed"] + head_for(c["heads"], m) + F.when(m == 0, token_count(F.lit(NO_LINES))).otherwise(used)

        return F.filter(F.sequence(F.lit(0), F.size(c["lines"])), lambda m: size_with(m) < cutoff)

    n = F.col("n_used")
    sampled = F.when(n == 0, F.lit(NO_LINES)).otherwise(F.array_join(F.slice("lines", F.lit(1), n), ""))
    return (
        sized.withColumn("_fitting", let(counts, fitting))
        .withColumns({"n_used": F.coalesce(F.array_max("_fitting"), F.lit(0)), "fits": F.size("_fitting") > 0})
        .withColumn("prompt", F.concat(head_for("_heads", n), case(sampled)))
        .drop("_solved", "_heads", "_fitting")
    )


# --- reranking ---------------------------------------------------------------

RANK_DATASETS = (
    "Below are a task and {count} data sets. Name the data set that would teach the task best, between double stars."
    + SECTION + "Task: {instruction}\nExamples:\n{examples}\n\nData sets:\n{items}\nThe best data set is:"
)
RANK_CONFIGS = (
    "Below are a task and {count} parts of the data set {dataset} ({description}). Name the part that would teach the task "
    "best, between double stars." + SECTION + "Task: {instruction}\nExamples:\n{examples}\n\nParts:\n{items}\nThe best part is:"
)


def dataset_item(number: Column, name: Column, description: Column, tags: Column) -> Column:
    return F.concat(
        F.lit("["), number.cast("string"), F.lit("] **"), name, F.lit("** "), F.coalesce(description, F.lit("")),
        F.lit("\n    tags: "), F.coalesce(F.array_join(tags, ", "), F.lit("")),
    )


def config_item(number: Column, name: Column, columns: Column, sample_row: Column) -> Column:
    letter = F.chr(F.lit(ord("a")) + number - 1)
    return F.concat(
        F.lit("["), letter, F.lit("] **"), name, F.lit("**\n    columns: "), F.array_join(columns, ", "),
        F.lit("\n    first row: "), F.coalesce(sample_row, F.lit("")),
    )


def listed(items: Column) -> Column:
    """Join collected (number, text) structs in order of their number."""
    return F.array_join(F.transform(F.array_sort(items), lambda x: x["text"]), "\n")


# --- column selection --------------------------------------------------------

SELECT_LEAD = (
    "Choose the columns of a data set that serve a task: one or more input columns and exactly one output column. Answer "
    'with a JSON object with the lists "input", "output", "irrelevant" and "ambiguous".'
)
SELECT_CASE = (
    "Task: {instruction}\nData set: {name}\nAbout: {description}\nColumns: {columns}\nFirst row: {sample_row}\nChosen columns:"
)
SELECT_SHOWN = (
    (
        {
            "instruction": "Answer a question about a short text.", "name": "reading_club",
            "description": "Questions on short stories with the passage that answers them.",
            "columns": "story, question, reply, story_id",
            "sample_row": '{"story": "The cat slept.", "question": "Who slept?", "reply": "the cat", "story_id": "17"}',
        },
        '{"input": ["story", "question"], "output": ["reply"], "irrelevant": ["story_id"], "ambiguous": []}',
    ),
)


def column_selection_prompt(instruction: Column, name: Column, description: Column, columns: Column, sample_row: Column) -> Column:
    """``columns`` is an array of names."""
    shown = [SELECT_CASE.format(**case) + "\n" + answer for case, answer in SELECT_SHOWN]
    case = fill(
        SELECT_CASE, instruction=instruction, name=name, description=F.coalesce(description, F.lit("")),
        columns=F.array_join(columns, ", "), sample_row=F.coalesce(sample_row, F.lit("")),
    )
    return F.concat(F.lit(SECTION.join([SELECT_LEAD, *shown]) + SECTION), case)


# --- explaining, planning, transforming ---------------------------------------

EXPLAIN = (
    "Someone who has never seen this task will have to do it. Tell them in one paragraph what they are given and what they "
    "must hand back." + SECTION + "Task: {instruction}\nExamples:\n{examples}\n"
)
PLAN = (
    "Write a numbered plan that turns rows of a table into examples of a task." + SECTION
    + "Task: {task}\nExamples of the task:\n{examples}\nRows of the table:\n{rows}\nPlan:"
)
TRANSFORM = (
    'Follow the plan to turn the row into one example of the task. Answer with a JSON object with "input" and "output".' + SECTION
    + "Task: {task}\nExamples of the task:\n{examples}\nPlan:\n{plan}\nRow:\n{row}\nExample as JSON:"
)
PLAN_ROWS = 5


def explanation_prompt(instruction: Column, examples: Column) -> Column:
    return fill(EXPLAIN, instruction=instruction, examples=examples)


def plan_prompt(task: Column, examples: Column, rows: Column) -> Column:
    """``rows``: array of row texts in order."""
    lines = F.array_join(F.transform(rows, lambda r: F.concat(r, F.lit("\n"))), "\n")
    return fill(PLAN, task=task, examples=examples, rows=lines)


def transform_prompt(task: Column, examples: Column, plan: Column, row: Column) -> Column:
    return fill(TRANSFORM, task=task, examples=examples, plan=plan, row=row)


# --- parsing a user's prompt, imagining a model description -------------------

PARSE_LEAD = (
    "Separate the user's prompt into what is to be done and the demonstrations it gives. Answer with a JSON object with the keys "
    '"Instruction" and "Demonstrations"; "Demonstrations" is "N/A" when the prompt shows none.'
)
PARSE_SHOWN = (
    (
        "Tell me the capital of a country. For example:\nFrance -> Paris",
        '{"Instruction": "Tell me the capital of a country.", "Demonstrations": "France -> Paris"}',
    ),
    ("Shorten the text to one sentence.", '{"Instruction": "Shorten the text to one sentence.", "Demonstrations": "N/A"}'),
)
PARSE_CASE = "The prompt:\n<<<\n{prompt}\n>>>\nIts parts as JSON:\n"
IMAGINE = (
    "Write the catalogue card of a model made for the work below: its kind, the data it saw, and its use.\n"
    'Work: "{instruction}"\nCard:\n'
)


def parsing_prompt(prompt: Column) -> Column:
    shown = [PARSE_CASE.format(prompt=p) + answer for p, answer in PARSE_SHOWN]
    return F.concat(F.lit(SECTION.join([PARSE_LEAD, *shown]) + SECTION), fill(PARSE_CASE, prompt=prompt))


def imagined_model_prompt(instruction: Column) -> Column:
    return fill(IMAGINE, instruction=instruction)
