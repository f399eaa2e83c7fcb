"""Synthetic pairs in rounds: sample examples, ask, parse, vote, until enough or out of calls (M5, J6).

All tasks of a table advance together: a round is one set of Spark jobs, whatever the number of tasks. Rounds append what
they change to tables; nothing that earlier rounds settled is computed again.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from itertools import count

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taskweave.contracts import INPUT, OUTPUT, TaskSpec, require_columns
from taskweave.functions import prompts as P
from taskweave.functions.draws import draw, draw_distinct
from taskweave.functions.parsing import strict_pair
from taskweave.operators.completion import CallSettings, ClientFactory, complete
from taskweave.operators.pairs import concatenate
from taskweave.operators.voting import vote_counts, winners
from taskweave.staging import Grown, stage


@dataclass(frozen=True)
class GenerationSettings:
    initial_temperature: float = 0.5
    max_temperature: float = 1.7
    max_batch_size: int = 5
    responses_per_request: int = 5
    requests_per_minute: float | None = 80
    multi_vote: bool = True
    context_cutoff: int = 3500
    max_rounds: int | None = None  # None: as many as the goals and the calls allow
    max_idle_rounds: int = 20  # rounds in a row that bring a task no new pair
    seed: int | str = 2023
    max_tokens: int | None = 4000
    wait_seconds: float = 10.0

    def __post_init__(self):
        if not 0 <= self.initial_temperature <= self.max_temperature <= 2:
            raise ValueError("temperatures must satisfy 0 <= initial <= max <= 2")

    def calls(self) -> CallSettings:
        return CallSettings(
            responses=self.responses_per_request, requests_per_minute=self.requests_per_minute,
            max_tokens=self.max_tokens, wait_seconds=self.wait_seconds,
        )


def with_sampled_lines(
    prompts: DataFrame, pool: DataFrame, seed: int | str, by: str = "task_id", version: str | None = None
) -> DataFrame:
    """Give each prompt an array ``lines`` of one to ten random pool examples (none while the pool is empty).

    ``prompts``: (task_id, prompt_id, have, ...) with the size of the task's pool; ``pool``: (task_id, pos, line) with
    dense positions. Positions are drawn by arithmetic and fetched by an equi-join, so no prompt ever meets the
    whole pool. A prompt collects ten lines at most. Where the pool has several lines for a position, that with the largest
    ``version`` counts.
    """
    k = F.when(F.col("have") > 0, 1 + draw(F.least(F.col("have"), F.lit(P.MAX_SAMPLED)), f"{seed}-k", F.col("prompt_id"))).otherwise(F.lit(0))
    drawn = prompts.withColumn("_draws", draw_distinct(k, F.col("have"), f"{seed}-draw", F.col("prompt_id")))
    picks = drawn.select(by, "prompt_id", F.posexplode_outer("_draws").alias("slot", "pos"))
    found = picks.join(pool, [by, "pos"])
    if version:
        found = found.groupBy("prompt_id", "slot").agg(F.max_by("line", version).alias("line"))
    lines = found.groupBy("prompt_id").agg(F.array_sort(F.collect_list(F.struct("slot", "line"))).alias("_l"))
    return (
        drawn.join(lines, "prompt_id", "left")
        .withColumn("lines", F.coalesce(F.col("_l.line"), F.array().cast("array<string>")))
        .drop("_draws", "_l")
    )


OPEN, DONE, SPENT, TOO_LONG, STALLED, UNFINISHED = (
    "open", "done", "no calls left", "instruction too long", "no new pairs", "out of rounds"
)
_STATUS = ("task_id", "instruction", "examples", "num_examples", "max_calls", "calls", "have", "idle", "state")


def generate(
    tasks: DataFrame, factory: ClientFactory, settings: GenerationSettings = GenerationSettings(), strict: bool = False
) -> DataFrame:
    """(task_id, pos, input_col, output_col) for a table of (task_id, instruction, examples, num_examples[, max_calls]).

    ``max_calls`` NULL or absent means no limit on calls.
    """
    return generate_with_status(tasks, factory, settings, strict)[0]


def generate_with_status(
    tasks: DataFrame, factory: ClientFactory, settings: GenerationSettings = GenerationSettings(), strict: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The pairs of ``generate`` and how each task ended: (task_id, num_examples, calls, have, state).

    A task that cannot go on ends alone, with what it has: its calls are spent, its instruction leaves no room in a prompt,
    or ``max_idle_rounds`` rounds in a row brought it no new pair. ``strict`` raises then, after all tasks have ended.

    Between rounds three things are kept, and a round adds to them: the status, a row per task; the vote counts of each
    round; and the pool, where a pair keeps the place at which its input first appeared. A round votes again on the inputs that
    its answers touched, and appends their winners, so its plan is the same in every round.
    """
    require_columns(tasks, "task_id", "instruction", "examples", "num_examples")
    spark = tasks.sparkSession
    if "max_calls" not in tasks.columns:
        tasks = tasks.withColumn("max_calls", F.lit(None).cast("bigint"))
    zero = F.lit(0).cast("bigint")
    fresh_state = tasks.withColumns({"calls": zero, "have": zero, "idle": F.lit(0), "state": F.lit(OPEN)})
    status = stage(_ended(fresh_state, settings).select(*_STATUS), "status")
    task_type = tasks.schema["task_id"].dataType.simpleString()
    votes = Grown(spark, "votes", f"task_id {task_type}, {INPUT} string, {OUTPUT} string, n bigint, first_seen bigint")
    pool = Grown(spark, "pool", f"task_id {task_type}, pos bigint, {INPUT} string, {OUTPUT} string, new boolean")

    for round_no in count() if settings.max_rounds is None else range(settings.max_rounds):
        prompts = stage(_prompts_of_round(status, pool, settings, round_no), "prompts")
        if prompts.isEmpty():
            break
        asked = prompts.where("fits")
        answers = complete(asked.drop("fits"), factory, settings.calls())
        # order of appearance: round, then prompt, then choice
        seen = F.lit(round_no << 40) + F.shiftleft(F.col("number").cast("bigint"), 20) + F.col("choice")
        pairs = (
            answers.withColumn("pair", strict_pair(F.col("content"))).where(F.col("pair").isNotNull())
            .join(asked.select("prompt_id", "task_id", "number"), "prompt_id")
            .select("task_id", F.col("pair.input").alias(INPUT), F.col("pair.output").alias(OUTPUT), seen.alias("seen"))
        )
        if settings.multi_vote:
            votes.add(vote_counts(pairs, F.col("seen"), by=("task_id",)), round_no)
            changed = _voted_again(votes, pool, round_no)
        else:
            changed = pairs.select("task_id", INPUT, OUTPUT, F.col("seen").alias("first_seen"), F.lit(None).cast("bigint").alias("pos"))
        pool.add(_placed(changed, status), round_no)
        status = stage(_after_round(status, prompts, pool.part(round_no), settings), "status")

    state = F.when(F.col("state") == OPEN, UNFINISHED).otherwise(F.col("state"))
    status = status.select("task_id", "num_examples", "calls", "have", state.alias("state"))
    if strict:
        _refuse(status)
    goals = status.select("task_id", "num_examples")
    pairs = pool.read().join(goals, "task_id").where(F.col("pos") < F.col("num_examples"))
    return _latest(pairs, "task_id", "pos").select("task_id", "pos", INPUT, OUTPUT), status


def _ended(status: DataFrame, settings: GenerationSettings) -> DataFrame:
    """Close the open tasks that have what they want or cannot ask any more."""
    state = (
        F.when(F.col("state") != OPEN, F.col("state"))
        .when(F.col("have") >= F.col("num_examples"), DONE)
        .when(F.col("calls") >= F.col("max_calls"), SPENT)
        .when(F.col("idle") >= settings.max_idle_rounds, STALLED)
        .otherwise(OPEN)
    )
    return status.withColumn("state", state)


def _latest(pool: DataFrame, *place: str) -> DataFrame:
    """The pair that is valid for each place, of all that rounds have written there."""
    return pool.groupBy(*place).agg(F.max_by(F.struct(INPUT, OUTPUT), "part").alias("_p")).select(*place, "_p.*")


def _prompts_of_round(status: DataFrame, pool: Grown, settings: GenerationSettings, round_no: int) -> DataFrame:
    left = F.coalesce(F.col("max_calls") - F.col("calls"), F.lit(settings.max_batch_size))
    missing = F.ceil((F.col("num_examples") - F.col("have")) / settings.responses_per_request)
    active = status.where(F.col("state") == OPEN).withColumn("batch", F.least(F.lit(settings.max_batch_size), missing, left).cast("int"))
    warmth = (settings.max_temperature - settings.initial_temperature) * F.col("have") / F.col("num_examples") + settings.initial_temperature
    asked = (
        active.withColumn("temperature", F.greatest(F.lit(0.0), F.least(F.lit(2.0), warmth)))
        .withColumn("number", F.explode(F.sequence(F.lit(0), F.col("batch") - 1)))
        .withColumn("prompt_id", F.concat_ws("~", F.col("task_id").cast("string"), F.lit(str(round_no)), F.col("number").cast("string")))
    )
    lines = pool.read().select("task_id", "pos", "part", P.example_line(F.col(INPUT), F.col(OUTPUT)).alias("line"))
    sampled = with_sampled_lines(asked, lines, settings.seed, version="part")
    built = P.with_generation_prompt(sampled, settings.context_cutoff, settings.seed)
    return built.select("task_id", "number", "prompt_id", "temperature", F.col("task_id").alias("batch_id"), "prompt", "fits")


def _voted_again(votes: Grown, pool: Grown, round_no: int) -> DataFrame:
    """(task_id, input, output, first_seen, pos) of the inputs that the round touched; ``pos`` is NULL for new ones."""
    item = ["task_id", INPUT]
    touched = votes.part(round_no).select(*item).distinct()
    known = votes.read().join(touched, item, "left_semi")
    merged = known.groupBy(*item, OUTPUT).agg(F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"))
    places = pool.read().where("new").select(*item, "pos")
    return winners(merged, by=("task_id",)).join(places, item, "left")


def _placed(changed: DataFrame, status: DataFrame) -> DataFrame:
    """Pool rows: new inputs follow those their task has, in order of appearance (a round brings a task few of them)."""
    new = F.col("pos").isNull()
    order = Window.partitionBy("task_id", new).orderBy("first_seen", INPUT)
    at = F.col("have") + F.row_number().over(order) - 1
    have = status.select("task_id", "have")
    return changed.join(have, "task_id").select("task_id", F.coalesce("pos", at).alias("pos"), INPUT, OUTPUT, new.alias("new"))


def _after_round(status: DataFrame, prompts: DataFrame, gained: DataFrame, settings: GenerationSettings) -> DataFrame:
    asked = prompts.groupBy("task_id").agg(F.sum(F.col("fits").cast("bigint")).alias("asked"))
    got = gained.groupBy("task_id").agg(F.sum(F.col("new").cast("bigint")).alias("more"))
    told = status.join(asked, "task_id", "left").join(got, "task_id", "left").fillna(0, ["more"])
    idle = F.when(F.col("asked") > 0, F.when(F.col("more") > 0, 0).otherwise(F.col("idle") + 1)).otherwise(F.col("idle"))
    moved = told.withColumns(
        {
            "calls": F.col("calls") + F.coalesce("asked", F.lit(0)),
            "have": F.col("have") + F.col("more"),
            "idle": idle,
            "state": F.when(F.col("asked") == 0, TOO_LONG).otherwise(F.col("state")),
        }
    )
    return _ended(moved, settings).select(*_STATUS)


def _refuse(status: DataFrame) -> None:
    """Raise, naming some of the tasks that are short of their goal."""
    short = status.where((F.col("state") != DONE) & (F.col("state") != SPENT)).orderBy("task_id").head(5)
    if short:
        raise RuntimeError("tasks are short of pairs: " + ", ".join(f"{r['task_id']} ({r['state']})" for r in short))


def generate_splits(
    spark: SparkSession,
    spec: TaskSpec,
    sizes: Mapping[str, int],
    factory: ClientFactory,
    settings: GenerationSettings = GenerationSettings(),
    max_calls: int | None = None,
    strict: bool = False,
) -> DataFrame:
    """(split, pos, input_col, output_col). The splits are made one after the other and share one budget of calls."""
    if max_calls is not None and max_calls <= 0:
        raise ValueError("max_calls must be above 0")
    left, parts = max_calls, []
    for split, n in sizes.items():
        row = [(split, spec.instruction, spec.examples, n, left)]
        tasks = spark.createDataFrame(row, "task_id string, instruction string, examples string, num_examples bigint, max_calls bigint")
        pairs, status = generate_with_status(tasks, factory, settings, strict)
        if left is not None:
            left -= sum(r["calls"] for r in status.collect())  # one task, so one row at most
        parts.append(pairs.withColumnRenamed("task_id", "split"))
    return concatenate(parts)
