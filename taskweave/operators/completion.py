"""Ask a language model from a table of prompts: M1, M2.

The model itself is the user's: a *client factory* is called once per task and
returns ``ask(prompt, n, temperature, max_tokens) -> list of n texts``. Answers are written to
the shared folder before anything reads them, so no call is repeated by a recomputed plan.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taskweave.contracts import require_columns
from taskweave.functions.text import token_count
from taskweave.operators.tokenize import completion_budget
from taskweave.staging import stage

Ask = Callable[[str, int, float, int], list[str]]
ClientFactory = Callable[[], Ask]

# Fixed value: what a prompt gets that the provider refuses.
FILTERED = "Invalid Request: Prompt was filtered"
NO_ROOM = "the prompt leaves no room for an answer"
_ANSWERS = "prompt_id {id}, choice int, content string, error string"
# prompts of one commit when answers are kept under a path: what a broken job may have to pay twice
CHUNK = 10_000


class PromptRefused(Exception):
    """Raised by a client when the provider refuses a prompt; it is not tried again."""


@dataclass(frozen=True)
class CallSettings:
    responses: int = 5
    temperature: float = 1.0
    requests_per_minute: float | None = 80
    max_tokens: int | None = 4000
    token_buffer: int = 300
    tries: int = 3
    wait_seconds: float = 10.0
    threads: int = 4  # calls in flight per task


class _Pace:
    """At most ``limit`` starts in any minute, counted per task."""

    def __init__(self, limit: float | None):
        self.limit, self.starts = limit, deque()

    def wait(self) -> None:
        if self.limit is None:
            return
        while True:
            now = time.monotonic()
            while self.starts and now - self.starts[0] >= 60:
                self.starts.popleft()
            if len(self.starts) + 1 <= max(1.0, self.limit):
                self.starts.append(now)
                return
            time.sleep(60 - (now - self.starts[0]))


def answer_prompt(ask: Ask, prompt: str, temperature: float, budget: int, s: CallSettings) -> list[tuple[int, str, str | None]]:
    """(choice, content, error) rows for one prompt, after up to ``s.tries`` attempts."""
    if budget <= 0:
        return [(0, "", NO_ROOM)]
    error = None
    for attempt in range(s.tries):
        try:
            return [(i, text, None) for i, text in enumerate(ask(prompt, s.responses, temperature, budget))]
        except PromptRefused as e:
            return [(0, FILTERED, str(e) or "refused")]
        except Exception as e:  # any provider error: the prompt fails alone, not the task
            error = f"{type(e).__name__}: {e}"
            if attempt + 1 < s.tries:
                time.sleep(s.wait_seconds)
    return [(0, "", error)]


def _caller(factory: ClientFactory, s: CallSettings, share: float | None):
    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask, pace = factory(), _Pace(share)

        def one(row):
            answers = answer_prompt(ask, row.prompt, row.temperature, int(row.budget), s)
            return [(row.prompt_id, *a) for a in answers]

        with ThreadPoolExecutor(max(1, s.threads)) as pool:
            for batch in batches:
                futures = []
                for row in batch.itertuples(index=False):
                    pace.wait()
                    futures.append(pool.submit(one, row))
                rows = [r for f in futures for r in f.result()]
                yield pd.DataFrame(rows, columns=["prompt_id", "choice", "content", "error"])

    return call


def complete(
    prompts: DataFrame, factory: ClientFactory, settings: CallSettings = CallSettings(), path: str | None = None,
    count: Callable[[Column], Column] = token_count, chunk: int = CHUNK,
) -> DataFrame:
    """(prompt_id, choice, content, error) for a table of (prompt_id, prompt[, temperature, batch_id]).

    A refused prompt gets the marker text, a failing one the empty text; neither fails the others. A prompt's own length by
    the token counter ``count`` sets its completion budget; with ``batch_id``, the longest prompt of the batch sets that of all.
    A prompt that leaves no room is not asked and gets an error.

    With ``path``, answers are kept in that table, ``chunk`` prompts to a commit. A prompt that has an answer there, or was
    refused, under the same id, text, temperature, budget and number of responses is not asked again; failed and changed
    prompts are. Only answers to ``prompts`` are returned.
    """
    require_columns(prompts, "prompt_id", "prompt")
    spark = prompts.sparkSession
    schema = _ANSWERS.format(id=prompts.schema["prompt_id"].dataType.simpleString())
    sized = prompts.withColumn("n_tokens", count(F.col("prompt")))
    if "batch_id" in prompts.columns:
        longest = sized.groupBy("batch_id").agg(F.max("n_tokens").alias("longest"))
        sized = sized.join(longest, "batch_id")
    else:
        sized = sized.withColumn("longest", F.col("n_tokens"))
    temperature = F.col("temperature") if "temperature" in prompts.columns else F.lit(float(settings.temperature))
    budget = completion_budget(F.col("longest"), settings.max_tokens, settings.token_buffer)
    tasks = spark.sparkContext.defaultParallelism
    share = None if settings.requests_per_minute is None else settings.requests_per_minute / tasks
    if share is not None and share < 1:
        # fewer tasks than slots, so that the shares still add up to the limit
        tasks, share = max(1, int(settings.requests_per_minute)), 1.0
    asked = sized.select("prompt_id", "prompt", temperature.cast("double").alias("temperature"), budget.cast("bigint").alias("budget"))

    def answer(rows: DataFrame) -> DataFrame:
        return rows.repartition(tasks, "prompt_id").mapInPandas(_caller(factory, settings, share), schema)

    if path is None:
        return stage(answer(asked), "answers")
    mark = F.md5(F.to_json(F.struct("prompt", "temperature", "budget", F.lit(settings.responses).alias("n")))).alias("asked_as")
    asked = stage(asked.withColumn("asked_as", mark), "asked")
    kept_as = f"{schema}, asked_as string"
    if _exists(spark, path):
        good = spark.read.schema(kept_as).parquet(path).where(F.col("error").isNull() | (F.col("content") == FILTERED))
        pending = asked.join(good.select("prompt_id", "asked_as").distinct(), ["prompt_id", "asked_as"], "left_anti")
    else:
        pending = asked
    chunks = -(-pending.count() // chunk)
    pending = pending.withColumn("part", F.pmod(F.xxhash64("prompt_id"), F.lit(max(chunks, 1))))
    if chunks:
        pending = stage(pending.repartition("part"), "pending", by="part")  # a chunk is read from its own files
    for part in range(chunks):
        rows = pending.where(F.col("part") == part)
        marks = rows.select("prompt_id", "asked_as")
        answer(rows.drop("asked_as", "part")).join(marks, "prompt_id").select(*schema_names(kept_as)).write.mode("append").parquet(path)
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    kept = spark.read.schema(kept_as).parquet(path).join(asked.select("prompt_id", "asked_as"), ["prompt_id", "asked_as"], "left_semi")
    # an earlier failure stays in the table beside the answer that came later
    answered = F.max(F.col("error").isNull() | (F.col("content") == FILTERED)).over(Window.partitionBy("prompt_id"))
    usable = kept.withColumn("_answered", answered).where(
        F.col("error").isNull() | (F.col("content") == FILTERED) | ~F.col("_answered")
    )
    return usable.select(*schema_names(schema)).dropDuplicates(["prompt_id", "choice"])


def schema_names(ddl: str) -> list[str]:
    return [field.strip().split(" ")[0] for field in ddl.split(",")]


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether something was written to ``path``; any other trouble in reading it is raised."""
    try:
        spark.read.format("binaryFile").load(f"{path}/_SUCCESS").select("path").head(1)
        return True
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def complete_until_parsed(
    prompts: DataFrame,
    factory: ClientFactory,
    parse: Callable[[Column], Column],
    tries: int = 5,
    settings: CallSettings = CallSettings(responses=1, temperature=0.01),
    strict: bool = False,
) -> DataFrame:
    """(prompt_id, parsed): ask, parse, and ask the unparsed prompts again, up to ``tries`` rounds.

    Prompts given up on have a NULL, or raise when ``strict``.
    """
    if tries <= 0:
        raise ValueError("tries must be above 0")
    prompts = stage(prompts.select("prompt_id", "prompt"), "prompts")
    pending, done = prompts, None
    for _ in range(tries):
        answers = complete(pending, factory, settings)
        parsed = answers.where(F.col("choice") == 0).select("prompt_id", parse(F.col("content")).alias("parsed"))
        parsed = parsed.where(F.col("parsed").isNotNull())
        done = parsed if done is None else done.unionByName(parsed)
        pending = prompts.join(done.select("prompt_id"), "prompt_id", "left_anti")
        if pending.isEmpty():
            return done
    if strict:
        raise RuntimeError("no usable answer within the allowed number of calls")
    return prompts.select("prompt_id").join(done, "prompt_id", "left")
