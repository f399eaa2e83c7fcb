"""Choose a dataset, then one of its configs, by votes of a model (M7)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskweave.functions import prompts as P
from taskweave.functions.draws import mark
from taskweave.functions.parsing import chosen_name
from taskweave.functions.text import fill
from taskweave.operators.completion import CallSettings, ClientFactory, complete
from taskweave.operators.positions import head_per_group
from taskweave.operators.voting import plurality

VOTES = CallSettings(responses=5, temperature=0.01)
MAX_CONFIGS = 10


def dataset_prompts(tasks: DataFrame, candidates: DataFrame) -> DataFrame:
    """One prompt per task from (task_id, pos, name, description, tags), ``pos`` from 1. A task has at most as many candidates as the search depth."""
    item = P.dataset_item(F.col("pos"), F.col("name"), F.col("description"), F.col("tags"))
    lists = candidates.groupBy("task_id").agg(
        F.collect_list(F.struct("pos", item.alias("text"))).alias("items"), F.count("*").alias("n")
    )
    prompt = fill(
        P.RANK_DATASETS, count=F.col("n").cast("string"), instruction=F.col("instruction"), examples=F.col("examples"), items=P.listed(F.col("items"))
    )
    return tasks.join(lists, "task_id").select(F.col("task_id").alias("prompt_id"), prompt.alias("prompt"))


def config_prompts(tasks: DataFrame, candidates: DataFrame) -> DataFrame:
    """One prompt per task from (task_id, pos, dataset, description, config, columns, sample_row); ten configs at most."""
    item = P.config_item(F.col("pos"), F.col("config"), F.col("columns"), F.col("sample_row"))
    lists = candidates.groupBy("task_id", "dataset", "description").agg(
        F.collect_list(F.struct("pos", item.alias("text"))).alias("items"), F.count("*").alias("n")
    )
    prompt = fill(
        P.RANK_CONFIGS, count=F.col("n").cast("string"), dataset=F.col("dataset"), description=F.coalesce("description", F.lit("")),
        instruction=F.col("instruction"), examples=F.col("examples"), items=P.listed(F.col("items")),
    )
    return tasks.join(lists, "task_id").select(F.col("task_id").alias("prompt_id"), prompt.alias("prompt"))


def vote_names(prompts: DataFrame, candidates: DataFrame, factory: ClientFactory, calls: CallSettings) -> DataFrame:
    """(task_id, winner): ask ``calls.responses`` times, read the name, drop unknown names to NULL, take the most voted.

    Raises when there were prompts and not one of them was answered: that is a broken client or budget, not a vote.
    """
    answers = complete(prompts, factory, calls)
    failed = F.col("error").isNotNull()
    told = answers.agg(
        F.count("*").alias("n"), F.sum(failed.cast("int")).alias("failed"), F.first(F.when(failed, F.col("error")), True).alias("why")
    ).first()
    if told["n"] and told["n"] == told["failed"]:
        raise RuntimeError(f"no vote was answered: {told['why']}")
    votes = answers.select(F.col("prompt_id").alias("item"), F.col("choice").alias("vote"), chosen_name(F.col("content")).alias("name"))
    return plurality(votes, candidates.select(F.col("task_id").alias("item"), "name")).select(F.col("item").alias("task_id"), "winner")


def rerank(
    tasks: DataFrame, candidates: DataFrame, configs: DataFrame, factory: ClientFactory, num_votes: int = 5,
    calls: CallSettings = VOTES, seed: int | str = 42,
) -> DataFrame:
    """(task_id, dataset, config). ``candidates``: (task_id, pos, name, description, tags); ``configs``: (dataset, config, columns, sample_row).

    A dataset with one config needs no second vote; of more than ten, ten are drawn. NULLs mean no choice.
    """
    calls = replace(calls, responses=num_votes)
    chosen = vote_names(dataset_prompts(tasks, candidates), candidates, factory, calls).withColumnRenamed("winner", "name")
    described = candidates.select("task_id", "name", "description")
    options = (
        chosen.join(described, ["task_id", "name"]).withColumnRenamed("name", "dataset").join(configs, "dataset")
        .withColumn("_m", mark(seed, F.col("task_id"), F.col("config")))
    )
    drawn = head_per_group(options, ["task_id"], [F.col("_m"), F.col("config")], MAX_CONFIGS, rank="_r").drop("_m", "_r")
    numbered = head_per_group(drawn, ["task_id"], [F.col("config")], MAX_CONFIGS, rank="pos")
    counts = numbered.groupBy("task_id").agg(F.count("*").alias("n"), F.min("config").alias("only"))
    many = counts.where(F.col("n") > 1).select("task_id")
    voted = vote_names(
        config_prompts(tasks.join(many, "task_id", "left_semi"), numbered), numbered.withColumnRenamed("config", "name"), factory, calls
    )
    config = F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("winner"))
    return (
        tasks.select("task_id").join(chosen, "task_id", "left").join(counts, "task_id", "left").join(voted, "task_id", "left")
        .select("task_id", F.col("name").alias("dataset"), config.alias("config"))
    )
