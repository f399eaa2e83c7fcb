"""Find a dataset for a task and bring it into pairs (M12)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskweave.contracts import INPUT, OUTPUT, TaskSpec
from taskweave.functions.draws import mark
from taskweave.operators.catalog import accessible
from taskweave.operators.completion import CallSettings, ClientFactory
from taskweave.operators.pairs import canonicalize, concatenate
from taskweave.operators.positions import head_per_group
from taskweave.operators.retrieval import dense_top_k
from taskweave.operators.shapes import flatten, prune, rename
from taskweave.operators.vector_index import VectorIndex
from taskweave.operators.positions import with_position
from taskweave.plans.rerank import VOTES, rerank
from taskweave.plans.transform import ROW_CALLS, transform_table
from taskweave.plans.understanding import SINGLE, select_columns
from taskweave.sources.catalogs import configs_of
from taskweave.staging import stage

FIRST_STAGE_DEPTH, FINAL_DEPTH = 1000, 25

# (dataset, config) -> a table with a split column and a unique key column ``row_key``
Loader = Callable[[str, str], DataFrame]


def search_datasets(
    tasks: DataFrame, datasets: DataFrame, encoder: Callable[[Column], Column], first_depth: int = FIRST_STAGE_DEPTH, depth: int = FINAL_DEPTH,
    vectors: DataFrame | VectorIndex | None = None,
) -> DataFrame:
    """(task_id, pos, name, score) by inner product of instruction and description.

    ``vectors``: stored (id, embedding), or an index of them, ids being names; then no description is encoded.
    """
    corpus = vectors if vectors is not None else datasets.select(F.col("name").alias("id"), encoder(F.col("description")).alias("embedding"))
    asked = tasks.select(F.col("task_id").alias("query_id"), encoder(F.col("instruction")).alias("embedding"))
    found = dense_top_k(asked, corpus, first_depth).select(F.col("query_id").alias("task_id"), F.col("id").alias("name"), "score")
    best = head_per_group(found, ["task_id"], [F.desc("score"), F.asc("name")], depth, rank="pos")
    return best.select("task_id", "pos", "name", "score")


def _candidates(found: DataFrame, catalog: DataFrame, allow_gated: bool) -> DataFrame:
    open_ = accessible(found.select("name").distinct(), catalog, allow_gated)
    return found.join(open_, "name").select("task_id", "pos", "name", "description", "tags", "configs")


def load_for(chosen, loader: Loader, seed: int | str) -> DataFrame:
    """A chosen table: shuffled, flattened, with the catalogue's column names, keyed by ``pos``."""
    table = loader(chosen["dataset"], chosen["config"])
    flat = rename(flatten(table), {**(chosen["columns_mapping"] or {}), "row_key": "row_key"})
    return flat.withColumn("_mark", mark(seed, F.col("row_key")))


def retrieve_dataset(
    spec: TaskSpec,
    datasets: DataFrame,
    catalog: DataFrame,
    encoder: Callable[[Column], Column],
    factory: ClientFactory,
    loader: Loader,
    transform: bool = False,
    max_rows: int = 3000,
    target_rows: int = 3000,
    max_failure_rate: float = 0.333,
    max_datasets: int = 3,
    num_votes: int = 5,
    allow_gated: bool = False,
    strict: bool = False,
    votes: CallSettings = VOTES,
    single: CallSettings = SINGLE,
    row_calls: CallSettings = ROW_CALLS,
    vectors: DataFrame | VectorIndex | None = None,
    seed: int | str = 2023,
) -> DataFrame:
    """(split, source, input_col, output_col); without rows when nothing fits.

    ``datasets``: (name, description); ``catalog``: rows of ``read_rerank_datasets``; ``vectors``: their stored descriptions,
    as vectors or as an index. Without ``transform`` one dataset is
    taken, at most ``max_rows`` rows per split. With it, datasets are chosen and rewritten one after the other, at most
    ``max_datasets``, until ``target_rows`` pairs are there; ``strict`` gives everything up when a choice fails midway.
    Raises when none of the votes is answered.
    """
    spark = datasets.sparkSession
    tasks = spark.createDataFrame([(0, spec.instruction, spec.examples)], "task_id int, instruction string, examples string")
    found = stage(_candidates(search_datasets(tasks, datasets, encoder, vectors=vectors), catalog, allow_gated), "candidates")
    if found.isEmpty():
        raise ValueError("no dataset found in the catalogue")
    configs = configs_of(found.select("name", "configs"))

    def choose(used: list[tuple[str, str | None]]):
        """The next (dataset, config) row, leaving out what was used before."""
        left = configs
        for dataset, config in used:
            same = F.col("dataset") == dataset
            left = left.where(~(same if config is None else same & (F.col("config") == config)))
        names = left.select(F.col("dataset").alias("name")).distinct()
        candidates = found.join(names, "name", "left_semi").select("task_id", "pos", "name", "description", "tags")
        if candidates.isEmpty():
            return None
        pick = rerank(tasks, candidates, left, factory, num_votes, votes, seed).first()
        return pick, left

    def columns_for(pick, left):
        row = left.where((F.col("dataset") == pick["dataset"]) & (F.col("config") == pick["config"]))
        asked = row.select(
            F.lit(0).alias("prompt_id"), F.lit(spec.instruction).alias("instruction"), F.col("dataset").alias("name"),
            F.col("dataset_description").alias("description"), "columns", "sample_row",
        )
        return row.first(), select_columns(asked, factory, calls=single).first()

    nothing = spark.createDataFrame([], f"split string, source string, {INPUT} string, {OUTPUT} string")
    used: list[tuple[str, str | None]] = []
    gathered: list[DataFrame] = []
    have = 0
    for _ in range(max_datasets if transform else 1):
        chosen = choose(used)
        if chosen is None:
            break
        pick, left = chosen
        if pick["dataset"] is None:
            if strict:
                return nothing
            break
        if pick["config"] is None:
            if not transform:
                return nothing
            used.append((pick["dataset"], None))
            continue
        used.append((pick["dataset"], pick["config"]))
        entry, columns = columns_for(pick, left)
        if columns is None or columns["problem"] is not None or columns["output"] is None:
            continue
        table = load_for(entry, loader, seed)
        inputs, output = list(columns["inputs"]), columns["output"]
        source = F.lit(f"{pick['dataset']}_{pick['config']}").alias("source")
        if not transform:
            pairs = canonicalize(table, inputs, output, ["_mark", "row_key"], max_rows, split="split")
            return pairs.select("split", source, INPUT, OUTPUT)
        train = table.where(F.col("split") == "train")
        wanted = head_per_group(train, [], [F.col("_mark"), F.col("row_key")], target_rows - have)
        placed = with_position(wanted.select(*dict.fromkeys([*inputs, output, "_mark", "row_key"])), ["_mark", "row_key"])
        made = stage(
            transform_table(
                prune(placed, [*inputs, output], "pos"), spec, factory, target_rows - have, int(target_rows * max_failure_rate), calls=row_calls
            ),
            "transformed",
        )
        have += made.count()
        gathered.append(made.select(F.lit("train").alias("split"), source, INPUT, OUTPUT))
        if have >= target_rows:
            break
    return concatenate(gathered) if gathered else nothing
