"""Names, schemas and plan-time checks shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import types as T

INPUT, OUTPUT = "input_col", "output_col"
MODEL_INPUT, MODEL_OUTPUT = "model_input", "model_output"
SPLITS = ("train", "val", "test")


class TaskType(str, Enum):
    """What kind of task a prompt describes; a label only."""

    TEXT_GENERATION = "text_generation"
    CLASSIFICATION = "classification"
    SEQUENCE_TAGGING = "sequence_tagging"
    SPAN_EXTRACTION = "span_extraction"


@dataclass(frozen=True)
class TaskSpec:
    """A parsed task: what to do, and a few demonstrations as text."""

    instruction: str
    examples: str = ""
    task_type: TaskType = TaskType.TEXT_GENERATION

    def __post_init__(self):
        if not self.instruction:
            raise ValueError("a task needs an instruction; parse the prompt first")


CONFIG_STRUCT = T.StructType(
    [
        T.StructField("config_name", T.StringType()),
        T.StructField("sample_row", T.StringType()),
        T.StructField("columns", T.ArrayType(T.StringType())),
        T.StructField("columns_mapping", T.MapType(T.StringType(), T.StringType())),
        T.StructField("dataset_description", T.StringType()),
        T.StructField("dataset_name", T.StringType()),
    ]
)

RERANK_ENTRY = T.StructType(
    [
        T.StructField("dataset_name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("downloads", T.LongType()),
        T.StructField("configs", T.MapType(T.StringType(), CONFIG_STRUCT)),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("is_gated", T.BooleanType()),
    ]
)

DATASET_ENTRY = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        # a list in some entries and an object in others, so kept as text
        T.StructField("evaluation_metadata", T.StringType()),
    ]
)

MODEL_ENTRY = T.StructType(
    [
        T.StructField("pretrained_model_name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("size_bytes", T.StringType()),
        T.StructField("downloads", T.LongType()),
    ]
)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Fail while the plan is built, not row by row, when a column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")
    return df
