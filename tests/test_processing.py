import pytest
from pyspark.sql import functions as F

from taskweave.operators.pairs import canonicalize, combine, contributions, format_pairs, pairs_from_samples, selection_problem
from taskweave.operators.splits import split_by_position, split_table, split_tasks
from taskweave.operators.textualize import drop_empty_pairs, process_tasks, textualize, wrap_input

PAIRS = [
    (0, "train", 0, "foo", "baz"), (0, "train", 1, "bar", "qux"), (0, "test", 0, "foo", "baz"),
    (1, "train", 0, "spam", "ham"), (1, "val", 0, "eggs", "sau"),
]
SCHEMA = "task_id int, split string, pos bigint, input_col string, output_col string"


def by_key(df):
    return {(r["task_id"], r["split"], r["pos"]): (r["model_input"], r["model_output"]) for r in df.collect()}


def text(task, x):
    return f"<task {task}>convert to text2text\nExample:\n{x}\nLabel:\n"


def test_textualize_encoder_decoder(spark):
    got = by_key(process_tasks(spark.createDataFrame(PAIRS, SCHEMA), "convert to text2text", True))
    assert got == {(t, s, p): (text(t, i), o) for t, s, p, i, o in PAIRS}


def test_textualize_decoder_only_ends_training_rows(spark):
    df = process_tasks(spark.createDataFrame(PAIRS, SCHEMA), "convert to text2text", False, "<|endoftext|>")
    assert "input_col" not in df.columns and "output_col" not in df.columns
    end = lambda s, o: o + "<|endoftext|>" if s == "train" else o
    assert by_key(df) == {
        (t, s, p): (text(t, i) + (end(s, o) if s == "train" else ""), end(s, o)) for t, s, p, i, o in PAIRS
    }


def test_numeric_labels_become_text(spark):
    df = spark.createDataFrame([("train", "foo", 0), ("test", "bar", 2)], "split string, input_col string, output_col bigint")
    assert {r["model_output"] for r in textualize(df, "x", True).collect()} == {"0", "2"}


def test_empty_sides_are_dropped_and_null_is_kept(spark):
    rows = [("foo", ""), ("", "qux"), ("test", "key"), (None, "x"), ("y", None)]
    df = drop_empty_pairs(spark.createDataFrame(rows, "input_col string, output_col string"))
    assert {tuple(r) for r in df.collect()} == {("test", "key"), (None, "x"), ("y", None)}


def test_wrong_columns_and_splits_raise(spark):
    with pytest.raises(ValueError):
        drop_empty_pairs(spark.createDataFrame([("a", "b")], "input_col string, output string"))
    with pytest.raises(ValueError):
        textualize(spark.createDataFrame([("train", "a", "b")], "split string, input_col string, output_col string"), "x", False)
    bad = textualize(spark.createDataFrame([("full", "a", "b")], "split string, input_col string, output_col string"), "x", True)
    with pytest.raises(Exception, match="full"):
        bad.collect()


def test_wrap_input(spark):
    assert spark.range(1).select(wrap_input("do", F.lit("x"))).first()[0] == "<task 0>do\nExample:\nx\nLabel:\n"


@pytest.mark.parametrize(
    "caps,bounds",
    [(None, (6000, 8000, 10000)), ({"train": 3000, "val": 500, "test": 1000}, (3000, 3500, 4500)), ({"train": 3000}, (3000, 5000, 7000))],
)
def test_splits_are_contiguous_and_capped(spark, caps, bounds):
    df = spark.range(10000).select((F.col("id") + 10000).alias("k"), F.col("id").alias("pos")).repartition(5)
    name = lambda p: "train" if p < bounds[0] else "val" if p < bounds[1] else "test"
    expected = {(p, name(p)) for p in range(bounds[2])}
    assert {(r["pos"], r["split"]) for r in split_table(df, ["k"], 0.6, 0.2, caps).collect()} == expected
    assert {(r["pos"], r["split"]) for r in split_by_position(df, 10000, 0.6, 0.2, caps).collect()} == expected


def test_split_by_several_keys(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("a"), F.col("id").alias("b"))
    ordered = sorted((i % 3, i) for i in range(100))
    got = {(r["a"], r["b"]): r["split"] for r in split_table(df, ["a", "b"], 0.5, 0.2).collect()}
    assert got == {k: "train" if i < 50 else "val" if i < 70 else "test" for i, k in enumerate(ordered)}


def test_split_of_several_tasks_with_one_large(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, 0).when(F.col("id") < 990, 1).otherwise(2).alias("task_id"), "id")
    got = split_tasks(df, ["id"], 0.6, 0.2, {"train": 100}).groupBy("task_id", "split").agg(F.count("*"), F.min("id"))
    assert {tuple(r) for r in got.collect()} == {
        (0, "train", 100, 0), (0, "val", 180, 100), (0, "test", 180, 280), (1, "train", 54, 900), (1, "val", 18, 954), (1, "test", 18, 972),
        (2, "train", 6, 990), (2, "val", 2, 996), (2, "test", 2, 998),
    }


def test_proportions_must_leave_a_test_split(spark):
    with pytest.raises(ValueError):
        split_table(spark.range(10), ["id"], 0.8, 0.2)


def test_canonicalize(spark):
    df = spark.createDataFrame(
        [("train", 0, "Who?", "Bob.", ["b", "c"]), ("train", 1, "x", "y", []), ("val", 0, "p", None, None)],
        "split string, pos int, question string, context string, answer array<string>",
    )
    got = canonicalize(df, ["question", "context", "answer"], "answer", ["pos"], 1, "split").collect()
    assert {(r["split"], r["input_col"], str(r["output_col"])) for r in got} == {
        ("train", "question: Who?\ncontext: Bob.\nanswer: ['b', 'c']", "['b', 'c']"), ("val", "question: p\ncontext: None\nanswer: None", "None"),
    }


def test_pairs_combine_and_format(spark):
    a = spark.createDataFrame([(" a ", "b\n"), (None, "c")], "x string, y string")
    pairs = pairs_from_samples(a, "x", "y")
    both = combine([pairs, pairs])
    assert [r["text"] for r in format_pairs(both).collect()] == ["a b", "a b"]
    assert combine([format_pairs(pairs)], "text").count() == 1
    with pytest.raises(ValueError):
        combine([pairs], "other")
    with pytest.raises(ValueError):
        combine([pairs], "text")


def test_selection_problem_and_contributions(spark):
    rows = [(["context", "question"], ["answers"]), (None, ["answers"]), (["comprehension"], ["answers"]), (["context"], ["answers", "title"]), ([], ["title"])]
    df = spark.createDataFrame(rows, "i array<string>, o array<string>")
    columns = F.array(*[F.lit(c) for c in ("id", "title", "context", "question", "answers")])
    got = [r[0] for r in df.select(selection_problem(F.col("i"), F.col("o"), columns)).collect()]
    assert got == [None, "wrong number of columns", "unknown columns: comprehension", "wrong number of columns", "wrong number of columns"]
    counted = contributions(spark.createDataFrame([("a",), ("a",), ("b",)], "source string"))
    assert {tuple(r) for r in counted.collect()} == {("a", 2), ("b", 1)}
