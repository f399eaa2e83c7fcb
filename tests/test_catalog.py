import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskweave.operators.catalog import (
    accessible, curate, curation_reasons, eligible_configs, eligible_models, reason_counts, size_in_mb, takes_schema, valid_datasets,
)
from taskweave.operators.shapes import flatten, flatten_with_unique_names, prune, rename, row_preview, unique_names
from taskweave.plans.catalog_build import build_catalog
from taskweave.sources import catalogs, tables


def write(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def test_read_dataset_catalog_sorted_by_name(spark, tmp_path):
    data = {n: {"name": n, "description": f"about {n}", "evaluation_metadata": m} for n, m in (("squad", [{"a": 1}]), ("trivia_qa", {}), ("search_qa", []))}
    df = catalogs.read_datasets(spark, write(tmp_path / "index.json", data))
    assert [tuple(r) for r in df.collect()] == [(n, f"about {n}", 0.0) for n in ("search_qa", "squad", "trivia_qa")]


def test_read_rerank_catalog(spark, tmp_path):
    config = {"config_name": "plain", "sample_row": "{}", "columns": ["a", "b_c"], "columns_mapping": {"b.c": "b_c", "a": "a"}, "dataset_description": "d", "dataset_name": "x"}
    entry = lambda gated: {"dataset_name": "x", "description": "d", "downloads": 13, "configs": {"plain": config, "other": {**config, "config_name": "other"}}, "tags": ["t"], "is_gated": gated}
    df = catalogs.read_rerank_datasets(spark, write(tmp_path / "r.json", {"open": entry(False), "shut": entry(True)}))
    assert {(r["name"], r["downloads"], tuple(r["tags"]), r["is_gated"]) for r in df.collect()} == {("open", 13, ("t",), False), ("shut", 13, ("t",), True)}
    configs = catalogs.configs_of(df)
    assert {(r["dataset"], r["config"]) for r in configs.collect()} == {(d, c) for d in ("open", "shut") for c in ("plain", "other")}
    assert configs.first()["columns_mapping"] == {"b.c": "b_c", "a": "a"}
    names = spark.createDataFrame([("open",), ("shut",), ("ghost",)], "name string")
    found = lambda **k: {r["name"] for r in accessible(names, df, **k).collect()}
    assert found() == {"open"} and found(allow_gated=True) == {"shut"} and found(allow_gated=True, include_open=True) == {"open", "shut"}


def test_read_models_skips_hidden_and_empty_files(spark, tmp_path):
    model = {"pretrained_model_name": "gpt2", "description": "d", "size_bytes": "800", "_comment": "x"}
    write(tmp_path / "gpt2.json", json.dumps(model, indent=2))
    write(tmp_path / "t5.json", {**model, "pretrained_model_name": "t5", "downloads": 7})
    write(tmp_path / ".hidden.json", {**model, "pretrained_model_name": "hidden"})
    write(tmp_path / "empty.json", "")
    assert {tuple(r) for r in catalogs.read_models(spark, str(tmp_path)).collect()} == {("gpt2", "d", "800", 0), ("t5", "d", "800", 7)}


def test_eligible_models(spark):
    rows = [("a", "d", "800"), ("b", "d", "0"), ("c", None, "5"), ("huggingtweets/x", "d", "5"), ("huggingtweets-fan/x", "d", "5"), ("e", "d", None), ("f", "d", "?")]
    df = spark.createDataFrame(rows, "name string, description string, size_bytes string")
    assert {r["name"] for r in eligible_models(df).collect()} == {"a", "huggingtweets-fan/x"}


def test_raw_catalog_round_trip_and_curation(spark, tmp_path):
    long = "four words are here"
    raw = [
        {"id": "a", "description": long, "downloads": 10}, {"id": "b", "description": long, "downloads": 99}, {"id": "c", "description": "too short", "downloads": 99},
        {"id": "d", "downloads": 99}, {"id": "e", "description": "", "downloads": 99}, {"id": "f", "description": "a b c d", "downloads": 9},
        {"id": "g", "description": "other text of words"}, {"id": "h", "description": "a b c d", "downloads": 12},
    ]
    df = catalogs.read_raw_catalog(spark, write(tmp_path / "raw.json", raw), "id string, description string, downloads bigint")
    placed = df.withColumn("pos", F.ascii("id").cast("bigint"))
    assert {r["id"]: r["reason"] for r in curation_reasons(placed).collect()} == {
        "a": None, "b": "duplicate", "c": "short_description", "d": "no_description", "e": "no_description", "f": "few_downloads", "g": "few_downloads", "h": None,
    }
    assert {tuple(r) for r in reason_counts(curation_reasons(placed)).collect()} == {
        ("kept", 2), ("duplicate", 1), ("short_description", 1), ("no_description", 2), ("few_downloads", 2)
    }
    kept = curate(placed)
    catalogs.write_catalog_json(kept, str(tmp_path / "out"))
    back = catalogs.read_raw_catalog(spark, str(tmp_path / "out"), "id string")
    assert {r["id"] for r in back.collect()} == {"a", "h"}
    catalogs.save_catalog(kept, str(tmp_path / "parquet"))
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 2


def test_valid_datasets(spark):
    rows = [("a", None, True, True), ("b", True, True, True), ("c", False, True, None), ("d", False, True, False)]
    df = spark.createDataFrame(rows, "dataset string, disabled boolean, preview boolean, viewer boolean")
    assert [r["dataset"] for r in valid_datasets(df).collect()] == ["a"]


def test_eligible_configs(spark):
    configs = spark.createDataFrame(
        [("d", "ok", ["train", "test"], "{}"), ("d", "no_train", ["test"], "{}"), ("d", "empty", ["train"], None), ("d", "pictures", ["train"], "{}")],
        "dataset string, config string, splits array<string>, sample_row string",
    )
    columns = spark.createDataFrame([("d", "ok", "x", "string"), ("d", "pictures", "x", "string"), ("d", "pictures", "y", "binary")], "dataset string, config string, name string, type string")
    assert [r["config"] for r in eligible_configs(configs, columns).collect()] == ["ok"]
    assert not takes_schema(T.StructType([T.StructField("a", T.StructType([T.StructField("b", T.DateType())]))]))


def test_unique_names():
    assert unique_names(["a.b", "a_b", "c", "a.b.c", "a_b_c", "a_b.c"]) == {
        "a.b": "a_b", "a_b": "a_b_1", "c": "c", "a.b.c": "a_b_c", "a_b_c": "a_b_c_1", "a_b.c": "a_b_c_2"
    }


def test_flatten_rename_prune(spark):
    df = spark.sql("SELECT 1 AS id, named_struct('text', array('x'), 'deep', named_struct('n', 2)) AS answers, 'y' AS answers_text")
    assert flatten(df).columns == ["id", "answers.text", "answers.deep.n", "answers_text"]
    flat = flatten_with_unique_names(df)
    assert tuple(flat.first()) == (1, ["x"], 2, "y") and flat.columns == ["id", "answers_text", "answers_deep_n", "answers_text_1"]
    assert prune(flat, ["id", "answers_text"], "id").columns == ["id", "answers_text"]
    assert rename(flatten(df), {"answers.text": "t"}).columns == ["id", "t", "answers.deep.n", "answers_text"]


def preview(row, limit):
    cut = {}
    for k, v in row.items():
        text = json.dumps(v)
        cut[k] = text if len(text) <= limit - 3 else text[:limit] + "..."
    return json.dumps(cut)


@pytest.mark.parametrize("limit", [50, 200])
def test_row_preview(spark, limit):
    # a JSON text is two characters longer than the plain one
    texts = ["x" * n for n in (0, limit - 6, limit - 5, limit - 4, limit - 3, limit - 2, limit, limit + 1, 3 * limit)] + ['q"' * limit, "é" * 9, "猫😀" * 30, "a\n\t\\", None]
    rows = [{"id": i, "text": t, "tags": ["a", t or ""], "score": 0.5} for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id bigint, text string, tags array<string>, score double")
    got = [r[0] for r in df.orderBy("id").select(row_preview(df, max_length=limit)).collect()]
    assert got == [preview(r, limit) for r in rows]


def test_build_catalog(spark):
    good = spark.sql("SELECT 1 AS id, named_struct('b', 'x') AS a, 'y' AS a_b")
    dated = spark.sql("SELECT current_date() AS d")
    datasets = spark.createDataFrame(
        [("ds", "about ds", 5, ["t"], False, False, True, True), ("off", "x", 5, ["t"], False, True, True, True)],
        "dataset string, description string, downloads bigint, tags array<string>, is_gated boolean, disabled boolean, preview boolean, viewer boolean",
    )
    found = {("ds", "plain"): (good, ["train", "test"]), ("ds", "dated"): (dated, ["train"]), ("ds", "test_only"): (good, ["test"]), ("off", "plain"): (good, ["train"])}
    rows = build_catalog(spark, datasets, found).collect()
    assert [r["dataset"] for r in rows] == ["ds"]
    config = rows[0]["configs"]["plain"]
    assert list(rows[0]["configs"]) == ["plain"]
    assert config["columns"] == ["id", "a_b", "a_b_1"] and config["columns_mapping"] == {"id": "id", "a.b": "a_b", "a_b": "a_b_1"}
    assert json.loads(config["sample_row"]) == {"id": "1", "a.b": '"x"', "a_b": '"y"'} and config["dataset_description"] == "about ds"


def test_size_in_mb(spark):
    df = spark.createDataFrame([(1345449,), (None,), (0,)], "b bigint")
    assert [r[0] for r in df.select(size_in_mb(F.col("b"))).collect()] == ["1.28", "NA", "0.00"]


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("train", 1), ("val", 2)], "split string, x int")
    tables.write_splits(df, str(tmp_path / "s"))
    assert tables.read_splits(spark, str(tmp_path / "s"), "val").select("x").collect()[0][0] == 2
    plan = tables.read_splits(spark, str(tmp_path / "s"), "val")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    vec = spark.createDataFrame([("a", [1.0, 2.0])], "id string, embedding array<float>")
    tables.write_vectors(vec, str(tmp_path / "v"))
    assert tables.read_vectors(spark, str(tmp_path / "v")).first()["embedding"] == [1.0, 2.0]
    rows = [{"text_id": 0, "text": "a"}, {"text_id": 1, "text": "b"}]
    array = write(tmp_path / "array.json", json.dumps(rows, indent=1))
    lines = write(tmp_path / "lines.json", "\n".join(json.dumps(r) for r in rows))
    for path in (array, lines):
        assert {tuple(r) for r in tables.texts_to_encode(spark, path).collect()} == {(0, "a"), (1, "b")}
    assert tables.texts_to_encode(spark, table=spark.createDataFrame(rows)).count() == 2
    for bad in ({}, {"file": array, "table": df}):
        with pytest.raises(ValueError):
            tables.texts_to_encode(spark, **bad)
    assert tables.read_table(spark, lines, "json").count() == 2
    with pytest.raises(ValueError):
        tables.read_table(spark, lines, "hub")
    metrics = spark.createDataFrame([("exact_match", 0.5)], "metric string, value double")
    tables.write_metrics_text(metrics, str(tmp_path / "t"))
    tables.write_metrics_json(metrics, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "t")).first()[0] == "exact_match: 0.5"
    assert spark.read.json(str(tmp_path / "j")).first().asDict() == {"metric": "exact_match", "value": 0.5}
