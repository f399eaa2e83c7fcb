from pyspark.sql import functions as F

from taskweave.operators.voting import winners
from taskweave.streaming.incremental import (
    compact_counts,
    current_totals,
    current_winners,
    parse_stream,
    textualize_stream,
    vote_stream,
    vote_totals_stream,
)

SCHEMA = "seen bigint, content string"


def answer(i, o):
    return '{"input": "%s", "output": "%s"}' % (i, o)


def test_votes_over_micro_batches_and_a_replay(spark, tmp_path):
    rounds = [[("1", "a"), ("1", "b"), ("1", "a"), ("2", "a")], [("3", "a")], [("1", "b"), ("1", "b"), ("1", "b"), ("9", "")]]
    source, counts = str(tmp_path / "in"), str(tmp_path / "counts")
    seen = 0
    for votes in rounds:
        rows = [(seen + i, answer(*v)) for i, v in enumerate(votes)]
        seen += len(votes)
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = parse_stream(spark.readStream.schema(SCHEMA).parquet(source))
        query = vote_stream(stream, counts, F.col("seen")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination()
    expected = [("1", "b"), ("2", "a"), ("3", "a")]
    assert [(r[0], r[1]) for r in current_winners(spark, counts).orderBy("first_seen").collect()] == expected
    # a batch that runs again overwrites what it wrote before
    again = spark.createDataFrame([(4, "3", "a")], "seen bigint, input_col string, output_col string")
    from taskweave.operators.voting import vote_counts

    vote_counts(again, F.col("seen")).write.mode("overwrite").parquet(f"{counts}/batch=1")
    assert [(r[0], r[1]) for r in current_winners(spark, counts).orderBy("first_seen").collect()] == expected
    compact_counts(spark, counts, str(tmp_path / "compact"))
    assert [(r[0], r[1]) for r in current_winners(spark, str(tmp_path / "compact")).orderBy("first_seen").collect()] == expected


def test_textualize_on_a_stream(spark, tmp_path):
    schema = "split string, input_col string, output_col string"
    spark.createDataFrame([("train", "a", "b"), ("train", "", "b")], schema).write.parquet(str(tmp_path / "in"))
    stream = textualize_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "do", True)
    query = stream.writeStream.format("memory").queryName("texts").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r["model_output"] for r in spark.sql("SELECT * FROM texts").collect()] == ["b"]


def test_totals_live_in_the_state_over_batches_and_restarts(spark, tmp_path):
    source, totals, seen = str(tmp_path / "in"), str(tmp_path / "totals"), 0
    given: dict = {}
    for start in range(3):  # each start is a stream of its own on the same checkpoint
        for i in range(3):
            votes = [(str((seen + k) % 4), "ab"[(seen * 7 + k) % 2]) for k in range(5)]
            rows = [(seen + k, answer(*v)) for k, v in enumerate(votes)]
            for at, v in enumerate(votes, seen):
                n, first = given.get(v, (0, at))
                given[v] = (n + 1, first)
            seen += len(votes)
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = parse_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source))
        query = vote_totals_stream(stream, totals, F.col("seen"), fold_every=3)
        query.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        got = {(r.input_col, r.output_col): (r.n, r.first_seen) for r in current_totals(spark, totals).collect()}
        assert got == given
        assert len([p for p in (tmp_path / "totals").iterdir() if p.name.startswith("upto=")]) <= 4
    assert winners(current_totals(spark, totals)).count() == 4
    assert current_totals(spark, str(tmp_path / "nothing")).count() == 0
