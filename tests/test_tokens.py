import random

import pytest
from pyspark.sql import functions as F

from taskweave.functions.arrays import leading_run, output_labels, trailing_run
from taskweave.functions.text import token_count
from taskweave.operators.positions import batch_number
from taskweave.operators.tokenize import (
    batch_budgets, completion_budget, hashed_ids, longest_texts, tokenize_causal, tokenize_rows, tokenizer_from,
)


def test_pad_runs(spark):
    rows = [([1, 1, 1, 3, 1], 1), ([1, 1, 1, 1], 1), ([2, 2, 2, 2, 2], 0), ([0, 0, 1, 1, 1], 0), ([0, 0, 1, 1, 1], 1), ([], 1)]
    df = spark.createDataFrame(rows, "ids array<int>, pad int")
    got = df.select(leading_run(F.col("ids"), F.col("pad")), trailing_run(F.col("ids"), F.col("pad"))).collect()
    assert [tuple(r) for r in got] == [(3, 1), (4, 4), (0, 0), (2, 0), (0, 3), (0, 0)]


def letters():
    """Words to ids by their length plus two."""
    return lambda text: [len(w) + 2 for w in text.split()]


TEXTS = [("a bb", "c"), ("a", "dd e f"), ("x y z x", ""), ("q r s t u v", "w")]


@pytest.fixture
def texts(spark):
    rows = [(i, *t) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "i int, model_input string, model_output string").repartition(3)


def arrays(df):
    return {r["i"]: (r["input_ids"], r["attention_mask"], r["labels"]) for r in df.collect()}


def test_decoder_only(texts):
    got = arrays(tokenize_rows(texts, False, tokenizer_from(letters), max_length=5))
    assert got == {
        0: ([0, 0, 0, 3, 4], [0, 0, 0, 1, 1], [-100, -100, -100, -100, 4]),
        1: ([0, 0, 0, 0, 3], [0, 0, 0, 0, 1], [-100, -100, 0, 0, 3]),
        2: ([0, 3, 3, 3, 3], [0, 1, 1, 1, 1], [-100] * 5),
        3: ([3, 3, 3, 3, 3], [1, 1, 1, 1, 1], [-100, -100, -100, -100, 3]),
    }


def test_encoder_decoder(texts):
    got = arrays(tokenize_rows(texts, True, tokenizer_from(letters)))
    assert got == {
        0: ([3, 4, 0, 0, 0, 0], [1, 1, 0, 0, 0, 0], [3, -100, -100]),
        1: ([3, 0, 0, 0, 0, 0], [1, 0, 0, 0, 0, 0], [4, 3, 3]),
        2: ([3, 3, 3, 3, 0, 0], [1, 1, 1, 1, 0, 0], [-100] * 3),
        3: ([3, 3, 3, 3, 3, 3], [1] * 6, [3, -100, -100]),
    }


def test_pad_ids_at_the_end_of_an_output_are_ignored_too(spark):
    df = spark.createDataFrame([([5, 0, 6, 0],)], "ids array<int>")
    assert df.select(output_labels(F.col("ids"), 6, 0)).first()[0] == [5, 0, 6, -100, -100, -100]


def test_causal_rows_have_a_fixed_width(spark):
    df = spark.createDataFrame([("a b c d",), ("a",)], "text string")
    rows = tokenize_causal(df, tokenizer_from(letters), width=3).collect()
    assert [(r["input_ids"], r["attention_mask"]) for r in rows] == [([3, 3, 3], [1, 1, 1]), ([0, 0, 3], [0, 0, 1])]
    assert all(r["labels"] == r["input_ids"] for r in rows)


def test_hashed_ids_are_stable_and_leave_room(spark):
    df = spark.createDataFrame([("same same, other",)], "t string")
    ids = df.select(hashed_ids(1000)(F.col("t"))).first()[0]
    assert len(ids) == 4 and ids[0] == ids[1] and all(3 <= i < 1000 for i in ids)


def test_longest_budgets_and_batches(spark):
    df = spark.createDataFrame([(0, "a b", "x"), (1, "abcdef", "y"), (2, "a b c.", "z")], "k int, t string, u string")
    got = {r["column"]: (r["k"], r["n_chars"], r["n_tokens"], r["truncated"]) for r in longest_texts(df, ["t", "u"], token_count, 2, "k").collect()}
    assert got == {"t": (1, 6, 1, False), "u": (0, 1, 1, False)}
    n = spark.createDataFrame([(10,)], "n bigint")
    assert n.select(completion_budget(F.col("n"), 4000), completion_budget(F.col("n"), None)).first()[:] == (3690, 30)
    batches = spark.range(250).select(batch_number("id", 100).alias("batch_id"), F.col("id").alias("n_tokens"))
    assert {(r["batch_id"], r["n_tokens"], r["n_prompts"], r["budget"]) for r in batch_budgets(batches, 4000).collect()} == {
        (0, 99, 100, 3601), (1, 199, 100, 3501), (2, 249, 50, 3451)
    }


@pytest.mark.parametrize("has_encoder", [True, False])
def test_buckets_of_lengths_hold_the_same_tokens_with_less_padding(spark, has_encoder):
    from taskweave.operators.tokenize import padding_share, tokenize_bucketed

    rnd = random.Random(2)
    lengths = [0, 1, 1, 2, 3, 5, 900] + [rnd.randint(1, 60) for _ in range(60)]
    rows = [(i, "w " * n, "o " * rnd.randint(0, 4)) for i, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, "id int, model_input string, model_output string").repartition(3)
    whole = {r.id: r for r in tokenize_rows(df, has_encoder).collect()}
    bucketed = tokenize_bucketed(df, has_encoder)
    assert bucketed.columns == ["bucket", "id", "input_ids", "attention_mask", "labels"]
    got = {r.id: r for r in bucketed.collect()}
    assert got.keys() == whole.keys()
    widths = {}
    for i, r in got.items():
        real = lambda row: [t for t, m in zip(row.input_ids, row.attention_mask) if m]
        assert real(r) == real(whole[i]) and len(real(r)) == lengths[i]
        kept, every = ([x for x in row.labels if x != -100] for row in (r, whole[i]))
        assert kept == every[len(every) - len(kept) :] and (len(kept) == len(every) or not has_encoder)
        widths.setdefault(r.bucket, set()).add(len(r.input_ids))
        assert len(r.input_ids) <= max(1, 1.5 * lengths[i]) or lengths[i] <= 1
    assert all(len(w) == 1 for w in widths.values()) and len(widths) > 5
    assert padding_share(tokenize_rows(df, has_encoder)).first().padding > 0.9
    assert padding_share(bucketed).first().padding < 0.2
    coarse = tokenize_bucketed(df, has_encoder, borders=[10])
    assert {(r.bucket, len(r.input_ids)) for r in coarse.collect()} == {(0, max(n for n in lengths if n <= 10)), (1, 900)}
    with pytest.raises(ValueError):
        tokenize_bucketed(df, has_encoder, borders=[3, 2])
