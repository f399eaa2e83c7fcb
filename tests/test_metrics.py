import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from taskweave.operators import metrics
from taskweave.operators.metrics import chrf, containment_accuracy, detach_echo, evaluate, exact_match, greedy_match, metric_words, pair_with_references

REFERENCES = ["The cat is sleeping.", "The dog is playing."]
INPUTS = ["Translate Chinese to English: 猫在睡觉。", "Translate Chinese to English: 狗在玩耍。"]
PLAIN = ["The cat is sleeping.", "The dog is barking."]
ECHOED = [i + p for i, p in zip(INPUTS, PLAIN)]


def pairs(spark, predictions, references=REFERENCES, inputs=INPUTS):
    rows = [(i, p, r, x) for i, (p, r, x) in enumerate(zip(predictions, references, inputs))]
    return spark.createDataFrame(rows, "row_id int, prediction string, reference string, model_input string")


def values(df):
    return {r["metric"]: round(r["value"], 2) for r in df.collect()}


def test_published_values(spark):
    assert values(evaluate(pairs(spark, PLAIN))) == {"chr_f++": 78.30, "exact_match": 0.50}
    assert values(evaluate(pairs(spark, ECHOED), model_input="model_input")) == {"chr_f++": 78.30, "exact_match": 0.50}
    assert values(evaluate(pairs(spark, ECHOED))) == {"chr_f++": 53.36, "exact_match": 0.0}


def test_metric_names(spark):
    assert set(values(evaluate(pairs(spark, PLAIN), ["exact_match"]))) == {"exact_match"}
    with pytest.raises(ValueError):
        evaluate(pairs(spark, PLAIN), ["bleu"])
    with pytest.raises(ValueError):
        evaluate(pairs(spark, PLAIN), ["bert_score"])

    def vectors(df):
        one = lambda side, c: df.select(F.col("row_id").alias("pair_id"), F.lit(side).alias("side"), F.posexplode(F.split(c, " ")).alias("token", "w")).select(
            "pair_id", "side", "token", F.array(F.length("w").cast("double"), F.lit(1.0)).alias("embedding"))
        return one(0, "prediction").unionByName(one(1, "reference"))

    got = values(evaluate(pairs(spark, PLAIN), ["chr_f", "exact_match", "bert_score"], token_vectors=vectors))
    assert set(got) == {"chr_f++", "exact_match", "average_bert_score"} and 0.9 < got["average_bert_score"] <= 1


def test_by_group(spark):
    df = pairs(spark, PLAIN).withColumn("task_id", F.col("row_id"))
    assert {r["task_id"]: r["value"] for r in exact_match(df, ["task_id"]).collect()} == {0: 1.0, 1: 0.0}
    assert {r["task_id"]: round(r["value"], 4) for r in chrf(df, ["task_id"]).collect()}[0] == 100.0


def test_unmatched_rows_raise(spark):
    p = spark.createDataFrame([(0, "a")], "row_id int, prediction string")
    r = spark.createDataFrame([(0, "a"), (1, "b")], "row_id int, reference string")
    with pytest.raises(ValueError):
        pair_with_references(p, r)
    assert pair_with_references(p, r.limit(1)).count() == 1


def test_detach_echo(spark):
    rows = [("in put out in", "in", "out"), ("in put", "in", "in it"), ("none", "in", "out"), ("abc", "", "x")]
    df = spark.createDataFrame(rows, "p string, i string, r string")
    assert [r[0] for r in df.select(detach_echo(F.col("p"), F.col("i"), F.col("r"))).collect()] == [" put out ", "in put", "none", "abc"]


def test_containment(spark):
    df = pairs(spark, ["IN: Paris, of course", "in: Rome"], ["paris ", "Oslo"], ["IN:", "in:"])
    assert containment_accuracy(df).first()["value"] == 0.5


def grams(text, n):
    s = "".join(text.split())
    return [s[i : i + n] for i in range(len(s) - n + 1)]


def slow_words(text):
    out = []
    marks = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    for w in text.split():
        if len(w) > 1 and w[-1] in marks:
            out += [w[:-1], w[-1]]
        elif len(w) > 1 and w[0] in marks:
            out += [w[0], w[1:]]
        else:
            out.append(w)
    return out


def slow_chrf(rows):
    from collections import Counter

    total = np.zeros((8, 3))
    for h, r in rows:
        for o in range(8):
            if o < 6:
                a, b = Counter(grams(h, o + 1)), Counter(grams(r, o + 1))
            else:
                ws = lambda t: [tuple(slow_words(t)[i : i + o - 5]) for i in range(len(slow_words(t)) - (o - 6))]  # noqa: E731, B023
                a, b = Counter(ws(h)), Counter(ws(r))
            total[o] += [sum((a & b).values()), sum(a.values()) if b else 0, sum(b.values())]
    used = [t for t in total if t[1] > 0 and t[2] > 0]
    if not used:
        return 0.0
    p, r = np.mean([t[0] / t[1] for t in used]), np.mean([t[0] / t[2] for t in used])
    return 500 * p * r / (4 * p + r) if p + r else 0.0


def test_chrf_against_counting(spark):
    rows = [
        ("", "abc"), ("abc", ""), ("a", "a"), ("ab ab ab!", "(ab) ab, 'ab'"), ("猫在睡觉。 😀😀", "猫睡觉。😀"), ("aaaaaaa", "aaa aaaa"),
        ("The dog, the \"cat\".", "the dog the cat ."), ("x" * 500 + " y", "x" * 300 + " z y"),
    ]
    df = spark.createDataFrame(rows, "prediction string, reference string").repartition(3)
    assert chrf(df).first()["value"] == pytest.approx(slow_chrf(rows))
    for row in rows:
        one = spark.createDataFrame([row], "prediction string, reference string")
        assert chrf(one).first()["value"] == pytest.approx(slow_chrf([row]))
    words = [r[0] for r in df.select(metric_words(F.col("reference"))).collect()]
    assert sorted(map(tuple, words)) == sorted(tuple(slow_words(r)) for _, r in rows)


@pytest.mark.parametrize("chunk", [512, 3])
def test_greedy_match_in_one_and_in_many_blocks(spark, monkeypatch, chunk):
    monkeypatch.setattr(metrics, "_CHUNK", chunk)
    rnd = np.random.default_rng(1)
    rows, expected = [], {}
    for pair, (n, m) in enumerate([(1, 1), (7, 4), (20, 11)]):
        a, b = rnd.normal(size=(n, 4)), rnd.normal(size=(m, 4))
        rows += [(pair, 0, i, v.tolist()) for i, v in enumerate(a)] + [(pair, 1, i, v.tolist()) for i, v in enumerate(b)]
        unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
        cosine = unit(a) @ unit(b).T
        p, r = cosine.max(axis=1).mean(), cosine.max(axis=0).mean()
        expected[pair] = (p, r, 2 * p * r / (p + r))
    df = spark.createDataFrame(rows, "pair_id int, side int, token int, embedding array<double>").repartition(5)
    for r in greedy_match(df).collect():
        assert (r["precision"], r["recall"], r["f1"]) == pytest.approx(expected.pop(r["pair_id"]))
    assert not expected


def test_chrf_of_many_kinds_of_rows(spark, monkeypatch):
    # short words by their key at six and twelve characters, longer ones by bytes, symbols that do not fit into one number
    words = ["sevench", "sevenCh", "twelvechars!", "(twelvechars", "averyveryveryverylongword", "averyveryveryverylongworD", "six.66", "\x1c", "a"]
    many = "".join(map(chr, range(0x4E00, 0x5300)))
    rnd = np.random.default_rng(5)
    text = lambda n: " ".join(rnd.choice(words, n).tolist())
    rows = [(text(i), text(i + 2)) for i in range(40)] + [(many[i:], many[:900] + " " + text(3)) for i in (0, 7, 500)] + [("", ""), (" ", "　")]
    df = spark.createDataFrame([(i % 3, *r) for i, r in enumerate(rows)], "task int, prediction string, reference string").repartition(2)
    expected = {g: pytest.approx(slow_chrf(rows[g::3])) for g in range(3)}
    assert {r["task"]: r["value"] for r in chrf(df, ["task"]).collect()} == expected
    plain = list(zip(*rows[:40]))
    got = metrics._counted(*map(list, plain))
    monkeypatch.setattr(metrics, "_KEY_BITS", 1)  # numbers instead of keys
    assert (metrics._counted(*map(list, plain)) == got).all()


def test_rows_are_counted_a_few_at_a_time(monkeypatch):
    held = []
    whole = metrics._counted
    monkeypatch.setattr(metrics, "_counted", lambda hyp, ref: held.append((len(hyp), sum(map(len, hyp + ref)))) or whole(hyp, ref))
    text = pd.Series(["a few words " * 250] * 300 + [""] * 1000)
    assert len(metrics._gram_counts.func(text, text)) == 1300
    assert sum(n for n, _ in held) == 1300 and max(n for n, _ in held) <= 256 and max(size for _, size in held) <= 200_000


def test_words_are_not_sent_to_python(spark):
    df = spark.createDataFrame([("a b.", "a c.")], "prediction string, reference string")
    plan = chrf(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "split(" not in plan
