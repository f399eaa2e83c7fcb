import json

from pyspark.sql import functions as F

from taskweave.functions.parsing import chosen_name, last_object, last_object_text, strict_pair


def apply(spark, texts, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("t"))).collect()]


def python_strict(text):
    try:
        d = json.loads(text)
    except (TypeError, ValueError):
        return None
    if not isinstance(d, dict) or not {"input", "output"} <= set(d) or d["input"] is None or d["output"] is None:
        return None
    pair = tuple(str(d[k]).strip() for k in ("input", "output"))
    return pair if all(pair) else None


def test_strict_pair(spark):
    texts = [
        '{"input": "1", "output": "a"}', ' {"input": " 1 ", "output": "a\\n"}\n', '{"input": "1, "output": "a"}', '{"input": "1", "label": "a"}',
        '{"input": "", "output": "a"}', '{"input": "1", "output": " "}', '{"input": 1, "output": 2.5}', '{"input": true, "output": "true"}',
        '{"input": false, "output": "b"}', '{"input": "a", "output": "b"} trailing', '{"input": "a", "output": "b"}{}', '[{"input": "a", "output": "b"}]',
        '{"input": "a", "output": "b"}]', '{"input": "a", "output": "b"}}] {x}', "{'input': 'a', 'output': 'b'}", '{"input": "a\nb", "output": "b"}',
        '{"input": "x", "output": "first", "output": "last"}', "5", "null", '"text"', "", None, '{"input": null, "output": "b"}',
        '{"input": "{}", "output": "}{"}', '{"input": "é 猫", "output": "\\u00e9"}', '{"extra": 1, "input": "a", "output": "b"}',
    ]
    got = apply(spark, texts, strict_pair)
    assert [None if g is None else (g["input"], g["output"]) for g in got] == [python_strict(t) for t in texts]


def test_last_object_text(spark):
    expected = {
        "": None, "no braces": None, "}": None, "{": None, "}{": None, "{}": "{}", "a {b} c": "{b}", "{a}{b}": "{b}",
        "{a{b}c}": "{a{b}c}", "{a}}": None, "{{a}": "{a}", "x {1} y {2 {3} } z {": "{2 {3} }", "{a} } b": None,
        "é {猫} 😀": "{猫}", '{"a": "}"}': None, '{"a": "{"}': '{"}', "{a} {b} tail": "{b}", "{\n}\n": "{\n}", "{a{b}": "{b}",
        "{{{}}}": "{{{}}}", "}}{{": None, "{}}{": None,
    }
    assert apply(spark, list(expected), last_object_text) == list(expected.values())


def test_last_object_fields(spark):
    texts = [
        'Sure!\n{"Instruction": " do it ", "Demonstrations": "a\nb"}', '{"Instruction": "x"}', '{"Instruction": "a", "Demonstrations": null}',
        'first {"Instruction": "1", "Demonstrations": "1"} then {"Instruction": "2", "Demonstrations": "2", "more": "3", "other": "4"}',
        '{"Instruction": "z", "Demonstrations": "b", "Instruction": "a"}', '{"Instruction": "a", "Demonstrations": "{"} }', '{"Instruction": "a", "Demonstrations": "b",}', None,
        '{"Instruction": ["x", "y"], "Demonstrations": 3}',
    ]
    got = apply(spark, texts, lambda c: last_object(c, ["Instruction", "Demonstrations"], ["more"]))
    assert got == [
        {"Instruction": "do it", "Demonstrations": "a\nb"}, None, {"Instruction": "a", "Demonstrations": None},
        {"Instruction": "2", "Demonstrations": "2", "more": "3"}, {"Instruction": "a", "Demonstrations": "b"}, None, None, None,
        {"Instruction": '["x","y"]', "Demonstrations": "3"},
    ]


def test_chosen_name(spark):
    texts = ["**code/puzzles**", "I take **a b** or **c**", "**a\nb** last.", "The best is v1.0.", "no_such_part", "", "  ", "****"]
    assert apply(spark, texts, chosen_name) == ["code/puzzles", "a b", "last", "v10", "no_such_part", "", "", ""]
