import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskweave.functions.text import fill, json_text, py_str, strip, words

DOUBLES = [
    0.0, -0.0, 1.0, 1.5, -2.25, 0.1, 1e7, 12345678.5, 123456789.0, 1e15, 1e16, 1.5e16, 1e20, 1e-4, 0.000123, 1e-5,
    1.5e-7, 1e-10, 1e100, -3.5e18, 112946.26, 9999999.0, float("nan"), float("inf"), float("-inf"),
]
STRINGS = ["", "a", "it's", 'say "x"', "it's \"x\"", "tab\there", "new\nline", "back\\slash", "café", "猫😀", "\x7f\x01"]


def rows(spark, values, dtype):
    return spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("v", dtype)]))


def shown(df, render):
    dtype = df.schema["v"].dataType
    return [r[0] for r in df.select(render(F.col("v"), dtype)).collect()]


@pytest.mark.parametrize(
    "dtype,values",
    [
        (T.DoubleType(), [*DOUBLES, None]),
        (T.LongType(), [0, -5, 2**40, None]),
        (T.BooleanType(), [True, False, None]),
        (T.StringType(), [*STRINGS[:-1], None]),
        (T.ArrayType(T.StringType()), [["a", "it's"], [], ['q"', None], STRINGS[:-1], None]),
        (T.ArrayType(T.DoubleType()), [[1.0, 2e20], [None]]),
        (T.StructType([T.StructField("x", T.LongType()), T.StructField("y", T.ArrayType(T.StringType()))]), [{"x": 1, "y": ["b"]}]),
        (T.MapType(T.StringType(), T.DoubleType()), [{"k": 1.5}]),
    ],
)
def test_py_str_is_str(spark, dtype, values):
    assert shown(rows(spark, values, dtype), py_str) == [str(v) for v in values]


@pytest.mark.parametrize(
    "dtype,values",
    [
        (T.StringType(), [*STRINGS, None]),
        (T.DoubleType(), [v for v in DOUBLES if v == v and abs(v) != float("inf")]),
        (T.BooleanType(), [True, False]),
        (T.ArrayType(T.StringType()), [["a", "é"], []]),
        (T.StructType([T.StructField("x é", T.LongType())]), [{"x é": 3}]),
    ],
)
def test_json_text_is_json_dumps(spark, dtype, values):
    assert shown(rows(spark, values, dtype), json_text) == [json.dumps(v) for v in values]


def test_strip_and_words_follow_python(spark):
    texts = ["  a b ", " x　", "\x1ca\x1d", "​q​", "", " \n\t", "a b\x85c  d"]
    df = rows(spark, texts, T.StringType())
    got = df.select(strip(F.col("v")), words(F.col("v"))).collect()
    assert [r[0] for r in got] == [t.strip() for t in texts]
    assert [list(r[1]) for r in got] == [t.split() for t in texts]


def test_fill_puts_values_into_holes(spark):
    got = spark.range(1).select(fill("a {x} {y}{x} {z}", x=F.lit("1"), y=F.lit("{x}"))).first()[0]
    assert got == "a 1 {x}1 {z}"
