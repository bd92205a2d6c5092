import json
import random

import pytest
from pyspark.sql import functions as F

from docquarry.functions import regexes
from docquarry.functions.scalars import compare, equal, literal, number_text, text
from docquarry.functions.values import Fields, double_text
from docquarry.operators.filters import where


@pytest.mark.parametrize(
    ("x", "said"),
    [(30, "30"), (0.1, "0.1"), (1e6, "1e+06"), (123456789, "1.23456789e+08"), (999999, "999999"), (1234567.5, "1.2345675e+06"), (1e-4, "0.0001"), (1.5e-4, "0.00015"), (1e-5, "1e-05"),
     (1.25e-7, "1.25e-07"), (1e100, "1e+100"), (-2.5, "-2.5"), (-0.0, "-0"), (0.0, "0"), (1e21, "1e+21"), (float("inf"), "+Inf"), (float("nan"), "NaN"), (100000.0, "100000")],
)
def test_number_text(spark, x, said):
    assert number_text(x) == said
    assert spark.range(1).select(double_text(F.lit(float(x))).alias("t")).first().t == said


def test_text_of_nested():
    assert text({"b": [1, "x", None], "a": True}) == "map[a:true b:[1 x <nil>]]"


def test_compare_and_equal():
    assert compare(2, 10) == -1 and compare("2", "10") == 1 and compare(5, "5") == 0 and compare(None, "a") == -1
    assert equal(30, "30") and not equal(True, 1)
    for a in (1, "1", True, None, 2.5, "b"):
        for b in (1, "1", True, None, 2.5, "b"):
            assert compare(a, b) == -compare(b, a)


def test_literal():
    assert literal("30") == 30 and literal('"30"') == "30" and literal("x") == "x" and literal("True") == "True" and literal(None) is None


VALUES = [1, 2, 10, -3.5, 1e6, 0, "1", "10", "abc", "", "true", "<nil>", True, False, None, [1, 2], {"b": 1, "a": "x"}, "é"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, json.dumps({"x": v})) for i, v in enumerate(VALUES)] + [(len(VALUES), "{}")]
    return spark.createDataFrame(rows, "id long, j string").select("id", F.parse_json("j").alias("data")).cache()


@pytest.mark.parametrize("op", ["eq", "neq", "gt", "gte", "lt", "lte", "contains"])
@pytest.mark.parametrize("want", [1, "1", 10, "abc", "", True, None, 1000000, "[1 2]", "map", "map[a:x", "zz"])
def test_leaves_agree_with_the_kernel(spark, docs, op, want):
    """Differential: every leaf over heterogeneous values against plain Python."""
    tests = {"eq": lambda v: equal(v, want), "neq": lambda v: not equal(v, want), "gt": lambda v: compare(v, want) > 0, "gte": lambda v: compare(v, want) >= 0, "lt": lambda v: compare(v, want) < 0, "lte": lambda v: compare(v, want) <= 0, "contains": lambda v: text(want) in text(v)}
    got = {r.id for r in where(docs, {"field": "x", "op": op, "value": json.dumps(want)}, "data").collect()}
    assert got == {i for i, v in enumerate(VALUES) if tests[op](v)}


def test_field_names_are_not_paths(spark):
    df = spark.createDataFrame([(1, '{"a.b": 1, "a": {"b": 2}, "it\'s": 3}')], "id long, j string").select("id", F.parse_json("j").alias("data"))
    assert where(df, {"field": "a.b", "op": "eq", "value": 1}, "data").count() == 1
    assert where(df, {"field": "it's", "op": "eq", "value": 3}, "data").count() == 1


def test_sort_key_follows_compare(spark):
    rng = random.Random(5)
    for pool in ([1, 2, 10, 1e6, -4, None], ["a", "b", "Z", "", None], [True, False, None]):
        values = [rng.choice(pool) for _ in range(30)]
        df = spark.createDataFrame([(i, json.dumps({"x": v})) for i, v in enumerate(values)], "id long, j string").select("id", F.parse_json("j").alias("data"))
        got = [r.id for r in df.orderBy(*Fields(df, "data")["x"].order(), "id").collect()]
        from functools import cmp_to_key

        assert got == sorted(range(30), key=cmp_to_key(lambda a, b: compare(values[a], values[b]) or a - b))


def test_regexes(spark):
    assert regexes.compiled(spark, "(?=a)") is None and regexes.compiled(spark, r"(a)\1") is None and regexes.compiled(spark, "(x") is None and regexes.compiled(spark, "a*+") is None
    assert regexes.compiled(spark, "(?P<n>x)") and regexes.compiled(spark, "[[:alpha:]_-]+$")
    df = spark.createDataFrame([("ab\n",), ("ab",), ("É",)], "t string")
    assert [r.t for r in df.where(F.col("t").rlike(regexes.compiled(spark, "ab$"))).collect()] == ["ab"]
    assert df.where(F.col("t").rlike(regexes.compiled(spark, "(?i)^é"))).count() == 1


def test_comparisons_need_no_python(docs):
    plan = where(docs, {"field": "x", "op": "gte", "value": 5}, "data")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
