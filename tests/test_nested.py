"""Walks over nested JSON."""
import json

import pytest
from pyspark.sql import functions as F

from galley.operators import nested

TEXTS = [(1, '{"id":"a","x":[{"id":"b","y":"s"},"t",[],{}],"n":null,"k.id":1}'), (1, '"top"'), (2, None), (3, "no json"), (None, '[{"id":["c"]}]'), (4, "[" * 40 + '"deep"' + "]" * 40)]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def walk(value, path=""):
    yield path
    if isinstance(value, dict):
        for k, v in value.items():
            yield from walk(v, f"{path}.{k}" if path else k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from walk(v, f"{path}[{i}]")


def test_values(spark):
    df = spark.createDataFrame(TEXTS, "k long, j string")
    found = nested.values(df, "k", "j")
    want = [(k, p) for k, j in TEXTS if j and j != "no json" for p in walk(json.loads(j))]
    assert rows(found.select("k", "path")) == sorted(want, key=str)
    kinds = {(r.k, r.path): (r.kind, r.value) for r in found.collect()}
    assert kinds[1, "n"] == ("null", None) and kinds[1, "x[1]"] == ("string", "t") and kinds[1, "x[3]"][0] == "object" and kinds[1, "x[2]"] == ("array", "[]")
    assert rows(nested.string_leaves(df, "k", "j").where("k = 1")) == [(1, "id", "a"), (1, "value", "top"), (1, "x[0].id", "b"), (1, "x[0].y", "s"), (1, "x[1]", "t")]
    assert rows(nested.identifiers(df, "k", "j")) == [(1, "a"), (1, "b")]
    shapes = {r.path: r.s for r in found.where("k = 1").select("path", nested.shape(F.col("kind"), F.col("value")).alias("s")).collect()}
    assert shapes["x"] == "array of 4" and shapes["x[0]"] == "object with id, y" and shapes["n"] == "null: null"
    assert nested.values(df.limit(0), "k", "j").count() == 0
    with pytest.raises(Exception, match="nested deeper"):
        nested.values(spark.createDataFrame([(1, "[" * 95 + "]" * 95)], "k long, j string"), "k", "j").count()


def test_a_walk_stays_in_the_tasks_that_have_the_texts(spark):
    texts = spark.createDataFrame([(i, "[" * (i % 3) + '{"a":[' + "1," * i + '2]}' + "]" * (i % 3)) for i in range(40)], "k long, j string").repartition(13)
    found = nested.values(texts, "k", "j")
    assert found.rdd.getNumPartitions() == 13  # the levels met in as many tasks as the first one's shuffle had
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == sum(i % 3 + 2 + i + 1 for i in range(40))


@pytest.mark.parametrize("levels", [8, 9, 10, 11, 19, 20, 21, 89])
def test_values_where_steps_of_a_walk_meet(spark, levels):
    inner = '{"b":[null,"s"],"c":{"d":{},"e":[[1.5]]}}' if levels < 80 else '["s"]'
    text = "[" * levels + f"{inner},{inner}" + "]" * levels
    found = rows(nested.values(spark.createDataFrame([(1, text), (1, text)], "k long, j string"), "k", "j"))
    want = [(1, p, d, v) for p, d, v in parts(json.loads(text))]
    assert [(k, p, d, v if kind == "string" else json.loads(v or "null")) for k, p, d, kind, v in found] == sorted(want + want, key=str)


def parts(value, path="", depth=0):
    yield path, depth, value
    for k, v in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ():
        yield from parts(v, f"{path}[{k}]" if isinstance(value, list) else f"{path}.{k}" if path else k, depth + 1)


def test_expressions(spark):
    calls = [(1, '{"expression_a":"x+1","other":"y","unit_definitions":{"formula":"z"}}'), (2, '{"a":["p","q"],"subject":"math"}'), (3, '{"subject":"math"}')]
    leaves = nested.string_leaves(spark.createDataFrame(calls, "k long, j string"), "k", "j")
    assert rows(nested.expressions(leaves, "k")) == [(1, "expression_a", "x+1"), (2, "a[0]", "p"), (2, "a[1]", "q")]


def test_parameters_of_calls_are_walked_once(spark):
    calls = spark.createDataFrame([("c1", "t", "u", "r", "s", True, '{"expression": "x+1"}', "2")], "call_id string, task_id string, unit_id string, run_id string, source_sha256 string, success boolean, params string, result string")
    said = spark.createDataFrame([("k", 1, "c1", "x+2", "2", "t", "u", "r", "s")], "key string, item int, call_id string, expression string, result string, task_id string, unit_id string, run_id string, source_sha256 string")
    found = nested.calculation_errors(said, calls, "key")
    assert "UnionLoop" not in found._jdf.queryExecution().optimizedPlan().toString()  # the walk was repeated for each use of its leaves
    assert [tuple(r) for r in found.collect()] == [("k", 1, "c1", "expression", "expression=x+1")]


def test_edits_cost_what_differs_and_not_the_texts(spark):
    long = "ab 中😀" * 60_000
    pairs = [("kitten", "sitting", 3), ("aaa", "aaaa", 1), ("aba", "aa", 1), ("", "", 0), ("", "x" * 201, 201), ("x" * 200, "", 200), ("é中😀", "é文😀", 1), ("a", None, None), (long, long + "!", 1), (long + "a" + long, long + "bc" + long, 2)]
    found = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "k int, a string, b string").select("k", nested.edits(F.col("a"), F.col("b")).alias("n"))  # quadratic in the texts before
    assert {r.k: r.n for r in found.collect()} == {i: n for i, (_, _, n) in enumerate(pairs)}
    calls = spark.createDataFrame([("c1", "t", "u", "r", "s", True, json.dumps({"expression": long}), "2")], "call_id string, task_id string, unit_id string, run_id string, source_sha256 string, success boolean, params string, result string")
    said = spark.createDataFrame([("k", i, "c1", e, "2", "t", "u", "r", "s") for i, e in enumerate([long, long + "!", None])], "key string, item int, call_id string, expression string, result string, task_id string, unit_id string, run_id string, source_sha256 string")
    errors = {r.item: (r.error, r.nearest) for r in nested.calculation_errors(said, calls, "key").collect()}
    assert errors == {1: ("expression", f"expression={long}"), 2: ("expression", f"expression={long}")}
