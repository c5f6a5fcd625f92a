"""Walks over nested JSON of unknown shape: leaves with their paths, identifiers, expressions of recorded calls, and what binds evidence to them.

A walk goes as deep as the values do, in the task that has the text: nothing is shuffled.  A row is a value; a step opens a few levels,
so that what a task holds at a time is a small multiple of one text.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..staging import staged

# Parameters that say whose a call is or what its words mean, and words in the names of those that hold an expression.
NO_EXPRESSION = ("task_id", "unit_id", "subject", "variables", "domain", "dim_operation", "operation", "target_units", "quantities", "unit_definitions", "substitutions")
EXPRESSIONS = ("expression", "formula", "equation")
#: Nesting beyond this ends a walk with an error; expressions further apart than so many edits are equally far.
DEPTH, EDITS = 90, 200
#: Levels that a step of a walk opens; each of them is as large as the text at most.
STEP = 10
_VALUES = "array<struct<path: string, depth: int, v: variant>>"


def _held(w: Column) -> Column:
    """(path, depth, v) of each value that an object or array holds; none of others."""
    part = lambda path, v: F.struct(path.alias("path"), (w["depth"] + 1).alias("depth"), v.alias("v"))
    named = lambda e: part(F.when(w["path"] == "", e["key"]).otherwise(F.concat(w["path"], F.lit("."), e["key"])), e["value"])
    numbered = lambda v, i: part(F.concat(w["path"], F.lit("["), i.cast("string"), F.lit("]")), v)
    items = F.map_entries(w["v"].try_cast("map<string, variant>")), w["v"].try_cast("array<variant>")  # null unless it is one
    return F.coalesce(F.transform(items[0], named), F.transform(items[1], numbered), F.array().cast(_VALUES))


def _opened(w: Column, levels: int) -> Column:
    """A value and all that it holds down to so many levels."""
    none = F.array().cast(_VALUES)
    start = F.struct(none.alias("done"), F.array(w).cast(_VALUES).alias("last"))
    further = lambda s, _: F.struct(F.concat(s["done"], s["last"]).alias("done"), F.flatten(F.transform(s["last"], _held)).alias("last"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), start, further, lambda s: F.concat(s["done"], s["last"]))


def values(df: DataFrame, key: str, json: str) -> DataFrame:
    """(key, path, depth, kind, value) of every value in JSON texts: ``object``, ``array``, ``string``, ``number``, ``boolean`` or ``null``.

    Paths are like ``a.b[0].c``, that of the whole is empty; values are texts, of objects and arrays in JSON.  What isn't JSON, and
    null, gives no row; keys may be null or repeated.
    """
    whole = F.struct(F.lit("").alias("path"), F.lit(0).alias("depth"), F.try_parse_json(F.col(json).cast("string")).alias("v"))
    found, w = df.select(F.col(key).alias("k"), whole.alias("w")), F.col("w")
    for depth in range(0, DEPTH, STEP):
        at = F.when(w["depth"] == depth, _opened(w, STEP)).otherwise(F.array(w))
        found = found.select("k", F.explode(at if depth else F.when(w["v"].isNotNull(), at)).alias("w"))  # a filter would parse the texts once more
    deeper = F.when(w["depth"] >= DEPTH, F.size(_held(w)) > 0).otherwise(False)
    found = found.where(F.when(deeper, F.raise_error(F.lit(f"nested deeper than {DEPTH}")).cast("boolean")).otherwise(True))
    found = found.select("k", "w.path", "w.depth", F.schema_of_variant("w.v").alias("kind"), F.col("w.v").cast("string").alias("value"))
    kind = F.when(F.col("kind").startswith("OBJECT"), "object").when(F.col("kind").startswith("ARRAY"), "array").when(F.col("kind") == "STRING", "string").when(F.col("kind") == "BOOLEAN", "boolean").when(F.col("kind") == "VOID", "null").otherwise("number")
    return found.select(F.col("k").alias(key), "path", "depth", kind.alias("kind"), F.when(F.col("kind") != "VOID", F.col("value")).alias("value"))


def string_leaves(df: DataFrame, key: str, json: str) -> DataFrame:
    """(key, path, value) of the strings in JSON texts; the path of a text that is one string is ``value``."""
    strings = values(df, key, json).where("kind = 'string'")
    return strings.select(key, F.when(F.col("path") == "", "value").otherwise(F.col("path")).alias("path"), "value")


def identifiers(df: DataFrame, key: str, json: str) -> DataFrame:
    """(key, id): each string that stands under ``id`` in an object, at any depth, once."""
    found = values(df, key, json).where((F.col("kind") == "string") & F.col("path").rlike(r"(?:^|\.)id$"))
    return found.select(key, F.col("value").alias("id")).distinct()


def shape(kind: Column, value: Column, most: int = 140) -> Column:
    """What a value is, for a diagnosis: an object's keys, an array's length, or the value."""
    keys = F.array_join(F.array_sort(F.json_object_keys(value)), ", ")
    said = F.when(kind == "object", F.concat(F.lit("object with "), keys)).when(kind == "array", F.concat(F.lit("array of "), F.coalesce(F.json_array_length(value), F.lit(0)).cast("string"))).otherwise(F.concat(kind, F.lit(": "), F.coalesce(value, F.lit("null"))))
    return F.substring(said, 1, most)


def expressions(leaves: DataFrame, key: str) -> DataFrame:
    """Of ``string_leaves`` of calls' parameters those that may be an expression: by their names, or all that aren't about something else."""
    part = F.split("path", r"\.|\[")
    may = leaves.where(~F.arrays_overlap(part, F.array(*map(F.lit, NO_EXPRESSION))))
    named = F.lower("path").rlike("|".join(EXPRESSIONS))
    return may.withColumn("__named", named).withColumn("__any", F.bool_or("__named").over(Window.partitionBy(key))).where("__named or not __any").drop("__named", "__any")


def _shared(a: Column, b: Column) -> Column:
    """How many characters two texts begin with alike: by halves, each stretch compared once."""
    n = F.least(F.length(a), F.length(b))
    longer = lambda p, k: F.when((p + k <= n) & (F.substr(a, p + 1, k) == F.substr(b, p + 1, k)), p + k).otherwise(p)
    return F.aggregate(F.array(*[F.lit(1 << k) for k in range(29, -1, -1)]), F.lit(0), longer)


def edits(a: Column, b: Column) -> Column:
    """Edits between two texts, ``EDITS + 1`` if there are more.

    What both begin and end with takes none, so only what is between is compared edit by edit: the cost is that of the difference, not of the texts.
    """
    pair = lambda x, y: F.struct(x.alias("a"), y.alias("b"))
    rest = lambda t: X.let(_shared(t["a"], t["b"]), lambda p: pair(F.reverse(F.substr(t["a"], p + 1)), F.reverse(F.substr(t["b"], p + 1))))
    n = X.let(pair(a, b), lambda t: X.let(rest(t), lambda u: X.let(rest(u), lambda v: F.levenshtein(v["a"], v["b"], EDITS))))
    return X.let(n, lambda n: F.when(n < 0, EDITS + 1).otherwise(n))


def calculation_errors(evidence: DataFrame, calls: DataFrame, key: str) -> DataFrame:
    """(key, item, call_id, error, nearest) of calculations in evidence that their recorded call doesn't bear out.

    evidence: (key, item, call_id, expression, result, task_id, unit_id, run_id, source_sha256), the last four of the unit at work;
    calls: (call_id, task_id, unit_id, run_id, source_sha256, success, params, result), params in JSON.  The first of: no such call,
    another unit's, another run's, of another source, failed, an expression that isn't a string in the parameters, another result.
    ``nearest`` is the expression of the call that takes the fewest edits, with its path, where the expression is what is wrong.
    """
    bound = ("task_id", "unit_id", "run_id", "source_sha256")
    there = calls.select("call_id", *[F.col(c).alias(f"c_{c}") for c in bound], "success", F.col("result").alias("c_result"), F.lit(True).alias("there"))
    leaves = staged(string_leaves(calls.join(evidence.select("call_id").distinct(), "call_id", "left_semi"), "call_id", "params"), "leaves")  # one walk for all that follows
    said = leaves.select("call_id", F.sha2("value", 256).alias("__digest")).distinct().withColumn("said", F.lit(True))  # whole texts don't travel to be compared
    met = evidence.withColumn("__digest", F.sha2("expression", 256)).join(there, "call_id", "left").join(said, ["call_id", "__digest"], "left")
    same = lambda c: F.col(c).eqNullSafe(F.col(f"c_{c}"))
    error = (
        F.when(F.col("there").isNull(), "call-missing").when(~(same("task_id") & same("unit_id")), "other-unit").when(~same("run_id"), "other-run").when(~same("source_sha256"), "other-source")
        .when(~F.coalesce("success", F.lit(False)), "call-failed").when(F.col("said").isNull(), "expression").when(~same("result"), "result")
    )
    wrong = met.withColumn("error", error).where("error is not null").select(key, "item", "call_id", "expression", "error")
    near = wrong.where("error = 'expression'").join(expressions(leaves, "call_id"), "call_id")
    closest = near.groupBy(key, "item").agg(F.min_by(F.concat("path", F.lit("="), "value"), F.struct(edits(F.col("expression"), F.col("value")).alias("apart"), "path")).alias("nearest"))
    return wrong.drop("expression").join(closest, [key, "item"], "left").select(key, "item", "call_id", "error", "nearest")
