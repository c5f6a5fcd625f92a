"""Repair of version 1 reports: their markers located in the source once more, and the body rebuilt from it."""
from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as X
from ..functions.reporttext import strip_preamble
from ..shipping import spread
from . import reports
from .locate import count_hits

#: Errors that a rebuilt body undoes.
MENDABLE = ("integrity.missing-paragraph", "integrity.extra-paragraph", "original.not-locatable")


def located_fields(df: DataFrame, key: str, body: str, source: str) -> DataFrame:
    """(key, ord, num, original, hits, start, end) of every marker: how often its original is in the source, and where if once."""
    each = reports.markers(df.select(key, body), key, body).select(key, "ord", "num", "original")
    met = each.join(df.select(key, F.col(source).alias("__source")), key)
    found = met.withColumn("hits", F.when(F.length("original") > 0, count_hits(F.col("__source"), F.col("original"))).otherwise(F.lit(0).cast("long")))
    start = F.when(F.col("hits") == 1, F.position(F.col("original"), F.col("__source")) - 1)
    return found.select(key, "ord", "num", "original", "hits", start.alias("start"), (start + F.length("original")).alias("end"))


def placed_fields(markers: Column, source: Column) -> Column:
    """Markers of ``reports.audited`` as (ord, num, original, replacement, hits, start, end): where a source has their originals, if once."""

    def one(m: Column) -> Column:
        hits = F.when(F.length(m["original"]) > 0, count_hits(source, m["original"])).otherwise(F.lit(0).cast("long"))
        start = F.when(hits == 1, F.position(m["original"], source) - 1)
        return F.named_struct(F.lit("ord"), m["ord"], F.lit("num"), m["num"], F.lit("original"), m["original"], F.lit("replacement"), m["replacement"], F.lit("hits"), hits, F.lit("start"), start, F.lit("end"), start + F.length(m["original"]))

    return F.transform(markers, one)


def field_codes(fields: Column) -> Column:
    """ARRAY<STRING>: why ``placed_fields`` can't be put back: repeated, empty, not found, found twice, out of order, overlapping."""
    none, unset = F.array().cast("array<string>"), F.lit(None).cast("int")

    def made(held: Column, numbers: Column) -> Column:
        def step(acc: Column, m: Column) -> Column:
            code = F.when(F.length(m["original"]) == 0, "repair.empty-original").when(m["hits"] == 0, "repair.original-not-found").when(m["hits"] > 1, "repair.original-not-unique")
            order = F.when(m["start"] < acc["start"], "repair.marker-order").when(m["start"] < acc["end"], "repair.marker-overlap")
            again = F.when(F.array_position(numbers, m["num"]) < m["ord"], "repair.duplicate-number")
            return F.named_struct(F.lit("start"), F.coalesce(m["start"], acc["start"]), F.lit("end"), F.coalesce(m["end"], acc["end"]), F.lit("codes"), F.concat(acc["codes"], F.array_compact(F.array(again, code, order))))

        return F.aggregate(held, F.named_struct(F.lit("start"), unset, F.lit("end"), unset, F.lit("codes"), none), step)["codes"]

    return X.let(fields, lambda held: X.let(F.transform(held, lambda m: m["num"]), lambda numbers: made(held, numbers)))


def structure_errors(text: Column) -> Column:
    """ARRAY<STRING>: what keeps a report from being cut into head, body and reasons."""
    n = lambda title: F.size(F.regexp_extract_all(text, F.lit(rf"(?m)^{title}[^\n]*$"), F.lit(0)))
    marked, why = n(reports.MARKED), n(reports.REASONS)
    order = F.when((marked == 1) & (why == 1) & (F.locate(reports.MARKED, text) > F.locate(reports.REASONS, text)), "report.section-order")
    return F.array_compact(F.array(F.when(marked != 1, "report.marked-section"), F.when(why != 1, "report.reasons-section"), order))


def unified_diff(before: str, after: str, name: str = "report") -> str:
    return "".join(difflib.unified_diff(before.splitlines(keepends=True), after.splitlines(keepends=True), name, f"{name} (repaired)"))


@F.pandas_udf(StringType())
def diff(before: pd.Series, after: pd.Series) -> pd.Series:
    """The unified diff of two texts; null if one is."""
    return pd.Series([None if a is None or b is None else unified_diff(a, b) for a, b in zip(before, after, strict=True)])


def candidates(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(key, ok, codes, repaired, diff) of version 1 reports: the body is the source with the report's markers in their places.

    ``codes`` says why a report can't be repaired: its version, an empty source, its structure, errors that a new body
    leaves, markers without one place; or what still fails once it has been rebuilt.  Then nothing is repaired.  A report is
    one row throughout: it is verified, its markers are placed, and what they make is verified again.  What can't be repaired
    anyhow isn't verified.
    """
    unix = lambda c: F.replace(F.replace(F.col(c), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    base = spread(df.select(key, unix(text).alias("__text"), unix(source).alias("__source")), key)
    head = F.regexp_extract("__text", rf"(?sm)\A.*?^{reports.MARKED}[^\n]*\n", 0)
    tail = F.regexp_extract("__text", rf"(?sm)^{reports.REASONS}.*\z", 0)
    early = F.when(reports.is_v2(F.col("__text")), F.array(F.lit("repair.v2-not-supported"))).when(F.length(X.strip(F.coalesce("__source", F.lit("")))) == 0, F.array(F.lit("repair.source-missing"))).otherwise(structure_errors(F.col("__text")))
    whole = base.select("*", head.alias("__head"), tail.alias("__tail"), early.alias("__early"))
    raw = F.substr("__text", F.length("__head") + 1, F.length("__text") - F.length("__head") - F.length("__tail"))
    asked = whole.withColumn("__go", F.size("__early") == 0).withColumn("__body", F.when(F.col("__go"), strip_preamble(raw)))
    marked = reports.audited(asked, "__body", out="__marks").withColumn("__fields", placed_fields(F.col("__marks"), F.col("__source")))
    marked = marked.select(key, "__text", "__source", "__head", "__tail", "__early", "__go", field_codes(F.col("__fields")).alias("__field_codes"), F.filter("__fields", lambda m: m["start"].isNotNull()).alias("__fields"))
    asked_of = marked.withColumn("__report", F.when(F.col("__go"), F.col("__text"))).withColumn("__against", F.when(F.col("__go"), F.col("__source")))
    first = reports.judged(asked_of, key, "__report", "__against", ("__text", "__source", "__head", "__tail", "__early", "__go", "__field_codes", "__fields"))
    none = F.array().cast("array<string>")
    lasting = F.array_except(reports.errors_of(F.col("issues")), F.array(*map(F.lit, MENDABLE)))
    codes = F.when(F.col("__go"), F.array_sort(F.array_union(lasting, "__field_codes"))).otherwise(F.col("__early"))
    judged = first.select(key, "__text", "__source", "__head", "__tail", codes.alias("__codes"), F.sort_array(F.transform("__fields", lambda m: F.named_struct(F.lit("start"), m["start"], F.lit("end"), m["end"], F.lit("mark"), F.concat(F.lit("【"), m["num"].cast("string"), F.lit("|"), m["original"], F.lit("|"), m["replacement"], F.lit("】"))))).alias("__spans"))
    zero = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    step = lambda acc, s: F.named_struct(F.lit("text"), F.concat(acc["text"], F.substr("__source", acc["at"] + 1, s["start"] - acc["at"]), s["mark"]), F.lit("at"), s["end"].cast("int"))
    woven = X.let(F.aggregate("__spans", zero, step), lambda w: F.concat(w["text"], F.substr("__source", w["at"] + 1, F.length("__source"))))
    rebuilt = X.let(woven, lambda body: F.concat("__head", body, F.when(body.endswith("\n"), "").otherwise("\n"), "__tail"))
    made = judged.select(key, "__text", "__source", "__codes", F.when(F.size("__codes") == 0, rebuilt).alias("repaired"))
    made = made.withColumn("__against", F.when(F.col("repaired").isNotNull(), F.col("__source")))
    last = reports.judged(made, key, "repaired", "__against", ("__text", "__codes", "repaired"))
    left = F.when(F.col("repaired").isNotNull(), reports.errors_of(F.col("issues"))).otherwise(none)
    out = last.select(key, F.concat("__codes", left).alias("codes"), "repaired", "__text").withColumn("ok", F.size("codes") == 0)
    out = out.withColumn("repaired", F.when(F.col("ok"), F.col("repaired")))
    return out.select(key, "ok", "codes", "repaired", diff(F.when(F.col("ok"), F.col("__text")), F.col("repaired")).alias("diff"))


def applied(df: DataFrame, repaired: DataFrame, key: str, text: str, expected: str | None = None) -> DataFrame:
    """(key, text, applied, before_sha256): reports with their repaired text where there is one.

    ``expected`` names a column with the digest that a caller has seen; a report that has changed since stays as it is.
    """
    met = df.join(repaired.select(key, "ok", "repaired"), key, "left")
    fresh = F.lit(True) if expected is None else F.coalesce(F.sha2(text, 256) == F.col(expected), F.lit(False))
    use = F.coalesce(F.col("ok"), F.lit(False)) & fresh
    return met.select(key, F.when(use, F.col("repaired")).otherwise(F.col(text)).alias("text"), use.alias("applied"), F.sha2(text, 256).alias("before_sha256"))


def legacy_parse_error(text: Column, registered: Column) -> Column:
    """Why a report isn't parsed the old way: a version 2 report is submitted, and what is registered isn't written over."""
    return F.when(reports.is_v2(text), "parse-v2-requires-submit").when(registered, "report-changed")
