"""States of units derived from what lies in their folders: sources, reports and their verification, notes of failure, registrations, reviews."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import ledger, reports
from .units import failure_note_issues

# Names of a unit's files.
REPORT, DATA, NOTE, SKIP = "_校对报告.md", "_校对数据.json", "_校对失败.md", ".skip_proofread"
BY = ("task_id", "unit")


def folders(files: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """(by, source, source_name, report, note, legacy, skip) of the files (by, name, text) of unit folders, a row a unit.

    The source is the file of the unit's own name, else the first Markdown file that isn't an artefact.  A report that is there
    and can't be read as text is empty.
    """
    name, text = F.col("name"), F.coalesce("text", F.lit(""))
    own = name == F.concat(F.col(by[-1]), F.lit(".md"))
    source = name.endswith(".md") & (own | ~name.startswith("_"))
    there = lambda n: F.max(F.when(name == n, text))
    legacy = F.get_json_object(there(DATA), "$.legacy_manual")
    return files.groupBy(*by).agg(
        F.min_by(F.when(source, text), F.when(source, F.struct(~own, name))).alias("source"), F.min_by(F.when(source, name), F.when(source, F.struct(~own, name))).alias("source_name"),
        there(REPORT).alias("report"), there(NOTE).alias("note"), F.coalesce(legacy == "true", F.lit(False)).alias("legacy"), F.bool_or(name == SKIP).alias("skip"),
    )


def first_line(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, r"\r\n|\n|\r", -1), X.strip), lambda x: x != "")
    return F.coalesce(F.get(lines, F.lit(0)), F.lit(""))


def derived(files: DataFrame, registered: DataFrame, reviewed: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """(by, status, reason, n_errors, n_warnings, n_markers, note_problems) of units by their files.

    registered: (by, report_sha256) of the registrations that count; reviewed: (by, report_sha256) of the reports that a
    current review accepted, which version 2 ones need.  A unit without a report is failed if there is a note, and else not
    started.  One whose report fails its verification is failed with a note and unverified without; one that passes is completed
    once it is registered and reviewed, and pending until then.  ``reason`` is the note's first line, the first three errors, or
    what is still missing.
    """
    units = folders(files, by).withColumn("__k", F.struct(*by))
    units = units.withColumn("__against", F.when(F.col("report").isNotNull(), F.col("source")))  # without a report nothing is verified
    checked = reports.judged(units, "__k", "report", "__against", (*by, "source", "report", "note", "legacy", "skip"))
    digest = F.when(F.col("report").isNotNull(), F.sha2("report", 256))
    known = lambda df, c: df.select(*by, F.col("report_sha256").alias("__digest"), F.lit(True).alias(c)).distinct()
    met = checked.withColumn("__digest", digest).join(known(registered, "__registered"), [*by, "__digest"], "left").join(known(reviewed, "__reviewed"), [*by, "__digest"], "left")
    none = F.expr("filter(issues, i -> false)")
    issues = F.when(F.col("report").isNotNull(), F.col("issues")).otherwise(none)
    of = lambda s: F.filter("__issues", lambda i: i["severity"] == s)
    told = met.withColumn("__issues", issues).withColumn("__errors", of("error"))
    v2 = F.coalesce(reports.is_v2(F.col("report")), F.lit(False))
    flags = told.withColumn("has_report", F.col("report").isNotNull()).withColumn("has_note", F.col("note").isNotNull()).withColumn("gate_ok", F.size("__errors") == 0).withColumn("registered", F.coalesce("__registered", F.lit(False))).withColumn("reviewed", F.coalesce("__reviewed", F.lit(False)) | ~v2)
    out = ledger.unit_status(flags)
    wrong = F.array_join(F.slice(F.transform("__errors", lambda i: i["code"]), 1, 3), "; ")
    noted = F.when(F.col("has_note") & (first_line(F.col("note")) != ""), first_line(F.col("note")))
    reason = (
        F.when(F.col("status") == "failed", F.coalesce(noted, F.nullif(wrong, F.lit("")), F.lit("failed before there was a report"))).when(F.col("status") == "unverified", wrong)
        .when(F.col("legacy") & (F.col("status") == "pending"), "delivered by hand").when((F.col("status") == "pending") & ~F.col("registered"), "not registered, or changed since").when(F.col("status") == "pending", "not reviewed, or sent back")
        .when((F.col("status") == "not_started") & F.col("source").isNull(), "no source")
    )
    marks = F.size(F.regexp_extract_all(F.coalesce(reports.sections(F.col("report"))["body"], F.lit("")), F.lit(r"【\d+\|"), F.lit(0)))
    return out.select(*by, "status", reason.alias("reason"), F.size("__errors").alias("n_errors"), F.size(of("warning")).alias("n_warnings"), marks.alias("n_markers"), F.when(F.col("status") == "failed", failure_note_issues(F.col("note"))).otherwise(F.array().cast("array<string>")).alias("note_problems"))
