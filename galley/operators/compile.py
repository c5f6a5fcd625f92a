"""Compiling located corrections into marked reports: merging revisions, overlap, severity, splicing."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .locate import MOST_OLD
from .reports import SEVERITIES


def rank(severity: Column) -> Column:
    """0 for no problem, up to the heaviest; null for what is no severity."""
    return F.nullif(F.array_position(F.array(*map(F.lit, SEVERITIES)), severity).cast("int"), F.lit(0)) - 1


def heaviest(corrections: DataFrame, key: str) -> DataFrame:
    return corrections.groupBy(key).agg(F.coalesce(F.max_by("severity", rank(F.col("severity"))), F.lit(SEVERITIES[0])).alias("summary"))


def overlaps(spans: DataFrame, key: str) -> DataFrame:
    """Spans that begin before one further left has ended."""
    w = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("left_end", F.max("end").over(w)).where("start < left_end")


def splice(df: DataFrame, corrections: DataFrame, key: str, source: str) -> DataFrame:
    """(key, body, restored): markers ``【n|original|replacement】`` put in order of start; restored equals the source.

    Corrections (key, start, end, replacement) must not overlap; fields are escaped. Sources without any stay as they are.
    """
    w = Window.partitionBy(key).orderBy("start", "end")
    span = F.struct("num", "start", "end", "replacement")
    ordered = corrections.withColumn("num", F.row_number().over(w)).groupBy(key).agg(F.array_sort(F.collect_list(span)).alias("cs"))
    joined = df.select(key, source).join(ordered, key, "left")
    cut = lambda a, b: F.substr(F.col(source), a + 1, b - a)
    mark = lambda c: F.concat(F.lit("【"), c["num"].cast("string"), F.lit("|"), X.escape_field(cut(c["start"], c["end"])), F.lit("|"), X.escape_field(c["replacement"]), F.lit("】"))
    zero = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    step = lambda acc, c: F.struct(F.concat(acc["text"], cut(acc["at"], c["start"]), mark(c)).alias("text"), c["end"].cast("int").alias("at"))
    spliced = F.aggregate("cs", zero, step)
    made = joined.withColumn("sp", spliced).withColumn("body", F.when(F.col("cs").isNull(), F.col(source)).otherwise(F.concat("sp.text", F.substr(F.col(source), F.col("sp.at") + 1, F.length(F.col(source))))))
    return made.select(key, "body", X.restore(F.col("body"), escaped=True).alias("restored"))


def merge_revision(base: DataFrame, withdrawn: DataFrame, added: DataFrame, key: str) -> DataFrame:
    """The corrections of the next revision: what the base has and isn't withdrawn, and what is added."""
    return base.join(withdrawn.select(key, "id").distinct(), [key, "id"], "left_anti").unionByName(added, allowMissingColumns=True)


def revision_errors(base: DataFrame, withdrawn: DataFrame, added: DataFrame, key: str) -> DataFrame:
    """(key, id, code): withdrawals of what isn't there or twice, and added identifiers in use."""
    many = withdrawn.groupBy(key, "id").count().where("count > 1").select(key, "id", F.lit("revise.withdrawn").alias("code"))
    gone = withdrawn.join(base, [key, "id"], "left_anti").select(key, "id", F.lit("revise.withdrawn").alias("code"))
    used = added.join(base, [key, "id"], "left_semi").select(key, "id", F.lit("revise.correction-id-duplicate").alias("code"))
    twice = added.groupBy(key, "id").count().where("count > 1").select(key, "id", F.lit("revise.correction-id-duplicate").alias("code"))
    return many.union(gone).union(used).union(twice).distinct()


def dangling(corrections: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """(key, id, evidence_id) of references to evidence that isn't there."""
    return corrections.select(key, "id", F.explode("evidence_ids").alias("evidence_id")).join(evidence.select(key, "evidence_id").distinct(), [key, "evidence_id"], "left_anti")


def prunable(corrections: DataFrame, key: str) -> DataFrame:
    """(key, evidence_id) of evidence that only inactive corrections own: nothing active refers to it."""
    each = corrections.select(key, "id", F.col("status").isin("retracted", "superseded").alias("off"), F.explode("evidence_ids").alias("evidence_id"))
    return each.groupBy(key, "evidence_id").agg(F.min("off").alias("all_off")).where("all_off").select(key, "evidence_id")


def binding_errors(evidence: DataFrame, calls: DataFrame, bound: tuple[str, ...]) -> DataFrame:
    """(call_id, code): the first condition that a calculation's evidence and its recorded call fail, if any."""
    there = calls.select("call_id", F.lit(True).alias("__there"), F.col("success").alias("__success"), *[F.col(c).alias(f"__{c}") for c in bound])
    joined = evidence.join(there, "call_id", "left")
    code = F.when(F.col("__there").isNull(), "call-missing").when(~F.col("__success"), "call-failed")
    for c in bound:
        code = code.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), f"{c}-mismatch")
    return joined.withColumn("code", code).where("code is not null").select("call_id", "code")


#: Characters of a correction's new text and of its reason, at most; its old text is an anchor.
MOST_NEW = MOST_REASON = 2000


def revision_limits(old: Column, new: Column, reason: Column) -> Column:
    """ARRAY<STRING> of all limits that a correction breaks."""
    long = (F.length(old) > MOST_OLD) | (F.length(new) > MOST_NEW) | (F.length(reason) > MOST_REASON)
    checks = (("revise.too-long", long), ("revise.reason-empty", F.length(X.strip(F.coalesce(reason, F.lit("")))) == 0), ("revise.noop", old == new))
    return F.array_compact(F.array(*[F.when(when, F.lit(code)) for code, when in checks]))


def revision_input_error(old: Column, new: Column, reason: Column) -> Column:
    """The code of the first limit that a correction breaks; null if none."""
    return F.get(revision_limits(old, new, reason), F.lit(0))


def snapshot_digest(**parts: Column) -> Column:
    """SHA-256 of canonical JSON: keys in order, no blanks."""
    return F.sha2(F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)]), {"ignoreNullFields": "false"}), 256)
