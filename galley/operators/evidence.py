"""Evidence of proposals: binding to snapshots and image references, layers of revisions, identifiers, self-checks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

BOUND = ("task_id", "unit_id", "run_id", "source_sha256", "body_sha256", "proposal_revision")
# What a self-check with corrections must cover, the keys of evidence.
SELF_CHECKS = ("real_issue", "replacement_semantics", "related_coverage", "scope_and_uncertainty", "severity")
EVIDENCE_KEYS = ("assumptions", "symbols", "images", "calculations")


def bind(proposals: DataFrame, snapshots: DataFrame, by: tuple[str, ...] = ("unit_id",)) -> DataFrame:
    """Proposals with the identity of their unit's snapshot, ``conflicts`` and ``code``: a field that says something else is one."""
    rest = [c for c in proposals.columns if c not in BOUND]
    said = [c for c in BOUND if c in proposals.columns and c not in by]
    snap = snapshots.select(*by, *[F.col(c).alias(f"__{c}") for c in BOUND if c not in by])
    met = proposals.join(snap, list(by), "left")
    off = F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & (F.col(c) != F.col(f"__{c}")), F.lit(c)) for c in said])) if said else F.array().cast("array<string>")
    code = F.when(~F.coalesce(F.col("__proposal_revision") >= 1, F.lit(False)), "proposal-binding-unavailable").when(F.size("conflicts") > 0, "proposal-binding-conflict")
    full = met.withColumn("conflicts", off).withColumn("code", code)
    return full.select(*[F.col(c) if c in by else F.col(f"__{c}").alias(c) for c in BOUND], *[c for c in rest if c not in by], "conflicts", "code")


def image_errors(evidence: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """(key, reference_index, code) where image evidence and a source's references differ.

    Both have reference_index, original_path, actual_read_path, line and column; evidence also readable.  ``missing``:
    a reference without evidence; ``extra``: evidence without a reference; ``repeated``; ``mismatch``: another path or
    place, or not readable.
    """
    fields = ("original_path", "actual_read_path", "line", "column")
    w = Window.partitionBy(key, "reference_index")
    own = evidence.select(key, "reference_index", "readable", *[F.col(c).alias(f"e_{c}") for c in fields], F.count("*").over(w).alias("n")).dropDuplicates([key, "reference_index"])
    both = own.join(references.select(key, "reference_index", *fields, F.lit(True).alias("there")), [key, "reference_index"], "full_outer")
    same = F.coalesce(F.col("readable"), F.lit(False))
    for c in fields:
        same &= F.col(c).eqNullSafe(F.col(f"e_{c}"))
    code = F.when(F.col("n").isNull(), "missing").when(F.col("there").isNull(), "extra").when(F.col("n") > 1, "repeated").when(~same, "mismatch")
    return both.withColumn("code", code).where("code is not null").select(key, "reference_index", "code")


def identifier_errors(corrections: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """(key, id, code): corrections without an identifier or with a repeated one, evidence whose identifier is in use."""
    blank = corrections.where("coalesce(id, '') = ''").select(key, "id", F.lit("revise.correction-id").alias("code"))
    n = corrections.where("id <> ''").groupBy(key, "id").agg(F.count("*").alias("n"))
    twice = n.where("n > 1").select(key, "id", F.lit("revise.correction-id-duplicate").alias("code"))
    used = n.select(key, "id").withColumn("n", F.lit(1)).unionByName(evidence.where("id is not null").groupBy(key, "id").agg(F.count("*").cast("int").alias("n")))
    taken = used.groupBy(key, "id").agg(F.sum("n").alias("n")).where("n > 1").select(key, "id", F.lit("revise.evidence-id-duplicate").alias("code"))
    return blank.union(twice).union(taken)


def merge_layers(unit: DataFrame, local: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """(key, kind, id, text, owner): a unit's evidence after a revision.

    unit: evidence of the unit (key, kind, id, text, owner), owner being the correction that brought it in, if one did;
    local: evidence of corrections (key, owner, kind, id, text); corrections: (key, id, status, evidence_ids).  Inherited
    evidence of a withdrawn correction to which no active one refers goes (images stay); local evidence of active
    corrections joins it.
    """
    off = F.col("status").isin("retracted", "superseded")
    active = corrections.where(~F.coalesce(off, F.lit(False)))
    wanted = active.select(key, F.explode("evidence_ids").alias("id")).distinct().withColumn("wanted", F.lit(True))
    gone = corrections.where(off).select(key, F.col("id").alias("owner")).distinct().withColumn("gone", F.lit(True))
    kept = unit.join(gone, [key, "owner"], "left").join(wanted, [key, "id"], "left").where((F.col("kind") == "images") | F.col("gone").isNull() | F.col("wanted").isNotNull())
    new = local.join(active.select(key, F.col("id").alias("owner")).distinct(), [key, "owner"], "left_semi")
    return kept.select(key, "kind", "id", "text", "owner").unionByName(new.select(key, "kind", "id", "text", "owner"))


def image_observations(evidence: DataFrame, key: str) -> DataFrame:
    """(key, reference_index, observations): what is said of an image, in order, each once."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "semantic")))
    return evidence.groupBy(key, "reference_index").agg(F.array_join(F.array_distinct(F.transform(ordered, lambda x: x["semantic"])), "；").alias("observations"))


def shape_errors(evidence_json: Column) -> Column:
    """ARRAY<STRING>: keys that evidence must not have, then those that it lacks."""
    keys = F.coalesce(F.json_object_keys(evidence_json), F.array().cast("array<string>"))
    wanted = F.array(*map(F.lit, EVIDENCE_KEYS))
    name = lambda what: lambda k: F.concat(F.lit(what), k)
    return F.concat(F.transform(F.array_sort(F.array_except(keys, wanted)), name("unknown:")), F.transform(F.array_except(wanted, keys), name("missing:")))


def all_identifiers(*parts: Column) -> Column:
    """The identifiers of several lists of evidence, each once."""
    out = parts[0]
    for p in parts[1:]:
        out = F.array_union(out, p)
    return F.array_sort(out)


def self_check_errors(covered: Column, has_corrections: Column) -> Column:
    """ARRAY<STRING>: what a self-check leaves out; without corrections it need not cover replacements and severity."""
    none = F.array(F.lit("replacement_semantics"), F.lit("severity"))
    wanted = F.array(*map(F.lit, SELF_CHECKS))
    return F.array_except(F.when(has_corrections, wanted).otherwise(F.array_except(wanted, none)), F.coalesce(covered, F.array().cast("array<string>")))


def occurrences(spans: DataFrame, source: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start, end, old_text, occurrence): located corrections as text with its ordinal among all places, overlapping ones too."""
    met = spans.select(key, "start", "end").join(source.select(key, text), key).withColumn("old_text", F.substr(text, F.col("start") + 1, F.col("end") - F.col("start")))
    quoted = F.concat(F.lit("(?=\\Q"), F.col("old_text"), F.lit("\\E)"))
    before = F.substr(F.col(text), F.lit(1), F.col("end"))
    hits = F.size(F.regexp_extract_all(before, quoted, F.lit(0)))
    return met.select(key, "start", "end", "old_text", hits.alias("occurrence"))


def slots(found: DataFrame, audits: DataFrame, key: str) -> DataFrame:
    """(key, slot, num, verdict): marker slots with the audit of their number, ``unknown`` where there is none."""
    return found.join(audits.groupBy(key, "num").agg(F.min_by("verdict", "ord").alias("verdict")), [key, "num"], "left").select(key, "slot", "num", F.coalesce("verdict", F.lit("unknown")).alias("verdict"))


def bare(text: Column) -> Column:
    """The body that proposals are about: the whole source, as it is."""
    return text
