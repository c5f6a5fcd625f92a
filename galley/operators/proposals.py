"""Proposals: revisions compiled into located corrections and rendered as reports; snapshots, submissions, reviews, events."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as X
from . import compile as K
from . import locate, reports

# Fields of a correction, phases of a unit, phases that end an attempt, decisions of a review.
REQUIRED = ("id", "old_text", "new_text", "reason", "category", "severity", "evidence_ids")
OPTIONAL = ("context_before", "context_after", "occurrence")
PHASES = ("prepared", "read", "images", "calculated", "proposed", "self_checked", "verified", "registered", "parent_reviewed", "deliverable")
ENDED = ("awaiting_parent_review", "parent_reviewed", "needs_revision", "cancelled")
DECISIONS = ("accepted", "needs_revision")
_IMAGE = r"^!\[[^\]\n]*\]\([^)\n]*\)(?:\{[^}\n]*\})?$"
#: What a version 2 report begins with, and what surrounds its body.
HEAD, LENGTH, END = "<!-- galley-report-v2 -->", "<!-- galley-body-length:", "<!-- galley-body-end -->"


def schema() -> dict:
    """JSON schema of a proposal that a host fills in."""
    text = lambda most, least=0: {"type": "string", "maxLength": most} | ({"minLength": least} if least else {})
    fields = {"id": text(200, 1), "old_text": text(locate.MOST_OLD, 1), "new_text": text(K.MOST_NEW), "reason": text(K.MOST_REASON, 1), "category": text(200, 1), "severity": {"enum": list(reports.SEVERITIES[1:])}, "evidence_ids": {"type": "array", "items": {"type": "string"}}, "context_before": text(locate.MOST_CONTEXT), "context_after": text(locate.MOST_CONTEXT), "occurrence": {"type": "integer", "minimum": 1}}
    item = {"type": "object", "additionalProperties": False, "required": sorted(REQUIRED), "properties": fields}
    return {"type": "object", "additionalProperties": False, "required": ["schema_version", "corrections", "self_check"], "properties": {"schema_version": {"const": 3}, "corrections": {"type": "array", "items": item}, "unit_evidence": {"type": "object"}, "self_check": {"type": "object"}, "base_proposal_revision": {"type": "integer", "minimum": 1}, "withdrawn": {"type": "array"}}}


#: A correction as it is proposed, and as it is compiled.
CORRECTION = "id string, old_text string, new_text string, reason string, severity string, context_before string, context_after string, occurrence int"
COMPILED = "array<struct<ord: int, id: string, start: int, `end`: int, original: string, replacement: string, reason: string, severity: string, location_id: string, error: string>>"


def _fields(ddl: str) -> list[list[str]]:
    return [x.split(" ") for x in ddl.split(", ")]


def revisions(units: DataFrame, base: DataFrame, withdrawn: DataFrame, added: DataFrame, key: str, source: str) -> DataFrame:
    """(key, source, base, withdrawn, added): a row for each unit with its corrections as arrays; a row each of tables, in one shuffle.

    Corrections are ordered by their fields, so that rows may come in any order; corrections of unknown units are left out.
    """
    fields = _fields(CORRECTION)

    def role(df: DataFrame, name: str) -> DataFrame:
        there = [F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in fields]
        return df.select(key, F.lit(name).alias("__role"), F.struct(*there).alias("__c"), F.lit(None).cast("string").alias("__source"))

    blank = F.lit(None).cast("struct<" + ", ".join(f"{c}: {t}" for c, t in fields) + ">")
    rows = units.select(key, F.lit("unit").alias("__role"), blank.alias("__c"), F.col(source).alias("__source"))
    for df, name in ((base, "base"), (withdrawn, "withdrawn"), (added, "added")):
        rows = rows.unionByName(role(df, name))
    held = lambda name: F.array_sort(F.collect_list(F.when(F.col("__role") == name, F.col("__c"))))
    packed = rows.groupBy(key).agg(F.count_if(F.col("__role") == "unit").alias("__there"), F.max("__source").alias(source), *[held(x).alias(x) for x in ("base", "withdrawn", "added")])
    return packed.where("__there > 0").select(key, source, "base", F.transform("withdrawn", lambda c: c["id"]).alias("withdrawn"), "added")


def _guards(live: Column, base: Column, withdrawn: Column, added: Column) -> Column:
    """ARRAY<STRING>, one for each live correction: why its identifier can't stand; null where it can."""
    count = lambda of, x: F.size(F.filter(of, lambda y: y == x))
    ids = lambda of: F.transform(of, lambda c: c["id"])

    def made(b: Column, a: Column, w: Column) -> Column:
        def one(c: Column) -> Column:
            own = c["id"]
            twice = (count(a, own) > 1) | (count(b, own) > 1) | ((count(a, own) > 0) & (count(b, own) > 0))
            gone = (count(w, own) > 1) | ((count(w, own) > 0) & (count(b, own) == 0))
            return F.when(X.strip(F.coalesce(own, F.lit(""))) == "", "revise.correction-id").when(twice, "revise.correction-id-duplicate").when(gone, "revise.withdrawn")

        return F.transform(live, one)

    return X.let(ids(base), lambda b: X.let(ids(added), lambda a: X.let(withdrawn, lambda w: made(b, a, w))))


def _overlapping(spots: Column) -> Column:
    """ARRAY<INT>: the ordinals of spans (start, end, ord) in order that begin before one further left has ended."""
    zero = F.named_struct(F.lit("far"), F.lit(-1), F.lit("bad"), F.array().cast("array<int>"))
    step = lambda acc, s: F.named_struct(F.lit("far"), F.greatest(acc["far"], s["end"]), F.lit("bad"), F.when(s["start"] < acc["far"], F.array_append(acc["bad"], s["ord"])).otherwise(acc["bad"]))
    return F.aggregate(spots, zero, step)["bad"]


def compile_rows(df: DataFrame, key: str, source: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, source, corrections, *carry) of ``revisions``: the next revision's corrections, located, without a shuffle.

    What the base has and isn't withdrawn, and what is added, in this order.  ``error`` of a correction is the first of: an
    identifier that is missing or in use or a withdrawal that isn't allowed, an anchor that isn't found or isn't one place, a
    change of nothing, an image alone, an overlap with a correction further left.  Withdrawals of what isn't there, or more than
    one of the same, stand behind the corrections, as errors without a place, unless a correction of that identifier has the error.
    """
    live = X.let(F.col("withdrawn"), lambda w: F.concat(F.filter("base", lambda c: ~F.coalesce(F.array_contains(w, c["id"]), F.lit(False))), "added"))
    rows = df.select(key, source, "base", "withdrawn", "added", live.alias("__live"), *carry)
    rows = rows.select(key, source, "__live", _guards(F.col("__live"), F.col("base"), F.col("withdrawn"), F.col("added")).alias("__guard"), F.array_distinct(F.filter("withdrawn", lambda x: F.coalesce(x != "", F.lit(False)))).alias("__gone"), F.transform("base", lambda c: c["id"]).alias("__base"), "withdrawn", *carry)
    rows = locate.resolved(rows.withColumn("__hash", F.sha2(source, 256)), source, "__live", "__spots")
    spans = F.filter(F.transform("__spots", lambda s, i: F.named_struct(F.lit("start"), s["start"], F.lit("end"), s["end"], F.lit("ord"), i + 1)), lambda s: s["start"].isNotNull())
    rows = rows.withColumn("__over", _overlapping(F.array_sort(spans)))

    def one(c: Column, i: Column) -> Column:
        spot = F.get("__spots", i)
        original = F.substr(F.col(source), spot["start"] + 1, spot["end"] - spot["start"])
        error = F.coalesce(F.get("__guard", i), spot["error"], F.when(original == c["new_text"], "revise.noop").when(X.strip(original).rlike(_IMAGE), "revise.image-only").when(F.array_contains("__over", i + 1), "proposal.overlap"))
        token = F.when(spot["start"].isNotNull(), X.location_id(F.col("__hash"), spot["start"], spot["end"]))
        parts = {"ord": i + 1, "id": c["id"], "start": spot["start"], "end": spot["end"], "original": original, "replacement": c["new_text"], "reason": c["reason"], "severity": c["severity"], "location_id": token, "error": error}
        return F.named_struct(*[x for n, v in parts.items() for x in (F.lit(n), v)])

    count = lambda of, x: F.size(F.filter(of, lambda y: y == x))
    wrong = F.filter("__gone", lambda x: ((count(F.col("withdrawn"), x) > 1) | (count(F.col("__base"), x) == 0)) & ~F.exists("__live", lambda c: F.coalesce(c["id"] == x, F.lit(False))))
    names = ("start", "end", "original", "replacement", "reason", "severity", "location_id")
    bad = F.transform(wrong, lambda x, i: F.named_struct(F.lit("ord"), F.size("__live") + i + 1, F.lit("id"), x, *[y for n in names for y in (F.lit(n), F.lit(None).cast("int" if n in ("start", "end") else "string"))], F.lit("error"), F.lit("revise.withdrawn")))
    return rows.select(key, source, F.concat(F.transform("__live", one).cast(COMPILED), bad.cast(COMPILED)).alias("corrections"), *carry)


def compiled(units: DataFrame, base: DataFrame, withdrawn: DataFrame, added: DataFrame, key: str, source: str) -> DataFrame:
    """(key, ord, id, start, end, original, replacement, reason, severity, location_id, error): a row for each correction of ``compile_rows``."""
    return compile_rows(revisions(units, base, withdrawn, added, key, source), key, source).select(key, F.explode("corrections").alias("c")).select(key, "c.*")


def render_rows(df: DataFrame, key: str, source: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, source, summary, text, restored, proposal_sha256, error, *carry) of ``compile_rows``: a version 2 report where no correction has an error.

    Markers are numbered in order of the source, which the body restores to (``restored``).  Without shuffle.
    """
    errors = F.array_min(F.filter(F.transform("corrections", lambda c: c["error"]), lambda e: e.isNotNull()))
    span = lambda c: F.named_struct(*[x for n in ("start", "end", "reason", "id", "replacement") for x in (F.lit(n), c[n])])
    rows = df.select(key, source, errors.alias("error"), F.col("corrections").alias("__all"), *carry)
    rows = rows.withColumn("__cs", F.array_sort(F.transform(F.when(F.col("error").isNull(), F.col("__all")).otherwise(F.array().cast(COMPILED)), span)))
    cut = lambda a, b: F.substr(F.col(source), a + 1, b - a)
    zero = F.named_struct(F.lit("text"), F.lit(""), F.lit("at"), F.lit(0), F.lit("num"), F.lit(1))
    mark = lambda acc, c: F.concat(F.lit("【"), acc["num"].cast("string"), F.lit("|"), X.escape_field(cut(c["start"], c["end"])), F.lit("|"), X.escape_field(c["replacement"]), F.lit("】"))
    step = lambda acc, c: F.named_struct(F.lit("text"), F.concat(acc["text"], cut(acc["at"], c["start"]), mark(acc, c)), F.lit("at"), c["end"], F.lit("num"), acc["num"] + 1)
    spliced = X.let(F.aggregate("__cs", zero, step), lambda s: F.concat(s["text"], F.substr(F.col(source), s["at"] + 1, F.length(source))))
    heaviest = F.aggregate("__all", F.lit(0), lambda most, c: F.greatest(most, F.coalesce(K.rank(c["severity"]), F.lit(0))))
    summary = F.get(F.array(*map(F.lit, reports.SEVERITIES)), heaviest)
    rows = rows.withColumn("__body", spliced).withColumn("__summary", summary)
    reasons = F.array_join(F.transform("__cs", lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c["reason"])), "\n")
    n = F.length("__body").cast("string")
    text = F.concat(F.lit(HEAD), F.lit("\n总结："), "__summary", F.lit(f"\n\n{reports.MARKED}\n{LENGTH}"), n, F.lit(":"), n, F.lit(" -->\n"), "__body", F.lit(f"\n{END}\n{reports.REASONS}\n"), reasons, F.lit("\n"))
    ok = F.col("error").isNull()
    restored = X.restore(F.col("__body"), escaped=True) == F.col(source)
    return rows.select(key, source, F.when(ok, F.col("__summary")).alias("summary"), F.when(ok, text).alias("text"), restored.alias("restored"), F.when(ok, F.sha2(F.to_json("__cs"), 256)).alias("proposal_sha256"), "error", *carry)


def rendered(units: DataFrame, base: DataFrame, withdrawn: DataFrame, added: DataFrame, key: str, source: str) -> DataFrame:
    """``render_rows`` of tables: (key, source, summary, text, restored, proposal_sha256, error)."""
    return render_rows(compile_rows(revisions(units, base, withdrawn, added, key, source), key, source), key, source)


def snapshots(units: DataFrame) -> DataFrame:
    """Units (task_id, unit_id, run_id, source_sha256, inputs_sha256, report_sha256, data_sha256, revision) with ``next_revision`` and ``snapshot_sha256``."""
    nxt = F.coalesce(F.col("revision") + 1, F.lit(1))
    parts = {c: F.col(c) for c in ("task_id", "unit_id", "run_id", "source_sha256", "inputs_sha256", "report_sha256", "data_sha256")}
    return units.withColumn("next_revision", nxt).withColumn("snapshot_sha256", K.snapshot_digest(**parts, next_revision=nxt))


def submitted(current: DataFrame, submissions: DataFrame, by: tuple[str, ...] = ("task_id", "unit_id")) -> DataFrame:
    """(by, outcome, revision, report_sha256): what a batch of submissions does to the units; nothing is written.

    current: ``snapshots``; submissions: (by, seq, expected_snapshot_sha256, text, ok).  The first submission that was made
    on the current snapshot and passes its gate is accepted; later ones and others are ``snapshot-stale``, one that fails
    its gate is ``verify_failed`` and leaves the unit as it was.
    """
    own = submissions.select(*by, "seq", "expected_snapshot_sha256", "ok", F.sha2("text", 256).alias("__digest"))
    met = own.join(current.select(*by, "snapshot_sha256", "next_revision", "revision", F.col("report_sha256").alias("__report")), list(by))
    fresh = F.col("expected_snapshot_sha256") == F.col("snapshot_sha256")
    judged = met.withColumn("first", F.min(F.when(fresh & F.col("ok"), F.col("seq"))).over(Window.partitionBy(*by)))  # no join with itself: a gate is costly
    stale = ~fresh | (F.col("first").isNotNull() & (F.col("seq") > F.col("first")))
    outcome = F.when(stale, "snapshot-stale").when(~F.col("ok"), "verify_failed").otherwise("accepted")
    done = outcome == "accepted"
    return judged.select(*by, "seq", outcome.alias("outcome"), F.when(done, F.col("next_revision")).otherwise(F.coalesce("revision", F.lit(0))).alias("revision"), F.when(done, F.col("__digest")).otherwise(F.col("__report")).alias("report_sha256"))


def review_errors(reviews: DataFrame, current: DataFrame, by: tuple[str, ...] = ("task_id", "unit_id")) -> DataFrame:
    """Reviews (by, seq, decision, reviewer_id, issue, snapshot_sha256) with ``error``: an unknown decision, no reviewer, no issue where one is sent back, a stale snapshot."""
    met = reviews.join(current.select(*by, F.col("snapshot_sha256").alias("__now")), list(by), "left")
    blank = lambda c: F.length(X.strip(F.coalesce(c, F.lit("")))) == 0
    error = (
        F.when(~F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False)) | blank("reviewer_id"), "review-invalid").when((F.col("decision") == "needs_revision") & blank("issue"), "review-issue-required")
        .when(~F.coalesce(F.col("snapshot_sha256") == F.col("__now"), F.lit(False)), "review-stale")
    )
    return met.withColumn("error", error).drop("__now")


def reviewed(units: DataFrame, reviews: DataFrame, by: tuple[str, ...] = ("unit_id",), bound: tuple[str, ...] = ("run_id", "report_sha256", "proposal_sha256", "self_check_sha256", "inputs_sha256")) -> DataFrame:
    """Units with ``current``: whether the last review that is about all of a unit's digests accepted it."""
    cond = [*by, *bound]
    last = reviews.groupBy(*cond).agg(F.max_by("decision", "seq").alias("decision"))
    return units.join(last, cond, "left").withColumn("current", F.coalesce(F.col("decision") == "accepted", F.lit(False))).drop("decision")


def event_errors(events: DataFrame, runs: DataFrame, ended: DataFrame, by: tuple[str, ...] = ("task_id", "unit_id")) -> DataFrame:
    """Events (by, seq, phase, attempt_id, expected_run_id) with ``error``: an unknown phase or no attempt, another run, an attempt that has ended.

    runs: (task_id, run_id) as they are; ended: (by, attempt_id).
    """
    met = events.join(runs.select("task_id", F.col("run_id").alias("__run")), "task_id", "left").join(ended.select(*by, "attempt_id").distinct().withColumn("__ended", F.lit(True)), [*by, "attempt_id"], "left")
    bad = ~F.coalesce(F.col("phase").isin(*PHASES), F.lit(False)) | (F.coalesce("attempt_id", F.lit("")) == "")
    error = F.when(bad, "event-invalid").when(F.col("expected_run_id").isNotNull() & ~F.col("expected_run_id").eqNullSafe(F.col("__run")), "run-changed").when(F.col("__ended"), "attempt-terminated")
    return met.withColumn("error", error).drop("__run", "__ended")


def next_run(runs: DataFrame, started: DataFrame) -> DataFrame:
    """(task_id, run_id, status) once new runs (task_id, run_id) have started: what was in progress of their tasks is superseded."""
    again = started.select("task_id").distinct().withColumn("__again", F.lit(True))
    old = runs.join(again, "task_id", "left")
    status = F.when(F.col("__again") & (F.col("status") == "in_progress"), "superseded").otherwise(F.col("status"))
    return old.select("task_id", "run_id", status.alias("status")).unionByName(started.select("task_id", "run_id", F.lit("in_progress").alias("status")))


def read_location(token: Column, source: Column, expected: Column) -> Column:
    """STRUCT<start, end, error> of a location token: damaged, of another source, out of range, or of another text."""
    r = X.read_location(token)
    text = F.substr(source, r["s"] + 1, r["e"] - r["s"])
    bad = (r["s"] < 0) | (r["s"] >= r["e"]) | (r["e"] > F.length(source))
    error = F.when(r.isNull(), "location.invalid").when(r["h"] != F.sha2(source, 256), "location.stale").when(bad, "location.out-of-range").when(text != expected, "location.original-mismatch")
    return F.struct(F.when(error.isNull(), r["s"]).alias("start"), F.when(error.isNull(), r["e"]).alias("end"), error.cast(StringType()).alias("error"))
