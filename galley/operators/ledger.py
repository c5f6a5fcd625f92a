"""The append-only ledger in batch: progress, dispatch, budgets, cancellation, registration, status."""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Recovery budgets, codes that never recover, exact codes by category, prefixes in order of precedence.
BUDGETS = {"call_correction": 2, "calc_representation": 2, "report_repair": 3, "targeted_review": 2, "technical_redispatch": 1, "image_schema_fix": 2}
LINKED = {"image_schema_fix": ("image_schema_fix", "call_correction")}
FORBIDDEN = ("user-cancel", "user_cancel", "permission-denied", "permission_denied")
EXACT = {
    "call_correction": (
        "usage not_found unsupported host-edit-precondition host-tool-schema snapshot-stale unit-input-mismatch run-changed unit-set-mismatch identity-missing identity-mismatch "
        "unit-path-mismatch paper-path-mismatch manifest-required invalid-manifest workspace-required outside-workspace invalid-source invalid-material-name material-conflict "
        "layout-conflict invalid-boundaries mode-required mode-conflict invalid-execution-mode invalid-execution-origin execution-policy-required execution-policy-locked event-invalid "
        "cancel-invalid recovery-invalid recovery-error-code-required self-check-missing review-invalid review-stale review-issue-required review-legacy-not-supported parse-failed "
        "parse-v2-requires-submit data-invalid data-missing proposal-json-invalid proposal-invalid proposal-base-invalid proposal-binding-conflict proposal-binding-unavailable "
        "proposal-revision-stale source-overwrite archive-conflict output-required"
    ),
    "calc_representation": "calc_failed calc-evidence-invalid proposal.calc-call-mismatch",
    "report_repair": "verify_failed contract out-of-contract report-restore-mismatch report-changed",
    "image_schema_fix": "images-invalid",
    "technical_redispatch": "env host-timeout host-crash parent-technical-timeout",
}
PREFIXES = (
    ("anchor.", "interactive"), ("revise.", "interactive"), ("proposal.calc", "calc_representation"), ("proposal.", "call_correction"), ("location.", "call_correction"),
    ("calc", "calc_representation"), ("images.", "image_schema_fix"), ("syntax.", "report_repair"), ("reason.", "report_repair"), ("severity.", "report_repair"),
    ("original.", "report_repair"), ("integrity.", "report_repair"), ("locate.", "report_repair"), ("report.", "report_repair"), ("marker.", "report_repair"),
)


def error_category(code: Column) -> Column:
    """``forbidden``, an exact code's category, that of the first prefix that fits, or ``unclassified``."""
    out = F.when(code.isin(*FORBIDDEN), "forbidden")
    for category, codes in EXACT.items():
        out = out.when(code.isin(*codes.split()), category)
    for prefix, category in PREFIXES:
        out = out.when(code.startswith(prefix), category)
    return out.otherwise("unclassified")


def latest(events: DataFrame, *by: str, order: tuple[str, ...] = ("at", "seq")) -> DataFrame:
    """The last row of each key: a maximum of structs, so no partition is sorted."""
    rest = [c for c in events.columns if c not in by]
    return events.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("l")).select(*by, "l.*")


def progress(events: DataFrame, now: Column, stale_after: int = 900, done: Iterable[str] = ("submitted", "completed", "failed")) -> DataFrame:
    """(task_id, unit_id, phase, attempt_id, age, in_flight, stale) from (task_id, unit_id, seq, at, phase, attempt_id)."""
    last = latest(events, "task_id", "unit_id").withColumn("age", F.unix_timestamp(now) - F.unix_timestamp("at"))
    flying = ~F.col("phase").isin(*done)
    return last.select("task_id", "unit_id", "phase", "attempt_id", "age", flying.alias("in_flight"), (flying & (F.col("age") > stale_after)).alias("stale"))


def dispatch(units: DataFrame, window: int = 8) -> DataFrame:
    """Units (task_id, unit_id, unit_no, state, cancelled) that may start: the first of those not started, while the window has room; none once anything is cancelled."""
    load = units.groupBy("task_id").agg((window - F.count_if(F.col("state") == "in_flight")).alias("free"), F.coalesce(F.bool_or("cancelled"), F.lit(False)).alias("stop"))
    waiting = units.where("state = 'not_started'").withColumn("nth", F.row_number().over(Window.partitionBy("task_id").orderBy("unit_no", "unit_id")))
    return waiting.join(load, "task_id").where("not stop and nth <= free").select("task_id", "unit_id", "nth")


class Recovery:
    """Budgets of one unit in one run: idempotent by attempt, linked charges all or nothing, rejections without a trace."""

    def __init__(self, used: dict[str, int] | None = None, attempts: dict[str, list] | None = None):
        self.used, self.attempts = dict(used or {}), dict(attempts or {})

    def charge(self, attempt: str, category: str, fingerprint: str) -> str:
        """``allowed``, ``exhausted``, ``replay`` or ``conflict``; ``forbidden`` for what has no budget."""
        if attempt in self.attempts:
            return "replay" if self.attempts[attempt] == [category, fingerprint] else "conflict"
        if category not in BUDGETS:
            return "forbidden"
        owed = LINKED.get(category, (category,))
        if any(self.used.get(c, 0) >= BUDGETS[c] for c in owed):
            return "exhausted"
        for c in owed:
            self.used[c] = self.used.get(c, 0) + 1
        self.attempts[attempt] = [category, fingerprint]
        return "allowed"


class Cancellation:
    """Cancels of one unit. A user's stands for ever; a technical one must aim at the current attempt and can be revoked once."""

    REASONS = {"user": ("user_cancel",), "parent": ("technical_timeout", "superseded"), "host": ("technical_timeout", "superseded")}

    def __init__(self, log: list[list] | None = None, current: str | None = None):
        self.log, self.current = [list(x) for x in log or []], current

    def active(self) -> list | None:
        standing = [x for x in self.log if x[0] == "cancel" and not x[4]]
        return next((x for x in standing if x[2] == "user"), standing[-1] if standing else None)

    def cancel(self, attempt: str, initiator: str, reason: str) -> str:
        if reason not in self.REASONS.get(initiator, ()):
            return "invalid"
        if initiator != "user" and (attempt != self.current or any(x[0] == "cancel" and x[1] == attempt and not x[4] for x in self.log)):
            return "not-current"
        self.log.append(["cancel", attempt, initiator, reason, False])
        return "cancelled"

    def revoke(self, attempt: str, initiator: str, reason: str) -> str:
        if any(x[0] == "revoke" and x[1] == attempt for x in self.log):
            return "replay"
        standing = [x for x in self.log if x[0] == "cancel" and not x[4] and x[2] != "user"]
        if initiator == "user" or not standing or standing[-1][2:4] != [initiator, reason]:
            return "not-revocable"
        standing[-1][4] = True
        self.log.append(["revoke", attempt, initiator, reason, False])
        return "revoked"


def fold(rows: Iterable[dict], recovery: Recovery, cancels: Cancellation) -> list[tuple[int, str]]:
    """(seq, outcome) of a unit's events in order: heartbeats, charges, cancels, revokes, and registrations, which end what the unit has."""
    out = []
    for r in rows:
        kind, attempt = r["kind"], r["attempt_id"]
        if kind == "registered":
            recovery.used, recovery.attempts, cancels.log, cancels.current = {}, {}, [], None
            out.append((r["seq"], "registered"))
        elif kind == "event":
            ended = any(x[0] == "cancel" and x[1] == attempt and not x[4] for x in cancels.log)
            if not ended:
                cancels.current = attempt
            out.append((r["seq"], "terminated" if ended else "recorded"))
        elif kind == "recovery":
            out.append((r["seq"], recovery.charge(attempt, r["category"], r["fingerprint"])))
        else:
            act = cancels.cancel if kind == "cancel" else cancels.revoke
            out.append((r["seq"], act(attempt, r["initiator"], r["reason"])))
    return out


def registered(units: DataFrame, records: DataFrame, bound: tuple[str, ...] = ("run_id", "report_sha256", "inputs_sha256")) -> DataFrame:
    """Units with a record of the same run, report and inputs; a record without a data digest fits any."""
    cond = (F.col("u.unit_id") == F.col("r.unit_id")) & (F.col("r.data_sha256").isNull() | (F.col("r.data_sha256") == F.col("u.data_sha256")))
    for c in bound:
        cond &= F.col(f"u.{c}") == F.col(f"r.{c}")
    return units.alias("u").join(records.alias("r"), cond, "left_semi")


def unit_status(u: DataFrame) -> DataFrame:
    """Adds ``status`` from flags skip, legacy, has_report, has_note, gate_ok, registered, reviewed."""
    f = F.col
    return u.withColumn(
        "status",
        F.when(f("skip"), "skip").when(f("legacy"), "pending").when(~f("has_report"), F.when(f("has_note"), "failed").otherwise("not_started"))
        .when(f("gate_ok"), F.when(f("registered") & f("reviewed"), "completed").otherwise("pending")).otherwise(F.when(f("has_note"), "failed").otherwise("unverified")),
    )


STATES = ("completed", "pending", "not_started", "unverified", "failed", "skip")


def state_counts(statuses: DataFrame) -> DataFrame:
    """(status, n) with a row for every state, also those that don't occur."""
    spark = statuses.sparkSession
    every = spark.createDataFrame([(s,) for s in STATES], "status string")
    return every.join(statuses.groupBy("status").count(), "status", "left").select("status", F.coalesce("count", F.lit(0)).alias("n"))


def run_complete(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("run_id").agg(F.bool_and(F.col("status").isin("skip", "completed")).alias("complete"))
