"""Units under version: submissions, registrations and their undoing as commits to a folder that many sessions share.

A commit is data first and a name last.  The rows that it changes are written as Parquet under a name nobody knows, read back and
checked; then a small file ``commits/<n>.json`` that says where they are is brought into being, which only one writer can do for
each n.  A writer that comes too late judges its rows again on the state that there is now, where what others have changed is
stale.  One that dies before the name leaves the state as it was, and its data to ``vacuum``.  Readers need no lock: a state is all
commits up to the last one.
"""
from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import proposals, reports
from ..shipping import spread

#: Commits after which the whole state is written once more, so that a reader needn't fold all of them; and attempts of a commit.
FOLDED, TRIES = 16, 20
STATE = "task_id string, unit_id long, run_id string, source string, source_sha256 string, inputs_sha256 string, report_sha256 string, data_sha256 string, revision int, report string, registered_run string, registered_sha256 string, registered_inputs string"
BY = ("task_id", "unit_id")


class Conflict(RuntimeError):
    """A commit that others were faster than each time, or a folder that can't be committed to."""


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _store(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _read(spark: SparkSession, path: str) -> dict:
    stream = _store(spark, path).open(_path(spark, path))
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def _brought_into_being(spark: SparkSession, path: str, value: dict) -> bool:
    """Whether this writer has made the file, whole: a link to a finished one on this machine's file systems, a rename that replaces
    nothing where a name node decides."""
    data, passing = json.dumps(value, sort_keys=True).encode(), f"{path}.{uuid.uuid4().hex}.tmp"
    store = _store(spark, path)
    scheme = store.getUri().getScheme()
    if scheme == "file":
        local, final = urlparse(passing).path, urlparse(path).path
        os.makedirs(os.path.dirname(final), exist_ok=True)
        with open(local, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(local, final)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(local)
    if scheme not in ("hdfs", "viewfs"):
        raise Conflict(f"{scheme} can't make a file that isn't there yet")
    stream = store.create(_path(spark, passing), True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
    jvm = spark._jvm
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, path).toUri(), spark._jsc.hadoopConfiguration()).rename(_path(spark, passing), _path(spark, path), options)
        return True
    except Exception:
        store.delete(_path(spark, passing), False)
        if store.exists(_path(spark, path)):
            return False
        raise


def versions(spark: SparkSession, root: str) -> list[int]:
    """The numbers of a folder's commits, from 0; an empty list where there is none."""
    store, folder = _store(spark, root), _path(spark, f"{root}/commits")
    if not store.exists(folder):
        return []
    names = [s.getPath().getName() for s in store.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())


def history(spark: SparkSession, root: str) -> list[dict]:
    """What each commit says: version, kind, data, rows, full, at."""
    return [_read(spark, f"{root}/commits/{n}.json") for n in versions(spark, root)]


def state(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The units as they are, or were at a version: of each the row of its last commit."""
    known = versions(spark, root)
    if not known or (version is not None and version not in known):
        raise Conflict(f"{root} has no version {0 if version is None else version}")
    last, parts = known[-1] if version is None else version, []
    for n in range(last, -1, -1):
        said = _read(spark, f"{root}/commits/{n}.json")
        parts.append((n, said))
        if said["full"]:
            break
    rows = None
    for n, said in parts:
        if said["rows"]:
            own = spark.read.schema(STATE).parquet(f"{root}/data/{said['data']}").withColumn("__version", F.lit(n))
            rows = own if rows is None else rows.unionByName(own)
    if rows is None:
        return spark.createDataFrame([], STATE)
    if len(parts) == 1:
        return rows.drop("__version")
    names = [c for c in rows.columns if c not in (*BY, "__version")]
    return rows.groupBy(*BY).agg(F.max_by(F.struct(*names), "__version").alias("s")).select(*BY, "s.*")


def _staged(rows: DataFrame, root: str) -> tuple[str, int]:
    """Where rows have been written, and how many; what is read back must be what its digests say."""
    spark, name = rows.sparkSession, uuid.uuid4().hex
    path = f"{root}/data/{name}"
    whole = [f.split(" ") for f in STATE.split(", ")]
    rows.select(*[F.col(c).cast(t).alias(c) for c, t in whole]).write.parquet(path)
    back = spark.read.schema(STATE).parquet(path)
    n, wrong, twice = back.agg(F.count("*"), F.count_if(F.col("report").isNotNull() & ~F.col("report_sha256").eqNullSafe(F.sha2("report", 256))), F.count("*") - F.count_distinct(*BY)).first()
    if wrong or twice:
        _store(spark, path).delete(_path(spark, path), True)
        raise ValueError(f"{wrong} reports aren't what their digests say" if wrong else f"{twice} units are changed twice")
    return name, n


def commit_rows(spark: SparkSession, root: str, kind: str, changed: Callable[[DataFrame, DataFrame | None], DataFrame], judge: Callable[[DataFrame], DataFrame] | None = None, full: bool = False, before_name: Callable[[], None] | None = None) -> tuple[int, DataFrame | None]:
    """(version, outcome): one commit of the rows of the current state that change, and what ``judge`` has found about them.

    ``judge(state)`` is written, so that it is done once, and ``changed(state, outcome)`` gives the rows.  Both are called again on
    the newest state as often as another writer was faster.  Nothing is committed where no row changes.  ``before_name`` is called when the data are there and the name isn't (tests end the writer here).
    """
    for attempt in range(TRIES):
        known = versions(spark, root)
        n = known[-1] + 1 if known else 0
        current = state(spark, root, n - 1) if n else spark.createDataFrame([], STATE)
        outcome = None
        if judge is not None:
            found, told = judge(current), f"{root}/outcomes/{uuid.uuid4().hex}"
            found.write.parquet(told)
            outcome = spark.read.schema(found.schema).parquet(told)
        name, size = _staged(changed(current, outcome), root)
        path = f"{root}/data/{name}"
        if before_name:
            before_name()
        if not size and n and not full:
            _store(spark, path).delete(_path(spark, path), True)
            return n - 1, outcome
        if _brought_into_being(spark, f"{root}/commits/{n}.json", {"version": n, "kind": kind, "data": name, "rows": size, "full": full or n == 0, "at": time.time()}):
            since = next((k for k, x in enumerate(reversed(history(spark, root))) if x["full"]), 0)
            if since >= FOLDED and kind != "fold":
                commit_rows(spark, root, "fold", lambda now, _: now, full=True)
            return n, outcome
        _store(spark, path).delete(_path(spark, path), True)
        time.sleep(min(0.05 * 2**attempt, 2))
    raise Conflict(f"{root}: others were faster {TRIES} times")


def begin(units: DataFrame, root: str) -> int:
    """Version 0 of a folder: units (task_id, unit_id, run_id, source, inputs_sha256) without reports, a row each."""
    spark = units.sparkSession
    if versions(spark, root):
        raise Conflict(f"{root} has been begun")
    have = units.withColumn("source_sha256", F.sha2("source", 256))
    names = [f.split(" ") for f in STATE.split(", ")]
    rows = have.select(*[F.col(c) if c in have.columns else F.lit(None).cast(t).alias(c) for c, t in names])

    def first(now: DataFrame, _: None) -> DataFrame:
        if versions(spark, root):
            raise Conflict(f"{root} has been begun")
        return rows

    return commit_rows(spark, root, "begin", first)[0]


def judged(current: DataFrame, submissions: DataFrame) -> DataFrame:
    """What submissions (task_id, unit_id, seq, expected_snapshot_sha256, text) would do, (by, seq, outcome, revision, report_sha256), without doing it.

    A report passes the gate if its verification against the unit's source has no error.  Each is verified once, by all tasks, and
    not at all where it was made on another snapshot.
    """
    now = proposals.snapshots(current)
    met = spread(submissions.join(now.select(*BY, "source", F.col("snapshot_sha256").alias("__now")), list(BY)), *BY).withColumn("__k", F.struct(*BY, "seq"))
    stale = F.coalesce(F.col("expected_snapshot_sha256") != F.col("__now"), F.lit(False))  # whatever its report is like
    seen = met.withColumn("__seen", F.when(~stale, F.col("text"))).withColumn("__against", F.when(~stale, F.col("source")))
    checked = reports.judged(seen, "__k", "__seen", "__against", (*BY, "seq", "expected_snapshot_sha256", "text"))
    return proposals.submitted(now, checked.withColumn("ok", F.size(reports.errors_of(F.col("issues"))) == 0), BY)


def submit(submissions: DataFrame, root: str, before_name: Callable[[], None] | None = None) -> tuple[int, DataFrame]:
    """(version, outcomes): submissions judged on the newest state, and those accepted committed together with their reports.

    Outcomes (by, seq, outcome, revision, report_sha256) are ``accepted``, ``snapshot-stale`` and ``verify_failed``; all that are
    accepted are in one commit or none is.  A new report takes the registration of the old one away.
    """
    spark = submissions.sparkSession

    def changed(current: DataFrame, outcome: DataFrame) -> DataFrame:
        taken = outcome.where("outcome = 'accepted'").select(*BY, "seq", F.col("revision").alias("__revision"), F.col("report_sha256").alias("__digest"))
        new = taken.join(submissions.select(*BY, "seq", F.col("text").alias("__text")), [*BY, "seq"])
        rows = current.join(new, list(BY)).withColumn("revision", F.col("__revision")).withColumn("report_sha256", F.col("__digest")).withColumn("report", F.col("__text"))
        for c in ("registered_run", "registered_sha256", "registered_inputs"):
            rows = rows.withColumn(c, F.lit(None).cast("string"))
        return rows.drop("seq", "__revision", "__digest", "__text")

    return commit_rows(spark, root, "submit", changed, lambda current: judged(current, submissions), before_name=before_name)


def register(units: DataFrame, root: str) -> tuple[int, DataFrame]:
    """(version, outcomes): units (task_id, unit_id, run_id, report_sha256) registered, if they are still what the caller has seen.

    Outcomes: ``registered``, ``run-changed``, ``report-changed``, ``report-missing``; of several rows for a unit the first outcome by name counts.
    """
    spark = units.sparkSession

    def judge(current: DataFrame) -> DataFrame:
        seen = units.select(*BY, F.col("run_id").alias("__run"), F.col("report_sha256").alias("__seen"))
        met = current.join(seen, list(BY))
        what = F.when(F.col("report").isNull(), "report-missing").when(~F.col("run_id").eqNullSafe(F.col("__run")), "run-changed").when(~F.col("report_sha256").eqNullSafe(F.col("__seen")), "report-changed").otherwise("registered")
        return met.groupBy(*BY).agg(F.min(what).alias("outcome"))

    def changed(current: DataFrame, outcome: DataFrame) -> DataFrame:
        rows = current.join(outcome.where("outcome = 'registered'").select(*BY), list(BY), "left_semi")
        return rows.withColumn("registered_run", F.col("run_id")).withColumn("registered_sha256", F.col("report_sha256")).withColumn("registered_inputs", F.col("inputs_sha256"))

    return commit_rows(spark, root, "register", changed, judge)


def registered(current: DataFrame) -> DataFrame:
    """Units of a state with ``registered``: the run, report and inputs are those of the registration."""
    same = F.col("registered_sha256").isNotNull()
    for c, r in (("run_id", "registered_run"), ("report_sha256", "registered_sha256"), ("inputs_sha256", "registered_inputs")):
        same &= F.col(c).eqNullSafe(F.col(r))
    return current.withColumn("registered", same)


def undo(spark: SparkSession, root: str, version: int) -> int:
    """A new version whose state is that of an older one; what was committed since stays in the history."""
    return commit_rows(spark, root, f"undo:{version}", lambda now, _: state(spark, root, version), full=True)[0]


def vacuum(spark: SparkSession, root: str, older_than: float = 86400.0) -> list[str]:
    """Take away data that no commit names, and outcomes, once they are older than so many seconds: what writers that died have left."""
    store, named = _store(spark, root), {h["data"] for h in history(spark, root)}
    out = []
    for folder in ("data", "outcomes"):
        if not store.exists(_path(spark, f"{root}/{folder}")):
            continue
        for s in store.listStatus(_path(spark, f"{root}/{folder}")):
            name = s.getPath().getName()
            if (folder == "outcomes" or name not in named) and time.time() - s.getModificationTime() / 1000 > older_than:
                store.delete(s.getPath(), True)
                out.append(f"{folder}/{name}")
    return sorted(out)
