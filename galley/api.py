"""The engine's commands by name: each takes a session and keyword arguments and returns a DataFrame.

Tables are named by path (Parquet folders); results are DataFrames, so that a caller chooses where they go.
``python -m galley <command> key=value ...`` prints a command's rows as JSON lines, and an error as one JSON line.
"""
from __future__ import annotations

import hashlib
import importlib
import inspect
import json
import platform
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import calc as C
from .operators import corpus, images, ledger, locate, proposals, repair, reports, segment, status, units
from .sources import commits, delivery, materials

#: Exit codes of the command line.
EXIT = {"ok": 0, "usage": 2, "contract": 4, "env": 5}


class CommandError(ValueError):
    """A call that can't be answered: {code, message, details}."""

    def __init__(self, code: str, message: str, **details):
        super().__init__(message)
        self.code, self.details = code, details

    def to_dict(self) -> dict:
        return {"ok": False, "code": self.code, "message": str(self), "details": self.details}


def _table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def doctor(spark: SparkSession, schema_sha256: str | None = None) -> DataFrame:
    """(name, state, required): versions, optional modules, and whether the proposals' schema is the one a host expects."""
    rows = [("spark", spark.version, True), ("python", platform.python_version(), True)]
    for name in ("pyarrow", "pandas", "numpy", "PIL", "matplotlib", "sympy"):
        try:
            rows.append((name, getattr(importlib.import_module(name), "__version__", "present"), name in ("pyarrow", "pandas", "numpy")))
        except ImportError:
            rows.append((name, "absent", name in ("pyarrow", "pandas", "numpy")))
    digest = hashlib.sha256(json.dumps(proposals.schema(), sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    rows.append(("proposal-schema", digest if schema_sha256 in (None, digest) else "drift", True))
    return spark.createDataFrame(rows, "name string, state string, required boolean")


def inspect_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, chars, lines, headings, tables, images, formulas, preview): what a material's Markdown holds."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = lambda pattern: F.size(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))
    lines = F.when(F.length(t) == 0, 0).otherwise(F.size(F.split(F.regexp_replace(t, r"\n\z", ""), "\n", -1)))
    return df.select(key, F.length(t).alias("chars"), lines.alias("lines"), n(r"(?m)^#{1,6}\s").alias("headings"), n(r"(?m)^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*\|").alias("tables"), n(r"!\[[^\]\n]*\]\([^)\n]*\)").alias("images"), n(r"\$[^$\n]+\$").alias("formulas"), F.substring(t, 1, 200).alias("preview"))


def _schemas(spark: SparkSession, made: dict[str, dict]) -> DataFrame:
    return spark.createDataFrame([(k, json.dumps(v, ensure_ascii=False, sort_keys=True)) for k, v in made.items()], "name string, schema string")


def calc_schema(spark: SparkSession) -> DataFrame:
    """(name, schema) of every calculation: its required parameters."""
    return _schemas(spark, {name: {"type": "object", "required": list(required)} for name, (_, required) in sorted(C.OPERATIONS.items())})


def calculate(spark: SparkSession, operation: str, params: str = "{}") -> DataFrame:
    return spark.range(1).select(C.calc(F.lit(operation), F.lit(params)).alias("c")).select("c.*")


def _split(spark: SparkSession, texts: str, mode: str = "exam", strategy: str = "rules", key: str = "id", text: str = "text") -> DataFrame:
    return segment.split_material(segment.to_lines(_table(spark, texts), key, text), key, mode, strategy)


def _slice(spark: SparkSession, texts: str, slices: str, key: str = "id", text: str = "text") -> DataFrame:
    return segment.coverage(segment.to_lines(_table(spark, texts), key, text), _table(spark, slices), key)


def _policies(spark: SparkSession, runs: str) -> DataFrame:
    return units.new_policies(_table(spark, runs))


def _progress(spark: SparkSession, events: str, now: str, stale_after: int = 900) -> DataFrame:
    return ledger.progress(_table(spark, events), F.lit(now).cast("timestamp"), int(stale_after))


def _folded(spark: SparkSession, events: str) -> DataFrame:
    from .streaming.ledger import fold_stream

    return fold_stream(_table(spark, events))


def _submit(spark: SparkSession, submissions: str, state: str = "", store: str = "") -> DataFrame:
    """Outcomes of submissions: against a table of units, which stays as it is, or committed to a store of versions."""
    if bool(state) == bool(store):
        raise CommandError("usage", "either a state to look at or a store to commit to")
    if store:
        return commits.submit(_table(spark, submissions), store)[1]
    return proposals.submitted(proposals.snapshots(_table(spark, state)), _table(spark, submissions))


def _register(spark: SparkSession, units: str, store: str) -> DataFrame:
    return commits.register(_table(spark, units), store)[1]


def _state(spark: SparkSession, store: str, version: str = "") -> DataFrame:
    return commits.registered(commits.state(spark, store, int(version) if version else None))


def inspect_images(spark: SparkSession, texts: str, folder: str = "", key: str = "id", text: str = "text") -> DataFrame:
    """References of images outside code, or, with the folder of their files, what is wrong with each: (key, reference_index, path, code).

    Files are named by their path below the folder, or below that of the text's key there; copies on white stand beside them.
    """
    df = _table(spark, texts)
    refs = corpus.image_references(df, key, text)
    if not folder:
        return refs
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString()
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.substring("path", len(root) + 2, 1 << 20).alias("name"), images.summary("content").alias("s"), F.sha2("content", 256).alias("sha256")).select("name", "s.*", "sha256")
    own = df.select(F.col(key), F.col(key).cast("string").alias("__own"))
    named = lambda rows: rows.withColumn("__first", F.substring_index("name", "/", 1)).withColumn("__rest", F.regexp_replace("name", "^[^/]*/", ""))
    whole = named(found)
    below = own.join(whole, F.col("__own") == F.col("__first")).select(key, F.col("__rest").alias("path"), "format", "alpha", "sha256")
    shared = refs.select(key, "path").distinct().join(whole.select(F.col("name").alias("path"), "format", "alpha", "sha256"), "path").select(key, "path", "format", "alpha", "sha256")
    files = below.unionByName(shared.join(below.select(key, "path"), [key, "path"], "left_anti"))
    copies = files.select(key, F.col("path").alias("__copy"), (F.col("format") == "png").alias("white_readable"))
    with_copy = files.withColumn("__copy", images.white_copy_name(F.col("path"), F.col("sha256"))).join(copies, [key, "__copy"], "left")
    is_copy = F.col("path").rlike(r"\.white-[0-9a-f]{16}\.png$")
    judged = with_copy.where(~is_copy).select(key, "path", F.col("format").isNotNull().alias("readable"), F.coalesce("alpha", F.lit(False)).alias("transparent"), "white_readable")
    return images.inspect(refs.withColumn("syntax", F.lit("inline")), judged, key)


def _status(spark: SparkSession, flags: str = "", files: str = "", registered: str = "", reviewed: str = "") -> DataFrame:
    """States of units from a table of flags, or from the files of their folders with registrations and reviews, if there are any."""
    if bool(flags) == bool(files):
        raise CommandError("usage", "either flags of units or the files of their folders")
    if flags:
        return ledger.unit_status(_table(spark, flags))
    held = _table(spark, files)
    none = held.select(*status.BY, F.lit("").alias("report_sha256")).where("false")
    return status.derived(held, _table(spark, registered) if registered else none, _table(spark, reviewed) if reviewed else none)


def _docx(spark: SparkSession, paper_units: str, paper: str = "paper") -> DataFrame:
    return delivery.word_files(_table(spark, paper_units), paper)


#: name: (function of (session, keywords), what it does)
COMMANDS: dict[str, tuple[Callable[..., DataFrame], str]] = {
    "check-env": (doctor, "versions, modules, schema drift"),
    "inspect-source": (lambda spark, path: inspect_text(materials.materials(spark, path), "path", "markdown"), "structure of source files"),
    "inspect-images": (inspect_images, "image references outside code, and what is wrong with their files"),
    "convert": (lambda spark, path, with_comments="": materials.materials(spark, path, bool(with_comments)), "source files to Markdown"),
    "import": (lambda spark, path, mode="exam", strategy="rules": segment.split_material(segment.to_lines(materials.materials(spark, path).where("error is null"), "path", "markdown"), "path", mode, strategy), "source files to units"),
    "split": (_split, "texts to units"),
    "slice": (_slice, "coverage of slices over lines"),
    "precheck-split": (lambda spark, made, key="id", overlong=20000: segment.precheck(_table(spark, made), key, int(overlong)), "lengths of units"),
    "status": (_status, "states of units, by flags or by the files in their folders"),
    "execution-policy": (_policies, "authorisation of runs"),
    "unit-locate": (lambda spark, texts, phrase, key="id", text="text": locate.locations(_table(spark, texts), key, text, phrase), "all places of a phrase"),
    "unit-read": (lambda spark, texts, start=1, lines=2000, key="id", text="text": units.page(_table(spark, texts), key, text, int(start), int(lines)), "a page of sources"),
    "unit-snapshot": (lambda spark, state: proposals.snapshots(_table(spark, state)), "snapshots of units"),
    "unit-submit": (_submit, "outcome of submissions, committed if a store is named"),
    "unit-register": (_register, "registrations committed to a store"),
    "unit-state": (_state, "units of a store, as they are or were at a version"),
    "unit-recovery": (_folded, "budgets, cancels and events folded"),
    "unit-progress": (_progress, "last phase of units"),
    "dispatch-plan": (lambda spark, state, window=8: ledger.dispatch(_table(spark, state), int(window)), "units that may start"),
    "unit-event": (lambda spark, events, runs, ended: proposals.event_errors(_table(spark, events), _table(spark, runs), _table(spark, ended)), "events and why they are rejected"),
    "unit-cancel": (_folded, "cancels and revokes folded"),
    "unit-schema": (lambda spark: _schemas(spark, {"proposal": proposals.schema()}), "schema of proposals"),
    "unit-review": (lambda spark, reviews, state: proposals.review_errors(_table(spark, reviews), proposals.snapshots(_table(spark, state))), "reviews and why they are rejected"),
    "verify-report": (lambda spark, table, key="id", text="report", source="source": reports.verify(_table(spark, table), key, text, source), "issues of reports"),
    "parse-report": (lambda spark, table, key="id", text="report": reports.parse(_table(spark, table), key, text), "corrections of reports"),
    "repair-report": (lambda spark, table, key="id", text="report", source="source": repair.candidates(_table(spark, table), key, text, source), "rebuilt reports"),
    "calc-schema": (calc_schema, "parameters of calculations"),
    "calc": (calculate, "a calculation"),
    "quantities": (lambda spark, configs, subject, search="": materials.quantities(materials.subject_configs(spark, configs), subject, search), "quantities of a subject"),
    "build-report": (lambda spark, paper_units, paper="paper": corpus.paper_report(_table(spark, paper_units), paper), "a report of each paper"),
    "build-docx": (_docx, "a Word file of each paper"),
}


def run(spark: SparkSession, command: str, **arguments) -> DataFrame:
    if command not in COMMANDS:
        near = units.closest(spark.createDataFrame([(command,)], "c string"), "c", tuple(COMMANDS)).first()["nearest"]
        raise CommandError("usage", f"unknown command {command!r}", suggestion=near)
    made = COMMANDS[command][0]
    try:
        inspect.signature(made).bind(spark, **arguments)
    except TypeError as e:
        raise CommandError("usage", str(e), command=command) from e
    return made(spark, **arguments)
