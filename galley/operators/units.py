"""Units and their materials: folders, manifests, pages of a source, identities, notes of failure, authorisations."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import ledger

MOST_LINES = 2000
MANIFEST = "schema_version int, material_name string, task_id string, unit_ids map<string,string>, current_run_id string, unit_set array<string>, broken string"


def page(df: DataFrame, key: str, text: str, start_line: int = 1, max_lines: int = MOST_LINES) -> DataFrame:
    """(key, line_start, line_end, line_count, next_line, content, source_sha256): a page of every source, by lines from 1."""
    if start_line < 1 or not 1 <= max_lines <= MOST_LINES:
        raise ValueError("unit-read-range")
    lines = F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(X.lines(F.col(text)))
    cut = df.select(key, text, lines.alias("ls")).withColumn("own", F.slice("ls", start_line, max_lines))
    some, end = F.size("own") > 0, F.lit(start_line - 1) + F.size("own")
    return cut.select(
        key, F.when(some, F.lit(start_line)).alias("line_start"), F.when(some, end).alias("line_end"), F.size("ls").alias("line_count"),
        F.when(end < F.size("ls"), end + 1).alias("next_line"), F.array_join("own", "\n").alias("content"), F.sha2(text, 256).alias("source_sha256"),
    )


def read_manifests(texts: DataFrame, path: str = "path", text: str = "value") -> DataFrame:
    """(path, error, ...): a manifest a row; one that can't be read is a row with an error and doesn't hinder the others."""
    read = F.from_json(text, MANIFEST, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    each = texts.select(path, read.alias("m")).select(path, "m.*")
    error = F.when(F.col("broken").isNotNull() | F.col("task_id").isNull(), "invalid-manifest").when(~F.coalesce(F.col("schema_version") == 1, F.lit(False)), "schema-version")
    return each.select(path, error.alias("error"), *[c for c in each.columns if c not in (path, "broken")])


def manifests(spark: SparkSession, folder: str, name: str = "manifest.json") -> DataFrame:
    """``read_manifests`` of all manifests below a folder."""
    found = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(folder)
    return read_manifests(found.select(F.col("_metadata.file_path").alias("path"), "value"))


def find_unit(materials: DataFrame, wanted: DataFrame, cutoff: float = 0.6) -> DataFrame:
    """(task_id, unit_id, unit, error, suggestion) of wanted identities; one that isn't known has the closest of its task, if close.

    Closeness is one minus the edit distance over the length.  Only what is missed meets the identities of its task.
    """
    known = materials.where("error is null").select("task_id", F.explode("unit_ids").alias("unit", "known_id"))
    hit = wanted.join(known.withColumnRenamed("known_id", "unit_id"), ["task_id", "unit_id"], "left")
    task = F.when(F.col("task_id").isin("", "undefined", "null", "None"), "identity-missing").otherwise("not_found")
    missed = hit.where("unit is null").select("task_id", "unit_id").join(known.select("task_id", "known_id"), "task_id")
    near = 1 - F.levenshtein("unit_id", "known_id") / F.greatest(F.length("unit_id"), F.length("known_id"), F.lit(1))
    best = missed.withColumn("near", near).where(F.col("near") >= cutoff).groupBy("task_id", "unit_id").agg(F.min_by("known_id", F.struct(-F.col("near"), "known_id")).alias("suggestion"))
    return hit.join(best, ["task_id", "unit_id"], "left").select("task_id", "unit_id", "unit", F.when(F.col("unit").isNull(), task).alias("error"), "suggestion")


def unit_set_difference(folders: DataFrame, materials: DataFrame, key: str = "task_id") -> DataFrame:
    """(key, unit, code): units on disk that a manifest doesn't list (``extra``) and listed ones without a folder (``missing``)."""
    listed = materials.select(key, F.explode("unit_set").alias("unit")).withColumn("listed", F.lit(True))
    both = folders.select(key, "unit").withColumn("there", F.lit(True)).join(listed, [key, "unit"], "full_outer")
    return both.where("there is null or listed is null").select(key, "unit", F.when(F.col("listed").isNull(), "extra").otherwise("missing").alias("code"))


def main_source(files: DataFrame, unit: str = "unit", name: str = "name") -> DataFrame:
    """(unit, name): the source of a unit, the file of its own name, else the first Markdown file that isn't an artefact."""
    own = F.col(name) == F.concat(unit, F.lit(".md"))
    good = files.where(F.col(name).endswith(".md") & (own | ~F.col(name).startswith("_")))
    return good.groupBy(unit).agg(F.min_by(name, F.struct(~own, name)).alias(name))


# Folders of a corpus and what reports in them are.
_TOP, _WHOLE = ("中间产物", "拆题结果"), "校对报告"


def report_place(rel: Column) -> Column:
    """STRUCT<top, doc, unit, kind> of a report's path below a corpus."""
    part = F.split(rel, "/")
    at = lambda i: F.get(part, F.lit(i))
    top = F.when((F.size(part) >= 2) & (at(0) == "output"), at(1)).otherwise("其他")
    deep, whole = top.isin(*_TOP) & (F.size(part) >= 5), top == _WHOLE
    doc = F.when(deep, at(2)).when(whole, F.regexp_replace(F.element_at(part, -1), "_校对报告\\.md$", "")).otherwise("其他")
    unit = F.when(deep, at(3)).when(whole, F.lit(None)).when(F.size(part) >= 2, F.get(part, F.size(part) - 2)).otherwise("?")
    return F.struct(top.alias("top"), doc.alias("doc"), unit.alias("unit"), F.when(~deep & whole, "整卷报告").otherwise("单元报告").alias("kind"))


def unit_number(name: Column) -> Column:
    """The first number in a unit's name; those without one come last."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"\d+", 0), F.lit("")).cast("int"), F.lit(9999))


def navigation(content: Column, patterns: tuple[str, ...]) -> Column:
    """Whether a unit's first line is one of navigation or a cover, so that it isn't proofread."""
    return X.strip(F.element_at(F.split(content, "\n", 2), 1)).rlike("|".join(patterns)) if patterns else F.lit(False)


def included(body: Column, reasons: Column) -> Column:
    """Whether a report goes into a Word file: one with markers needs its sections."""
    return ~(F.coalesce(body, F.lit("")).rlike(X.MARKER_V1) & (body.isNull() | reasons.isNull()))


# What shows that a failure note has a verification's output, and the words of its summary.
NOTE_OUTPUT, NOTE_WORDS = ('"ok"', "'ok'", "verify-report", "verify_report", "未执行"), ("标记", "严重度", "错误")


def failure_note_issues(note: Column) -> Column:
    """ARRAY<STRING> of codes: an empty note, one without a verification's output, one without a summary; none for no note."""
    has = lambda words: [note.contains(w).cast("int") for w in words]
    empty = F.length(X.strip(note)) == 0
    found = F.array_compact(F.array(F.when(F.greatest(*has(NOTE_OUTPUT)) == 0, "failure_note.no-verify-output"), F.when(sum(has(NOTE_WORDS)) < 2, "failure_note.no-summary")))
    none = F.array().cast("array<string>")
    return F.when(note.isNull(), none).when(empty, F.array(F.lit("failure_note.empty"))).otherwise(found)


def inside(root: Column, path: Column) -> Column:
    """Whether a path, its dots resolved, lies in a root; a relative one counts from there. No link is followed."""
    full = F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", root, path))
    step = lambda acc, p: F.when(p.isin("", "."), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    resolve = lambda x: F.aggregate(F.split(x, "/"), F.array().cast("array<string>"), step)
    base, own = resolve(root), resolve(full)
    return F.slice(own, 1, F.size(base)) == base


def may_use(tools: Column, family: str) -> Column:
    """Whether a subject may use a family of tools."""
    return F.coalesce(F.array_contains(tools, family), F.lit(False))


# Modes and origins of an authorisation, and how the old totals map to budgets.
MODES, ORIGINS = ("automatic", "interactive"), ("user", "confirmed")
_FROM_OLD = {"call_correction": ("call_correction",), "calc_representation": ("calculation_correction",), "report_repair": ("report_correction",), "technical_redispatch": ("unit_recovery", "technical_retry"), "image_schema_fix": ("call_correction",)}


def new_policies(runs: DataFrame, mode: str = "mode", origin: str = "origin") -> DataFrame:
    """Runs with their authorisation: budgets and an error code where mode or origin isn't allowed."""
    budgets = F.create_map(*[F.lit(x) for pair in ledger.BUDGETS.items() for x in pair])
    error = F.when(~F.coalesce(F.col(mode).isin(*MODES), F.lit(False)), "invalid-execution-mode").when(~F.coalesce(F.col(origin).isin(*ORIGINS), F.lit(False)), "invalid-execution-origin")
    return runs.withColumn("budgets", budgets).withColumn("error", error)


def current_policy(policy: Column, run_id: Column) -> Column:
    """Whether an authorisation (mode, origin, run_id, confirmed_at, budgets) is that of a run."""
    full = [F.coalesce(policy["budgets"][k] == v, F.lit(False)) for k, v in ledger.BUDGETS.items()]
    good = policy["mode"].isin(*MODES) & policy["origin"].isin(*ORIGINS) & (policy["run_id"] == run_id) & policy["confirmed_at"].isNotNull() & (F.size(policy["budgets"]) == len(ledger.BUDGETS))
    for x in full:
        good &= x
    return F.coalesce(good, F.lit(False))


def migrate_spent(spent: Column) -> Column:
    """MAP<category, used> of an old run's totals, never more than the budget; what is zero is left out."""
    used = lambda old: F.greatest(*[F.coalesce(spent[k], F.lit(0)) for k in old], F.lit(0))
    each = F.map_from_arrays(F.array(*map(F.lit, _FROM_OLD)), F.array(*[F.least(used(old), F.lit(ledger.BUDGETS[k])).cast("int") for k, old in _FROM_OLD.items()]))
    return F.map_filter(each, lambda _, v: v > 0)


def failure_fingerprint(error_code: Column, category: Column, message: Column, details: Column) -> Column:
    """SHA-256 of the canonical JSON of a failure: details (a map) by key, then the code or the category, then the message.

    Null where the message is blank or the whole is over 64 KiB.
    """
    quoted = lambda c: F.substr(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    pairs = F.transform(F.array_sort(F.map_entries(F.coalesce(details, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))), lambda e: F.concat(quoted(e["key"]), F.lit(":"), quoted(e["value"])))
    code = F.coalesce(F.nullif(error_code, F.lit("")), F.concat(F.lit("category:"), F.coalesce(category, F.lit("None"))))
    whole = F.concat(F.lit('{"details":{'), F.array_join(pairs, ","), F.lit('},"error_code":'), quoted(code), F.lit(',"message":'), quoted(message), F.lit("}"))
    return F.when((F.length(X.strip(message)) > 0) & (F.octet_length(whole) <= 65536), F.sha2(whole, 256))


def valid_fingerprint(fingerprint: Column) -> Column:
    """Whether a failure's fingerprint is a lower-case SHA-256 and no placeholder."""
    return F.coalesce(fingerprint.rlike("^[0-9a-f]{64}$") & ~fingerprint.isin("0" * 64, "1" * 64, "f" * 64), F.lit(False))


def unit_inputs(sources: DataFrame, images: DataFrame, key: str) -> DataFrame:
    """(key, inputs_sha256): one digest of a unit's source and of its images (rel, sha256) by path."""
    by_unit = images.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rel", "sha256"))).alias("images"))
    pair = F.transform(F.coalesce("images", F.array().cast("array<struct<rel:string,sha256:string>>")), lambda i: F.concat_ws(":", i["rel"], i["sha256"]))
    return sources.join(by_unit, key, "left").select(key, F.sha2(F.concat_ws("\n", F.col("source_sha256"), F.array_join(pair, "\n")), 256).alias("inputs_sha256"))


def calc_records(calls: DataFrame, units: DataFrame) -> DataFrame:
    """Calculations with the run and the digests of source and inputs that their unit had; ``call_id`` numbers a unit's calls."""
    bound = calls.join(units.select("task_id", "unit_id", "run_id", "source_sha256", "inputs_sha256"), ["task_id", "unit_id"])
    n = F.row_number().over(Window.partitionBy("task_id", "unit_id", "run_id").orderBy("at", "operation", "params"))
    return bound.withColumn("call_id", F.concat_ws("-", F.lit("calc"), F.substring("unit_id", 1, 8), n.cast("string")))


def closest(df: DataFrame, text: str, others: tuple[str, ...]) -> DataFrame:
    """``df`` with ``nearest``: which of a few words, given as literals, is the nearest by edit distance; ties go to the first."""
    word = F.array(*[F.struct(F.levenshtein(text, F.lit(o)).alias("d"), F.lit(i).alias("i"), F.lit(o).alias("o")) for i, o in enumerate(others)])
    return df.withColumn("nearest", F.array_min(word)["o"])


def artefacts(unit: Column) -> Column:
    """STRUCT of the names of a unit's files: source, report, data, failure note, mark of what is skipped."""
    names = {"source": F.concat(unit, F.lit(".md")), "report": F.lit("_校对报告.md"), "data": F.lit("_校对数据.json"), "failure": F.lit("_校对失败.md"), "skip": F.lit(".skip_proofread")}
    return F.struct(*[c.alias(n) for n, c in names.items()])


def is_unit_name(name: Column) -> Column:
    return name.rlike(r"^(?:第\d+题|单元\d+|板块\d+)$")


def rewritten(files: DataFrame, text: str, rule) -> DataFrame:
    """``files`` with a text rule applied: only rows that it changes, as they are to be written."""
    return files.withColumn("__new", rule(F.col(text))).where(~F.col("__new").eqNullSafe(F.col(text))).drop(text).withColumnRenamed("__new", text)
