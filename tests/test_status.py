"""States of units by their files."""
from galley import api
from galley.operators import status

FILES = "task_id string, unit string, name string, text string"


def test_states_of_odd_folders(spark, tmp_path):
    rows = [
        ("t", "a", "a.md", "src"), ("t", "a", "z.md", "other"), ("t", "b", "z.md", "second"), ("t", "b", "y.md", "first"), ("t", "b", "_x.md", "artefact"), ("t", "c", "_note.md", "n"),
        ("t", "d", status.NOTE, ""), ("t", "d", "d.md", "s"), ("t", "e", status.REPORT, None), ("t", "e", "e.md", "s"), ("t", "f", status.SKIP, None), ("t", "g", status.DATA, "no json"), ("t", "g", "g.md", ""), (None, "h", "h.md", "s"),
        ("t", "i", status.REPORT, "无问题\n### 标记原文\ntext\n### 修改原因\n"), ("t", "i", "i.md", "text"),
    ]
    df = spark.createDataFrame(rows, FILES)
    held = {r.unit: r for r in status.folders(df).collect()}
    assert held["a"].source == "src" and (held["b"].source, held["b"].source_name) == ("first", "y.md") and held["c"].source is None and held["f"].skip and not held["g"].legacy
    none = spark.createDataFrame([], "task_id string, unit string, report_sha256 string")
    found = {r.unit: r for r in status.derived(df, none, none).collect()}
    assert {u: r.status for u, r in found.items()} == {"a": "not_started", "b": "not_started", "c": "not_started", "d": "failed", "e": "unverified", "f": "skip", "g": "not_started", "h": "not_started", "i": "pending"}
    assert found["c"].reason == "no source" and found["d"].reason == "failed before there was a report" and found["d"].note_problems == ["failure_note.empty"] and "report.empty" in found["e"].reason
    assert found["i"].reason == "not registered, or changed since" and found["i"].n_errors == 0
    import hashlib

    digest = hashlib.sha256(rows[-2][3].encode()).hexdigest()
    done = spark.createDataFrame([("t", "i", digest), ("t", "i", digest)], none.schema)
    assert {r.unit: r.status for r in status.derived(df, done, none).collect()}["i"] == "completed"  # of version 1, so that no review is needed
    df.write.parquet(str(tmp_path / "files"))
    assert api.run(spark, "status", files=str(tmp_path / "files")).count() == 9
    assert status.derived(df.limit(0), none, none).count() == 0


def test_sources_without_a_report_are_not_verified(spark):
    files = spark.createDataFrame([("t", "u", "u.md", "a\n\nb")], "task_id string, unit string, name string, text string")
    none = files.selectExpr("task_id", "unit", "'' as report_sha256").where("false")
    made = status.derived(files, none, none)
    assert "__against" in made._jdf.queryExecution().analyzed().toString()
    assert [(r.status, r.n_errors) for r in made.collect()] == [("not_started", 0)]
