"""Units under version: two writers, a writer that dies, undoing, folding."""
import threading

import pytest
from pyspark.sql import functions as F

from galley.operators import proposals
from galley.sources import commits


def report(source, old, new):
    body = source.replace(old, f"【1|{old}|{new}】")
    n = len(body)
    return f"{proposals.HEAD}\n总结：轻微问题\n\n### 标记原文\n{proposals.LENGTH}{n}:{n} -->\n{body}\n{proposals.END}\n### 修改原因\n1. why\n"


@pytest.fixture
def root(spark, tmp_path):
    units = spark.createDataFrame([("t", i, "r1", f"alpha beta {i}", f"in{i}") for i in range(6)], "task_id string, unit_id long, run_id string, source string, inputs_sha256 string")
    path = f"file://{tmp_path}/store"
    assert commits.begin(units, path) == 0
    return path


def snapshots(spark, root):
    return {r.unit_id: r.snapshot_sha256 for r in proposals.snapshots(commits.state(spark, root)).collect()}


def submissions(spark, seen, wanted):
    rows = [("t", i, seq, seen.get(i, "none"), text) for seq, (i, text) in enumerate(wanted)]
    return spark.createDataFrame(rows, "task_id string, unit_id long, seq int, expected_snapshot_sha256 string, text string")


def outcomes(found):
    return sorted((r.unit_id, r.seq, r.outcome) for r in found.collect())


def test_a_submission_is_judged_verified_and_kept(spark, root):
    seen = snapshots(spark, root)
    good = report("alpha beta 1", "beta", "BETA")
    made = submissions(spark, seen, [(1, good), (2, report("alpha beta 9", "beta", "B")), (3, "no report"), (4, report("alpha beta 4", "beta", "B")), (4, report("alpha beta 4", "alpha", "A")), (77, good)])
    assert outcomes(commits.judged(commits.state(spark, root), made)) == [(1, 0, "accepted"), (2, 1, "verify_failed"), (3, 2, "verify_failed"), (4, 3, "accepted"), (4, 4, "snapshot-stale")]
    assert commits.versions(spark, root) == [0]  # a preview changes nothing
    version, found = commits.submit(made, root)
    assert version == 1 and outcomes(found) == [(1, 0, "accepted"), (2, 1, "verify_failed"), (3, 2, "verify_failed"), (4, 3, "accepted"), (4, 4, "snapshot-stale")]
    now = {r.unit_id: r for r in commits.state(spark, root).collect()}
    assert len(now) == 6 and (now[1].revision, now[1].report) == (1, good) and now[2].report is None and now[4].revision == 1
    again, stale = commits.submit(submissions(spark, seen, [(1, good)]), root)  # on the old snapshot
    assert again == 1 and outcomes(stale) == [(1, 0, "snapshot-stale")]
    assert {r.unit_id: r.report for r in commits.state(spark, root, 0).collect()} == dict.fromkeys(range(6))


def test_of_two_writers_of_a_unit_one_wins_and_others_both(spark, root):
    seen = snapshots(spark, root)
    meet = threading.Barrier(2, timeout=120)
    waited, results = set(), {}

    def writer(name, wanted):
        def both_have_staged():
            if name not in waited:
                waited.add(name)
                meet.wait()

        results[name] = commits.submit(submissions(spark, seen, wanted), root, before_name=both_have_staged)

    jobs = [threading.Thread(target=writer, args=(n, w)) for n, w in (("a", [(1, report("alpha beta 1", "beta", "A")), (2, report("alpha beta 2", "beta", "A"))]), ("b", [(1, report("alpha beta 1", "beta", "B")), (3, report("alpha beta 3", "beta", "B"))]))]
    for j in jobs:
        j.start()
    for j in jobs:
        j.join()
    assert commits.versions(spark, root) == [0, 1, 2] and sorted(v for v, _ in results.values()) == [1, 2]
    first, second = sorted(results.values(), key=lambda x: x[0])
    assert [o for *_, o in outcomes(first[1])] == ["accepted", "accepted"] and [o for *_, o in outcomes(second[1])] == ["snapshot-stale", "accepted"]
    now = {r.unit_id: r.revision for r in commits.state(spark, root).collect()}
    assert now == {0: None, 1: 1, 2: 1, 3: 1, 4: None, 5: None}


def test_a_writer_that_dies_leaves_the_old_state(spark, root):
    seen, before = snapshots(spark, root), sorted(map(tuple, commits.state(spark, root).collect()))

    class Killed(BaseException):
        pass

    def kill():
        raise Killed

    with pytest.raises(Killed):
        commits.submit(submissions(spark, seen, [(1, report("alpha beta 1", "beta", "A"))]), root, before_name=kill)
    assert commits.versions(spark, root) == [0] and sorted(map(tuple, commits.state(spark, root).collect())) == before
    assert commits.submit(submissions(spark, seen, [(1, report("alpha beta 1", "beta", "B"))]), root)[0] == 1
    assert commits.vacuum(spark, root) == []  # young data may belong to a writer at work
    assert len(commits.vacuum(spark, root, older_than=-1)) == 3 and snapshots(spark, root)[1] != seen[1]


def test_registration_and_undoing(spark, root):
    good = report("alpha beta 1", "beta", "A")
    commits.submit(submissions(spark, snapshots(spark, root), [(1, good), (2, report("alpha beta 2", "beta", "A"))]), root)
    digest = {r.unit_id: r.report_sha256 for r in commits.state(spark, root).collect()}
    rows = [("t", 1, "r1", digest[1]), ("t", 2, "r1", "other"), ("t", 3, "r1", None), ("t", 9, "r1", None)]
    version, found = commits.register(spark.createDataFrame(rows, "task_id string, unit_id long, run_id string, report_sha256 string"), root)
    assert version == 2 and sorted(map(tuple, found.collect())) == [("t", 1, "registered"), ("t", 2, "report-changed"), ("t", 3, "report-missing")]
    assert [r.unit_id for r in commits.registered(commits.state(spark, root)).where("registered").collect()] == [1]
    commits.submit(submissions(spark, snapshots(spark, root), [(1, report("alpha beta 1", "alpha", "C"))]), root)
    assert commits.registered(commits.state(spark, root)).where("registered").isEmpty()  # of another report
    assert commits.undo(spark, root, 2) == 4
    now = {r.unit_id: (r.report, r.registered) for r in commits.registered(commits.state(spark, root)).collect()}
    assert now[1] == (good, True) and [h["kind"] for h in commits.history(spark, root)] == ["begin", "submit", "register", "submit", "undo:2"]


def test_many_commits_are_folded(spark, root, monkeypatch):
    monkeypatch.setattr(commits, "FOLDED", 2)
    for k in range(3):
        commits.submit(submissions(spark, snapshots(spark, root), [(k, report(f"alpha beta {k}", "beta", "A"))]), root)
    said = commits.history(spark, root)
    assert [h["kind"] for h in said] == ["begin", "submit", "submit", "fold", "submit"] and said[3]["full"] and said[3]["rows"] == 6
    assert sorted(r.unit_id for r in commits.state(spark, root).where("report is not null").collect()) == [0, 1, 2]


def test_what_can_not_be(spark, root, tmp_path):
    with pytest.raises(commits.Conflict):
        commits.begin(commits.state(spark, root).select("task_id", "unit_id", "run_id", "source", "inputs_sha256"), root)
    with pytest.raises(commits.Conflict):
        commits.state(spark, root, 7)
    with pytest.raises(commits.Conflict):
        commits.state(spark, f"file://{tmp_path}/nothing")
    double = commits.state(spark, root).where("unit_id = 1").unionByName(commits.state(spark, root).where("unit_id = 1"))
    with pytest.raises(ValueError, match="changed twice"):
        commits.commit_rows(spark, root, "x", lambda now, _: double)
    with pytest.raises(ValueError, match="aren't what"):
        commits.commit_rows(spark, root, "x", lambda now, _: now.withColumn("report", F.lit("r")).withColumn("report_sha256", F.lit("d")))
    assert commits.versions(spark, root) == [0]


def test_submissions_are_verified_once_by_all_tasks(spark, root):
    made = submissions(spark, snapshots(spark, root), [(1, report("alpha beta 1", "beta", "B")), (1, report("alpha beta 1", "alpha", "A"))])
    found = commits.judged(commits.state(spark, root), made)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "RepartitionByExpression" in plan
    assert outcomes(found) == [(1, 0, "accepted"), (1, 1, "snapshot-stale")]
    stale = made.withColumn("expected_snapshot_sha256", F.when(F.col("seq") == 0, "old").otherwise(F.col("expected_snapshot_sha256")))
    assert outcomes(commits.judged(commits.state(spark, root), stale)) == [(1, 0, "snapshot-stale"), (1, 1, "accepted")]
