"""The ledger as a stream: late, repeated and shuffled events, registration, and what state is left."""
import datetime as dt
import json
import os
import random

import pytest

from galley.streaming import ledger

SCHEMA = "task_id string, unit_id string, seq long, at timestamp, kind string, attempt_id string, category string, fingerprint string, initiator string, reason string"
START = dt.datetime(2024, 1, 1)


def rows(df):
    return sorted(map(tuple, df.collect()))


def event(unit, seq, minute, kind, attempt="a", category=None, fingerprint=None, initiator=None, reason=None):
    return {"task_id": "t", "unit_id": unit, "seq": seq, "at": (START + dt.timedelta(minutes=minute)).isoformat(), "kind": kind, "attempt_id": attempt, "category": category, "fingerprint": fingerprint, "initiator": initiator, "reason": reason}


def ledger_of(units, rng, n=40):
    out = []
    for u in range(units):
        for k in range(n):
            kind = rng.choice(["event", "event", "recovery", "recovery", "cancel", "revoke"])
            attempt = f"a{rng.randrange(4)}"
            out.append(event(f"u{u}", k, k + u / 100, kind, attempt, rng.choice(["report_repair", "image_schema_fix", "call_correction", "other"]), f"f{rng.randrange(2)}", *rng.choice([("user", "user_cancel"), ("host", "superseded"), ("host", "technical_timeout"), ("parent", "x")])))
    return out


def run(spark, tmp_path, files, make, name, mode="append", drain=()):
    """The rows of a stream over files read one a batch, and what each batch said of its state."""
    folder = tmp_path / name
    folder.mkdir()
    for k, events in enumerate([*files, *drain]):
        (folder / f"{k:04d}.json").write_text("\n".join(map(json.dumps, events)))
        os.utime(folder / f"{k:04d}.json", (1_700_000_000 + k, 1_700_000_000 + k))  # a stream of files reads them by their times
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))
    query = make(source).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}-cp").trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    return spark.table(name), [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]


@pytest.fixture(scope="module")
def session(spark):
    keep = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", keep)


def test_stream_is_batch_when_events_come_late_and_twice(session, tmp_path):
    rng = random.Random(5)
    events = ledger_of(4, rng)
    order = sorted(events, key=lambda e: (e["at"], e["unit_id"]))
    for k in range(0, len(order), 12):  # within a dozen, so within the watermark
        part = order[k : k + 12]
        rng.shuffle(part)
        order[k : k + 12] = part
    files = [order[k : k + 20] + rng.sample(order[max(0, k - 4) : k + 20], 6) for k in range(0, len(order), 20)]
    end = [[event("end", 0, 500, "event")], [event("end", 1, 1000, "event")]]
    found, _ = run(session, tmp_path, files, lambda s: ledger.fold_stream(s, "30 minutes"), "late", drain=end)
    table = session.createDataFrame([tuple(e.values()) for e in events + events[:30]], SCHEMA.replace("at timestamp", "at string"))
    want = [r for r in rows(ledger.fold_stream(table)) if r[1] != "end"]
    assert [r for r in rows(found) if r[1] != "end"] == want and len(want) == len(events)
    assert {r[3] for r in want} >= {"recorded", "allowed", "exhausted", "replay", "conflict", "cancelled", "forbidden"}


def test_state_goes_with_registration(session, tmp_path):
    work = [[event(f"u{u}", k, 10 * k, "recovery", f"a{k}", "report_repair", "f") for u in range(20)] for k in range(3)]
    done = [[event(f"u{u}", 9, 40, "registered") for u in range(19)], [event("z", 1, 300, "event")], [event("z", 2, 600, "event")]]
    after = [[event("u0", 10, 700, "recovery", "a9", "report_repair", "f"), event("u19", 10, 700, "recovery", "a9", "report_repair", "f")], [event("z", 3, 1000, "event")], [event("z", 4, 1400, "event")]]
    found, states = run(session, tmp_path, work + done + after, lambda s: ledger.fold_stream(s, "5 minutes"), "ends")
    sizes = [s["numRowsTotal"] for s in states]
    assert max(sizes) >= 80 and sizes[-1] <= 12, sizes
    last = {r.unit_id: r.outcome for r in found.where("seq = 10").collect()}
    assert last == {"u0": "allowed", "u19": "exhausted"}  # u0 was registered and begins anew
    table = session.createDataFrame([tuple(e.values()) for part in work + done + after for e in part], SCHEMA.replace("at timestamp", "at string"))
    assert set(rows(found)) <= set(rows(ledger.fold_stream(table)))


def test_too_late_is_dropped_and_counted(session, tmp_path):
    files = [[event("u", 1, 0, "event")], [event("u", 2, 200, "event")], [event("u", 3, 300, "event")], [event("u", 4, 5, "event"), event("u", 5, 301, "event")], [event("u", 6, 900, "event")], [event("u", 7, 2000, "event")]]
    found, states = run(session, tmp_path, files, lambda s: ledger.fold_stream(s, "10 minutes"), "dropped")
    assert {r.seq for r in found.collect()} >= {1, 2, 3, 5} and 4 not in {r.seq for r in found.collect()}
    assert sum(s["numRowsDroppedByWatermark"] for s in states) == 1


def test_last_phase_and_forgetting(session, tmp_path):
    source = [[event("a", 1, 0, "x"), event("b", 1, 1, "x")], [event("a", 3, 20, "z"), event("a", 2, 10, "y")], [event("a", 4, 15, "w")], [event("c", 1, 60 * 30, "x")], [event("c", 2, 60 * 60, "x")], [event("c", 3, 60 * 61, "x")]]
    found, states = run(session, tmp_path, source, lambda s: ledger.latest_stream(s.withColumnRenamed("kind", "phase"), "2 hours", 3), "phases", mode="update")
    assert [r.phase for r in found.where("unit_id = 'a'").orderBy("at").collect()] == ["x", "z"]  # what came later was earlier
    assert max(s["numRowsTotal"] for s in states) >= 2 and states[-1]["numRowsTotal"] <= 2


def test_table_is_folded_unit_by_unit_across_batches(session):
    from galley.operators.ledger import Cancellation, Recovery, fold

    rng = random.Random(7)
    events = ledger_of(5, rng, 30)
    again = [{**e, "at": (START + dt.timedelta(days=1)).isoformat(), "kind": "revoke"} for e in rng.sample(events, 20)]  # of one number the first counts
    mixed = events + again
    rng.shuffle(mixed)
    given = session.createDataFrame([{**e, "at": dt.datetime.fromisoformat(e["at"])} for e in mixed], SCHEMA)
    keep = session.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = ledger.fold_stream(given)
        assert "FlatMapGroups" not in found._jdf.queryExecution().optimizedPlan().toString()  # a call of Python for each unit
        have = rows(found)
    finally:
        session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", keep)
    want = []
    for u in {e["unit_id"] for e in events}:
        own = sorted((e for e in events if e["unit_id"] == u), key=lambda e: (e["at"], e["seq"]))
        want += [("t", u, seq, outcome) for seq, outcome in fold(own, Recovery(), Cancellation())]
    assert have == sorted(want)
