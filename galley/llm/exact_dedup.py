"""Exact dedup by a tree-merge of sorted digest runs.

Every input partition sorts what it has of (digest, length, check sum) into runs, in which copies are one entry with
the smallest and largest identifier and a count.  Runs are exchanged in binomial rounds: in round r the runs whose
numbers agree after division by ``2 ** r`` meet and are merged, without sorting again, into one sorted run.  The digest
space is cut into ranges; a run's part of a range travels as one row of packed entries, small enough for any task, and a
group of copies of any size crosses a round as one entry a run.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shipping import ship
from .common import by_group, materialize, shuffle_partitions, sub_batches, tidied

#: Entries that a range of the digest space has about, and that a worker holds before it emits a run.
RANGE_ENTRIES, RUN_ENTRIES = 50_000, 400_000
_RUN = "bucket int, run int, entries binary"
#: key: digest, length and check sum, big-endian, so that keys are ordered as bytes.
ENTRY = np.dtype([("key", "S48"), ("low", "<i8"), ("high", "<i8"), ("n", "<i8")])
_GROUP = "digest binary, n_bytes long, check_sum long, min_id long, max_id long, n long"


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, digest, n_bytes, check_sum, *carry) of every text, lower-cased A-Z; null counts as empty."""
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *carry)
    schema = StructType.fromDDL("doc_id long, digest binary, n_bytes long, check_sum long")
    for field in source.schema.fields[2:]:
        schema.add(field)

    def run(batches):
        for batch in batches:
            for part in sub_batches(batch, "text", 16 << 20):
                low = pc.binary_join_element_wise(pc.fill_null(pc.ascii_lower(part.column(1)), ""), "", "").cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([hashlib.sha256(t).digest() for t in low], pa.binary()), pa.array([len(t) for t in low], pa.int64()), pa.array(np.array([xxhash.xxh64_intdigest(t) for t in low], np.uint64).view(np.int64)), *part.columns[2:]],
                    names=["doc_id", "digest", "n_bytes", "check_sum", *carry],
                )

    ship(df.sparkSession)
    return source.mapInArrow(tidied(run), schema)


_NONE_LOW, _NONE_HIGH = np.iinfo(np.int64).max, np.iinfo(np.int64).min  # an identifier that is missing


def collapse(run: np.ndarray) -> np.ndarray:
    """A sorted run with adjacent entries of equal keys as one."""
    at = np.flatnonzero(np.append(True, run["key"][1:] != run["key"][:-1])) if len(run) else np.empty(0, np.int64)
    out = run[at]
    if len(at) < len(run):
        out["low"], out["high"], out["n"] = np.minimum.reduceat(run["low"], at), np.maximum.reduceat(run["high"], at), np.add.reduceat(run["n"], at)
    return out


def merge(runs: list[np.ndarray]) -> np.ndarray:
    """One sorted run of many: two at a time, the smallest first, each entry put where it belongs by binary search."""
    left = sorted(runs, key=len, reverse=True)
    while len(left) > 1:
        b, a = left.pop(), left.pop()
        out = np.empty(len(a) + len(b), ENTRY)
        at = np.searchsorted(a["key"], b["key"]) + np.arange(len(b))
        rest = np.ones(len(out), bool)
        rest[at] = False
        out[at], out[rest] = b, a
        out = collapse(out)
        left.append(out)
        left.sort(key=len, reverse=True)
    return left[0]


def _entries(batch: pa.RecordBatch) -> np.ndarray:
    """An entry for each row of (doc_id, digest, n_bytes, check_sum)."""
    out = np.empty(batch.num_rows, ENTRY)
    key = np.empty((batch.num_rows, 6), ">u8")
    key[:, :4] = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u8").reshape(-1, 4)
    for i in (2, 3):
        key[:, i + 2] = batch.column(i).to_numpy().view(np.uint64)
    out["key"] = key.reshape(-1).view("S48")
    out["low"], out["high"] = (pc.fill_null(batch.column(0), missing).to_numpy(zero_copy_only=False) for missing in (_NONE_LOW, _NONE_HIGH))
    out["n"] = 1
    return out


def _prefix(run: np.ndarray) -> np.ndarray:
    """The leading 24 bits of the digests."""
    return np.ascontiguousarray(run["key"]).view(np.uint8).reshape(-1, 48)[:, :3].astype(np.int64) @ np.array([1 << 16, 1 << 8, 1])


def local_runs(hashed: DataFrame, ranges: int) -> DataFrame:
    """Each partition's entries as sorted runs with copies collapsed, a row for each range of the digest space."""

    def run(batches):
        number, held, many = TaskContext.get().partitionId(), [], 0

        def emit() -> pa.RecordBatch:
            whole = np.concatenate(held)
            own = collapse(whole[np.argsort(whole["key"], kind="stable")])
            bucket = _prefix(own) * ranges >> 24
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
            parts = [own[i:j].tobytes() for i, j in zip(cuts, [*cuts[1:], len(own)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[cuts], pa.int32()), pa.array([number] * len(cuts), pa.int32()), pa.array(parts, pa.binary())], names=["bucket", "run", "entries"])

        for batch in batches:
            if batch.num_rows:
                held.append(_entries(batch))
                many += batch.num_rows
            if many >= RUN_ENTRIES:  # the rest becomes another run of the same number
                yield emit()
                held, many = [], 0
        if many:
            yield emit()

    return hashed.mapInArrow(tidied(run), _RUN)


def _rows(entries: np.ndarray) -> list[pa.Array]:
    """Columns of ``_GROUP`` of a run."""
    key = np.ascontiguousarray(entries["key"]).view(">u8").reshape(-1, 6)
    digest = pa.Array.from_buffers(pa.binary(), len(entries), [None, pa.py_buffer(np.arange(0, 32 * len(entries) + 1, 32, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(key[:, :4]))])
    size, check = (np.ascontiguousarray(key[:, i], np.uint64).view(np.int64) for i in (4, 5))
    low, high, n = (np.ascontiguousarray(entries[c]) for c in ("low", "high", "n"))
    return [digest, pa.array(size), pa.array(check), pa.array(low, mask=low == _NONE_LOW), pa.array(high, mask=high == _NONE_HIGH), pa.array(n)]


def merge_runs(runs: DataFrame, fan_in: int, last: bool = False) -> DataFrame:
    """A round: the runs whose numbers agree after division by ``fan_in`` become one sorted run; the last one gives rows (``_GROUP``)."""
    names = [x.split(" ")[0] for x in _GROUP.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        one = merge([np.frombuffer(x, ENTRY) for x in table.column("entries").to_pylist()])
        if last:  # in this task, so that no second worker is needed for it
            return pa.table(_rows(one), names=names)
        return pa.table({"bucket": table.column("bucket")[:1], "run": table.column("run")[:1], "entries": pa.array([one.tobytes()], pa.binary())})

    return runs.withColumn("run", F.expr(f"cast(run div {fan_in} as int)")).groupBy("bucket", "run").applyInArrow(run, _GROUP if last else _RUN)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", fan_in: int = 2, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: (doc_id, keep_id, group_size, kept, text_sha256, *carry).

    Texts are equal when identical after lower-casing A-Z, verified at every merge by SHA-256, byte length and a second
    check sum.  ``keep`` says whether the row with the smallest or the largest identifier stays.  Null and empty texts
    are equal to each other.  Where the identifier that stays is repeated within its group, all its rows are marked
    kept; a row with a null identifier is kept only where its group has no other, and then keep_id is null.  An empty
    table gives no row; the columns ``carry`` follow as they are, others are ignored.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep: smallest or largest")
    hashed = materialize(digests(df, id_col, text_col, carry), "digests")
    ranges = min(1 << 24, max(shuffle_partitions(df.sparkSession), hashed.count() // RANGE_ENTRIES))
    runs, left = local_runs(hashed.select("doc_id", "digest", "n_bytes", "check_sum"), ranges), hashed.rdd.getNumPartitions()
    while left > fan_in:
        runs, left = merge_runs(runs, fan_in), -(-left // fan_in)
    key = ["digest", "n_bytes", "check_sum"]
    found = materialize(merge_runs(runs, fan_in, last=True), "groups").select(*key, F.col("min_id" if keep == "smallest" else "max_id").alias("keep_id"), F.col("n").alias("group_size"), F.col("n").alias("__n"))
    return by_group(hashed, found, key).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), *carry)
