"""Helpers shared by the training-data operators: shared-folder tables and Arrow mapping."""
from __future__ import annotations

import atexit
import contextlib
import contextvars
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shipping import ship

#: Tables this process wrote below the shared folder: session, owner, path.
_WRITTEN: list[tuple[SparkSession, str, str]] = []
_OWNER: contextvars.ContextVar[str] = contextvars.ContextVar("owner", default="")
_OWN = f"/tmp/checkpoints/galley-{os.getpid()}"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a default of this machine only where it is unset and all run on it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _OWN
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, removed with its owner's others or at the end of the process."""
    path = f"{shared_dir(spark)}/galley-{label}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, _OWNER.get(), path))
    return path


@contextlib.contextmanager
def owned(spark: SparkSession, owner: str):
    """Tables written within belong to ``owner``; what it wrote before is removed first, since nothing reads it any more."""
    release(owner)
    token = _OWNER.set(owner)
    try:
        yield
    finally:
        _OWNER.reset(token)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Columns that tell the rows of a table apart: a hash of the content, the file, the number in the file.
ROW = ("__content", "__file", "__row")


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with the columns ``ROW``, the same whenever it is read; what isn't a plain scan of Parquet is written first."""
    own = [F.col(f"`{c}`") for c in df.columns]
    key = F.xxhash64(*own), F.xxhash64("_metadata.file_path"), F.col("_metadata.row_index")
    node = df._jdf.queryExecution().analyzed()
    while node.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    if node.getClass().getSimpleName() == "LogicalRelation":
        try:
            return df.select(*own, *[k.alias(n) for k, n in zip(key, ROW, strict=True)])
        except AnalysisException:  # a format without row numbers
            pass
    return materialize(df, "numbered").select(*own, *[k.alias(n) for k, n in zip(key, ROW, strict=True)])


def release(owner: str | None = None) -> None:
    """Remove the tables of an owner, or all; call it only when no pending result reads them."""
    keep = []
    for spark, whose, path in _WRITTEN:
        if owner is not None and whose != owner:
            keep.append((spark, whose, path))
            continue
        try:
            jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            stopped = spark._jsc.sc().isStopped()
            conf = spark._jvm.org.apache.hadoop.conf.Configuration() if stopped else spark._jsc.hadoopConfiguration()
            jvm_path.getFileSystem(conf).delete(jvm_path, True)
        except Exception:  # the JVM or the store may be gone; at the end nothing more can be done
            keep.append((spark, whose, path))
    _WRITTEN[:] = keep


atexit.register(release)


def texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Python strings of a column; null counts as empty."""
    return [x if x is not None else "" for x in column.to_pylist()]


def tidy() -> None:
    """Give memory that a worker no longer uses back to the machine: workers live on between stages."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that tidies up at the end of a partition."""

    def whole(batches):
        yield from run(batches)
        tidy()

    return whole


def map_arrow(df: DataFrame, schema: StructType | str, fn: Callable[[pa.RecordBatch], dict | None]) -> DataFrame:
    """``mapInArrow`` with a function from one record batch to the columns of one; empty results are left out."""
    want = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    names = want.fieldNames()
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(want)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (cols := fn(batch)) is not None:
                yield pa.RecordBatch.from_arrays([as_array(cols[n], arrow.field(n).type) for n in names], schema=arrow)

    ship(df.sparkSession)
    return df.mapInArrow(run, want)


def as_array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def sub_batches(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts take about ``most`` bytes; one longer text makes a slice of its own."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tree_sum(rows: DataFrame, part: Callable[[pa.RecordBatch], list], fan_in: int = 16, exact: bool = False) -> list:
    """The sum over all batches of the arrays of numbers that part(batch) gives; none without rows.

    Arrays, whose sizes must not depend on the rows, are added within a task, then of ``fan_in`` tasks at a time, round
    by round, until a few are left for the driver.  Numbers are doubles; with ``exact`` they are Python's integers of any size.
    """
    import numpy as np
    import zstandard
    from pyspark import TaskContext

    def dump(total: list) -> list[bytes]:
        plain = [" ".join(map(str, a)).encode() if exact else np.ascontiguousarray(a, np.float64).tobytes() for a in total]
        return [zstandard.ZstdCompressor(level=1).compress(a) for a in plain]

    def load(held: list[bytes]) -> list:
        plain = [zstandard.ZstdDecompressor().decompress(x) for x in held]
        return [np.array([int(i) for i in a.split()], object) if exact else np.frombuffer(a) for a in plain]

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                own = part(batch)
                total = own if total is None else [a + b for a, b in zip(total, own, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([dump(total)], pa.list_(pa.binary()))], names=["g", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = None
        for held in table.column("sums"):
            own = load(held.as_py())
            total = own if total is None else [a + b for a, b in zip(total, own, strict=True)]
        return pa.table({"g": table.column("g")[:1], "sums": pa.array([dump(total)], pa.list_(pa.binary()))})

    schema = "g int, sums array<binary>"
    left, sums = rows.rdd.getNumPartitions(), ship(rows.sparkSession) and rows.mapInArrow(run, schema)
    while left > 4:
        sums, left = sums.withColumn("g", F.expr(f"cast(g div {fan_in} as int)")).groupBy("g").applyInArrow(add, schema), -(-left // fan_in)
    parts = [load(r["sums"]) for r in sums.collect()]  # four rows at most
    return [sum(x) for x in zip(*parts, strict=True)]


#: Rows of groups that ``by_group`` broadcasts whole.
FEW_GROUPS = 5_000


def by_group(rows: DataFrame, groups: DataFrame, on: list[str], size: str = "__n", most: int = 1000, few: int | None = None) -> DataFrame:
    """The inner join of rows with one row for each of their groups, without a hot group in one task.

    ``size`` says how many rows a group has and isn't returned.  Up to ``few`` (``FEW_GROUPS``) groups are broadcast.  Of more,
    those with over a ``most``-th of all rows are fewer than ``most``, so these are broadcast; the others are joined by
    a shuffle, in which no key has more rows than that.  ``groups`` should be a written table of narrow rows, since it
    is read again and again; keys must not be null.
    """
    count, total = groups.agg(F.count("*"), F.sum(size)).first()
    if count <= (FEW_GROUPS if few is None else few):
        return rows.join(F.broadcast(groups.drop(size)), on)
    edge = max(10_000, total // most)
    hot, cold = (groups.where(x).drop(size) for x in (F.col(size) > edge, F.col(size) <= edge))
    if hot.isEmpty():
        return rows.join(cold, on)
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on))


def empty_if_null(name: str):
    return F.coalesce(F.col(name), F.lit(""))


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's size: the files' bytes for a scan. Only for choosing numbers of buckets."""
    return min(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), 1 << 50)
