"""Two-pass external shuffle into shards, with native DataFrame functions only.

The first pass scatters rows uniformly into memory-sized buckets by a seeded hash, permutes each bucket by
Fisher-Yates and writes it.  The second pass numbers the rows through all buckets and cuts the numbers into shards
whose row counts differ by one at most.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, materialize, numbered, shuffle_partitions

BUCKET_BYTES = 16 << 20
#: What a row takes in memory beside its text.
ROW_BYTES = 256
#: Offsets of so many buckets take 32 MB at most, and are broadcast; more are joined.
BROADCAST_BUCKETS = 1_000_000


def _running(counts: DataFrame, group: int = 1024) -> DataFrame:
    """(bucket, base): rows in the buckets before; groups of buckets are summed first, so no window holds all buckets."""
    block = F.expr(f"bucket div {group}")
    by_block = counts.groupBy(block.alias("block")).agg(F.sum("n").alias("n")).withColumn("over", F.expr(f"block div {group}"))
    before = lambda part, order: Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    tops = by_block.groupBy("over").agg(F.sum("n").alias("n"))  # one row for each million buckets
    tops = tops.select("over", F.coalesce(F.sum("n").over(before(F.lit(0), "over")), F.lit(0)).alias("base2"))
    blocks = by_block.join(F.broadcast(tops), "over").select("block", (F.coalesce(F.sum("n").over(before("over", "block")), F.lit(0)) + F.col("base2")).alias("base1"))
    own = counts.withColumn("block", block).join(blocks, "block")
    return own.select("bucket", (F.coalesce(F.sum("n").over(before("block", "bucket")), F.lit(0)) + F.col("base1")).alias("base"))


def shuffle_shards(df: DataFrame, shards: int = 16, seed: int = 11, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``df`` plus size, law (``rows``), shard, slot and grown_shard (null: only another law has it).

    ``size`` is the text's UTF-8 bytes plus 1 (null: 1).  ``slot`` counts from 0 without gaps within a shard.  Columns
    of ``df`` with these names, or ``bucket``, are replaced.  Rows are dealt by identifier, text and number in their
    file, so that a bucket can't fill with copies of one row.  For given files and partition numbers the result repeats.
    Null identifiers and empty texts are rows like any other; an empty table gives no row.
    """
    made = ("size", "law", "shard", "slot", "grown_shard", "bucket")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in made]
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1
    total = df.agg(F.coalesce(F.sum(size + ROW_BYTES), F.lit(0)), F.count("*")).first()
    rows, buckets = int(total[1]), max(1, -(-int(total[0]) // bucket_bytes))
    drawn = lambda n: F.xxhash64(F.lit(seed + n), F.col(id_col), F.col(text_col), F.col(ROW[2]))
    dealt = numbered(df).select(*kept, size.alias("size"), F.pmod(drawn(0), F.lit(buckets)).alias("bucket"), drawn(1).alias("__order"))
    scattered = dealt.repartition(max(buckets, shuffle_partitions(df.sparkSession)), "bucket").sortWithinPartitions("bucket", "__order")
    held = F.struct(*kept, "size")
    permuted = scattered.groupBy("bucket").agg(F.shuffle(F.collect_list(held), F.lit(seed)).alias("rows"))  # Fisher-Yates
    written = materialize(permuted.select("bucket", F.posexplode("rows").alias("at", "row")).select("bucket", F.col("at").cast("long").alias("at"), "row.*"), "buckets")
    bases = _running(written.groupBy("bucket").agg(F.count("*").alias("n")))
    if buckets <= BROADCAST_BUCKETS:
        bases = F.broadcast(bases)
    base, extra = divmod(rows, shards)
    place: Column = F.col("base") + F.col("at")
    first = extra * (base + 1)
    shard = F.when(place < first, F.floor(place / (base + 1))).otherwise(F.lit(extra) + F.floor((place - first) / max(base, 1))).cast("int")
    start = F.col("shard").cast("long") * base + F.least(F.col("shard"), F.lit(extra))
    out = written.join(bases, "bucket").withColumn("place", place).withColumn("shard", shard)
    return out.select(*kept, "size", F.lit("rows").alias("law"), "shard", (F.col("place") - start).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
