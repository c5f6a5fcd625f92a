"""Packing of tokenised documents into fixed-length sequences by large-item matching and best fit.

A sequence holds ``capacity`` tokens, so what matters of a corpus is how many pieces it has of each length: at most
``capacity`` counts, whatever its size.  The plan is made from these counts on the driver, in steps that place all
pieces of a length at once, and yields for each length ranges of ordinals that go to a range of sequences at an offset.
Pieces are numbered within their length without gathering them, and look their place up in the plan.
"""
from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from . import pretokens
from .common import new_path, sub_batches, texts, tidied
from .vocabulary import Vocabulary

_PIECES = "doc_id long, piece int, start long, length long, ids binary, part int, k_local long"


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """([(length, first ordinal, how many, first sequence, offset)], number of sequences) for pieces of these lengths.

    Pieces of over a third of the capacity meet at most in pairs: the longest takes the longest partner that fits.
    Shorter ones, longest first, go to the smallest gap that holds them; where none does, to new sequences.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("a piece's length must be from 1 to the capacity")
    gaps: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    order: list[int] = []

    def put(gap: int, many: int, held: tuple[int, ...]) -> None:
        if many:
            if not gaps.get(gap):
                gaps.setdefault(gap, [])
                bisect.insort(order, gap)
            gaps[gap].append((many, held))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        at = bisect.bisect_right(large, capacity - n) - 1
        partner = large[at] if at >= 0 else 0
        if partner == n and left[n] == 1:
            partner = large[at - 1] if at > 0 else 0
        if not partner:
            put(capacity - n, left.pop(n), (n,))
            large.pop()
            continue
        many = left[n] // 2 if partner == n else min(left[n], left[partner])
        put(capacity - n - partner, many, (n, partner))
        for x in (n, partner):
            left[x] -= many
        for x in {n, partner}:
            if not left[x]:
                del left[x]
                large.remove(x)
    for n in sorted(left, reverse=True):
        many = left[n]
        while many:
            at = bisect.bisect_left(order, n)
            if at == len(order):
                each = capacity // n
                put(capacity - each * n, many // each, (n,) * each)
                put(capacity - many % each * n, int(many % each > 0), (n,) * (many % each))
                break
            gap = order[at]
            have, held = gaps[gap].pop()
            if not gaps[gap]:
                order.pop(at)
            take = min(have, many)
            put(gap, have - take, held)
            put(gap - n, take, (*held, n))
            many -= take
    out, used, sequence = [], dict.fromkeys(counts, 0), 0
    for gap in sorted(gaps):
        for many, held in gaps[gap]:
            offset = 0
            for n in held:
                out.append((n, used[n], many, sequence, offset))
                used[n] += many
                offset += n
            sequence += many
    return out, sequence


def pieces(df: DataFrame, vocabulary: Vocabulary, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Tokenise and cut: a text of over ``capacity`` tokens gives whole pieces, the first maybe shorter."""
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            for own in sub_batches(batch, "text", 4 << 20):
                parts = [vocabulary.split(t) for t in texts(own.column(1))]
                index, distinct, counts = pretokens.words([x for p in parts for x in p[::2]])
                flat, offsets = pretokens.flat_ids(vocabulary.encode(), pretokens.as_bytes(distinct))
                ids, ends = pretokens.gather(flat, offsets, index)
                stops = iter(np.concatenate([[0], ends])[np.cumsum(counts)].tolist())
                data, begin = ids.astype("<u4", copy=False).tobytes(), 0
                cols = [[] for _ in range(7)]
                for doc, p in zip(own.column(0).to_pylist(), parts, strict=True):
                    runs = []
                    for x in [*p[1::2], end_id]:
                        stop = next(stops)
                        runs += [data[4 * begin : 4 * stop], np.uint32(x).tobytes()]
                        begin = stop
                    whole = b"".join(runs)
                    n, at, piece = len(whole) // 4, 0, 0
                    while at < n:
                        size = capacity if at else n - (-(-n // capacity) - 1) * capacity
                        k = seen.get(size, 0)
                        seen[size] = k + 1
                        for c, v in zip(cols, (doc, piece, at, size, whole[4 * at : 4 * (at + size)], part, k), strict=True):
                            c.append(v)
                        at, piece = at + size, piece + 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids", "part", "k_local"])

    return source.mapInArrow(tidied(run), _PIECES)


def pack(df: DataFrame, vocabulary: Vocabulary, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: (doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset).

    ``ids`` is binary, little-endian unsigned 32-bit.  A null or empty text is the end id alone.  Repeated ids and
    texts are packed like any other row; a null id stays null.  An empty table gives no row.  Other columns are ignored.
    """
    spark = ship(df.sparkSession)
    path = new_path(spark, "pieces")
    cut = pieces(df, vocabulary, capacity, end_id, id_col, text_col)
    cut.write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(cut.schema).parquet(path).withColumn("ids_crc32", F.crc32("ids"))
    by_part = stored.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    ranges, _ = plan(counts, capacity)
    places: dict[int, list[tuple[int, int, int, int]]] = {}
    for n, first, many, sequence, offset in ranges:
        places.setdefault(n, []).append((first, first + many, sequence - first, offset))
    lookup = spark.createDataFrame(sorted(places.items()), "length long, places array<struct<lo: long, hi: long, shift: long, offset: long>>")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = stored.join(bases, ["part", "length"]).withColumn("k", F.col("base") + F.col("k_local")).join(F.broadcast(lookup), "length")
    placed = placed.withColumn("place", F.filter("places", lambda p: (p["lo"] <= F.col("k")) & (F.col("k") < p["hi"]))[0])
    return placed.select("doc_id", "piece", "start", "length", "ids", "ids_crc32", (F.col("k") + F.col("place.shift")).alias("sequence_id"), F.col("place.offset").alias("offset"))
