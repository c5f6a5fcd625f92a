"""Corpus statistics, delivery accounting and image references."""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mathtext import images
from ..shipping import ship


def nearest_rank(df: DataFrame, value: str, q: float, *by: str, rule: str = "round") -> DataFrame:
    """(by, value): the value at index ``round((n - 1) q)`` (halves to even) or ``int(n q)`` of the sorted ones; no group is collected."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ranked = counts.withColumn("upto", F.sum("n").over(w.orderBy(value))).withColumn("all", F.sum("n").over(w))
    at = F.bround((F.col("all") - 1) * q).cast("long") if rule == "round" else F.least(F.floor(F.col("all") * q), F.col("all") - 1)
    return ranked.where(F.col("upto") > at).groupBy(*by).agg(F.min(value).alias(value))


def histogram(n: Column) -> Column:
    """The bucket of a report's number of markers."""
    return F.when(n == 1, "1").when(n == 2, "2").when(n <= 4, "3-4").when(n <= 9, "5-9").when(n <= 19, "10-19").otherwise("20+")


def representatives(df: DataFrame, text: str, path: str) -> DataFrame:
    """(digest, copies, representative): equal texts once, with their least path."""
    return df.groupBy(F.sha2(F.coalesce(text, F.lit("")), 256).alias("digest")).agg(F.count("*").alias("copies"), F.min(path).alias("representative"))


def cover(features: DataFrame, most: int = 22) -> list:
    """Greedy choice of rows (doc, unit, chars, classes) that add most new classes; ties by length down, doc, unit.

    Each step is an aggregate over what is left, so only the chosen rows reach the driver.
    """
    seen: list[str] = []
    chosen: list = []
    for _ in range(most):
        gain = F.size(F.array_except("classes", F.array(*map(F.lit, seen)).cast("array<string>")))
        left = features.where(~F.concat_ws("\0", "doc", "unit").isin([f"{r['doc']}\0{r['unit']}" for r in chosen])) if chosen else features
        best = left.withColumn("gain", gain).orderBy(F.desc("gain"), F.desc("chars"), "doc", "unit").limit(1).collect()
        if not best or not best[0]["gain"]:
            break
        chosen.append(best[0])
        seen = sorted({*seen, *best[0]["classes"]})
    return chosen


def accounting(marks: DataFrame, anchors: DataFrame, fallbacks: DataFrame, key: str) -> DataFrame:
    """(key, n_markers, n_anchors, n_fallbacks, missing, over): what was delivered of each unit's markers; never netted between units."""
    parts = [d.groupBy(key).agg(F.count("*").alias(n)) for d, n in ((marks, "n_markers"), (anchors, "n_anchors"), (fallbacks, "n_fallbacks"))]
    full = parts[0].join(parts[1], key, "full_outer").join(parts[2], key, "full_outer").na.fill(0, ["n_markers", "n_anchors", "n_fallbacks"])
    left = F.col("n_markers") - F.col("n_anchors") - F.col("n_fallbacks")
    return full.withColumn("missing", F.greatest(left, F.lit(0))).withColumn("over", F.greatest(-left, F.lit(0)))


def paired_ids(starts: Column, ends: Column, refs: Column) -> Column:
    """Comment identifiers that have a start, an end and a reference."""
    return F.array_sort(F.array_intersect(F.array_intersect(starts, ends), refs))


def image_references(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, reference_index, alt, path, start, end, duplicate_of) of images outside code, in order."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                first: dict[str, int] = {}
                for i, (a, b, alt, path) in enumerate(images(t)):
                    before = first.setdefault(path, i + 1)
                    rows.append((k, i + 1, alt, path, a, b, None if before == i + 1 else before))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [batch.schema.field(0).type, pa.int32(), pa.string(), pa.string(), *[pa.int32()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[key, "reference_index", "alt", "path", "start", "end", "duplicate_of"])

    ship(df.sparkSession)
    return df.select(key, text).where(F.col(text).contains("](")).mapInArrow(run, f"`{key}` {kind}, reference_index int, alt string, path string, start int, `end` int, duplicate_of int")


def image_issues(refs: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """(key, path, code): references without a file, and files without a reference."""
    gone = refs.join(files, [key, "path"], "left_anti").select(key, "path", F.lit("images.missing").alias("code"))
    extra = files.join(refs, [key, "path"], "left_anti").select(key, "path", F.lit("images.extra_images").alias("code"))
    return gone.union(extra).distinct()


def paper_report(units: DataFrame, paper: str) -> DataFrame:
    """(paper, text, complete) of units (paper, unit_no, unit_name, body, ok, skip): bodies in order, placeholders for what failed."""
    part = F.when(F.col("ok"), F.concat(F.lit("## "), "unit_name", F.lit("\n\n"), "body")).otherwise(F.concat(F.lit("## "), "unit_name", F.lit("\n\n（未通过）")))
    rows = units.where("not skip").groupBy(paper).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("unit_no", F.lit(9999)).alias("no"), "unit_name", part.alias("part")))).alias("p"), F.bool_and("ok").alias("complete"))
    return rows.select(paper, F.array_join(F.transform("p", lambda x: x["part"]), "\n\n").alias("text"), "complete")


def distinct_counts(df: DataFrame, text: str, *by: str) -> DataFrame:
    """(by, physical, contents): how many rows there are and how many different texts."""
    return df.groupBy(*by).agg(F.count("*").alias("physical"), F.count_distinct(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("contents"))


def ranked(df: DataFrame, label: str) -> DataFrame:
    """(label, n, place): labels by how often they occur, most first, then by name; only the counts meet in one task."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), label)))


def with_neighbours(df: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """``df`` with the nearest text before and after a row that isn't blank."""
    full = F.when(F.length(F.trim(text)) > 0, F.col(text))
    w = Window.partitionBy(key).orderBy(order)
    before = F.last(full, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("before", before).withColumn("after", F.first(full, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))


def with_order(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``df`` with ``rising``: whether a row's value isn't below that of the row before."""
    return df.withColumn("rising", F.coalesce(F.col(value) >= F.lag(value).over(Window.partitionBy(key).orderBy(order)), F.lit(True)))
