"""Images of units: headers and pixels, copies on white, candidates for a reference, names, rewritten references, inspection."""
from __future__ import annotations

import hashlib
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, StringType, StructField, StructType

from ..functions.pixels import decode, encode_png, gif_is_transparent

KIND = StructType([StructField("format", StringType()), StructField("width", IntegerType()), StructField("height", IntegerType()), StructField("alpha", BooleanType())])


def header(data: bytes) -> tuple[str, int, int, bool] | None:
    """(format, width, height, whether it may be transparent) of PNG, JPEG, GIF and BMP data; None of others and of damaged ones."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 33 and data[12:16] == b"IHDR":
        width, height, _, colour = struct.unpack(">IIBB", data[16:26])
        return "png", width, height, colour in (4, 6) or b"tRNS" in data[:4096]
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return "gif", *struct.unpack("<HH", data[6:10]), gif_is_transparent(data)
    if data[:2] == b"BM" and len(data) >= 26:
        width, height = struct.unpack("<ii", data[18:26])
        return "bmp", width, abs(height), False
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            code, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if 0xC0 <= code <= 0xCF and code not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                return "jpeg", width, height, False
            at += 2 + size
    return None


@F.pandas_udf(KIND)
def summary(data: pd.Series) -> pd.DataFrame:
    """STRUCT<format, width, height, alpha> of images; all null where they can't be read."""
    found = [header(x) if x is not None else None for x in data]
    return pd.DataFrame([x or (None,) * 4 for x in found], columns=KIND.names)


def white_copy_name(name: Column, sha256: Column) -> Column:
    """The name of an image's copy on white: bound to what the image holds."""
    return F.concat(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit(".white-"), F.substring(sha256, 1, 16), F.lit(".png"))


def candidates(references: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """(key, name, path, code): the file for each image name, from the folder of the highest priority (the least number).

    files: (key, name, path, sha256, priority).  Files of one name and priority that differ in content are ``conflict``,
    a name without a file is ``missing``; then there is no path.
    """
    best = files.groupBy(key, "name", "priority").agg(F.count_distinct("sha256").alias("n"), F.min("path").alias("path"))
    first = best.groupBy(key, "name").agg(F.min_by(F.struct("n", "path"), "priority").alias("f"))
    met = references.select(key, "name").distinct().join(first, [key, "name"], "left")
    code = F.when(F.col("f").isNull(), "missing").when(F.col("f.n") > 1, "conflict")
    return met.select(key, "name", F.when(code.isNull(), F.col("f.path")).alias("path"), code.alias("code"))


def stored_names(files: DataFrame, key: str) -> DataFrame:
    """Files (key, name, sha256) with ``stored``: of different ones with a name all but the first by digest get it in theirs."""
    distinct = files.select(key, "name", "sha256").distinct()
    first = distinct.groupBy(key, "name").agg(F.min("sha256").alias("first"))
    dot = F.regexp_extract("name", r"(\.[^.]*)?$", 0)
    stem = F.substr("name", F.lit(1), F.length("name") - F.length(dot))
    stored = F.when(F.col("sha256") == F.col("first"), F.col("name")).otherwise(F.concat(stem, F.lit("-"), F.substring("sha256", 1, 8), dot))
    return files.join(first, [key, "name"]).withColumn("stored", stored).drop("first")


def rewrite(text: Column, folder: str = "./images") -> Column:
    """Image references point to one folder by their file names; remote ones stay."""
    return F.regexp_replace(text, r"(!\[[^\]\n]*\]\()(?![A-Za-z][A-Za-z0-9+.-]*:|//)(?:[^)\n]*/)?([^)/\n]+)(?=\))", f"$1{folder}/$2")


def placeholder_digest(pixels: bytes) -> str:
    """SHA-256 of an image's pixels, by which a converter's placeholder of a broken image is known."""
    return hashlib.sha256(pixels).hexdigest()


def broken_placeholder(width: Column, height: Column, pixels_sha256: Column, known: tuple[str, ...]) -> Column:
    """Whether an image is a converter's placeholder: 88 by 106 pixels with a known digest."""
    return (width == 88) & (height == 106) & pixels_sha256.isin(*known)


def white_copy(data: bytes) -> bytes | None:
    """A transparent image on white, as a PNG; None where it has nothing transparent or can't be decoded."""
    pixels = decode(data)
    if pixels is None or (pixels[..., 3] == 255).all():
        return None
    alpha = pixels[..., 3:].astype(np.int64)
    return encode_png((pixels[..., :3] * alpha + 255 * (255 - alpha) + 127) // 255)


@F.pandas_udf(BinaryType())
def on_white(data: pd.Series) -> pd.Series:
    """``white_copy`` of images."""
    return pd.Series([None if x is None else white_copy(x) for x in data])


@F.pandas_udf(StringType())
def pixels_sha256(data: pd.Series) -> pd.Series:
    """SHA-256 of the pixels of images, red green blue alpha; null where they can't be decoded."""
    found = [None if x is None else decode(x) for x in data]
    return pd.Series([None if p is None else placeholder_digest(np.ascontiguousarray(p).tobytes()) for p in found])


#: Suffixes of images that are read.
SUFFIXES = ("png", "jpg", "jpeg", "gif", "bmp", "webp")


def inspect(references: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """(key, reference_index, path, code): the first thing that is wrong with each reference, and files that nothing refers to.

    references: (key, reference_index, path, syntax), syntax being ``inline`` or another that isn't read; files: (key,
    path, readable, transparent, white_readable), the last null where there is no copy on white.
    """
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    climbs = F.col("path").rlike(r"^/|(?:^|/)\.\.(?:/|$)") | (F.length(F.trim("path")) == 0)
    met = references.join(files.withColumn("there", F.lit(True)), [key, "path"], "left")
    code = (
        F.when(F.col("syntax") != "inline", "images.unsupported_syntax").when(F.col("path").isNull() | (F.length(F.trim("path")) == 0), "images.invalid_reference").when(F.col("path").rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|//)"), "images.remote_unsupported")
        .when(climbs, "images.invalid_reference").when(F.col("there").isNull(), "images.missing").when(~suffix.isin(*SUFFIXES), "images.unsupported_format").when(~F.coalesce("readable", F.lit(False)), "images.unreadable")
        .when(F.col("transparent") & F.col("white_readable").isNull(), "images.white_background_missing").when(F.col("transparent") & ~F.col("white_readable"), "images.white_background_unreadable")
    )
    extra = files.join(references.select(key, "path").distinct(), [key, "path"], "left_anti").select(key, F.lit(None).cast("int").alias("reference_index"), "path", F.lit("images.extra_images").alias("code"))
    return met.withColumn("code", code).where("code is not null").select(key, "reference_index", "path", "code").unionByName(extra)
