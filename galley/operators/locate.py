"""Locating spans: overlapping search, anchors with context, safe spans, location tokens."""
from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.mathtext import math_spans
from ..functions.text import ANCHOR_ZERO_WIDTH
from ..shipping import ship

MOST_OLD, MOST_CONTEXT, CANDIDATES, AROUND = 1000, 200, 5, 24


def hits(text: str, query: str) -> list[int]:
    """All offsets of a query, overlapping ones included."""
    out, at = [], text.find(query) if query else -1
    while at >= 0:
        out.append(at)
        at = text.find(query, at + 1)
    return out


def count_hits(text: Column, query: Column) -> Column:
    """How often a query occurs, overlapping, without leaving the JVM."""
    return F.size(F.regexp_extract_all(text, F.concat(F.lit("(?=(\\Q"), query, F.lit("\\E))")), F.lit(1))).cast("long")


def normalized(text: str) -> tuple[str, list[int]]:
    """(text without zero-width characters and with plain line ends, source offset of each of its characters and of the end)."""
    chars, at = [], []
    i = 0
    while i < len(text):
        if text[i] not in ANCHOR_ZERO_WIDTH:
            at.append(i)
            if text.startswith("\r\n", i):
                chars.append("\n")
                i += 1
            else:
                chars.append(text[i])
        i += 1
    return "".join(chars), [*at, len(text)]


def structure_spans(text: str) -> list[tuple[int, int]]:
    """Spans that a correction must not cut: formulas and bold runs."""
    return sorted([(a, b) for a, b, _ in math_spans(text)] + [m.span() for m in re.finditer(r"\*\*[^*\n]+\*\*", text)])


def safe_span(spans: list[tuple[int, int]], start: int, end: int) -> tuple[int, int]:
    """The span grown, until nothing changes, by every structure that it overlaps."""
    while True:
        touched = [(a, b) for a, b in spans if a < end and start < b]
        grown = min([start, *(a for a, _ in touched)]), max([end, *(b for _, b in touched)])
        if grown == (start, end):
            return grown
        start, end = grown


def line_column(text: str, at: int) -> tuple[int, int]:
    return text.count("\n", 0, at) + 1, at - (text.rfind("\n", 0, at) + 1) + 1


def resolve(source: str, old: str, before: str = "", after: str = "", occurrence: int | None = None) -> dict:
    """The span of ``old`` between its contexts: {start, end, line, col, normalized} or {error, candidates, required}."""
    if not old:
        return {"error": "anchor.empty"}
    if len(old) > MOST_OLD or max(len(before), len(after)) > MOST_CONTEXT:
        return {"error": "anchor.too-long"}
    query = before + old + after
    starts = [(p + len(before), p + len(before) + len(old)) for p in hits(source, query)]
    exact = bool(starts)
    if not starts:
        (plain, at), parts = normalized(source), [normalized(x)[0] for x in (before, old, after)]
        starts = [(at[p + len(parts[0])], at[p + len(parts[0]) + len(parts[1]) - 1] + 1) for p in hits(plain, "".join(parts)) if parts[1]]
        starts = [(a, b + (source[b - 1 : b + 1] == "\r\n")) for a, b in starts]
    if not starts:
        return {"error": "anchor.not-found"}
    if occurrence is not None and not 1 <= occurrence <= len(starts):
        return {"error": "anchor.occurrence-out-of-range"}
    if occurrence is None and len(starts) > 1:
        shown = [{"start": a, "around": source[max(a - AROUND, 0) : b + AROUND]} for a, b in starts[:CANDIDATES]]
        return {"error": "anchor.ambiguous", "candidates": shown}
    start, end = starts[(occurrence or 1) - 1]
    grown = safe_span(structure_spans(source), start, end)
    if grown != (start, end):
        return {"error": "anchor.structure-cut", "required": source[slice(*grown)]}
    line, col = line_column(source, start)
    return {"start": start, "end": end, "line": line, "col": col, "normalized": not exact}


_RESULT = "start int, `end` int, line int, col int, normalized boolean, error string, required string, candidates array<struct<start: int, around: string>>"


def anchors(df: DataFrame, key: str, source: str, old: str, before: str | None = None, after: str | None = None, occurrence: str | None = None) -> DataFrame:
    """(key, span or error) of every row: what ``resolve`` says."""
    part = lambda c, kind: (F.col(c) if c else F.lit(None)).cast(kind)
    rows = df.select(F.col(key).alias("k"), part(source, "string").alias("s"), part(old, "string").alias("o"), part(before, "string").alias("b"), part(after, "string").alias("a"), part(occurrence, "int").alias("n"))
    kind = df.schema[key].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int32()), ("around", pa.string())]))
    kinds = {"start": pa.int32(), "end": pa.int32(), "line": pa.int32(), "col": pa.int32(), "normalized": pa.bool_(), "error": pa.string(), "required": pa.string(), "candidates": span}

    def run(batches):
        for batch in batches:
            found = [resolve(s or "", o or "", b or "", a or "", n) for s, o, b, a, n in zip(*(batch.column(i).to_pylist() for i in range(1, 6)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x.get(c) for x in found], t) for c, t in kinds.items())], names=[key, *kinds])

    ship(df.sparkSession)
    return rows.mapInArrow(run, f"`{key}` {kind}, {_RESULT}")


def resolved(df: DataFrame, source: str, wanted: str, out: str = "spots") -> DataFrame:
    """``df`` with ``out``: of each element of ``wanted``, an array of (old_text, context_before, context_after, occurrence), its (start, end, error).

    A step of its own, not a function of columns, which can't stand within functions of an array's elements.
    """
    names = ("old_text", "context_before", "context_after", "occurrence")
    schema = StructType([*df.schema.fields, *StructType.fromDDL(f"`{out}` array<struct<start: int, `end`: int, error: string>>").fields])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("error", pa.string())]))
    at, by = df.columns.index(source), df.columns.index(wanted)

    def run(batches):
        for batch in batches:
            found = []
            for text, each in zip(batch.column(at).to_pylist(), batch.column(by).to_pylist(), strict=True):
                spots = [resolve(text or "", *(x[n] or "" for n in names[:3]), x[names[3]]) for x in each or ()]
                found.append([{c: x.get(c) for c in ("start", "end", "error")} for x in spots])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=schema.fieldNames())

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def locations(df: DataFrame, key: str, source: str, phrase: str, around: int = 48) -> DataFrame:
    """(key, match_index, start, end, safe_start, safe_end, paragraph_id, context) of every hit of a phrase."""
    kind = df.schema[key].dataType.simpleString()
    names = ["match_index", "start", "end", "safe_start", "safe_end", "paragraph_id", "context"]

    def run(batches):
        for batch in batches:
            keys, rows = [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = hits(text or "", phrase)
                spans = structure_spans(text) if found else []
                cuts = [m.end() for m in re.finditer(r"\n\s*\n", text)] if found else []
                for i, a in enumerate(found):
                    b = a + len(phrase)
                    ordinal = sum(c <= a for c in cuts)
                    paragraph = re.split(r"\n\s*\n", text)[ordinal]
                    keys.append(k)
                    rows.append((i + 1, a, b, *safe_span(spans, a, b), f"p{ordinal + 1}-{hashlib.sha256(paragraph.encode()).hexdigest()[:12]}", text[max(a - around, 0) : b + around]))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int32()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=[key, *names])

    ship(df.sparkSession)
    return df.select(key, source).mapInArrow(run, f"`{key}` {kind}, match_index int, start int, `end` int, safe_start int, safe_end int, paragraph_id string, context string")


def formulas(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ord, start, end, display) of every formula."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = [(k, i + 1, *s) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, s in enumerate(math_spans(t or ""))]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [batch.schema.field(0).type, *[pa.int32()] * 3, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[key, "ord", "start", "end", "display"])

    ship(df.sparkSession)
    return df.select(key, text).where(F.col(text).contains("$")).mapInArrow(run, f"`{key}` {kind}, ord int, start int, `end` int, display boolean")
