"""Delivery: marked reports as Word files with comments, their audit, and the tables and files that leave the engine.

A Word file is made in memory from one paper's units and comes back as a binary column, so that its audit, which reads
the finished file, and its accounting are ordinary queries.  Only ``publish`` touches a file system.
"""
from __future__ import annotations

import io
import re
import uuid
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.mathtext import math_spans
from ..operators.corpus import paired_ids
from ..shipping import ship, sliced, spread
from . import omml
from .archives import open_archive
from .archives import read_xml as _xml
from .materials import _W, _run_text

AUTHOR = "galley"
_NS = f'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="{omml.NAMESPACE}"'
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
#: Parts of a Word file that are the same in each.
_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    + "".join(f'<Override PartName="/word/{n}.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.{n if n != "document" else "document.main"}+xml"/>' for n in ("document", "styles", "comments"))
    + "</Types>",
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
    "word/_rels/document.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    + "".join(f'<Relationship Id="rId{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{n}" Target="{n}.xml"/>' for i, n in enumerate(("styles", "comments"), 1))
    + "</Relationships>",
    "word/styles.xml": f'<w:styles {_NS}><w:style w:type="paragraph" w:styleId="Heading1"><w:name w:val="heading 1"/><w:pPr><w:outlineLvl w:val="0"/></w:pPr></w:style></w:styles>',
}
_NOT_XML = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")


def _run(text: str) -> str:
    """Runs and formula objects; line ends within become breaks, and what XML can't hold is left out.

    A formula that says what has no object stays a text.
    """
    out, at = [], 0
    for begin, end, display in math_spans(text) if "$" in text else ():
        width = 2 if display else 1
        made = omml.from_latex(_NOT_XML.sub("", text[begin + width : end - width]))
        if made:
            out += [_plain(text[at:begin]), f"<m:oMathPara>{made}</m:oMathPara>" if display else made]
            at = end
    return "".join([*out, _plain(text[at:])])


def _plain(text: str) -> str:
    pieces = [f'<w:t xml:space="preserve">{escape(p)}</w:t>'.replace("\r", "&#13;") for p in _NOT_XML.sub("", text).split("\n")]
    return f"<w:r>{'<w:br/>'.join(pieces)}</w:r>" if text else ""


def _anchored(note: int, inner: str) -> str:
    return f'<w:commentRangeStart w:id="{note}"/>{inner}<w:commentRangeEnd w:id="{note}"/><w:r><w:commentReference w:id="{note}"/></w:r>'


def make_docx(units: list[dict], escaped: bool = False, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """A Word file of units (unit_name, body, reasons: list of num and reason), in the order given.

    A unit is a heading and its body's lines.  A marker becomes its original under a comment that says the replacement
    and the reason.  A marker without an original has nothing to hold on to; its comment goes to the unit's heading.
    """
    marker = re.compile(X.MARKER_V2 if escaped else X.MARKER_V1)
    plain = (lambda s: re.sub(r"\\([\\|【】])", r"\1", s)) if escaped else (lambda s: s)
    body: list[str] = []
    notes: list[str] = []

    def note(num: str, original: str, replacement: str, why: dict[int, str]) -> int:
        said = [f"{num}. {original} → {replacement}", *filter(None, [why.get(int(num))])]
        notes.append("".join(f"<w:p>{_run(s)}</w:p>" for s in said))
        return len(notes) - 1

    for unit in units:
        why = {r["num"]: r["reason"] for r in unit["reasons"] or ()}
        loose: list[int] = []
        lines = [""]
        at = 0
        text = unit["body"] or ""
        for m in [*marker.finditer(text), None]:
            first, *more = text[at : m.start() if m else len(text)].split("\n")
            lines[-1] += _run(first)
            lines += map(_run, more)
            if m:
                original, replacement = plain(m[2]), plain(m[3])
                key = note(m[1], original, replacement, why)
                if _NOT_XML.sub("", original).strip():
                    lines[-1] += _anchored(key, _run(original))
                else:
                    lines[-1] += _run(original)
                    loose.append(key)
                at = m.end()
        title = _run(unit["unit_name"] or "")
        for key in loose:
            title = _anchored(key, title)
        body.append(f'<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr>{title}</w:p>')
        body += [f"<w:p>{x}</w:p>" for x in lines]
    comments = "".join(f'<w:comment w:id="{i}" w:author="{AUTHOR}" w:date="{date}">{x}</w:comment>' for i, x in enumerate(notes))
    parts = _PARTS | {"word/document.xml": f"<w:document {_NS}><w:body>{''.join(body)}</w:body></w:document>", "word/comments.xml": f"<w:comments {_NS}>{comments}</w:comments>"}
    with zipfile.ZipFile(out := io.BytesIO(), "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), _HEAD + data, zipfile.ZIP_DEFLATED)  # a fixed time: equal input, equal bytes
    return out.getvalue()


def word_files(units: DataFrame, paper: str, escaped: bool = False) -> DataFrame:
    """(paper, content, error) of units (paper, unit_no, unit_name, body, reasons: array of num and reason), a file a paper.

    Units are ordered by number, then name; those without a number come last.  What can't be made gives its error.
    """
    kind = units.schema[paper].dataType.simpleString()
    unit = F.struct(F.coalesce("unit_no", F.lit(1 << 30)).alias("no"), "unit_name", "body", "reasons")
    papers = spread(units, paper).groupBy(paper).agg(F.array_sort(F.collect_list(unit)).alias("units"))

    def run(batches):
        for batch in sliced(batches):
            made: list[tuple[bytes | None, str | None]] = []
            for own in batch.column(1).to_pylist():
                try:
                    made.append((make_docx(own, escaped), None))
                except (ValueError, OverflowError) as e:
                    made.append((None, f"{type(e).__name__}: {e}"))
            contents, errors = zip(*made, strict=True) if made else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(contents, pa.binary()), pa.array(errors, pa.string())], names=[paper, "content", "error"])

    ship(units.sparkSession)
    return papers.mapInArrow(run, f"`{paper}` {kind}, content binary, error string")


def _inspect(content: bytes) -> list[tuple[int, str, list[str], list[str], list[str], list[str], list[str]]]:
    """(ordinal, unit, starts, ends, references, comments of them that exist, identifiers at the heading) of a Word file's units."""
    z = open_archive(content)
    known = {c.get(f"{_W}id") for c in _xml(z, "word/comments.xml").iter(f"{_W}comment")} if "word/comments.xml" in z.namelist() else set()
    out: list[tuple] = []
    for p in _xml(z, "word/document.xml").iter(f"{_W}p"):
        style = p.find(f"{_W}pPr/{_W}pStyle")
        heading = style is not None and style.get(f"{_W}val") == "Heading1"
        if heading:
            out.append((len(out), _run_text(p), [], [], [], [], []))
        if out:
            for i, tag in ((2, "commentRangeStart"), (3, "commentRangeEnd"), (4, "commentReference")):
                out[-1][i].extend(e.get(f"{_W}id") for e in p.iter(f"{_W}{tag}"))
            if heading:
                out[-1][6].extend(out[-1][2])
    for u in out:
        u[5].extend(sorted(set(u[4]) & known))
    return out


def word_audit(files: DataFrame, paper: str) -> DataFrame:
    """(paper, unit_ord, unit_name, n_anchors, n_fallbacks, n_unpaired) of finished Word files (paper, content).

    An anchor has a start, an end, a reference and a comment; at a heading it is a fallback.  ``n_unpaired`` counts
    identifiers that lack one of the four.  A file without content gives no row.
    """
    kind = files.schema[paper].dataType.simpleString()
    names = ("starts", "ends", "refs", "known", "at_heading")

    def run(batches):
        for batch in sliced(batches):
            rows = [(k, *u) for k, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for u in _inspect(content)]
            cols = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [batch.schema.field(0).type, pa.int32(), pa.string(), *[pa.list_(pa.string())] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[paper, "unit_ord", "unit_name", *names])

    ship(files.sparkSession)
    found = files.where(F.col("content").isNotNull()).select(paper, "content").mapInArrow(run, f"`{paper}` {kind}, unit_ord int, unit_name string, " + ", ".join(f"{n} array<string>" for n in names))
    paired = found.withColumn("paired", F.array_intersect(paired_ids(F.col("starts"), F.col("ends"), F.col("refs")), "known"))
    every = F.array_distinct(F.concat("starts", "ends", "refs"))
    count = lambda c: F.size(c).cast("long")
    return paired.select(paper, "unit_ord", "unit_name", count(F.array_except("paired", "at_heading")).alias("n_anchors"), count(F.array_intersect("paired", "at_heading")).alias("n_fallbacks"), count(F.array_except(every, "paired")).alias("n_unpaired"))


def reconcile(marks: DataFrame, audit: DataFrame, paper: str) -> DataFrame:
    """(paper, n_markers, n_anchors, n_fallbacks, missing, over, n_unpaired, ok): the markers of units (paper, n_markers) against an audit.

    ``missing`` and ``over`` are never netted between papers; a paper without a file has all its markers missing.
    """
    want = marks.groupBy(paper).agg(F.sum("n_markers").alias("n_markers"))
    got = audit.groupBy(paper).agg(*[F.sum(c).alias(c) for c in ("n_anchors", "n_fallbacks", "n_unpaired")])
    both = want.join(got, paper, "full_outer").na.fill(0, ["n_markers", "n_anchors", "n_fallbacks", "n_unpaired"])
    left = F.col("n_markers") - F.col("n_anchors") - F.col("n_fallbacks")
    full = both.withColumn("missing", F.greatest(left, F.lit(0))).withColumn("over", F.greatest(-left, F.lit(0)))
    return full.withColumn("ok", (left == 0) & (F.col("n_unpaired") == 0))


def _replace(spark, passing, final) -> None:
    """Give a file its final name in one step, also where there is one of that name."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark._jsc.hadoopConfiguration()).rename(passing, final, options)


def publish(files: DataFrame, folder: str, name: str = "name", ok: str = "ok") -> list[str]:
    """Write files (name, content, ok) into a folder of any file system Spark reaches; returns their paths.

    Rows come to the driver one partition at a time and are written under a passing name, then renamed over what may be
    there, so a reader finds the old file or the new one and never half of one.  What isn't ok is named
    ``.failed.docx``, and leaves a file published before alone.  Different files whose names are equal once they are
    safe get a part of their digest behind them, but for the first by digest.
    """
    spark = files.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(conf)
    root = fs.makeQualified(root)
    named = files.select(X.safe_name(F.col(name)).alias("n"), "content", F.coalesce(F.col(ok), F.lit(False)).alias("ok")).where("content is not null").withColumn("d", F.sha2("content", 256))
    first = named.groupBy("n", "ok").agg(F.min("d").alias("first"))
    called = F.when(F.col("d") == F.col("first"), F.col("n")).otherwise(F.concat(F.col("n"), F.lit("-"), F.substring("d", 1, 8)))
    out = []
    for row in named.join(first, ["n", "ok"]).select(called.alias("n"), "ok", "content").toLocalIterator():
        final = jvm.org.apache.hadoop.fs.Path(root, f"{row['n']}{'.docx' if row['ok'] else '.failed.docx'}")
        passing = jvm.org.apache.hadoop.fs.Path(root, f".{uuid.uuid4().hex}.tmp")
        stream = fs.create(passing, True)
        try:
            stream.write(bytearray(row["content"]))
        finally:
            stream.close()
        _replace(spark, passing, final)
        out.append(str(final))
    return out


def report_json(summary: Column, marks: Column) -> Column:
    """A report as JSON: its severity and an array of (num, original, replacement, reason)."""
    return F.to_json(F.struct(summary.alias("summary"), marks.alias("items")), {"ignoreNullFields": "false"})


def write_units(units: DataFrame, path: str, material: str = "material_id", mode: str = "append") -> None:
    """Units as Parquet, a folder a material; rows of a material are spread by unit, so a large one is many files."""
    units.repartition(material, "unit_no").write.mode(mode).partitionBy(material).parquet(path)


def supersede(old: DataFrame, keep: DataFrame, run_id: str, *key: str) -> DataFrame:
    """``old`` with a status: units that ``keep`` has not are superseded by the run, and none is deleted."""
    there = keep.select(*key).distinct().withColumn("__kept", F.lit(True))
    gone = F.col("__kept").isNull()
    return old.join(there, list(key), "left").withColumn("status", F.when(gone, "superseded").otherwise("current")).withColumn("superseded_by", F.when(gone, F.lit(run_id))).drop("__kept")
