"""Reading materials: Markdown, Word and InDesign files into Markdown with a block plan, and subject configurations.

Files are read with Spark's binary reader; archives are opened in memory with limits on members and sizes.
"""
from __future__ import annotations

import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship, sliced
from ..staging import staged
from . import indesign, omml
from . import wordparts as P
from .archives import SourceError, open_archive
from .archives import read_xml as _xml

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_MATH = f"{{{omml.NAMESPACE}}}"
SCHEMA = "path string, kind string, markdown string, blocks array<struct<kind: string, level: int, title: string, start_line: int, end_line: int>>, warnings array<string>, error string"



def _style_levels(z: zipfile.ZipFile) -> dict[str, int]:
    """Outline level of each paragraph style, inherited from the style it is based on."""
    if "word/styles.xml" not in z.namelist():
        return {}
    own, base = {}, {}
    for s in _xml(z, "word/styles.xml").iter(f"{_W}style"):
        key = s.get(f"{_W}styleId", "")
        level, parent = s.find(f"{_W}pPr/{_W}outlineLvl"), s.find(f"{_W}basedOn")
        if level is not None and (level.get(f"{_W}val") or "").isdigit():
            own[key] = int(level.get(f"{_W}val")) + 1
        if parent is not None:
            base[key] = parent.get(f"{_W}val", "")
    out = {}
    for key in {*own, *base}:
        at, seen = key, set()
        while at and at not in own and at not in seen:
            seen.add(at)
            at = base.get(at, "")
        if at in own:
            out[key] = own[at]
    return out


def _relations(z: zipfile.ZipFile) -> dict[str, str]:
    """Targets of the document's relations by identifier."""
    name = "word/_rels/document.xml.rels"
    return {e.get("Id", ""): e.get("Target", "") for e in _xml(z, name)} if name in z.namelist() else {}


def _add_table(table: ElementTree.Element, add, inner, levels: dict[str, int]) -> None:
    """A table as blocks: a heading or paragraph in a cell alone, a question in a column of cells, a line of cells, or data."""
    rows = P.rows_of(table)
    texts = [[[x for x in inner(c) if x.strip()] for c in r] for r in rows]
    if len(rows) >= 3 and all(len(r) == 1 for r in rows):
        stem = [x for r in texts[:1] for c in r for x in c]
        rest = [x for r in texts[1:] for c in r for x in c]
        first = next((i for i, x in enumerate(rest) if re.match(P.OPTION, x)), len(rest))
        last = next((i for i, x in enumerate(rest) if i > first and re.match(r"^【?(?:答案|解析|详解)", x)), len(rest))
        add("question", None, stem[0] if stem else "", [*stem, *rest[:first], *P.options(rest[first:last]), *rest[last:]] or [""])
    elif len(rows) == 1:
        held = [x for c in texts[0] for x in c]
        style = table.find(f".//{_W}pPr/{_W}pStyle")
        level = levels.get(style.get(f"{_W}val", "")) if style is not None and len(rows[0]) == 1 else None
        if held and level and len(held) == 1 and len(held[0]) <= 20:
            add("heading", level, held[0].strip("*"), [f"{'#' * level} {held[0].strip('*')}"])
        elif held:
            add("paragraph", None, held[0], held)
    elif P.holds_data(table):
        add("table", None, "", P.pipe_table(table, inner))
    else:
        made = P.answer_lines([(r[0][0] if len(r) > 1 and len(r[0]) == 1 else "", [x for c in (r[1:] if len(r) > 1 and len(r[0]) == 1 else r) for x in c]) for r in texts])
        if made:
            add("paragraph", None, made[0], made)


def run_formats(data: bytes) -> list[tuple[str, str]]:
    """(kind, text) of the formatted runs of a Word file."""
    z = open_archive(data)
    return P.formats(_xml(z, "word/document.xml")) if "word/document.xml" in z.namelist() else []


def _formula(e: ElementTree.Element) -> str:
    """A formula object in LaTeX; empty where it is nested too deep for that, which the reader warns of."""
    try:
        return omml.to_latex(e)
    except RecursionError:
        return ""


def _plain_text(e: ElementTree.Element) -> str:
    """The words below an element, formulas between dollars."""
    return "".join(x.text or "" if x.tag == f"{_W}t" else f"${_formula(x)}$" for x in e.iter() if x.tag in (f"{_W}t", f"{_MATH}oMath"))


def _run_text(paragraph: ElementTree.Element, notes: dict[str, str] | None = None, targets: dict[str, str] | None = None) -> str:
    """A paragraph's text: deleted runs left out, neighbouring bold runs in one pair of marks, ``notes`` where their ranges end, drawings as images."""
    parts: list[tuple[bool, str]] = []
    shown: set[ElementTree.Element] = set()

    def add(strong: bool, text: str) -> None:
        if parts and parts[-1][0] == strong:
            parts[-1] = (strong, parts[-1][1] + text)
        else:
            parts.append((strong, text))

    for r in paragraph.iter():
        if r.tag == f"{_W}commentRangeEnd" and notes and (key := r.get(f"{_W}id")) in notes:
            parts.append((False, notes[key]))
        if r.tag == f"{_MATH}oMathPara":
            shown.update(r.iter(f"{_MATH}oMath"))
        if r.tag == f"{_MATH}oMath" and (formula := _formula(r)):
            mark = "$$" if r in shown else "$"
            add(False, f"{mark}{formula}{mark}")
        if r.tag != f"{_W}r":
            continue
        text = "".join(t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" if t.tag == f"{_W}br" else P.drawing(t, targets) if targets and t.tag == f"{_W}drawing" else "" for t in r)
        bold = r.find(f"{_W}rPr/{_W}b")
        strong = bold is not None and bold.get(f"{_W}val", "1") not in ("0", "false")
        if text:
            add(strong, text)
    return "".join(f"**{t}**" if b and t.strip() else t for b, t in parts)


def _comment_texts(z: zipfile.ZipFile) -> dict[str, str]:
    if "word/comments.xml" not in z.namelist():
        return {}
    return {c.get(f"{_W}id", ""): _plain_text(c) for c in _xml(z, "word/comments.xml").iter(f"{_W}comment")}


def _comment_anchors(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(id, text under it) of the comment ranges of a Word file, by where they end."""
    found: list[tuple[str, str]] = []
    begun: dict[str, list[str]] = {}
    for e in _xml(z, "word/document.xml").iter():
        if e.tag == f"{_W}commentRangeStart":
            begun[e.get(f"{_W}id", "")] = []
        elif e.tag in (f"{_W}t", f"{_MATH}oMath"):
            for held in begun.values():
                held.append(e.text or "" if e.tag == f"{_W}t" else f"${_formula(e)}$")
        elif e.tag == f"{_W}commentRangeEnd" and (k := e.get(f"{_W}id", "")) in begun:
            found.append((k, "".join(begun.pop(k))))
    return found


def _comment_tags(z: zipfile.ZipFile) -> dict[str, str]:
    """The tag of each comment that has a text under it, numbered in order."""
    texts = _comment_texts(z)
    held = [(k, anchor) for k, anchor in _comment_anchors(z) if anchor and k in texts]
    return {k: f"<批注 id={n}><原>{anchor}</原><改>{texts[k]}</改></批注>" for n, (k, anchor) in enumerate(held, 1)}


def read_docx(data: bytes, with_comments: bool = False) -> tuple[str, list[dict], list[str]]:
    """(Markdown, blocks, warnings): headings, paragraphs and tables with 1-based inclusive lines.

    With comments, each stands in a tag where its range ends, by its place in the file and not by a search for its text.
    """
    z = open_archive(data)
    notes = _comment_tags(z) if with_comments else {}
    if "word/document.xml" not in z.namelist():
        raise SourceError("no Word document inside")
    levels, body, targets = _style_levels(z), _xml(z, "word/document.xml").find(f"{_W}body"), _relations(z)
    lines: list[str] = []
    blocks: list[dict] = []
    warnings: list[str] = []

    def add(kind: str, level: int | None, title: str, new: list[str]) -> None:
        blocks.append({"kind": kind, "level": level, "title": title, "start_line": len(lines) + 1, "end_line": len(lines) + len(new)})
        lines.extend([*new, ""])

    def inner(container: ElementTree.Element) -> list[str]:
        """Lines of a cell or a content control: its paragraphs and what its tables hold."""
        out: list[str] = []
        for child in container:
            if child.tag == f"{_W}p":
                out += _run_text(child, notes, targets).split("\n")
            elif child.tag == f"{_W}tbl" and P.holds_data(child):
                out += P.pipe_table(child, inner)
            elif child.tag == f"{_W}tbl":
                out += [x for row in P.rows_of(child) for cell in row for x in inner(cell)]
            elif child.tag == f"{_W}sdt" and (held := child.find(f"{_W}sdtContent")) is not None:
                out += inner(held)
        return out

    for node in body if body is not None else ():
        if node.tag == f"{_W}p":
            if any(not _formula(e) for e in node.iter(f"{_MATH}oMath")):
                warnings.append("a formula object is empty or nested too deep")
            text = _run_text(node, notes, targets)
            style = node.find(f"{_W}pPr/{_W}pStyle")
            level = levels.get(style.get(f"{_W}val", "")) if style is not None else None
            if text.strip():
                plain = text.strip().strip("*")
                add("heading" if level else "paragraph", level, plain if level else "", [f"{'#' * level} {plain}"] if level else text.split("\n"))
        elif node.tag == f"{_W}tbl":
            _add_table(node, add, inner, levels)
    return "\n".join(lines).rstrip("\n") + "\n", blocks, sorted(set(warnings))


def read_markdown(data: bytes) -> tuple[str, list[dict], list[str]]:
    try:
        return data.decode("utf-8-sig"), [], []
    except UnicodeDecodeError:
        return data.decode("utf-8", "replace"), [], ["bytes that aren't UTF-8 were replaced"]


READERS = {"docx": read_docx, "md": read_markdown, "markdown": read_markdown}


#: What a damaged file raises.
FAILURES = (SourceError, ElementTree.ParseError, zipfile.BadZipFile, KeyError)


def read_one(path: str, data: bytes, with_comments: bool = False) -> tuple:
    """(kind, markdown, blocks, warnings, error) of a file by its name's ending."""
    kind = path.rsplit(".", 1)[-1].lower()
    try:
        if kind not in READERS:
            raise SourceError(f"unsupported: .{kind}")
        return kind, *(read_docx(data, True) if with_comments and kind == "docx" else READERS[kind](data)), None
    except FAILURES as e:
        return kind, None, [], [], f"{type(e).__name__}: {e}"


def parsed(files: DataFrame, with_comments: bool = False) -> DataFrame:
    """(path, kind, markdown, blocks, warnings, error) of files (path, content); a file that can't be read gives its error.

    ``with_comments`` puts the comments of Word files into their Markdown, in tags that ``clean_markdown`` removes.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(f"{SCHEMA}, {indesign.PARTS.removeprefix('path string, ').removesuffix(', error string')}")
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in sliced(batches, 64):
            rows = []
            for file, content, designed in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                if designed:
                    spreads, paragraphs, error = indesign.read_row(content.as_py())
                    rows.append((file, "idml", None, [], [], error, spreads, paragraphs))
                else:
                    rows.append((file, *read_one(file, content.as_py(), with_comments), None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

    ship(files.sparkSession)
    named = files.where(F.col("path").isNotNull()).select("path", "content", F.lower("path").endswith(".idml").alias("designed"))
    read = staged(named.mapInArrow(run, schema), "read")  # each file is opened once, however often its parts are needed
    return read.where("spreads is null").drop("spreads", "paragraphs").unionByName(indesign.assembled(read.where("spreads is not null").select("path", "spreads", "paragraphs", "error")))


def materials(spark: SparkSession, path: str, with_comments: bool = False) -> DataFrame:
    """``parsed`` of all files below a path."""
    return parsed(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), with_comments)


def comments(spark: SparkSession, path: str) -> DataFrame:
    """(path, id, text, anchor) of the comments of Word files, ordered by where they end."""

    def run(batches):
        for batch in sliced(batches):
            rows = []
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                z = open_archive(content.as_py())
                if "word/comments.xml" not in z.namelist():
                    continue
                texts = _comment_texts(z)
                rows += [(file, k, texts.get(k), anchor) for k, anchor in _comment_anchors(z)]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["path", "id", "text", "anchor"])

    ship(spark)
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content").mapInArrow(run, "path string, id string, text string, anchor string")


def formulas(files: DataFrame) -> DataFrame:
    """(path, no, latex) of the formula objects of Word files (path, content), in order from 1; files that can't be read give no row."""

    def run(batches):
        for batch in sliced(batches):
            rows = []
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    body = _xml(open_archive(content.as_py()), "word/document.xml")
                except (SourceError, ElementTree.ParseError, zipfile.BadZipFile, KeyError):
                    continue
                rows += [(file, no, _formula(e)) for no, e in enumerate(body.iter(f"{_MATH}oMath"), 1)]
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string()), strict=True)], names=["path", "no", "latex"])

    ship(files.sparkSession)
    return files.select("path", "content").mapInArrow(run, "path string, no int, latex string")


def unit_dirs(files: DataFrame) -> DataFrame:
    """(unit_dir, unit_no) of paths whose folder is named like a unit."""
    name = F.element_at(F.split("path", "/"), -2)
    return files.select(name.alias("unit_dir")).where(name.rlike(r"^(?:第\d+题|单元\d+|板块\d+)$")).distinct().withColumn("unit_no", F.regexp_extract("unit_dir", r"(\d+)", 1).cast("int"))


_SUBJECT = "subject string, tools array<string>, split_mode string, section_pattern string, exam_question_pattern string, nav_patterns array<string>, quantities map<string, string>, lecture struct<split_mode: string, section_pattern: string>, exam struct<question_pattern: string>"


def settings(texts: DataFrame, text: str, *carry: str) -> DataFrame:
    """(carry, subject, tools, split_mode, section_pattern, exam_question_pattern, nav_patterns, quantities) of JSON texts: aliases resolved, the top level first."""
    raw = texts.select(*carry, F.from_json(text, _SUBJECT).alias("s")).select(*carry, "s.*")
    return raw.select(
        *carry, "subject", F.coalesce("tools", F.array().cast("array<string>")).alias("tools"), F.coalesce("split_mode", "lecture.split_mode", F.lit("section")).alias("split_mode"), F.coalesce("section_pattern", "lecture.section_pattern").alias("section_pattern"),
        F.coalesce("exam_question_pattern", "exam.question_pattern", F.lit(r"^(\d+)．")).alias("exam_question_pattern"), F.coalesce("nav_patterns", F.array(F.lit("直击课堂"), F.lit("本讲导航"))).alias("nav_patterns"), "quantities",
    )


def subject_configs(spark: SparkSession, path: str) -> DataFrame:
    """``settings`` of all JSON files of a path."""
    return settings(spark.read.option("wholetext", "true").text(path), "value")


def quantities(configs: DataFrame, subject: str, search: str = "", *carry: str) -> DataFrame:
    """(carry, name, unit) of a subject's quantities whose name or unit holds the words."""
    each = configs.where(F.col("subject") == subject).select(*carry, F.explode("quantities").alias("name", "unit"))
    return each.where(F.col("name").contains(search) | F.col("unit").contains(search))
