import io
import json
import zipfile
from pathlib import Path
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from galley.sources import delivery, indesign, materials, omml

UNITS = "paper string, unit_no int, unit_name string, body string, reasons array<struct<num: int, reason: string>>"
ROWS = [
    ("p1", 2, "第2题", "line one\nsecond 【1|wrng|wrong】 end\n\nlast 【2||added】", [(1, "spelling"), (2, "missing <word>")]),
    ("p1", 1, "第1题", "a & b < c 【1|two\nlines|one】", [(1, None)]),
    ("p2", None, "第9题", None, None),
    ("p3", 1, "bad \x00 name", "tab\there \x0b 【7|日本🙂|x】", []),
]


def test_word_files_read_back(spark, tmp_path):
    units = spark.createDataFrame(ROWS, UNITS)
    files = delivery.word_files(units, "paper").cache()
    made = {r.paper: bytes(r.content) for r in files.collect()}
    assert set(made) == {"p1", "p2", "p3"} and files.where("error is not null").isEmpty()
    text, blocks, _ = materials.read_docx(made["p1"])
    assert [b["title"] for b in blocks if b["kind"] == "heading"] == ["第1题", "第2题"]
    assert "a & b < c two\nlines" in text and "second wrng end" in text and "【" not in text
    assert "tab\there  日本🙂" in materials.read_docx(made["p3"])[0]

    audit = {(r.paper, r.unit_name): (r.n_anchors, r.n_fallbacks, r.n_unpaired) for r in delivery.word_audit(files, "paper").collect()}
    assert audit == {("p1", "第1题"): (1, 0, 0), ("p1", "第2题"): (1, 1, 0), ("p2", "第9题"): (0, 0, 0), ("p3", "bad  name"): (1, 0, 0)}

    for paper, content in made.items():
        (tmp_path / f"{paper}.docx").write_bytes(content)
    held = sorted((Path(r.path).stem, r.anchor, r.text) for r in materials.comments(spark, str(tmp_path)).collect())
    assert ("p1", "wrng", "1. wrng → wrongspelling") in held and ("p3", "日本🙂", "7. 日本🙂 → x") in held
    assert next(t for p, a, t in held if a == "第2题") == "2.  → addedmissing <word>"


def test_equal_input_gives_equal_bytes():
    unit = [{"unit_name": "u", "body": "【1|a|b】", "reasons": [{"num": 1, "reason": "r"}]}]
    assert delivery.make_docx(unit) == delivery.make_docx(unit)


def test_escaped_markers():
    content = delivery.make_docx([{"unit_name": "u", "body": r"x 【1|a\|b\】c|d】 y", "reasons": None}], escaped=True)
    assert "x a|b】c y" in materials.read_docx(content)[0]


def test_reconcile_never_nets(spark):
    marks = spark.createDataFrame([("a", 3), ("b", 1), ("c", 2)], "paper string, n_markers long")
    audit = spark.createDataFrame([("a", 0, 1, 1, 0), ("b", 0, 2, 0, 0), ("d", 0, 0, 0, 1)], "paper string, unit_ord int, n_anchors long, n_fallbacks long, n_unpaired long")
    found = {r.paper: (r.missing, r.over, r.ok) for r in delivery.reconcile(marks, audit, "paper").collect()}
    assert found == {"a": (1, 0, False), "b": (0, 1, False), "c": (2, 0, False), "d": (0, 0, False)}


def test_damaged_anchors_are_seen(spark):
    import io

    content = delivery.make_docx([{"unit_name": "u", "body": "【1|a|b】【2|c|d】", "reasons": None}])
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out := io.BytesIO(), "w") as w:
        for n in z.namelist():
            w.writestr(n, z.read(n).replace(b'<w:commentRangeEnd w:id="1"/>', b"") if n == "word/document.xml" else z.read(n))
    files = spark.createDataFrame([("p", bytearray(out.getvalue()))], "paper string, content binary")
    (row,) = delivery.word_audit(files, "paper").collect()
    assert (row.n_anchors, row.n_unpaired) == (1, 1)


def test_publish(spark, tmp_path):
    rows = [("a/b", bytearray(b"one"), True), ("c", bytearray(b"two"), False), ("d", None, True)]
    files = spark.createDataFrame(rows, "name string, content binary, ok boolean")
    (tmp_path / "a_b.docx").write_bytes(b"before")
    (tmp_path / "c.docx").write_bytes(b"good")
    assert len(delivery.publish(files, f"file://{tmp_path}")) == 2
    assert (tmp_path / "a_b.docx").read_bytes() == b"one" and (tmp_path / "c.failed.docx").read_bytes() == b"two" and (tmp_path / "c.docx").read_bytes() == b"good"
    assert not list(tmp_path.glob("*.tmp"))


def test_tables(spark, tmp_path):
    units = spark.createDataFrame([("m", 1, "x"), ("m", 2, "y"), ("n", 1, "z")], "material_id string, unit_no int, body string")
    delivery.write_units(units, f"{tmp_path}/u")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/u").select("material_id", "unit_no", "body").collect())) == [("m", 1, "x"), ("m", 2, "y"), ("n", 1, "z")]
    marked = delivery.supersede(units, units.where("unit_no = 1"), "run7", "material_id", "unit_no").collect()
    assert {(r.body, r.status, r.superseded_by) for r in marked} == {("x", "current", None), ("y", "superseded", "run7"), ("z", "current", None)}
    one = spark.range(1).select(delivery.report_json(F.lit("无问题"), F.array(F.struct(F.lit(1).alias("num"), F.lit(None).cast("string").alias("reason")))).alias("j")).first()
    assert json.loads(one.j) == {"summary": "无问题", "items": [{"num": 1, "reason": None}]}


def test_comments_stand_in_the_markdown():
    content = delivery.make_docx([{"unit_name": "u", "body": "x 【1|a|b】 y", "reasons": [{"num": 1, "reason": "r"}]}])
    assert "x a<批注 id=1><原>a</原><改>1. a → br</改></批注> y" in materials.read_docx(content, True)[0]
    assert "x a y" in materials.read_docx(content)[0]


def _idml(spreads, texts, designmap=None):
    with zipfile.ZipFile(out := io.BytesIO(), "w") as z:
        for name, spread in spreads.items():
            z.writestr(f"Spreads/{name}.xml", f"<R>{spread}</R>")
        for key, paragraphs in texts.items():
            ranges = "".join(f'<ParagraphStyleRange AppliedParagraphStyle="ParagraphStyle/{style}"><CharacterStyleRange><Content>{text}</Content></CharacterStyleRange></ParagraphStyleRange>' for style, text in paragraphs)
            z.writestr(f"Stories/{key}.xml", f'<R><Story Self="{key}">{ranges}</Story></R>')
        if designmap:
            z.writestr("designmap.xml", designmap)
    return out.getvalue()


def _frame(key, x, y, own="", previous="n", matrix="1 0 0 1"):
    return f'<TextFrame Self="{own}" ParentStory="{key}" PreviousTextFrame="{previous}" ItemTransform="{matrix} {x} {y}"/>'


def _page(name, x, matrix="1 0 0 1", y=0):
    return f'<Page Name="{name}" GeometricBounds="0 0 600 500" ItemTransform="{matrix} {x} {y}"/>'


def _markdown(spark, files):
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary")
    return {r.path: [x for x in (r.markdown or "").split("\n") if x] for r in materials.parsed(rows).collect()}


def test_idml_order(spark):
    texts = {"s1": [("正文", "second row")], "s2": [("旁注", "margin note")], "s3": [("正文", "right body")], "s4": [("正文", "padded page")], "s5": [("正文", "unplaced")]}
    flat = _page("7", 0) + _page("08", 500) + _frame("s1", 10, 200) + _frame("s2", 10, 20) + _frame("s3", 300, 50) + _frame("s4", 510, 300)
    # the same places by groups: turned by 90 degrees about a point, twice moved, scaled by two
    turned = _page("7", 0) + _page("08", 500) + f'<Group ItemTransform="0 1 -1 0 210 190"><Group>{_frame("s1", 10, 200)}</Group></Group>' + f'<Group ItemTransform="1 0 0 1 4 5"><Group ItemTransform="1 0 0 1 5 5">{_frame("s2", 1, 10)}</Group></Group>' + f'<Group ItemTransform="2 0 0 2 0 0">{_frame("s3", 150, 25)}{_frame("s4", 255, 150)}</Group>'
    want = ["# a", "padded page", "right body", "> 💡 margin note", "second row", "unplaced"]
    found = _markdown(spark, {"a.idml": _idml({"x": flat}, texts), "b.idml": _idml({"x": f'<Spread ItemTransform="0 -1 1 0 3000 9">{turned}</Spread>'}, texts), "c.idml": b"none"})
    assert found["a.idml"] == want and found["b.idml"] == ["# b", *want[1:]] and found["c.idml"] == []


def test_idml_pages(spark):
    """A page upside down, the halves of a spread for what is on no page, a frame that follows another, spreads as the map lists them."""
    texts = {k: [("x", k)] for k in ("top", "bottom", "left", "right", "beside", "chained", "later")}
    first = _page("1", 0) + _page("2", 1000, "-1 0 0 -1", 600) + _frame("top", 990, 590) + _frame("bottom", 600, 10) + _frame("left", 20, -80) + _frame("right", 700, 900) + _frame("chained", 10, 300, "f2", "f1") + _frame("chained", 900, 10, "f1")
    second = _page("3", 0) + _frame("beside", -50, 10) + _frame("later", 10, 10)
    data = _idml({"a": second, "b": first}, texts, '<D><Spread src="Spreads/b.xml"/><Spread src="Spreads/a.xml"/></D>')
    parts = indesign.parts(spark.createDataFrame([("k.idml", bytearray(data))], "path string, content binary"))
    assert [(r.story, r.page) for r in indesign.reading_order(parts).orderBy("place").collect()] == [("left", "1"), ("right", "2"), ("top", "2"), ("chained", "2"), ("bottom", "2"), ("later", "3"), ("beside", None)]
    spots = {(r.story, r.self): (r.page, r.x, r.y, r.spread) for r in indesign.frames(parts).collect()}
    assert spots["top", ""] == ("2", 10.0, 10.0, 0) and spots["beside", ""] == (None, None, None, 1) and spots["chained", "f1"] == ("2", 100.0, 590.0, 0)


def test_idml_paragraphs(spark):
    paragraphs = [("x", "ends here。"), ("x", "12"), ("x", "no end"), ("x", "13"), ("x", "14．item"), ("x", "15"), ("x", "2026"), ("x", "①②"), ("NormalParagraphStyle", "600字"), ("x", "600字"), ("第一讲", "top"), ("（一）导", "second"), ("例文标题", "third"), ("Heading 5", "fifth"), ("出处", "source"), ("表格宋", "cell"), ("小贴士", "hint")]
    found = _markdown(spark, {"a.idml": _idml({"x": _page("1", 0) + _frame("s", 1, 1)}, {"s": paragraphs})})["a.idml"]
    assert found == ["# a", "ends here。", "12", "no end", "13", "14．item", "2026", "600字", "## top", "### second", "#### third", "##### fifth", "> source", "`cell`", "> 💡 hint"]


FORMULAS = [
    (r"\frac{a}{b}", None), (r"\sqrt[3]{x+1}", None), (r"x_{1}^{2}", None), (r"\sum_{i=1}^{n}{i^{2}}", None), (r"\sum_{i=1}^n i", r"\sum_{i=1}^{n}{i}"), (r"\begin{cases}x=1 \\ y=2\end{cases}", None), (r"\begin{pmatrix}a & b\end{pmatrix}", r"\left( \begin{matrix}a & b\end{matrix} \right)"),
    (r"\lim_{x \to 0}{\frac{\sin{x}}{x}}", r"\lim_{x\rightarrow0}{\frac{\sin{x}}{x}}"), (r"\log_{2}{x}", None), (r"\left. x \right|", None), (r"\text{速度 v}", None), (r"\mathrm{kg}", None), (r"f'(x)", r"f^{\prime}(x)"), (r"\alpha x", None), (r"\overline{AB}\leq\vec{c}", None), (r"\underset{n}{A}", None),
]


@pytest.mark.parametrize(("latex", "again"), FORMULAS)
def test_formulas_go_to_word_and_back(latex, again):
    content = delivery.make_docx([{"unit_name": "u", "body": f"so ${latex}$ here", "reasons": []}])
    assert f"so ${again or latex}$ here" in materials.read_docx(content)[0]


def test_formulas_without_an_object():
    for latex in (r"\nothing{x}", "x_{1}_{2}", "{", r"\begin{matrix}a", r"\left( x", "{" * 5000):
        assert omml.from_latex(latex) is None
    body = "a $\\nothing$ b $$x^2$$ c 【1|$y_1$|$z$】"
    content = delivery.make_docx([{"unit_name": "u", "body": body, "reasons": [{"num": 1, "reason": "r"}]}])
    told = materials.read_docx(content, True)[0]
    assert "a $\\nothing$ b $$x^{2}$$ c $y_{1}$<批注 id=1><原>$y_{1}$</原><改>1. $y_{1}$ → $z$r</改></批注>" in told
    deep = "<m:r><m:t>x</m:t></m:r>"
    for _ in range(3000):
        deep = f"<m:e>{deep}</m:e>"
    with zipfile.ZipFile(out := io.BytesIO(), "w") as z:
        z.writestr("word/document.xml", f"<w:document {delivery._NS}><w:body><w:p><w:r><w:t>t</w:t></w:r><m:oMath>{deep}</m:oMath></w:p></w:body></w:document>")
    assert materials.read_docx(out.getvalue())[2] == ["a formula object is empty or nested too deep"]


def test_formula_objects_of_other_writers():
    r = lambda t, p="": f"<m:r>{p}<m:t>{t}</m:t></m:r>"
    cases = {
        f'<m:f><m:fPr><m:type m:val="lin"/></m:fPr><m:num>{r("a")}</m:num><m:den>{r("b")}</m:den></m:f>': "a/b",
        f"<m:sPre><m:sub>{r('6')}</m:sub><m:sup>{r('12')}</m:sup><m:e>{r('C')}</m:e></m:sPre>": "{}_{6}^{12}C",
        f"<m:nary><m:sub/><m:sup/><m:e>{r('f')}</m:e></m:nary>": r"\int{f}",
        f'<m:d><m:dPr><m:begChr m:val="["/><m:endChr m:val=")"/><m:sepChr m:val=","/></m:dPr><m:e>{r("0")}</m:e><m:e>{r("1")}</m:e></m:d>': r"\left[ 0,1 \right)",
        f"<m:func><m:fName><m:limLow><m:e>{r('lim')}</m:e><m:lim>{r('n→∞')}</m:lim></m:limLow></m:fName><m:e>{r('a')}</m:e></m:func>": r"\lim_{n\rightarrow\infty}{a}",
        f'<m:groupChr><m:groupChrPr><m:pos m:val="top"/></m:groupChrPr><m:e>{r("a")}</m:e></m:groupChr>': r"\overbrace{a}",
        f"<m:box><m:e>{r('5%')}</m:e></m:box>": r"5\%", r("αb"): r"\alpha b", r("s", '<m:rPr><m:sty m:val="p"/></m:rPr>'): r"\mathrm{s}",
    }
    for xml, want in cases.items():
        assert omml.to_latex(ElementTree.fromstring(f'<m:oMath xmlns:m="{omml.NAMESPACE}">{xml}</m:oMath>')) == want


def test_names_that_become_equal(spark, tmp_path):
    rows = [("a/b", b"1", True), ("a:b", b"2", True), ("a/b", b"1", False), ("c", None, True)]
    df = spark.createDataFrame(rows, "name string, content binary, ok boolean")
    out = delivery.publish(df, str(tmp_path))
    assert len(out) == len(set(out)) == 3 and sorted(p.read_bytes() for p in tmp_path.glob("*.docx")) == [b"1", b"1", b"2"]
    delivery.publish(spark.createDataFrame([("c", b"old", True)], df.schema), str(tmp_path))
    delivery.publish(spark.createDataFrame([("c", b"new", True)], df.schema), str(tmp_path))
    assert (tmp_path / "c.docx").read_bytes() == b"new" and not list(tmp_path.glob(".*.tmp"))


def test_files_are_read_once_by_all_tasks(spark):
    units = spark.createDataFrame([(i, 1, f"u{i}", f"body {i}") for i in range(5)], "id long, unit_no int, unit_name string, body string").coalesce(1)
    made = delivery.word_files(units.withColumn("reasons", F.lit(None).cast("array<struct<num: int, reason: string>>")), "id")
    assert made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    read = materials.parsed(made.select(F.concat("id", F.lit(".docx")).alias("path"), "content"))
    assert "MapInArrow" not in read._jdf.queryExecution().optimizedPlan().toString()  # archives and others were read each by its own pass
    assert sorted(r["markdown"].split("\n")[0] for r in read.collect()) == [f"# u{i}" for i in range(5)]
