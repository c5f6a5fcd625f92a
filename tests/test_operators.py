import io
import random
import time
import zipfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from galley.operators import compile as K
from galley.operators import corpus, ledger, proposals, repair, reports, segment
from galley.sources import materials
from galley.streaming import ledger as stream


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_units_and_headers(spark):
    df = spark.createDataFrame([(1, "pre\n## A\n## B\nbody\n## C\ntext")], "k long, t string")
    made = segment.units(segment.to_lines(df, "k", "t"), "k", F.col("line").rlike(r"^##\s"))
    assert [(r.unit_no, r.title) for r in made.orderBy("unit_no").collect()] == [(1, "## A"), (2, "## B"), (3, "## C")]
    merged = segment.merge_headers(made, "k").orderBy("unit_no").collect()
    assert [r.content for r in merged] == ["## A\n## B\nbody", "## C\ntext"]


def test_coverage(spark):
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(["a", "", "b", "c", "d"], 1)], "k long, line_no int, line string")
    cuts = spark.createDataFrame([(1, 1, 3), (1, 3, 4)], "k long, start_line int, end_line int")
    assert rows(segment.coverage(lines, cuts, "k")) == [(1, 5, 4, 1, 1)]


def test_manual_units(spark):
    text = "###### 单元开始 ######\na\n###### 单元结束 ######\n###### 单元结束 ######"
    lines = segment.to_lines(spark.createDataFrame([(1, text)], "k long, t string"), "k", "t")
    found = segment.manual_units(lines, "k").collect()
    assert [(r.start_line, r.end_line) for r in found if not r.error] == [(2, 2)] and sum(bool(r.error) for r in found) == 1


def test_marker_verdicts(spark):
    source = "the quick brown fox jumps over the lazy dog"
    body = "the 【1|quick|slow】 brown 【2|fax|fox】 jumps 【3| |x】over 【4|the|the】 lazy 【5|cat|bird】"
    found = reports.markers(spark.createDataFrame([(1, body, source)], "k long, b string, s string"), "k", "b", "s")
    assert [r.verdict for r in found.orderBy("ord").collect()][1:4] == ["restore-new", "empty-orig", "noop"]
    plain = reports.markers(spark.createDataFrame([(1, "the 【1|quick|slow】 brown fox", source)], "k long, b string, s string"), "k", "b", "s")
    assert plain.first().verdict == "ok"


def test_reasons(spark):
    text = "1. first\nmore\n2-3、both\n④ round\n⑤-⑥ range\n9-8) back\n7.\nnothing\n\n10. last\n核验说明：note\n0.5 no number\n---\n11. gone"
    found = reports.reasons(spark.createDataFrame([(1, text)], "k long, t string"), "k", "t").orderBy("num").collect()
    assert [(r.num, r.reason) for r in found] == [(1, "first\nmore"), (2, "both"), (3, "both"), (4, "round"), (5, "range"), (6, "range"), (8, "back"), (9, "back"), (10, "last")]


def test_verify_two_ways(spark):
    source = "para one\n\npara two"
    good = f"总结：轻微问题\n\n{reports.MARKED}\n\npara 【1|one|uno】\n\npara two\n\n{reports.REASONS}\n\n1. because\n"
    bad = good.replace("para two", "para three").replace("1. because", "2. because")
    df = spark.createDataFrame([(1, good, source), (2, bad, source), (3, "", source), (4, good, None)], "k long, r string, s string")
    issues = reports.verify(df, "k", "r", "s")
    codes = {k: sorted(r.code for r in issues.where(F.col("k") == k).collect()) for k in (1, 2, 3, 4)}
    assert codes[1] == []
    assert codes[2] == ["integrity.extra-paragraph", "integrity.missing-paragraph", "locate.unknown", "reason.missing", "reason.orphan"]
    assert "report.empty" in codes[3] and "integrity.no-source" in codes[4]
    assert {r.k: r.ok for r in reports.verdicts(df, issues, "k").collect()} == {1: True, 2: False, 3: False, 4: False}


def test_verify_fields_likeness_and_version_two(spark):
    one = lambda body: f"总结：轻微问题\n\n{reports.MARKED}\n\n{body}\n\n{reports.REASONS}\n\n1. because\n"
    two = lambda body, n=None: f"<!-- x-report-v2 -->\n总结：轻微问题\n\n{reports.MARKED}\n\n<!-- x-body-length:{n or len(body)}:{n or len(body)} -->\n{body}\n<!-- x-body-end -->\n{reports.REASONS}\n1. because\n"
    rows = [
        (1, one("para 【1|one|uno|due】"), "para one"), (2, one("para 【1|one|ＯＮＥ】"), "para one"),
        (3, two("para 【1|a\\|b\\】|a\\【c】 end"), "para a|b】 end"), (4, two("para 【1|a|b】 end", 3), "para a end"), (5, two("para 【1|one|uno】 gone"), "para one end"), (6, two("para 【1|one|b|c】"), "para one"),
        (7, two("cost 【1|$x\\|y$|$z$】 now").replace("\n", "\r\n"), "cost $x|y$ now"),
    ]
    df = spark.createDataFrame(rows, "k long, r string, s string")
    issues = reports.verify(df, "k", "r", "s")
    codes = {k: sorted(r.code for r in issues.where(F.col("k") == k).collect()) for k, *_ in rows}
    assert codes[1] == ["syntax.field-count"] and codes[2] == ["marker.manual-review"] and codes[3] == [] and codes[6] == ["syntax.field-count"]
    assert "integrity.missing-paragraph" in codes[4] and codes[5] == ["integrity.extra-paragraph", "integrity.missing-paragraph", "locate.unknown"]
    assert not {c for c in codes[7] if c != "integrity.unknown-diff"}
    assert {r.k: r.ok for r in reports.verdicts(df, issues, "k").collect()} == {1: False, 2: True, 3: True, 4: False, 5: False, 6: False, 7: True}


def test_splice_restores(spark):
    docs = spark.createDataFrame([(1, "😀ab|cd【x】"), (2, "plain")], "k long, s string")
    fixes = spark.createDataFrame([(1, 1, 3, "A"), (1, 4, 6, "C|")], "k long, start int, `end` int, replacement string")
    made = {r.k: r for r in K.splice(docs, fixes, "k", "s").collect()}
    assert made[1].body == "😀【1|ab|A】|【2|cd|C\\|】【x】" and made[1].restored == "😀ab|cd【x】" and made[2].body == "plain"


def test_revision(spark):
    base = spark.createDataFrame([(1, "a"), (1, "b")], "k long, id string")
    gone = spark.createDataFrame([(1, "a"), (1, "z")], "k long, id string")
    added = spark.createDataFrame([(1, "b"), (1, "c")], "k long, id string")
    assert rows(K.merge_revision(base, gone, added, "k")) == [(1, "b"), (1, "b"), (1, "c")]
    assert rows(K.revision_errors(base, gone, added, "k")) == [(1, "b", "revise.correction-id-duplicate"), (1, "z", "revise.withdrawn")]


def test_recovery_and_cancellation():
    r = ledger.Recovery()
    assert [r.charge("a", "image_schema_fix", "f"), r.charge("a", "image_schema_fix", "f"), r.charge("a", "report_repair", "f")] == ["allowed", "replay", "conflict"]
    assert r.used == {"image_schema_fix": 1, "call_correction": 1}
    assert [r.charge("b", "call_correction", "f"), r.charge("c", "image_schema_fix", "f")] == ["allowed", "exhausted"] and r.used["image_schema_fix"] == 1
    c = ledger.Cancellation(current="a")
    assert [c.cancel("x", "host", "superseded"), c.cancel("a", "host", "superseded"), c.revoke("r", "host", "superseded"), c.revoke("r", "host", "superseded")] == ["not-current", "cancelled", "revoked", "replay"]
    assert c.cancel("a", "user", "user_cancel") == "cancelled" and c.revoke("s", "user", "user_cancel") == "not-revocable" and c.active()[2] == "user"


def test_stream_is_batch(spark, tmp_path):
    data = [(str(i % 3), str(i % 5), i, ["event", "recovery", "cancel", "revoke"][i % 4], str(i % 2), "report_repair", str(i % 3), "host", "superseded") for i in range(60)]
    schema = "task_id string, unit_id string, seq long, kind string, attempt_id string, category string, fingerprint string, initiator string, reason string"
    spark.createDataFrame(data, schema).coalesce(1).write.json(f"{tmp_path}/in")
    q = stream.fold_stream(spark.readStream.schema(schema).json(f"{tmp_path}/in")).writeStream.format("memory").queryName("folded").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("folded")) == rows(stream.fold_stream(spark.read.schema(schema).json(f"{tmp_path}/in")))


def test_nearest_rank_and_accounting(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(1, 11)] + [("b", None)], "g string, v double")
    assert rows(corpus.nearest_rank(df, "v", 0.9, "g")) == [("a", 9.0)]
    assert rows(corpus.nearest_rank(df, "v", 0.9, "g", rule="floor")) == [("a", 10.0)]
    m = spark.createDataFrame([("u",), ("u",), ("v",)], "unit string")
    a = spark.createDataFrame([("u",), ("w",)], "unit string")
    assert rows(corpus.accounting(m, a, a.limit(0), "unit")) == [("u", 2, 1, 0, 1, 0), ("v", 1, 0, 0, 1, 0), ("w", 0, 1, 0, 0, 1)]


def test_greedy_cover(spark):
    df = spark.createDataFrame([("d1", "1", 5, ["a", "b"]), ("d2", "1", 9, ["b", "c", "d"]), ("d3", "1", 1, ["a"])], "doc string, unit string, chars int, classes array<string>")
    assert [r["doc"] for r in corpus.cover(df)] == ["d2", "d1"]


def _zip(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for k, v in members.items():
            z.writestr(k, v)


def test_materials(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    styles = f'<w:styles {w}><w:style w:styleId="H"><w:pPr><w:outlineLvl w:val="1"/></w:pPr></w:style><w:style w:styleId="K"><w:basedOn w:val="H"/></w:style></w:styles>'
    p = lambda t, s="": f'<w:p><w:pPr>{s}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    doc = f'<w:document {w}><w:body>{p("Title", chr(60) + "w:pStyle w:val=" + chr(34) + "K" + chr(34) + "/>")}{p("text")}<w:tbl><w:tr><w:tc>{p("a|b")}</w:tc><w:tc>{p("c")}</w:tc></w:tr><w:tr><w:tc>{p("d")}</w:tc><w:tc>{p("e")}</w:tc></w:tr></w:tbl></w:body></w:document>'
    _zip(tmp_path / "a.docx", {"word/document.xml": doc, "word/styles.xml": styles})
    _zip(tmp_path / "b.idml", {"Stories/s1.xml": '<r><Story Self="u1"><ParagraphStyleRange AppliedParagraphStyle="ParagraphStyle/标题1"><Content>头</Content></ParagraphStyleRange><ParagraphStyleRange AppliedParagraphStyle="x"><Content>12</Content><Br/><Content>正文</Content></ParagraphStyleRange></Story></r>', "Spreads/p1.xml": '<r><TextFrame ParentStory="u1"/></r>'})
    (tmp_path / "c.md").write_bytes("# x\n\xff".encode("latin-1"))
    (tmp_path / "d.doc").write_bytes(b"old")
    (tmp_path / "e.docx").write_bytes(b"broken")
    found = {r.path.rsplit("/", 1)[-1]: r for r in materials.materials(spark, str(tmp_path)).collect()}
    assert found["a.docx"].markdown == "## Title\n\ntext\n\n| a\\|b | c |\n| --- | --- |\n| d | e |\n" and [b.kind for b in found["a.docx"].blocks] == ["heading", "paragraph", "table"]
    assert found["b.idml"].markdown == "# b\n\n#### 头\n\n12\n正文\n" and [(b.kind, b.level, b.start_line, b.end_line) for b in found["b.idml"].blocks] == [("heading", 1, 1, 1), ("heading", 4, 3, 3), ("paragraph", None, 5, 6)] and found["c.md"].warnings and found["d.doc"].error and found["e.docx"].error


def test_archive_limits():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", b"0" * (33 << 20))
    with pytest.raises(materials.SourceError):
        materials.open_archive(buffer.getvalue())


def test_entry(spark):
    made = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(made) and len(made) > 40
    assert __spark_entry__.entry(spark).count() > 0


def test_compiled_rows_stay_rows(spark):
    """Repeated and null identifiers, corrections of unknown units, units without any, rows that come in any order."""
    units = spark.createDataFrame([(1, "a b c d"), (2, "none"), (None, "a b")], "k long, s string")
    kind = "k long, id string, old_text string, new_text string, reason string, severity string, occurrence int"
    base = spark.createDataFrame([(1, "x", "a", "A", "r", "轻微问题", None), (1, "y", "b", "B", "r", "严重错误", None), (9, "z", "a", "A", "r", None, None)], kind)
    added = spark.createDataFrame([(1, None, "c", "C", "r", None, 1), (1, None, "c d", "D", "r", None, None), (1, "y", "d", "d", "r", None, None), (1, "w", "q", "Q", "r", None, None)], kind)
    gone = spark.createDataFrame([(1, "x"), (1, "nothing"), (1, None)], "k long, id string")
    found = sorted(((r.id, r.original, r.error) for r in proposals.compiled(units, base, gone, added, "k", "s").collect()), key=str)
    want = [("y", "b", "revise.correction-id-duplicate"), (None, "c", "revise.correction-id"), (None, "c d", "revise.correction-id"), ("y", "d", "revise.correction-id-duplicate"), ("w", None, "anchor.not-found"), ("nothing", None, "revise.withdrawn")]
    assert found == sorted(want, key=str)
    none = gone.where("false")
    made = {r.k: r for r in proposals.rendered(units, base, none, added.where("false"), "k", "s").collect()}
    assert made[1].error is None and made[1].summary == "严重错误" and made[1].restored and "【1|a|A】 【2|b|B】 c d" in made[1].text
    assert made[2].summary == "无问题" and made[2].restored and made[2].error is None and None in made and 9 not in made


def test_alignment_against_a_table():
    def longest(a, b):
        held = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                held[i + 1][j + 1] = held[i][j] + 1 if x == y else max(held[i][j + 1], held[i + 1][j])
        return held[-1][-1]

    rng = random.Random(4)
    for _ in range(600):
        k = rng.choice([1, 2, 3, 9])
        a, b = ([str(rng.randrange(k)) for _ in range(rng.randrange(16))] for _ in range(2))
        left, right, pairs = reports.align(a, b)
        assert len(pairs) == longest(a, b) and all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))
        assert sorted(left + [i for i, _ in pairs]) == list(range(len(a))) and sorted(right + [j for _, j in pairs]) == list(range(len(b)))
    began = time.monotonic()
    same = ["first", *["equal"] * 20000, "last"]
    assert len(reports.align(same, ["other", *["equal"] * 20000, "end"])[2]) == 20000 and time.monotonic() - began < 10


def test_repair_codes(spark):
    head, tail = f"轻微问题\n{reports.MARKED}\n", f"\n{reports.REASONS}\n1. a\n2. b\n"
    rows = [
        (1, f"{head}x 【1|a|A】 【2|b|B】 y{tail}", "x a b y"), (2, f"{head}【2|b|B】 【1|a|A】{tail}", "a b"), (3, f"{head}【1|ab|A】 【2|b c|B】{tail}", "ab c"), (4, f"{head}【1|a|A】 【1|b|B】{tail}", "a b"), (5, f"{head}【1||A】 【2|b|B】{tail}", "a b"),
        (6, "no sections", "a"), (7, f"{head}x{tail}", None), (8, None, "a"), (9, f"<!-- x-report-v2 -->\n{head}x{tail}", "a"), (10, f"{head}【1|a|A】 lost 【2|b|B】{tail}", "a kept b"),
    ]
    found = {r.k: r for r in repair.candidates(spark.createDataFrame(rows, "k int, t string, s string"), "k", "t", "s").collect()}
    assert found[1].ok and found[10].ok and "【1|a|A】 kept 【2|b|B】" in found[10].repaired and "+" in found[10].diff
    assert found[2].codes == ["repair.marker-order"] and "repair.marker-overlap" in found[3].codes and "repair.duplicate-number" in found[4].codes and "repair.empty-original" in found[5].codes
    assert found[6].codes == ["report.marked-section", "report.reasons-section"] and found[7].codes == ["repair.source-missing"] and found[9].codes == ["repair.v2-not-supported"]
    assert all(not found[k].ok and found[k].repaired is None and found[k].diff is None for k in (2, 3, 4, 5, 6, 7, 8, 9))


def test_verification_is_worked_out_once_a_report(spark):
    from galley.plans import catalogue

    plans = {n: catalogue.queries()[n](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString() for n in ("report_issues", "verify_reports")}
    assert not [x for x in plans["report_issues"].splitlines() if ("Join" in x or "Filter" in x) and "regexp_extract_all" in x]
    assert plans["verify_reports"].count("MapInArrow") == 1 and plans["verify_reports"].count("Relation [") == 2
    assert all("RepartitionByExpression" in p for p in plans.values())


def test_likeness_of_fields_of_all_kinds(spark):
    pairs = [[("a B", "Ab"), ("ab", "a b")], [("ab", "abc")], [], None, [("Ａb", "aB"), ("x", "y")]]
    rows = [(i, None if p is None else [{"original": a, "replacement": b} for a, b in p]) for i, p in enumerate(pairs)]
    df = spark.createDataFrame(rows, "k int, m array<struct<original: string, replacement: string>>").coalesce(1)
    found = df.withColumn("f", reports.alike(F.col("m"))).select("k", reports._same(F.col("f")).alias("s")).orderBy("k").collect()
    assert [r.s for r in found][:3] + [found[4].s] == [[True, True], [False], [], [True, False]]


def test_reports_that_restore_their_source_are_not_cut_into_paragraphs(spark):
    df = spark.createDataFrame([(1, "a\n\nb", "a\n\nb"), (2, "a\n\nb", "a\n\nc\n\nd"), (3, None, "a"), (4, "a b", "ab"), (5, "a", None)], "k int, s string, r string")
    found = sorted(map(tuple, reports.integrity(df, "k", "s", "r").collect()))
    assert found == [(1, 0, 0, 0), (2, 1, 2, 0), (3, None, None, None), (4, 0, 0, 0), (5, 1, 0, 0)]


def test_reports_of_one_file_are_repaired_and_parsed_by_all_tasks(spark):
    df = spark.createDataFrame([(1, "no report", "a\n\nb")], "k int, t string, s string")
    for made in (repair.candidates(df, "k", "t", "s"), reports.parse(df, "k", "t")):
        assert made._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
    assert repair.candidates(df, "k", "t", "s").first().codes == ["report.marked-section", "report.reasons-section"]
