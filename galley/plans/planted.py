"""Queries of text rules: pieces with a known outcome, planted at many places of every document's letters.

The SQL puts the known outcomes in the same places, so that it knows nothing of how a rule works.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import latex as L
from ..functions import mathtext as M
from ..functions import reporttext as R
from ..functions import text as X
from ..operators import locate, reports
from .catalogue import query

#: The letters of a whole text in stretches; no rule has anything to say of them, so that all that changes is a piece.
STRETCH = 200
_LETTERS = f"regexp_extract_all('x' || regexp_replace(text, '[^a-z]+', '', 'g'), '.{{1,{STRETCH}}}')"


def _letters() -> Column:
    return F.regexp_extract_all(F.concat(F.lit("x"), F.regexp_replace("text", "[^a-z]+", "")), F.lit(f".{{1,{STRETCH}}}"), F.lit(0))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def planted(name: str, fn: Callable[[Column], Column], pieces: list[tuple[str, str]], sep: str = " ", many: bool = True) -> None:
    """A query of a text rule over whole texts: a piece (before, after) behind each stretch of letters but the last, or, if not ``many``, one in the middle.

    A text of one stretch has a piece behind it and its letters once more.
    """

    def run(spark: SparkSession, d: str) -> DataFrame:
        made = _docs(spark, d).withColumn("w", _letters()).withColumn("w", F.when(F.size("w") > 1, F.col("w")).otherwise(F.concat("w", "w")))
        values = F.array(*[F.lit(p) for p, _ in pieces])
        here = (lambda i: i < F.size("w") - 1) if many else (lambda i: i == F.floor(F.size("w") / 2) - 1)
        put = lambda i: F.when(here(i), F.concat(F.lit(sep), F.element_at(values, ((F.col("doc_id") + i) % len(pieces) + 1).cast("int")), F.lit(sep))).otherwise("")
        out = fn(F.array_join(F.transform("w", lambda x, i: F.concat(x, put(i))), ""))
        return made.withColumn("o", out).select("doc_id", F.sha2("o", 256).alias("digest"), F.length("o").cast("long").alias("n"))

    run.__name__ = name
    listed = "[" + ", ".join(_quoted(after) for _, after in pieces) + "]"
    where = "i < len(w)" if many else "i = len(w) // 2"
    put = f"list_transform(w, lambda x, i: x || case when {where} then {_quoted(sep)} || ({listed})[(doc_id + i - 1) % {len(pieces)} + 1] || {_quoted(sep)} else '' end)"
    query(f"select doc_id, sha256(o) as digest, length(o) as n from (select doc_id, array_to_string({put}, '') as o from (select doc_id, case when len(w) > 1 then w else list_concat(w, w) end as w from (select doc_id, {_LETTERS} as w from (select doc_id, coalesce(text, '') as text from documents))))")(run)


def judged(name: str, fn: Callable[[Column], Column], pieces: list[tuple[str, object]]) -> None:
    """A query of a function of one short text: each document has one of the pieces, and the known value."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        piece = F.element_at(F.array(*[F.lit(p) for p, _ in pieces]), (F.col("doc_id") % len(pieces) + 1).cast("int"))
        return _docs(spark, d).withColumn("t", piece).select("doc_id", fn(F.col("t")).alias("value"))

    run.__name__ = name
    values = "[" + ", ".join(_quoted(v) if isinstance(v, str) else "null" if v is None else str(v).lower() for _, v in pieces) + "]"
    query(f"select doc_id, ({values})[doc_id % {len(pieces)} + 1] as value from documents")(run)


# text rules of mathtext
planted("latex_escapes", M.each(M.fix_latex_escapes), [
    (r"a\_b", "a_b"), (r"\\alpha", r"\alpha"), (r"\$x\_1\$", "$x_1$"), (r"50\% \# \&", "50% # &"), (r"\[note\]", "[note]"), (r"\[x\^2\]", r"\[x^2\]"),
    (r"\left\(a\right\)", r"\left(a\right)"), (r"$\{a\}\%$", r"${a}\%$"), (r"\\\\\_", "_"), (r"a \\5 \\\\5", r"a \\5 \\5"), (r"\<b\> it\'s", "<b> it's"), ("$$\nx\\_1\n$$", "$$\nx_1\n$$"),
], sep="\n")
planted("table_remains", M.each(M.clean_tables), [
    ("k\n+---+---+", "k"), ("| a | b |", "a  b"), ("答案:--\nAB C", "答案: AB C"), ("$|x|$ | y", "$|x|$  y"), ("k\n1\\. +---+", "k"), ("....", "...."),
    ("k\n\n\n\nm", "k\n\nm"), ("答案: C\nnot", "答案: C\nnot"), ("k\n|---|:--|", "k"), ("  in  ", "in"), ("k\n$$\na | b\n$$", "k\n$$\na | b\n$$"),
], sep="\n")
planted("intent_notes", M.each(lambda t: M.drop_intent(t, (r"例\d+", "变式"))), [
    ("【出题意图】why\nmore\n**例1** t", "**例1** t"), ("a【出题意图】b", "a【出题意图】b"), ("【出题意图】x **例2** y", "**例2** y"), ("k\n\n\n\nm", "k\n\nm"), ("【出题意图】x\n【出题意图】y\n**变式** z", "**变式** z"),
], sep="\n")
_GAP = " " * 34
planted("floating_images", M.each(M.lift_images), [
    ("A. ![test](u.png){width=1} one\nB. two", f"![](u.png){{width=1}}\nA.{_GAP}one\nB. two"), ("A. ![test](u.png)\nB. ![](v.png)", "A. ![test](u.png)\nB. ![](v.png)"), ("A.![test](u.png)", f"![](u.png)\nA.{_GAP}"),
    (" A. ![test](u.png)", " A. ![test](u.png)"), ("A. ![x](u.png) one", "A. ![x](u.png) one"), ("A. ![test](u.png) a\n" + "-\n" * 9 + "C. ![](v.png)", f"![](u.png)\nA.{_GAP}a\n" + "-\n" * 9 + "C. ![](v.png)"),
], sep="\n", many=False)
planted("decor_images", M.each(M.drop_decor), [
    ('![](a.png){width="0.2in" height="0.3in"}', ""), ('![test](a.png){width="0.39in" height="0.1in"}', ""), ('![](a.png){width="0.5in" height="0.1in"}', '![](a.png){width="0.5in" height="0.1in"}'), ('![x](a.png){width="0.2in" height="0.3in"}', '![x](a.png){width="0.2in" height="0.3in"}'), ("![](a.png)", "![](a.png)"),
])
planted("lecture_cleaning", M.lecture_clean((r"例\d+",)), [
    ("【出题意图】why\n**例1** a\\_b     c", "**例1** a_b  c"), ("| a\\% |", "a%"), ("k\n+----+\n\\[note\\]", "k\n[note]"), ('k ![](a.png){width="0.1in" height="0.1in"} m', "k  m"),
], sep="\n")
planted("comment_anomaly", X.drop_comment_anomaly, [("a`<!-- -->`{=html}b", "ab"), ("`<!-- -->`", "`<!-- -->`"), ("plain", "plain")])
planted("carets_and_tildes", X.caret_tilde, [("H~2~O", "H<下标>2</下标>O"), ("x^2^", "x<上标>2</上标>"), (r"a\~b", "a~b"), (r"\^2\^", "^2^"), ("~a b~", "~a b~"), ("^^", "^^")])
planted("displays_inline", M.each(M.display_to_inline), [("$$x$$", "$x$"), ("$$a\nb$$", "$$a\nb$$"), ("$x$", "$x$"), ("$$x$$ $$y$$", "$x$ $y$")])
planted("exam_post_process", R.post_process, [("$$x^2^$$`<!-- -->`{=html}", "$x<上标>2</上标>$"), ("H~2~O", "H<下标>2</下标>O"), ("$$a\nb$$", "$$a\nb$$"), ("plain", "plain")])
planted("masked_code", M.each(M.mask_code), [("`ab`", "    "), ("``a`b``", "       "), ("\n```\nab\n```\n", "\n   \n  \n   \n"), ("a`b", "a`b"), ("plain", "plain")], many=False)

# rules of reports on their way to Word
planted("latex_for_word", M.each(L.for_word), [
    (r"\[x\]", "$x$"), (r"\\[a\\b\\]", r"$a\b$"), (r"\$y\$", "$y$"), (r"${\rm m}$", r"$\mathrm{m}$"), (r"$\rm{kg}$", r"$\mathrm{kg}$"), ("$200\\Omega $", "$200\\Omega$"), ("$ x$", "$x$"), ("cost $5", "cost \\$5"), ("plain", "plain"),
], sep="\n")
planted("reference_preamble", R.strip_preamble, [("## 前置参考 a\nold\n---\nnew", "new"), ("### 权威原文 a\nk", "k"), ("⚠️ careful\nk", "k"), ("编号：3\nk", "k"), ("内容：\nk", "k"), ("plain", "plain")], sep="\n", many=False)
judged("wrapping_fences", R.strip_fence, [("```markdown\na\nb\n```", "a\nb"), ("~~~\na\n~~~\n", "a"), ("a\n```\nb\n```\nc", "a\n```\nb\n```\nc"), ("```\na", "a"), ("plain", "plain")])
judged("audit_bodies", R.audit_body, [("### 标记原文\n编号：1\n内容：x\ntext\n", "text"), ("```\n### 标记原文\nk\n```", "k"), ("## 前置参考\nold\n---\nnew", "new"), ("plain\n\nmore", "plain\n\nmore")])
judged("trimmed_reasons", R.trim_reasons, [("1. a\n---\n2. b", "1. a"), ("1. a\n## 📋 c", "1. a"), ("1. a \n### e\nf", "1. a"), ("1. a\n## other\n", "1. a\n## other")])
planted("masked_fields", R.mask_fields, [("【1|ab|c】", "【1|XX|X】"), ("【12|a\\】b|\\|】", "【12|XXXX|XX】"), ("【x|a|b】", "【x|a|b】"), ("plain", "plain"), ("【3||】", "【3||】")])
planted("dash_grids", M.each(R.dash_tables), [
    ("----------\na  bc\n对  d\n----------", "+----+----+\n| a  | bc |\n+====+====+\n| 对 | d  |\n+----+----+"), ("---\na  b\n---", "---\na  b\n---"), ("- item", "- item"), ("------------\nonly", "------------\nonly"),
], sep="\n", many=False)
planted("anchored_grids", M.each(lambda t: R.pipe_tables(t, "@@")), [
    ("| a | @@bc |\n|---|---|\n| 对 | d |", "+----+------+\n| a  | @@bc |\n+----+------+\n| 对 | d    |\n+----+------+"), ("| a | b |\n|---|---|\n| c | d |", "| a | b |\n|---|---|\n| c | d |"), ("@@ no table", "@@ no table"), ("| a \\| b@@ |", "+----------+\n| a \\| b@@ |\n+----------+"),
], sep="\n")
planted("skipped_formulas", M.each(lambda t: R.textify_skipped(t, {1: ("x^2", "x^3"), 2: ("y", "")})), [
    ("$a SKIPANCH1Z b$", "==\\$a x\\^2 b\\$（标记 1 修改意见：x\\^2→x\\^3）=="), ("$SKIPANCH2Z$", "==\\$y\\$（标记 2 修改意见：删去「y」）=="), ("$a$", "$a$"), ("SKIPANCH1Z", "SKIPANCH1Z"), ("$SKIPANCH1Z+SKIPANCH2Z$", "==\\$x\\^2+y\\$（标记 1 修改意见：x\\^2→x\\^3）（标记 2 修改意见：删去「y」）=="),
])
planted("inserted_comments", M.each(lambda t: R.insert_comments(t, [(1, "the “key”", "c"), (2, "the \"key\"", "d"), (3, "GONE!", "e")])[0]), [
    ('see the  "key" now', 'see the  "key"<批注 id=2><原>the "key"</原><改>d</改></批注><批注 id=1><原>the “key”</原><改>c</改></批注> now'), ("the“key” and the ‘key’", 'the“key”<批注 id=2><原>the "key"</原><改>d</改></批注><批注 id=1><原>the “key”</原><改>c</改></批注> and the ‘key’'), ("the “ke", "the “ke"), ("other", "other"),
], many=False)
planted("tagged_runs", M.each(lambda t: R.tag_runs(t, [("emphasis", "Key"), ("underline", "Key word"), ("emphasis", "重"), ("strike", "Z")])), [
    ("a Key b", "a <着重>Key</着重> b"), ("重 Z", "<着重>重</着重> Z"), ("Key word", "<着重>Key</着重> word"), ("plain", "plain"), ("Key then Key word", "<着重>Key</着重> then <下划线>Key word</下划线>"),
], many=False)
judged("visible_escapes", M.each(R.escape_invisible), [("a​b", "a\\u200bb"), ("a\tb\n", "a\\tb\\n"), ("对 b", "对 b"), ("﻿", "\\ufeff")])
judged("brief_texts", lambda t: R.brief(t, 6), [("a\nb", "a\\nb"), ("abcdefg", "abcdef…"), ("abcdef", "abcdef"), ("", "")])

# small predicates and keys
judged("math_pairs", M.each(M.math_safe, "boolean"), [("$a$", True), ("$ a$", False), ("$a $", False), ("a$", False), (r"\$5", True), ("$a$5", False), ("no", True), ("$a$ $b$", True)])
judged("math_fields", X.is_math_field, [("a_1", True), ("x", False), ("{y}", True), (r"\alpha", True), ("对", False), ("$", True)])
judged("image_targets", X.image_target, [("<a b.png>", "a b.png"), ('a.png "title"', "a.png"), (" a b.png ", "a b.png"), ("a.png 't'", "a.png"), ("a.png", "a.png")])
judged("display_widths", M.each(M.display_width, "long"), [("abc", 3), ("对a", 3), ("，（", 4), ("×μα①", 4), ("", 0)])
judged("comparison_keys", M.each(M.compare_key), [("ＡＢ", "ab"), ("ﬁ", "fi"), ("Straße", "strasse"), ("①", "1"), ("x", "x")])
judged("squeezed_texts", X.squeeze, [("a ​ b", "ab"), (r"\$ 5", "$5"), ("a　b\n", "ab"), ("x", "x"), ("⁠﻿y", "y")])
judged("compressed_texts", X.compress, [("a ​ b", "ab"), (r"\$ 5", r"\$5"), ("a　b\n", "ab"), ("x", "x")])
judged("report_versions", reports.is_v2, [("<!-- abc-report-v2 -->\nx", True), ("x\n<!-- abc-report-v2 -->", False), ("", False), ("<!-- abc-report-v1 -->", False)])
judged("structure_spans", M.each(lambda t: str(locate.safe_span(locate.structure_spans(t), 2, 4))), [("ab $cd$", "(2, 7)"), ("a$bcd$e", "(1, 6)"), ("**ab** $x$", "(0, 6)"), ("a **$b$** c", "(2, 9)"), ("plain text", "(2, 4)")])
judged("normalized_sources", M.each(lambda t: str((locate.normalized(t)[0].encode("unicode_escape").decode(), locate.normalized(t)[1]))), [("ab", "('ab', [0, 1, 2])"), ("a​b", "('ab', [0, 2, 3])"), ("a\r\nb", "('a\\\\nb', [0, 1, 3, 4])"), ("﻿", "('', [1])")])
judged("formula_spans", M.each(lambda t: str(M.math_spans(t))), [("a $b$ c", "[(2, 5, False)]"), ("$$x$$", "[(0, 5, True)]"), (r"\$5 $6$", "[(4, 7, False)]"), ("【1|$a$|b】 $c$", "[(10, 13, False)]"), ("none", "[]")])
judged("line_columns", M.each(lambda t: str(locate.line_column(t, t.find("Q")))), [("Q", "(1, 1)"), ("ab\ncQ", "(2, 2)"), ("a\n\nQ", "(3, 1)"), ("对对Q", "(1, 3)")])
judged("overlapping_hits", M.each(lambda t: str(locate.hits(t, "aa"))), [("aaaa", "[0, 1, 2]"), ("baab", "[1]"), ("b", "[]"), ("aa aa", "[0, 3]")])
judged("rendered_latex", M.each(L.for_renderer), [
    (r"a \gt b \le c", r"a > b \leq c"), (r"\mbox{cm} \hspace{2em}x", r"\text{cm} \ x"), (r"\mathrel{=} \displaystyle x", r"=  x"), (r"\left\| x \right\| \|U", r"\left\Vert x \right\Vert {\Vert}U"), (r"\text{速度} v_对", r"\text{速度} v_\mathrm{对}"), (r"\leftarrow \gtx", r"\leftarrow \gtx"), (r"\mathrm{ \, }\sum\limits", r"\mathrm{}\sum"),
])
