"""Segmentation: lines to units by running groups, explicit slices with proof of coverage, exam answers."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

_SEEN = lambda key: Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)


def to_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no from 1, line)."""
    return df.select(key, F.posexplode(X.lines(F.col(text))).alias("at", "line")).select(key, (F.col("at") + 1).alias("line_no"), "line")


def running_groups(lines: DataFrame, key: str, starts: Column) -> DataFrame:
    """Adds ``unit_no``: how many start lines there were up to a line; 0 before the first."""
    return lines.withColumn("unit_no", F.sum(F.when(starts, 1).otherwise(0)).over(_SEEN(key)).cast("long"))


def units(lines: DataFrame, key: str, starts: Column, prelude: bool = False) -> DataFrame:
    """(key, unit_no, title, content, first_line, chars): lines of a group joined; what precedes the first start only if asked for."""
    grouped = running_groups(lines, key, starts).where(F.lit(prelude) | (F.col("unit_no") > 0))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    made = grouped.groupBy(key, "unit_no").agg(parts.alias("ls"), F.min("line_no").alias("first_line"))
    return made.select(key, "unit_no", F.element_at("ls", 1).alias("title"), F.array_join("ls", "\n").alias("content"), "first_line", F.length(F.array_join("ls", "\n")).cast("long").alias("chars"))


def has_body(content: Column) -> Column:
    """Whether a unit has more than headings and bold lines."""
    return F.exists(F.split(content, "\n", -1), lambda x: (F.length(X.strip(x)) > 0) & ~X.strip(x).rlike(r"^#{1,6}\s|^\*\*[^*]+\*\*\z"))


def merge_headers(made: DataFrame, key: str) -> DataFrame:
    """A section-heading unit takes the one after it, pairwise: in a run of headings every second is taken."""
    w = Window.partitionBy(key).orderBy("unit_no")
    flagged = made.withColumn("head", F.col("title").rlike(r"^##\s")).withColumn("run", F.sum(F.when(~F.col("head"), 1).otherwise(0)).over(w))
    ranked = flagged.withColumn("nth", F.row_number().over(Window.partitionBy(key, "run", "head").orderBy("unit_no")))
    taker = ranked.withColumn("takes", F.col("head") & (F.col("nth") % 2 == 1) & F.lead("unit_no").over(w).isNotNull())
    done = taker.withColumn("taken", F.coalesce(F.lag("takes").over(w), F.lit(False))).withColumn("after", F.lead("content").over(w))
    return done.where(~F.col("taken")).select(key, "unit_no", "title", F.when(F.col("takes"), F.concat_ws("\n", "content", "after")).otherwise(F.col("content")).alias("content"), "first_line")


def answer_section(lines: DataFrame, key: str) -> DataFrame:
    """(key, answer_line): where the reference answers begin."""
    return lines.where(F.col("line").contains("参考答案")).groupBy(key).agg(F.min("line_no").alias("answer_line"))


def answer_mode(grouped: DataFrame, key: str, has_answer: Column) -> DataFrame:
    """(key, n_units, mode): ``inline`` if over half of the units have an answer, else ``end``."""
    by_unit = grouped.where("unit_no > 0").groupBy(key, "unit_no").agg(F.max(F.when(has_answer, 1).otherwise(0)).alias("has"))
    return by_unit.groupBy(key).agg(F.count("*").alias("n_units"), F.when(2 * F.sum("has") > F.count("*"), "inline").otherwise("end").alias("mode"))


def unique_only(df: DataFrame, *by: str) -> DataFrame:
    """Rows whose key occurs once."""
    return df.withColumn("__n", F.count("*").over(Window.partitionBy(*by))).where("__n = 1").drop("__n")


def backfill(questions: DataFrame, answers: DataFrame, *by: str) -> DataFrame:
    """Questions with the end answer of their number; a number repeated on either side gets none."""
    single = unique_only(questions.select(*by), *by)
    return questions.join(unique_only(answers, *by).join(single, list(by), "left_semi"), list(by), "left")


def coverage(lines: DataFrame, slices: DataFrame, key: str) -> DataFrame:
    """(key, total, non_empty, uncovered, overlap) of slices (key, start_line, end_line) over lines.

    A slice adds one at its start and takes one after its end, so coverage is a running sum and no line meets its slices.
    """
    marks = slices.select(key, F.col("start_line").alias("line_no"), F.lit(1).alias("d")).unionAll(slices.select(key, (F.col("end_line") + 1).alias("line_no"), F.lit(-1).alias("d")))
    step = marks.groupBy(key, "line_no").agg(F.sum("d").alias("d"))
    full = lines.join(step, [key, "line_no"], "left").withColumn("n", F.coalesce(F.sum("d").over(_SEEN(key)), F.lit(0)))
    body = F.length(X.strip(F.col("line"))) > 0
    return full.groupBy(key).agg(F.count("*").alias("total"), F.count_if(body).alias("non_empty"), F.count_if(body & (F.col("n") == 0)).alias("uncovered"), F.count_if(body & (F.col("n") > 1)).alias("overlap"))


def islands(rows: DataFrame, key: str) -> DataFrame:
    """(key, start_line, end_line): maximal runs of consecutive line numbers."""
    w = Window.partitionBy(key).orderBy("line_no")
    return rows.withColumn("g", F.col("line_no") - F.row_number().over(w)).groupBy(key, "g").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line")).drop("g")


def manual_units(lines: DataFrame, key: str) -> DataFrame:
    """(key, unit_no, start_line, end_line, error): units between start and end marks; unpaired marks give an error row."""
    begin = F.col("line").rlike(r"^\s*(?:\\?#){6}\s*单元开始\s*(?:\\?#){6}\s*\z")
    end = F.col("line").rlike(r"^\s*(?:\\?#){6}\s*单元结束\s*(?:\\?#){6}\s*\z")
    marks = lines.where(begin | end).withColumn("is_start", begin)
    w = Window.partitionBy(key).orderBy("line_no")
    paired = marks.withColumn("next_start", F.lead("is_start").over(w)).withColumn("next_line", F.lead("line_no").over(w)).withColumn("last_start", F.lag("is_start").over(w))
    good = F.col("is_start") & (F.col("next_start") == F.lit(False))
    bad = (F.col("is_start") & F.coalesce(F.col("next_start"), F.lit(True))) | (~F.col("is_start") & ~F.coalesce(F.col("last_start"), F.lit(False)))
    return paired.where(good | bad).select(key, F.sum(F.when(good, 1).otherwise(0)).over(_SEEN(key)).alias("unit_no"), (F.col("line_no") + 1).alias("start_line"), F.when(good, F.col("next_line") - 1).alias("end_line"), F.when(bad, F.concat(F.lit("unpaired mark in line "), F.col("line_no"))).alias("error"))


def precheck(made: DataFrame, key: str, overlong: int = 20000) -> DataFrame:
    """(key, unit_count, empty, overlong, min, median and max characters)."""
    n = F.col("chars")
    return made.groupBy(key).agg(F.count("*").alias("unit_count"), F.count_if(n == 0).alias("n_empty"), F.count_if(n > overlong).alias("n_overlong"), F.min(n).alias("min_chars"), F.median(n).alias("median_chars"), F.max(n).alias("max_chars"))


def exam_units(lines: DataFrame, key: str, question: str = r"^(\d+)．") -> DataFrame:
    """(key, unit_no, number, content, mode): an exam's questions with their answers, whichever side these are on.

    A question begins where the pattern matches a line that isn't bold; what comes before the first goes.  Answers stand
    in the questions (marked 【答案】 and 【详解】) or behind a line of reference answers under the same numbers, of which
    repeated ones are given to none.  Bold lines of titles leave a question's stem.
    """
    cut = lines.join(answer_section(lines, key), key, "left").withColumn("tail", F.coalesce(F.col("line_no") >= F.col("answer_line"), F.lit(False)))
    bare = X.strip(F.col("line"))
    number = F.regexp_extract(bare, question, 1).try_cast("int")
    cut = cut.withColumn("start", bare.rlike(question) & ~bare.startswith("**")).withColumn("num", F.when(F.col("start"), number))
    side = Window.partitionBy(key, "tail").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    grouped = cut.withColumn("unit_no", F.sum(F.when(F.col("start"), 1).otherwise(0)).over(side).cast("long")).where("unit_no > 0")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    made = grouped.groupBy(key, "tail", "unit_no").agg(ordered.alias("ls"), F.max("num").alias("number"))
    asked = made.where("not tail").withColumn("inline", F.exists("ls", lambda x: x.contains("【答案】")))
    mode = asked.groupBy(key).agg(F.when(2 * F.count_if("inline") > F.count("*"), "inline").otherwise("end").alias("mode"))
    answers = made.where("tail").select(key, "number", F.col("ls").alias("answer"))
    marked = F.when(F.exists("answer", lambda x: x.contains("【答案】")), F.col("answer")).otherwise(F.concat(F.array(F.lit("【答案】")), "answer"))
    full = backfill(asked.select(key, "unit_no", "number", "ls"), answers.withColumn("answer", marked), key, "number").join(mode, key)
    at = F.array_position(F.transform("ls", X.strip), F.lit("【答案】"))
    split = F.when((F.col("mode") == "inline") & (at > 0), at - 1).otherwise(F.size("ls")).cast("int")
    stem = F.filter(F.slice("ls", F.lit(1), split), lambda x: ~X.strip(x).rlike(r"^\*\*.*\*\*$"))
    rest = F.when(F.col("mode") == "inline", F.slice("ls", split + 1, F.size("ls"))).otherwise(F.coalesce("answer", F.array().cast("array<string>")))
    return full.select(key, "unit_no", "number", F.array_join(F.concat(stem, rest), "\n").alias("content"), "mode")


def section_problems(made: DataFrame, key: str, problem: Column) -> DataFrame:
    """(key, unit_no, part_no, title, content): a section's units once more, cut at example titles.

    ``problem`` says of a column ``line`` whether it is a title.  What comes before the first is a unit of knowledge with
    the section's title, unless blank; a section without examples stays one.
    """
    each = made.select(key, "unit_no", F.col("title").alias("section"), F.posexplode(F.split("content", "\n", -1)).alias("line_no", "line"))
    w = Window.partitionBy(key, "unit_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    numbered = each.withColumn("part_no", F.sum(F.when(problem, 1).otherwise(0)).over(w))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    parts = numbered.groupBy(key, "unit_no", "section", "part_no").agg(ordered.alias("ls"))
    whole = F.array_join("ls", "\n")
    content = F.when(F.col("part_no") == 0, X.strip(whole)).otherwise(whole)
    kept = parts.select(key, "unit_no", "part_no", F.when(F.col("part_no") == 0, F.col("section")).otherwise(X.strip(F.element_at("ls", 1))).alias("title"), content.alias("content"))
    return kept.where("part_no > 0 or length(content) > 0")


def structural(lines: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """(key, unit_no, title, content, error): units of a recorded plan of blocks (key, block_no, kind, level, start_line, end_line, title).

    A question is a unit.  Other blocks in a row make units of knowledge; a heading of level 1 to 3 begins another once
    the one before has more than headings.  Blocks whose lines aren't in the text give a row with an error, and then
    their text has no units.
    """
    n = lines.groupBy(key).agg(F.max("line_no").alias("n"))
    placed = blocks.join(n, key, "left").withColumn("bad", ~F.coalesce((F.col("start_line") >= 1) & (F.col("start_line") <= F.col("end_line")) & (F.col("end_line") <= F.col("n")), F.lit(False)))
    wrong = placed.where("bad").select(key, "block_no", F.lit("block-range").alias("error"))
    fine = placed.join(wrong.select(key).distinct(), key, "left_anti")
    spread = fine.select(key, "block_no", "kind", "level", "title", F.explode(F.sequence("start_line", "end_line")).alias("line_no")).join(lines, [key, "line_no"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    body = (F.length(X.strip(F.col("line"))) > 0) & ~F.ltrim(F.col("line")).startswith("#")
    own = spread.groupBy(key, "block_no", "kind", "level", "title").agg(text.alias("text"), F.bool_or(body).alias("body"), F.min_by(F.when(body, X.strip(F.col("line"))), F.when(body, F.col("line_no"))).alias("first"))
    by = Window.partitionBy(key).orderBy("block_no")
    question = F.col("kind") == "question"
    runs = own.withColumn("run", F.sum(F.when(question | F.coalesce(F.lag("kind").over(by) == "question", F.lit(True)), 1).otherwise(0)).over(by))
    before = Window.partitionBy(key, "run").orderBy("block_no")
    small = (F.col("kind") == "heading") & F.coalesce(F.col("level").between(1, 3), F.lit(False))
    # the body blocks so far; a small heading cuts where one came since the last cut, that is where their count has grown
    seen = runs.withColumn("bodies", F.coalesce(F.sum(F.when(F.col("body"), 1).otherwise(0)).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = F.max(F.when(small, F.col("bodies"))).over(before.rowsBetween(Window.unboundedPreceding, -1))
    cut = seen.withColumn("cut", F.when(small & (F.col("bodies") > F.coalesce(last, F.lit(0))), 1).otherwise(0)).withColumn("part", F.sum("cut").over(before))
    part = F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda x: x["text"])
    units_ = cut.groupBy(key, "run", "part").agg(F.min("block_no").alias("at"), F.bool_or(question).alias("q"), F.bool_or("body").alias("has"), X.strip(F.array_join(part, "\n")).alias("content"), F.min_by("title", "block_no").alias("title"), F.min_by("first", F.when(F.col("first").isNotNull(), F.col("block_no"))).alias("first"))
    kept = units_.where("has or (q and length(content) > 0)")
    done = kept.select(key, F.row_number().over(Window.partitionBy(key).orderBy("at")).alias("unit_no"), F.coalesce(F.nullif("title", F.lit("")), F.when(~F.col("q"), F.col("first")), F.lit("")).alias("title"), "content", F.lit(None).cast("string").alias("error"))
    return done.unionByName(wrong.select(key, F.lit(None).cast("int").alias("unit_no"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("content"), "error"))


def split_material(lines: DataFrame, key: str, mode: str, strategy: str = "rules", start: Column | None = None) -> DataFrame:
    """(key, unit_no, content) by one name: ``exam`` or ``lecture`` by rules, ``markers`` set by hand, or the ``whole`` text as a unit."""
    if strategy == "whole":
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
        return lines.groupBy(key).agg(F.array_join(ordered, "\n").alias("content")).select(key, F.lit(1).cast("long").alias("unit_no"), "content")
    if strategy == "markers":
        found = manual_units(lines, key)
        spread = found.where("error is null").select(key, "unit_no", F.explode(F.sequence("start_line", "end_line")).alias("line_no")).join(lines, [key, "line_no"])
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
        return spread.groupBy(key, "unit_no").agg(F.array_join(ordered, "\n").alias("content"))
    if strategy != "rules" or mode not in ("exam", "lecture"):
        raise ValueError("mode: exam or lecture; strategy: rules, markers or whole")
    if mode == "exam":
        return exam_units(lines, key).select(key, "unit_no", "content")
    return units(lines, key, start if start is not None else F.col("line").rlike(r"^#{1,6}\s")).select(key, "unit_no", "content")
