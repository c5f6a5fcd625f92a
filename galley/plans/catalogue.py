"""Named queries over the driver's tables, each with SQL where SQL can say it.

``documents`` holds no reports, so these derive them: each line's first word becomes a marker's original.
"""
from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calc as C
from ..functions import text as X
from ..operators import compile as K
from ..operators import corpus, ledger, locate, reports, segment
from ..shipping import ship, spread
from ..sources import delivery

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        @functools.wraps(f)
        def run(spark: SparkSession, d: str) -> DataFrame:
            return f(ship(spark), d)  # before any function of this package is sent to workers

        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return run

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return segment.to_lines(_t(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


_SQL_LINES = "select doc_id, unnest(generate_series(1, len(l))) as line_no, unnest(l) as line from (select doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) as l from documents)"


def _words(lines: DataFrame) -> DataFrame:
    return lines.withColumn("w", F.regexp_extract("line", r"^([^ 【】|\\$]+)", 1)).where("w <> ''")


_SQL_WORDS = f"select doc_id, line_no, line, regexp_extract(line, '^([^ 【】|\\\\$]+)', 1) as w from ({_SQL_LINES}) where regexp_extract(line, '^([^ 【】|\\\\$]+)', 1) <> ''"


@query("select doc_id, sha256(regexp_replace(text, ' {4,}', '  ', 'g')) as digest, length(regexp_replace(text, ' {4,}', '  ', 'g')) as n from documents")
def clean_spacing(spark: SparkSession, d: str) -> DataFrame:
    c = X.clean_spacing(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", F.sha2(c, 256).alias("digest"), F.length(c).cast("long").alias("n"))


@query("select doc_id, sha256(regexp_replace(regexp_replace(text, '\\*\\*([^*]+)\\*\\*', '\\1', 'g'), '__([^_]+)__', '\\1', 'g')) as digest from documents")
def strip_format_tags(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", F.sha2(X.clean_markdown(F.col("text")), 256).alias("digest"))


@query(r"""select page_id, regexp_replace(url, '[\\/:*?"<>|]', '_', 'g') as name, regexp_matches(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:|//)') as remote from pages""")
def safe_names(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", X.safe_name(F.col("url")).alias("name"), X.is_remote(F.col("url")).alias("remote"))


@query(r"select doc_id, sha256(regexp_replace(text, '([\\|【】])', '\\\1', 'g')) as escaped, true as same from documents")
def marker_escape_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    e = X.escape_field(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", F.sha2(e, 256).alias("escaped"), (X.unescape_field(e) == F.col("text")).alias("same"))


@query(f"select doc_id, line_no, concat(w, substr(line, length(w) + 1)) = line as same, length(w) as n from ({_SQL_WORDS})")
def marker_restore(spark: SparkSession, d: str) -> DataFrame:
    marked = F.concat(F.lit("【1|"), "w", F.lit("|"), F.upper("w"), F.lit("】"), F.substr("line", F.length("w") + 1))
    return _words(_lines(spark, d)).select("doc_id", "line_no", (X.restore(marked) == F.col("line")).alias("same"), F.length("w").cast("long").alias("n"))


@query("select doc_id, sha256(text) as digest, substr(sha256(text), 1, 12) as short from documents")
def source_digest(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.substring(F.sha2("text", 256), 1, 12).alias("short"))


@query(f"select doc_id, concat('p', line_no, '-', substr(sha256(line), 1, 12)) as paragraph_id from ({_SQL_LINES})")
def paragraph_ids(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("doc_id", X.paragraph_id(F.col("line_no"), F.col("line")).alias("paragraph_id"))


@query("select doc_id, 0 as s, length(text) as e, sha256(text) as h from documents")
def location_tokens(spark: SparkSession, d: str) -> DataFrame:
    token = X.location_id(F.sha2("text", 256), F.lit(0), F.length("text"))
    read = _t(spark, d, "documents").select("doc_id", token.alias("t")).select("doc_id", X.read_location(F.col("t")).alias("r"))
    return read.select("doc_id", F.col("r.s").alias("s"), F.col("r.e").cast("long").alias("e"), F.col("r.h").alias("h"))


_START = "line rlike '^[A-Z][a-z]{2,5}[ .]'"
_SQL_UNITS = f"""select doc_id, unit_no, string_agg(line, chr(10) order by line_no) as content, min(line_no) as first_line from (
  select *, sum(case when regexp_matches(line, '^[A-Z][a-z]{{2,5}}[ .]') then 1 else 0 end) over (partition by doc_id order by line_no) as unit_no from ({_SQL_LINES})) where unit_no > 0 group by doc_id, unit_no"""


def _units(spark: SparkSession, d: str) -> DataFrame:
    return segment.units(_lines(spark, d), "doc_id", F.expr(_START))


@query(f"select doc_id, cast(unit_no as bigint) as unit_no, first_line, length(content) as chars, sha256(content) as digest from ({_SQL_UNITS})")
def unit_segments(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d).select("doc_id", "unit_no", F.col("first_line").cast("long").alias("first_line"), "chars", F.sha2("content", 256).alias("digest"))


@query(f"select doc_id, count(*) as unit_count, count(*) filter (where length(content) = 0) as n_empty, count(*) filter (where length(content) > 2000) as n_overlong, min(length(content)) as min_chars, median(length(content)) as median_chars, max(length(content)) as max_chars from ({_SQL_UNITS}) group by doc_id")
def unit_precheck(spark: SparkSession, d: str) -> DataFrame:
    return segment.precheck(_units(spark, d), "doc_id", 2000)


@query("""select conv_id, cast(unit_no as bigint) as unit_no, count(*) as n_turns, sum(length(text)) as chars from (
  select *, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn) as unit_no from conversations) where unit_no > 0 group by conv_id, unit_no""")
def conversation_blocks(spark: SparkSession, d: str) -> DataFrame:
    turns = _t(spark, d, "conversations").withColumnRenamed("turn", "line_no")
    return segment.running_groups(turns, "conv_id", F.col("role") == "user").where("unit_no > 0").groupBy("conv_id", "unit_no").agg(F.count("*").alias("n_turns"), F.sum(F.length("text")).alias("chars"))


@query("""with b as (select conv_id, unit_no, max(case when role = 'assistant' then 1 else 0 end) as has from (
  select *, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn) as unit_no from conversations) where unit_no > 0 group by conv_id, unit_no)
  select conv_id, count(*) as n_units, case when 2 * sum(has) > count(*) then 'inline' else 'end' end as mode from b group by conv_id""")
def answer_mode(spark: SparkSession, d: str) -> DataFrame:
    turns = _t(spark, d, "conversations").withColumnRenamed("turn", "line_no")
    return segment.answer_mode(segment.running_groups(turns, "conv_id", F.col("role") == "user"), "conv_id", F.col("role") == "assistant")


_SQL_NUMBERED = "select conv_id, turn, turn // 2 as num, role, text from conversations"


@query(f"""with q as (select * from ({_SQL_NUMBERED}) where role = 'user'), a as (select * from ({_SQL_NUMBERED}) where role = 'assistant'),
  uq as (select conv_id, num from q group by all having count(*) = 1), ua as (select conv_id, num, any_value(text) as answer from a group by conv_id, num having count(*) = 1)
  select q.conv_id, q.num, q.turn, sha256(ua.answer) as answer from q left join uq on q.conv_id = uq.conv_id and q.num = uq.num left join ua on uq.conv_id = ua.conv_id and uq.num = ua.num""")
def answer_backfill(spark: SparkSession, d: str) -> DataFrame:
    numbered = _t(spark, d, "conversations").withColumn("num", F.expr("turn div 2"))
    q, a = numbered.where("role = 'user'").select("conv_id", "num", "turn"), numbered.where("role = 'assistant'").select("conv_id", "num", F.col("text").alias("answer"))
    return segment.backfill(q, a, "conv_id", "num").select("conv_id", "num", "turn", F.sha2("answer", 256).alias("answer"))


@query(f"""with l as ({_SQL_LINES}), n as (select doc_id, max(line_no) as n from l group by doc_id),
  s as (select doc_id, 1 as a, 1 + n // 2 as b from n union all select doc_id, 1 + n // 2, n - 1 from n),
  c as (select l.doc_id, l.line_no, l.line, count(s.a) as k from l left join s on l.doc_id = s.doc_id and l.line_no between s.a and s.b group by all)
  select doc_id, count(*) as total, count(*) filter (where regexp_matches(line, '[^ ]')) as non_empty, count(*) filter (where k = 0 and regexp_matches(line, '[^ ]')) as uncovered, count(*) filter (where k > 1 and regexp_matches(line, '[^ ]')) as overlap from c group by doc_id""")
def slice_coverage(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    n = lines.groupBy("doc_id").agg(F.max("line_no").alias("n"))
    mid = F.expr("1 + n div 2").cast("int")
    cut = n.select("doc_id", F.explode(F.array(F.struct(F.lit(1).alias("start_line"), mid.alias("end_line")), F.struct(mid.alias("start_line"), (F.col("n") - 1).alias("end_line")))).alias("s")).select("doc_id", "s.*")
    return segment.coverage(lines, cut.where("end_line >= start_line"), "doc_id")


@query(f"""with w as (select *, row_number() over (partition by doc_id order by line_no) as g from ({_SQL_LINES}) where line like '% the %')
  select doc_id, min(line_no) as start_line, max(line_no) as end_line from w group by doc_id, line_no - g""")
def line_islands(spark: SparkSession, d: str) -> DataFrame:
    out = segment.islands(_lines(spark, d).where("line like '% the %'"), "doc_id")
    return out.select("doc_id", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))


def _reports(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text, body, report): every third line has a marker, some changed, some void, some without a reason.

    A null text counts as empty, so that every document has a report.
    """
    n, w = F.col("line_no"), F.col("w")
    docs = _t(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    lines = spread(segment.to_lines(docs.select("doc_id", "text"), "doc_id", "text"), "doc_id").withColumn("w", F.regexp_extract("line", r"^([^ 【】|\\$]+)", 1)).withColumn("marked", (n % 3 == 1) & (w != ""))
    orig = F.when(n % 4 == 0, F.concat(w, F.lit("q"))).otherwise(w)
    new = F.when(n % 7 == 0, orig).otherwise(F.concat(w, F.lit("x")))
    body = F.when(F.col("marked"), F.concat(F.lit("【"), n.cast("string"), F.lit("|"), orig, F.lit("|"), new, F.lit("】"), F.substr("line", F.length(w) + 1))).otherwise(F.col("line"))
    why = F.when(F.col("marked") & (n % 5 != 0), F.concat(n.cast("string"), F.lit(". because")))
    piece = F.array_sort(F.collect_list(F.struct("line_no", body.alias("b"), why.alias("r"))))
    made = lines.groupBy("doc_id").agg(piece.alias("p")).select("doc_id", F.array_join(F.transform("p", lambda x: x["b"]), "\n\n").alias("body"), F.array_join(F.array_compact(F.transform("p", lambda x: x["r"])), "\n").alias("why"))
    full = made.withColumn("report", F.concat(F.lit(f"总结：{reports.SEVERITIES[1]}\n\n{reports.MARKED}\n\n"), "body", F.lit(f"\n\n{reports.REASONS}\n\n"), "why", F.lit("\n")))
    return full.join(docs.select("doc_id", "source", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text")), "doc_id")


_SQL_MARKED = f"select doc_id, line_no, line, w, case when line_no % 4 = 0 then w || 'q' else w end as orig, case when line_no % 7 = 0 then case when line_no % 4 = 0 then w || 'q' else w end else w || 'x' end as new from ({_SQL_WORDS}) where line_no % 3 = 1"


@query(f"""with m as ({_SQL_MARKED}) select documents.source, count(*) as n_markers, count(*) filter (where orig = new) as n_noop, count(*) filter (where line_no % 5 = 0) as n_without_reason,
  count(distinct m.doc_id) as n_reports from m join documents on m.doc_id = documents.doc_id group by documents.source""")
def report_issues(spark: SparkSession, d: str) -> DataFrame:
    marked = _reports(spark, d).where(F.col("body").rlike(X.MARKER_V1))  # by the body: a condition on what is made of it would make all of it once more, each part for each marker
    r = reports.audited(marked, "body", "text")
    numbers = reports.number_issues(F.transform("markers", lambda m: m["num"]), F.transform(reports.reason_entries(reports.sections(F.col("report"))["reasons"]), lambda x: x["num"]))
    n = lambda of, keep: F.sum(F.size(F.filter(of, keep)))
    each = r.withColumn("issues", numbers).groupBy("source")
    return each.agg(F.sum(F.size("markers")).alias("n_markers"), n("markers", lambda m: m["verdict"] == "noop").alias("n_noop"), n("issues", lambda i: i["code"] == "reason.missing").alias("n_without_reason"), F.count_distinct("doc_id").alias("n_reports"))


FLAGSHIP = report_issues


@query(f"select doc_id, cast(line_no as int) as num, 'reason.missing' as code from ({_SQL_MARKED}) where line_no % 5 = 0")
def reasons_vs_markers(spark: SparkSession, d: str) -> DataFrame:
    r = _reports(spark, d)
    found, why = reports.markers(r, "doc_id", "body"), reports.reasons(r.select("doc_id", reports.sections(F.col("report"))["reasons"].alias("t")), "doc_id", "t")
    return reports.reason_issues(found, why, "doc_id").select("doc_id", F.col("location").cast("int").alias("num"), "code")


@query("select doc_id, len(string_split(text, 'the ')) - 1 as n from documents where text like '%the %'")
def locate_phrase(spark: SparkSession, d: str) -> DataFrame:
    return locate.locations(_t(spark, d, "documents"), "doc_id", "text", "the ").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("select doc_id, len(string_split(text, 'tion')) - 1 as n from documents")
def phrase_counts(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", locate.count_hits(F.col("text"), F.lit("tion")).alias("n"))


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """Corrections of the first word of every third line, and of a stretch in which some overlap."""
    lines = _words(_lines(spark, d)).where("line_no % 3 = 1")
    return lines.select("doc_id", "line_no", "w", F.length("w").alias("n"))


@query(f"""with s as (select doc_id, line_no * 10 as a, line_no * 10 + length(w) * 4 as b from ({_SQL_WORDS}) where line_no % 3 = 1),
  o as (select *, max(b) over (partition by doc_id order by a, b rows between unbounded preceding and 1 preceding) as left_end from s) select doc_id, a as "start", b as "end", left_end from o where a < left_end""")
def overlap_check(spark: SparkSession, d: str) -> DataFrame:
    s = _spans(spark, d).select("doc_id", (F.col("line_no") * 10).cast("long").alias("start"), (F.col("line_no") * 10 + F.col("n") * 4).cast("long").alias("end"))
    return K.overlaps(s, "doc_id")


_SQL_SEVERITY = "case doc_id * 7 % 4 when 0 then '无问题' when 1 then '轻微问题' when 2 then '一般问题' else '严重错误' end"


@query(f"select source, {{}} as summary from (select source, max(doc_id * 7 % 4) as r from documents group by source)".format(_SQL_SEVERITY.replace("doc_id * 7 % 4", "r")))
def max_severity(spark: SparkSession, d: str) -> DataFrame:
    s = F.element_at(F.array(*map(F.lit, reports.SEVERITIES)), (F.col("doc_id") * 7 % 4 + 1).cast("int"))
    return K.heaviest(_t(spark, d, "documents").withColumn("severity", s), "source")


@query("select e.event_id, 'none' as evidence_id from events e where e.event_id % 3 = 0")
def evidence_dangling(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    ids = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("there"), F.lit("none"))).otherwise(F.array(F.lit("there")))
    wanted = e.select("event_id", F.col("event_id").alias("id"), ids.alias("evidence_ids"))
    return K.dangling(wanted, e.select("event_id", F.lit("there").alias("evidence_id")), "event_id").select("event_id", "evidence_id")


_SQL_BOUND = "select event_id as call_id, case when event_id % 5 = 0 then 'call-missing' when event_id % 7 = 0 then 'call-failed' when event_id % 11 = 0 then 'unit_id-mismatch' end as code from events"


@query(f"select * from ({_SQL_BOUND}) where code is not null")
def calc_binding(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").select(F.col("event_id").alias("call_id"), F.col("user_id").alias("unit_id"))
    off = F.when(F.col("call_id") % 11 == 0, F.col("unit_id") + 1).otherwise(F.col("unit_id"))
    calls = e.where("call_id % 5 <> 0").select("call_id", off.alias("unit_id"), (F.col("call_id") % 7 != 0).alias("success"))
    return K.binding_errors(e, calls, ("unit_id",))


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Events as a ledger: a user is a unit of one of ten tasks, an event's type its phase."""
    e = _t(spark, d, "events")
    return e.select((F.col("user_id") % 10).cast("string").alias("task_id"), F.col("user_id").cast("string").alias("unit_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("phase"), (F.col("event_id") % 5).cast("string").alias("attempt_id"))


@query("""with u as (select user_id, cast(user_id % 10 as varchar) as task_id, user_id % 13 = 0 as flying, user_id % 3 = 0 as waiting from (select distinct user_id from events)),
  f as (select task_id, 8 - count(*) filter (where flying) as free from u group by task_id),
  w as (select *, row_number() over (partition by task_id order by user_id, cast(user_id as varchar)) as nth from u where waiting and not flying)
  select w.task_id, cast(user_id as varchar) as unit_id, nth from w join f on w.task_id = f.task_id where nth <= free""")
def dispatch_plan(spark: SparkSession, d: str) -> DataFrame:
    u = _t(spark, d, "events").select("user_id").distinct()
    state = F.when(F.col("user_id") % 13 == 0, "in_flight").when(F.col("user_id") % 3 == 0, "not_started").otherwise("completed")
    units = u.select((F.col("user_id") % 10).cast("string").alias("task_id"), F.col("user_id").cast("string").alias("unit_id"), F.col("user_id").alias("unit_no"), state.alias("state"), F.lit(False).alias("cancelled"))
    return ledger.dispatch(units).withColumn("nth", F.col("nth").cast("long"))


@query("""select s.status, count(u.user_id) as n from (values ('completed'), ('pending'), ('not_started'), ('unverified'), ('failed'), ('skip')) s(status)
  left join (select distinct user_id from events) u on s.status = case user_id % 5 when 0 then 'completed' when 1 then 'pending' when 2 then 'not_started' when 3 then 'unverified' else 'failed' end group by s.status""")
def unit_state_counts(spark: SparkSession, d: str) -> DataFrame:
    u = _t(spark, d, "events").select("user_id").distinct()
    k = F.col("user_id") % 5
    flags = u.select(F.lit(False).alias("skip"), F.lit(False).alias("legacy"), (k != 2).alias("has_report"), (k == 4).alias("has_note"), k.isin(0, 1).alias("gate_ok"), (k == 0).alias("registered"), F.lit(True).alias("reviewed"))
    return ledger.state_counts(ledger.unit_status(flags))


@query(f"select event_id, case event_id % 6 when 0 then 'call_correction' when 1 then 'calc_representation' when 2 then 'call_correction' when 3 then 'interactive' when 4 then 'forbidden' else 'unclassified' end as category from events")
def error_categories(spark: SparkSession, d: str) -> DataFrame:
    codes = F.array(*map(F.lit, ("usage", "proposal.calc-x", "proposal.y", "anchor.ambiguous", "user-cancel", "strange")))
    return _t(spark, d, "events").select("event_id", ledger.error_category(F.element_at(codes, (F.col("event_id") % 6 + 1).cast("int"))).alias("category"))


@query("select sha256(text) as digest, count(*) as copies, min(source || '/' || doc_id) as representative from documents group by 1")
def dedup_by_sha(spark: SparkSession, d: str) -> DataFrame:
    return corpus.representatives(_t(spark, d, "documents").withColumn("path", F.concat_ws("/", "source", F.col("doc_id").cast("string"))), "text", "path")


@query("""with s as (select l_returnflag, l_extendedprice as v, row_number() over (partition by l_returnflag order by l_extendedprice) - 1 as i, count(*) over (partition by l_returnflag) as n from lineitem)
  select l_returnflag, min(v) filter (where i = round_even((n - 1) * 0.9, 0)) as p90 from s group by l_returnflag""")
def length_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return corpus.nearest_rank(_t(spark, d, "lineitem"), "l_extendedprice", 0.9, "l_returnflag").withColumnRenamed("l_extendedprice", "p90")


@query(f"""select bucket, count(*) as n from (select doc_id, case when count(*) = 1 then '1' when count(*) = 2 then '2' when count(*) <= 4 then '3-4' when count(*) <= 9 then '5-9' when count(*) <= 19 then '10-19' else '20+' end as bucket from ({_SQL_MARKED}) group by doc_id) group by bucket""")
def marker_histogram(spark: SparkSession, d: str) -> DataFrame:
    n = _spans(spark, d).groupBy("doc_id").agg(F.count("*").alias("k"))
    return n.select(corpus.histogram(F.col("k")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1")
def latest_review(spark: SparkSession, d: str) -> DataFrame:
    return ledger.latest(_t(spark, d, "events"), "user_id", order=("ts", "event_id")).select("user_id", "event_id", "event_type")


@query("select l_orderkey, l_linenumber from lineitem l where exists (select 1 from orders o where o.o_orderkey = l.l_orderkey and (o.o_orderkey % 2 = 0 or o.o_orderstatus = l.l_linestatus))")
def registered_current(spark: SparkSession, d: str) -> DataFrame:
    u = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("unit_id"), F.col("l_linestatus").alias("data_sha256"), F.lit(1).alias("run_id"))
    r = _t(spark, d, "orders").select(F.col("o_orderkey").alias("unit_id"), F.when(F.col("o_orderkey") % 2 != 0, F.col("o_orderstatus")).alias("data_sha256"), F.lit(1).alias("run_id"))
    return ledger.registered(u, r, ("run_id",)).select("l_orderkey", "l_linenumber")


@query("""select m.source, count(*) as n_markers, count(*) filter (where doc_id % 3 = 0) as n_anchors, count(*) filter (where doc_id % 5 = 0) as n_fallbacks,
  greatest(count(*) - count(*) filter (where doc_id % 3 = 0) - count(*) filter (where doc_id % 5 = 0), 0) as missing, greatest(count(*) filter (where doc_id % 3 = 0) + count(*) filter (where doc_id % 5 = 0) - count(*), 0) as over from documents m group by m.source""")
def anchor_accounting(spark: SparkSession, d: str) -> DataFrame:
    m = _t(spark, d, "documents").select("source", "doc_id")
    return corpus.accounting(m, m.where("doc_id % 3 = 0"), m.where("doc_id % 5 = 0"), "source")


@query("""select l_orderkey, l_linenumber, round(l_quantity * l_discount + l_extendedprice * l_tax, 6) as dot, round(l_quantity * l_tax - l_extendedprice * l_discount, 6) as cross_z from lineitem""")
def vector_ops(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.array("l_quantity", "l_extendedprice"), F.array("l_discount", "l_tax")
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(C.dot(a, b), 6).alias("dot"), F.round(C.cross2(a, b), 6).alias("cross_z"))


@query("select p_partkey, round(p_retailprice / 16.04 * 2 * 18.015, 3) as water from part")
def stoichiometry(spark: SparkSession, d: str) -> DataFrame:
    params = F.to_json(F.struct(F.lit("CH4+2O2->CO2+2H2O").alias("balanced_equation"), F.lit("CH4").alias("known_substance"), F.col("p_retailprice").alias("known_mass"), F.lit("H2O").alias("target_substance")))
    out = C.calculated(_t(spark, d, "part"), "stoichiometry", params)
    return out.select("p_partkey", F.round(F.col("c.result").cast("double"), 3).alias("water"))


@query("select p_partkey, cast(p_size as double) * 1000 as g, true as same from part")
def dimension_check(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "part").select("p_partkey", "p_size")
    conv = F.to_json(F.struct(F.col("p_size").cast("string").alias("expression"), F.lit("convert").alias("dim_operation"), F.lit("kg").alias("unit_definitions"), F.lit("g").alias("target_units")))
    chk = F.lit('{"expression": "F = m*a", "unit_definitions": {"F": "N", "m": "kg", "a": "m/s^2"}}')
    out = C.calculated(p, "dimension", conv).withColumn("k", C.calc(F.lit("dimensional"), chk))
    return out.select("p_partkey", F.col("c.result").cast("double").alias("g"), F.get_json_object("k.result", "$.consistent").cast("boolean").alias("same"))


@query(f"select source, string_agg('## ' || doc_id || chr(10) || chr(10) || case when doc_id % 4 > 0 then sha256(text) else '（未通过）' end, chr(10) || chr(10) order by doc_id, cast(doc_id as varchar)) as text, bool_and(doc_id % 4 > 0) as complete from documents where doc_id % 10 > 0 group by source")
def paper_report(spark: SparkSession, d: str) -> DataFrame:
    u = _t(spark, d, "documents").select("source", F.col("doc_id").alias("unit_no"), F.col("doc_id").cast("string").alias("unit_name"), F.sha2("text", 256).alias("body"), (F.col("doc_id") % 4 > 0).alias("ok"), (F.col("doc_id") % 10 == 0).alias("skip"))
    return corpus.paper_report(u, "source")


def _calculated(df: DataFrame, key: str, op: str, **params) -> DataFrame:
    given = F.to_json(F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in params.items()]))
    out = C.calculated(df.select(key, given.alias("given")), op, F.col("given"))
    return out.select(key, F.col("c.result").alias("result"))


@query("select p_partkey, round(p_size * p_size * 1.5 + p_size, 6) as area from part")
def definite_integral(spark: SparkSession, d: str) -> DataFrame:
    made = _calculated(_t(spark, d, "part"), "p_partkey", "integrate", expression="3*x + 1", variable="x", lower_limit="0", upper_limit=F.col("p_size").cast("string"))
    return made.select("p_partkey", F.round(F.col("result").cast("double"), 6).alias("area"))


@query("select p_partkey, round((p_size - 3) / 4.0, 6) as a from part")
def formula_solve(spark: SparkSession, d: str) -> DataFrame:
    made = _calculated(_t(spark, d, "part"), "p_partkey", "formula", formula="v = u + a*t", solve_for="a", substitutions=F.struct(F.col("p_size").alias("v"), F.lit(3).alias("u"), F.lit(4).alias("t")))
    return made.select("p_partkey", F.round(F.col("result").cast("double"), 6).alias("a"))


@query("select p_partkey, '\"x + ' || (p_size + 1) || '\"' as result from part")
def simplified_quotient(spark: SparkSession, d: str) -> DataFrame:
    n = (F.col("p_size") + 1).cast("string")
    return _calculated(_t(spark, d, "part"), "p_partkey", "simplify", expression=F.concat(F.lit("(x^2 - "), n, F.lit("*"), n, F.lit(")/(x - "), n, F.lit(")")))


@query("select p_partkey, cast(p_size as double) as reached from part")
def quotient_limit(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size").cast("string")
    made = _calculated(_t(spark, d, "part"), "p_partkey", "limit", expression=F.concat(F.lit("(x^2 - "), n, F.lit("*x)/(x - "), n, F.lit(")")), variable="x", approach=n)
    return made.select("p_partkey", F.col("result").cast("double").alias("reached"))


@query("select p_partkey, p_size * 5.0 as distance from part")
def point_distance(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size").cast("string")
    made = _calculated(_t(spark, d, "part"), "p_partkey", "geometry", expression=F.concat(F.lit("Point(0,0).distance(Point(3*"), n, F.lit(",4*"), n, F.lit("))")))
    return made.select("p_partkey", F.col("result").cast("double").alias("distance"))


@query(f"""with m as (select doc_id, count(*) as n from ({_SQL_MARKED}) group by doc_id)
  select d.doc_id, coalesce(n, 0) as n_markers, coalesce(n, 0) as n_anchors, cast(0 as bigint) as n_fallbacks, cast(0 as bigint) as missing, true as ok from documents d left join m on d.doc_id = m.doc_id""")
def word_delivery(spark: SparkSession, d: str) -> DataFrame:
    """A Word file of each derived report, read back and held against the report's markers."""
    r = _reports(spark, d)
    units = r.select("doc_id", F.lit(1).alias("unit_no"), F.col("doc_id").cast("string").alias("unit_name"), "body", F.lit(None).cast("array<struct<num: int, reason: string>>").alias("reasons"))
    marks = r.select("doc_id", F.size(F.regexp_extract_all("body", F.lit(X.MARKER_V1), F.lit(1))).cast("long").alias("n_markers"))
    audit = delivery.word_audit(delivery.word_files(units, "doc_id"), "doc_id")
    return delivery.reconcile(marks, audit, "doc_id").select("doc_id", "n_markers", "n_anchors", "n_fallbacks", "missing", "ok")


@query(f"""with m as ({_SQL_MARKED}) select doc_id, sha256('{{"summary":"{reports.SEVERITIES[1]}","items":[' || string_agg('{{"num":' || line_no || ',"original":' || to_json(orig) || ',"replacement":' || to_json(new) || '}}', ',' order by line_no) || ']}}') as digest from m group by doc_id""")
def report_json(spark: SparkSession, d: str) -> DataFrame:
    """Each derived report as JSON, its markers in order."""
    r = _reports(spark, d)
    found = reports.markers(r, "doc_id", "body").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("num", "original", "replacement"))).alias("items"))
    made = r.select("doc_id", reports.summary(F.col("report")).alias("summary")).join(found, "doc_id")
    return made.select("doc_id", F.sha2(delivery.report_json(F.col("summary"), F.col("items")), 256).alias("digest"))


@query("select source, doc_id, case when doc_id % 7 = 0 then 'superseded' else 'current' end as status, case when doc_id % 7 = 0 then 'run-2' end as superseded_by from documents")
def superseded_units(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select("source", "doc_id")
    return delivery.supersede(docs, docs.where("doc_id % 7 <> 0"), "run-2", "source", "doc_id")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    return dict(_SQL)
