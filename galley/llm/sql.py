"""DuckDB SQL of the queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = r"""
with chats as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), made as (
  select *, length(replace(replace(replace(text, '\', '\b'), '<turn>', '<\eturn>'), '</turn>', '<\e/turn>')) as n_text,
    length(replace(replace(replace(replace(role, '\', '\b'), '<turn>', '<\eturn>'), '</turn>', '<\e/turn>'), chr(10), '\n')) as n_role,
    lag(role) over (partition by conv_id order by turn, role, text) as before,
    row_number() over (partition by conv_id order by turn desc, role desc, text desc) as back
  from chats
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(n_text + n_role + length('<turn>') + 1 + length('</turn>') + 1) as bigint) as formatted_chars,
  bool_and(case when before is null then role in ('system', 'user') when before = 'system' then role = 'user'
    when before = 'user' then role = 'assistant' when before = 'assistant' then role = 'user' else false end
    and (back > 1 or role = 'assistant')) as valid
from made group by conv_id
"""

OP6 = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, cast(strlen(html) as bigint) as payload_bytes, sha256(html) as payload_digest from p),
m as (select *, min(page_id) over (partition by payload_digest) as first from d)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id > first then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id > first then first end as refers_to
from m
"""

OP7 = f"""
with d as (select doc_id, {_LOWER} as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
  doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from d
"""

_RATIOS = {"symbols": ("n_symbols", "n_words", 1000, 1), "word_length": ("word_chars", "n_words", 100, 1), "dup_lines": ("n_dup_lines", "n_lines", 1000, 1), "repeats": ("n_repeat_words", "n_words", 1000, 9), "capitals": ("n_upper", "word_chars", 1000, 1), "marks": ("n_marks", "n_words", 1000, 1)}
_METRICS = " union all ".join(f"select doc_id, lang, source, '{m}' as metric, {k} * {a} // {b} as v, {k * more} // {b} as item from s where not base_failed" for m, (a, b, k, more) in _RATIOS.items())
_BITS = "({0} >> greatest(length(bin({0})) - 6, 0)) << greatest(length(bin({0})) - 6, 0)"


def _quartile(quarter: int, column: str, part: str) -> str:
    return f"select {part}, max(n_all) as n, min(b) filter (where 4 * upto >= {quarter} * n_all) as q from (select *, {column} as b, count(*) over (partition by {part} order by {column}) as upto, count(*) over (partition by {part}) as n_all from sk) group by {part}"


def _level(name: str, by: str) -> str:
    part = ", ".join(filter(None, (by, "metric")))
    return f"""{name} as (select * from (select {part}, n, q as q1 from ({_quartile(1, 'b_v', part)})) join (select {part}, q as q3 from ({_quartile(3, 'b_v', part)})) using ({part}) join (select {part}, q as item from ({_quartile(3, 'b_item', part)})) using ({part}))"""


def _blend(q: str) -> str:
    return f"(o.n * o.{q} + 10 * ((l.n * l.{q} + 10 * w.{q}) // (l.n + 10))) // (o.n + 10) as {q}"


OP9 = rf"""
with d as (
  select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents
), grams as (
  select doc_id, unnest(range(1, len(w) - 1)) as i, w from d where len(w) >= 3
), keyed as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as n from grams),
covered as (
  select doc_id, count(distinct p) as n from (select doc_id, i as p from keyed where n > 1 union all select doc_id, i + 1 from keyed where n > 1 union all select doc_id, i + 2 from keyed where n > 1) group by doc_id
), s as (
  select d.doc_id, lang, source, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(lines) as bigint) as n_lines,
    cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, coalesce(covered.n, 0) as n_repeat_words,
    cast(length(regexp_replace(text, '[^A-Z]', '', 'g')) as bigint) as n_upper, cast(length(regexp_replace(text, '[^!?]', '', 'g')) as bigint) as n_marks,
    (len(w) < 50 or 100 * coalesce(covered.n, 0) > 50 * len(w)) as base_failed
  from d left join covered on d.doc_id = covered.doc_id
), m as ({_METRICS}),
sk as (select *, {_BITS.format("v")} as b_v, {_BITS.format("item")} as b_item from m),
{_level("own", "lang, source")}, {_level("by_lang", "lang")}, {_level("whole", "")},
mixed as (select o.lang, o.source, o.metric, {_blend("q1")}, {_blend("q3")}, {_blend("item")} from own o join by_lang l on o.lang = l.lang and o.metric = l.metric join whole w on o.metric = w.metric),
broken as (
  select m.doc_id, count(*) as n from m join mixed x on m.lang = x.lang and m.source = x.source and m.metric = x.metric
  where m.v > x.q3 + 8 * greatest(x.q3 - x.q1, x.item) or (m.metric = 'word_length' and m.v < x.q1 - 8 * greatest(x.q3 - x.q1, x.item)) group by m.doc_id
)
select s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and broken.n is null as kept
from s left join broken on s.doc_id = broken.doc_id
"""

OP11 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, v.vec_id as vec_id, cast(list_dot_product(q.x, v.x) as bigint) as score
  from v as q join v on q.vec_id <> v.vec_id where q.vec_id % 50 = 0
)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from s qualify rank <= 5
"""

ORACLES = {"op3_chat_format": OP3, "op6_arc_to_warc": OP6, "op7_exact_dedup": OP7, "op9_quality_rules": OP9, "op11_pivot_top_k": OP11}
