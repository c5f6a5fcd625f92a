"""Column functions over Markdown text: cleaning, digests, identifiers, marker fields."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Format tags, zero-width code points (of markers and of anchors), image size limit in inches.
FORMAT_TAGS = ("着重", "下划线", "波浪线", "删除线", "上标", "下标")
ZERO_WIDTH = "\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
ANCHOR_ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"
DECOR_INCHES = 0.4
#: What a text has that isn't only Unicode white space; and the white space of ASCII.
SOME, ASCII_BLANKS = r"(?U)\S", "\t\n\u000b\f\r "
#: Marker with fields in which a backslash and the character after it belong together; possessive, so that long fields are safe.
MARKER_V2 = r"【(\d+)\|([^|\\]*+(?:\\[\s\S][^|\\]*+)*+)\|([^】\\]*+(?:\\[\s\S][^】\\]*+)*+)】"
#: Marker with plain fields.
MARKER_V1 = r"【(\d+)\|([^|】]*)\|([^】]*)】"


def let(value: Column, body) -> Column:
    """body(value), with value computed once: what a function of an array's elements refers to is computed anew for each of them."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean_spacing(t: Column) -> Column:
    """Four blanks or more become two."""
    return F.regexp_replace(t, " {4,}", "  ")


def drop_comment_anomaly(t: Column) -> Column:
    return F.replace(t, F.lit("`<!-- -->`{=html}"), F.lit(""))


def caret_tilde(t: Column) -> Column:
    """``~x~`` and ``^x^`` become subscript and superscript tags; escaped signs lose their backslash afterwards."""
    out = F.regexp_replace(t, r"(?<!\\)~([^~\s]+?)~", "<下标>$1</下标>")
    out = F.regexp_replace(out, r"(?<!\\)\^([^\^\s]+?)\^", "<上标>$1</上标>")
    return F.replace(F.replace(out, F.lit("\\~"), F.lit("~")), F.lit("\\^"), F.lit("^"))


def strip_format_tags(t: Column) -> Column:
    return F.regexp_replace(t, f"</?(?:{'|'.join(FORMAT_TAGS)})>", "")


def clean_markdown(t: Column, keep_bold: bool = True) -> Column:
    """Without format tags, Word comments, and bold or underlined marks (or the marked words)."""
    out = F.regexp_replace(strip_format_tags(t), r"(?s)<批注\s+id=\d+>.*?</批注>", "")
    put = "$1" if keep_bold else ""
    return F.regexp_replace(F.regexp_replace(out, r"\*\*([^*]+)\*\*", put), r"__([^_]+)__", put)


def strip(t: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(t, r"(?U)^\s+|\s+\z", "")


def safe_name(t: Column) -> Column:
    """A file name: reserved characters become underscores, an empty name gets a default."""
    return F.coalesce(F.nullif(strip(F.regexp_replace(t, r'[\\/:*?"<>|]', "_")), F.lit("")), F.lit("未命名"))


def image_target(raw: Column) -> Column:
    """The target of an image: out of angle brackets, without a quoted title; blanks within stay."""
    t = strip(raw)
    bare = strip(F.regexp_replace(t, r"""\s+(?:"[^"]*"|'[^']*')\s*\z""", ""))
    return F.when(t.startswith("<") & t.contains(">"), F.regexp_extract(t, "^<([^>]*)>", 1)).otherwise(bare)


def is_remote(path: Column) -> Column:
    return path.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|//)")


def is_math_field(t: Column) -> Column:
    return t.rlike(r"[\\$^_{}]")


def escape_field(t: Column) -> Column:
    return F.regexp_replace(t, r"([\\|【】])", r"\\$1")


def unescape_field(t: Column) -> Column:
    """Undoes ``escape_field`` in one pass from the left; other escapes stay."""
    return F.regexp_replace(t, r"\\([\\|【】])", "$1")


def restore(body: Column, escaped: bool = False) -> Column:
    """Every marker replaced by its original field."""
    if not escaped:
        return F.regexp_replace(body, MARKER_V1, "$2")
    gaps = F.split(F.regexp_replace(body, MARKER_V2, "\u0001"), "\u0001", -1)
    fields = F.transform(F.regexp_extract_all(body, F.lit(MARKER_V2), F.lit(2)), unescape_field)
    return F.array_join(F.transform(gaps, lambda g, i: F.concat(F.when(i > 0, F.element_at(fields, F.greatest(i, F.lit(1)))).otherwise(F.lit("")), g)), "")


def without_zero_width(t: Column) -> Column:
    return F.regexp_replace(t, f"[{ZERO_WIDTH}]", "")


def squeeze(t: Column) -> Column:
    """Without zero-width characters and white space; an escaped dollar is a dollar."""
    return F.regexp_replace(F.replace(without_zero_width(t), F.lit("\\$"), F.lit("$")), r"(?U)\s+", "")


def compress(t: Column) -> Column:
    return F.regexp_replace(without_zero_width(t), r"(?U)\s+", "")


def paragraphs(t: Column) -> Column:
    """Blank-line separated paragraphs, stripped, none empty."""
    unix = F.replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.filter(F.transform(F.split(unix, r"\n[ \t]*(?:\n[ \t]*)+", -1), strip), lambda p: F.length(p) > 0)


def lines(t: Column) -> Column:
    """Lines as Python's ``splitlines`` sees them: all Unicode line ends, no empty last line."""
    unix = F.regexp_replace(t, "\r\n|[\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]", "\n")
    return F.split(F.regexp_replace(unix, r"\n\z", ""), "\n", -1)


def paragraph_id(ordinal: Column, paragraph: Column) -> Column:
    return F.concat(F.lit("p"), ordinal.cast("string"), F.lit("-"), F.substring(F.sha2(paragraph, 256), 1, 12))


def location_id(digest: Column, start: Column, end: Column) -> Column:
    """A token bound to a source's digest and a span: ``loc1.<base64url of canonical JSON>.<12 hex of its hash>``."""
    json = F.concat(F.lit('{"e":'), end.cast("string"), F.lit(',"h":"'), digest, F.lit('","s":'), start.cast("string"), F.lit(',"v":1}'))
    coded = F.translate(F.rtrim(F.translate(F.base64(json.cast("binary")), "+/=\r\n", "-_ ")), " ", "")
    return F.concat(F.lit("loc1."), coded, F.lit("."), F.substring(F.sha2(json, 256), 1, 12))


def read_location(token: Column) -> Column:
    """STRUCT<s, e, h, v> of a token, or null where it is damaged."""
    part = F.split(token, r"\.")
    b64 = F.translate(F.element_at(part, 2), "-_", "+/")
    json = F.decode(F.unbase64(F.rpad(b64, (F.ceil(F.length(b64) / 4) * 4).cast("int"), F.lit("="))), "UTF-8")
    good = (F.size(part) == 3) & (F.element_at(part, 1) == "loc1") & (F.substring(F.sha2(json, 256), 1, 12) == F.element_at(part, 3))
    return F.when(good, F.from_json(json, "s int, e int, h string, v int"))


def floating_images(rows_order: str = "line_no"):
    """Window over a unit's next ten lines, for images that float after an option line."""
    from pyspark.sql import Window

    return Window.partitionBy("unit_id").orderBy(rows_order).rowsBetween(0, 9)
