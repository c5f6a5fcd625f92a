"""Text rules that must keep formulas whole: plain functions of one text, and UDFs over them."""
from __future__ import annotations

import bisect
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import DECOR_INCHES

_INLINE = re.compile(r"(\$[^$\n]+\$)")
#: Stands for a formula while the text around it is worked on.
_HOLE = "\ue001"


def tokens(text: str) -> list[tuple[bool, str]]:
    """(is a formula, piece) from the left: inline formulas first, then what a pair of double dollars encloses."""
    out: list[tuple[bool, str]] = []
    within: list[tuple[bool, str]] | None = None
    for i, part in enumerate(_INLINE.split(text)):
        if i % 2:
            (out if within is None else within).append((True, part))
            continue
        for k, piece in enumerate(part.split("$$")):
            if k and within is None:
                within = []
            elif k:
                out.append((True, "$$" + "".join(x for _, x in within) + "$$"))
                within = None
            (out if within is None else within).append((False, piece))
    return out if within is None else [*out, (False, "$$"), *within]


def around_formulas(text: str, prose, formula=lambda x: x) -> str:
    """The text with ``prose`` applied to it around its formulas, and ``formula`` to each of these."""
    found = [(f or x == _HOLE, x) for f, piece in tokens(text) for x in ([piece] if f else re.split(f"({_HOLE})", piece))]
    pieces = prose("".join(_HOLE if f else x for f, x in found)).split(_HOLE)
    kept = [formula(x) if x != _HOLE else x for f, x in found if f]
    return pieces[0] + "".join(a + b for a, b in zip(kept, pieces[1:], strict=True))


# Escaped signs that are plain around formulas, before and after brackets are looked at; those that are plain in them.
EARLY, LATE, INSIDE = "_<>{}", "^#~&%*+-=|!'", "_^{}"


def _unescape(signs: str):
    pattern = re.compile(r"\\([" + re.escape(signs) + "])")
    return lambda text: pattern.sub(r"\1", text)


_EARLY, _LATE, _INSIDE = _unescape(EARLY), _unescape(LATE), _unescape(INSIDE)


def _plain_brackets(text: str) -> str:
    """``\\[...\\]`` around what has no sign of mathematics is a pair of brackets."""
    return re.sub(r"\\\[([^]$\\^_]*)\\\]", r"[\1]", text)


def fix_latex_escapes(text: str) -> str:
    """Undo a converter's surplus escapes.

    A run of backslashes is one, but two before a digit or the end; dollars are never escaped.  Around formulas signs
    lose their backslash, delimiters after ``\\left`` and ``\\right`` theirs, and brackets where they hold plain words;
    inside formulas only scripts and groups do.
    """
    once = re.sub(r"\\{2,}([\s\S]?)", lambda m: ("\\\\" if m[1] in "0123456789" else "\\") + m[1], text).replace("\\$", "$")

    def prose(x: str) -> str:
        x = re.sub(r"\\left\\([(\[])|\\right\\([)\]])", lambda m: f"\\left{m[1]}" if m[1] else f"\\right{m[2]}", _EARLY(x))
        return _LATE(_plain_brackets(x))

    return around_formulas(once, prose, _INSIDE)


_RULE = re.compile(r"(?:[|\s]*\d+\\?\.\s*[|\s]*)?([|+\-=:.\s]*)")


def _is_rule(line: str) -> bool:
    """Whether a line, maybe numbered, only draws a table's border; three dots or more are none."""
    m = _RULE.fullmatch(line.strip())
    return m is not None and len(m[1]) > 2 and not set(m[1]).isdisjoint("|+-=:")


def clean_tables(text: str) -> str:
    """Without table rules and pipes outside formulas; an answer label takes a following line of capitals; blank runs shrink."""

    def prose(x: str) -> str:
        out: list[str] = []  # from the last line to the first
        below = ""
        for line in reversed(x.splitlines()):
            if not _is_rule(line):
                kept = line.replace("|", "")
                if "答案:" in kept:
                    kept = re.sub("[-=]+", "", kept)
                    if re.fullmatch(r"[A-Z\s]+", below):
                        kept = f"{kept.rstrip()} {below}"
                        out.pop()
                out.append(kept)
            below = line.strip()
        joined = re.sub(r"\n{3,}", "\n\n", "\n".join(reversed(out)))
        return "\n".join(line.strip() for line in joined.split("\n"))

    return around_formulas(text, prose).strip()


def display_to_inline(text: str) -> str:
    """A display formula on one line becomes an inline one."""
    return re.sub(r"\$\$(.+?)\$\$", lambda m: m[0] if "\n" in m[1] else f"${m[1]}$", text, flags=re.S)


def drop_intent(text: str, problem_markers: tuple[str, ...]) -> str:
    """Delete each intent note that begins a line up to the next bold problem marker; one without a marker after it stays.

    Blank runs shrink, outer blanks go; so they do where a marker's pattern is broken, and nothing else then.
    """
    try:
        ends = [m.start() for m in re.finditer(r"\*\*(?:" + "|".join(problem_markers) + r")\*\*", text)] if problem_markers else []
    except re.error:
        return text.strip()
    out, at = [], 0
    for m in re.finditer(r"(?m)^【出题意图】", text):
        k = bisect.bisect_right(ends, m.start())
        if m.start() >= at and k < len(ends):
            out.append(text[at : m.start()])
            at = ends[k]
    return re.sub(r"\n{3,}", "\n\n", "".join([*out, text[at:]])).strip()


def drop_decor(text: str) -> str:
    """Without images that have no description and are smaller than the limit both ways."""

    def put(m: re.Match) -> str:
        try:
            return "" if max(float(m[1]), float(m[2])) < DECOR_INCHES else m[0]
        except ValueError:
            return m[0]

    return re.sub(r'!\[(?:test)?\]\([^)]*\)\{width="([\d.]+)in" height="([\d.]+)in"\}', put, text)


OPTION_GAP = " " * 34  # fixed value: what stands between an option's letter and its text once its image is gone


def lift_images(text: str) -> str:
    """The image ``![test](...)`` of a line ``A.`` goes to a line of its own, unless options B to D within ten lines have images."""
    rows = text.split("\n")
    pictured = [i for i, line in enumerate(rows) if re.match(r"[B-D]\.\s*!\[", line)]
    out = []
    for i, line in enumerate(rows):
        m = re.match(r"A\.\s*!\[test\]\(([^)]+)\)\s*(\{[^}]*\})?\s*(.*)", line)
        after = bisect.bisect_left(pictured, i)
        if m and not (after < len(pictured) and pictured[after] < i + 10):
            out += [f"![]({m[1]}){m[2] or ''}", f"A.{OPTION_GAP}{m[3]}"]
        else:
            out.append(line)
    return "\n".join(out)


def mask_code(text: str) -> str:
    """Fenced and inline code blanked, character by character, line ends kept."""
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    fenced = re.sub(r"(?ms)^ {0,3}(`{3,}|~{3,})[^\n]*\n.*?(?:^ {0,3}\1[`~]*[ \t]*$|\Z)", blank, text)
    return re.sub(r"(?s)(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", blank, fenced)


def images(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, description, target) of the images outside code."""
    return [(m.start(), m.end(), m[1], m[2]) for m in re.finditer(r"!\[([^\]\n]*)\]\(([^)\n]*)\)", mask_code(text))]


def math_spans(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, display) of the formulas from the left; a marker's fields hide theirs, an escaped dollar is none."""
    masked = re.sub(r"【\d+\|(?:\\[\s\S]|[^】\\])*(?:】|\Z)", lambda m: "\x00" * len(m[0]), text)
    at = [m.start() for m in re.finditer(r"(?<!\\)\$", masked)]
    have, out, i = set(at), [], 0
    while i < len(at):
        p = at[i]
        if p + 1 in have:
            close = next((q for q in at[i + 2 :] if q + 1 in have), None)
            if close is not None:
                out.append((p, close + 2, True))
                i = at.index(close, i) + 2
                continue
        if i + 1 < len(at) and at[i + 1] > p + 1:
            out.append((p, at[i + 1] + 1, False))
            i += 2
        else:
            i += 1
    return out


def compare_key(text: str) -> str:
    """Compatibility form, case folded, of a text without white space: equal keys need a person's look, not a rejection."""
    return unicodedata.normalize("NFKC", text).casefold()


def display_width(text: str) -> int:
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def math_safe(text: str) -> bool:
    """Whether dollars pair up: an opening one before, a closing one after something that isn't blank, none before a digit."""
    opened = False
    for m in re.finditer(r"(?<!\\)\$", text):
        before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        if opened and before and not before.isspace() and not after.isdigit():
            opened = False
        elif not opened and after and not after.isspace():
            opened = True
        else:
            return False
    return not opened


def each(fn, kind: str = "string"):
    """A UDF of a function of one text; null stays null. It is made where it is used, once there is a session.

    Texts go to Python a hundred at a time rather than in Arrow's batches of thousands, as a worker holds a batch and what is made of it.
    """

    def column(c) -> Column:
        apply = F.udf(lambda t: None if t is None else fn(t), kind, useArrow=False)
        return apply(c if isinstance(c, Column) else F.col(c))

    return column


def lecture_clean(problem_markers: tuple[str, ...]):
    """The cleaning chain of lecture material in one UDF."""
    return each(lambda t: clean_tables(re.sub(" {4,}", "  ", lift_images(drop_decor(drop_intent(fix_latex_escapes(t), problem_markers))))))
