"""LaTeX formulas as tokens and groups: what a renderer or a converter of formulas lacks is put into words that it has."""
from __future__ import annotations

import re
from collections.abc import Iterator

_TOKEN = re.compile(r"\\[A-Za-z]+|\\[\s\S]|\\\Z|[{}]|[一-鿿]+|[^\\{}一-鿿]+")
# Commands that a formula renderer lacks, by what it has for them; commands that only wrap a group or set a style;
# those whose group is text.
SAME = {"gt": ">", "lt": "<", "ge": "\\geq", "le": "\\leq", "|": "{\\Vert}"}
WRAPS = frozenset("mathrel mathord mathbin mathopen mathclose mathpunct mathinner ensuremath".split())
STYLES = frozenset("displaystyle textstyle scriptstyle scriptscriptstyle limits nolimits".split())
TEXTS = {"text": "\\text", "mathrm": "\\mathrm", "mbox": "\\text"}


class Tokens:
    """The tokens of a formula from the left: commands with their backslash, braces, Chinese, anything else."""

    def __init__(self, formula: str):
        self.held, self.at = _TOKEN.findall(formula), 0

    def __iter__(self) -> Iterator[str]:
        while self.at < len(self.held):
            self.at += 1
            yield self.held[self.at - 1]

    def blanks(self) -> bool:
        """Whether the next token is blank; it is passed over if something that may belong to a command follows."""
        return self.at + 1 < len(self.held) and self.held[self.at].isspace()

    def group(self) -> list[str] | None:
        """The tokens within the braces that come next, blanks before them aside; none if there are no such or they don't close."""
        begin = self.at + self.blanks()
        if begin >= len(self.held) or self.held[begin] != "{":
            return None
        depth = 0
        for i in range(begin, len(self.held)):
            depth += {"{": 1, "}": -1}.get(self.held[i], 0)
            if depth == 0:
                self.at = i + 1
                return self.held[begin + 1 : i]
        return None

    def bar(self) -> bool:
        """Passes over a double bar, if one is next."""
        at = self.at + self.blanks()
        found = at < len(self.held) and self.held[at] == "\\|"
        self.at = at + 1 if found else self.at
        return found


def for_renderer(formula: str) -> str:
    """A formula in the words of a renderer of mathematics; Chinese outside texts is put upright."""
    tokens, out = Tokens(formula), []
    for token in tokens:
        name = token[1:] if token.startswith("\\") else ""
        if name in SAME:
            out.append(SAME[name])
        elif name in STYLES:
            continue
        elif name in ("left", "right") and tokens.bar():
            out.append(f"{token}\\Vert")
        elif name in WRAPS and (inside := tokens.group()) is not None:
            out.append(for_renderer("".join(inside)))
        elif name in TEXTS and (inside := tokens.group()) is not None:
            kept = "".join(inside)
            out.append(f"{TEXTS[name]}{{{'' if name == 'mathrm' and kept.strip() == chr(92) + ',' else kept}}}")
        elif name == "hspace":
            if tokens.at < len(tokens.held) and tokens.held[tokens.at] == "*":
                tokens.at += 1
            out.append("\\ " if tokens.group() is not None else token)
        elif "一" <= token[0] <= "鿿":
            out.append(f"\\mathrm{{{token}}}")
        else:
            out.append(token)
    return "".join(out)


_UNIT = re.compile(r"\s*(\{?)([A-Za-z/]+)\}")


def upright(text: str) -> str:
    """``\\rm`` before a group or first within one, around letters, as ``\\mathrm``."""
    first, *rest = text.split("\\rm")
    out = first
    for part in rest:
        m = _UNIT.match(part)
        if m and m[1]:
            out += f"\\mathrm{{{m[2]}}}{part[m.end() :]}"
        elif m and out.endswith("{"):
            out = f"{out[:-1]}\\mathrm{{{m[2]}}}{part[m.end() :]}"
        else:
            out += "\\rm" + part
    return out


def _bracketed(text: str) -> Iterator[tuple[str, bool]]:
    """Pieces of a text, and whether they stood between square brackets, each with one or two backslashes; doubled ones inside are undone."""
    at = 0
    while (begin := text.find("\\[", at)) >= 0:
        twice = begin > at and text[begin - 1] == "\\"
        mark = "\\\\" if twice else "\\"
        end = text.find(f"{mark}]", begin + 2)
        if end < 0:
            yield text[at : begin + 2], False
            at = begin + 2
            continue
        yield text[at : begin - twice], False
        inside = text[begin + 2 : end]
        yield inside.replace("\\\\", "\\") if twice else inside, True
        at = end + len(mark) + 1
    yield text[at:], False


def for_word(text: str) -> str:
    """Formulas as a converter of Markdown to Word wants them.

    Dollars stand for brackets and for escaped dollars, backslashes inside are single, units upright, and no blank is next to a
    dollar inside a formula of one line.  A line with an odd number of dollars has its last one escaped.
    """
    whole = "".join(f"${piece}$" if formula else piece for piece, formula in _bracketed(text)).replace("\\$", "$")
    out, at = [], 0
    while (begin := whole.find("$", at)) >= 0 and (end := whole.find("$", begin + 2)) >= 0:
        out += [whole[at:begin], "$", whole[begin + 1 : end].replace("\\\\", "\\"), "$"]
        at = end + 1
    return "\n".join(map(_dollars_of_a_line, upright("".join([*out, whole[at:]])).split("\n")))


def _dollars_of_a_line(line: str) -> str:
    parts = line.split("$")
    paired = (len(parts) - 1) // 2 * 2
    parts = [x.strip(" \t") if i % 2 and i < paired else x for i, x in enumerate(parts)]
    return "$".join(parts) if len(parts) % 2 else "$".join(parts[:-1]) + "\\$" + parts[-1]
