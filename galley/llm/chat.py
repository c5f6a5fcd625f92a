"""Chat formatting: a declarative template, a finite-state machine over roles, and loss flags by segment.

Native DataFrame functions only.  A template's control strings never occur in an escaped text, so the formatted
string reads back to the turns it was made of.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``open`` + role + newline + text + ``close`` for each turn; texts of ``loss_roles`` are under the loss.

    ``follows`` is the machine: state (``start`` or the last role) to the roles that may come; a conversation may end
    after a role of ``ends``.  Control strings must not contain a backslash, nor a first character of one further in.
    """

    open: str = "<turn>"
    close: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple[str, ...] = ("assistant",)

    def controls(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(c.rstrip("\n") for c in (self.open, self.close)))

    def __post_init__(self) -> None:
        first = {c[:1] for c in self.controls()}
        if not all(len(c) > 1 and "\\" not in c and not first & set(c[1:]) for c in self.controls()):
            raise ValueError("control strings need two characters, no backslash, and no first character of one inside")


def escape(text: Column, template: Template) -> Column:
    """Reversible: backslashes become ``\\b``, and control strings are broken up by ``\\e``."""
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    for c in template.controls():
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\e{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\e"), F.lit("")), F.lit("\\b"), F.lit("\\"))


def _role(role: Column, template: Template) -> Column:
    return F.replace(escape(role, template), F.lit("\n"), F.lit("\\n"))


def _unrole(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def valid_order(roles: Column, template: Template) -> Column:
    """Whether the machine accepts an array of roles."""
    moves = [f"{state}\0{role}" for state, roles_ in template.follows.items() for role in roles_]
    allowed = F.array(*map(F.lit, moves))
    last = F.aggregate(roles, F.lit("start"), lambda state, role: F.when(F.array_contains(allowed, F.concat(state, F.lit("\0"), role)), role).otherwise(F.lit("")))
    return last.isin(*template.ends)


def format_chats(df: DataFrame, template: Template | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: (conv_id, n_turns, valid, segments, formatted).

    ``segments``: array of (text, loss), three a turn; ``formatted`` joins them.  Rows are ordered by turn, equal turns
    by role and text; a null turn comes first.  Null roles and texts count as empty.  Conversations the machine rejects
    are formatted too, with ``valid`` false.  Rows with a null conversation make one conversation.  An empty table
    gives no row; other columns are ignored.
    """
    t = template or Template()
    turns = df.select(F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    one = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    segment = lambda value, loss: F.struct(value.alias("text"), loss.alias("loss"))
    of_turn = lambda x: F.array(
        segment(F.concat(F.lit(t.open), _role(x["role"], t), F.lit("\n")), F.lit(False)),
        segment(escape(x["text"], t), x["role"].isin(*t.loss_roles)),
        segment(F.lit(t.close), F.lit(False)),
    )
    made = one.select("conv_id", F.size("turns").cast("long").alias("n_turns"), valid_order(F.transform("turns", lambda x: x["role"]), t).alias("valid"), F.flatten(F.transform("turns", of_turn)).alias("segments"))
    return made.withColumn("formatted", F.concat_ws("", F.transform("segments", lambda s: s["text"])))


def read_turns(formatted: Column, template: Template | None = None) -> Column:
    """Array of (role, text) of a formatted conversation."""
    t = template or Template()
    end = t.close
    pieces = F.slice(F.split(formatted, f"\\Q{end}\\E", -1), 1, F.size(F.split(formatted, f"\\Q{end}\\E", -1)) - 1)

    def one(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(t.open) + 1))
        at = F.locate("\n", body)
        return F.struct(_unrole(F.substr(body, F.lit(1), at - 1)).alias("role"), unescape(F.substr(body, at + 1)).alias("text"))

    return F.transform(pieces, one)


def loss_text(segments: Column) -> Column:
    """All text under the loss, unescaped, nothing between."""
    return F.concat_ws("", F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])))
