"""Chat formatting: conversations to training text with a loss flag per segment, from a declarative template.

A finite-state machine over the roles says whether the turns come in a valid order. Every turn
becomes three segments, the mark that opens it, its text and the mark that closes it; only
texts of the roles that the template names carry loss. Control strings inside a text are
broken by an escape, so marks can be told from texts, and texts come back as they were.
All of it is column expressions; a conversation is one group, as it is one training example.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearfold.llm.common import let

ESCAPE = "\\"
CONTROL = re.compile(r"<<[^<>]*>>|<[^<>]*>|\[[^\[\]]*\]")
BREAK = "."  # an escape and this, put after the first character of a control string, break it


@dataclass(frozen=True)
class Template:
    """Marks around the text of each role, the role that stands for all others, loss roles and role order."""

    marks: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("<s>[INST] ", " [/INST]"), "assistant": ("[OUT] ", " </s>")}
    )
    other: tuple[str, str, str] = ("[ROLE] ", " [/ROLE] ", " [END]")  # before the role, between role and text, after the text
    loss: tuple[str, ...] = ("assistant",)
    start: tuple[str, ...] = ("system", "user")
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        """All control strings: what marks hold in angle or square brackets, longest first."""
        marks = [m for pair in self.marks.values() for m in pair] + list(self.other)
        return sorted({w for m in marks for w in CONTROL.findall(m)}, key=lambda w: (-len(w), w))


def escape(text: Column, template: Template) -> Column:
    """``text`` without any control string; undone by ``unescape``."""
    halves = "|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in template.controls())
    return F.regexp_replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2)), halves, re.escape(ESCAPE + BREAK).replace("\\.", "."))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(?:(\\)|\.)", "$1")


def _segments(turn: Column, template: Template) -> Column:
    """The three segments of a turn, as structs of text and loss."""
    role, text = turn["role"], escape(turn["text"], template)
    before, between, after = template.other
    opening = F.concat(F.lit(before), escape(role, template), F.lit(between))
    closing, loss = F.lit(after), role.isin(*template.loss)
    for name, (left, right) in template.marks.items():
        opening = F.when(role == name, F.lit(left)).otherwise(opening)
        closing = F.when(role == name, F.lit(right)).otherwise(closing)
    part = lambda t, flag: F.struct(t.alias("text"), flag.alias("loss"))
    return F.array(part(opening, F.lit(False)), part(text, loss), part(closing, F.lit(False)))


def _valid(roles: Column, template: Template) -> Column:
    """Whether the machine, fed with the roles, ends in an accepting state."""
    steps = [("", r) for r in template.start] + [(a, b) for a, after in template.follows.items() for b in after]

    def step(state: Column, role: Column) -> Column:
        allowed = reduce(lambda x, y: x | y, [(state == a) & (role == b) for a, b in steps])
        return F.when(allowed, role).otherwise(F.lit("!"))

    return F.aggregate(roles, F.lit(""), step).isin(*template.ends)


def format_conversations(
    turns: DataFrame, template: Template | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per conversation: ``conv_id``, ``valid``, ``segments`` (text, loss), ``formatted``.

    Turns are ordered by number, null first, and equal numbers by role and text; repeated rows
    are repeated turns. Null roles and texts are empty. Roles without marks of their own are
    written by name under the marks for others. Invalid orders are formatted all the same and
    flagged. Rows with a null conversation form one conversation. Extra columns are not read.
    """
    template = template or Template()
    row = F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    grouped = turns.select(F.col(conv_col).alias("conv_id"), row.alias("row")).groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    made = grouped.select(
        "conv_id",
        _valid(F.transform("rows", lambda t: t["role"]), template).alias("valid"),
        F.flatten(F.transform("rows", lambda t: _segments(t, template))).alias("segments"),
    )
    return made.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column, template: Template | None = None) -> Column:
    """The turns (role, text) of a formatted conversation, read off its marks."""
    template = template or Template()
    quoted = lambda m: re.sub(r"([\\\[\]{}()*+?.^$|/<>])", r"\\\1", m)
    before, between, after = map(quoted, template.other)
    shapes = [f"{quoted(a)}(?s:.*?){quoted(b)}" for a, b in template.marks.values()] + [f"{before}(?s:.*?){between}(?s:.*?){after}"]

    def turn(piece: Column) -> Column:
        left, middle, right = template.other
        inner = F.substr(piece, F.lit(len(left) + 1), F.length(piece) - len(left) - len(right))
        at = F.instr(inner, middle)
        role, text = F.substr(inner, F.lit(1), at - 1), F.substr(inner, at + len(middle), F.length(inner))
        for name, (a, b) in template.marks.items():
            own = F.startswith(piece, F.lit(a))
            role = F.when(own, F.lit(name)).otherwise(role)
            text = F.when(own, F.substr(piece, F.lit(len(a) + 1), F.length(piece) - len(a) - len(b))).otherwise(text)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit("|".join(shapes)), F.lit(0)), turn)


def report(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Digests per conversation of what is read back from its formatted text and segments."""
    made = format_conversations(turns, template)
    lost = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    digest = let(
        read_turns(F.col("formatted"), template),
        lambda t: F.struct(
            F.size(t).cast("bigint").alias("n"),
            F.sha2(F.array_join(F.transform(t, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("sha"),
        ),
    )
    out = made.select("conv_id", digest.alias("d"), lost.alias("lost"), F.length("formatted").cast("bigint").alias("formatted_chars"), "valid")
    return out.select(
        "conv_id", F.col("d.n").alias("n_turns"), F.col("d.sha").alias("turns_sha256"), F.length("lost").cast("bigint").alias("loss_chars"),
        F.sha2("lost", 256).alias("loss_sha256"), "formatted_chars", "valid",
    )
