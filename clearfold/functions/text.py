"""Text predicates and renderings as native column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label vocabulary, meta-title patterns, placeholder bodies and lengths.
LABELS = ("NTA", "YTA", "ESH", "NAH")
META_TITLE_PATTERNS = (
    r"Monthly Open Forum",
    r"META",
    r"\[META\]",
    r"Rule \p{Nd}+",
    r"Welcome to",
    r"Modpost",
)
PLACEHOLDER_BODIES = ("[deleted]", "[removed]")
MIN_BODY_CHARS = 100
LABEL_WINDOW_CHARS = 200

_EDGE = r"[^\p{L}\p{N}_]"


def whole_word_pattern(words: Sequence[str]) -> str:
    """Pattern that captures one of ``words`` standing alone.

    Spells the word edges out as character classes, because engines disagree on
    which alphabets the word-boundary escape covers.
    """
    inner = "|".join(re.escape(w) for w in words)
    return f"(?:^|{_EDGE})({inner})(?:$|{_EDGE})"


def label_from_text(message: Column, labels: Sequence[str] = LABELS, window: int = LABEL_WINDOW_CHARS) -> Column:
    """First label named as a whole word in the first ``window`` characters, upper-cased, else null."""
    head = F.substring(message, 1, window)
    found = F.regexp_extract(head, "(?iu)" + whole_word_pattern(labels), 1)
    return F.nullif(F.upper(found), F.lit(""))


def is_meta_title(title: Column, patterns: Sequence[str] = META_TITLE_PATTERNS) -> Column:
    return title.rlike("(?iu)" + "|".join(patterns))


def is_valid_post(
    title: Column,
    body: Column,
    patterns: Sequence[str] = META_TITLE_PATTERNS,
    min_chars: int = MIN_BODY_CHARS,
) -> Column:
    """True for posts with a real title and a substantial body; never null.

    The cheap length tests come first, so the regular expression only runs on the
    rows they leave.
    """
    ok = (
        (F.length(title) > 0)
        & (F.length(body) > 0)
        & (F.length(body) >= min_chars)
        & ~body.isin(*PLACEHOLDER_BODIES)
        & ~is_meta_title(title, patterns)
    )
    return F.coalesce(ok, F.lit(False))


def truncate(text: Column, limit: int, ellipsis: bool = True) -> Column:
    """First ``limit`` characters, with an ellipsis only where something was cut."""
    head = F.substring(text, 1, limit)
    if not ellipsis:
        return head
    return F.when(F.length(text) > limit, F.concat(head, F.lit("..."))).otherwise(text)


def clean_phrases(phrases: Column, keep: int = 15) -> Column:
    """Trimmed non-blank entries of a string array, first ``keep`` only."""
    trimmed = F.transform(phrases, lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.slice(F.filter(trimmed, lambda p: p != ""), 1, keep)


def first_names(names: Column, keep: int = 2) -> Column:
    """``"a, b +3"``: the first names of an array and how many are left out."""
    rest = F.size(names) - keep
    head = F.array_join(F.slice(names, 1, keep), ", ")
    return F.when(rest > 0, F.concat(head, F.lit(" +"), rest.cast("string"))).otherwise(head)


def change_summary(removed: Column, added: Column) -> Column:
    """One line per round: what left and what came, or ``baseline`` where nothing left."""
    line = F.concat(F.lit("-("), first_names(removed), F.lit(") +("), first_names(added), F.lit(")"))
    return F.when(F.size(removed) > 0, line).otherwise(F.lit("baseline"))


def score_stars(score: Column, best: int = 5) -> Column:
    """A bar of filled and empty stars for a 1..best score."""
    filled = F.repeat(F.lit("★"), score.cast("int"))
    return F.concat(filled, F.repeat(F.lit("☆"), (F.lit(best) - score).cast("int")))


def keep_mark(keep: Column) -> Column:
    return F.when(keep, F.lit("keep")).otherwise(F.lit("remove"))


def run_stamp(ts: Column) -> Column:
    """Run id of a timestamp, second resolution."""
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def iso_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
