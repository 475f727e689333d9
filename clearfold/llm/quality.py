"""Quality rules: text statistics and decision lists learned from labelled statistics.

Sequential covering grows one conjunction of threshold conditions at a time on two thirds
of the labelled rows, prunes it on the other third, removes what it covers and goes on.
The list is an ordered ``CASE WHEN`` over statistics that are plain column expressions,
so a verdict is one projection of a scan, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearfold.llm.common import SPACE, SPACED_WORD, let, total

SYMBOL = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LABELLED = 20_000  # labelled rows that a list is learned from
FEATURES = (
    "n_words", "mean_word_chars", "symbols_per_word", "marks_per_word", "upper_share", "dup_line_share", "repeat_share",
    "distinct_share",
)


def repeated_words(hashes: Column) -> Column:
    """Words inside any 3-word window that occurs twice or more, given one hash per word.

    Windows are sorted by hash so that equal ones are neighbours; the places of those with an
    equal neighbour are sorted again and their spans of three words united. Texts whose
    windows all differ skip the sorts.
    """
    windows = let(
        hashes,
        lambda h: F.transform(
            F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))),
            lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)),
        ),
    )
    return let(
        windows,
        lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("bigint")).otherwise(_covered_by_equal(w)),
    )


def _covered_by_equal(windows: Column) -> Column:
    near = lambda s, j, h: F.coalesce(F.get(s, j)["h"] == h, F.lit(False))
    places = let(
        F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        lambda s: F.filter(
            F.transform(s, lambda x, j: F.when(near(s, j + 1, x["h"]) | near(s, j - 1, x["h"]), x["i"])),
            lambda p: p.isNotNull(),
        ),
    )
    return let(
        F.sort_array(places),
        lambda p: total(
            F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3))).cast("bigint"))
        ),
    )


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``stats``, a struct of counts and ratios of the whole text.

    Null text counts as empty. All ratios of a text without words are 0. Any other column,
    whatever its name, is kept, except one named ``stats``, which is replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(SPACED_WORD), F.lit(0))
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    lines = F.filter(F.split(text, "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    counts = let(
        hashed,
        lambda h: F.struct(
            F.size(h).cast("bigint").alias("n_words"),
            F.size(F.array_distinct(h)).cast("bigint").alias("n_distinct"),
            repeated_words(h).alias("n_repeat_words"),
        ),
    )
    of_lines = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("bigint").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        ),
    )
    raw = F.struct(
        counts.alias("c"),
        of_lines.alias("l"),
        (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOL)).cast("bigint").alias("n_symbols"),
        F.regexp_count(text, F.lit("[!?]")).cast("bigint").alias("n_marks"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("bigint").alias("n_upper"),
    )
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
    stats = let(
        raw,
        lambda r: F.struct(
            r["c"]["n_words"].alias("n_words"),
            r["word_chars"].alias("word_chars"),
            r["n_symbols"].alias("n_symbols"),
            r["l"]["n_dup_lines"].alias("n_dup_lines"),
            r["c"]["n_repeat_words"].alias("n_repeat_words"),
            share(r["word_chars"], r["c"]["n_words"]).alias("mean_word_chars"),
            share(r["n_symbols"], r["c"]["n_words"]).alias("symbols_per_word"),
            share(r["n_marks"], r["c"]["n_words"]).alias("marks_per_word"),
            share(r["n_upper"], r["word_chars"]).alias("upper_share"),
            share(r["l"]["n_dup_lines"], r["l"]["n_lines"]).alias("dup_line_share"),
            share(r["c"]["n_repeat_words"], r["c"]["n_words"]).alias("repeat_share"),
            share(r["c"]["n_distinct"], r["c"]["n_words"]).alias("distinct_share"),
        ),
    )
    return docs.withColumn("stats", stats)


# -- decision lists --------------------------------------------------------------------


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, stats: Column) -> Column:
        value = stats[self.feature].cast("double")
        return value > self.threshold if self.above else value <= self.threshold


@dataclass(frozen=True)
class Rule:
    """All conditions hold: the row is rejected."""

    conditions: tuple[Condition, ...]

    def column(self, stats: Column) -> Column:
        return reduce(lambda a, b: a & b, [c.column(stats) for c in self.conditions])

    def __str__(self) -> str:
        return " and ".join(f"{c.feature} {'>' if c.above else '<='} {c.threshold:g}" for c in self.conditions)


def first_rule(rules: list[Rule], stats: Column) -> Column:
    """Number (from 1) of the first rule that covers the row, null when none does."""
    out = F.lit(None).cast("int")
    for i in range(len(rules), 0, -1):
        out = F.when(rules[i - 1].column(stats), F.lit(i)).otherwise(out)
    return out


def _grow(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], most: int) -> list[tuple[int, bool, float]]:
    """Conditions in the order of their information gain, until only rejected rows are covered."""
    inside, found = np.ones(len(y), bool), []
    while len(found) < most and (y[inside] == 0).any():
        p0, n0 = (y[inside] == 1).sum(), (y[inside] == 0).sum()
        best, gain = None, 1e-9
        for f, edges in enumerate(cuts):
            above = x[inside, f][:, None] > edges[None, :]
            bad = y[inside] == 1
            for over in (True, False):
                hit = above if over else ~above
                p, n = hit[bad].sum(0), hit[~bad].sum(0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -1.0)
                if len(g) and g.max() > gain:
                    gain, best = g.max(), (f, over, float(edges[int(g.argmax())]))
        if best is None:
            break
        found.append(best)
        inside &= (x[:, best[0]] > best[2]) == best[1]
    return found


def _covered(x: np.ndarray, conditions: list[tuple[int, bool, float]]) -> np.ndarray:
    inside = np.ones(len(x), bool)
    for f, over, edge in conditions:
        inside &= (x[:, f] > edge) == over
    return inside


def learn(
    x: np.ndarray, reject: np.ndarray, names: tuple[str, ...] = FEATURES, max_rules: int = 16, max_conditions: int = 4,
    n_cuts: int = 48, min_precision: float = 0.95, min_covered: int = 4,
) -> list[Rule]:
    """Sequential covering over a bounded matrix of statistics; ``reject`` is 1 for bad rows.

    Every third row prunes, the others grow. A rule is kept if, on both parts together, at
    least ``min_precision`` of the rows it newly covers are bad; the first that is not ends
    the list. No rows, or rows of one class only, give an empty list.
    """
    if len(reject) == 0 or reject.min() == reject.max():
        return []
    pruning = np.arange(len(reject)) % 3 == 2
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, n_cuts + 2)[:-1])) for f in range(x.shape[1])]
    left, rules = np.ones(len(reject), bool), []
    while len(rules) < max_rules and (reject[left & ~pruning] == 1).any():
        grow = left & ~pruning
        conditions = _grow(x[grow], reject[grow], cuts, max_conditions)
        if not conditions:
            break
        worth = []
        for k in range(1, len(conditions) + 1):
            y = reject[left & pruning][_covered(x[left & pruning], conditions[:k])]
            worth.append((2 * y.sum() - len(y)) / (len(y) + 1))
        conditions = conditions[: int(np.argmax(worth)) + 1]
        covered = left & _covered(x, conditions)
        if covered.sum() < min_covered or reject[covered].mean() < min_precision:
            break
        rules.append(Rule(tuple(Condition(names[f], over, edge) for f, over, edge in conditions)))
        left &= ~covered
    return rules


def learn_rules(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality",
    max_labelled: int = MAX_LABELLED,
) -> list[Rule]:
    """A decision list from the documents that ``labels`` covers.

    The first ``max_labelled`` labels in hash order are the sample: at most that many narrow
    rows are broadcast to the scan, and one row of statistics comes back for each. Rows with a
    null id, label or text teach nothing. Of several labels of one id the smallest counts, of
    several texts that with the least hash.
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col(quality_col).isNotNull())
    sample = (
        usable.groupBy(F.col(id_col).alias("__id")).agg(F.min(quality_col).alias("__q"))
        .orderBy(F.xxhash64("__id"), "__id").limit(max_labelled)
    )
    own = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    joined = with_statistics(own.join(F.broadcast(sample), "__id"), "__text")
    values = F.struct(F.xxhash64("__text").alias("h"), *[F.col(f"stats.{f}").cast("double").alias(f) for f in FEATURES])
    least = joined.select("__id", "__q", values.alias("v")).groupBy("__id", "__q").agg(F.min("v").alias("v"))
    rows = least.select("__id", "__q", *[F.col(f"v.{f}") for f in FEATURES]).collect()
    rows.sort(key=lambda r: tuple(r))
    x = np.array([r[2:] for r in rows], float).reshape(len(rows), len(FEATURES))
    return learn(x, np.array([int(r[1] == 0) for r in rows], int))


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """Add ``stats``, ``base_failed``, ``rule`` (the first that rejects, else null) and ``kept``.

    Empty and null texts fail the base rule. Columns of these names are replaced.
    """
    s = F.col("stats")
    failed = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])
    return (
        with_statistics(docs, text_col).withColumn("base_failed", failed).withColumn("rule", first_rule(rules, s))
        .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    )


def keep(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that neither the base rule nor a rule rejects, with all of their columns, whatever their names."""
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"))
    return judge(packed, rules).where(F.col("kept")).select("row.*")
