"""Request texts for an analysis service, built from tables, and parsing of its answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clearfold.functions.text import clean_phrases, truncate

# Text lengths and sample counts of the requests.
SAMPLE_CHARS = 400
BROAD_CHARS = 500
RESIDUAL_CHARS = 500
RESIDUAL_EXAMPLES = 5
BROAD_PATTERNS = 15

EXTRACTION_SYSTEM = (
    "Read the text and fill in the requested features. Judge only what is written and how; "
    "do not guess at the outcome.\n\nFeature set: {name}\n{description}"
)
EXTRACTION_USER = "Text to analyse:\n\n"
RESIDUAL_HEAD = "A model misread the texts below. Which signals does it lack? Current features: "
BROAD_HEAD = "List 10 to 15 general patterns that set the labels of these texts apart.\n\n"
SAMPLE_HEAD = "Compare texts the model got right with texts it got wrong.\n\n"
PROPOSAL_HEAD = "Judge each feature, then name features to remove and features to add.\n\n"

# Schemas of the answers.
RESIDUAL_DDL = (
    "pattern_summary string, hypotheses array<struct<feature_name:string,feature_type:string,"
    "description:string,extraction_prompt:string>>"
)
BROAD_DDL = "patterns array<string>"
SAMPLE_DDL = "correct_patterns string, incorrect_patterns string, missing_signals array<string>, key_insight string"
ITERATION_DDL = (
    "summary string, feature_evaluations array<struct<feature_name:string,usefulness_score:string,"
    "reasoning:string,keep:string>>, features_to_remove array<string>, proposed_features array<struct<"
    "name:string,feature_type:string,description:string,min_val:string,max_val:string,values:array<string>,"
    "rationale:string>>, expected_improvement string"
)


def extraction_requests(
    df: DataFrame, name: str, description: str, id_col: str = "id", text_col: str = "body"
) -> DataFrame:
    """One request per text: ``id, system, user``."""
    return df.select(
        F.col(id_col).cast("string").alias("id"),
        F.lit(EXTRACTION_SYSTEM.format(name=name, description=description)).alias("system"),
        F.concat(F.lit(EXTRACTION_USER), F.col(text_col)).alias("user"),
    )


def rendered_sample(features: Sequence[str], limit: int = SAMPLE_CHARS, prefix: str = "feat_") -> Column:
    """One prediction as a block of text: the shortened text, then its values, then what was said and what is so."""
    values = F.to_json(F.struct(*[F.col(prefix + c).alias(c) for c in features]))
    verdict = F.concat(F.col("predicted_label"), F.lit(" (sure to "), F.format_string("%.2f", F.col("confidence")), F.lit("), in truth "), F.col("true_label"))
    return F.concat(F.lit("* "), truncate(F.col("text"), limit), F.lit("\n  values "), values, F.lit("\n  judged "), verdict)


def joined_in_order(order: str, line: Column, sep: str = "\n") -> Column:
    """Aggregate that joins lines in ``order``; for inputs already cut to a few rows."""
    entries = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("s"))))
    return F.array_join(F.transform(entries, lambda e: e["s"]), sep)


def residual_request(wrong: DataFrame, feature_names: Sequence[str], order: str = "id") -> DataFrame:
    """One request from the misclassified examples chosen beforehand; no row when there are none."""
    shown = truncate(F.col("text"), RESIDUAL_CHARS, ellipsis=False)
    line = F.concat(F.lit("* judged "), F.col("predicted_label"), F.lit(" instead of "), F.col("true_label"), F.lit(": "), shown)
    head = RESIDUAL_HEAD + ", ".join(feature_names) + "\n\n"
    joined = wrong.agg(F.count(F.lit(1)).alias("n_examples"), joined_in_order(order, line).alias("examples"))
    return joined.where(F.col("n_examples") > 0).select(
        "n_examples", F.concat(F.lit(head), F.col("examples")).alias("prompt")
    )


def broad_request(sample: DataFrame, label: str, text: str, order: str = "id") -> DataFrame:
    """One request over a drawn sample of labelled texts."""
    line = F.concat(F.lit("- LABEL: "), F.col(label), F.lit("\n  TEXT: "), truncate(F.col(text), BROAD_CHARS))
    return sample.agg(F.count(F.lit(1)).alias("n_examples"), joined_in_order(order, line).alias("e")).select(
        "n_examples", F.concat(F.lit(BROAD_HEAD), F.col("e")).alias("prompt")
    )


def bullet_list(items: Sequence[str]) -> str:
    return "\n".join(f"- {i}" for i in items) if items else "(none)"


def sample_request(right: DataFrame, wrong: DataFrame, features: Sequence[str], patterns: Sequence[str] = ()) -> DataFrame:
    """One request that contrasts a few right and wrong predictions."""
    both = right.select(F.lit(1).alias("side"), F.col("id"), rendered_sample(features).alias("s")).unionByName(
        wrong.select(F.lit(0).alias("side"), F.col("id"), rendered_sample(features).alias("s"))
    )

    def side(value: int) -> Column:
        entries = F.sort_array(F.collect_list(F.when(F.col("side") == value, F.struct("id", "s"))))
        return F.array_join(F.transform(entries, lambda e: e["s"]), "\n")

    head = SAMPLE_HEAD + "Known patterns:\n" + bullet_list(patterns) + "\n\nRIGHT:\n"
    return both.agg(side(1).alias("r"), side(0).alias("w")).select(
        F.concat(F.lit(head), F.col("r"), F.lit("\n\nWRONG:\n"), F.col("w")).alias("prompt")
    )


def coefficient_lines(coefs: DataFrame, keys: Sequence[str] = ("config_id",)) -> DataFrame:
    """The coefficients of each model as one text, largest first; a model has a bounded number of them."""
    line = F.format_string("%+.4f %s, odds x %.3f", F.col("coefficient"), F.col("feature"), F.col("odds_ratio"))
    keyed = coefs.select(*keys, F.struct((-F.col("abs_coef")).alias("a"), F.col("feature").alias("f")).alias("o"), line.alias("l"))
    return keyed.groupBy(*keys).agg(joined_in_order("o", F.col("l")).alias("coefficient_lines"))


def definition_lines(defs: DataFrame, keys: Sequence[str] = ("config_id",)) -> DataFrame:
    line = F.concat(F.col("name"), F.lit(" ("), F.col("type"), F.lit(") "), F.coalesce("description", F.lit("")))
    return defs.groupBy(*keys).agg(joined_in_order("pos", line).alias("definition_lines"))


def cost_lines(costs: DataFrame, keys: Sequence[str] = ("config_id",), top: int = 10) -> DataFrame:
    """The ``top`` dearest features of each configuration with their matrix columns, equal ones by name."""
    entry = F.struct((-F.col("n_columns")).alias("c"), F.col("name").alias("n"))
    shown = lambda e: F.concat(e["n"], F.lit(" "), (-e["c"]).cast("string"))
    return costs.groupBy(*keys).agg(F.array_join(F.transform(F.slice(F.sort_array(F.collect_list(entry)), 1, top), shown), ", ").alias("cost_lines"))


def budget_lines(budgets: DataFrame) -> DataFrame:
    """What is left of the column budget, per row of ``(effective_dim, budget)``."""
    left = F.col("budget") - F.col("effective_dim")
    return budgets.withColumn("budget_lines", F.format_string("Columns left: %+d of %d, %d taken.", left, F.col("budget"), F.col("effective_dim")))


def insight_lines(insights: DataFrame) -> DataFrame:
    """The parsed sample analyses as texts, one part to a line; parts that are missing are left out."""
    part = lambda head, text: F.when(F.length(text) > 0, F.concat(F.lit(head), text))
    lines = F.array_compact(
        F.array(
            part("above all: ", F.col("key_insight")), part("lacking: ", F.array_join("missing_signals", "; ")),
            part("where wrong: ", F.col("incorrect_patterns")), part("where right: ", F.col("correct_patterns")),
        )
    )
    return insights.withColumn("insight_lines", F.array_join(lines, "\n"))


def proposal_requests(
    standing: DataFrame, coefs: DataFrame, defs: DataFrame, costs: DataFrame, insights: DataFrame, tried: DataFrame,
    patterns: Sequence[str] = (), max_swaps: int = 3, key: str = "config_id",
) -> DataFrame:
    """One request per row of ``standing``: ``key, prompt``.

    ``standing`` has ``cv_accuracy, cv_std, n_nonzero, n_columns, effective_dim, budget``; the others
    hold rows of the same key: coefficients, definitions, matrix columns per feature (``name,
    n_columns``), parsed sample analyses and names tried before. A key may be missing in any of them.
    """
    names = tried.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("tried"))
    seen = insight_lines(insights).select(key, "insight_lines")
    rows = budget_lines(standing)
    for part in (coefficient_lines(coefs, [key]), definition_lines(defs, [key]), cost_lines(costs, [key]), seen, names):
        rows = rows.join(part, key, "left")
    score = F.format_string(
        "Accuracy over folds %.3f, spread %.3f; %d of %d columns carry weight.", F.col("cv_accuracy"), F.col("cv_std"), F.col("n_nonzero"), F.col("n_columns")
    )
    shown = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("(none)"))
    rules = f"Remove up to {max_swaps} features and add up to {max_swaps}. Not to be named again: "
    prompt = F.concat(
        F.lit(PROPOSAL_HEAD), score, F.lit("\n"), F.col("budget_lines"), F.lit("\nDearest: "), shown("cost_lines"),
        F.lit("\n\nLessons of the samples:\n"), shown("insight_lines"), F.lit("\n\nKnown patterns:\n" + bullet_list(patterns)),
        F.lit("\n\nFeatures:\n"), shown("definition_lines"), F.lit("\n\nCoefficients:\n"), shown("coefficient_lines"),
        F.lit("\n\n" + rules), shown("tried"),
    )
    return rows.select(key, prompt.alias("prompt"))


# -- answers ---------------------------------------------------------------------------


def parse_answers(df: DataFrame, ddl: str, column: str = "response") -> DataFrame:
    """Add ``answer``, the typed form of a JSON response."""
    return df.withColumn("answer", F.from_json(column, ddl))


def broad_patterns(parsed: DataFrame, keys: Sequence[str], keep: int = BROAD_PATTERNS) -> DataFrame:
    """Patterns of broad answers in order: trimmed, blank ones left out, the first ``keep``; ``keys, pos, pattern``."""
    return parsed.select(*keys, F.posexplode(clean_phrases(F.col("answer.patterns"), keep)).alias("pos", "pattern"))


def sample_insights(parsed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sample analyses as columns; ``complete`` is false where the answer is no JSON or lacks a part."""
    fields = ("correct_patterns", "incorrect_patterns", "missing_signals", "key_insight")
    complete = F.lit(True)
    for f in fields:
        complete = complete & F.col(f"answer.{f}").isNotNull()
    return parsed.select(*keys, *[F.col(f"answer.{f}").alias(f) for f in fields], F.coalesce(complete, F.lit(False)).alias("complete"))


def _lax_int(c: Column) -> Column:
    return c.try_cast("int")


def feature_evaluations(parsed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Evaluated features of iteration answers, weakest first within a request.

    Numbers and flags may arrive as text; they are read as text and cast.
    """
    e = F.posexplode("answer.feature_evaluations").alias("pos", "e")
    return parsed.select(*keys, e).select(
        *keys,
        "pos",
        F.col("e.feature_name").alias("feature_name"),
        _lax_int(F.col("e.usefulness_score")).alias("usefulness_score"),
        F.col("e.keep").try_cast("boolean").alias("keep"),
        F.col("e.reasoning").alias("reasoning"),
    )


def weakest_first(evaluations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``place``: 1 for the weakest feature of a request, unscored ones first, equal ones by position."""
    order = Window.partitionBy(*keys).orderBy(F.col("usefulness_score").asc_nulls_first(), "pos")
    return evaluations.withColumn("place", F.row_number().over(order))


def requested_removals(parsed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return parsed.select(*keys, F.posexplode("answer.features_to_remove").alias("pos", "name"))


def requested_additions(parsed: DataFrame, keys: Sequence[str]) -> DataFrame:
    p = parsed.select(*keys, F.posexplode("answer.proposed_features").alias("pos", "p"))
    return p.select(
        *keys,
        "pos",
        F.col("p.name").alias("name"),
        F.col("p.feature_type").alias("feature_type"),
        F.col("p.description").alias("description"),
        _lax_int(F.col("p.min_val")).alias("min_val"),
        _lax_int(F.col("p.max_val")).alias("max_val"),
        F.col("p.values").alias("values"),
    )


def hypotheses(parsed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Proposed features of residual answers; ``complete`` is false where a field is missing."""
    h = parsed.select(*keys, F.posexplode("answer.hypotheses").alias("pos", "h"))
    fields = ("feature_name", "feature_type", "description", "extraction_prompt")
    complete = F.lit(True)
    for f in fields:
        complete = complete & F.col(f"h.{f}").isNotNull()
    return h.select(*keys, "pos", *[F.col(f"h.{f}").alias(f) for f in fields], complete.alias("complete"))
