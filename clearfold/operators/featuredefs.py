"""Feature definitions as a table.

One row per feature: ``config_id, pos, name, type, min, max, values, description`` with
``type`` one of scale, bool, categorical.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clearfold.functions.hashing import hex_number
from clearfold.operators.ordered import running

DEFS_SCHEMA = T.StructType(
    [
        T.StructField("config_id", T.StringType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("min", T.IntegerType()),
        T.StructField("max", T.IntegerType()),
        T.StructField("values", T.ArrayType(T.StringType())),
        T.StructField("description", T.StringType()),
    ]
)
_DEF_FIELDS = [f.name for f in DEFS_SCHEMA.fields if f.name not in ("config_id", "pos")]

# Scale bounds used where a definition names none, and the clamp of the budget.
SCALE_MIN, SCALE_MAX = 1, 5
BUDGET_SHARE, BUDGET_MIN, BUDGET_MAX = 0.25, 12, 25


def _scale(name: str, description: str) -> dict:
    return {"name": name, "type": "scale", "min": 1, "max": 5, "description": description}


def _flag(name: str, description: str) -> dict:
    return {"name": name, "type": "bool", "description": description}


def _choice(name: str, values: list[str], description: str) -> dict:
    return {"name": name, "type": "categorical", "values": values, "description": description}


# Names, types, bounds and domains of the shipped feature sets.
DEFAULT_SET = {
    "name": "default",
    "description": "Eight scales about how the writer tells a conflict.",
    "features": [
        _scale("self_awareness", "from ignoring one's own part (1) to weighing it openly (5)"),
        _scale("empathy_shown", "from no regard for the other side (1) to full understanding of it (5)"),
        _scale("emotional_intensity", "from an even tone (1) to a heated one (5)"),
        _scale("harm_caused", "from nothing lost (1) to serious damage (5)"),
        _scale("provocation_received", "from no trigger (1) to being wronged badly first (5)"),
        _scale("proportionality", "from a wild overreaction (1) to a fitting answer (5)"),
        _scale("relationship_closeness", "from strangers (1) to the closest family or friends (5)"),
        _scale("power_dynamic", "who holds the power: the writer (1), neither (3), the other side (5)"),
    ],
}
FULL_SET = {
    "name": "full",
    "description": "Fifteen scales, flags and one choice about how the writer tells a conflict.",
    "features": [
        _scale("perspective_balance", "from one side only (1) to both sides told fairly (5)"),
        _scale("self_awareness", "from ignoring one's own part (1) to weighing it openly (5)"),
        _scale("minimization", "from owning the act (1) to playing it down heavily (5)"),
        _flag("power_imbalance", "one side holds clear power over the other"),
        _flag("financial_component", "money or property is at stake"),
        _flag("children_involved", "minors take part or are affected"),
        _flag("betrayal_of_trust", "a promise or an agreement was broken"),
        _flag("boundary_setting", "the writer mainly defends a personal limit"),
        _scale("anger_level", "from calm (1) to hostile (5)"),
        _scale("guilt_expressed", "from none (1) to overwhelming (5)"),
        _scale("empathy_shown", "from no regard for the other side (1) to full understanding of it (5)"),
        _choice(
            "relationship_type",
            ["romantic", "family", "friendship", "workplace", "neighbor", "stranger", "other"],
            "what mainly ties the two sides",
        ),
        _flag("escalation_initiated", "the writer raised the stakes first"),
        _flag("social_norm_violation", "a common rule of behaviour was broken"),
        _flag("revenge_or_retaliation", "the act was mainly meant as payback"),
    ],
}
MINIMAL_SET = {
    "name": "minimal",
    "description": "Three features for a quick look.",
    "features": [
        _scale("sentiment", "from very negative (1) to very positive (5)"),
        _flag("self_aware", "the writer sees a possible fault of their own"),
        _choice("conflict_type", ["personal", "professional", "family", "other"], "where the conflict takes place"),
    ],
}


def defs_table(spark: SparkSession, *configs: dict) -> DataFrame:
    """Definition rows of literal configurations."""
    rows = [
        (
            c["name"], i, f.get("name"), f.get("type"), f.get("min"), f.get("max"), f.get("values"), f.get("description"),
        )
        for c in configs
        for i, f in enumerate(c["features"])
    ]
    return spark.createDataFrame(rows, DEFS_SCHEMA)


# -- cost and budget -------------------------------------------------------------------


def column_cost(ftype: str = "type", values: str = "values") -> Column:
    """Matrix columns one definition adds: categories minus one, otherwise one."""
    size = F.when(F.col(values).isNull(), F.lit(0)).otherwise(F.size(values))
    return F.when(F.col(ftype) == "categorical", F.greatest(size - 1, F.lit(0))).otherwise(F.lit(1))


def config_cost(defs: DataFrame) -> DataFrame:
    return defs.groupBy("config_id").agg(F.sum(column_cost()).alias("total_cost"), F.count(F.lit(1)).alias("n_features"))


def column_budget(n_train: Column) -> Column:
    """A quarter of the training rows, rounded half to even, clamped to 12..25."""
    quarter = F.bround(n_train.cast("decimal(20,2)") * F.lit(BUDGET_SHARE).cast("decimal(3,2)"), 0)
    return F.least(F.lit(BUDGET_MAX), F.greatest(F.lit(BUDGET_MIN), quarter.cast("int")))


def mark_pruned(defs: DataFrame, budget: Column) -> DataFrame:
    """Add ``cost``, ``total_cost`` and ``dropped``: what a column budget removes from each config.

    Categoricals go first, then scales, then flags, the costlier first and the earlier on
    ties, while the rest is still over ``budget``. A row is dropped exactly when the cost
    left before it is over budget, which a running sum decides for all configs at once.
    """
    rank = F.when(F.col("type") == "categorical", 2).when(F.col("type") == "scale", 1).otherwise(0)
    costed = defs.withColumn("cost", column_cost()).withColumn("__rank", rank)
    totals = costed.groupBy("config_id").agg(F.sum("cost").alias("total_cost"))
    chunk = F.struct(-F.col("__rank"), -F.col("cost"), F.floor(F.col("pos") / 4096))
    summed = running(
        costed, ["config_id"], chunk, [F.desc("__rank"), F.desc("cost"), F.asc("pos")], F.col("cost"), "__gone"
    )
    left = F.col("total_cost") - F.coalesce(F.col("__gone"), F.lit(0))
    return summed.join(totals, "config_id").withColumn("dropped", left > budget).drop("__rank", "__gone")


def prune(defs: DataFrame, budget: Column) -> DataFrame:
    return mark_pruned(defs, budget).where(~F.col("dropped")).select(*defs.columns)


def encoded_costs(defs: DataFrame, observed: DataFrame, top: int = 10) -> DataFrame:
    """Encoded columns per raw feature, most expensive first.

    ``observed(name, value)`` lists the category values of the training rows. Joining by
    feature name, instead of matching column-name prefixes, keeps ``a`` and ``a_b`` apart.
    """
    seen = observed.distinct().groupBy("name").agg(F.count("value").alias("__k"))
    cost = F.when(
        F.col("type") == "categorical", F.greatest(F.coalesce("__k", F.lit(0)) - 1, F.lit(0))
    ).otherwise(F.lit(1))
    costed = defs.join(seen, "name", "left").select("name", cost.cast("bigint").alias("n_columns"))
    return costed.orderBy(F.desc("n_columns"), "name").limit(top)


# -- schema of a config ----------------------------------------------------------------

_SPARK_TYPES = {"scale": T.IntegerType(), "bool": T.BooleanType(), "categorical": T.StringType()}


def record_schema(defs: Iterable) -> T.StructType:
    """Record type of one config from its definition rows, in order; unknown types are an error."""
    fields = []
    for d in defs:
        if d["type"] not in _SPARK_TYPES:
            raise ValueError(f"unknown type {d['type']!r} of feature {d['name']!r}")
        fields.append(T.StructField(d["name"], _SPARK_TYPES[d["type"]], True, {"comment": field_description(d)}))
    return T.StructType(fields)


def field_description(d) -> str:
    """Description given to the extractor; a categorical lists its domain."""
    text = d["description"] or ""
    if d["type"] == "categorical":
        return f"{text} (One of: {', '.join(d['values'] or [])})"
    return text


def field_types(defs: DataFrame) -> DataFrame:
    return defs.select("config_id", "name", "type")


def categorical_domains(defs: DataFrame) -> DataFrame:
    empty = F.array().cast("array<string>")
    return defs.where(F.col("type") == "categorical").select("config_id", "name", F.coalesce("values", empty).alias("values"))


# -- edits -----------------------------------------------------------------------------


def definition_from_proposal(proposals: DataFrame) -> DataFrame:
    """Proposed features as definition rows; missing bounds and domains get their defaults."""
    scale = F.col("feature_type") == "scale"
    choice = F.col("feature_type") == "categorical"
    empty = F.array().cast("array<string>")
    return proposals.select(
        "config_id",
        "pos",
        "name",
        F.col("feature_type").alias("type"),
        F.when(scale, F.coalesce("min_val", F.lit(SCALE_MIN))).alias("min"),
        F.when(scale, F.coalesce("max_val", F.lit(SCALE_MAX))).alias("max"),
        F.when(choice, F.coalesce("values", empty)).alias("values"),
        "description",
    )


def new_only(proposals: DataFrame, defs: DataFrame) -> DataFrame:
    """Proposals whose name the config does not have yet."""
    return proposals.join(defs.select("config_id", "name"), ["config_id", "name"], "left_anti").select(*proposals.columns)


def _first_by_name(rows: DataFrame) -> DataFrame:
    first = rows.groupBy("config_id", "name").agg(F.min("pos").alias("pos"))
    return rows.join(first, ["config_id", "name", "pos"], "left_semi").select(*rows.columns)


def apply_changes(
    defs: DataFrame, removals: DataFrame, proposals: DataFrame, max_swaps: int, suffix: str | None = None
) -> DataFrame:
    """Next version of every config: the first ``max_swaps`` removals out, proposals appended.

    ``removals(config_id, pos, name)`` and ``proposals`` (a definition row each) are numbered
    from 0 per config. A proposal whose name is still present, or came up earlier, is skipped.
    """
    gone = removals.where(F.col("pos") < max_swaps).select("config_id", "name")
    kept = defs.join(gone, ["config_id", "name"], "left_anti").select(*defs.columns)
    fresh = _first_by_name(new_only(proposals.where(F.col("pos") < max_swaps), kept))
    last = defs.groupBy("config_id").agg(F.max("pos").alias("__last"))
    added = fresh.join(last, "config_id").withColumn("pos", F.col("pos") + F.col("__last") + 1).select(*defs.columns)
    out = kept.unionByName(added)
    return out.withColumn("config_id", F.concat("config_id", F.lit(suffix))) if suffix else out


def add_definition(defs: DataFrame, row: DataFrame) -> DataFrame:
    """``defs`` with one more definition at the end of its config; a known name is an error."""
    if not row.join(defs, ["config_id", "name"], "left_semi").isEmpty():
        raise ValueError("a feature of that name already exists")
    last = defs.groupBy("config_id").agg((F.max("pos") + 1).alias("__next"))
    placed = row.join(last, "config_id", "left").withColumn("pos", F.coalesce("__next", F.lit(0)).cast("int"))
    return defs.unionByName(placed.select(*defs.columns))


def remove_definition(defs: DataFrame, name: str) -> DataFrame:
    return defs.where(~F.col("name").eqNullSafe(name))


def get_definition(defs: DataFrame, name: str) -> DataFrame:
    return defs.where(F.col("name") == name)


def tried_names(*tables: DataFrame) -> DataFrame:
    """Every (config_id, name) a session has used, proposed or pruned."""
    out = tables[0].select("config_id", "name")
    for t in tables[1:]:
        out = out.unionByName(t.select("config_id", "name"))
    return out.distinct()


# -- checks and fingerprints -----------------------------------------------------------


def check_definitions(defs: DataFrame) -> DataFrame:
    """Add ``errors``: what is wrong with each definition; empty where nothing is."""
    twice = (
        defs.groupBy("config_id", "name").agg(F.count(F.lit(1)).alias("__c")).where(F.col("__c") > 1).select("config_id", "name", "__c")
    )
    joined = defs.join(twice, ["config_id", "name"], "left")
    t = F.col("type")
    known = F.coalesce(t.isin("scale", "bool", "categorical"), F.lit(False))
    rules = [
        F.when(~known, F.lit("unknown type")),
        F.when((t == "scale") & (F.col("min").isNull() | F.col("max").isNull()), F.lit("scale without bounds")),
        F.when((t == "scale") & (F.col("min") >= F.col("max")), F.lit("scale with empty range")),
        F.when((t == "categorical") & (F.coalesce(F.size("values"), F.lit(0)) <= 0), F.lit("categorical without values")),
        F.when(F.col("__c").isNotNull(), F.lit("duplicate name")),
    ]
    return joined.withColumn("errors", F.array_compact(F.array(*rules))).select(*defs.columns, "errors")


def rendered_definition() -> Column:
    """One definition as a canonical string."""
    return F.concat_ws(
        "|",
        F.col("pos").cast("string"),
        F.coalesce("name", F.lit("")),
        F.coalesce("type", F.lit("")),
        F.coalesce(F.col("min").cast("string"), F.lit("")),
        F.coalesce(F.col("max").cast("string"), F.lit("")),
        F.coalesce(F.array_join("values", ","), F.lit("")),
        F.coalesce("description", F.lit("")),
    )


def config_fingerprint(defs: DataFrame) -> DataFrame:
    """A digest per config of its definitions and their order, the config's name left out.

    Digests of the rows are added up as exact numbers, so partial results merge and no
    config is gathered into one list.
    """
    digest = F.md5(rendered_definition())
    return (
        defs.withColumn("__d", digest)
        .groupBy("config_id")
        .agg(
            F.count(F.lit(1)).alias("__n"),
            F.sum(hex_number(F.col("__d"), 1)).alias("__a"),
            F.sum(hex_number(F.col("__d"), 16)).alias("__b"),
        )
        .select(
            "config_id",
            F.md5(
                F.concat_ws(":", F.col("__n").cast("string"), F.col("__a").cast("string"), F.col("__b").cast("string"))
            ).alias("config_hash"),
        )
    )
