"""Stand-in views over the given tables, in Spark and in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearfold.operators.extraction import Signal, extract_signals
from clearfold.session import shared_dir


@dataclass(frozen=True)
class Check:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the checkpoints, for queries that write and read back."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# -- posts and comments ----------------------------------------------------------------

WORDS = ("the", "of", "and", "is", "la", "que", "der", "un")
WORDS_SQL = r"(?:^|[^\p{L}\p{N}_])(the|of|and|is|la|que|der|un)(?:$|[^\p{L}\p{N}_])"
TITLE_PATTERNS = (r"Rule \p{Nd}+", r"Welcome to", r"^Is ", r"und d", r"Meta")
TITLE_SQL = r"Rule \p{Nd}+|Welcome to|^Is |und d|Meta"


def posts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("post_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("body"),
        (F.col("n_chars") % 100).alias("score"),
    )


POSTS = """posts AS (SELECT doc_id AS post_id, split_part(text, chr(10), 1) AS title, text AS body,
  n_chars % 100 AS score FROM documents)"""


def comments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("post_id"),
        F.col("turn").alias("comment_id"),
        F.col("text").alias("message"),
        (F.length("text") % 50 - 10).cast("bigint").alias("score"),
    )


COMMENTS = """comments AS (SELECT conv_id AS post_id, turn AS comment_id, text AS message,
  CAST(length(text) % 50 - 10 AS BIGINT) AS score FROM conversations)"""


def event_votes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("user_id").alias("post_id"),
        F.col("event_id").alias("comment_id"),
        F.col("event_type").alias("label"),
        F.col("value").cast("decimal(18,2)").alias("score"),
    )


EVENT_VOTES = """votes AS (SELECT user_id AS post_id, event_id AS comment_id, event_type AS label,
  CAST(value AS DECIMAL(18,2)) AS score FROM events)"""

LINE_ORDER = ("l_extendedprice", "l_linenumber", "l_partkey", "l_suppkey")


def line_votes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("post_id"),
        F.col("l_returnflag").alias("label"),
        (F.col("l_quantity") - 10).cast("bigint").alias("score"),
        *LINE_ORDER,
    )


LINE_VOTES = """votes AS (SELECT l_orderkey AS post_id, l_returnflag AS label,
  CAST(l_quantity - 10 AS BIGINT) AS score, l_extendedprice, l_linenumber, l_partkey, l_suppkey FROM lineitem)"""


def four_labels(spark: SparkSession, d: str) -> DataFrame:
    """Every document with a label of four, null where it has none."""
    q, t = F.col("quality"), F.col("toxic")
    name = (
        F.when((q == 1) & (t == 0), "NTA").when((q == 0) & (t == 0), "YTA").when((q == 1) & (t == 1), "NAH")
        .when((q == 0) & (t == 1), "ESH")
    )
    docs = table(spark, d, "documents").select("doc_id")
    return docs.join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", name.alias("verdict"))


FOUR_LABELS = """four AS (SELECT d.doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'NTA' WHEN quality = 0 AND toxic = 0 THEN 'YTA'
  WHEN quality = 1 AND toxic = 1 THEN 'NAH' WHEN quality = 0 AND toxic = 1 THEN 'ESH' END AS verdict
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

# -- records read off the documents ----------------------------------------------------

SIGNALS = (
    Signal("comma_level", "scale", ",", every=5),
    Signal("length_level", "scale", None, every=400),
    Signal("line_level", "scale", "\n", every=3),
    Signal("has_digit", "bool", "[0-9]"),
    Signal("has_symbol", "bool", "[@#%&*]"),
    Signal(
        "tongue",
        "categorical",
        choices=(
            ("english", " (the|and|of) "),
            ("french", " (le|les|des) "),
            ("german", " (der|und|das) "),
            ("spanish", " (el|los|que) "),
        ),
    ),
)
SIGNAL_NAMES = [s.name for s in SIGNALS]
SIGNAL_DEFS = [s.definition() for s in SIGNALS]


def records(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return extract_signals(docs, SIGNALS, "text").drop("text")


RECORDS = """records AS (SELECT doc_id AS id,
  CAST(1 + least(4, floor((length(text) - length(replace(text, ',', ''))) / 5)) AS INTEGER) AS comma_level,
  CAST(1 + least(4, floor(length(text) / 400)) AS INTEGER) AS length_level,
  CAST(1 + least(4, floor((length(text) - length(replace(text, chr(10), ''))) / 3)) AS INTEGER) AS line_level,
  regexp_matches(text, '[0-9]') AS has_digit,
  regexp_matches(text, '[@#%&*]') AS has_symbol,
  CASE WHEN regexp_matches(text, ' (the|and|of) ') THEN 'english' WHEN regexp_matches(text, ' (le|les|des) ') THEN 'french'
    WHEN regexp_matches(text, ' (der|und|das) ') THEN 'german' WHEN regexp_matches(text, ' (el|los|que) ') THEN 'spanish'
    ELSE 'other' END AS tongue
  FROM documents)"""


def quality_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select(
        F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "good").otherwise("poor").alias("label")
    )


QUALITY = """quality AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS label FROM labels)"""


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """A fixed rule's predictions for the labelled documents."""
    joined = records(spark, d).join(quality_labels(spark, d), "id")
    pred = F.when((F.col("length_level") > 1) & ~F.col("has_symbol"), "good").otherwise("poor")
    conf = (F.lit(0.5) + F.col("comma_level") * F.lit(0.09)).cast("double")
    return joined.select("id", F.col("label").alias("true_label"), pred.alias("predicted_label"), conf.alias("confidence"))


PREDICTIONS = (
    RECORDS
    + ",\n"
    + QUALITY
    + """,
preds AS (SELECT r.id, label AS true_label, CASE WHEN length_level > 1 AND NOT has_symbol THEN 'good' ELSE 'poor' END AS predicted_label,
  CAST(0.5 AS DOUBLE) + comma_level * CAST(0.09 AS DOUBLE) AS confidence FROM records r JOIN quality q ON r.id = q.id)"""
)


def line_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Three-class predictions of a fixed rule on the largest table."""
    q = F.col("l_quantity")
    pred = F.when(q <= 20, "A").when(q <= 35, "N").otherwise("R")
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("true_label"), pred.alias("predicted_label"))


LINE_PREDICTIONS = """preds AS (SELECT l_returnflag AS true_label,
  CASE WHEN l_quantity <= 20 THEN 'A' WHEN l_quantity <= 35 THEN 'N' ELSE 'R' END AS predicted_label FROM lineitem)"""

# -- configurations, usage, coefficients, history --------------------------------------


def definitions(spark: SparkSession, d: str) -> DataFrame:
    """Twelve definitions per configuration, read off the parts."""
    p = table(spark, d, "part")
    size, slot = F.col("p_size"), (F.col("p_partkey") % 12)
    kind = (
        F.when(size % 5 == 0, "bool").when(size % 5 == 1, "categorical").when(size % 11 == 9, "text").otherwise("scale")
    )
    return p.select(
        F.concat(F.lit("c"), F.floor(F.col("p_partkey") / 12).cast("string")).alias("config_id"),
        slot.cast("int").alias("pos"),
        F.concat_ws("_", F.split("p_name", " ")[1], (size % 7).cast("string")).alias("name"),
        kind.alias("type"),
        F.when((kind == "scale") & (size % 13 != 0), F.lit(1)).alias("min"),
        F.when(kind == "scale", (size % 6).cast("int")).alias("max"),
        F.when(kind == "categorical", F.transform(F.sequence(F.lit(0), (size % 9).cast("int")), lambda x: F.concat(F.lit("v"), x.cast("string")))).alias("values"),
        F.col("p_type").alias("description"),
    )


DEFINITIONS = """raw_defs AS (SELECT *, CASE WHEN p_size % 5 = 0 THEN 'bool' WHEN p_size % 5 = 1 THEN 'categorical'
  WHEN p_size % 11 = 9 THEN 'text' ELSE 'scale' END AS kind FROM part),
defs AS (SELECT 'c' || CAST(p_partkey // 12 AS VARCHAR) AS config_id, CAST(p_partkey % 12 AS INTEGER) AS pos,
  split_part(p_name, ' ', 2) || '_' || CAST(p_size % 7 AS VARCHAR) AS name, kind AS type,
  CASE WHEN kind = 'scale' AND p_size % 13 <> 0 THEN 1 END AS min,
  CASE WHEN kind = 'scale' THEN CAST(p_size % 6 AS INTEGER) END AS max,
  CASE WHEN kind = 'categorical' THEN list_transform(range(0, (p_size % 9) + 1), lambda x: 'v' || CAST(x AS VARCHAR)) END AS values,
  p_type AS description FROM raw_defs)"""


def proposals(spark: SparkSession, d: str) -> DataFrame:
    """Twelve proposed features per configuration, read off the same parts under other rules."""
    size = F.col("p_size")
    return table(spark, d, "part").select(
        F.concat(F.lit("c"), F.floor(F.col("p_partkey") / 12).cast("string")).alias("config_id"),
        (F.col("p_partkey") % 12).cast("int").alias("pos"),
        F.concat_ws("_", F.split("p_name", " ")[1], (size % 9).cast("string")).alias("name"),
        F.when(size % 3 == 0, "scale").when(size % 3 == 1, "bool").otherwise("categorical").alias("feature_type"),
        F.col("p_brand").alias("description"),
        F.when(size % 2 == 0, F.lit(2)).alias("min_val"),
        F.when(size % 4 == 0, F.lit(7)).alias("max_val"),
        F.when(size % 5 != 0, F.array(F.lit("x"), F.lit("y"), F.lit("z"))).alias("values"),
    )


PROPOSALS = """proposals AS (SELECT 'c' || CAST(p_partkey // 12 AS VARCHAR) AS config_id, CAST(p_partkey % 12 AS INTEGER) AS pos,
  split_part(p_name, ' ', 2) || '_' || CAST(p_size % 9 AS VARCHAR) AS name,
  CASE WHEN p_size % 3 = 0 THEN 'scale' WHEN p_size % 3 = 1 THEN 'bool' ELSE 'categorical' END AS feature_type,
  p_brand AS description, CASE WHEN p_size % 2 = 0 THEN 2 END AS min_val, CASE WHEN p_size % 4 = 0 THEN 7 END AS max_val,
  CASE WHEN p_size % 5 <> 0 THEN ['x', 'y', 'z'] END AS values FROM part)"""


def usage(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 8
    name = (
        F.when(k == 0, "gpt-5-mini").when(k == 1, "gpt-5").when(k == 2, "gpt-5.2").when(k == 3, "gpt-5.2-pro")
        .when(k == 4, "gpt-4o-mini").when(k == 5, "gpt-4o").otherwise("unlisted")
    )
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        name.alias("model"),
        F.floor("o_totalprice").alias("input_tokens"),
        F.col("o_custkey").alias("output_tokens"),
    )


USAGE = """usage AS (SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN 'gpt-5-mini' WHEN 1 THEN 'gpt-5' WHEN 2 THEN 'gpt-5.2'
  WHEN 3 THEN 'gpt-5.2-pro' WHEN 4 THEN 'gpt-4o-mini' WHEN 5 THEN 'gpt-4o' ELSE 'unlisted' END AS model,
  CAST(floor(o_totalprice) AS BIGINT) AS input_tokens, o_custkey AS output_tokens FROM orders),
prices(model, input_price, output_price) AS (VALUES ('gpt-5-mini', 0.25::DOUBLE, 2.0::DOUBLE), ('gpt-5', 1.25, 10.0),
  ('gpt-5.2', 1.75, 14.0), ('gpt-5.2-pro', 21.0, 168.0), ('gpt-4o-mini', 0.15, 0.6), ('gpt-4o', 2.5, 10.0)),
priced AS (SELECT u.*, coalesce(p.input_price, 0.25) AS input_price, coalesce(p.output_price, 2.0) AS output_price
  FROM usage u LEFT JOIN prices p ON u.model = p.model)"""


def coefs(spark: SparkSession, d: str) -> DataFrame:
    value = (F.col("p_size") % 41 - 20) / F.lit(8.0)
    return table(spark, d, "part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("feature"), value.alias("coefficient"))


COEFS = """coefs AS (SELECT 'f' || CAST(p_partkey AS VARCHAR) AS feature, (p_size % 41 - 20) / 8.0::DOUBLE AS coefficient FROM part)"""


def history(spark: SparkSession, d: str) -> DataFrame:
    """One session per customer, one iteration per order."""
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("session"),
        F.col("o_orderkey").alias("iteration"),
        (F.floor(F.col("o_totalprice") / 10000) / F.lit(64.0)).alias("val_accuracy"),
    )


HISTORY = """history AS (SELECT o_custkey AS session, o_orderkey AS iteration,
  floor(o_totalprice / 10000) / 64.0::DOUBLE AS val_accuracy FROM orders)"""
