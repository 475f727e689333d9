"""Feature matrices, run results and iteration history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HISTORY_DDL = (
    "iteration int, timestamp string, train_fold int, features_used array<string>, train_cv_accuracy double, "
    "train_cv_std double, val_accuracy double, n_train bigint, n_val bigint, n_nonzero int, regularization_c double, "
    "effective_dimensionality int, dimensionality_budget int, estimated_dimensionality int, "
    "auto_removed array<string>, "
    "per_class_metrics array<struct<class:string,precision:double,recall:double,f1:double,support:bigint>>, "
    "extraction_cost double, features_removed array<string>, "
    "features_added array<struct<name:string,feature_type:string>>, is_best boolean, "
    "macro_f1 double, p_value double, reverted boolean"
)


def write_features(df: DataFrame, path: str, run_id: str) -> None:
    """Append the feature matrix of one run; a run is one partition of the table."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def read_features(spark: SparkSession, path: str, run_id: str, schema: T.StructType | str | None = None) -> DataFrame:
    """The matrix of one run; only its partition is listed and read."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{path}/run_id={run_id}")


def _plain(field: T.StructField):
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(field.name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(field.name)
    if isinstance(field.dataType, (T.DateType, T.DecimalType)):
        return F.col(field.name).cast("string").alias(field.name)
    return F.col(field.name)


def write_results(df: DataFrame, path: str, run_id: str) -> None:
    """Append result rows as JSON; values JSON has no type for become strings."""
    plain = df.select(*[_plain(f) for f in df.schema.fields])
    plain.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").json(path)


def read_results(spark: SparkSession, path: str, run_id: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(f"{path}/run_id={run_id}")


def append_history(df: DataFrame, path: str, session_id: str) -> None:
    df.withColumn("session_id", F.lit(session_id)).write.mode("append").partitionBy("session_id").parquet(path)


def read_history(spark: SparkSession, path: str, session_id: str) -> DataFrame:
    """The iterations of one session, in no order; columns that older sessions lack are null."""
    return spark.read.schema(HISTORY_DDL).parquet(f"{path}/session_id={session_id}")
