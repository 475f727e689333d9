"""Feature configurations as JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONFIG_DDL = (
    "name string, description string, features array<struct<name:string,type:string,"
    "min:int,max:int,values:array<string>,description:string>>"
)
_FIELDS = ("name", "type", "min", "max", "values", "description")


def configs_to_defs(configs: DataFrame) -> DataFrame:
    """Documents to definition rows; the place in the document becomes ``pos``."""
    exploded = configs.select(F.col("name").alias("config_id"), F.posexplode("features").alias("pos", "f"))
    return exploded.select("config_id", "pos", *[F.col("f")[c].alias(c) for c in _FIELDS])


def defs_to_configs(defs: DataFrame, description: str = "") -> DataFrame:
    """Definition rows to one document row per config."""
    entries = F.sort_array(F.collect_list(F.struct("pos", *_FIELDS)))
    return (
        defs.groupBy(F.col("config_id").alias("name"))
        .agg(entries.alias("e"))
        .select(
            "name",
            F.lit(description).alias("description"),
            F.transform("e", lambda e: F.struct(*[e[c].alias(c) for c in _FIELDS])).alias("features"),
        )
    )


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    return configs_to_defs(spark.read.schema(CONFIG_DDL).option("multiLine", True).json(path))


def write_configs(defs: DataFrame, path: str, description: str = "") -> None:
    defs_to_configs(defs, description).write.mode("overwrite").json(path)
