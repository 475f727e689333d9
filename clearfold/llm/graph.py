"""Connected components of a table of links, with Spark joins and written tables between the rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearfold.llm.common import attach
from clearfold.session import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _stars(edges: DataFrame) -> DataFrame:
    """Of every node, its links and the least node it is linked with (``m``)."""
    least = cut(edges.groupBy("u").agg(F.min("v").alias("least")))
    return attach(edges, least, ["u"]).select("u", "v", F.least("u", "least").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the least node reachable) of every linked node; ``links`` has ``a`` and ``b``.

    Alternates two contractions until nothing changes: every node links its larger neighbours
    to its least one, then its smaller neighbours and itself. The result is one star per
    component. Null nodes and self links are ignored; without links the result is empty.
    """
    edges = cut(
        links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = _state(edges)
    while before[0]:
        both = cut(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = cut(_stars(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = _stars(large)
        pairs = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = cut(pairs.where(F.col("u") != F.col("v")).distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
