"""Hash-derived keys: random-looking orders, cache keys and fingerprints.

A draw "at random" is a prefix of the order by md5(seed:id). The order does not depend
on partitioning, so a lost executor or another cluster size gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_order(seed: int | Column, id_col: str | Column) -> Column:
    ident = F.col(id_col) if isinstance(id_col, str) else id_col
    seed_col = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat(seed_col, F.lit(":"), ident.cast("string")))


def cache_key(config_hash: str | Column, text: Column) -> Column:
    """Key of one text under one feature configuration."""
    scope = config_hash if isinstance(config_hash, Column) else F.lit(config_hash)
    return F.md5(F.concat(scope, F.lit(":"), text))


def hex_number(digest: Column, start: int, width: int = 15) -> Column:
    """``width`` hex digits of a digest as an exact decimal (15 digits fit a long)."""
    return F.conv(F.substring(digest, start, width), 16, 10).cast("decimal(38,0)")
