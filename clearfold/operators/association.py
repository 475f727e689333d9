"""Association of features of any type with a label, with each other, and examples of their values."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearfold.operators.ordered import running

LANES = 32  # first level of the sums over tasks
BLOCK = 64  # columns of one row block of the Gram matrices
SHIFT_ROWS = 1000  # rows whose mean the sums are taken around, for precision only
HELD_KEYS = 100_000  # keys whose examples one task holds before it passes them on
EDGES = 256  # chunks of the running counts of one column's values


def _cells(df: DataFrame, columns: Sequence[str], extra: Sequence[Column], kind: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast(kind).alias("value")) for c in columns])
    return df.select(*extra, F.explode(pairs).alias("p")).select("*", "p.*").drop("p")


def label_association(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Per feature: ``n, n_values, n_labels, chi2, cramers_v, mutual_information`` with the label.

    Any type will do; values count as categories. Cramer's V is corrected for bias, mutual
    information is in nats. Rows without the value or the label are left out of a feature. One
    pass counts all contingency cells; margins are sums of the cells.
    """
    rows = _cells(df, columns, [F.col(label).cast("string").alias("label")], "string").where(F.col("label").isNotNull() & F.col("value").isNotNull())
    cells = rows.groupBy("feature", "value", "label").agg(F.count(F.lit(1)).alias("c"))
    by_value = cells.groupBy("feature", "value").agg(F.sum("c").alias("r"))
    by_label = cells.groupBy("feature", "label").agg(F.sum("c").alias("k"))
    sizes = by_value.groupBy("feature").agg(F.sum("r").alias("n"), F.count(F.lit(1)).alias("n_values"))
    kinds = by_label.groupBy("feature").agg(F.count(F.lit(1)).alias("n_labels"))
    full = cells.join(by_value, ["feature", "value"]).join(by_label, ["feature", "label"]).join(sizes, "feature")
    share = F.col("c") / (F.col("r") * F.col("k").cast("double"))
    sums = full.groupBy("feature", "n", "n_values").agg(
        F.sum(F.col("c") * share).alias("s"), F.sum(F.col("c") * F.log(F.col("n") * share)).alias("i")
    ).join(kinds, "feature")
    n, r, k = F.col("n"), F.col("n_values"), F.col("n_labels")
    chi2 = F.greatest(n * (F.col("s") - 1), F.lit(0.0))
    rest = F.nullif(n - 1, F.lit(0))
    phi2 = F.greatest(F.lit(0.0), chi2 / n - (r - 1) * (k - 1) / rest)
    room = F.least(r - (r - 1) * (r - 1) / rest, k - (k - 1) * (k - 1) / rest) - 1
    v = F.when(room > 0, F.least(F.sqrt(phi2 / room), F.lit(1.0))).otherwise(0.0)
    return sums.select("feature", "n", "n_values", "n_labels", chi2.alias("chi2"), v.alias("cramers_v"), F.greatest(F.col("i") / n, F.lit(0.0)).alias("mutual_information"))


def value_examples(df: DataFrame, columns: Sequence[str], label: str, id_col: str = "id", k: int = 3, seed: int = 42) -> DataFrame:
    """``feature, value, label, n, examples``: up to ``k`` ids for every value of a feature under a label.

    The ids with the smallest md5 of seed and id; tasks keep the ``k`` smallest of every key and
    pass them on when they hold many keys, so ``k`` ids per task and key are shuffled, at most.
    Null values and labels are values of their own.
    """
    ident = F.col(id_col).cast("string")
    columns_in = [F.col(label).cast("string").alias("label"), ident.alias("id"), F.md5(F.concat(F.lit(f"{seed}:"), ident)).alias("h")]
    rows = df.select(*columns_in, *[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)])
    names = list(columns)
    ddl = "feature string, value string, label string, n bigint, h string, id string"

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def passed() -> pa.RecordBatch:
            out = [(*key, n if i == 0 else 0, *pair) for key, (n, pairs) in held.items() for i, pair in enumerate(pairs)]
            held.clear()
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, kinds)], names=["feature", "value", "label", "n", "h", "id"])

        for batch in batches:
            labels, ids, hashes = (batch.column(c).to_pylist() for c in ("label", "id", "h"))
            for i, name in enumerate(names):
                groups: dict[tuple, list] = {}
                for value, lab, h, ident_ in zip(batch.column(f"c{i}").to_pylist(), labels, hashes, ids):
                    groups.setdefault((name, value, lab), []).append((h, ident_))
                for key, pairs in groups.items():
                    n, before = held.get(key, (0, []))
                    held[key] = (n + len(pairs), heapq.nsmallest(k, before + pairs, key=lambda p: (p[0] or "", p[1] or "")))
            if len(held) > HELD_KEYS:
                yield passed()
        yield passed()

    pairs = rows.mapInArrow(keep, ddl).groupBy("feature", "value", "label").agg(
        F.sum("n").alias("n"), F.slice(F.sort_array(F.collect_list(F.struct("h", "id"))), 1, k).alias("x")
    )
    return pairs.select("feature", "value", "label", "n", F.array_join("x.id", ",").alias("examples"))


def _lanes(df: DataFrame) -> DataFrame:
    """Sums of equally long arrays of doubles per block, first per lane of tasks, then over the lanes."""
    shape = "block int, lane int, sums binary"

    def add(key, pdf):
        total = np.sum([np.frombuffer(x) for x in pdf["sums"]], axis=0)
        return pd.DataFrame([(key[0], 0, total.tobytes())], columns=["block", "lane", "sums"])

    return df.groupBy("block", "lane").applyInPandas(add, shape).groupBy("block").applyInPandas(add, shape)


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``feature_a, feature_b, n, r`` of every pair of columns, in the order given; one pass, no pair is an expression.

    Each task adds up four Gram matrices of its rows (values, squares and flags of what is known)
    in row blocks; blocks are added up in two levels and turned into pairs where they are. A pair
    uses the rows that have both values; r is null where either side is constant.
    """
    d = len(columns)
    x = F.array(*[F.col(c).cast("double") for c in columns])
    shift = [v or 0.0 for v in df.limit(SHIFT_ROWS).agg(*[F.avg(F.col(c).cast("double")).alias(f"a{i}") for i, c in enumerate(columns)]).first()]
    rows = df.select(x.alias("x"))

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums = np.zeros((4, d, d))
        for batch in batches:
            values = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, d) - shift
            known = (~np.isnan(values)).astype(float)
            values = np.where(known > 0, values, 0.0)
            sums += np.stack([known.T @ known, values.T @ known, (values**2).T @ known, values.T @ values])
        lane = TaskContext.get().partitionId() % LANES
        starts = range(0, d, BLOCK)
        yield pa.RecordBatch.from_pydict({
            "block": pa.array(range(len(starts)), pa.int32()), "lane": pa.array([lane] * len(starts), pa.int32()),
            "sums": [np.ascontiguousarray(sums[:, a : a + BLOCK]).tobytes() for a in starts],
        })

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, sums in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist()):
                whole[block] = np.frombuffer(sums).reshape(4, -1, d)
        for block, (n, s, ss, p) in sorted(whole.items()):
            at = block * BLOCK
            yield pa.RecordBatch.from_pydict({
                "i": pa.array(np.repeat(np.arange(at, at + len(n)), d), pa.int32()), "j": pa.array(np.tile(np.arange(d), len(n)), pa.int32()),
                "n": n.ravel(), "s": s.ravel(), "ss": ss.ravel(), "p": p.ravel(),
            })

    blocks = _lanes(rows.mapInArrow(gram, "block int, lane int, sums binary"))
    cells = blocks.mapInArrow(pairs, "i int, j int, n double, s double, ss double, p double")
    own, other = cells.where(F.col("i") < F.col("j")), cells.where(F.col("i") > F.col("j"))
    mirrored = other.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("s").alias("t"), F.col("ss").alias("tt"))
    both = own.join(mirrored, ["i", "j"])
    n, s, t = F.col("n"), F.col("s"), F.col("t")
    vx, vy = F.col("ss") / n - s / n * (s / n), F.col("tt") / n - t / n * (t / n)
    flat = lambda v, total: v <= 1e-14 * F.greatest(total / n, F.lit(1e-300))
    r = F.when((n > 0) & ~flat(vx, F.col("ss")) & ~flat(vy, F.col("tt")), (F.col("p") / n - s / n * (t / n)) / F.sqrt(vx * vy))
    names = F.lit(list(columns))
    return both.select(F.element_at(names, F.col("i") + 1).alias("feature_a"), F.element_at(names, F.col("j") + 1).alias("feature_b"), n.cast("bigint").alias("n"), r.alias("r"))


def redundant_pairs(df: DataFrame, columns: Sequence[str], limit: float = 0.8) -> DataFrame:
    """Feature pairs with their correlation, and whether it exceeds ``limit`` in size."""
    found = correlations(df, columns)
    return found.select("feature_a", "feature_b", "r", F.coalesce(F.abs("r") > limit, F.lit(False)).alias("redundant"))


def mean_ranks(values: DataFrame, key: str, value: str, n: str) -> DataFrame:
    """Add ``rank`` to distinct values with their counts: the mean rank of a value's rows among those of its key.

    Running counts go over chunks between approximate quantiles of the key's values.
    """
    edges = values.groupBy(F.col(key).alias("__key")).agg(F.percentile_approx(value, [i / EDGES for i in range(1, EDGES)], 10 * EDGES).alias("__edges"))
    cut_up = values.join(edges, F.col(key) == F.col("__key")).withColumn("__at", F.size(F.filter("__edges", lambda e: e < F.col(value)))).drop("__key", "__edges")
    counted = running(cut_up, [key], F.col("__at"), [value], F.col(n), "__ahead").drop("__at")
    return counted.withColumn("rank", F.coalesce("__ahead", F.lit(0)) + (F.col(n) + 1) / 2).drop("__ahead")


def rank_correlation(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Spearman correlation of every feature with a target, ties sharing their mean rank.

    Rows with any gap are left out. One unpivot counts (feature, value, target); the ranks of values
    and of the target are joined to the counts, whatever the number of features.
    """
    whole = df.select(*columns, F.col(target).cast("double").alias("__t")).dropna()
    counted = _cells(whole, columns, [F.col("__t").alias("t")], "double").groupBy("feature", "value", "t").agg(F.count(F.lit(1)).alias("n"))
    values = mean_ranks(counted.groupBy("feature", "value").agg(F.sum("n").alias("m")), "feature", "value", "m")
    targets = whole.groupBy(F.lit(0).alias("__one"), F.col("__t").alias("t")).agg(F.count(F.lit(1)).alias("m"))
    targets = mean_ranks(targets, "__one", "t", "m").select("t", F.col("rank").alias("y"))
    ranked = counted.join(values.select("feature", "value", F.col("rank").alias("x")), ["feature", "value"]).join(targets, "t")
    n, x, y = F.col("n"), F.col("x"), F.col("y")
    sums = ranked.groupBy("feature").agg(
        F.sum(n).alias("n"), F.sum(n * x).alias("sx"), F.sum(n * y).alias("sy"), F.sum(n * x * x).alias("sxx"), F.sum(n * y * y).alias("syy"), F.sum(n * x * y).alias("sxy")
    )
    cov = F.col("sxy") / n - F.col("sx") / n * F.col("sy") / n
    vx, vy = F.col("sxx") / n - F.pow(F.col("sx") / n, 2), F.col("syy") / n - F.pow(F.col("sy") / n, 2)
    named = df.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    return named.join(sums, "feature", "left").select("feature", F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy)).alias("rank_corr"))
