"""Draws, splits and folds. Sizes are shares of the table, so the work grows with it."""

from __future__ import annotations

from pyspark.sql import functions as F

from clearfold.checks import base as b
from clearfold.checks.base import Check
from clearfold.operators import sampling as sp
from clearfold.operators.ordered import hash_head


def _docs(spark, d):
    """Every labelled document with its four-way label."""
    return b.four_labels(spark, d).where(F.col("verdict").isNotNull()).withColumnRenamed("doc_id", "id")


DOCS = b.FOUR_LABELS + ",\ndocs AS (SELECT doc_id AS id, verdict FROM four WHERE verdict IS NOT NULL)"


def _lines(spark, d):
    """Orders labelled by status: three strata over a table that grows with the scale."""
    return b.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("verdict"))


ORDERS = "docs AS (SELECT o_orderkey AS id, o_orderstatus AS verdict FROM orders)"


def _n(df, share: int) -> int:
    return df.count() // share


def h(seed, ident: str = "id") -> str:
    return f"md5('{seed}:' || CAST({ident} AS VARCHAR))"


def strat_sql(source: str, size: str, seed: int, name: str) -> str:
    """CTEs for a proportional draw of ``size`` rows from ``source``."""
    return f"""{name}_r AS (SELECT *, {h(seed)} AS h, row_number() OVER (PARTITION BY verdict ORDER BY {h(seed)}, id) AS rn,
  count(*) OVER (PARTITION BY verdict) AS nc, count(*) OVER () AS na FROM {source}),
{name}_d AS (SELECT *, row_number() OVER (ORDER BY h, id) AS ra FROM {name}_r WHERE rn <= greatest(1, floor({size} * nc / na))),
{name} AS (SELECT id, verdict FROM {name}_d WHERE ra <= {size})"""


def _uniform(spark, d):
    docs = _lines(spark, d)
    return sp.uniform_sample(docs, int(_n(docs, 10) * 1.5))


def _trim(spark, d):
    docs = _docs(spark, d)
    return sp.stratified_trim(docs, "verdict", _n(docs, 4))


def _start_trim(spark, d):
    docs = _lines(spark, d)
    return sp.stratified_trim(docs, "verdict", _n(docs, 5), seed=7)


def _sample(spark, d):
    docs = _docs(spark, d)
    return sp.stratified_sample(docs, "verdict", _n(docs, 3))


def _split(spark, d):
    docs = _lines(spark, d)
    rest, split = sp.stratified_split(docs, "verdict", _n(docs, 5))
    return rest.withColumn("part", F.lit("rest")).unionByName(split.withColumn("part", F.lit("split")))


def split_roles(spark, d):
    docs = _docs(spark, d)
    n = docs.count()
    return sp.make_splits(docs, "verdict", n // 5, n // 10, n // 4, 5)


def split_sql(docs: str = DOCS, held_out: int = 10) -> str:
    """Roles of ``docs(id, verdict)``: a fifth for the test, one ``held_out``-th for validation, a quarter in each training fold."""
    folds = "(SELECT count(*) FROM docs) // 4"
    return f"""WITH {docs}, {strat_sql("docs", "((SELECT count(*) FROM docs) // 5)", 42, "test")},
rest AS (SELECT * FROM docs WHERE id NOT IN (SELECT id FROM test)),
{strat_sql("rest", f"((SELECT count(*) FROM docs) // {held_out})", 43, "val")},
pool AS (SELECT * FROM rest WHERE id NOT IN (SELECT id FROM val)),
wide AS (SELECT id, verdict, CAST(fold AS INTEGER) AS fold, md5(CAST(100 + fold AS VARCHAR) || ':' || CAST(id AS VARCHAR)) AS h
  FROM pool, range(5) r(fold)),
fr AS (SELECT *, row_number() OVER (PARTITION BY fold, verdict ORDER BY h, id) AS rn,
  count(*) OVER (PARTITION BY fold, verdict) AS nc, count(*) OVER (PARTITION BY fold) AS na FROM wide),
fd AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY h, id) AS ra FROM fr WHERE rn <= greatest(1, floor({folds} * nc / na)))
SELECT id, verdict, 'test' AS role, CAST(NULL AS INTEGER) AS fold FROM test
UNION ALL SELECT id, verdict, 'validation', NULL FROM val
UNION ALL SELECT id, verdict, 'train_pool', NULL FROM pool
UNION ALL SELECT id, verdict, 'train', fold FROM fd WHERE ra <= {folds}"""


def _broad(spark, d):
    pool = split_roles(spark, d).where(F.col("role") == "train_pool").select("id", "verdict")
    return sp.stratified_sample(pool, "verdict", min(200, pool.count()), seed=sp.SEED_BROAD)


def _sides(spark, d):
    preds = b.predictions(spark, d).withColumn("correct", F.col("true_label") == F.col("predicted_label"))
    return hash_head(preds.select("id", "correct"), "id", 42, 5, per=["correct"])


def _complement(spark, d):
    docs = b.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    taken = b.table(spark, d, "labels").where(F.col("quality") == 1).select(F.col("doc_id").alias("id"))
    return sp.without(docs, taken)


CHECKS = [
    Check(
        "g1_uniform_sample",
        _uniform,
        f"""WITH {ORDERS}, r AS (SELECT *, row_number() OVER (ORDER BY {h(42)}, id) AS rn FROM docs)
SELECT id, verdict FROM r WHERE rn <= floor((SELECT count(*) FROM docs) // 10 * 1.5)""",
    ),
    Check(
        "g2_stratified_trim",
        _trim,
        f"WITH {DOCS}, {strat_sql('docs', '((SELECT count(*) FROM docs) // 4)', 42, 'k')} SELECT * FROM k",
    ),
    Check(
        "g3_start_sample",
        _start_trim,
        f"WITH {ORDERS}, {strat_sql('docs', '((SELECT count(*) FROM docs) // 5)', 7, 'k')} SELECT * FROM k",
    ),
    Check(
        "g4_stratified_sample",
        _sample,
        f"WITH {DOCS}, {strat_sql('docs', '((SELECT count(*) FROM docs) // 3)', 42, 'k')} SELECT * FROM k",
    ),
    Check(
        "g5_stratified_split",
        _split,
        f"""WITH {ORDERS}, {strat_sql('docs', '((SELECT count(*) FROM docs) // 5)', 42, 'k')}
SELECT id, verdict, 'split' AS part FROM k UNION ALL SELECT id, verdict, 'rest' FROM docs WHERE id NOT IN (SELECT id FROM k)""",
    ),
    Check("g6_split_roles", split_roles, split_sql()),
    Check("g7_right_and_wrong_rows", _sides, f"""WITH {b.PREDICTIONS}, c AS (SELECT id, true_label = predicted_label AS correct FROM preds)
SELECT id, correct FROM (SELECT *, row_number() OVER (PARTITION BY correct ORDER BY {h(42)}, id) AS rn FROM c) WHERE rn <= 5"""),
    Check(
        "g8_broad_sample",
        _broad,
        f"""WITH roles AS ({split_sql()}), p AS (SELECT id, verdict FROM roles WHERE role = 'train_pool'),
{strat_sql('p', "least(200, (SELECT count(*) FROM p))", 2026, 'k')} SELECT * FROM k""",
    ),
    Check(
        "c5_complement_split",
        _complement,
        """SELECT doc_id AS id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""",
    ),
    Check(
        "e2_kfold_assignment",
        lambda s, d: sp.kfold(_lines(s, d), "verdict", 5),
        f"""WITH {ORDERS} SELECT id, verdict, CAST((row_number() OVER (PARTITION BY verdict ORDER BY {h(42)}, id) - 1) % 5 AS INTEGER) AS fold FROM docs""",
    ),
    Check(
        "e5_rotating_fold",
        lambda s, d: b.history(s, d).select("iteration", sp.rotating_fold(F.col("iteration"), 5).alias("fold")),
        "SELECT o_orderkey AS iteration, ((o_orderkey - 1) % 5 + 5) % 5 AS fold FROM orders",
    ),
]
