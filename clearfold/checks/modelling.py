"""Model fits and the end-to-end runs, against optima that SQL reaches on its own way (``fits``). Coefficients and
confidences are rounded to three places on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from clearfold.checks import base as b
from clearfold.checks import fits as ft
from clearfold.checks.base import Check
from clearfold.checks.sampling import split_sql
from clearfold.operators import metrics as m
from clearfold.operators import model as md
from clearfold.operators import sparsefit as sf
from clearfold.operators.ordered import hash_rank
from clearfold.operators.profile import class_counts
from clearfold.operators.sampling import make_splits
from clearfold.plans.feature_run import run, signal_extraction
from clearfold.plans.improvement import Changes, improve
from clearfold.session import cut

N_FOLDS = 5
LINE_FEATURES = ["quantity_level", "discount_level", "line_no", "tax_high", "status"]


def line_records(spark, d):
    """Typed records of every line, keyed by a digest of the whole line."""
    li = b.table(spark, d, "lineitem")
    level = F.least(F.lit(4), F.floor(F.col("l_quantity") / 11)).cast("int") + 1
    price = F.least(F.lit(4), F.floor(F.col("l_discount") * 50)).cast("int") + 1
    return li.select(
        F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in li.columns])).alias("id"),
        level.alias("quantity_level"),
        price.alias("discount_level"),
        F.col("l_linenumber").alias("line_no"),
        (F.col("l_tax") > 0.04).alias("tax_high"),
        F.col("l_linestatus").alias("status"),
        F.when((F.col("l_quantity") + F.length("l_returnflag") + F.col("l_extendedprice") % 37) > 40, "high").otherwise("low").alias("label"),
    )


def _rounded(df, *columns, places=3):
    return df.withColumns({c: F.round(c, places) + F.lit(0.0) for c in columns})


def _shown(coefs):
    return _rounded(m.coefficient_table(coefs), "coefficient", "abs_coef", "odds_ratio")


def _docs(spark, d):
    return b.records(spark, d), b.quality_labels(spark, d)


def _fixed_c(spark, d):
    feats = line_records(spark, d)
    fitted = md.fit_fixed_c(feats, None, LINE_FEATURES)
    return _shown(md.coefficients(fitted, feats))


def _optimality(spark, d):
    """Subgradient conditions of the fit, per column, from one aggregate over all rows."""
    feats = line_records(spark, d)
    fitted = md.fit_fixed_c(feats, None, LINE_FEATURES)
    return _rounded(md.optimality(fitted, feats), "coefficient").select("feature", "coefficient", "optimal")


ORDER_FEATURES = ["price_level", "status", "customer"]


def order_records(spark, d):
    """Records of every order; the customer is a category with thousands of values."""
    o = b.table(spark, d, "orders")
    dear = F.col("o_totalprice") + 100_000 * (F.col("o_custkey") % 3) > 350_000
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.floor(F.col("o_totalprice") / 100_000).cast("int").alias("price_level"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_custkey").cast("string").alias("customer"),
        F.when(dear, "dear").otherwise("cheap").alias("label"),
    )


def _sparse_cells(spark, d):
    """Every cell of the orders' matrix that is not 0, in long form."""
    feats = order_records(spark, d)
    return sf.cells(feats, ORDER_FEATURES, sf.value_tables(feats, ORDER_FEATURES), ["id"])


def _wide_optimality(spark, d):
    """Subgradient conditions of a fit with a column per customer, to a fifth of the L1 limit."""
    feats = order_records(spark, d)
    fitted = md.fit_fixed_c(feats, None, ORDER_FEATURES)
    return md.optimality(fitted, feats, tolerance=0.2 * 0.5 / feats.count()).select("feature", "optimal")


def _nested(spark, d):
    feats, labels = _docs(spark, d)
    e = md.fit_and_evaluate(feats, labels, b.SIGNAL_NAMES)
    rows = [(i, float(x)) for i, x in enumerate(e.fold_scores)]
    return spark.createDataFrame(rows, "fold int, score double")


def _select_c(spark, d):
    feats = line_records(spark, d)
    e = md.fit_and_evaluate(feats, None, LINE_FEATURES, outer=False)
    return _shown(md.coefficients(e.fitted, feats)).withColumn("c", F.lit(e.fitted.c))


def _top_of_model(spark, d):
    feats, labels = _docs(spark, d)
    fitted = md.fit_fixed_c(feats, labels, b.SIGNAL_NAMES)
    return _shown(md.coefficients(fitted, feats))


def _predicted(spark, d):
    feats = line_records(spark, d)
    return _rounded(md.predict(md.fit_fixed_c(feats, None, LINE_FEATURES), feats), "confidence")


def _split_sets(spark, d):
    """Records of a role and fold, and the labels; the texts are read once, for all roles and folds."""
    feats, labels = _docs(spark, d)
    feats = cut(feats.withColumn("id", F.col("id").cast("string")))
    keys = labels.withColumn("id", F.col("id").cast("string"))
    n = keys.count()
    splits = cut(make_splits(keys, "label", n // 5, n // 5, n // 4, N_FOLDS))

    def rows(role, fold=None):
        s = splits.where(F.col("role") == role)
        s = s if fold is None else s.where(F.col("fold") == fold)
        return feats.join(s.select("id"), "id", "left_semi")

    return rows, keys


def _split_evaluation(spark, d):
    """Each rotating training fold scored on the one validation set."""
    rows, keys = _split_sets(spark, d)
    held = rows("validation")
    out = None
    for fold in range(N_FOLDS):
        fitted = md.fit_and_evaluate(rows("train", fold), keys, b.SIGNAL_NAMES, outer=False).fitted
        preds = md.predict(fitted, held).join(keys.withColumnRenamed("label", "true_label"), "id")
        row = m.accuracy_summary(preds).withColumn("train_fold", F.lit(fold))
        out = row if out is None else out.unionByName(row)
    return out


def _test_evaluation(spark, d):
    """The model of the training fold that does best on the validation set, on the test set; the first of equals."""
    rows, keys = _split_sets(spark, d)
    truth, held = keys.withColumnRenamed("label", "true_label"), rows("validation")
    fits = [md.fit_and_evaluate(rows("train", fold), keys, b.SIGNAL_NAMES, outer=False).fitted for fold in range(N_FOLDS)]
    scores = [m.accuracy_summary(md.predict(f, held).join(truth, "id")).first()["accuracy"] for f in fits]
    fitted = fits[scores.index(max(scores))]
    preds = md.predict(fitted, rows("test")).join(keys.withColumnRenamed("label", "true_label"), "id")
    return m.per_class_metrics(preds, class_counts(keys, "label").select(F.col("label").alias("class")))


def _detailed(spark, d):
    feats, labels = _docs(spark, d)
    texts = b.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    return _rounded(md.in_sample_predictions(feats, labels, texts, b.SIGNAL_NAMES), "confidence")


def corpus_of(spark, d):
    docs = b.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("body"))
    labels = b.quality_labels(spark, d).select(F.col("id").cast("string").alias("id"), F.col("label").alias("verdict"))
    return docs.join(labels, "id")


def _run(spark, d):
    report = run(corpus_of(spark, d), b.SIGNAL_DEFS, signal_extraction(b.SIGNALS))
    shown = _rounded(report.coefficients, "coefficient", "abs_coef", "odds_ratio")
    return _rounded(shown.withColumn("cv_accuracy", F.lit(report.evaluation.mean)), "cv_accuracy", places=9)


def planned(context) -> Changes:
    """A fixed plan in place of an analysis service."""
    if context.iteration == 1:
        return Changes(remove=["line_level"], add=[b.SIGNALS[4].definition(), b.SIGNALS[5].definition()])
    return Changes(remove=["has_digit"] if context.iteration == 2 else [])


def _loop(spark, d):
    corpus = corpus_of(spark, d)
    n = corpus.count()
    out = improve(
        corpus, b.SIGNAL_DEFS[:4], signal_extraction(b.SIGNALS), planned, 3, sample_size=n // 4,
        validation_size=n // 5, test_size=n // 5,
    )
    if out.error:
        raise RuntimeError(out.error)
    keep = ["iteration", "train_fold", "train_cv_accuracy", "val_accuracy", "n_train", "n_val", "effective_dimensionality", "is_best"]
    shown = out.history.select(*keep, F.array_join("features_used", ",").alias("features_used"))
    return _rounded(shown.withColumn("test_accuracy", F.lit(out.test_accuracy)), "train_cv_accuracy", "val_accuracy", "test_accuracy", places=9)


def _ablation(spark, d):
    """The full feature set against the sets without one feature each."""
    feats, labels = _docs(spark, d)
    return _rounded(md.ablation(feats, labels, b.SIGNAL_NAMES, b.SIGNAL_NAMES), "cv_accuracy", "cv_std", places=9)


def _slots(spark, d):
    """Slot of every order under its status, from which all fold memberships follow."""
    orders = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("label"))
    n_slots = md.FoldLayout(5, 3).n_slots
    ranked = hash_rank(orders, ["label"], "id", md.SEED, "rank")
    return ranked.select("id", "label", (F.col("rank") % n_slots).cast("int").alias("slot"))


SLOTS = """SELECT o_orderkey AS id, o_orderstatus AS label, CAST((row_number() OVER (PARTITION BY o_orderstatus
  ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1) % 15 AS INTEGER) AS slot FROM orders"""

LINES = """rows AS (SELECT 0 AS grp, md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR),
    CAST(l_linenumber AS VARCHAR), CAST(l_quantity AS VARCHAR), CAST(l_extendedprice AS VARCHAR), CAST(l_discount AS VARCHAR), CAST(l_tax AS VARCHAR),
    l_returnflag, l_linestatus, CAST(l_shipdate AS VARCHAR))) AS id,
  CAST(least(4, floor(l_quantity / 11)) AS INTEGER) + 1 AS quantity_level, CAST(least(4, floor(l_discount * 50)) AS INTEGER) + 1 AS discount_level,
  l_linenumber AS line_no, l_tax > 0.04 AS tax_high, l_linestatus AS status,
  CASE WHEN l_quantity + length(l_returnflag) + l_extendedprice % 37 > 40 THEN 'high' ELSE 'low' END AS label FROM lineitem)"""
LINE_COLUMNS = {c: c for c in LINE_FEATURES[:4]} | {"status_O": "status = 'O'"}
TONGUES = ("french", "german", "other", "spanish")
DOC_COLUMNS = {c: c for c in b.SIGNAL_NAMES[:5]} | {f"tongue_{t}": f"tongue = '{t}'" for t in TONGUES}
DOC_ROWS = f"{b.RECORDS}, {b.QUALITY}, rows AS (SELECT 0 AS grp, r.*, label FROM records r JOIN quality q ON r.id = q.id)"


def _start(rows, columns, positive, **how):
    expressions = [f"CAST({x} AS INTEGER)" for x in columns.values()]
    return f"WITH RECURSIVE {rows}, {ft.slots_sql()}, {ft.collapsed_sql(expressions, positive)}, {ft.fits_sql(len(columns), **how)}"


def _coefs(columns, picked):
    """Coefficient rows of the fits that ``picked`` gives; a category that no labelled row has is no column."""
    names = ", ".join(f"'{c}'" for c in columns)
    known = "WHERE feature NOT LIKE 'tongue%' OR feature IN (SELECT 'tongue_' || tongue FROM rows)" if "tongue_other" in columns else ""
    return f"""listed AS (SELECT p.*, unnest([{names}]) AS feature, unnest(b[1:{len(columns)}]) AS w FROM ({picked}) p),
coefs AS (SELECT *, round(w, 3) + 0.0 AS coefficient, round(abs(w), 3) + 0.0 AS abs_coef, round(exp(w), 3) + 0.0 AS odds_ratio FROM listed {known})"""


FIXED = {"grid": (1.0,), "outer": False, "inner": False}
LINE_FIT = _start(LINES, LINE_COLUMNS, "low", **FIXED)
DOC_FIT = _start(DOC_ROWS, DOC_COLUMNS, "poor", **FIXED)
BEST = "SELECT t.*, h.c AS best_c FROM chosen h JOIN fits t ON t.grp = h.grp AND t.f = h.f AND t.c = h.c AND t.g = -1 WHERE h.f = -1"
OUTER_SCORES = "SELECT s.grp, s.f, s.score FROM scores s JOIN chosen h ON h.grp = s.grp AND h.f = s.f AND h.c = s.c WHERE s.g = -1"
NESTED = f"{_start(DOC_ROWS, DOC_COLUMNS, 'poor')}, {ft.chosen_sql(9)}"


def _scored(n, fits, rows="slotted"):
    """Rows of a group with the chance of the second class under that group's fit."""
    return f"scored AS (SELECT r.*, 1.0 / (1.0 + exp(-({ft.margin_sql(n)}))) AS p FROM (SELECT *, {'{x}'} AS x FROM {rows}) r JOIN ({fits}) t ON t.grp = r.grp)"


def _x(columns):
    return "[" + ", ".join(f"CAST(CAST({e} AS INTEGER) AS DOUBLE)" for e in columns.values()) + "]"


K9 = f"""{LINE_FIT}, {_scored(5, "SELECT * FROM fits").format(x=_x(LINE_COLUMNS))}
SELECT id, CASE WHEN p > 0.5 THEN 'low' ELSE 'high' END AS predicted_label, round(greatest(p, 1 - p), 3) AS confidence FROM scored"""
K14 = f"""{DOC_FIT}, {_scored(9, "SELECT * FROM fits").format(x=_x(DOC_COLUMNS))}
SELECT CAST(s.id AS VARCHAR) AS id, label AS true_label, text, CASE WHEN p > 0.5 THEN 'poor' ELSE 'good' END AS predicted_label,
  round(greatest(p, 1 - p), 3) AS confidence, label = CASE WHEN p > 0.5 THEN 'poor' ELSE 'good' END AS correct,
  {", ".join(f"{c} AS feat_{c}" for c in b.SIGNAL_NAMES)} FROM scored s JOIN documents d ON d.doc_id = s.id"""

# Rows of every training fold as a group of their own; the other roles are scored under each group's fit.
LABELLED = "docs AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS verdict FROM labels)"
SPLIT_ROWS = f"""{b.RECORDS}, {b.QUALITY}, roles AS MATERIALIZED ({split_sql(LABELLED, 5)}),
rows AS (SELECT fold AS grp, r.*, label FROM roles s JOIN records r ON r.id = s.id JOIN quality q ON q.id = s.id WHERE role = 'train')"""
HELD = """(SELECT f.grp, role, r.*, label FROM (SELECT DISTINCT grp FROM rows) f, roles s JOIN records r ON r.id = s.id JOIN quality q ON q.id = s.id
  WHERE role IN ('validation', 'test'))"""
SPLIT_FITS = f"{_start(SPLIT_ROWS, DOC_COLUMNS, 'poor', outer=False)}, {ft.chosen_sql(9)}, {_scored(9, BEST, HELD).format(x=_x(DOC_COLUMNS))}"
GUESSED = ", guessed AS (SELECT *, CASE WHEN p > 0.5 THEN 'poor' ELSE 'good' END AS guess FROM scored)"
K13 = f"""{SPLIT_FITS}{GUESSED}
SELECT count(*) AS n, count(*) FILTER (guess = label) AS n_correct, count(*) FILTER (guess <> label) AS n_wrong,
  count(*) FILTER (guess = label) / count(*) AS accuracy, count(*) FILTER (guess <> label) / count(*) * 100.0::DOUBLE AS pct_wrong, grp AS train_fold
FROM guessed WHERE role = 'validation' GROUP BY grp"""
K15 = f"""{SPLIT_FITS}{GUESSED},
best AS (SELECT grp FROM guessed WHERE role = 'validation' GROUP BY grp ORDER BY count(*) FILTER (guess = label) DESC, grp LIMIT 1),
t AS (SELECT label, guess FROM guessed WHERE role = 'test' AND grp = (SELECT grp FROM best)),
c AS (SELECT class, count(*) FILTER (label = class) AS support, count(*) FILTER (guess = class) AS predicted, count(*) FILTER (label = class AND guess = class) AS hit
  FROM t, (SELECT DISTINCT label AS class FROM quality) GROUP BY class)
SELECT class, CASE WHEN predicted > 0 THEN hit / predicted ELSE 0.0::DOUBLE END AS precision, CASE WHEN support > 0 THEN hit / support ELSE 0.0::DOUBLE END AS recall,
  CASE WHEN predicted + support > 0 THEN 2.0::DOUBLE * hit / (predicted + support) ELSE 0.0::DOUBLE END AS f1, support FROM c"""

# One group per feature that is left out, whose columns are then zero everywhere and get no coefficient.
LEFT_OUT = (None, *b.SIGNAL_NAMES)
ABLATED = f"{b.RECORDS}, {b.QUALITY}, rows AS (SELECT grp, r.*, label FROM range({len(LEFT_OUT)}) v(grp), records r JOIN quality q ON r.id = q.id)"
ABLATED_COLUMNS = {
    c: f"CASE WHEN grp = {next(i for i, f in enumerate(LEFT_OUT) if f and c.startswith(f))} THEN 0 ELSE CAST({x} AS INTEGER) END" for c, x in DOC_COLUMNS.items()
}
P4 = f"""{_start(ABLATED, ABLATED_COLUMNS, 'poor')}, {ft.chosen_sql(9)},
final AS (SELECT c FROM chosen WHERE grp = 0 AND f = -1),
kept AS (SELECT s.grp, s.score FROM scores s JOIN chosen h ON h.grp = s.grp AND h.f = s.f
  WHERE s.g = -1 AND s.c = CASE WHEN s.grp = 0 THEN h.c ELSE (SELECT c FROM final) END)
SELECT [{", ".join(f"'{f}'" if f else "NULL" for f in LEFT_OUT)}][CAST(grp + 1 AS BIGINT)] AS left_out, round(avg(score), 9) + 0.0 AS cv_accuracy,
  round(stddev_pop(score), 9) + 0.0 AS cv_std, (SELECT c FROM final) AS c FROM kept GROUP BY grp"""

# The iterations of the loop as groups: iteration i trains on fold i - 1 with the features that the fixed plan leaves it.
LOOP_SETS = (b.SIGNAL_NAMES[:4], ["comma_level", "length_level", "has_digit", "has_symbol", "tongue"], ["comma_level", "length_level", "has_symbol", "tongue"])
LOOP_ROWS = SPLIT_ROWS.replace("WHERE role = 'train'", f"WHERE role = 'train' AND fold < {len(LOOP_SETS)}")


def _in_use(column, expression):
    groups = ", ".join(str(i) for i, names in enumerate(LOOP_SETS) if any(column == n or column.startswith(f"{n}_") for n in names))
    return f"CASE WHEN grp IN ({groups}) THEN CAST({expression} AS INTEGER) ELSE 0 END"


LOOP_COLUMNS = {c: _in_use(c, x) for c, x in DOC_COLUMNS.items()}
DIMENSIONS = " ".join(f"WHEN {i} THEN {len(names)}" + (" + k - 2" if "tongue" in names else "") for i, names in enumerate(LOOP_SETS))
USED = " ".join(f"WHEN {i} THEN '{','.join(names)}'" for i, names in enumerate(LOOP_SETS))
K17 = f"""{_start(LOOP_ROWS, LOOP_COLUMNS, 'poor')}, {ft.chosen_sql(9)}, {_scored(9, BEST, HELD).format(x=_x(LOOP_COLUMNS))}{GUESSED},
cv AS (SELECT grp, avg(score) AS a FROM ({OUTER_SCORES}) GROUP BY grp),
held AS (SELECT grp, role, count(*) AS n, count(*) FILTER (guess = label) / count(*) AS v FROM guessed GROUP BY grp, role),
val AS (SELECT *, v > coalesce(max(v) OVER (ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS is_best FROM held WHERE role = 'validation'),
best AS (SELECT grp FROM val ORDER BY v DESC, grp LIMIT 1),
seen AS (SELECT grp, count(*) AS n_train, count(DISTINCT tongue) AS k FROM rows GROUP BY grp)
SELECT CAST(val.grp + 1 AS INTEGER) AS iteration, CAST(val.grp AS INTEGER) AS train_fold, round(a, 9) + 0.0 AS train_cv_accuracy, round(v, 9) + 0.0 AS val_accuracy,
  n_train, n AS n_val, CAST(CASE val.grp {DIMENSIONS} END AS INTEGER) AS effective_dimensionality, is_best, CASE val.grp {USED} END AS features_used,
  (SELECT round(h.v, 9) + 0.0 FROM held h WHERE role = 'test' AND grp = (SELECT grp FROM best)) AS test_accuracy
FROM val JOIN cv ON cv.grp = val.grp JOIN seen ON seen.grp = val.grp"""

ORDERS = """o AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(floor(o_totalprice / 100000) AS INTEGER) AS price_level, o_orderstatus AS status,
  CAST(o_custkey AS VARCHAR) AS customer FROM orders)"""
CELLS = f"""WITH {ORDERS} SELECT id, 'price_level' AS name, CAST(price_level AS DOUBLE) AS value FROM o WHERE price_level <> 0
UNION ALL SELECT id, 'status_' || status, 1.0::DOUBLE FROM o WHERE status <> (SELECT min(status) FROM o)
UNION ALL SELECT id, 'customer_' || customer, 1.0::DOUBLE FROM o WHERE customer <> (SELECT min(customer) FROM o)"""
WIDE_COLUMNS = f"""WITH {ORDERS} SELECT 'price_level' AS feature, true AS optimal
UNION ALL SELECT DISTINCT 'status_' || status, true FROM o WHERE status <> (SELECT min(status) FROM o)
UNION ALL SELECT DISTINCT 'customer_' || customer, true FROM o WHERE customer <> (SELECT min(customer) FROM o)"""

COEF_LIST = "feature, coefficient, abs_coef, odds_ratio"
CHECKS = [
    Check("k5_elastic_net_fit", _fixed_c, f"{LINE_FIT}, {_coefs(LINE_COLUMNS, 'SELECT * FROM fits')} SELECT {COEF_LIST} FROM coefs"),
    Check("k5_optimality", _optimality, f"{LINE_FIT}, {_coefs(LINE_COLUMNS, 'SELECT * FROM fits')} SELECT feature, coefficient, true AS optimal FROM coefs"),
    Check("k1_sparse_cells", _sparse_cells, CELLS),
    Check("k5_wide_categories", _wide_optimality, WIDE_COLUMNS),
    Check(
        "k6_select_c",
        _select_c,
        f"""{_start(LINES, LINE_COLUMNS, 'low', outer=False)}, {ft.chosen_sql(5)}, {_coefs(LINE_COLUMNS, BEST)}
SELECT {COEF_LIST}, best_c AS c FROM coefs""",
    ),
    Check("k7_nested_cross_validation", _nested, f"{NESTED} SELECT CAST(f AS INTEGER) AS fold, score FROM ({OUTER_SCORES})"),
    Check("k8_coefficient_table", _top_of_model, f"{DOC_FIT}, {_coefs(DOC_COLUMNS, 'SELECT * FROM fits')} SELECT {COEF_LIST} FROM coefs"),
    Check("k9_predictions", _predicted, K9),
    Check("k13_split_evaluation", _split_evaluation, K13),
    Check("k14_detailed_predictions", _detailed, K14),
    Check("k15_test_evaluation", _test_evaluation, K15),
    Check(
        "k16_feature_run",
        _run,
        f"""{NESTED}, {_coefs(DOC_COLUMNS, BEST)}
SELECT {COEF_LIST}, (SELECT round(avg(score), 9) + 0.0 FROM ({OUTER_SCORES})) AS cv_accuracy FROM coefs""",
    ),
    Check("k17_improvement_loop", _loop, K17),
    Check("p4_ablation", _ablation, P4),
    Check("k7_fold_slots", _slots, SLOTS),
]
