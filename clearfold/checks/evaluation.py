"""Matrices, prediction tables, metrics, cost and history."""

from __future__ import annotations

from pyspark.sql import functions as F

from clearfold.checks import base as b
from clearfold.checks.base import Check
from clearfold.operators import association as assoc
from clearfold.operators import matrix as mx
from clearfold.operators import metrics as m
from clearfold.operators import resampling as rsm
from clearfold.operators.ordered import hash_head
from clearfold.operators.profile import class_counts
from clearfold.operators.sampling import kfold
from clearfold.sources import results as rs


def rounded(df, digits=9):
    cols = [F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields]
    return df.select(*cols)


# -- matrices --------------------------------------------------------------------------


def _labelled(spark, d):
    return mx.join_labels(b.records(spark, d), b.quality_labels(spark, d))


LABELLED = f"""{b.RECORDS}, {b.QUALITY}, labelled AS (SELECT CAST(r.id AS VARCHAR) AS id, r.* EXCLUDE (id), label
  FROM records r JOIN quality q ON r.id = q.id)"""


def _aligned(spark, d):
    texts = b.table(spark, d, "documents").where(F.col("lang") != "es").select(F.col("doc_id").alias("id"), "text")
    return mx.align(b.records(spark, d), b.quality_labels(spark, d), texts).select("id", "label", "tongue", "text")


def _one_hot(spark, d):
    """Matrix of every document under the vocabulary of the labelled ones."""
    vocab = mx.fit_vocabulary(_labelled(spark, d), b.SIGNAL_NAMES)
    return mx.encode(b.records(spark, d), b.SIGNAL_NAMES, vocab)


def _one_hot_own(spark, d):
    """Matrix of the documents whose categories come from the language column."""
    docs = b.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "n_chars", "lang")
    return mx.encode(docs, ["n_chars", "lang"], mx.fit_vocabulary(docs, ["lang"]))


def _aligned_columns(spark, d):
    """A matrix of German and Spanish documents under the columns of all languages, and one more."""
    docs = b.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "n_chars", "lang")
    train = mx.encoded_columns(["n_chars", "lang"], mx.fit_vocabulary(docs, ["lang"]))
    part = docs.where(F.col("lang").isin("de", "es")).withColumn("extra", F.lit(1))
    own = mx.encode(part, ["n_chars", "lang", "extra"], mx.fit_vocabulary(part, ["lang"]))
    return mx.align_columns(own, train)



def _gappy(spark, d):
    """Line numbers with gaps where a line is heavily discounted."""
    li = b.table(spark, d, "lineitem")
    keep = F.col("l_discount") < 0.09
    return li.select(
        *[F.when(keep, F.col(c)).alias(c) for c in ("l_quantity", "l_linenumber")],
        (F.col("l_tax") * 100).cast("int").alias("tax_pct"),
        F.lit(3).alias("constant"),
    )


GAPPY = """gappy AS (SELECT CASE WHEN l_discount < 0.09 THEN l_quantity END AS l_quantity,
  CASE WHEN l_discount < 0.09 THEN l_linenumber END AS l_linenumber, CAST(trunc(l_tax * 100) AS INTEGER) AS tax_pct, 3 AS constant FROM lineitem)"""
GAPPY_COLS = ["l_quantity", "l_linenumber", "tax_pct", "constant"]


def _stats_sql() -> str:
    parts = []
    for c in GAPPY_COLS:
        parts.append(
            f"SELECT '{c}' AS \"column\", CAST(median({c}) AS DOUBLE) AS median, avg(coalesce({c}, (SELECT median({c}) FROM gappy))) AS mean,"
            f" stddev_pop(coalesce({c}, (SELECT median({c}) FROM gappy))) AS std FROM gappy"
        )
    return " UNION ALL ".join(parts)


SCALED = ["comma_level", "length_level", "line_level"]


def _impute_scale(spark, d):
    """Standardised levels of every document, fitted on the labelled ones only."""
    r = b.records(spark, d).select("id", *SCALED)
    train = r.join(b.quality_labels(spark, d), "id", "left_semi")
    return rounded(mx.impute_scale(r, mx.fit_scaler(train, SCALED), SCALED), 6)


def _scaled_sql() -> str:
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in SCALED)
    cols = ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in SCALED)
    return f"""WITH {b.RECORDS}, s AS (SELECT {stats} FROM records WHERE id IN (SELECT doc_id FROM labels)) SELECT id, {cols} FROM records, s"""


def _single_class(spark, d):
    only = _labelled(spark, d).where(F.col("label") == "good")
    return mx.single_class_predictions(only.select("id", "label"), "label")


def _features_round_trip(spark, d):
    path = b.scratch(spark, "features")
    r = b.records(spark, d)
    rs.write_features(r, path, "run_a")
    rs.write_features(r.where(F.col("has_digit")), path, "run_b")
    return rs.read_features(spark, path, "run_b", r.schema)


def _results_round_trip(spark, d):
    path = b.scratch(spark, "results")
    orders = b.table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    rs.write_results(orders, path, "run_a")
    return rs.read_results(spark, path, "run_a", "o_orderkey bigint, o_totalprice double, o_orderdate string")


def _history_round_trip(spark, d):
    path = b.scratch(spark, "history")
    h = b.history(spark, d)
    rows = h.select(
        F.col("iteration").cast("int").alias("iteration"), "val_accuracy", (F.col("session") % 5).cast("int").alias("train_fold"),
        F.array(F.lit("a"), F.lit("b")).alias("features_removed"),
        F.array(F.struct(F.lit("c").alias("name"), F.lit("bool").alias("feature_type"))).alias("features_added"),
    )
    rs.append_history(rows, path, "s1")
    return m.with_changes(rs.read_history(spark, path, "s1")).select("iteration", "val_accuracy", "train_fold", "changes")


# -- predictions -----------------------------------------------------------------------


def _with_texts(spark, d):
    texts = b.table(spark, d, "documents").where(F.col("lang") != "de").select(F.col("doc_id").alias("id"), "text")
    return m.attach_texts(b.predictions(spark, d).select("id", "predicted_label"), texts)


def _with_features(spark, d):
    raw = b.records(spark, d).where(F.col("tongue") != "german").select("id", "comma_level", "has_digit")
    return m.attach_features(b.predictions(spark, d).select("id", "predicted_label"), raw)


def _line_classes(spark):
    """The classes of the training map; Z never occurs in the data but is still listed."""
    return spark.createDataFrame([("A",), ("N",), ("R",), ("Z",)], "class string")


def _per_class(spark, d):
    return rounded(m.per_class_metrics(b.line_predictions(spark, d), _line_classes(spark)))


PER_CLASS = f"""WITH {b.LINE_PREDICTIONS}, c("class") AS (VALUES ('A'), ('N'), ('R'), ('Z')),
s AS (SELECT "class", count(*) FILTER (true_label = "class") AS sup, count(*) FILTER (predicted_label = "class") AS prd,
  count(*) FILTER (true_label = "class" AND predicted_label = "class") AS hit FROM c, preds GROUP BY "class"),
k AS (SELECT "class", CASE WHEN prd > 0 THEN hit / prd ELSE 0.0::DOUBLE END AS p, CASE WHEN sup > 0 THEN hit / sup ELSE 0.0::DOUBLE END AS r, sup FROM s)
SELECT "class", round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0::DOUBLE END, 9) AS f1, sup AS support FROM k"""


def _paired(spark, d):
    """Two fixed rules compared on the same lines."""
    li = b.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_quantity").alias("q"), F.max("l_returnflag").alias("t"))
    before = li.select(F.col("l_orderkey").alias("id"), (F.when(F.col("q") > 30, "R").otherwise("N") == F.col("t")).alias("correct"))
    after = li.select(F.col("l_orderkey").alias("id"), (F.when(F.col("q") > 10, "R").otherwise("A") == F.col("t")).alias("correct"))
    return rounded(m.paired_comparison(before, after))


PAIRED = """WITH li AS (SELECT l_orderkey, max(l_quantity) AS q, max(l_returnflag) AS t FROM lineitem GROUP BY l_orderkey),
x AS (SELECT CASE WHEN q > 30 THEN 'R' ELSE 'N' END = t AS a, CASE WHEN q > 10 THEN 'R' ELSE 'A' END = t AS b FROM li),
c AS (SELECT count(*) AS n, count(*) FILTER (a AND b) AS both_right, count(*) FILTER (a AND NOT b) AS only_before,
  count(*) FILTER (NOT a AND b) AS only_after, count(*) FILTER (NOT a AND NOT b) AS both_wrong FROM x),
s AS (SELECT *, CASE WHEN only_before + only_after > 0 THEN power(greatest(abs(only_before - only_after) - 1, 0), 2)::DOUBLE / (only_before + only_after) ELSE 0.0::DOUBLE END AS chi FROM c)
SELECT n, both_right, only_before, only_after, both_wrong, round(chi, 9) AS chi2, chi > 3.841458820694124 AND only_before > only_after AS significantly_worse FROM s"""


def _paired_exact(spark, d):
    """Two fixed rules compared on the lines of every quantity."""
    li = b.table(spark, d, "lineitem")
    wins = [F.count_if(c).alias(n) for n, c in (("only_before", _before() & ~_after()), ("only_after", ~_before() & _after()))]
    return rounded(rsm.exact_paired_test(li.groupBy("l_quantity").agg(*wins)), 9)


def _before():
    return (F.col("l_tax") > 0.03) == (F.col("l_returnflag") == "R")


def _after():
    return (F.col("l_discount") > 0.06) == (F.col("l_returnflag") == "R")


P3_EXACT = """WITH x AS (SELECT l_quantity, (l_tax > 0.03) = (l_returnflag = 'R') AS a, (l_discount > 0.06) = (l_returnflag = 'R') AS b FROM lineitem),
c AS (SELECT l_quantity, count(*) FILTER (a AND NOT b) AS only_before, count(*) FILTER (NOT a AND b) AS only_after FROM x GROUP BY 1),
t AS (SELECT *, only_before + only_after AS n, least(only_before, only_after) AS k FROM c),
p AS (SELECT *, CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 2 * list_sum(list_transform(range(0, k + 1),
  lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0::DOUBLE))))) END AS v FROM t)
SELECT l_quantity, only_before, only_after, round(v, 9) AS p_value, v < 0.05 AND only_before > only_after AS worse FROM p"""


def _bootstrap(spark, d):
    hit = (F.col("true_label") == F.col("predicted_label")).cast("double")
    return rounded(rsm.bootstrap_interval(b.predictions(spark, d), hit))


BOOTSTRAP = f"""WITH {b.PREDICTIONS}, draws AS (SELECT true_label = predicted_label AS hit, k * 8 + j AS r,
    CAST('0x' || substr(md5('42:' || CAST(id AS VARCHAR) || ':' || CAST(k AS VARCHAR)), CAST(1 + 4 * j AS BIGINT), 4) AS INTEGER) AS u
  FROM preds, range({rsm.REPLICATES // rsm.PER_DIGEST}) a(k), range({rsm.PER_DIGEST}) o(j)),
weighted AS (SELECT r, hit, len(list_filter({list(rsm.POISSON)}, lambda t: t <= u)) AS w FROM draws),
scores AS (SELECT r, sum(CASE WHEN hit THEN w ELSE 0 END) / sum(w) AS score FROM weighted GROUP BY r)
SELECT count(*) AS n_replicates, round(quantile_cont(score, 0.025), 9) AS low, round(quantile_cont(score, 0.5), 9) AS median,
  round(quantile_cont(score, 0.975), 9) AS high, round(stddev_samp(score), 9) AS std FROM scores"""

ALL_SIGNALS = [*b.SIGNAL_NAMES, "lang"]


def _associations(spark, d):
    docs = b.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "lang")
    return _labelled(spark, d).join(docs, "id")


def _association(spark, d):
    return rounded(assoc.label_association(_associations(spark, d), ALL_SIGNALS, "label"), 6)


def _examples(spark, d):
    return assoc.value_examples(_associations(spark, d), ALL_SIGNALS, "label")


CELLS = f"""{{labelled}}, wide AS (SELECT l.*, lang FROM labelled l JOIN documents d ON l.id = CAST(d.doc_id AS VARCHAR)),
cells AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value, label, id FROM wide" for c in ALL_SIGNALS)})"""
ASSOCIATION = f"""WITH {CELLS.format(labelled=LABELLED)}, c AS (SELECT feature, value, label, count(*) AS c FROM cells GROUP BY ALL),
m AS (SELECT *, sum(c) OVER (PARTITION BY feature, value) AS r, sum(c) OVER (PARTITION BY feature, label) AS k, sum(c) OVER (PARTITION BY feature) AS n FROM c),
s AS (SELECT feature, any_value(n) AS n, count(DISTINCT value) AS v, count(DISTINCT label) AS l, sum(power(c - r * k / n, 2) / (r * k / n)) + any_value(n) - sum(r * k / n) AS chi2,
  sum(c / n * ln(c * n / (r * k))) AS mi FROM m GROUP BY feature)
SELECT feature, CAST(n AS BIGINT) AS n, v AS n_values, l AS n_labels, round(chi2, 6) AS chi2,
  round(CASE WHEN least(v - power(v - 1, 2) / (n - 1), l - power(l - 1, 2) / (n - 1)) > 1 THEN
    sqrt(greatest(0.0, chi2 / n - (v - 1) * (l - 1) / (n - 1)) / (least(v - power(v - 1, 2) / (n - 1), l - power(l - 1, 2) / (n - 1)) - 1)) ELSE 0.0 END, 6) AS cramers_v,
  round(greatest(mi, 0.0), 6) AS mutual_information FROM s"""
EXAMPLES = f"""WITH {CELLS.format(labelled=LABELLED)}, r AS (SELECT *, row_number() OVER (PARTITION BY feature, value, label ORDER BY md5('42:' || id), id) AS i,
  count(*) OVER (PARTITION BY feature, value, label) AS n FROM cells)
SELECT feature, value, label, any_value(n) AS n, string_agg(id, ',' ORDER BY i) AS examples FROM r WHERE i <= 3 GROUP BY feature, value, label"""


def _line_correlations(spark, d):
    """Every pair of the numeric columns of the lines, some with gaps."""
    li = b.table(spark, d, "lineitem").withColumn("l_tax", F.when(F.col("l_discount") < 0.09, F.col("l_tax")))
    return rounded(assoc.correlations(li, LINE_NUMBERS), 6)


LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_CORRELATIONS = "WITH li AS (SELECT * REPLACE (CASE WHEN l_discount < 0.09 THEN l_tax END AS l_tax) FROM lineitem) " + " UNION ALL ".join(
    f"SELECT '{x}' AS feature_a, '{y}' AS feature_b, count(*) FILTER ({x} IS NOT NULL AND {y} IS NOT NULL) AS n, round(corr({x}, {y}), 6) AS r FROM li"
    for i, x in enumerate(LINE_NUMBERS) for y in LINE_NUMBERS[i + 1 :]
)


def _fold_scores(spark, d):
    """Accuracy per fold of a fixed rule, then mean and population std."""
    p = kfold(b.predictions(spark, d), "true_label", 5)
    per = p.groupBy("fold").agg(F.avg((F.col("true_label") == F.col("predicted_label")).cast("double")).alias("score"))
    return rounded(m.fold_summary(per))


def _shuffled_head(spark, d):
    return hash_head(b.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus"), "id", 42, 100)


def _session_cost(spark, d):
    cost = F.when(F.col("o_orderstatus") != "P", F.floor("o_totalprice") / F.lit(64.0))
    runs = b.table(spark, d, "orders").select(F.col("o_custkey").alias("session"), cost.alias("extraction_cost"))
    return m.session_cost(runs, ["session"])


def _history_summary(spark, d):
    return m.history_summary(b.history(spark, d), ["session"])


SIG_NUM = ["comma_level", "length_level", "line_level"]


def _numeric_records(spark, d):
    target = F.when(F.col("label") == "good", 1.0).otherwise(0.0)
    return _labelled(spark, d).select("id", "label", *SIG_NUM, target.alias("y"))


def _quality(spark, d):
    return rounded(m.feature_quality(_numeric_records(spark, d), SIG_NUM, "y"), 6)


def _redundant(spark, d):
    return rounded(assoc.redundant_pairs(_numeric_records(spark, d), SIG_NUM), 6)


def _rank_corr(spark, d):
    return rounded(assoc.rank_correlation(_numeric_records(spark, d), SIG_NUM, "y"), 6)


def _rank_sql() -> str:
    def mean_rank(c: str) -> str:
        return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS r_{c}"

    ranks = ", ".join(mean_rank(c) for c in (*SIG_NUM, "y"))
    parts = " UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr(r_{c}, r_y), 6) AS rank_corr FROM k" for c in SIG_NUM)
    return f"WITH {NUM}, k AS (SELECT {ranks} FROM n) {parts}"


def _coverage(spark, d):
    p = b.table(spark, d, "part")
    patterns = p.select(F.col("p_partkey").alias("pattern_id"), F.col("p_name").alias("pattern"))
    mapping = b.table(spark, d, "lineitem").where(F.col("l_quantity") > 45).select(
        F.col("l_partkey").alias("pattern_id"), F.col("l_suppkey").cast("string").alias("feature")
    )
    return m.coverage(patterns, mapping)


def _corr_sql(pairs) -> str:
    return " UNION ALL ".join(
        f"SELECT '{x}' AS feature_a, '{y}' AS feature_b, round(corr({x}, {y}), 6) AS r, abs(corr({x}, {y})) > 0.8 AS redundant FROM n" for x, y in pairs
    )


NUM = f"""{LABELLED}, n AS (SELECT id, label, comma_level, length_level, line_level, CASE WHEN label = 'good' THEN 1.0::DOUBLE ELSE 0.0 END AS y FROM labelled)"""
PAIRS = [("comma_level", "length_level"), ("comma_level", "line_level"), ("length_level", "line_level")]

CHECKS = [
    Check("c3_features_with_labels", _labelled, f"WITH {LABELLED} SELECT * FROM labelled"),
    Check(
        "c4_aligned_rows",
        _aligned,
        f"""WITH {LABELLED} SELECT l.id, label, tongue, text FROM labelled l JOIN documents d ON l.id = CAST(d.doc_id AS VARCHAR) WHERE lang <> 'es'""",
    ),
    Check(
        "h3_common_ids",
        lambda s, d: b.records(s, d).select("id").intersect(b.quality_labels(s, d).select("id")).intersect(
            b.table(s, d, "documents").select(F.col("doc_id").alias("id"))
        ),
        "SELECT doc_id AS id FROM documents INTERSECT SELECT doc_id FROM labels",
    ),
    Check(
        "k1_one_hot",
        _one_hot_own,
        """SELECT doc_id AS id, n_chars, CAST(lang = 'en' AS INTEGER) AS lang_en, CAST(lang = 'es' AS INTEGER) AS lang_es, CAST(lang = 'fr' AS INTEGER) AS lang_fr FROM documents""",
    ),
    Check(
        "k2_train_vocabulary",
        _one_hot,
        f"""WITH {b.RECORDS} SELECT id, comma_level, length_level, line_level, CAST(has_digit AS INTEGER) AS has_digit, CAST(has_symbol AS INTEGER) AS has_symbol,
  CAST(tongue = 'french' AS INTEGER) AS tongue_french, CAST(tongue = 'german' AS INTEGER) AS tongue_german,
  CAST(tongue = 'other' AS INTEGER) AS tongue_other, CAST(tongue = 'spanish' AS INTEGER) AS tongue_spanish FROM records""",
    ),
    Check(
        "k2_align_columns",
        _aligned_columns,
        """SELECT doc_id AS id, n_chars, 0 AS lang_en, CAST(lang = 'es' AS INTEGER) AS lang_es, 0 AS lang_fr FROM documents WHERE lang IN ('de', 'es')""",
    ),
    Check(
        "k3_class_weights",
        lambda s, d: rounded(mx.class_weights(b.line_predictions(s, d), "true_label").groupBy("true_label", "weight").agg(F.count(F.lit(1)).alias("n"))),
        """SELECT l_returnflag AS true_label, round((SELECT count(*) FROM lineitem) / ((SELECT count(DISTINCT l_returnflag) FROM lineitem) * count(*)), 9) AS weight,
  count(*) AS n FROM lineitem GROUP BY l_returnflag""",
    ),
    Check(
        "d16_k4_scaler_statistics",
        lambda s, d: rounded(mx.scaler_stats(_gappy(s, d), GAPPY_COLS), 6),
        f"WITH {GAPPY}, s AS ({_stats_sql()}) SELECT \"column\", median, round(mean, 6) AS mean, round(CASE WHEN std > 0 THEN std ELSE 1.0 END, 6) AS std FROM s",
    ),
    Check("k4_impute_scale", _impute_scale, _scaled_sql()),
    Check(
        "k10_single_class",
        _single_class,
        f"WITH {LABELLED} SELECT id, label, label AS predicted_label, true AS correct, 1.0::DOUBLE AS confidence FROM labelled WHERE label = 'good'",
    ),
    Check(
        "a7_a11_features_round_trip",
        _features_round_trip,
        f"WITH {b.RECORDS} SELECT * FROM records WHERE has_digit",
    ),
    Check(
        "a8_results_round_trip",
        _results_round_trip,
        "SELECT o_orderkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS o_orderdate FROM orders",
    ),
    Check(
        "a9_history_round_trip",
        _history_round_trip,
        f"""WITH {b.HISTORY} SELECT CAST(iteration AS INTEGER) AS iteration, val_accuracy, CAST(session % 5 AS INTEGER) AS train_fold, '-(a, b) +(c)' AS changes
FROM history""",
    ),
    Check(
        "b8_misclassified",
        lambda s, d: m.misclassified(b.predictions(s, d)),
        f"WITH {b.PREDICTIONS} SELECT * FROM preds WHERE true_label <> predicted_label",
    ),
    Check(
        "b8_correctly_classified",
        lambda s, d: m.correctly_classified(b.line_predictions(s, d)).groupBy("true_label").agg(F.count(F.lit(1)).alias("n")),
        f"WITH {b.LINE_PREDICTIONS} SELECT true_label, count(*) AS n FROM preds WHERE true_label = predicted_label GROUP BY true_label",
    ),
    Check(
        "c6_predictions_with_texts",
        _with_texts,
        f"""WITH {b.PREDICTIONS} SELECT id, predicted_label, coalesce(text, '') AS text FROM preds LEFT JOIN (SELECT * FROM documents WHERE lang <> 'de') ON id = doc_id""",
    ),
    Check(
        "c7_predictions_with_features",
        _with_features,
        f"""WITH {b.PREDICTIONS} SELECT p.id, predicted_label, comma_level AS feat_comma_level, has_digit AS feat_has_digit
FROM preds p LEFT JOIN (SELECT * FROM records WHERE tongue <> 'german') r ON p.id = r.id""",
    ),
    Check(
        "c8_usage_with_prices",
        lambda s, d: m.priced(b.usage(s, d)),
        f"WITH {b.USAGE} SELECT id, model, input_tokens, output_tokens, CAST(input_price AS DOUBLE) AS input_price, CAST(output_price AS DOUBLE) AS output_price FROM priced",
    ),
    Check(
        "d9_accuracy_summary",
        lambda s, d: rounded(m.accuracy_summary(b.line_predictions(s, d))),
        f"""WITH {b.LINE_PREDICTIONS}, c AS (SELECT count(*) AS n, count(*) FILTER (true_label = predicted_label) AS k FROM preds)
SELECT n, k AS n_correct, n - k AS n_wrong, round(k / n, 9) AS accuracy, round((n - k) / n * 100.0::DOUBLE, 9) AS pct_wrong FROM c""",
    ),
    Check("d10_per_class_metrics", _per_class, PER_CLASS),
    Check(
        "d11_fold_summary",
        _fold_scores,
        f"""WITH {b.PREDICTIONS}, r AS (SELECT *, (row_number() OVER (PARTITION BY true_label ORDER BY md5('42:' || CAST(id AS VARCHAR)), id) - 1) % 5 AS fold FROM preds),
f AS (SELECT fold, avg(CAST(true_label = predicted_label AS DOUBLE)) AS s FROM r GROUP BY fold)
SELECT round(avg(s), 9) AS mean, round(stddev_pop(s), 9) AS std, count(*) AS n_folds FROM f""",
    ),
    Check(
        "d12_cost_by_model",
        lambda s, d: rounded(m.cost_by_model(b.usage(s, d)), 6),
        f"""WITH {b.USAGE}, t AS (SELECT model, count(*) AS n_samples, CAST(sum(input_tokens) AS BIGINT) AS i, CAST(sum(output_tokens) AS BIGINT) AS o,
  CAST(any_value(input_price) AS DOUBLE) AS ip, CAST(any_value(output_price) AS DOUBLE) AS op FROM priced GROUP BY model)
SELECT model, n_samples, i AS input_tokens, o AS output_tokens, i + o AS total_tokens, round(i * ip / 1e6, 6) AS input_cost_usd, round(o * op / 1e6, 6) AS output_cost_usd,
  round(i * ip / 1e6 + o * op / 1e6, 6) AS total_cost_usd FROM t""",
    ),
    Check(
        "d13_session_cost",
        _session_cost,
        """SELECT o_custkey AS session, coalesce(sum(floor(o_totalprice) / CAST(64 AS DOUBLE)) FILTER (o_orderstatus <> 'P'), CAST(0 AS DOUBLE)) AS total_cost_usd,
  count(*) FILTER (o_orderstatus <> 'P') AS n_costed FROM orders GROUP BY 1""",
    ),
    Check(
        "d13_cost_per_sample",
        lambda s, d: rounded(m.cost_per_sample(m.cost_by_model(b.usage(s, d))), 6),
        f"""WITH {b.USAGE}, t AS (SELECT sum(CAST(input_tokens AS DOUBLE) * input_price / 1e6 + CAST(output_tokens AS DOUBLE) * output_price / 1e6) AS c, count(*) AS n FROM priced)
SELECT round(c, 6) AS total_cost_usd, n AS n_samples, round(c / n, 6) AS cost_per_sample, round(c / n * 5000, 6) AS cost_at_target FROM t""",
    ),
    Check(
        "d14_surviving_features",
        lambda s, d: m.surviving_features(b.coefs(s, d)),
        f"WITH {b.COEFS} SELECT count(*) FILTER (abs(coefficient) > 1e-6) AS n_nonzero, count(*) AS n_features FROM coefs",
    ),
    Check(
        "d17_history_summary",
        _history_summary,
        f"""WITH {b.HISTORY} SELECT session, count(*) AS n_iterations, arg_min(val_accuracy, iteration) AS first_score, arg_max(val_accuracy, iteration) AS last_score,
  arg_max(val_accuracy, iteration) - arg_min(val_accuracy, iteration) AS net_change, max(val_accuracy) AS best_score,
  (SELECT min(i.iteration) FROM history i WHERE i.session = h.session AND i.val_accuracy = max(h.val_accuracy)) AS best_iteration FROM history h GROUP BY session""",
    ),
    Check(
        "e4_running_best",
        lambda s, d: m.running_best(b.history(s, d), ["session"]),
        f"""WITH {b.HISTORY} SELECT *, val_accuracy > coalesce(max(val_accuracy) OVER (PARTITION BY session ORDER BY iteration
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS is_best FROM history""",
    ),
    Check(
        "f1_top_coefficients",
        lambda s, d: rounded(m.top_coefficients(b.coefs(s, d), 10), 6),
        f"""WITH {b.COEFS} SELECT feature, coefficient, abs(coefficient) AS abs_coef, round(exp(coefficient), 6) AS odds_ratio,
  CASE WHEN coefficient > 0 THEN 'positive' WHEN coefficient < 0 THEN 'negative' ELSE 'neutral' END AS direction FROM coefs ORDER BY abs_coef DESC, feature LIMIT 10""",
    ),
    Check(
        "i6_odds_ratios",
        lambda s, d: rounded(m.coefficient_table(b.coefs(s, d)), 6),
        f"WITH {b.COEFS} SELECT feature, coefficient, abs(coefficient) AS abs_coef, round(exp(coefficient), 6) AS odds_ratio FROM coefs",
    ),
    Check(
        "f3_first_misclassified",
        lambda s, d: m.first_misclassified(b.predictions(s, d), 5, "id"),
        f"WITH {b.PREDICTIONS} SELECT * FROM preds WHERE true_label <> predicted_label ORDER BY id LIMIT 5",
    ),
    Check(
        "f4_shuffled_head",
        _shuffled_head,
        "SELECT o_orderkey AS id, o_orderstatus FROM orders ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 100",
    ),
    Check(
        "p1_macro_f1",
        lambda s, d: rounded(m.macro_f1(m.per_class_metrics(b.line_predictions(s, d), class_counts(b.line_predictions(s, d), "true_label").select(F.col("true_label").alias("class")))), 6),
        f"WITH pc AS ({PER_CLASS}) SELECT round(avg(f1), 6) AS macro_f1, count(*) AS n_classes FROM pc WHERE support > 0",
    ),
    Check(
        "p2_wilson_interval",
        lambda s, d: rounded(m.wilson_interval(m.accuracy_summary(b.line_predictions(s, d)))),
        f"""WITH {b.LINE_PREDICTIONS}, c AS (SELECT count(*) AS n, count(*) FILTER (true_label = predicted_label) AS k FROM preds), z AS (SELECT *, k / n AS p, 1.959963984540054::DOUBLE AS z FROM c)
SELECT n, k AS n_correct, round(p, 9) AS accuracy, round(((p + z * z / (2 * n)) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9) AS low,
  round(((p + z * z / (2 * n)) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9) AS high FROM z""",
    ),
    Check("p2_bootstrap_interval", _bootstrap, BOOTSTRAP),
    Check("p3_paired_comparison", _paired, PAIRED),
    Check("p3_exact", _paired_exact, P3_EXACT),
    Check("p5_line_correlations", _line_correlations, LINE_CORRELATIONS),
    Check("p6_label_association", _association, ASSOCIATION),
    Check("p6_value_examples", _examples, EXAMPLES),
    Check(
        "p5_feature_quality",
        _quality,
        f"WITH {NUM} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(var_pop({c}), 6) AS variance, round(corr({c}, y), 6) AS target_corr FROM n" for c in SIG_NUM),
    ),
    Check("p5_rank_correlation", _rank_corr, _rank_sql()),
    Check("p5_redundant_pairs", _redundant, f"WITH {NUM} {_corr_sql(PAIRS)}"),
    Check(
        "p6_value_distribution",
        lambda s, d: m.value_distribution(_numeric_records(s, d), SIG_NUM, "label"),
        f"WITH {NUM} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value, label, count(*) AS n FROM n GROUP BY ALL" for c in SIG_NUM),
    ),
    Check(
        "p7_interaction_terms",
        lambda s, d: mx.with_interactions(b.records(s, d).select("id", *SIG_NUM), [("comma_level", "length_level"), ("line_level", "line_level")]),
        f"WITH {b.RECORDS} SELECT id, comma_level, length_level, line_level, comma_level * length_level AS comma_level__x__length_level, line_level * line_level AS line_level__x__line_level FROM records",
    ),
    Check(
        "p8_pattern_coverage",
        _coverage,
        """SELECT p_partkey AS pattern_id, p_name AS pattern, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45) AS n_features,
  (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45) > 0 AS covered FROM part""",
    ),
]
