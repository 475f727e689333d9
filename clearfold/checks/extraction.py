"""Extraction, cache, requests and answers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from clearfold.checks import base as b
from clearfold.checks.base import Check
from clearfold.functions.hashing import cache_key
from clearfold.functions.text import clean_phrases, keep_mark, score_stars
from clearfold.operators import extraction as ex
from clearfold.operators import metrics as m
from clearfold.operators import requests as rq
from clearfold.operators.featuredefs import column_cost, record_schema
from clearfold.operators.ordered import hash_head
from clearfold.operators.sampling import stratified_sample

# -- a service that fails and refuses on a fixed pattern --------------------------------

LEVEL = T.StructType([T.StructField("level", T.IntegerType())])


def unreliable_service():
    """Fails for good on some texts and refuses others on the first try."""
    seen: set[str] = set()

    def extract(text: str, ident: str) -> ex.Extraction:
        if len(text) % 7 == 0:
            raise ValueError("service error")
        if len(text) % 5 == 0 and ident not in seen:
            seen.add(ident)
            raise ex.Refused("declined")
        return ex.Extraction({"level": len(text) % 5 + 1}, len(text), 7)

    return extract


def _no_wait(attempt: int) -> float:
    return 0.0


def _documents(spark, d):
    return b.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))


def _extracted(spark, d):
    return ex.run_extractor(
        _documents(spark, d), lambda: unreliable_service(), LEVEL, max_concurrent=8, requests_per_minute=None, backoff=_no_wait
    )


SERVICE = """calls AS (SELECT CAST(doc_id AS VARCHAR) AS id, text, CASE WHEN length(text) % 7 = 0 THEN 'failed' ELSE 'ok' END AS status,
  CAST(CASE WHEN length(text) % 7 = 0 THEN 3 WHEN length(text) % 5 = 0 THEN 2 ELSE 1 END AS INTEGER) AS attempt,
  CASE WHEN length(text) % 7 = 0 THEN 'service error' END AS error,
  CASE WHEN length(text) % 7 <> 0 THEN length(text) END AS input_tokens,
  CASE WHEN length(text) % 7 <> 0 THEN CAST(7 AS BIGINT) END AS output_tokens,
  CASE WHEN length(text) % 7 <> 0 THEN CAST(length(text) % 5 + 1 AS INTEGER) END AS level FROM documents)"""


def _batch(spark, d):
    """Every document through the cache table; copies of a text are extracted once."""
    docs = ex.with_cache_key(_documents(spark, d), "abc123")
    cache = ex.extract_into_cache(
        docs, b.scratch(spark, "cache"), lambda: unreliable_service(), LEVEL, batches=2, max_concurrent=4,
        requests_per_minute=None, backoff=_no_wait,
    )
    return docs.join(cache, "cache_key").select(F.col("id").cast("string").alias("id"), "status", F.col("record.level").alias("level"))


def _cache_split(spark, d):
    docs = b.table(spark, d, "documents")
    cache = ex.with_cache_key(docs.where(F.col("lang") == "en"), "abc123", "text").select("cache_key").distinct()
    keyed = ex.with_cache_key(docs.select("doc_id", "text"), "abc123", "text")
    hits = ex.cache_hits(keyed, cache).select("cache_key", F.lit("hit").alias("side"), F.col("doc_id"))
    misses = ex.cache_misses(keyed, cache, "text").select("cache_key", F.lit("miss").alias("side"), F.lit(None).cast("bigint").alias("doc_id"))
    return hits.unionByName(misses)


TIGHT_DEFS = [
    {"name": "comma_level", "type": "scale", "min": 2, "max": 3, "values": None, "description": ""},
    {"name": "has_digit", "type": "bool", "min": None, "max": None, "values": None, "description": ""},
    {"name": "tongue", "type": "categorical", "min": None, "max": None, "values": ["english"], "description": ""},
]


def _validated(spark, d):
    missing = F.col("length_level") == 3
    r = b.records(spark, d).select(
        "id", "comma_level", F.when(~missing, F.col("has_digit")).alias("has_digit"), F.when(~missing, F.col("tongue")).alias("tongue")
    )
    return ex.check_records(r, TIGHT_DEFS).select("id", "valid", F.array_join("errors", "; ").alias("errors"))


def _typed(spark, d):
    """Records sent through JSON and read back under the schema of their configuration."""
    schema = record_schema(b.SIGNAL_DEFS)
    raw = b.records(spark, d).select("id", F.to_json(F.struct(*b.SIGNAL_NAMES)).alias("j"))
    return raw.select("id", F.from_json("j", schema).alias("r")).select("id", "r.*")


# -- requests --------------------------------------------------------------------------


def detailed(spark, d):
    preds = b.predictions(spark, d)
    texts = b.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return m.attach_features(m.attach_texts(preds, texts), b.records(spark, d))


RENDER = """'* ' || CASE WHEN length(text) > 400 THEN substring(text, 1, 400) || '...' ELSE text END || chr(10) || '  values {"comma_level":' || comma_level ||
  ',"length_level":' || length_level || ',"line_level":' || line_level || ',"has_digit":' || has_digit || ',"has_symbol":' || has_symbol ||
  ',"tongue":"' || tongue || '"}' || chr(10) || '  judged ' || predicted_label || ' (sure to ' || printf('%.2f', confidence) || '), in truth ' || true_label"""
DETAILED = f"""{b.PREDICTIONS}, full_preds AS (SELECT p.*, d.text, comma_level, length_level, line_level, has_digit, has_symbol, tongue
  FROM preds p JOIN documents d ON p.id = d.doc_id JOIN records r ON r.id = p.id)"""


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _residual(spark, d):
    wrong = m.first_misclassified(detailed(spark, d), rq.RESIDUAL_EXAMPLES, "id")
    return rq.residual_request(wrong, b.SIGNAL_NAMES)


def _broad(spark, d):
    docs = b.quality_labels(spark, d)
    drawn = stratified_sample(docs, "label", 200, seed=2026)
    texts = b.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return rq.broad_request(drawn.join(texts, "id"), "label", "text")


def _contrast(spark, d):
    full = detailed(spark, d)
    right = hash_head(m.correctly_classified(full), "id", 42, 5)
    wrong = hash_head(m.misclassified(full), "id", 42, 5)
    return rq.sample_request(right, wrong, b.SIGNAL_NAMES, ["pattern one", "pattern two"])


def _budget_lines(spark, d):
    o = b.table(spark, d, "orders")
    budgets = o.select("o_orderkey", (F.col("o_custkey") % 40).cast("int").alias("effective_dim"), F.lit(18).alias("budget"))
    return rq.budget_lines(budgets).select("o_orderkey", "budget_lines")


def _config_coefs(spark, d):
    """The coefficients of one model per configuration, under the configuration's id."""
    of_part = F.concat(F.lit("c"), F.floor(F.substring("feature", 2, 20).cast("bigint") / 12).cast("string"))
    odds = m.coefficient_table(b.coefs(spark, d))
    return odds.withColumn("config_id", of_part)


def _coefficient_lines(spark, d):
    return rq.coefficient_lines(_config_coefs(spark, d))


def _sample_answers(spark, d):
    """One sample analysis per configuration as JSON; some lack a part, some are no JSON."""
    p = b.table(spark, d, "part").withColumn("config_id", F.concat(F.lit("c"), F.floor(F.col("p_partkey") / 12).cast("string")))
    parts = p.groupBy("config_id").agg(
        F.sum("p_size").alias("s"), F.min("p_type").alias("a"), F.max("p_type").alias("w"), F.array_sort(F.collect_set("p_brand")).alias("m"), F.min("p_name").alias("k")
    )
    answer = F.to_json(
        F.struct(
            F.col("a").alias("correct_patterns"), F.when(F.col("s") % 7 != 0, F.col("w")).alias("incorrect_patterns"),
            F.col("m").alias("missing_signals"), F.col("k").alias("key_insight"),
        )
    )
    return parts.select("config_id", "s", F.when(F.col("s") % 11 == 0, F.lit("sorry, no")).otherwise(answer).alias("response"))


def _insights(spark, d):
    return rq.sample_insights(rq.parse_answers(_sample_answers(spark, d), rq.SAMPLE_DDL), ["config_id"])


def _insight_rows(spark, d):
    return _insights(spark, d).withColumn("missing_signals", F.array_join("missing_signals", ","))


def _broad_patterns(spark, d):
    """Patterns of one broad answer per configuration, with blanks to trim and blank entries."""
    defs = b.definitions(spark, d)
    padded = F.when(F.col("pos") % 4 == 3, F.lit("  ")).otherwise(F.concat(F.lit(" "), "description", F.lit(" ")))
    lists = defs.groupBy("config_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", padded.alias("t")))), lambda x: x["t"]).alias("patterns"))
    answers = lists.select("config_id", F.to_json(F.struct("patterns")).alias("response"))
    return rq.broad_patterns(rq.parse_answers(answers, rq.BROAD_DDL), ["config_id"], keep=6)


def _proposal(spark, d):
    """The whole request of every configuration."""
    defs = b.definitions(spark, d)
    s = F.col("s")
    standing = _sample_answers(spark, d).select(
        "config_id", (s % 8 / F.lit(8.0)).alias("cv_accuracy"), (s % 3 / F.lit(8.0)).alias("cv_std"), (s % 5).cast("int").alias("n_nonzero"),
        F.lit(12).alias("n_columns"), (s % 40).cast("int").alias("effective_dim"), F.lit(18).alias("budget"),
    )
    costs = defs.select("config_id", "name", column_cost().cast("bigint").alias("n_columns"))
    tried = b.proposals(spark, d).where(F.col("pos") < 3)
    return rq.proposal_requests(standing, _config_coefs(spark, d), defs, costs, _insights(spark, d), tried, ["one", "two"], 4)


CONFIG_COEFS = f"{b.COEFS}, config_coefs AS (SELECT 'c' || CAST(CAST(substr(feature, 2) AS BIGINT) // 12 AS VARCHAR) AS config_id, * FROM coefs)"
COEF_LINES = """SELECT config_id, string_agg(CASE WHEN coefficient >= 0 THEN '+' ELSE '' END || printf('%.4f', coefficient) || ' ' || feature || ', odds x ' ||
  printf('%.3f', exp(coefficient)), chr(10) ORDER BY abs(coefficient) DESC, feature) AS coefficient_lines FROM config_coefs GROUP BY config_id"""
DEF_LINES = "SELECT config_id, string_agg(name || ' (' || type || ') ' || description, chr(10) ORDER BY pos) AS definition_lines FROM defs GROUP BY config_id"
INSIGHTS = """parts AS (SELECT 'c' || CAST(p_partkey // 12 AS VARCHAR) AS config_id, CAST(sum(p_size) AS BIGINT) AS s, min(p_type) AS a, max(p_type) AS w,
  string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS m, string_agg(DISTINCT p_brand, '; ' ORDER BY p_brand) AS signals, min(p_name) AS k FROM part GROUP BY 1),
insights AS (SELECT *, s % 11 <> 0 AS valid, s % 7 <> 0 AS whole FROM parts)"""
PROPOSAL_SQL = f"""WITH {CONFIG_COEFS}, {b.DEFINITIONS}, {b.PROPOSALS}, {INSIGHTS}, cl AS ({COEF_LINES}), dl AS ({DEF_LINES}),
costs AS (SELECT config_id, name || ' ' || c AS t, row_number() OVER (PARTITION BY config_id ORDER BY c DESC, name) AS i FROM
  (SELECT config_id, name, CASE WHEN type = 'categorical' THEN greatest(len(values) - 1, 0) ELSE 1 END AS c FROM defs)),
dear AS (SELECT config_id, string_agg(t, ', ' ORDER BY i) AS dearest FROM costs WHERE i <= 10 GROUP BY 1),
past AS (SELECT config_id, string_agg(DISTINCT name, ', ' ORDER BY name) AS tried FROM proposals WHERE pos < 3 GROUP BY 1)
SELECT i.config_id, {{head}} || 'Accuracy over folds ' || printf('%.3f', s % 8 / 8.0::DOUBLE) || ', spread ' || printf('%.3f', s % 3 / 8.0::DOUBLE) || '; ' ||
  CAST(s % 5 AS VARCHAR) || ' of 12 columns carry weight.' || chr(10) || 'Columns left: ' || CASE WHEN 18 - s % 40 >= 0 THEN '+' ELSE '' END || CAST(18 - s % 40 AS VARCHAR) ||
  ' of 18, ' || CAST(s % 40 AS VARCHAR) || ' taken.' || chr(10) || 'Dearest: ' || dearest || chr(10) || chr(10) || 'Lessons of the samples:' || chr(10) ||
  CASE WHEN valid THEN 'above all: ' || k || chr(10) || 'lacking: ' || signals || chr(10) || CASE WHEN whole THEN 'where wrong: ' || w || chr(10) ELSE '' END || 'where right: ' || a
    ELSE '(none)' END || chr(10) || chr(10) || 'Known patterns:' || chr(10) || '- one' || chr(10) || '- two' || chr(10) || chr(10) || 'Features:' || chr(10) || definition_lines ||
  chr(10) || chr(10) || 'Coefficients:' || chr(10) || coefficient_lines || chr(10) || chr(10) || 'Remove up to 4 features and add up to 4. Not to be named again: ' ||
  coalesce(tried, '(none)') AS prompt
FROM insights i JOIN dear USING (config_id) JOIN cl USING (config_id) JOIN dl USING (config_id) LEFT JOIN past USING (config_id)"""


def _definition_lines(spark, d):
    return rq.definition_lines(b.definitions(spark, d))


# -- answers ---------------------------------------------------------------------------


def _answers(spark, d):
    """One answer per configuration, written as JSON from its definitions and proposals."""
    defs, props = b.definitions(spark, d), b.proposals(spark, d)
    evaluations = defs.groupBy("config_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "pos", F.col("name").alias("feature_name"), ((F.col("pos") * 7) % 5 + 1).alias("usefulness_score"),
                    F.lit("because").alias("reasoning"), (F.col("pos") % 3 != 0).alias("keep"),
                )
            )
        ).alias("e"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("pos") % 3 == 0, F.struct("pos", "name")))), lambda x: x["name"]).alias("r"),
    )
    added = props.groupBy("config_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "name", "feature_type", "description", "min_val", "max_val", "values"))).alias("p")
    )
    return evaluations.join(added, "config_id").select(
        "config_id",
        F.to_json(
            F.struct(
                F.lit("ok").alias("summary"), F.col("e").alias("feature_evaluations"), F.col("r").alias("features_to_remove"),
                F.col("p").alias("proposed_features"), F.lit("some").alias("expected_improvement"),
            )
        ).alias("response"),
    )


def _parsed(spark, d):
    return rq.parse_answers(_answers(spark, d), rq.ITERATION_DDL)


def _evaluations(spark, d):
    e = rq.feature_evaluations(_parsed(spark, d), ["config_id"])
    return e.select("config_id", "pos", "feature_name", "usefulness_score", "keep")


def _additions(spark, d):
    a = rq.requested_additions(_parsed(spark, d), ["config_id"])
    return a.select("config_id", "pos", "name", "feature_type", "min_val", "max_val", F.array_join("values", ",").alias("domain"))


def _hypotheses(spark, d):
    """Residual answers, some with a field missing."""
    p = b.table(spark, d, "part")
    answers = p.select(
        "p_partkey",
        F.to_json(
            F.struct(
                F.col("p_name").alias("pattern_summary"),
                F.array(
                    F.struct(
                        F.col("p_brand").alias("feature_name"), F.lit("boolean").alias("feature_type"),
                        F.when(F.col("p_size") > 10, F.col("p_type")).alias("description"), F.lit("ask").alias("extraction_prompt"),
                    )
                ).alias("hypotheses"),
            )
        ).alias("response"),
    )
    h = rq.hypotheses(rq.parse_answers(answers, rq.RESIDUAL_DDL), ["p_partkey"])
    return h.select("p_partkey", "feature_name", "description", "complete")


def _stars(spark, d):
    e = _evaluations(spark, d)
    return e.select("config_id", "pos", score_stars(F.col("usefulness_score")).alias("stars"), keep_mark(F.col("keep")).alias("mark"))


def _phrases(spark, d):
    p = F.split("text", "[.\n]")
    return b.table(spark, d, "conversations").select("conv_id", "turn", F.array_join(clean_phrases(p), "|").alias("phrases"))


EVAL_SQL = f"""WITH {b.DEFINITIONS} SELECT config_id, pos, name AS feature_name, CAST((pos * 7) % 5 + 1 AS INTEGER) AS usefulness_score, pos % 3 <> 0 AS keep
FROM defs"""

CHECKS = [
    Check("j7_signal_features", b.records, f"WITH {b.RECORDS} SELECT * FROM records"),
    Check(
        "b9_feature_validate",
        _validated,
        f"""WITH {b.RECORDS}, r AS (SELECT id, comma_level, CASE WHEN length_level <> 3 THEN has_digit END AS has_digit,
  CASE WHEN length_level <> 3 THEN tongue END AS tongue FROM records),
e AS (SELECT id, concat_ws('; ', CASE WHEN comma_level < 2 THEN 'comma_level: below 2' END, CASE WHEN comma_level > 3 THEN 'comma_level: above 3' END,
  CASE WHEN has_digit IS NULL THEN 'has_digit: missing' END, CASE WHEN tongue IS NULL THEN 'tongue: missing' END) AS errors FROM r)
SELECT id, errors = '' AS valid, errors FROM e""",
    ),
    Check(
        "i4_cache_keys",
        lambda s, d: b.table(s, d, "documents").select("doc_id", cache_key("abc123", F.col("text")).alias("cache_key")),
        "SELECT doc_id, md5('abc123:' || text) AS cache_key FROM documents",
    ),
    Check(
        "c9_cache_split",
        _cache_split,
        """WITH k AS (SELECT doc_id, lang, md5('abc123:' || text) AS cache_key FROM documents), c AS (SELECT DISTINCT cache_key FROM k WHERE lang = 'en')
SELECT cache_key, 'hit' AS side, doc_id FROM k WHERE cache_key IN (SELECT cache_key FROM c)
UNION ALL SELECT DISTINCT cache_key, 'miss', CAST(NULL AS BIGINT) FROM k WHERE cache_key NOT IN (SELECT cache_key FROM c)""",
    ),
    Check(
        "j1_extract_with_retries",
        lambda s, d: _extracted(s, d).select("id", "status", "attempt", "error", "input_tokens", "output_tokens", "record.level"),
        f"WITH {SERVICE} SELECT id, status, attempt, error, input_tokens, output_tokens, level FROM calls",
    ),
    Check("j2_extract_batch", _batch, f"WITH {SERVICE} SELECT id, status, level FROM calls"),
    Check(
        "j4_extraction_log",
        lambda s, d: ex.extraction_log(_extracted(s, d), "gpt-5-mini").select("post_id", "model", "attempt", "usage.input_tokens", "usage.output_tokens"),
        f"WITH {SERVICE} SELECT id AS post_id, 'gpt-5-mini' AS model, attempt, input_tokens, output_tokens FROM calls WHERE status = 'ok'",
    ),
    Check("j5_typed_records", _typed, f"WITH {b.RECORDS} SELECT * FROM records"),
    Check(
        "j8_extraction_requests",
        lambda s, d: rq.extraction_requests(_documents(s, d), "signals", "Text signals"),
        f"""SELECT CAST(doc_id AS VARCHAR) AS id, {_sql_text(rq.EXTRACTION_SYSTEM.format(name='signals', description='Text signals'))} AS system,
  {_sql_text(rq.EXTRACTION_USER)} || text AS user FROM documents""",
    ),
    Check(
        "j9_rendered_samples",
        lambda s, d: detailed(s, d).select("id", rq.rendered_sample(b.SIGNAL_NAMES).alias("sample")),
        f"WITH {DETAILED} SELECT id, {RENDER} AS sample FROM full_preds",
    ),
    Check(
        "j10_residual_request",
        _residual,
        f"""WITH {DETAILED}, w AS (SELECT * FROM full_preds WHERE true_label <> predicted_label ORDER BY id LIMIT 5)
SELECT count(*) AS n_examples, {_sql_text(rq.RESIDUAL_HEAD + ', '.join(b.SIGNAL_NAMES) + chr(10) * 2)} || string_agg('* judged ' || predicted_label || ' instead of ' || true_label || ': ' ||
  substring(text, 1, 500), chr(10) ORDER BY id) AS prompt FROM w""",
    ),
    Check(
        "j11_broad_request",
        _broad,
        f"""WITH {b.QUALITY}, r AS (SELECT *, md5('2026:' || CAST(id AS VARCHAR)) AS h, row_number() OVER (PARTITION BY label ORDER BY md5('2026:' || CAST(id AS VARCHAR)), id) AS rn,
  count(*) OVER (PARTITION BY label) AS nc, count(*) OVER () AS na FROM quality),
k AS (SELECT * FROM r WHERE rn <= greatest(1, floor(200 * nc / na)) ORDER BY h, id LIMIT 200)
SELECT count(*) AS n_examples, {_sql_text(rq.BROAD_HEAD)} || string_agg('- LABEL: ' || label || chr(10) || '  TEXT: ' ||
  CASE WHEN length(text) > 500 THEN substring(text, 1, 500) || '...' ELSE text END, chr(10) ORDER BY id) AS prompt FROM k JOIN documents ON id = doc_id""",
    ),
    Check(
        "j11_sample_request",
        _contrast,
        f"""WITH {DETAILED}, x AS (SELECT id, true_label = predicted_label AS ok, {RENDER} AS s,
  row_number() OVER (PARTITION BY true_label = predicted_label ORDER BY md5('42:' || CAST(id AS VARCHAR)), id) AS rn FROM full_preds)
SELECT {_sql_text(rq.SAMPLE_HEAD + 'Known patterns:' + chr(10) + '- pattern one' + chr(10) + '- pattern two' + chr(10) * 2 + 'RIGHT:' + chr(10))} ||
  string_agg(s, chr(10) ORDER BY id) FILTER (ok) || {_sql_text(chr(10) * 2 + 'WRONG:' + chr(10))} || string_agg(s, chr(10) ORDER BY id) FILTER (NOT ok) AS prompt
FROM x WHERE rn <= 5""",
    ),
    Check(
        "j11_budget_lines",
        _budget_lines,
        """SELECT o_orderkey, 'Columns left: ' || CASE WHEN 18 - e >= 0 THEN '+' ELSE '' END || (18 - e) || ' of 18, ' || e || ' taken.' AS budget_lines
FROM (SELECT o_orderkey, o_custkey % 40 AS e FROM orders)""",
    ),
    Check("j11_coefficient_lines", _coefficient_lines, f"WITH {CONFIG_COEFS} {COEF_LINES}"),
    Check("j11_definition_lines", _definition_lines, f"WITH {b.DEFINITIONS} {DEF_LINES}"),
    Check("j11_proposal_request", _proposal, PROPOSAL_SQL.format(head=_sql_text(rq.PROPOSAL_HEAD))),
    Check(
        "j12_parse_broad",
        _broad_patterns,
        f"""WITH {b.DEFINITIONS}, kept AS (SELECT config_id, trim(description) AS pattern, CAST(row_number() OVER (PARTITION BY config_id ORDER BY pos) - 1 AS INTEGER) AS pos
  FROM defs WHERE pos % 4 <> 3 AND trim(description) <> '') SELECT config_id, pos, pattern FROM kept WHERE pos < 6""",
    ),
    Check(
        "j12_parse_sample",
        _insight_rows,
        f"""WITH {INSIGHTS} SELECT config_id, CASE WHEN valid THEN a END AS correct_patterns, CASE WHEN valid AND whole THEN w END AS incorrect_patterns,
  CASE WHEN valid THEN m END AS missing_signals, CASE WHEN valid THEN k END AS key_insight, valid AND whole AS complete FROM insights""",
    ),
    Check("j12_parse_evaluations", _evaluations, EVAL_SQL),
    Check(
        "j12_parse_removals",
        lambda s, d: rq.requested_removals(_parsed(s, d), ["config_id"]),
        f"""WITH {b.DEFINITIONS} SELECT config_id, CAST(row_number() OVER (PARTITION BY config_id ORDER BY pos) - 1 AS INTEGER) AS pos, name FROM defs
WHERE pos % 3 = 0""",
    ),
    Check(
        "j12_parse_additions",
        _additions,
        f"WITH {b.PROPOSALS} SELECT config_id, pos, name, feature_type, min_val, max_val, array_to_string(values, ',') AS domain FROM proposals",
    ),
    Check(
        "j12_parse_hypotheses",
        _hypotheses,
        """SELECT p_partkey, p_brand AS feature_name, CASE WHEN p_size > 10 THEN p_type END AS description, p_size > 10 AS complete FROM part""",
    ),
    Check(
        "f5_weakest_features_first",
        lambda s, d: rq.weakest_first(_evaluations(s, d), ["config_id"]),
        f"""WITH e AS ({EVAL_SQL}) SELECT *, CAST(row_number() OVER (PARTITION BY config_id ORDER BY usefulness_score, pos) AS INTEGER) AS place FROM e""",
    ),
    Check(
        "i7_score_stars",
        _stars,
        f"""WITH e AS ({EVAL_SQL}) SELECT config_id, pos, repeat('★', usefulness_score) || repeat('☆', 5 - usefulness_score) AS stars,
  CASE WHEN keep THEN 'keep' ELSE 'remove' END AS mark FROM e""",
    ),
    Check(
        "i8_clean_phrases",
        _phrases,
        r"""SELECT conv_id, turn, array_to_string(list_slice(list_filter(list_transform(string_split_regex(text, '[.\n]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')),
  lambda x: x <> ''), 1, 15), '|') AS phrases FROM conversations""",
    ),
]
