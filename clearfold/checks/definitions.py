"""Feature definitions: cost, budget, edits, checks and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from clearfold.checks import base as b
from clearfold.checks.base import Check
from clearfold.functions.text import change_summary, first_names
from clearfold.operators import featuredefs as fd
from clearfold.sources import configs as cf

COST = "CASE WHEN type = 'categorical' THEN greatest(coalesce(len(values), 0) - 1, 0) ELSE 1 END"
FLAT = "coalesce(array_to_string(values, ','), '') AS domain"


def _flat(df):
    """Definition rows with the domain as text."""
    values = F.coalesce(F.array_join("values", ","), F.lit("")).alias("domain")
    return df.select(*[c for c in df.columns if c != "values"], values)


BUDGET = 10
PRUNE_SQL = f"""costed AS (SELECT *, {COST} AS cost, CASE type WHEN 'categorical' THEN 2 WHEN 'scale' THEN 1 ELSE 0 END AS rk FROM defs),
summed AS (SELECT *, sum(cost) OVER (PARTITION BY config_id) AS total,
  coalesce(sum(cost) OVER (PARTITION BY config_id ORDER BY rk DESC, cost DESC, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM costed)"""


def _prune(spark, d):
    m = fd.mark_pruned(b.definitions(spark, d), F.lit(BUDGET))
    return m.select("config_id", "pos", "name", F.col("cost").cast("bigint").alias("cost"), "total_cost", "dropped")


def _removals(spark, d):
    return b.definitions(spark, d).where(F.col("pos") % 3 == 1).select(
        "config_id", F.floor(F.col("pos") / 3).cast("int").alias("pos"), "name"
    )


def _changed(spark, d):
    adds = fd.definition_from_proposal(b.proposals(spark, d))
    out = fd.apply_changes(b.definitions(spark, d), _removals(spark, d), adds, 3, "_next")
    return _flat(out)


NEW_DEFS = """adds AS (SELECT config_id, pos, name, feature_type AS type, CASE WHEN feature_type = 'scale' THEN coalesce(min_val, 1) END AS min,
  CASE WHEN feature_type = 'scale' THEN coalesce(max_val, 5) END AS max,
  CASE WHEN feature_type = 'categorical' THEN coalesce(values, CAST([] AS VARCHAR[])) END AS values, description FROM proposals)"""

CHANGED_SQL = f"""WITH {b.DEFINITIONS}, {b.PROPOSALS}, {NEW_DEFS},
gone AS (SELECT config_id, name FROM defs WHERE pos % 3 = 1 AND pos // 3 < 3),
kept AS (SELECT * FROM defs d WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.config_id = d.config_id AND g.name = d.name)),
fresh AS (SELECT a.* FROM adds a WHERE pos < 3 AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.config_id = a.config_id AND k.name = a.name)),
firsts AS (SELECT * FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM fresh e WHERE e.config_id = f.config_id AND e.name = f.name AND e.pos < f.pos)),
last AS (SELECT config_id, max(pos) AS m FROM defs GROUP BY config_id),
alld AS (SELECT * FROM kept UNION ALL SELECT f.config_id, CAST(f.pos + m + 1 AS INTEGER), name, type, min, max, values, description
  FROM firsts f JOIN last l ON f.config_id = l.config_id)
SELECT config_id || '_next' AS config_id, pos, name, type, min, max, description, {FLAT} FROM alld"""


def _encoded(spark, d):
    defs = fd.defs_table(spark, {"name": "signals", "features": b.SIGNAL_DEFS})
    seen = b.records(spark, d).select(F.lit("tongue").alias("name"), F.col("tongue").alias("value"))
    return fd.encoded_costs(defs, seen)


def _round_trip(spark, d):
    path = b.scratch(spark, "configs")
    cf.write_configs(b.definitions(spark, d), path)
    back = spark.read.schema(cf.CONFIG_DDL).json(path)
    return _flat(cf.configs_to_defs(back))


def _tried(spark, d):
    defs, props = b.definitions(spark, d), b.proposals(spark, d)
    pruned = fd.mark_pruned(defs, F.lit(BUDGET)).where("dropped")
    return fd.tried_names(defs, props, pruned)


def _names(spark, d):
    per = b.definitions(spark, d).groupBy("config_id").agg(F.sort_array(F.collect_set("name")).alias("names"))
    old = F.slice("names", 1, 3)
    return per.select(
        "config_id",
        first_names(F.col("names")).alias("short"),
        change_summary(old, F.col("names")).alias("changes"),
    )


def _first(cols: str, n: str) -> str:
    return f"array_to_string(list_slice({cols}, 1, 2), ', ') || CASE WHEN {n} > 2 THEN ' +' || CAST({n} - 2 AS VARCHAR) ELSE '' END"


def _added(spark, d):
    defs = b.definitions(spark, d)
    row = (
        b.proposals(spark, d).where(F.col("pos") == 0).withColumn("name", F.concat(F.lit("extra_"), F.col("name")))
    )
    return _flat(fd.add_definition(defs, fd.definition_from_proposal(row))).select("config_id", "pos", "name", "type", "domain")


def _edited(spark, d):
    defs = b.definitions(spark, d)
    return fd.remove_definition(defs, "ring_3").select("config_id", "pos", "name")


CHECKS = [
    Check(
        "k11_feature_cost",
        lambda s, d: b.definitions(s, d).select("config_id", "pos", fd.column_cost().cast("bigint").alias("cost")),
        f"WITH {b.DEFINITIONS} SELECT config_id, pos, {COST} AS cost FROM defs",
    ),
    Check(
        "k11_config_cost",
        lambda s, d: fd.config_cost(b.definitions(s, d)),
        f"WITH {b.DEFINITIONS} SELECT config_id, CAST(sum({COST}) AS BIGINT) AS total_cost, count(*) AS n_features FROM defs GROUP BY config_id",
    ),
    Check(
        "k12_column_budget",
        lambda s, d: b.table(s, d, "orders").select("o_orderkey", fd.column_budget(F.col("o_custkey") % 130).alias("budget")),
        """SELECT o_orderkey, CAST(least(25, greatest(12, round_even(CAST(o_custkey % 130 AS DECIMAL(20,2)) * 0.25, 0))) AS INTEGER) AS budget FROM orders""",
    ),
    Check(
        "e3_budget_prune",
        _prune,
        f"""WITH {b.DEFINITIONS}, {PRUNE_SQL}
SELECT config_id, pos, name, cost, CAST(total AS BIGINT) AS total_cost, total - gone > {BUDGET} AS dropped FROM summed""",
    ),
    Check(
        "f2_encoded_column_costs",
        _encoded,
        f"""WITH {b.RECORDS}, k AS (SELECT count(DISTINCT tongue) - 1 AS n FROM records)
SELECT name, CASE WHEN name = 'tongue' THEN (SELECT n FROM k) ELSE 1 END AS n_columns
FROM (VALUES ('comma_level'), ('length_level'), ('line_level'), ('has_digit'), ('has_symbol'), ('tongue')) t(name)""",
    ),
    Check(
        "a10_config_round_trip",
        _round_trip,
        f"WITH {b.DEFINITIONS} SELECT config_id, pos, name, type, min, max, description, {FLAT} FROM defs",
    ),
    Check(
        "c10_new_proposals",
        lambda s, d: fd.new_only(b.proposals(s, d), b.definitions(s, d)).select("config_id", "pos", "name"),
        f"""WITH {b.DEFINITIONS}, {b.PROPOSALS} SELECT config_id, pos, name FROM proposals p
WHERE NOT EXISTS (SELECT 1 FROM defs d WHERE d.config_id = p.config_id AND d.name = p.name)""",
    ),
    Check(
        "h4_tried_names",
        _tried,
        f"""WITH {b.DEFINITIONS}, {b.PROPOSALS} SELECT config_id, name FROM defs UNION SELECT config_id, name FROM proposals""",
    ),
    Check("j13_apply_changes", _changed, CHANGED_SQL),
    Check(
        "j14_definitions_from_proposals",
        lambda s, d: _flat(fd.definition_from_proposal(b.proposals(s, d))),
        f"WITH {b.PROPOSALS}, {NEW_DEFS} SELECT config_id, pos, name, type, min, max, description, {FLAT} FROM adds",
    ),
    Check(
        "j15_add_definition",
        _added,
        f"""WITH {b.DEFINITIONS}, {b.PROPOSALS}, {NEW_DEFS}, last AS (SELECT config_id, max(pos) + 1 AS p FROM defs GROUP BY config_id)
SELECT config_id, pos, name, type, {FLAT} FROM defs UNION ALL
SELECT a.config_id, CAST(p AS INTEGER), 'extra_' || name, type, {FLAT} FROM adds a JOIN last l ON a.config_id = l.config_id WHERE pos = 0""",
    ),
    Check(
        "j15_remove_definition",
        _edited,
        f"WITH {b.DEFINITIONS} SELECT config_id, pos, name FROM defs WHERE name <> 'ring_3'",
    ),
    Check(
        "j15_get_definition",
        lambda s, d: fd.get_definition(b.definitions(s, d), "ring_3").select("config_id", "pos", "type"),
        f"WITH {b.DEFINITIONS} SELECT config_id, pos, type FROM defs WHERE name = 'ring_3'",
    ),
    Check(
        "j16_definition_check",
        lambda s, d: fd.check_definitions(b.definitions(s, d)).select("config_id", "pos", F.array_join("errors", "; ").alias("errors")),
        f"""WITH {b.DEFINITIONS}, c AS (SELECT *, count(*) OVER (PARTITION BY config_id, name) AS c FROM defs)
SELECT config_id, pos, concat_ws('; ', CASE WHEN type NOT IN ('scale', 'bool', 'categorical') THEN 'unknown type' END,
  CASE WHEN type = 'scale' AND (min IS NULL OR max IS NULL) THEN 'scale without bounds' END,
  CASE WHEN type = 'scale' AND min >= max THEN 'scale with empty range' END,
  CASE WHEN type = 'categorical' AND coalesce(len(values), 0) <= 0 THEN 'categorical without values' END,
  CASE WHEN c > 1 THEN 'duplicate name' END) AS errors FROM c""",
    ),
    Check(
        "j6_categorical_domains",
        lambda s, d: _flat(fd.categorical_domains(b.definitions(s, d))),
        f"WITH {b.DEFINITIONS} SELECT config_id, name, {FLAT} FROM defs WHERE type = 'categorical'",
    ),
    Check(
        "j6_field_types",
        lambda s, d: fd.field_types(b.definitions(s, d)),
        f"WITH {b.DEFINITIONS} SELECT config_id, name, type FROM defs",
    ),
    Check(
        "i5_config_fingerprint",
        lambda s, d: fd.config_fingerprint(b.definitions(s, d)),
        f"""WITH {b.DEFINITIONS}, r AS (SELECT config_id, md5(concat_ws('|', CAST(pos AS VARCHAR), coalesce(name, ''), coalesce(type, ''),
  coalesce(CAST(min AS VARCHAR), ''), coalesce(CAST(max AS VARCHAR), ''), coalesce(array_to_string(values, ','), ''), coalesce(description, ''))) AS h FROM defs)
SELECT config_id, md5(concat_ws(':', CAST(count(*) AS VARCHAR), CAST(sum(CAST(('0x' || substring(h, 1, 15)) AS BIGINT)) AS VARCHAR),
  CAST(sum(CAST(('0x' || substring(h, 16, 15)) AS BIGINT)) AS VARCHAR))) AS config_hash FROM r GROUP BY config_id""",
    ),
    Check(
        "i10_short_name_lists",
        _names,
        f"""WITH {b.DEFINITIONS}, n AS (SELECT config_id, list_sort(list(DISTINCT name)) AS names FROM defs GROUP BY config_id),
o AS (SELECT *, list_slice(names, 1, 3) AS old FROM n)
SELECT config_id, {_first('names', 'len(names)')} AS short, CASE WHEN len(old) > 0 THEN '-(' || {_first('old', 'len(old)')} || ') +(' ||
  {_first('names', 'len(names)')} || ')' ELSE 'baseline' END AS changes FROM o""",
    ),
]
