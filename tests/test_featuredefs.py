import pytest
from pyspark.sql import functions as F

from clearfold.operators import featuredefs as fd
from clearfold.sources.configs import read_configs, write_configs


def config(*features, name="c"):
    return {"name": name, "features": list(features)}


SCALE = {"name": "s", "type": "scale", "min": 1, "max": 3, "description": "d"}
FLAG = {"name": "f", "type": "bool", "description": "d"}


def choice(name, n):
    return {"name": name, "type": "categorical", "values": [f"v{i}" for i in range(n)], "description": "d"}


def names(df):
    return [r.name for r in df.orderBy("pos").collect()]


def test_shipped_sets(spark):
    kinds = lambda c: sorted(f["type"] for f in c["features"])
    assert kinds(fd.DEFAULT_SET) == ["scale"] * 8
    assert kinds(fd.FULL_SET) == ["bool"] * 8 + ["categorical"] + ["scale"] * 6
    assert kinds(fd.MINIMAL_SET) == ["bool", "categorical", "scale"]
    table = fd.defs_table(spark, fd.DEFAULT_SET, fd.FULL_SET, fd.MINIMAL_SET)
    assert fd.check_definitions(table).where(F.size("errors") > 0).count() == 0


def test_costs(spark):
    df = fd.defs_table(spark, config(FLAG, SCALE, choice("a", 4), choice("b", 0)))
    assert [r[0] for r in df.orderBy("pos").select(fd.column_cost()).collect()] == [1, 1, 3, 0]
    assert fd.config_cost(fd.defs_table(spark, config(FLAG, SCALE, choice("a", 3)))).first().total_cost == 4


def test_budget(spark):
    n = [(74,), (20,), (50,), (54,), (58,), (62,), (1000,)]
    got = [r[0] for r in spark.createDataFrame(n, "n int").select(fd.column_budget(F.col("n"))).collect()]
    assert got == [18, 12, 12, 14, 14, 16, 25]  # 12.5, 13.5, 14.5 and 15.5 round to even


def test_prune_drops_categoricals_first(spark):
    df = fd.defs_table(spark, config(FLAG, SCALE, choice("big", 6), choice("med", 3)))
    assert names(fd.prune(df, F.lit(3))) == ["f", "s"]
    assert names(fd.prune(df, F.lit(4))) == ["f", "s", "med"]
    assert names(fd.prune(df, F.lit(9))) == ["f", "s", "big", "med"]
    assert names(fd.prune(df, F.lit(0))) == []


def test_prune_equals_step_by_step_removal(spark):
    """Against the rule applied one removal at a time."""
    import random

    rnd = random.Random(5)
    configs = []
    for k in range(40):
        feats = []
        for i in range(rnd.randint(1, 9)):
            kind = rnd.choice(["bool", "scale", "categorical"])
            f = {"name": f"x{i}", "type": kind, "description": ""}
            if kind == "categorical":
                f["values"] = [str(v) for v in range(rnd.randint(0, 6))]
            feats.append(f)
        configs.append({"name": f"c{k}", "features": feats})
    cost = lambda f: max(len(f["values"]) - 1, 0) if f["type"] == "categorical" else 1
    rank = {"categorical": 2, "scale": 1, "bool": 0}
    got = {}
    for r in fd.prune(fd.defs_table(spark, *configs), F.lit(6)).collect():
        got.setdefault(r.config_id, set()).add(r["name"])
    for c in configs:
        left = list(c["features"])
        while left and sum(map(cost, left)) > 6:
            worst = max(range(len(left)), key=lambda i: (rank[left[i]["type"]], cost(left[i]), -i))
            left.pop(worst)
        assert got.get(c["name"], set()) == {f["name"] for f in left}


def test_edits(spark):
    df = fd.defs_table(spark, fd.MINIMAL_SET)
    extra = fd.defs_table(spark, {"name": "minimal", "features": [{"name": "new_test_feature", "type": "bool"}]})
    assert names(fd.add_definition(df, extra))[-1] == "new_test_feature"
    again = fd.defs_table(spark, {"name": "minimal", "features": [{"name": "sentiment", "type": "scale"}]})
    with pytest.raises(ValueError):
        fd.add_definition(df, again)
    assert names(fd.remove_definition(df, "sentiment")) == ["self_aware", "conflict_type"]
    assert fd.get_definition(df, "missing").count() == 0


def test_schema_and_descriptions():
    schema = fd.record_schema(fd.MINIMAL_SET["features"])
    assert [f.dataType.typeName() for f in schema] == ["integer", "boolean", "string"]
    assert schema["conflict_type"].metadata["comment"].endswith("(One of: personal, professional, family, other)")
    with pytest.raises(ValueError, match="invalid_type"):
        fd.record_schema([{"name": "x", "type": "invalid_type", "description": ""}])


def test_definition_check(spark):
    rows = config(
        {"name": "ok1", "type": "scale", "min": 1, "max": 10}, {"name": "ok2", "type": "bool"}, choice("ok3", 3),
        {"name": "bad1", "type": "scale"}, {"name": "bad2", "type": "categorical"}, {"name": "bad3", "type": "invalid"},
        {"name": "twice", "type": "bool"}, {"name": "twice", "type": "bool"},
    )
    got = [(r["name"], len(r["errors"])) for r in fd.check_definitions(fd.defs_table(spark, rows)).orderBy("pos").collect()]
    assert got == [("ok1", 0), ("ok2", 0), ("ok3", 0), ("bad1", 1), ("bad2", 1), ("bad3", 1), ("twice", 1), ("twice", 1)]


def test_fingerprint(spark):
    a, b = dict(SCALE), {k: SCALE[k] for k in reversed(SCALE)}
    h = lambda c: fd.config_fingerprint(fd.defs_table(spark, c)).first().config_hash
    assert h(config(a)) == h(config(b, name="renamed"))
    assert h(config(a)) != h(config(FLAG))
    assert h(config(a, FLAG)) != h(config(FLAG, a))


def test_changes(spark):
    df = fd.defs_table(spark, config(SCALE, FLAG, choice("a", 3)))
    gone = spark.createDataFrame([("c", 0, "s"), ("c", 1, "a"), ("c", 2, "f")], "config_id string, pos int, name string")
    ddl = "config_id string, pos int, name string, feature_type string, description string, min_val int, max_val int, values array<string>"
    new = spark.createDataFrame(
        [("c", 0, "f", "bool", "", None, None, None), ("c", 1, "n", "scale", "", None, None, None), ("c", 2, "late", "bool", "", None, None, None)], ddl
    )
    out = fd.apply_changes(df, gone, fd.definition_from_proposal(new), 2)
    assert names(out) == ["f", "n"]
    n = out.where("name = 'n'").first()
    assert (n["min"], n["max"]) == (1, 5)


def test_documents(spark, tmp_path):
    df = fd.defs_table(spark, fd.MINIMAL_SET, fd.FULL_SET)
    write_configs(df, str(tmp_path / "cfg"))
    (tmp_path / "one.json").write_text('{"name": "m", "description": "", "features": [\n {"type": "bool", "name": "x", "description": "d"}]}')
    back = spark.read.schema("name string").json(str(tmp_path / "cfg"))
    assert back.count() == 2
    assert names(read_configs(spark, str(tmp_path / "one.json"))) == ["x"]


def test_encoded_cost_ignores_name_prefixes(spark):
    df = fd.defs_table(spark, config(choice("a", 3), choice("a_b", 3), FLAG))
    seen = spark.createDataFrame([("a", "v0"), ("a", "v1"), ("a_b", "v0"), ("a_b", "v1"), ("a_b", "v2")], "name string, value string")
    assert [tuple(r) for r in fd.encoded_costs(df, seen).collect()] == [("a_b", 2), ("a", 1), ("f", 1)]
