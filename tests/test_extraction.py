import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clearfold.operators import extraction as ex
from clearfold.operators import requests as rq
from clearfold.operators.metrics import cost_by_model

REC = T.StructType([T.StructField("n", T.IntegerType())])
FAST = dict(max_concurrent=2, requests_per_minute=None, backoff=lambda a: 0.0)


def counting(path):
    """An extractor that leaves one line per call."""
    def factory():
        def extract(text, ident):
            with open(path, "a") as f:
                f.write(ident + "\n")
            if "bad" in text:
                raise RuntimeError("boom")
            if "no" in text:
                raise ex.Refused("declined")
            return ex.Extraction({"n": len(text)}, 10, 2)

        return extract

    return factory


def docs(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, body string")


def test_retries_and_statuses(spark, tmp_path):
    calls = tmp_path / "calls"
    out = ex.run_extractor(docs(spark, "fine", "bad", "no"), counting(str(calls)), REC, **FAST).collect()
    by = {r.id: r for r in out}
    assert (by["0"].status, by["0"].attempt, by["0"].record.n) == ("ok", 1, 4)
    assert (by["1"].status, by["1"].attempt, by["1"].error) == ("failed", 3, "boom")
    assert by["2"].status == "refused" and by["2"].record is None
    assert len(calls.read_text().split()) == 1 + 3 + 3
    ok, failed = ex.split_status(spark.createDataFrame(out, ex.output_schema(REC)))
    assert ok.collect()[0].n == 4 and failed.count() == 2


def test_wait_only_between_failed_attempts():
    waits = []
    def failing(text, ident):
        raise RuntimeError("x")
    def refusing(text, ident):
        raise ex.Refused("x")
    note = lambda a: waits.append(a) or 0.0
    ex._attempts(failing, "t", "i", 2, ex.Pace(0.0), note)
    assert waits == [0, 1]
    ex._attempts(refusing, "t", "i", 2, ex.Pace(0.0), note)
    assert waits == [0, 1]


def test_pace(spark, tmp_path):
    texts = ["t" + str(i) for i in range(6)]
    start = time.time()
    ex.run_extractor(docs(spark, *texts), counting(str(tmp_path / "c")), REC, max_concurrent=1, requests_per_minute=600).collect()
    assert time.time() - start >= 0.6  # six requests at ten per second


def test_cache_extracts_each_text_once(spark, tmp_path):
    calls, table = tmp_path / "calls", str(tmp_path / "cache")
    keyed = ex.with_cache_key(docs(spark, "same", "same", "other", "bad"), "abc123")
    cache = ex.extract_into_cache(keyed, table, counting(str(calls)), REC, call_id="one", **FAST)
    assert cache.where("status = 'ok'").count() == 2
    assert len(calls.read_text().split()) == 2 + 3
    again = ex.extract_into_cache(keyed, table, counting(str(calls)), REC, call_id="two", batches=3, **FAST)
    assert len(calls.read_text().split()) == 5 + 3  # only the failed text is tried again
    assert again.where("status = 'ok' and call_id = 'two'").count() == 0


def test_a_call_reads_the_records_of_its_own_keys(spark, tmp_path):
    path = str(tmp_path / "cache")
    factory = lambda: lambda text, ident: ex.Extraction({"n": 1})
    every = ex.with_cache_key(docs(spark, *[f"t{i}" for i in range(200)]), "h")
    ex.extract_into_cache(every, path, factory, REC, **FAST)
    few = ex.extract_into_cache(every.where(F.col("id").isin("1", "2", "3")), path, factory, REC, **FAST)
    assert few.count() == 3
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert plan.index("LeftSemi") > plan.index("Window")  # below the window that ranks the rows of a key
    assert ex.read_cache(spark, path, few.schema).count() == 200


def test_cache_is_scoped_by_config(spark):
    df = docs(spark, "text")
    a = ex.with_cache_key(df, "abc123").first().cache_key
    b = ex.with_cache_key(df, "def456").first().cache_key
    assert a != b
    cache = spark.createDataFrame([(a, 1)], "cache_key string, v int")
    assert ex.cache_hits(ex.with_cache_key(df, "abc123"), cache).count() == 1
    assert ex.cache_misses(ex.with_cache_key(df, "def456"), cache).count() == 1


def test_all_failing_gives_an_empty_table(spark, tmp_path):
    out = ex.run_extractor(docs(spark, "bad"), counting(str(tmp_path / "c")), REC, **FAST)
    ok, failed = ex.split_status(out.persist())
    assert ok.columns == ["id", "n"] and ok.count() == 0 and failed.count() == 1
    assert ex.run_extractor(docs(spark, "x").limit(0), counting(str(tmp_path / "c")), REC, **FAST).count() == 0


def test_record_bounds(spark):
    defs = [
        {"name": "s", "type": "scale", "min": 1, "max": 5}, {"name": "b", "type": "bool"}, {"name": "c", "type": "categorical", "values": ["red"]},
    ]
    rows = [(3, True, "red"), (6, True, "purple"), (0, None, "red"), (None, True, None)]
    got = [(r.valid, list(r.errors)) for r in ex.check_records(spark.createDataFrame(rows, "s int, b boolean, c string"), defs).collect()]
    assert got == [
        (True, []), (False, ["s: above 5"]), (False, ["s: below 1", "b: missing"]), (False, ["s: missing", "c: missing"]),
    ]


def test_log_feeds_cost(spark, tmp_path):
    out = ex.run_extractor(docs(spark, "aa", "b"), counting(str(tmp_path / "c")), REC, **FAST)
    log = ex.extraction_log(out, "gpt-5")
    cost = cost_by_model(log.select("model", "usage.*")).first()
    assert cost.input_tokens == 20 and cost.output_tokens == 4
    assert cost.total_cost_usd == pytest.approx(20 * 1.25e-6 + 4 * 10e-6)


def test_answers_with_text_numbers(spark):
    text = (
        '{"summary": "s", "feature_evaluations": [{"feature_name": "a", "usefulness_score": "3", "reasoning": "r", "keep": true}], '
        '"features_to_remove": ["a", "b"], "proposed_features": [{"name": "n", "feature_type": "scale", "description": "d", '
        '"min_val": "1", "max_val": null, "values": null, "rationale": "r"}], "expected_improvement": "e"}'
    )
    parsed = rq.parse_answers(spark.createDataFrame([(1, text)], "k int, response string"), rq.ITERATION_DDL)
    e = rq.feature_evaluations(parsed, ["k"]).first()
    assert e.usefulness_score == 3 and e.keep is True
    assert [r.name for r in rq.requested_removals(parsed, ["k"]).orderBy("pos").collect()] == ["a", "b"]
    a = rq.requested_additions(parsed, ["k"]).first()
    assert a.min_val == 1 and a.max_val is None


def test_residual_request_without_errors_is_empty(spark):
    none = spark.createDataFrame([], "id int, true_label string, predicted_label string, text string")
    assert rq.residual_request(none, ["a"]).count() == 0
    assert rq.bullet_list([]) == "(none)"


def test_pace_counts_the_time_of_calls():
    pace, started = ex.Pace(0.05), time.monotonic()
    for _ in range(6):
        pace.wait()
        time.sleep(0.03)
    assert 0.27 <= time.monotonic() - started < 0.45


def test_overlapping_calls_leave_one_row_per_key(spark, tmp_path):
    keyed = ex.with_cache_key(spark.createDataFrame([(i, f"t{i % 3}") for i in range(6)], "id int, body string"), "h")
    factory = lambda: lambda text, ident: ex.Extraction({"n": 1})
    path = str(tmp_path / "cache")
    first = ex.extract_into_cache(keyed, path, factory, REC, call_id="a", requests_per_minute=None)
    once = first.collect()
    assert len(once) == 3
    ex.append_cache(spark.createDataFrame(once, first.schema).withColumn("call_id", F.lit("b")), path)
    again = ex.read_cache(spark, path, first.schema).collect()
    assert len(again) == 3 and {r.call_id for r in again} == {"a"}


def test_a_call_reads_the_folders_of_its_prefixes(spark, tmp_path):
    path = str(tmp_path / "cache")
    factory = lambda: lambda text, ident: ex.Extraction({"n": len(text)})
    every = ex.with_cache_key(docs(spark, *[f"t{i}" for i in range(300)], None), "h")
    ex.extract_into_cache(every, path, lambda: lambda text, ident: ex.Extraction({"n": len(text or "")}), REC, call_id="a", **FAST)
    few = every.where(F.col("id").isin("1", "2", "3"))
    got = ex.extract_into_cache(few, path, factory, REC, call_id="b", **FAST)
    assert {r.call_id for r in got.collect()} == {"a"} and got.count() == 3
    plan = got._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters: [") :].split("]")[0]
    assert "bucket" in filters and all(f"k{r.cache_key[:2]}" in filters for r in few.collect())
    assert ex.read_cache(spark, path, got.schema).where("cache_key is not null").count() == 300


def test_compaction_keeps_the_answers(spark, tmp_path):
    path, out = str(tmp_path / "cache"), str(tmp_path / "compact")
    texts = ex.with_cache_key(docs(spark, "bad", *[f"t{i}" for i in range(40)]), "h")
    for call in ("a", "b"):
        got = ex.extract_into_cache(texts, path, counting(str(tmp_path / "calls")), REC, call_id=call, **FAST)
    doubled = got.where("status = 'ok'").withColumn("call_id", F.lit("c"))
    ex.append_cache(spark.createDataFrame(doubled.collect(), got.schema), path)
    ex.compact_cache(spark, path, got.schema, out)
    same = lambda p: sorted(map(str, ex.read_cache(spark, p, got.schema).where("status = 'ok'").collect()))
    assert same(path) == same(out) and len(same(out)) == 40
    assert spark.read.parquet(out).count() == 41 and ex.read_cache(spark, out, got.schema).where("status <> 'ok'").count() == 1
    folders = [f for f in (tmp_path / "compact").iterdir() if f.is_dir()]
    assert all(len(list(f.glob("*.parquet"))) == 1 for f in folders)
