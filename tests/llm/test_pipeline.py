import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as p
from clearfold.llm import mixing, quality
from test_decontaminate import brute as contaminated
from test_neardup import shingles


def test_stages_in_turn(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    rules = quality.learn_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    stages = dict(p.STAGES)
    kept = stages["quality_rules"](spark, docs, sf_dir).cache()
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in quality.judge(docs, rules).where("kept").collect()}

    unique = stages["near_dedup"](spark, kept, sf_dir).cache()
    assert unique.columns == docs.columns
    sets = {r["doc_id"]: shingles(r["text"]) for r in kept.collect()}
    linked = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    stay = {r["doc_id"] for r in unique.collect()}
    assert not any(linked(a, b) for a in stay for b in stay if a < b)
    assert all(any(linked(a, b) for b in sets if b != a) for a in set(sets) - stay)

    clean = stages["benchmark_decontamination"](spark, unique, sf_dir).cache()
    found = contaminated([(r["doc_id"], r["text"], None) for r in unique.collect()], items)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, *_, hit in found if not hit}

    mixed = stages["weighted_mix"](spark, clean, sf_dir).cache()
    times = {r["__id"]: r["times"] for r in mixing.mix(clean).collect()}
    assert mixed.columns == docs.columns and mixed.count() == sum(times.values())

    rows = stages["token_output"](spark, mixed, sf_dir).orderBy("start").collect()
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    texts = sorted((r["doc_id"], r["text"]) for r in mixed.collect())
    assert [r["doc_id"] for r in rows] == [i for i, _ in texts]
    assert [r["n_tokens"] for r in rows] == [len(encode(t, add_special_tokens=False).ids) + 1 for _, t in texts]


def test_quality_stage_keeps_columns_of_any_name(spark, sf_dir):
    own = ["stats", "rule", "kept", "base_failed", "row"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    named = docs.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in own])
    kept = dict(p.STAGES)["quality_rules"](spark, named, sf_dir)
    assert kept.dtypes == named.dtypes
    rows = kept.select("doc_id", *own).collect()
    assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in own)


def test_stages_over_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_near_dedup_links_from_eighty_percent(spark, documents, sf_dir):
    from test_neardup import between

    docs = documents([(2 * i + k, t, "s") for i, pair in enumerate(between(80, 85, 30)) for k, t in enumerate(pair)])
    assert sorted(r["doc_id"] for r in dict(p.STAGES)["near_dedup"](spark, docs, sf_dir).select("doc_id").collect()) == list(range(0, 60, 2))
