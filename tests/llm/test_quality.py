import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clearfold.llm import quality as q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    hit = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, r = len(words), len(hit)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n)


TEXTS = [None, "", " \n\t ", "a", "a b", "a b c", "a b c a b c", "a a a a a", "x\nx\n\nx\n y", "# * <b> |", "é ü 中 \U0001f600 a", "tab\tand\x0bvt",
         "word " * 3000, " ".join(f"w{i}" for i in range(30000)), "a b c d " * 20 + " ".join(map(str, range(100)))]


def rows_of(df):
    s = [F.col(f"stats.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return [tuple(r) for r in df.select("doc_id", *s, "base_failed", "kept").collect()]


def test_statistics_equal_brute_force(spark, documents):
    got = rows_of(q.judge(documents([(i, t, "s") for i, t in enumerate(TEXTS)]), []))
    assert {r[0]: r[1:7] for r in got} == {i: brute(t) for i, t in enumerate(TEXTS)}
    assert all(r[7] == (not r[6]) for r in got)


@settings(max_examples=15, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from("ab \n#é"), max_size=60), min_size=1, max_size=30))
def test_statistics_of_any_text(spark, documents, texts):
    got = rows_of(q.judge(documents([(i, t, "s") for i, t in enumerate(texts)], extra=False), []))
    assert {r[0]: r[1:7] for r in got} == {i: brute(t) for i, t in enumerate(texts)}


def test_learns_a_threshold_conjunction():
    r = np.random.default_rng(1)
    x = r.random((3000, 3))
    bad = ((x[:, 0] > 0.7) & (x[:, 2] <= 0.4)).astype(int)
    rules = q.learn(x, bad, names=("a", "b", "c"))
    hit = np.zeros(len(x), bool)
    for rule in rules:
        inside = np.ones(len(x), bool)
        for c in rule.conditions:
            inside &= (x[:, "abc".index(c.feature)] > c.threshold) == c.above
        hit |= inside
    assert (hit == bad).mean() > 0.97


def test_nothing_to_learn():
    assert q.learn(np.empty((0, 8)), np.empty(0, int)) == []
    assert q.learn(np.ones((5, 8)), np.ones(5, int)) == []


def test_empty_tables_and_nulls(spark, documents):
    labels = spark.createDataFrame([(None, 0), (1, None), (2, 0), (2, 1), (3, 1)], "doc_id bigint, quality int")
    docs = documents([(1, "a", None), (2, None, "s"), (None, "b", "s"), (3, "c", "s")])
    assert q.learn_rules(docs, labels) == []
    assert q.learn_rules(docs.limit(0), labels.limit(0)) == []
    assert q.judge(docs.limit(0), []).count() == 0


def test_one_row_per_label_comes_back(spark, documents, monkeypatch):
    seen = []
    monkeypatch.setattr(q, "learn", lambda x, y: seen.append((len(x), len(y))) or [])
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (3, 1)], "doc_id bigint, quality int")
    q.learn_rules(documents([(i % 2 + 1, f"text {i % 7}", "s") for i in range(400)]), labels, max_labelled=2)
    assert seen[0][0] == seen[0][1] <= 2


def test_held_out_accuracy(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/../sf0.1/documents.parquet"), spark.read.parquet(f"{sf_dir}/../sf0.1/labels.parquet")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    rules = q.learn_rules(docs, labels.where(fold == 0))
    judged = q.judge(docs, rules).join(labels.where(fold == 1), "doc_id").where(~F.col("base_failed"))
    hit = judged.agg(F.avg(F.when((F.col("quality") == 1) == F.col("kept"), 1.0).otherwise(0.0))).first()[0]
    lost = judged.where(F.col("quality") == 1).agg(F.avg(F.when(F.col("kept"), 0.0).otherwise(1.0))).first()[0]
    assert hit > 0.95 and lost < 0.02
