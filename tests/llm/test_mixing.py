import random

import pytest
from pyspark.sql import functions as F

from clearfold.llm import mixing as m


def filled(sizes, weights, passes=3):
    """Targets by resharing what exceeds a cap, again and again."""
    total, free, target = sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    left = float(total)
    while free:
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = {i for i in free if share[i] > passes * sizes[i]}
        if not over:
            for i in free:
                target[i] = share[i]
            break
        for i in over:
            target[i] = float(passes * sizes[i])
            left -= target[i]
        free -= over
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    r = random.Random(seed)
    sizes = [r.choice([0, 1, 10, 100, 1000, 1000]) * r.randint(1, 9) for _ in range(r.randint(1, 9))]
    names = [None] + sorted((chr(70 + i) if i % 2 else chr(0x10000 + i) for i in range(len(sizes) - 1)), key=lambda s: s.encode())
    df = spark.createDataFrame([(n, s) for n, s in zip(names, sizes)], "source string, size bigint")
    order = sorted(range(len(sizes)), key=lambda i: (names[i] is None, (names[i] or "").encode()))
    expected = filled([sizes[i] for i in order], [1 + k % 3 for k in range(len(order))])
    got = {x["source"]: x["target"] for x in m.source_targets(df).collect()}
    assert all(got[names[i]] == pytest.approx(t) for i, t in zip(order, expected))


def test_mix_comes_near_its_targets(spark, documents):
    r = random.Random(8)
    rows = [(i, "w " * r.randint(0, 30), r.choice(["a", "a", "a", "a", "b", "c", None])) for i in range(1500)]
    got = m.mix(documents(rows)).cache()
    assert got.count() == 1500
    for x in got.groupBy("source", "source_size", "target").agg(F.sum("taken").alias("taken"), F.max("times").alias("times")).collect():
        assert abs(x["taken"] - x["target"]) <= 31 and x["times"] <= 3
    again = m.mix(documents(rows).repartition(7))
    key = ["__id", "taken"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, again.select(key).collect()))
    taken = m.take(documents(rows))
    assert taken.columns == documents(rows).columns and taken.count() == got.agg(F.sum("times")).first()[0]


def test_awkward_rows(spark, documents):
    rows = [(None, "a b", None), (1, None, "x"), (2, "", "x"), (3, "w " * 5000, "x"), (4, "b c", "y"), (4, "b c", "y"), (5, "z", "")]
    got = m.mix(documents(rows)).collect()
    assert len(got) == 7
    assert all(r["taken"] == r["times"] * r["size"] and 0 <= r["times"] <= 3 for r in got)
    assert m.mix(documents([]).limit(0)).count() == 0
    assert m.take(documents([(1, "", "x")])).count() == 0
