import random
from itertools import combinations

import numpy as np
import pytest

from clearfold.llm import neardup as n
from clearfold.llm.graph import components


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    sets = [(i, shingles(t)) for i, t, _ in docs]
    least = {i: i for i, _ in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for (a, x), (b, y) in combinations(sets, 2):
        if x and y and a is not None and b is not None and 100 * len(x & y) >= 85 * len(x | y):
            low, high = sorted((root(a), root(b)))
            least[high] = low
    return sorted((i, len(s), None if i is None else root(i)) for i, s in sets if i is not None)


def case(seed, n_docs=60):
    r = random.Random(seed)
    prose = lambda k: [r.choice("abcdefghij") + str(r.randint(0, 400)) for _ in range(k)]
    docs, base = [], []
    for i in range(n_docs):
        if base and r.random() < 0.6:
            w = list(r.choice(base))
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                w[r.randrange(len(w))] = f"new{r.random()}"
        else:
            w = prose(r.choice([1, 3, 4, 5, 6, 12, 60, 200]))
            base.append(w)
        docs.append((i, " ".join(w), "s"))
    return docs + [(900, None, "s"), (901, "", "s"), (902, " \n", "s"), (903, "A b C", "s"), (904, "a B c", None)]


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, documents, seed):
    docs = case(seed)
    got = n.report(documents(docs))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute(docs)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


def test_large_group_of_near_copies(spark, documents):
    """Copies with independent edits: many are linked with each other only through others."""
    r = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(300):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(120)] = f"e{r.random()}"
        docs.append((i, " ".join(w), "s"))
    got = n.report(documents(docs, extra=False))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute(docs)


def test_null_ids_repeated_rows_and_empty_table(spark, documents):
    docs = documents([(None, "a b c d e f", "s"), (5, "a b c d e f", "s"), (7, "A B c d e f", "s"), (5, "a b c d e f", "s"), (5, "other words", "s")])
    rows = n.near_duplicates(docs).collect()
    assert len(rows) == 5
    assert {(r["__id"], r["component"], r["kept"]) for r in rows} == {(None, None, True), (5, 5, True), (7, 5, False)}
    left = n.deduplicate(docs)
    assert left.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["5", "None"]
    assert n.report(docs.limit(0)).count() == 0
    assert n.deduplicate(docs.limit(0)).count() == 0


def test_sketch_distance_follows_similarity():
    memo, buffer = n._WordHashes(), np.empty((512, n.SAMPLES), np.uint32)
    r = random.Random(2)
    base = [str(r.random()) for _ in range(3000)]
    at_threshold = over = 0
    for _ in range(60):
        own = n.shingle_set(" ".join(base), memo)
        part = np.unique(np.concatenate([own[: int(len(own) * 0.925)], n.shingle_set(" ".join(str(r.random()) for _ in range(250)), memo)]))
        common = len(np.intersect1d(own, part))
        at_threshold += common / (len(own) + len(part) - common) < 0.87
        a, b = n.sketch(own, buffer)[1].view(np.uint64), n.sketch(part, buffer)[1].view(np.uint64)
        over += int(np.bitwise_count(a ^ b).sum()) > n.most_different_bits(85)
    assert at_threshold == 60 and over == 0


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(300)] + [(0, i) for i in range(1, 60)] + [(None, 1)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    least = {i: i for i in range(400)}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for a, b in links:
        if a is not None:
            low, high = sorted((root(a), root(b)))
            least[high] = low
    linked = {x for a, b in links if a is not None and a != b for x in (a, b)}
    assert got == {i: root(i) for i in linked}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def between(low, high, n):
    """Pairs of texts whose similarity in percent is at least ``low`` and less than ``high``."""
    r, out = random.Random(11), []
    while len(out) < n:
        w = [f"w{r.random()}" for _ in range(r.randint(60, 300))]
        v = list(w)
        for _ in range(r.randint(1, 12)):
            v[r.randrange(len(v))] = f"e{r.random()}"
        x, y = shingles(" ".join(w)), shingles(" ".join(v))
        if low * len(x | y) <= 100 * len(x & y) < high * len(x | y):
            out.append((" ".join(w), " ".join(v)))
    return out


def test_bands_follow_the_threshold():
    assert n.bands_for(85) == (24, 5)
    for percent in range(3, 101):
        bands, rows = n.bands_for(percent)
        assert bands * rows <= n.SAMPLES and (1 - (percent / 100) ** rows) ** bands <= n.MISS
    for percent in (0, 2, 101):
        with pytest.raises(ValueError):
            n.bands_for(percent)


@pytest.mark.parametrize("percent", [80, 50])
def test_pairs_just_over_a_threshold(spark, documents, percent):
    pairs = between(percent, percent + 5, 40)
    docs = documents([(2 * i + k, t, "s") for i, pair in enumerate(pairs) for k, t in enumerate(pair)])
    assert sorted(r["doc_id"] for r in n.deduplicate(docs, percent=percent).select("doc_id").collect()) == list(range(0, 80, 2))
    assert n.deduplicate(docs, percent=percent + 5).count() == 80
