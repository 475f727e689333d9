import hashlib
import random
import re

import pytest

from clearfold.llm import decontaminate as d

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return W.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, n=10):
    out = []
    for i, t, _ in docs:
        w, hit, ids = words(t), set(), set()
        for item, text in items:
            iw = words(text)
            m = min(n, len(iw))
            windows = {tuple(iw[k : k + m]) for k in range(len(iw) - m + 1)} if iw else set()
            at = [k for k in range(len(w) - m + 1) if tuple(w[k : k + m]) in windows]
            hit |= {p for k in at for p in range(k, k + m)}
            ids |= {str(item)} if at else set()
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def case(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["é", "Ab", "x1", "ß\U0001f600"]
    prose = lambda n: r.choice([" ", ", ", "--"]).join(r.choices(vocabulary, k=n))
    items = [(k, prose(r.choice([1, 3, 9, 10, 11, 25]))) for k in range(8)] + [(100, None), (101, "!?"), (3, "w1 w1"), (200, "w1 w1")]
    docs = [(k, " ".join([prose(r.randint(0, 30)), r.choice(items)[1] or "", prose(r.randint(0, 30)), r.choice(items)[1] or ""]), "s") for k in range(40)]
    return docs + [(50, None, "s"), (51, "", "s"), (52, "... ", None), docs[0], docs[1], (53, (items[3][1] + " | ") * 400, "s")], items


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, documents, seed):
    docs, items = case(seed)
    got = d.report(documents(docs), spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items)


def test_empty_sides(spark, documents):
    docs, items = case(9)
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert {r["n_hit"] for r in d.report(documents(docs), none).collect()} == {0}
    assert d.report(documents(docs).limit(0), spark.createDataFrame(items, "item_id bigint, text string")).count() == 0


def test_removal(spark, documents):
    item = "one two three four five six seven eight nine ten eleven"
    docs = documents([(1, f"Start here. {item.upper()}! The end.", "s"), (2, "clean text", None), (None, item, "s"), (3, None, "s")])
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    left = d.decontaminate(docs, items)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [2, 3]
    cut = d.decontaminate(docs, items, remove="spans")
    assert cut.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {1: "Start here. ! The end.", 2: "clean text", None: "", 3: None}
    with pytest.raises(ValueError):
        d.decontaminate(docs, items, remove="all")
