import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clearfold.llm import chat as c

PIECES = ["</s>", "[INST]", " [/INST]", "<s>", "\\", "\\.", "<<SYS>>", "<</SYS>>", "\n", " ", "ok", "[ROLE]", "[END]", "[OUT] ", "é\U0001f600", "$1", "[/ROLE] ", "<", "["]
TEXT = st.lists(st.sampled_from(PIECES), max_size=6).map("".join)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "a\\[END] b"]), TEXT), min_size=1, max_size=30))
def test_turns_come_back(spark, turns):
    rows = [(i // 3, i % 3, r, t) for i, (r, t) in enumerate(turns)]
    got = {r["conv_id"]: r for r in c.format_conversations(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).select("conv_id", "formatted", c.read_turns(F.col("formatted")).alias("t")).collect()}
    for conv in {r[0] for r in rows}:
        assert [(x["role"], x["text"]) for x in got[conv]["t"]] == [(r, t) for k, _, r, t in rows if k == conv]


def test_report(spark):
    rows = [(1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 0, "user", "q"), (2, 0, "user", None), (2, 1, None, "x"), (None, None, "assistant", "a"),
            (3, 0, "assistant", "early"), (4, 0, "system", "s"), (4, 1, "user", "u"), (4, 2, "assistant", "one"), (4, 3, "user", "u"), (4, 4, "assistant", "two"), (5, 0, "user", "x" * 200_000), (5, 0, "user", "x" * 200_000)]
    df = spark.createDataFrame([(*r, "e") for r in rows], "conv_id bigint, turn bigint, role string, text string, rows string")
    got = {r["conv_id"]: r for r in c.report(df).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("user\nq\nassistant\n</s>[INST] ok [/INST]\n")
    assert (got[1]["loss_chars"], got[1]["loss_sha256"], got[1]["valid"]) == (21, sha("</s>[INST] ok [/INST]"), True)
    assert got[2]["turns_sha256"] == sha("user\n\n\nx\n") and not got[2]["valid"]
    assert (got[4]["loss_sha256"], got[4]["n_turns"], got[4]["valid"]) == (sha("onetwo"), 5, True)
    assert not got[3]["valid"] and got[3]["loss_sha256"] == sha("early")
    assert got[5]["n_turns"] == 2 and got[None]["n_turns"] == 1
    assert c.report(df.limit(0)).count() == 0


@pytest.mark.parametrize("roles,valid", [("ua", True), ("sua", True), ("uaua", True), ("u", False), ("au", False), ("ssua", False), ("uua", False), ("uas", False)])
def test_order_of_roles(spark, roles, valid):
    names = {"u": "user", "a": "assistant", "s": "system"}
    df = spark.createDataFrame([(1, i, names[r], "t") for i, r in enumerate(roles)], "conv_id int, turn int, role string, text string")
    assert c.report(df).first()["valid"] is valid
