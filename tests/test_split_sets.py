from clearfold.checks.modelling import _split_sets


def test_texts_are_read_once_for_all_roles(spark, tmp_path):
    d = str(tmp_path)
    texts = [(i, "the cat, " * (i % 9) + ("7" if i % 2 else "")) for i in range(60)] + [(None, None), (3, "a copy")]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, i % 3 % 2) for i in range(50)], "doc_id bigint, quality int").write.parquet(f"{d}/labels.parquet")
    rows, keys = _split_sets(spark, d)
    for part in (rows("train", 0), rows("validation"), rows("test")):
        assert "documents.parquet" not in "".join(part.inputFiles())  # before: every fit and every score read the texts again
    every = [r["id"] for part in (rows("train"), rows("validation"), rows("test")) for r in part.collect()]
    assert set(every) <= {r["id"] for r in keys.collect()} and every.count("3") in (0, 2) and len(every) > 40
