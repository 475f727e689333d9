import datetime as dt

import pytest

from clearfold.sources import corpora, results


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_with_quotes_and_line_breaks(spark, tmp_path):
    p = write(tmp_path / "a.csv", 'id,body,verdict,extra_col\n1,"line one\nline ""two"", end",NTA,1\n2,plain,YTA,2\n')
    rows = corpora.read_corpus(spark, p).collect()
    assert [r.body for r in rows] == ['line one\nline "two", end', "plain"] and rows[0].extra_col == "1"


def test_recode_on_load(spark, tmp_path):
    p = write(tmp_path / "a.csv", "body,verdict\na,NTA\nb,YTA\nc,NAH\nd,ESH\n")
    assert [r.verdict for r in corpora.read_corpus(spark, p).collect()] == ["NTA", "YTA", "NTA"]
    assert [r.verdict for r in corpora.read_corpus(spark, p, binary_labels=False).collect()] == ["NTA", "YTA", "NAH", "ESH"]


@pytest.mark.parametrize("header,missing", [("wrong_column,verdict", "body"), ("body,wrong_label", "verdict")])
def test_missing_columns(spark, tmp_path, header, missing):
    p = write(tmp_path / "a.csv", header + "\nx,NTA\n")
    with pytest.raises(ValueError, match=missing):
        corpora.read_corpus(spark, p)


def test_custom_columns_and_ids(spark, tmp_path):
    p = write(tmp_path / "a.csv", "text_content,label\nsame,NTA\nsame,YTA\n")
    df = corpora.with_row_ids(corpora.read_corpus(spark, p, "text_content", "label"))
    assert df.count() == 2 and df.select("id").distinct().count() == 2


def test_posts_and_comments(spark, tmp_path):
    spark.createDataFrame([(1, "a", "t", "b", 3, "x")], "id long, submission_id string, title string, selftext string, score long, other string").write.parquet(
        str(tmp_path / "posts")
    )
    spark.createDataFrame([(1, "a", "m", 3)], "comment_id long, submission_id string, message string, score long").write.parquet(str(tmp_path / "comments"))
    assert corpora.read_posts(spark, str(tmp_path / "posts")).columns == list(corpora.POST_COLUMNS)
    assert corpora.read_comments(spark, str(tmp_path / "comments")).count() == 1


def test_results_round_trip(spark, tmp_path):
    rows = [(0.5, ["a"], ("r1",), dt.datetime(2024, 1, 2, 3, 4, 5))]
    df = spark.createDataFrame(rows, "accuracy double, features array<string>, metadata struct<run:string>, timestamp timestamp")
    results.write_results(df, str(tmp_path / "r"), "run1")
    back = results.read_results(
        spark, str(tmp_path / "r"), "run1", "accuracy double, features array<string>, metadata struct<run:string>, timestamp string"
    ).first()
    assert back.accuracy == 0.5 and back.features == ["a"] and back.metadata.run == "r1"
    assert back.timestamp.startswith("2024-01-02 03:04:05")


def test_feature_matrix_keeps_types(spark, tmp_path):
    df = spark.createDataFrame([("1", 3, True, "x")], "id string, s int, b boolean, c string")
    results.write_features(df, str(tmp_path / "f"), "a")
    results.write_features(df.limit(0), str(tmp_path / "f"), "b")
    assert results.read_features(spark, str(tmp_path / "f"), "a", df.schema).collect() == df.collect()


def test_sample_posts(spark):
    rows = corpora.read_corpus(spark).collect()
    assert len({r.id for r in rows}) == 12 and sorted(r.verdict for r in rows) == ["NTA"] * 9 + ["YTA"] * 3
