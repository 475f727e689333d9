import random

from pyspark.sql import functions as F

from clearfold.operators.corpus import top_votes
from clearfold.plans.corpus_build import vote_consensus
from clearfold.streaming import votes as votes_module
from clearfold.streaming.votes import current_top_votes, follow_top_votes, followed_verdicts

VOTES = "post_id string, comment_id string, label string, score int"


def some(seed, n):
    rng = random.Random(seed)
    post = lambda: "hot" if rng.random() < 0.4 else f"p{rng.randrange(12)}"
    return [(post(), f"{seed}-{i:04d}", rng.choice(["NTA", "YTA", "ESH", None]), rng.choice([None, *range(-3, 9)])) for i in range(n)]


def test_top_votes_of_a_stream_over_restarts(spark, tmp_path):
    source, best, cp = (str(tmp_path / n) for n in ("votes", "best", "cp"))
    rows = []
    for seed in (1, 2):  # the second run goes on where the first ended; it sees 30 votes again, one post and one id that are null
        new = some(seed, 150) + rows[:30] + ([] if seed == 1 else [(None, "n1", "NTA", 5), ("hot", None, "YTA", 99)])
        rows += new
        spark.createDataFrame(new, VOTES).repartition(3).write.mode("append").parquet(source)
        stream = spark.readStream.schema(VOTES).option("maxFilesPerTrigger", 2).parquet(source)
        follow_top_votes(stream, best, cp, k=4, salts=3).awaitTermination()
    votes = spark.createDataFrame(sorted({r for r in rows if r[1]}, key=str), VOTES)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(current_top_votes(spark, best, votes.schema, 4).select(*votes.columns), top_votes(votes, 4))
    assert same(followed_verdicts(spark, best, votes.schema, 4), vote_consensus(votes, 4))
    held = spark.read.parquet(best)
    assert held.groupBy("post_id", "salt", "batch").count().agg(F.max("count")).first()[0] == 4  # no state is larger
    assert held.agg(F.countDistinct("batch")).first()[0] >= 3


def test_empty_stream(spark, tmp_path):
    source, best, cp = (str(tmp_path / n) for n in ("votes", "best", "cp"))
    empty = spark.createDataFrame([], VOTES)
    empty.write.parquet(source)
    follow_top_votes(spark.readStream.schema(VOTES).parquet(source), best, cp).awaitTermination()
    assert followed_verdicts(spark, best, empty.schema).count() == 0


def test_few_and_light_states(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(votes_module, "CUT_ROWS", 50)  # tasks cut their votes several times
    rows = some(3, 400) + [("big", f"b{i}", "NTA", s) for i, s in enumerate([None, 7, 2**31 - 1])]
    source, best, cp = (str(tmp_path / n) for n in ("votes", "best", "cp"))
    df = spark.createDataFrame(rows + rows[:50], VOTES)
    df.repartition(4).write.parquet(source)
    follow_top_votes(spark.readStream.schema(VOTES).option("maxFilesPerTrigger", 2).parquet(source), best, cp, k=3).awaitTermination()
    held = spark.read.parquet(best)
    assert held.groupBy("post_id", "batch").count().agg(F.max("count")).first()[0] == 3  # before: 3 in each of 16 states
    expected = top_votes(spark.createDataFrame(rows, VOTES), 3)
    got = current_top_votes(spark, best, df.schema, 3).select(*df.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))
