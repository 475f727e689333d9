import pytest

AWKWARD = ["__id", "__th", "stats", "id", "text_a", "n", "h", "label", "keys", "word"]


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a documents table with extra columns whose names operators use themselves."""

    def make(rows, extra=True):
        df = spark.createDataFrame([(i, t, s) for i, t, s in rows], "doc_id bigint, text string, source string")
        if extra:
            from pyspark.sql import functions as F

            df = df.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(AWKWARD)])
        return df

    return make
