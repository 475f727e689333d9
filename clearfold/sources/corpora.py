"""Posts, comments and labelled corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearfold.operators.corpus import BINARY_RECODE, recode_labels

POST_COLUMNS = ("id", "submission_id", "title", "selftext", "score")
COMMENT_COLUMNS = ("comment_id", "submission_id", "message", "score")
MINIMAL_COLUMNS = ("id", "body", "verdict")
CORPUS_DDL = "id string, body string, verdict string"


def read_posts(spark: SparkSession, source: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Post columns of a table; ``fmt="jdbc"`` reads them out of a database."""
    return spark.read.format(fmt).options(**options).load(source).select(*POST_COLUMNS)


def read_comments(spark: SparkSession, source: str, fmt: str = "parquet", **options: str) -> DataFrame:
    return spark.read.format(fmt).options(**options).load(source).select(*COMMENT_COLUMNS)


# Twelve short invented posts to try the package on, nine NTA and three YTA.
SAMPLE_POSTS = (
    ("NTA", "My flatmate borrowed my bike without asking and came back with a bent wheel. I asked for the repair money and now our friends call me stingy."),
    ("NTA", "I left a family dinner early because my uncle kept joking about my job. My aunt says I ruined the evening for everyone."),
    ("YTA", "I promised my cousin a ride to the airport, overslept, and told them a taxi would teach them to plan better. They missed the flight."),
    ("NTA", "My manager wanted me to cancel my leave two days before the trip. I said no, and the team had to cover for me."),
    ("NTA", "A neighbour parks across our driveway every weekend. After five polite notes I had the car towed."),
    ("YTA", "I read my partner's diary because I was curious, then argued about what it said. They have moved to the guest room."),
    ("NTA", "My brother asked me to lend him money for the third time this year without paying back the first two loans. I refused."),
    ("NTA", "I told a guest to leave my party after they insulted my sister. Half of the group went with them."),
    ("NTA", "My mother gave away my old guitar without a word to me. I said that I will not leave things at her house again."),
    ("YTA", "I laughed at a colleague's first presentation and called it honest feedback. They have not spoken to me since."),
    ("NTA", "I did not invite a friend to my wedding because they told everyone about my proposal before I had made it."),
    ("NTA", "My gym partner is always an hour late. I started without them last week and they said I had let them down."),
)


def sample_corpus(spark: SparkSession) -> DataFrame:
    rows = [(f"sample_{i:03d}", body, verdict) for i, (verdict, body) in enumerate(SAMPLE_POSTS, start=1)]
    return spark.createDataFrame(rows, CORPUS_DDL)


def read_corpus(
    spark: SparkSession,
    path: str | None = None,
    text_col: str = "body",
    label_col: str = "verdict",
    binary_labels: bool = True,
    schema: str | None = None,
) -> DataFrame:
    """A labelled CSV with quoted multi-line texts; missing columns are an error.

    Without a path, the sample posts as they are. Without ``schema`` every column is read
    as a string, which needs no extra pass over the data. A file with multi-line texts
    cannot be split, so keep large corpora in many files, or in parquet.
    """
    if path is None:
        return sample_corpus(spark)
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    df = (reader.schema(schema) if schema else reader).csv(path)
    for kind, name in (("text", text_col), ("label", label_col)):
        if name not in df.columns:
            raise ValueError(f"{kind} column '{name}' not found")
    if "id" in df.columns:
        df = df.withColumn("id", F.col("id").cast("string"))
    return recode_labels(df, label_col, BINARY_RECODE) if binary_labels else df


def with_row_ids(df: DataFrame) -> DataFrame:
    """Generated ids for a table without any, equal texts included.

    Call it right on the scan: there a row's file split and place in it are fixed, so a
    recomputed task gives the same ids.
    """
    if "id" in df.columns:
        return df
    return df.withColumn("id", F.concat(F.lit("row_"), F.monotonically_increasing_id().cast("string")))


def write_corpus(df: DataFrame, path: str, fmt: str = "parquet", full_suffix: str = "_full") -> tuple[str, str]:
    """The minimal corpus at ``path`` and the one with vote totals next to it."""
    def save(frame: DataFrame, where: str) -> None:
        writer = frame.write.mode("overwrite")
        if fmt == "csv":
            writer.option("header", True).option("quote", '"').option("escape", '"').csv(where)
        else:
            writer.format(fmt).save(where)

    save(df.select(*MINIMAL_COLUMNS), path)
    save(df, path + full_suffix)
    return path, path + full_suffix
