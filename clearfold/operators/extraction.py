"""Feature extraction: the pluggable extractor job, its cache, and rule-based signals."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clearfold.functions.hashing import cache_key
from clearfold.session import cut, shared_dir

# Defaults of the extraction job.
MAX_RETRIES = 2
MAX_CONCURRENT = 30
REQUESTS_PER_MINUTE = 1200.0


class Refused(Exception):
    """Raised by an extractor that declines a text; retried at once."""


@dataclass
class Extraction:
    """What an extractor returns for one text."""

    record: dict
    input_tokens: int = 0
    output_tokens: int = 0


Extractor = Callable[[str, str], Extraction]


def output_schema(record: T.StructType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("id", T.StringType()),
            T.StructField("status", T.StringType()),
            T.StructField("attempt", T.IntegerType()),
            T.StructField("error", T.StringType()),
            T.StructField("elapsed_s", T.DoubleType()),
            T.StructField("input_tokens", T.LongType()),
            T.StructField("output_tokens", T.LongType()),
            T.StructField("record", record),
        ]
    )


class Pace:
    """Slots of a fixed length, one call each; time that a call takes counts towards its slot."""

    def __init__(self, slot_s: float):
        self.slot_s, self.next = slot_s, 0.0

    def wait(self) -> None:
        now = time.monotonic()
        if self.next > now:
            time.sleep(self.next - now)
        self.next = max(self.next, now) + self.slot_s


def _attempts(extract: Extractor, text: str, ident: str, max_retries: int, pace: Pace, backoff: Callable[[int], float]):
    error = None
    for attempt in range(max_retries + 1):
        pace.wait()
        started = time.monotonic()
        try:
            got = extract(text, ident)
            return ("ok", attempt + 1, None, round(time.monotonic() - started, 2), got)
        except Refused as exc:
            error = ("refused", str(exc))
        except Exception as exc:
            error = ("failed", str(exc))
            if attempt < max_retries:
                time.sleep(backoff(attempt))
    return (error[0], max_retries + 1, error[1], None, None)


def run_extractor(
    df: DataFrame,
    factory: Callable[[], Extractor],
    record: T.StructType,
    id_col: str = "id",
    text_col: str = "body",
    max_retries: int = MAX_RETRIES,
    max_concurrent: int = MAX_CONCURRENT,
    requests_per_minute: float | None = REQUESTS_PER_MINUTE,
    backoff: Callable[[int], float] = lambda attempt: 2.0**attempt,
    by_prefix: bool = False,
) -> DataFrame:
    """One row per input with ``status``, ``attempt``, ``error``, token counts and ``record``.

    ``factory`` builds one client per task. At most ``max_concurrent`` tasks run, each
    paced at its share of the rate cap, so the caps hold across the cluster without any
    coordination. Without a rate cap (None) the partitions stay as they are, unless ``by_prefix``
    deals ids that are md5 digests to tasks by their leading digits, which is even and keeps
    neighbouring ids together. Write the result before using it twice: every evaluation calls the
    service again. For a paid service leave ``spark.speculation`` off, since a speculative
    copy of a task calls it again too.
    """
    pace_s = 60.0 * max_concurrent / requests_per_minute if requests_per_minute else 0.0
    names = record.fieldNames()
    columns = output_schema(record).fieldNames()

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extract, pace = factory(), Pace(pace_s)
        for pdf in batches:
            rows = []
            for ident, text in zip(pdf["id"], pdf["text"]):
                status, attempt, error, elapsed, got = _attempts(extract, text, ident, max_retries, pace, backoff)
                rec = {n: got.record.get(n) for n in names} if got else None
                tokens = (got.input_tokens, got.output_tokens) if got else (None, None)
                rows.append((ident, status, attempt, error, elapsed, *tokens, rec))
            out = pd.DataFrame(rows, columns=columns, dtype=object)
            yield out

    tasks = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    dealt = tasks.repartition(max_concurrent) if requests_per_minute else tasks
    if by_prefix:
        n = max_concurrent if requests_per_minute else min(CACHE_BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        dealt = tasks.repartitionById(n, _place(F.col("id"), n))
    return dealt.mapInPandas(task, output_schema(record))


def split_status(extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records as columns, failed ids) of a written extraction result."""
    ok = extracted.where(F.col("status") == "ok").select("id", "record.*")
    failed = extracted.where(F.col("status") != "ok").select("id", "status", "attempt", "error")
    return ok, failed


def extraction_log(extracted: DataFrame, model: str) -> DataFrame:
    return extracted.where(F.col("status") == "ok").select(
        F.col("id").alias("post_id"),
        F.lit(model).alias("model"),
        "elapsed_s",
        "attempt",
        F.struct("input_tokens", "output_tokens").alias("usage"),
    )


# -- cache -----------------------------------------------------------------------------


CACHE_BUCKETS = 256  # folders of a cache table, by the first two digits of the key


def _place(key: Column, n: int) -> Column:
    """Which of ``n`` equal ranges of digests a key is in; 0 for a missing one."""
    digits = F.conv(F.substring(key, 1, 4), 16, 10).cast("bigint")
    return F.coalesce(F.floor(digits * n / 65536), F.lit(0)).cast("int")


def _bucket(key: Column) -> Column:
    return F.concat(F.lit("k"), F.coalesce(F.substring(key, 1, 2), F.lit("")))


def append_cache(rows: DataFrame, path: str) -> None:
    """Add rows to the cache table at ``path``, a folder per key prefix."""
    rows.withColumn("bucket", _bucket(F.col("cache_key"))).write.mode("append").partitionBy("bucket").parquet(path)


def with_cache_key(df: DataFrame, config_hash: str | Column, text_col: str = "body") -> DataFrame:
    return df.withColumn("cache_key", cache_key(config_hash, F.col(text_col)))


def cache_hits(keyed: DataFrame, cache: DataFrame) -> DataFrame:
    return keyed.join(cache, "cache_key")


def cache_misses(keyed: DataFrame, cache: DataFrame, text_col: str = "body") -> DataFrame:
    """Texts to extract, each once: duplicates collapse on the map side before the shuffle."""
    return (
        keyed.join(cache.select("cache_key"), "cache_key", "left_anti")
        .select("cache_key", text_col)
        .dropDuplicates(["cache_key"])
    )


def extract_into_cache(
    keyed: DataFrame,
    path: str,
    factory: Callable[[], Extractor],
    record: T.StructType,
    text_col: str = "body",
    batches: int = 1,
    call_id: str = "",
    **options,
) -> DataFrame:
    """Extract what the cache table at ``path`` lacks and return the table's rows of the wanted keys.

    With several ``batches`` the distinct misses are written once, cut by key, and worked
    off slice by slice; each slice's results are written when done, so a lost executor or
    job repeats one slice at most. Failed rows are written too, under their status, and are
    tried again by the next call. ``call_id`` marks the rows of this call, which are the
    ones it paid for.
    """
    spark = keyed.sparkSession
    key, call = T.StructField("cache_key", T.StringType()), T.StructField("call_id", T.StringType())
    schema = T.StructType([key, *output_schema(record).fields[1:], call])
    append_cache(spark.createDataFrame([], schema), path)  # so that there is a table to read
    keys = cut(keyed.select("cache_key").distinct())
    done = read_cache(spark, path, schema, keys).where(F.col("status") == "ok")
    todo = cache_misses(keyed, done, text_col)
    slices = [todo]
    if batches > 1:
        folder = f"{shared_dir(spark)}/todo-{uuid.uuid4().hex}"
        sliced = todo.withColumn("slice", F.pmod(F.xxhash64("cache_key"), F.lit(batches)).cast("int"))
        sliced.write.partitionBy("slice").parquet(folder)
        waiting = spark.read.schema(f"cache_key string, {text_col} string, slice int").parquet(folder)
        slices = [waiting.where(F.col("slice") == b) for b in range(batches)]
    for part in slices:
        out = run_extractor(part, factory, record, "cache_key", text_col, by_prefix=True, **options)
        append_cache(out.withColumnRenamed("id", "cache_key").withColumn("call_id", F.lit(call_id)), path)
    return read_cache(spark, path, schema, keys)


def read_cache(spark: SparkSession, path: str, schema: T.StructType, wanted: DataFrame | None = None) -> DataFrame:
    """The cache table with one ``ok`` row per key at most, whatever calls overlapped; failed rows stay.

    Of several successes the one with the least call and attempt counts. Kept rows are found
    by key, so the shuffle carries a key and two small values beside the record. With ``wanted``,
    best a written table of keys, only the folders of its key prefixes are read, and records of
    other keys are not shuffled.
    """
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.StringType())])).parquet(path)
    if wanted is not None:
        prefixes = sorted(r[0] for r in wanted.select(_bucket(F.col("cache_key"))).distinct().collect())  # CACHE_BUCKETS and one at most
        if len(prefixes) < CACHE_BUCKETS:
            rows = rows.where(F.col("bucket").isin(prefixes))
        rows = rows.join(wanted.select("cache_key").distinct(), "cache_key", "left_semi")
    rows = rows.select(*schema.fieldNames())
    ok = F.col("status") == "ok"
    first = Window.partitionBy("cache_key").orderBy("call_id", "attempt", "elapsed_s")
    good = rows.where(ok).withColumn("__rn", F.row_number().over(first)).where(F.col("__rn") == 1).drop("__rn")
    return good.unionByName(rows.where(~ok))


def compact_cache(spark: SparkSession, path: str, schema: T.StructType, out: str) -> None:
    """Write the cache table anew under ``out``, a file per key prefix: one row per key, a success where there is one.

    The old table stays as it is, for calls that still read it.
    """
    ok_first = Window.partitionBy("cache_key").orderBy((F.col("status") != "ok").cast("int"), "call_id", "attempt", "elapsed_s")
    rows = spark.read.schema(schema).parquet(path).withColumn("__rn", F.row_number().over(ok_first)).where(F.col("__rn") == 1).drop("__rn")
    append_cache(rows.repartitionById(CACHE_BUCKETS, _place(F.col("cache_key"), CACHE_BUCKETS)), out)


# -- record checks ---------------------------------------------------------------------


def record_errors(defs: Iterable) -> Column:
    """``errors array<string>`` of a record: missing fields and scales out of bounds.

    Category values are reported by the extractor but not held to the declared domain.
    """
    rules = []
    for d in defs:
        c = F.col(d["name"])
        rules.append(F.when(c.isNull(), F.lit(f"{d['name']}: missing")))
        if d["type"] == "scale":
            low, high = d["min"], d["max"]
            if low is not None:
                rules.append(F.when(c < low, F.lit(f"{d['name']}: below {low}")))
            if high is not None:
                rules.append(F.when(c > high, F.lit(f"{d['name']}: above {high}")))
    return F.array_compact(F.array(*rules))


def check_records(df: DataFrame, defs: Iterable) -> DataFrame:
    return df.withColumn("errors", record_errors(defs)).withColumn("valid", F.size("errors") == 0)


# -- rule-based signals ----------------------------------------------------------------


@dataclass(frozen=True)
class Signal:
    """A feature read off the text by counting: a stand-in extractor that needs no service.

    scale: 1 + occurrences of ``pattern`` per ``every``, at most ``max``; with no pattern
    the text length counts. bool: ``pattern`` occurs. categorical: the first entry of
    ``choices`` (value, pattern) that occurs, else ``other``.
    """

    name: str
    type: str
    pattern: str | None = None
    every: int = 1
    max: int = 5
    choices: Sequence[tuple[str, str]] = field(default_factory=tuple)

    def column(self, text: Column) -> Column:
        if self.type == "bool":
            return text.rlike(self.pattern)
        if self.type == "categorical":
            out = F.lit("other")
            for value, pattern in reversed(list(self.choices)):
                out = F.when(text.rlike(pattern), F.lit(value)).otherwise(out)
            return out
        if self.pattern is None:
            count = F.length(text)
        elif len(self.pattern) == 1 and self.pattern not in r".^$*+?{}[]\|()":
            count = F.length(text) - F.length(F.replace(text, F.lit(self.pattern), F.lit("")))
        else:
            count = F.regexp_count(text, F.lit(self.pattern))
        level = F.least(F.lit(self.max - 1), F.floor(count / F.lit(self.every))) + 1
        return level.cast("int")

    def definition(self) -> dict:
        if self.type == "scale":
            return {"name": self.name, "type": "scale", "min": 1, "max": self.max, "description": self.name}
        if self.type == "bool":
            return {"name": self.name, "type": "bool", "description": self.name}
        values = [v for v, _ in self.choices] + ["other"]
        return {"name": self.name, "type": "categorical", "values": values, "description": self.name}


def extract_signals(df: DataFrame, signals: Sequence[Signal], text_col: str = "body") -> DataFrame:
    """Signals as columns next to the others, computed in the scan stage without a shuffle."""
    text = F.col(text_col)
    return df.select("*", *[s.column(text).alias(s.name) for s in signals])
