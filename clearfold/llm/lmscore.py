"""Scoring documents with a recurrent language model that is trained on the corpus itself.

Words of all training documents are counted by Spark. The most frequent ones go to the workers:
the named words of the model, as many as cover half of the tokens, and a dictionary of counts up
to a fixed number; rarer words are looked up by a join. Documents become codes once; the model is trained in rounds,
in each of which every partition trains a replica from the common weights and the replicas
are averaged in a tree; then every document is scored whole.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearfold.llm import gru
from clearfold.llm.common import one_blas_thread, row_key, small_batches
from clearfold.session import cut

NAMED = 2048  # words with a code of their own, at least
MASS = 0.5  # share of the training tokens that named words cover at least
DICTIONARY = 300_000  # words whose counts the workers hold
ENDINGS = 1024  # codes of all other words, by their last two bytes
ENDING_CLASSES = 64
ROUNDS = 3
RATE = 0.01
BUFFER = 3_000_000  # codes that a task holds at once
PORTION = 16_000_000  # bytes of texts that a task splits into words at once
FAN_IN = 32  # replicas that one step of the tree averages
END = "\n"  # stands for the end of a document; no word contains it
SMOOTH = 0.1


def _training(id_col: str):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 10 != 0


def word_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``word``, ``c`` over the training documents, a written table; every document ends with ``END``.

    Tasks count the words of a portion of texts in Arrow; the counts of the portions meet by word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for portion in _portions(batches):
            yield _counted(portion.column(0))

    texts = docs.where(_training(id_col)).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return cut(texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("c")))


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, put together to portions of about ``PORTION`` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= PORTION:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _counted(texts: pa.Array) -> pa.RecordBatch:
    """Words with their counts; ``END`` once per text."""
    found = pc.value_counts(_split(texts).flatten())
    values, counts = found.field("values"), found.field("counts")
    real = pc.not_equal(values, "")
    values = pa.concat_arrays([values.filter(real), pa.array([END])])
    counts = pa.concat_arrays([counts.filter(real), pa.array([len(texts)], pa.int64())])
    return pa.RecordBatch.from_arrays([values, counts], names=["word", "n"])


def _split(texts: pa.Array) -> pa.Array:
    """Words of each text between white space, with A-Z as a-z, and an empty one where a text begins or ends with white space."""
    return pc.ascii_split_whitespace(pc.ascii_lower(texts))


def _most_frequent(counts: DataFrame, most: int) -> list[tuple[str, int]]:
    """Words in descending order of count, as many whole levels of count as ``most`` rows hold; ``END`` is first.

    The level is read off a histogram of counts, which has at most the square root of twice
    the number of tokens rows.
    """
    levels = counts.where(F.col("word") != END).groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c")).collect()
    held, least = 0, None
    for c, n in levels:
        if held + n > most:
            break
        held, least = held + n, c
    rows = [] if least is None else counts.where((F.col("c") >= least) & (F.col("word") != END)).collect()
    end = counts.where(F.col("word") == END).collect()
    return [(END, end[0][1] if end else 0)] + sorted(((r[0], r[1]) for r in rows), key=lambda x: (-x[1], x[0]))


def _ending(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % ENDINGS


class Vocabulary:
    """Bounded tables of the model: codes, classes and counts. Words outside are known by their ending."""

    def __init__(self, counts: DataFrame):
        self.tokens, self.types = (int(x or 0) for x in counts.agg(F.sum("c"), F.count(F.lit(1))).first())
        top = _most_frequent(counts, DICTIONARY)
        self.words = [w.encode() for w, _ in top]
        self.counts = np.array([c for _, c in top], float)
        covering = int(np.searchsorted(np.cumsum(self.counts), MASS * self.tokens)) + 1
        self.n_named = min(max(NAMED, covering), len(top), 2**16 - ENDINGS)  # codes have 16 bits
        classes = -(-self.n_named // gru.PER_CLASS)
        ending = F.crc32(F.substring(F.encode("word", "utf-8"), -2, 2)) % ENDINGS % ENDING_CLASSES
        mass, types = np.zeros(ENDING_CLASSES), np.zeros(ENDING_CLASSES)
        for e, c, n in counts.groupBy(ending.alias("e")).agg(F.sum("c"), F.count(F.lit(1))).collect():
            mass[e], types[e] = c, n
        for w, c in zip(self.words[: self.n_named], self.counts):
            if c:
                mass[_ending(w) % ENDING_CLASSES] -= c
                types[_ending(w) % ENDING_CLASSES] -= 1
        self.ending_total = mass + SMOOTH * (types + 1)
        named = np.full((classes, gru.PER_CLASS), 0.0)
        named.ravel()[: self.n_named] = self.counts[: self.n_named] + SMOOTH
        share = np.concatenate([named.sum(axis=1), self.ending_total])
        self.class_share = share / share.sum()
        with np.errstate(divide="ignore"):
            self.within = np.maximum(np.log(named / named.sum(axis=1, keepdims=True)), -30.0)
        place = np.arange(self.n_named)
        self.codes = gru.Codes(
            np.concatenate([place // gru.PER_CLASS, classes + np.arange(ENDINGS) % ENDING_CLASSES]).astype(np.int64),
            np.concatenate([place % gru.PER_CLASS, np.full(ENDINGS, -1)]).astype(np.int64), classes,
        )


def _endings(words: pa.Array) -> np.ndarray:
    """``_ending`` of each word, computed once for equal ends."""
    last = pc.binary_slice(words.cast(pa.binary()), -2).dictionary_encode()
    return np.array([_ending(x) for x in last.dictionary.to_pylist()], np.int64)[last.indices.to_numpy(zero_copy_only=False)]


ENCODED = "n_tokens bigint, known bigint, log_all double, log_rest double, codes binary, words array<string>, times array<int>"


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str, text_col: str) -> DataFrame:
    """Documents as codes, a written table, with sums of log10(c + 0.1) over the words the dictionary holds and the words it does not."""
    spark = docs.sparkSession
    n_named, logs = vocabulary.n_named, np.log10(vocabulary.counts + SMOOTH)
    own = np.array([i if i < n_named else n_named + _ending(w) for i, w in enumerate(vocabulary.words)], "<u2")
    end_known = int(vocabulary.counts[0] > 0)  # END is the first word
    shared = spark.sparkContext.broadcast((pa.array(vocabulary.words, pa.binary()).cast(pa.string()), logs, own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary, logs, own = shared.value
        names = ["__id", "__th", "train", *(c.split()[0] for c in ENCODED.split(", "))]
        for batch in _portions(batches):
            lists = _split(batch.column("__text"))
            n, words = len(lists), lists.flatten()
            doc = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            real = pc.not_equal(words, "")
            if not pc.all(real).as_py():
                words, doc = words.filter(real), doc[real.to_numpy(zero_copy_only=False)]
            at = pc.fill_null(pc.index_in(words, value_set=dictionary), -1).to_numpy(zero_copy_only=False)
            missing = np.flatnonzero(at < 0)
            others = words.take(pa.array(missing)).dictionary_encode()
            which = others.indices.to_numpy(zero_copy_only=False)
            coded, log = own[at], logs[at]
            coded[missing], log[missing] = n_named + _endings(others.dictionary)[which], 0.0
            lengths = np.bincount(doc, minlength=n) + 1
            ends = np.cumsum(lengths)
            codes = np.full(len(at) + n, own[0], "<u2")
            inside = np.ones(len(codes), bool)
            inside[ends - 1] = False
            codes[inside] = coded
            types = max(1, len(others.dictionary))
            pairs, times = np.unique(doc[missing] * types + which, return_counts=True)
            bounds = pa.array(np.searchsorted(pairs, np.arange(n + 1) * types), pa.int32())
            out = [
                pa.array(lengths, pa.int64()),
                pa.array(lengths - 1 - np.bincount(doc[missing], minlength=n) + end_known, pa.int64()),
                pa.array(np.bincount(doc, log, n) + logs[0]),
                pa.array(np.bincount(doc, np.where(at >= n_named, log, 0.0), n)),
                pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.append(0, 2 * ends).astype(np.int32)), pa.py_buffer(codes)]),
                pa.ListArray.from_arrays(bounds, others.dictionary.take(pa.array(pairs % types))),
                pa.ListArray.from_arrays(bounds, pa.array(times, pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:3]), *out], names=names)

    source = docs.select(*row_key(id_col, text_col), _training(id_col).alias("train"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in source.drop("__text").dtypes)
    return cut(source.mapInArrow(run, f"{kinds}, {ENCODED}"))


def _buffered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], list[pa.RecordBatch]]]:
    """Documents in portions of about ``BUFFER`` codes, with the batches they came in."""
    docs, held, size = [], [], 0
    for batch in batches:
        held.append(batch)
        for x in batch.column("codes"):
            docs.append(np.frombuffer(x.as_buffer(), "<u2"))
            size += len(docs[-1])
        if size >= BUFFER:
            yield docs, held
            docs, held, size = [], [], 0
    if held:
        yield docs, held


def fit(encoded: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> gru.Weights:
    """Train on every training document once, a third of them (by hash) in each round.

    A round gives one replica per partition; replicas are averaged by tokens, about ``FAN_IN`` at
    a time, until one is left for the driver. Weights travel as a broadcast, whose size is that of
    the bounded vocabulary. The partitions are those of the encoded table, so another layout of
    it gives slightly other weights; a repeated task gives the same.
    """
    codes, first = vocabulary.codes, gru.initial(vocabulary.codes, vocabulary.class_share, vocabulary.within)
    weights = first
    for r in range(rounds):
        data, rate = encoded.sparkSession.sparkContext.broadcast(weights.flat()), RATE / (1 + r)

        def run(batches: Iterator[pa.RecordBatch], data=data, rate=rate) -> Iterator[pa.RecordBatch]:
            one_blas_thread()
            own, seen = first.like(data.value), 0
            for docs, _ in _buffered(batches):
                seen += gru.train(own, codes, docs, rate)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([float(seen)]), pa.array([own.flat()], pa.binary())], names=["tokens", "weights"])

        part = encoded.where(F.col("train") & (F.pmod(F.xxhash64("__id", "__th"), F.lit(rounds)) == r)).select("codes")
        replicas = cut(part.mapInArrow(run, "tokens double, weights binary"))
        while (n := replicas.count()) > 1:
            grouped = replicas.withColumn("g", F.pmod(F.xxhash64("weights"), F.lit(math.ceil(n / FAN_IN))))
            replicas = cut(grouped.groupBy("g").applyInPandas(_averaged_group, "tokens double, weights binary"))
        rows = sorted((x["tokens"], bytes(x["weights"])) for x in replicas.collect())
        if rows:
            weights = first.like(_averaged(rows))
    return weights


def _averaged(rows: list[tuple[float, bytes]]) -> bytes:
    total = sum(t for t, _ in rows)
    return sum(np.frombuffer(w, "<f4").astype(float) * (t / total) for t, w in rows).astype("<f4").tobytes()


def _averaged_group(rows: pd.DataFrame) -> pd.DataFrame:
    pairs = sorted(zip(rows["tokens"], map(bytes, rows["weights"])))
    return pd.DataFrame({"tokens": [sum(t for t, _ in pairs)], "weights": [_averaged(pairs)]})


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: ``__id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    A document trains unless the crc32 of its id is divisible by 10. Null and empty texts are
    a single end token; a null id counts as the empty string and trains. Repeated rows train
    as often as they occur and get equal scores. Without training documents every token is
    unknown. Extra columns are not read.
    """
    small_batches(docs.sparkSession)
    counts = word_counts(docs, id_col, text_col)
    vocabulary = Vocabulary(counts)
    encoded = encode(docs, vocabulary, id_col, text_col)
    weights = fit(encoded, vocabulary, rounds)
    codes, totals = vocabulary.codes, np.log10(vocabulary.ending_total)
    data = docs.sparkSession.sparkContext.broadcast(weights.flat())
    n_named = vocabulary.n_named

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_blas_thread()
        own = weights.like(data.value)
        for texts, held in _buffered(batches):
            log10p = gru.score(own, codes, texts)
            fixed = np.array([totals[(t[t >= n_named] - n_named) % ENDING_CLASSES].sum() for t in texts])
            at = 0
            for batch in held:
                value = pa.array((log10p - fixed)[at : at + batch.num_rows], pa.float64())
                at += batch.num_rows
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in OUT), value], names=[*OUT, "model"])

    scored = encoded.select(*OUT, "codes").mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in encoded.select(*OUT).dtypes) + ", model double")
    rare = (
        encoded.where(F.size("words") > 0).select("__id", "__th", F.explode(F.arrays_zip("words", "times")).alias("x"))
        .select("__id", "__th", F.col("x.words").alias("word"), F.col("x.times").alias("n")).distinct()
        .join(counts, "word", "left").groupBy("__id", "__th")
        .agg(
            F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(SMOOTH))).alias("log_rare"),
            F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("known_rare"),
        )
    )
    same = F.col("s.__id").eqNullSafe(F.col("r.__id")) & (F.col("s.__th") == F.col("r.__th"))
    both = cut(scored).alias("s").join(rare.alias("r"), same, "left")
    rest = F.coalesce("r.log_rare", F.lit(0.0))
    per_token = math.log10(vocabulary.tokens + SMOOTH * (vocabulary.types + 1))
    return both.select(
        "s.__id",
        (~F.col("s.train")).alias("held_out"),
        "s.n_tokens",
        (F.col("s.known") + F.coalesce("r.known_rare", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.tokens).cast("bigint").alias("train_tokens"),
        (F.col("s.log_all") + rest - F.col("s.n_tokens") * F.lit(per_token)).alias("base_score"),
        (F.col("s.model") + F.col("s.log_rest") + rest).alias("score"),
    )


OUT = ["__id", "__th", "train", "n_tokens", "known", "log_all", "log_rest"]


def report(docs: DataFrame) -> DataFrame:
    return score_documents(docs).withColumnRenamed("__id", "doc_id")
