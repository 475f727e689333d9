"""Near-duplicate documents by MinHash bands and odd sketches.

One pass turns each text into the digest of its shingle set, banded MinHash keys and an odd
sketch: a bitmap in which every MinHash sample flips one bit, so that the population count
of the XOR of two sketches estimates how many samples differ. Texts with equal sets collapse
to one. Candidates that share a band are compared in two rounds, so that no band ever emits
all its pairs: first each with the least of its band, which settles large groups in linear
work; then, after components are formed, only members of different components, in tiles of
bounded size. What a sketch lets through is confirmed on the full shingle sets of the texts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clearfold.llm.common import attach, bounded_broadcast, row_key, small_batches
from clearfold.llm.graph import components
from clearfold.session import cut

SHINGLE = 5
MOST_ROWS = 5
MISS = 1e-6  # chance that a pair at the threshold shares no band, at most
SAMPLES = 512  # MinHash samples folded into the sketch; the bands use the first of them
SKETCH_BITS = 2048
TILE = 1024  # members of a band that one tile holds on either side
MEMO = 200_000  # words whose hash a worker remembers
_U = np.uint64
_FOLD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], _U)
_MULTIPLIERS = np.random.default_rng(20240229).integers(0, 2**32, SAMPLES, dtype=np.uint32) | np.uint32(1)


def bands_for(percent: int) -> tuple[int, int]:
    """Bands and rows of a band by which a pair at ``percent`` shares no band with a probability of at most ``MISS``.

    That is (1 - s**rows)**bands: 24 bands of 5 at 85, 35 of 5 at 80. Lower thresholds take
    fewer rows as soon as the samples do not suffice.
    """
    s = percent / 100
    if not 0 < s <= 1:
        raise ValueError(f"percent must be from 3 to 100, not {percent}")
    for rows in range(MOST_ROWS, 0, -1):
        bands = 1 if s == 1 else math.ceil(math.log(MISS) / math.log1p(-(s**rows)))
        if bands * rows <= SAMPLES:
            return bands, rows
    raise ValueError(f"{SAMPLES} samples are too few to find pairs at {percent} percent")


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def shingle_set(text: str | None, memo: dict) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct 5-word shingles; fewer words make one shingle, none an empty set."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, _U)
    w = np.fromiter(map(memo.__getitem__, words), _U, n)
    if n < SHINGLE:
        return _mixed((w * _FOLD[:n]).sum(keepdims=True, dtype=_U) + _U(n))
    h = np.zeros(n - SHINGLE + 1, _U)
    for k in range(SHINGLE):
        h += w[k : n - SHINGLE + 1 + k] * _FOLD[k]
    return np.unique(_mixed(h))


def sketch(shingles: np.ndarray, buffer: np.ndarray, percent: int = 85) -> tuple[np.ndarray, np.ndarray]:
    """Band keys for pairs at ``percent`` and odd sketch (both as int64) of a set that is not empty."""
    bands, width = bands_for(percent)
    x = (shingles >> _U(32)).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(x), len(buffer)):
        part = x[start : start + len(buffer), None]
        np.minimum(least, np.multiply(part, _MULTIPLIERS, out=buffer[: len(part)]).min(axis=0), out=least)
    wide = least.astype(_U)
    rows = wide[: bands * width].reshape(bands, width)
    keys = _mixed((_mixed(rows + _FOLD[:width]) * _FOLD[:width]).sum(axis=1, dtype=_U) + np.arange(bands, dtype=_U) * _U(0x9FB21C651E98DF25))
    places = (_mixed(wide + np.arange(SAMPLES, dtype=_U) * _U(0x9FB21C651E98DF25)) >> _U(65 - SKETCH_BITS.bit_length())).astype(np.int64)
    odd = np.packbits((np.bincount(places, minlength=SKETCH_BITS) & 1).astype(np.uint8))
    return keys.view(np.int64), odd.view(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    memo, buffer = _WordHashes(), np.empty((512, SAMPLES), np.uint32)
    for batch in batches:
        if len(memo) > MEMO:
            memo.clear()
        sizes, digests, keys, odds = [], [], [], []
        for text in batch.column("__text"):
            s = shingle_set(text.as_py(), memo)
            sizes.append(len(s))
            digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            k, o = sketch(s, buffer, percent) if len(s) else (None, None)
            keys.append(k)
            odds.append(o)
        arrays = [batch.column("__id"), batch.column("__th"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary())]
        arrays += [pa.array(keys, pa.list_(pa.int64())), pa.array(odds, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["__id", "__th", "n_shingles", "digest", "keys", "odd"])


def most_different_bits(percent: int) -> int:
    """Population count of the XOR that pairs at the threshold exceed less than once in a million times.

    A binomial share of the samples differs, each differing one flips a bit in either sketch,
    and bits flipped twice vanish. Five standard deviations of both together are allowed.
    """
    miss, n = 1 - percent / 100, SKETCH_BITS
    flips, spread = 2 * SAMPLES * miss, 2 * math.sqrt(SAMPLES * miss * (1 - miss))
    left = (1 - 2 / n) ** flips
    return math.ceil(n / 2 * (1 - left) + 5 * math.hypot(left * spread, flips / math.sqrt(2 * n)))


def _different_bits(a: Column, b: Column) -> Column:
    out = F.lit(0)
    for i in range(SKETCH_BITS // 64):
        out = out + F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))))
    return out


def _plausible(percent: int, na: Column, nb: Column, oa: Column, ob: Column) -> Column:
    sized = F.least(na, nb) * 100 >= F.greatest(na, nb) * percent
    return sized & (_different_bits(oa, ob) <= most_different_bits(percent))


def _confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """The ``pairs`` (a, b), a written table, whose full shingle sets reach the threshold.

    Only texts that occur in a pair are shuffled. A leader of many pairs makes a skewed
    partition, which adaptive execution splits.
    """
    ids = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
    needed = cut(ids.join(reps.select("rep", "rep_th"), "rep"))
    wanted, own = bounded_broadcast(needed), docs.select(*row_key(id_col, text_col), F.col(text_col).alias("text"))
    here = (own["__id"] == wanted["rep"]) & (own["__th"] == wanted["rep_th"])
    texts = cut(own.join(wanted, here).select("rep", "text").dropDuplicates(["rep"]))
    text_of = lambda side: texts.select(F.col("rep").alias(side), F.col("text").alias(f"text_{side}"))
    both = pairs.join(text_of("a"), "a").join(text_of("b"), "b").select("a", "b", "text_a", "text_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, last, of_last = _WordHashes(), None, None
        for batch in batches:
            if len(memo) > MEMO:
                memo.clear()
            good = []
            for b, text_a, text_b in zip(batch.column("b"), batch.column("text_a"), batch.column("text_b")):
                if b != last:
                    last, of_last = b, shingle_set(text_b.as_py(), memo)
                own = shingle_set(text_a.as_py(), memo)
                common = len(np.intersect1d(own, of_last, assume_unique=True))
                good.append(bool(common) and 100 * common >= percent * (len(own) + len(of_last) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return cut(both.mapInArrow(check, pairs.select("a", "b").schema))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """One row per input row: ``__id``, ``__th``, ``n_shingles``, ``component``, ``kept``.

    Two documents are linked if 100 * |A and B| >= percent * |A or B| over their shingle sets,
    but for pairs that share no band or whose sketches look too far apart, about one in a
    million each at the threshold (``bands_for``, ``most_different_bits``);
    ``component`` is the least id reachable and ``kept`` marks the row that has it. Null and
    empty texts, and texts without words, have an empty set and no links. Rows that share an
    id count as one document. A null id cannot be a component: such rows are never linked and
    are kept. Extra columns are not read.
    """
    small_batches(docs.sparkSession)
    key = row_key(id_col, text_col)
    source = docs.select(*key, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    kinds = f"`__id` {dict(source.dtypes)['__id']}, `__th` bigint, n_shingles bigint, digest binary, `keys` array<bigint>, odd array<bigint>"
    sketched = cut(source.mapInArrow(lambda batches: _sketches(batches, percent), kinds))
    usable = sketched.where(F.col("digest").isNotNull() & F.col("__id").isNotNull())
    sets = cut(usable.groupBy("digest").agg(F.min("__id").alias("rep")))
    reps = cut(
        usable.join(sets.select(F.col("rep").alias("__id"), "digest"), ["__id", "digest"])
        .select(F.col("__id").alias("rep"), F.col("__th").alias("rep_th"), "n_shingles", "keys", "odd").dropDuplicates(["rep"])
    )
    # one document may hold several sets only where rows share an id; its sets are then one node
    entries = cut(reps.select("rep", F.explode("keys").alias("key")).distinct())
    bands = cut(entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("leader")).where(F.col("n") > 1).drop("n"))
    members = cut(attach(entries, bands, ["key"]).select("key", "rep", "leader"))
    traits = reps.select("rep", "n_shingles", "odd", "keys")

    starred = cut(members.where(F.col("rep") != F.col("leader")).select(F.col("rep").alias("a"), F.col("leader").alias("b")).distinct())
    leaders = cut(starred.select("b").distinct().join(traits.select(F.col("rep").alias("b"), F.col("n_shingles").alias("nb"), F.col("odd").alias("ob")), "b"))
    compared = attach(starred, leaders, ["b"]).join(traits.select(F.col("rep").alias("a"), F.col("n_shingles").alias("na"), F.col("odd").alias("oa")), "a")
    near = cut(compared.where(_plausible(percent, F.col("na"), F.col("nb"), F.col("oa"), F.col("ob"))).select("a", "b"))
    links = _confirmed(near, reps, docs, id_col, text_col, percent)
    grouped = cut(components(links))

    crossing = cut(_crossing(members, grouped, traits, percent))
    if crossing.limit(1).count():
        more = _confirmed(crossing, reps, docs, id_col, text_col, percent)
        if more.limit(1).count():
            grouped = cut(components(links.unionByName(more)))

    named = sets.join(grouped.withColumnRenamed("node", "rep"), "rep", "left")
    of_set = cut(named.select("digest", F.coalesce("component", "rep").alias("component")))
    linked = attach(sketched.where(F.col("__id").isNotNull()), of_set, ["digest"])
    alone = sketched.where(F.col("digest").isNull() | F.col("__id").isNull()).withColumn("component", F.col("__id"))
    columns = ["__id", "__th", "n_shingles", "component", F.coalesce(F.col("__id") == F.col("component"), F.lit(True)).alias("kept")]
    return linked.select(*columns).unionByName(alone.select(*columns))


def _crossing(members: DataFrame, grouped: DataFrame, traits: DataFrame, percent: int) -> DataFrame:
    """Plausible pairs of members of a band that are still in different components.

    Of a band with n members, s of them outside its largest component, every member meets
    only those s. Both sides are dealt into tiles of about ``TILE`` by ``TILE`` members, so
    no task holds a band; pairs are compared inside the join and only plausible ones leave it,
    each in the first of the bands that it shares.
    """
    own = members.join(grouped.withColumnRenamed("node", "rep"), "rep", "left")
    labelled = cut(own.select("key", "rep", F.coalesce("component", "rep").alias("label")))
    per_label = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    mixed = cut(
        per_label.groupBy("key").agg(F.sum("c").alias("n"), F.max("c").alias("most"), F.count(F.lit(1)).alias("labels"), F.max_by("label", F.struct("c", "label")).alias("main"))
        .where(F.col("labels") > 1)
        .select("key", "n", "main", F.ceil(F.col("n") / TILE).cast("int").alias("across"), F.ceil((F.col("n") - F.col("most")) / TILE).cast("int").alias("down"))
    )
    rows = attach(labelled, mixed, ["key"]).join(traits, "rep")
    left = rows.select(
        "key", F.col("rep").alias("a"), F.col("label").alias("la"), "main", F.col("n_shingles").alias("na"), F.col("odd").alias("oa"), F.col("keys").alias("ka"),
        F.pmod(F.xxhash64("rep"), F.col("across")).cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("y"),
    )
    right = rows.where(F.col("label") != F.col("main")).select(
        "key", F.col("rep").alias("b"), F.col("label").alias("lb"), F.col("n_shingles").alias("nb"), F.col("odd").alias("ob"), F.col("keys").alias("kb"),
        F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("x"), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("down")).cast("int").alias("y"),
    )
    tile = (left["key"] == right["key"]) & (left["x"] == right["x"]) & (left["y"] == right["y"])
    apart = (F.col("la") != F.col("lb")) & ((F.col("la") == F.col("main")) | (F.col("a") < F.col("b")))
    close = _plausible(percent, F.col("na"), F.col("nb"), F.col("oa"), F.col("ob"))
    shared = F.filter(F.zip_with("ka", "kb", lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull())
    once = F.get(shared, F.lit(0)) == left["key"]
    return left.join(right, tile & apart & close & once).select("a", "b").distinct()


def report(docs: DataFrame) -> DataFrame:
    """``near_duplicates`` of ``documents`` at 0.85, under the names of that table."""
    return near_duplicates(docs, percent=85).select(F.col("__id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates; repeated rows of an id are dropped too.

    Which of several rows of one id stays is the one with the least text hash. Rows without
    an id stay. The ids to drop are written first and broadcast if they are few, so that the
    texts that stay are not shuffled.
    """
    found = cut(near_duplicates(docs, id_col, text_col, percent))
    dropped = cut(found.where(~F.col("kept")).select("__id").distinct())
    repeated = cut(found.where(F.col("kept") & F.col("__id").isNotNull()).groupBy("__id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))
    gone = bounded_broadcast(dropped)
    out = docs.join(gone, docs[id_col] == gone["__id"], "left_anti")
    if repeated.limit(1).count():
        twice = bounded_broadcast(repeated.select("__id"))
        again = out.join(twice, out[id_col] == twice["__id"], "left_semi")
        rest = out.join(twice, out[id_col] == twice["__id"], "left_anti")
        order = Window.partitionBy(id_col).orderBy(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
        marked = again.withColumn("__first of its id", F.row_number().over(order))
        out = rest.unionByName(marked.where(F.col("__first of its id") == 1).drop("__first of its id"))
    return out
