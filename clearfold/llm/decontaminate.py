"""Benchmark decontamination: benchmark n-grams looked up in training texts.

Every run of ``n`` words of a benchmark item is a window (an item of fewer words is one
window as a whole). A bitmap of the hashes of all windows' first words, of a size bounded by
a parameter, goes into the scan as a literal and drops the places that start no window; what
remains is joined with the windows by hash, and equal words are required. Only those few places leave the
scan, with their words, so the texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearfold.llm.common import LOWER, UPPER, bounded_broadcast, let, row_key
from clearfold.session import cut

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OTHER = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))  # ASCII outside words
PREFIX = 4  # words of a window that the bitmap knows
MAX_BITS = 22  # log2 of the largest bitmap: 2**22 bits are 65,536 longs


def _words(text: str | Column) -> Column:
    """Words of ``WORD`` after A-Z became a-z, by one translation and a split at single spaces."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    plain = F.translate(text, UPPER + OTHER, LOWER + " " * len(OTHER))
    return F.array_remove(F.split(plain, " ", -1), "")


def _prefix_hash(first: Column, hashes: Column, i: Column, n_words: int) -> Column:
    """Hash of the ``n_words`` words from place ``i`` on, given one hash per word; ``first`` is the word hash at ``i``."""
    return F.xxhash64(first, *[F.get(hashes, i + k) for k in range(1, n_words)])


def benchmark_windows(items: DataFrame, n: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Two tables: the distinct windows with the item classes they occur in, and the items of each class.

    Items with equal words form a class, so copies of an item cost one entry. Items without
    words are left out; null ids of items are kept as items without a name.
    """
    worded = items.select(F.col(id_col).cast("string").alias("item"), _words(text_col).alias("w")).where(F.size("w") > 0)
    classes = cut(worded.groupBy("w").agg(F.sort_array(F.collect_list("item")).alias("items")).select(F.xxhash64("w").alias("cls"), "w", "items"))
    length = F.least(F.lit(n), F.size("w"))
    spots = F.transform(F.sequence(F.lit(1), F.size("w") - length + 1), lambda i: F.slice("w", i, length))
    windows = cut(
        classes.select("cls", F.explode(spots).alias("words")).groupBy("words").agg(F.collect_set("cls").alias("classes"))
        .select("words", "classes", F.size("words").alias("len"), F.xxhash64("words").alias("h"))
    )
    return windows, classes.select("cls", "items")


def _bitmap(windows: DataFrame, lengths: list[int], bits: int) -> Column:
    """The hashes of the windows' first words as an array of longs, one bit a hash; its size depends on ``bits`` alone."""
    hashes = F.transform("words", lambda x: F.xxhash64(x))
    start = F.lit(None).cast("bigint")
    for n in sorted({min(PREFIX, x) for x in lengths}):
        own = _prefix_hash(F.get(hashes, F.lit(0)), hashes, F.lit(0), n)
        start = F.when(F.least(F.col("len"), F.lit(PREFIX)) == n, own).otherwise(start)
    slots = windows.select(start.alias("h")).groupBy(F.shiftrightunsigned("h", 70 - bits).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("b"))
    longs = [0] * (1 << (bits - 6))
    for i, b in slots.collect():
        longs[i] = b
    return F.split(F.lit(",".join(map(str, longs))), ",").cast("array<bigint>")


def _spots(words: Column, lengths: list[int], bitmap: Column, bits: int) -> Column:
    """Places (from 0) whose window starts like a benchmark window, with the window's hash and words."""

    def marked(h: Column) -> Column:
        return F.bit_get(F.get(bitmap, F.shiftrightunsigned(h, 70 - bits).cast("int")), h.bitwiseAND(63).cast("int")) == 1

    def starts(hashes: Column, n: int) -> Column:
        found = F.transform(hashes, lambda x, i: F.when(marked(_prefix_hash(x, hashes, i, n)), i))
        return F.filter(found, lambda i: i.isNotNull())

    def windows(w: Column, at: Column, length: int) -> Column:
        whole = F.filter(at, lambda i: i + length <= F.size(w))
        return F.transform(whole, lambda i: F.struct(i.alias("pos"), F.lit(length).alias("len"), F.slice(w, i + 1, length).alias("words")))

    def of(w: Column, hashes: Column, n: int) -> Column:
        return let(starts(hashes, n), lambda at: F.concat(*[windows(w, at, x) for x in lengths if min(PREFIX, x) == n]))

    kinds = sorted({min(PREFIX, x) for x in lengths})
    found = lambda w: let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.concat(*[of(w, h, n) for n in kinds]))
    return let(words, found)


def _united(spans: Column) -> Column:
    """Words inside any of the (pos, len) spans, which are sorted by place."""
    step = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(s["pos"] + s["len"] - F.greatest(a["end"], s["pos"]), F.lit(0))).alias("n"),
            F.greatest(a["end"], s["pos"] + s["len"]).alias("end"),
        ),
    )
    return step["n"]


def find_contamination(
    docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per document: ``__id``, ``__th`` (hash of the text), ``n_words``, ``spans``, ``item_ids``.

    ``spans`` are the verified windows as (pos, len) in words, sorted; ``item_ids`` the items
    they occur in, as sorted strings. A null or empty text has no words and no spans. Rows
    with the same id and text count as one in the join and each get the result. An empty
    benchmark finds nothing. Extra columns of either table are not read.
    """
    windows, classes = benchmark_windows(items, n, item_id, item_text)
    sized = windows.groupBy("len").count().collect()  # at most n rows
    n_windows = sum(r["count"] for r in sized)
    lengths = [r["len"] for r in sized]
    bits = min(MAX_BITS, max(12, (64 * n_windows).bit_length()))
    key = row_key(id_col, text_col)
    if not sized:
        none = F.array().cast("array<struct<pos:int,len:int>>")
        return docs.select(*key, F.size(_words(text_col)).cast("bigint").alias("n_words"), none.alias("spans"), F.array().cast("array<string>").alias("item_ids"))
    scanned = cut(
        docs.select(
            *key,
            let(
                _words(text_col),
                lambda w: F.struct(F.size(w).cast("bigint").alias("n"), _spots(w, lengths, _bitmap(windows, lengths, bits), bits).alias("at")),
            ).alias("s"),
        ).select("__id", "__th", F.col("s.n").alias("n_words"), F.col("s.at").alias("at"))
    )
    spots = (
        scanned.where(F.size("at") > 0).select("__id", "__th", F.explode("at").alias("x"))
        .select("__id", "__th", "x.*", F.xxhash64("x.words").alias("h"))
    )
    hits = spots.join(bounded_broadcast(windows), ["h", "len", "words"]).select("__id", "__th", "pos", "len", "classes")
    per_doc = hits.groupBy("__id", "__th").agg(
        F.sort_array(F.collect_set(F.struct("pos", "len"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("classes"))).alias("cls"),
    )
    found = cut(per_doc)
    named = (
        found.select("__id", "__th", F.explode("cls").alias("cls")).join(bounded_broadcast(classes), "cls")
        .groupBy("__id", "__th").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("item_ids"))
    )
    a, b, c = scanned.drop("at").alias("a"), found.drop("cls").alias("b"), named.alias("c")
    same = lambda x, y: F.col(f"{x}.__id").eqNullSafe(F.col(f"{y}.__id")) & (F.col(f"{x}.__th") == F.col(f"{y}.__th"))
    hit = b.join(c, same("b", "c"), "left").select("b.*", "c.item_ids").alias("d")
    return a.join(hit, same("a", "d"), "left").select(
        "a.*",
        F.coalesce("d.spans", F.array().cast("array<struct<pos:int,len:int>>")).alias("spans"),
        F.coalesce("d.item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def report(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """``find_contamination`` as counts and a digest per document of ``documents``."""
    found = find_contamination(docs, items, n)
    ids = F.array_sort(F.col("item_ids"))
    return found.select(
        F.col("__id").alias("doc_id"),
        "n_words",
        _united(F.col("spans")).alias("n_hit"),
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def decontaminate(
    docs: DataFrame, items: DataFrame, n: int = 10, remove: str = "documents", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` without contaminated documents, or with the hit words cut out (``remove="spans"``).

    A removed span takes its words and the separators between them. Columns stay as they are;
    only documents that are hit are looked up, so clean texts are not shuffled while the hit
    ones fit a checked broadcast.
    """
    found = find_contamination(docs, items, n, id_col, text_col).where(F.size("spans") > 0)
    hit = bounded_broadcast(cut(found.select("__id", "__th", "spans").dropDuplicates(["__id", "__th"])))
    same = docs[id_col].eqNullSafe(hit["__id"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == hit["__th"])
    if remove == "documents":
        return docs.join(hit, same, "left_anti")
    if remove != "spans":
        raise ValueError("remove is 'documents' or 'spans'")
    text = F.coalesce(docs[text_col], F.lit(""))
    pieces = F.regexp_extract_all(text, F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+|[^0-9A-Za-z\x{80}-\x{10FFFF}]+"), F.lit(0))
    first = F.when(text.rlike(r"^[0-9A-Za-z\x{80}-\x{10FFFF}]"), F.lit(0)).otherwise(F.lit(1))
    inside = lambda j: F.exists(hit["spans"], lambda s: (j >= 2 * s["pos"] + first) & (j <= 2 * (s["pos"] + s["len"] - 1) + first))
    kept = F.array_join(F.filter(pieces, lambda p, j: ~inside(j)), "")
    cleaned = F.when(hit["spans"].isNull(), docs[text_col]).otherwise(kept).alias(text_col)
    return docs.join(hit, same, "left").select(*[cleaned if c == text_col else docs[c] for c in docs.columns])
