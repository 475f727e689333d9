"""Token counts of whole texts: lengths only, in batches of about equal bytes."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from clearfold.llm.common import small_batches

BATCH_BYTES = 1 << 20  # text that one call of the library gets, about
LONG = 1 << 14  # characters; a longer text is cut into pieces of about this length
LIMIT = 4096
BLANK = "▁"  # what piece models write for a blank
PROBES = ["a", "the cat", "x.", "Don't", "9", "été", "in  two", "你好", "(so", "end\nof", "A1", "it's 3.5%", "zz" * 9]

Cut = tuple[str, int]  # a piece of a text, and the tokens its encoding has beyond its share of the whole


class PieceCounter:
    """Counts of a piece model, and the places where a text may be cut without changing them.

    No piece reaches over a pair of characters that stands in no piece, so a text may be cut
    between them. The library puts a blank before every text: a piece that followed a blank
    leaves its own out; before any other piece that blank is one token too many, if no piece
    joins it to the character it now precedes. Models without that blank, with a piece that goes
    on after a word's end, or that count a probe otherwise are never given pieces of a text.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size()) if not self.model.is_control(i) and not self.model.is_byte(i)]
        self.pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        plain = BLANK in pieces and not any(p[1] == BLANK != p[0] for p in self.pairs)
        self.cuts = plain and all(self._same(a, b) for a in PROBES for b in PROBES)

    def _same(self, a: str, b: str) -> bool:
        whole, left, right, line, spaced = self.counts([f"{a} {b}", a, b, f"\n{b}", f"{a}\n{b}"])
        return whole == left + right and ("\n" in self.pairs or spaced == left + line - 1)

    def counts(self, texts: Sequence[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, out_type=int, num_threads=1)]

    def split(self, text: str, long: int) -> Iterator[Cut]:
        start, extra = 0, 0
        while self.cuts and len(text) - start > long:
            at, drop = self._place(text, start + long)
            if at < 0:
                break
            yield text[start:at], extra
            start, extra = at + drop, 1 - drop
        yield text[start:], extra

    def _place(self, text: str, i: int) -> tuple[int, int]:
        """The first safe place from ``i`` on, and 1 if it is a blank that the next piece leaves out."""
        for j in range(i, len(text) - 1):
            before, here = text[j - 1], text[j]
            if here == " ":
                if before not in (" ", BLANK):
                    return j, 1
            elif before not in (" ", BLANK) and here != BLANK and before + here not in self.pairs and BLANK + here not in self.pairs:
                return j, 0
        return -1, 0


class WordCounter:
    """Counts of a tokenizer file; texts are cut before a blank between ASCII letters, if probes agree."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.cuts = all(self._same(f"{a} x", f" y {b}") for a in PROBES for b in PROBES)

    def _same(self, a: str, b: str) -> bool:
        whole, left, right = self.counts([a + b, a, b])
        return whole == left + right

    def counts(self, texts: Sequence[str]) -> list[int]:
        return [len(x) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def split(self, text: str, long: int) -> Iterator[Cut]:
        start = 0
        while self.cuts and len(text) - start > long:
            at = text.find(" ", start + long)
            while at >= 0 and not _between_letters(text, at):
                at = text.find(" ", at + 1)
            if at < 0:
                break
            yield text[start:at], 0
            start = at
        yield text[start:], 0


def _between_letters(text: str, at: int) -> bool:
    sides = text[at - 1 : at] + text[at + 1 : at + 2]
    return len(sides) == 2 and sides.isascii() and sides.isalpha()


_COUNTERS: dict[str, PieceCounter | WordCounter] = {}


def counter(path: str) -> PieceCounter | WordCounter:
    """One counter per worker process and file: tokenizers for .json, sentencepiece for .model."""
    if path not in _COUNTERS:
        kinds: dict[str, Callable] = {".json": WordCounter, ".model": PieceCounter}
        kind = os.path.splitext(path)[1]
        if kind not in kinds:
            raise ValueError(f"no library for {path}")
        _COUNTERS[path] = kinds[kind](path)
    return _COUNTERS[path]


def lengths(texts: Sequence[str], count: PieceCounter | WordCounter, long: int = LONG, batch_bytes: int = BATCH_BYTES) -> list[int]:
    """Tokens of every text. Pieces of long texts and whole short ones fill batches of ``batch_bytes``."""
    totals = [0] * len(texts)
    pieces: list[str] = []
    owners: list[int] = []
    held = 0

    def flush() -> None:
        for i, n in zip(owners, count.counts(pieces)):
            totals[i] += n
        pieces.clear()
        owners.clear()

    for i, text in enumerate(texts):
        for piece, extra in count.split(text, long) if len(text) > long else ((text, 0),):
            totals[i] -= extra
            pieces.append(piece)
            owners.append(i)
            held += len(piece)
            if held >= batch_bytes:
                flush()
                held = 0
    if pieces:
        flush()
    return totals


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, long: int = LONG) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` per row of ``docs``, as the library counts the whole text.

    Texts stay in the tasks that read them; only four narrow columns come back. No begin, end or
    padding token is counted, nothing is truncated, and special strings inside texts are read as
    the library reads them by default. A null or empty text has no bytes and no tokens; rows that
    repeat and null ids each give a row; an empty table gives none; other columns are not read.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer)
        for batch in batches:
            n = pa.array(lengths(batch.column("text").to_pylist(), own, long), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), n], names=["id", "n_bytes", "n_tokens"])

    shape = StructType([StructField("id", kind), StructField("n_bytes", LongType()), StructField("n_tokens", LongType())])
    counted = narrow.mapInArrow(count, shape)
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
