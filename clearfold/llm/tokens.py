"""Token ids in fixed-width bit packing: sharded files with block offsets for random access.

A shard holds the documents of one id range in ascending order::

    magic (8 bytes) | blocks of packed ids | document ids | document ends | block offsets | trailer

Every id takes the fewest bits that the vocabulary needs, most significant bit first. A
block packs ``BLOCK`` ids (a multiple of 8, so blocks end on bytes), the last one fewer.
Document ends are counted in ids from the start of the shard, block offsets in bytes from
the start of the file. The trailer has the bits, the block length and the counts.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clearfold.llm.common import small_batches
from clearfold.session import cut, shared_dir

MAGIC = b"CFTOKEN1"
BLOCK = 65_536
TRAILER = struct.Struct("<IIQQQQ")  # bits, ids per block, documents, ids, start of the index, version
TEXT_STEP = 4_000_000  # characters that are tokenized at once
MEMO = 150_000  # words whose ids either half of a worker's memory holds
MARK = "\x01"
TAILS, TAIL = ".,", "[0-9a-z][.,]$"
LOWER_ASCII = {b: b + 32 for b in range(65, 91)}
LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")  # lower-cased the same way everywhere, and in normal form
PROBES = ["the", "Anan", "\u00e9lan", "stra\u00dfe", "\u00d1and\u00fa", "\u00e0" * 9, "x" * 40, "A", "3", "3.14", "it's", "$$$", "", "(so)", "\u4f60\u597d", "X9"]  # a tokenizer that differs on these goes its own way
_VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARACTERS = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_VISIBLE))) if b != 32}  # byte-level models write other bytes so
BYTE_CODES = np.array([ord(BYTE_CHARACTERS.get(b, chr(b))) for b in range(256)], "<u2")
NO_ID = -(1 << 63)  # stands for a null document id
SHARD_BYTES = 32 << 20  # text of one shard, about


# -- packing ---------------------------------------------------------------------------


def bits_for(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids (uint32) as ``bits`` bits each, padded with zero bits to a whole byte."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    octets = np.ascontiguousarray(ids, ">u4").view(np.uint8).reshape(-1, 4)
    if bits % 8 == 0:
        return octets[:, 4 - bits // 8 :].tobytes()
    return np.packbits(np.unpackbits(octets, axis=1)[:, 32 - bits :]).tobytes()


def unpack(data: bytes, bits: int, n: int, first: int = 0) -> np.ndarray:
    """``n`` ids from place ``first`` of packed ``data`` on, without a loop over ids."""
    start = (first + np.arange(n, dtype=np.int64)) * bits
    padded = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(5, np.uint8)])
    word = np.zeros(n, np.uint64)
    for k in range((bits + 14) // 8):
        word = (word << np.uint64(8)) | padded[(start >> 3) + k]
    spare = np.uint64(8 * ((bits + 14) // 8) - bits) - (start & 7).astype(np.uint64)
    return ((word >> spare) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class ShardWriter:
    """Appends documents to an open binary file; memory is bounded by one block and the index."""

    def __init__(self, out, bits: int, block: int = BLOCK):
        self.out, self.bits, self.block = out, bits, block
        self.at, self.pending, self.held, self.total = len(MAGIC), [], 0, 0
        self.doc_ids, self.ends, self.offsets = [], [], []
        out.write(MAGIC)

    def _flush(self, whole: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.empty(0, np.uint32)
        upto = len(ids) if whole else len(ids) - len(ids) % self.block
        for start in range(0, upto, self.block):
            data = pack(ids[start : min(start + self.block, upto)], self.bits)
            self.offsets.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.pending, self.held = [ids[upto:]], len(ids) - upto

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.pending.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        self.doc_ids.append(doc_id)
        self.ends.append(self.total)
        if self.held >= self.block:
            self._flush(False)

    def close(self) -> None:
        self._flush(True)
        for column, kind in ((self.doc_ids, "<i8"), (self.ends, "<u8"), (self.offsets, "<u8")):
            self.out.write(np.array(column, kind).tobytes())
        self.out.write(TRAILER.pack(self.bits, self.block, len(self.doc_ids), self.total, self.at, 1))


class ShardReader:
    """Random access to the ids of a shard through a seekable file."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, os.SEEK_END)
        source.seek(size - TRAILER.size)
        self.bits, self.block, self.n_docs, self.n_ids, self.index, version = TRAILER.unpack(source.read(TRAILER.size))
        source.seek(0)
        if version != 1 or source.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a token shard")
        source.seek(self.index)
        n_blocks = -(-self.n_ids // self.block)
        column = lambda n, kind: np.frombuffer(source.read(8 * n), kind)
        self.doc_ids, self.ends, self.offsets = column(self.n_docs, "<i8"), column(self.n_docs, "<u8"), column(n_blocks, "<u8")

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids at places ``start`` to ``end`` of the shard; reads only the blocks they lie in."""
        if end <= start:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        self.source.seek(int(self.offsets[first]))
        upto = self.offsets[last + 1] if last + 1 < len(self.offsets) else self.index
        data = self.source.read(int(upto) - int(self.offsets[first]))
        return unpack(data, self.bits, end - start, start - first * self.block)

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))

    def documents(self, step: int = 1 << 20) -> Iterator[tuple[int, np.ndarray]]:
        """All documents in order, reading about ``step`` ids at a time."""
        i = 0
        while i < self.n_docs:
            start = int(self.ends[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(self.ends, start + step, "right")))
            ids = self.ids(start, int(self.ends[j - 1]))
            for k in range(i, j):
                low = int(self.ends[k - 1]) if k else 0
                yield int(self.doc_ids[k]), ids[low - start : int(self.ends[k]) - start]
            i = j


# -- tokenizing ------------------------------------------------------------------------


class WordEncoder:
    """Encodes texts with a tokenizer whose tokens never span a blank or a line feed.

    Such a tokenizer gives the ids of a text as the ids of its blank-separated parts, so each
    distinct part is encoded once and remembered, and new parts are encoded many at a time. The memory has
    two halves of at most about ``MEMO`` parts: when the young one is full it becomes the old one,
    and what is used again moves back.

    What a tokenizer allows is probed at the start, never assumed. ``apart``: parts give the ids of
    the text; else whole texts are encoded. ``folds``: A-Z are a-z, and a full stop or comma after
    a letter or digit is a token of its own. ``direct``: a word of plain letters is one piece for
    the model, which ends in a token that ends words; then new words go to the model in one call
    without the other steps, and such tokens tell where each word ends.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.young, self.old = Tokenizer.from_file(path), {}, {}
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None) or None
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        mark = self._ids([MARK])[0]
        self.mark = mark[0] if len(mark) == 1 else None
        self.apart = self._same(PROBES + [f"{a}{s}{b}" for s in (" ", "\n", "  ", " \n") for a in PROBES for b in PROBES], lambda t: t.replace("\n", " ").split(" "))
        self.folds = self.apart and self._same([p + e for p in PROBES for e in ("", ".", ",", "..", ".,")], lambda t: [x for x in _stem(t) if x])
        tails = self._ids(list(TAILS))
        self.folds = self.folds and all(len(x) == 1 for x in tails)
        self.tails = np.array([x[0] for x in tails if x], "<u4")
        letters = [p for p in PROBES if LETTERS.fullmatch(p)]
        self.direct = bool(self.folds and suffix) and self._pieces(letters) == [np.array(i, "<u4").tobytes() for i in self._ids(letters)]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _same(self, texts: list[str], parts: Callable[[str], list[str]]) -> bool:
        """Whether each text has the ids of its parts, one after the other."""
        split = [parts(t) for t in texts]
        ids = iter(self._ids([p for s in split for p in s]))
        return all(whole == [i for _ in s for i in next(ids)] for whole, s in zip(self._ids(texts), split))

    def _pieces(self, words: list[str]) -> list[bytes] | None:
        """Ids of words of plain letters straight from the model; None if their ends cannot be told."""
        text = " ".join(words)
        if not text.isascii():
            octets = np.frombuffer(text.lower().encode(), np.uint8)
            text = BYTE_CODES[octets].tobytes().decode("utf-16-le")
        ids = np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(ends) != len(words) or len(words) and ends[-1] != 4 * len(ids):
            return None
        data, ends = ids.tobytes(), ends.tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def _encode(self, parts: list[str]) -> None:
        young = self.young
        if self.direct:
            words = [p for p in parts if LETTERS.fullmatch(p)]
            for start in range(0, len(words), 4096):
                some = words[start : start + 4096]
                found = self._pieces(some)
                if found is not None:
                    young.update(zip(some, found))
            parts = [p for p in parts if p not in young] if words else parts
        together = [] if self.mark is None else [p for p in parts if MARK not in p]
        alone = parts if self.mark is None else [p for p in parts if MARK in p]
        for start in range(0, len(together), 4096):
            some = together[start : start + 4096]
            ids = np.array(self._ids([f" {MARK} ".join(some)])[0], "<u4")
            ends = np.flatnonzero(ids == self.mark).tolist() + [len(ids)]
            data, at = ids.tobytes(), 0
            for part, end in zip(some, ends):
                young[part] = data[4 * at : 4 * end]
                at = end + 1
        for part, ids in zip(alone, self._ids(alone)):
            young[part] = np.array(ids, "<u4").tobytes()

    def _known(self, parts: list[str]) -> list[bytes]:
        """Ids of distinct parts, from memory or encoded now."""
        if len(self.young) > MEMO:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        missing = []
        for p in [p for p in parts if p not in young]:
            if p in old:
                young[p] = old[p]
            else:
                missing.append(p)
        self._encode(missing)
        return list(map(young.__getitem__, parts))

    def __call__(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Ids of each text. Arrow splits the texts and numbers their parts, numpy gathers the ids."""
        whole = [i for i, t in enumerate(texts) if not self.apart or "<|" in t]  # what could be a special token is not taken apart
        if whole:
            out = dict(zip(whole, (np.array(x, "<u4") for x in self._ids([texts[i] for i in whole]))))
            rest = [t for i, t in enumerate(texts) if i not in out]
            others = iter(self(rest) if rest else [])
            return [out[i] if i in out else next(others) for i in range(len(texts))]
        column = pa.array(texts, pa.large_string())
        column = pc.ascii_lower(column) if self.folds else column
        lists = pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")
        numbered = lists.flatten().dictionary_encode()
        parts, codes = numbered.dictionary, numbered.indices.to_numpy()
        tail = np.zeros(len(parts), np.int64)  # 1, 2: the part is a stem and the first, second of TAILS
        if self.folds:
            marked = pc.match_substring_regex(parts, TAIL)
            for k, mark in enumerate(TAILS):
                tail[pc.and_(marked, pc.ends_with(parts, mark)).to_numpy(zero_copy_only=False)] = k + 1
            numbered = pc.if_else(marked, pc.utf8_slice_codeunits(parts, 0, -1), parts).dictionary_encode()
            parts, stem = numbered.dictionary, numbered.indices.to_numpy()
            tail, codes = tail[codes], stem[codes]
        else:
            tail = tail[codes]
        table = self._known(parts.to_numpy(zero_copy_only=False).tolist())
        lengths = np.fromiter(map(len, table), np.int64, len(table)) // 4
        first = np.cumsum(lengths) - lengths
        n = lengths[codes] + (tail > 0)
        upto = np.cumsum(n)
        places = np.repeat(first[codes] - (upto - n), n) + np.arange(int(upto[-1]) if len(upto) else 0)
        held = np.frombuffer(b"".join([*table, b"\0\0\0\0"]), "<u4")
        flat = held[places]
        flat[upto[tail > 0] - 1] = self.tails[tail[tail > 0] - 1]
        ends = np.concatenate([[0], upto])[lists.offsets.to_numpy()]
        return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _stem(part: str) -> tuple[str, str]:
    """A part with A-Z as a-z, and a full stop or comma that follows a letter or digit at its end."""
    part = part.translate(LOWER_ASCII)
    return (part[:-1], part[-1]) if re.search(TAIL, part) else (part, "")


def _steps(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= TEXT_STEP:
            yield held
            held, size = [], 0
    if held:
        yield held


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    """One encoder per worker process and tokenizer, so that its memory outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


# -- Spark jobs ------------------------------------------------------------------------

MANIFEST = "file string, first_id bigint, n_docs bigint, n_tokens bigint, bits int"


def _open(uri: str, write: bool):
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs.open_output_stream(path) if write else fs.open_input_file(path)


def write_shards(
    docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
    shard_bytes: int = SHARD_BYTES, vocabulary: int | None = None,
) -> DataFrame:
    """Write token shards and return their manifest, a written table with one row per shard.

    Documents are range-partitioned by id and sorted; a task streams its range into one file
    under a name of its own. Only the manifest says which files count, and it has a row only
    for tasks that succeeded, so a lost executor or a second attempt leaves at worst a file
    that nothing names. ``end_id`` closes every document. A null text is empty and yields just
    the end id; rows of equal ids lie next to each other; a null id is stored as ``NO_ID``, comes
    first and is read back as null. An empty table gives no shards. ``folder`` is a URI that
    pyarrow can write (default: a new one in the shared folder); extra columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text))).first()
    if vocabulary is None:
        from tokenizers import Tokenizer

        vocabulary = Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True)
    bits = bits_for(max(vocabulary, end_id + 1))
    shards = max(1, int((size[0] or 0) // shard_bytes), spark.sparkContext.defaultParallelism)
    ordered = (
        docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"), text.alias("text")).repartitionByRange(shards, "id")
        .sortWithinPartitions("id", "text")
    )
    end = np.array([end_id], np.uint32)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer, uri = _encoder(tokenizer), None, f"{folder}/{uuid.uuid4().hex}.tok"
        for batch in batches:
            ids, at = batch.column("id").to_pylist(), 0
            for texts in _steps(batch.column("text").to_pylist()):
                for coded in encode(texts):
                    if writer is None:
                        writer = ShardWriter(_open(uri, True), bits)
                    writer.add(ids[at], np.concatenate([coded, end]))
                    at += 1
        if writer is not None:
            writer.close()
            writer.out.close()
            row = [[uri], [writer.doc_ids[0]], [len(writer.doc_ids)], [writer.total], [bits]]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=["file", "first_id", "n_docs", "n_tokens", "bits"])

    return cut(ordered.mapInArrow(write, MANIFEST))


def read_shards(manifest: DataFrame) -> DataFrame:
    """One row per document of the shards: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``, ``shard``.

    ``start`` is the number of ids before the document over all shards in order; a running sum
    over one row per shard gives what precedes a shard. Each shard is read by one task, block
    by block. The checksum is over the ids as little-endian 32-bit integers.
    """
    spark: SparkSession = manifest.sparkSession
    order = Window.orderBy("first_id", "file")
    placed = manifest.select(
        "file", "n_tokens", (F.row_number().over(order) - 1).cast("bigint").alias("shard"),
        F.coalesce(F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    placed = cut(placed)
    n = max(1, placed.count(), spark.sparkContext.defaultParallelism)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows, at = [], row["before"]
                with _open(row["file"], False) as source:
                    for doc_id, ids in ShardReader(source).documents():
                        rows.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), row["shard"]))
                        at += len(ids)
                        if len(rows) == 10_000:
                            yield _columns(rows)
                            rows = []
                if at - row["before"] != row["n_tokens"]:
                    raise ValueError(f"{row['file']} has not the ids its manifest names")
                if rows:
                    yield _columns(rows)

    dealt = placed.repartitionByRange(n, "shard")
    rows = dealt.mapInArrow(read, "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, shard bigint")
    return rows.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "start", "n_tokens", "ids_crc32", "shard")


def _columns(rows: list[tuple]) -> pa.RecordBatch:
    names = ["id", "start", "n_tokens", "ids_crc32", "shard"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)
