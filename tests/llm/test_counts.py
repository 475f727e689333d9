import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from clearfold.llm import counts

FILES = ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"]


def library(name, texts):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        return [len(sentencepiece.SentencePieceProcessor(model_file=path).encode(t)) for t in texts]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def odd_texts(seed=3):
    draw = random.Random(seed)
    atoms = ["the", "Cat's", "ran", " ", "  ", "\n", "\n\n", "\t", "▁", "é", "你好吗", "　", "\U0001f600", "<s>", "<|endoftext|>", "3.14", "...", "é", " ", "zzzzzz", "\x00", "\x01"]
    texts = ["".join(draw.choice(atoms) + draw.choice(["", " ", " ", "  "]) for _ in range(draw.randint(1, 400))) for _ in range(150)]
    return texts + ["", " ", "a" * 5000, "你好" * 3000, " " * 4000, "word " * 2000, "\n" * 300, " x" * 40 + " "]


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize("long", [1, 7, 60, 1 << 14])
def test_pieces_count_as_the_whole(name, long):
    texts = odd_texts()
    assert counts.lengths(texts, counts.counter(public_tokenizers.path(name)), long, 500) == library(name, texts)


@pytest.mark.parametrize("name", FILES)
def test_long_texts_are_cut(name):
    own = counts.counter(public_tokenizers.path(name))
    assert own.cuts
    pieces = list(own.split("some words in a row " * 5000, 1000))
    assert len(pieces) > 90 and max(len(p) for p, _ in pieces) < 1100


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = {r["doc_id"]: r for r in counts.count_tokens(docs, path, long=500).collect()}
    rows = docs.select("doc_id", "text").collect()
    want = library("piece_bpe_32k.model", [r["text"] or "" for r in rows])
    assert len(got) == len(rows)
    for r, n in zip(rows, want):
        assert tuple(got[r["doc_id"]]) == (r["doc_id"], len((r["text"] or "").encode()), n, n > 4096)


def test_nulls_repeats_extra_columns_and_empty(spark):
    rows = [(1, None, "a", 5), (1, "two words", "b", 6), (1, "two words", "b", 6), (None, "x", "c", 7), (4, "", "d", 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string, id int")
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = sorted((tuple(r) for r in counts.count_tokens(docs, path, limit=1).collect()), key=str)
    assert got == sorted([(1, 0, 0, False), (1, 9, 2, True), (1, 9, 2, True), (None, 1, 1, False), (4, 0, 0, False)], key=str)
    assert counts.count_tokens(docs.where(F.lit(False)), path).count() == 0


def test_unknown_kind():
    with pytest.raises(ValueError):
        counts.counter("/x/vocab.txt")
