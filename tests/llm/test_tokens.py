import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from clearfold.llm import tokens as t

PATH = public_tokenizers.path("word_bpe_49k.json")


@given(bits=st.integers(1, 32), n=st.integers(0, 70), seed=st.integers(0, 99), data=st.data())
def test_pack_round_trip(bits, n, seed, data):
    ids = np.random.default_rng(seed).integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
    packed = t.pack(ids, bits)
    assert len(packed) == -(-n * bits // 8)
    first = data.draw(st.integers(0, n))
    assert (t.unpack(packed, bits, n - first, first) == ids[first:]).all()


def test_pack_rejects_wide_ids():
    with pytest.raises(ValueError):
        t.pack(np.array([8], np.uint32), 3)


@settings(max_examples=30, deadline=None)
@given(lengths=st.lists(st.integers(0, 90), max_size=12), bits=st.sampled_from([3, 11, 16, 17]))
def test_shard_random_access(lengths, bits):
    r = np.random.default_rng(len(lengths))
    docs = [r.integers(0, 1 << bits, n).astype(np.uint32) for n in lengths]
    out = io.BytesIO()
    w = t.ShardWriter(out, bits, block=32)
    for i, ids in enumerate(docs):
        w.add(i * 7, ids)
    w.close()
    reader = t.ShardReader(out)
    assert [(i, list(x)) for i, x in reader.documents(step=50)] == [(i * 7, list(x)) for i, x in enumerate(docs)]
    whole = np.concatenate(docs) if docs else np.empty(0)
    for a, b in ((0, len(whole)), (len(whole) // 3, min(len(whole), len(whole) // 2 + 1))):
        assert list(reader.ids(a, b)) == list(whole[a:b])
    assert all(list(reader.document(i)) == list(x) for i, x in enumerate(docs))


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.text(max_size=80), st.lists(st.sampled_from(["a", "\x01", " ", "<|startoftext|>", "The.", "X,", "..", ".", "<|ENDOFTEXT|>", "\u00c9t\u00e9", "stra\u00dfe", "\u00aa", "na\u00efve.", "\u0130", "9.", "\u00e9.", "e\u0301", "'s", "\t"])).map("".join)))
def test_word_encoder_equals_whole_text(text):
    assert list(ENCODER([text])[0]) == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_words_go_to_the_model_directly():
    assert ENCODER.apart and ENCODER.folds and ENCODER.direct


BYTES = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
BYTE_ENCODER = t.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.text(max_size=80), st.lists(st.sampled_from(["a", " ", "\n", "The", "X,", "<|endoftext|>", "\u00c9t\u00e9", "9."])).map("".join)))
def test_a_tokenizer_that_tells_case_and_blanks_apart(text):
    assert not BYTE_ENCODER.apart
    assert list(BYTE_ENCODER([text, "The cat. Sat, 3.14 times.", ""])[0]) == BYTES.encode(text, add_special_tokens=False).ids


def test_many_texts_at_once_and_a_small_memory(monkeypatch):
    monkeypatch.setattr(t, "MEMO", 5)
    encoder = t.WordEncoder(PATH)
    texts = ["One two. Three, four", "", "<|endoftext|> x", "two. two.. THREE\nfour", "", "\u00c9t\u00e9. \u00e9t\u00e9, na\u00efve"] * 3
    for _ in range(3):
        assert [list(x) for x in encoder(texts)] == [TOKENIZER.encode(x, add_special_tokens=False).ids for x in texts]
    assert encoder([]) == []


TOKENIZER, ENCODER = Tokenizer.from_file(PATH), t.WordEncoder(PATH)


def test_shards_of_documents(spark, documents):
    rows = [(3, "Hello there", "s"), (1, None, "s"), (2, "", "s"), (3, "Hello there", "s"), (None, "no id <|endoftext|>", "s"), (9, "lang " * 40_000, None), (-4, "é\t中\n\n'tis", "s")]
    got = t.read_shards(t.write_shards(documents(rows), PATH)).orderBy("start").collect()
    at, expected = 0, []
    for i, text in sorted(((i, x) for i, x, _ in rows), key=lambda p: (p[0] is not None, p[0] or 0)):
        ids = np.array(TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        expected.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [tuple(r)[:4] for r in got] == expected
    assert t.read_shards(t.write_shards(documents(rows).limit(0), PATH)).count() == 0
