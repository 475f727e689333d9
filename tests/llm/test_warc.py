import gzip
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clearfold.llm import warc as w


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 99), st.one_of(st.none(), st.text(max_size=30)), st.binary(max_size=200), st.one_of(st.none(), st.integers(0, 9))), max_size=8))
def test_records_round_trip(pages):
    data = b"".join(w.page_record(i, u, p, r, "2020-01-01T00:00:00Z") for i, u, p, r in pages)
    got = list(w.records(io.BytesIO(data)))
    assert [r.kind for r in got] == ["response" if r is None else "revisit" for *_, r in pages]
    assert all(r.verified() for r in got)
    assert [r.payload for r in got] == [p if r is None else b"" for _, _, p, r in pages]
    assert all(r.headers["warc-payload-digest"] == f"sha1:{w.digest(p)}" for r, (_, _, p, _) in zip(got, pages))


def test_each_record_is_a_gzip_member():
    one = w.page_record(1, "http://a/", b"x" * 300_000, None, "d")
    assert gzip.decompress(one).startswith(b"WARC/1.1\r\n")
    assert len(list(w.members(io.BytesIO(one * 3)))) == 3


def test_damage_is_noticed():
    one = w.page_record(1, "http://a/", b"payload", None, "d")
    with pytest.raises(ValueError):
        list(w.records(io.BytesIO(one[:-9])))
    plain = gzip.decompress(one)
    longer = gzip.compress(plain.replace(b"payload", b"payloads"))
    with pytest.raises(ValueError):
        list(w.records(io.BytesIO(longer)))
    changed = gzip.compress(plain.replace(b"payload", b"pAyload"))
    assert [r.verified() for r in w.records(io.BytesIO(changed))] == [False]
    with pytest.raises(ValueError):
        list(w.records(io.BytesIO(gzip.compress(b"no record"))))


def test_pages(spark):
    rows = [(1, "http://a/", "same"), (5, "http://b/é b\r\nX: y", "same"), (3, None, "same"), (4, "u", None), (2, "u", ""), (None, "u", "same"), (7, "u", "z" * 500_000), (7, "u", "z" * 500_000)]
    pages = spark.createDataFrame([(*r, "e", "f") for r in rows], "page_id bigint, url string, html string, id string, sha string")
    got = w.read_archives(w.write_archives(pages)).collect()
    assert all(r["verified"] for r in got)
    found = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got), key=str)
    expected = [(1, 4, "revisit", 5), (5, 4, "response", None), (3, 4, "revisit", 5), (4, 0, "response", None), (2, 0, "revisit", 4), (None, 4, "response", None)]
    assert found == sorted(expected + [(7, 500_000, "response", None)] * 2, key=str)
    assert {r["payload_digest"] for r in got if r["page_id"] in (1, 3, 5)} == {w.digest(b"same")}
    assert w.read_archives(w.write_archives(pages.limit(0))).count() == 0
