import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from clearfold.llm import trie
from clearfold.llm.queries import op12_prefix_trie
from clearfold.session import cut


def by_conversation(rows):
    out = {}
    for c, t, r, x in rows:
        if c is not None:
            out.setdefault(c, []).append((t is not None, t or 0, digest(r, x), r or "", x or ""))
    return {c: [(r, x) for *_, r, x in sorted(v)] for c, v in out.items()}


def digest(role, text):
    role, text = role or "", text or ""
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute(convs):
    """Every node by its prefix, from whole lists of members."""
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    below = {p: [q for q in members if q[: len(p)] == p] for p in members}
    has_child = {q[:-1] for q in members if q}
    out = []
    for p, mine in members.items():
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below[p] if q)
        ids = ",".join(map(str, sorted(ends.get(p, []))))
        out.append((
            min(mine), len(p), min(members[p[:-1]]) if p else None, len(mine), sum(len(q) == len(p) + 1 for q in below[p]),
            sum(q not in has_child for q in below[p]), saved, hashlib.sha256(ids.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def found(spark, rows, shard_cells, rebuild=False):
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    turns = turns.withColumns({"key": F.lit(1), "sizes": F.lit(2), "s": F.lit("x")})
    seqs = cut(trie.sequences(turns))
    return sorted((tuple(r) for r in trie.trie(cut(trie.rebuild(seqs)) if rebuild else seqs, shard_cells).collect()), key=str)


def some_rows(seed):
    draw = random.Random(seed)
    rows = []
    for c in draw.sample(range(500), 60):
        n = draw.choice([1, 2, 3, 8, 40, 70]) if seed % 2 else draw.randint(1, 6)
        turns = [(draw.choice(["user", "assistant", None]), draw.choice(["a", "bé", None, "c c"])) if draw.random() < 0.3 else ("user", "same") for _ in range(n)]
        rows += [(c, t if draw.random() < 0.95 else None, r, x) for t, (r, x) in enumerate(turns)]
    return rows + [(None, 0, "user", "x")] + [(c, 0, "user", "hot") for c in range(1000, 1090)]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("shard_cells", [10, 100_000])
def test_equals_brute_force(spark, seed, shard_cells):
    rows = some_rows(seed)
    assert found(spark, rows, shard_cells) == brute(by_conversation(rows))


def test_rebuilt_equals_brute_force(spark):
    rows = some_rows(2)
    assert found(spark, rows, 25, rebuild=True) == brute(rebuilt(by_conversation(rows)))


def test_shards_do_not_matter(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = brute(rebuilt(by_conversation(rows)))
    assert found(spark, rows, 7, rebuild=True) == want
    assert sorted((tuple(r) for r in op12_prefix_trie(spark, sf_dir).collect()), key=str) == want


def test_all_copies_and_empty(spark):
    copies = [(c, t, "user", "x" * t) for c in range(300) for t in range(3)]
    assert found(spark, copies, 20) == brute(by_conversation(copies))
    assert found(spark, [(None, 1, "a", "b")], 20) == []
    assert found(spark, [(7, None, None, None)], 20) == brute({7: [("", "")]})


@pytest.mark.parametrize("width", [1, 2, 32])
def test_matrix_width(monkeypatch, width):
    monkeypatch.setattr(trie, "WIDTH", width)
    draw = random.Random(5)
    word = {i: hashlib.md5(bytes([i])).digest() for i in range(3)}
    seqs = [[draw.randrange(3) for _ in range(draw.randint(0, 9))] for _ in range(200)]
    keys = [b"".join(word[i] for i in s) for s in seqs]
    shard = trie.Shard(list(range(200)), keys, [[1] * len(s) for s in seqs])
    want = sorted(zip(keys, range(200)))
    assert list(zip(shard.keys, shard.conv.tolist())) == want
    assert shard.shared.tolist() == [-1] + [trie.shared_turns(a, b) for (a, _), (b, _) in zip(want, want[1:])]
