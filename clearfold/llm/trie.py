"""Prefix trie of conversations: how many share each beginning, and what a shared cache saves.

A conversation is the sequence of its turns' digests, so the bytes of its key sort like the
sequence. Rows are dealt by ranges of (key, id) and every shard works on its own rows:

* a padded matrix of turn ids, some columns at a time, sorted with ``lexsort``;
* change masks between neighbouring rows, or-accumulated over the columns, give the depth to
  which a row repeats the row before, and a node starts where it stops repeating;
* ``reduceat`` over the cells (row, depth) in order of depth sums up every node of the shard.

Every figure is a sum over the rows of a node, once a row knows its neighbours on both sides.
So a node that goes over the edge of a shard, which must lie on the path of the shard's first
or last row, is emitted in part and recombined; what its shard could not know about the row
before is added as a correction from a table of one row per shard. Copies of one conversation
may fill any number of shards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clearfold.llm.common import bounded_broadcast, small_batches
from clearfold.session import cut

DIGEST = 16  # bytes of a turn's digest
SHARD_CELLS = 500_000  # turns and roots that one shard should hold, about
WIDTH = 32  # columns of the matrix that are sorted at once
NO_ENDS = hashlib.sha256(b"").hexdigest()
INNER, EDGE_NODE, SHARD = 0, 1, 2

FIGURES = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
PARTIAL = (
    "kind int, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    "saved_tokens bigint, ends string, first_end bigint, node string, parent string, first_key binary, last_key binary, sums array<bigint>"
)


# -- sequences -------------------------------------------------------------------------


def turn_digest(role: Column, text: Column) -> Column:
    """Hex digest that tells (role, text) pairs apart."""
    return F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))


def sequences(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``conv_id, key, sizes``: the turns of a conversation as digests in a row, and the bytes of their texts.

    Turns are in order of ``turn_col``, null first, equal ones by digest; a null role or text is
    empty. Rows without a conversation id belong to none and are left out. Texts are digested
    where they are scanned; a conversation is one row of 16 bytes a turn.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    narrow = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("conv_id"),
        F.struct(F.col(turn_col).alias("t"), turn_digest(role, text).alias("d"), F.octet_length(text).cast("bigint").alias("b")).alias("s"),
    )
    ordered = narrow.groupBy("conv_id").agg(F.sort_array(F.collect_list("s")).alias("s"))
    return ordered.select("conv_id", F.unhex(F.array_join("s.d", "")).alias("key"), F.col("s.b").alias("sizes"))


def rebuild(seqs: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """Sequences whose first turns are those of the first conversation of their group of ids.

    Conversation c takes the first h turns of conversation ``c - c % group`` (all if there are
    fewer, none if there is no such conversation), then its own turns after its first h, with h
    the crc32 of its decimal id modulo ``most``. A sequence may end up without any turn. ``seqs``
    should be a written table.
    """
    base, h = F.col("conv_id") - F.col("conv_id") % group, (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    head = seqs.where(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("__b"),
        F.substring("key", 1, DIGEST * (most - 1)).alias("__k"),
        F.slice("sizes", 1, most - 1).alias("__s"),
    )
    own = seqs.withColumns({"__base": base, "__h": h})
    none = F.lit(b"").cast("binary")
    key = F.concat(
        F.coalesce(F.substring(F.col("__k"), F.lit(1), F.col("__h") * DIGEST), none),
        F.substring(F.col("key"), F.col("__h") * DIGEST + 1, F.lit(2**31 - 1)),
    )
    sizes = F.concat(
        F.coalesce(F.slice(F.col("__s"), F.lit(1), F.col("__h")), F.array().cast("array<bigint>")),
        F.slice(F.col("sizes"), F.col("__h") + 1, F.greatest(F.size("sizes") - F.col("__h"), F.lit(0))),
    )
    return own.join(head, F.col("__base") == F.col("__b"), "left").select("conv_id", key.alias("key"), sizes.alias("sizes"))


# -- one shard -------------------------------------------------------------------------


class Shard:
    """The rows of one shard in order, with the depth to which each repeats the row before."""

    def __init__(self, convs: Sequence[int], keys: Sequence[bytes], sizes: Sequence[Sequence[int]]):
        self.conv = np.array(convs, np.int64)
        self.keys = keys
        self.length = np.array([len(k) // DIGEST for k in keys], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.length)[:-1]]).astype(np.int64)
        self.turns = self._turn_ids(b"".join(keys))
        self.sizes = np.concatenate([np.asarray(s, np.int64) for s in sizes]) if len(sizes) else np.empty(0, np.int64)
        self._sort()
        self.shared = self._shared()

    @staticmethod
    def _turn_ids(digests: bytes) -> np.ndarray:
        """Dense ids from 1 on that sort like the digests."""
        parts = np.frombuffer(digests, ">u8").reshape(-1, 2)
        order = np.lexsort((parts[:, 1], parts[:, 0]))
        new = np.ones(len(order), bool)
        new[1:] = (parts[order][1:] != parts[order][:-1]).any(axis=1)
        ids = np.empty(len(order), np.int64)
        ids[order] = np.cumsum(new)
        return ids

    def _matrix(self, rows: np.ndarray, start: int) -> np.ndarray:
        """Turn ids of ``rows`` at the depths from ``start`` on, 0 beyond a row's end."""
        columns = start + np.arange(WIDTH)
        inside = columns[None, :] < self.length[rows][:, None]
        at = np.where(inside, self.first[rows][:, None] + columns[None, :], 0)
        return np.where(inside, self.turns[at], 0) if len(self.turns) else np.zeros(at.shape, np.int64)

    def _sort(self) -> None:
        """Order rows by sequence, then id; columns are sorted while rows still tie and go on."""
        n = len(self.conv)
        rank, order = np.zeros(n, np.int64), np.arange(n)
        start = 0
        while True:
            size = np.bincount(rank, minlength=n)
            longest = np.zeros(n, np.int64)
            np.maximum.at(longest, rank, self.length)
            active = np.flatnonzero((size[rank] > 1) & (longest[rank] > start))
            if not len(active):
                break
            m = self._matrix(active, start)
            by = np.lexsort((*m.T[::-1], rank[active]))
            rows, m = active[by], m[by]
            tied = rank[rows]
            fresh = np.ones(len(rows), bool)
            fresh[1:] = tied[1:] != tied[:-1]
            heads = np.flatnonzero(fresh)
            place = tied + np.arange(len(rows)) - np.repeat(heads, np.diff(np.append(heads, len(rows))))
            fresh[1:] |= (m[1:] != m[:-1]).any(axis=1)
            rank[rows] = np.maximum.accumulate(np.where(fresh, place, -1))
            start += WIDTH
        order = np.lexsort((self.conv, rank))
        self.conv, self.length, self.first = self.conv[order], self.length[order], self.first[order]
        self.keys = [self.keys[i] for i in order]

    def _shared(self) -> np.ndarray:
        """Leading turns that a row shares with the row before; -1 for the first row."""
        n = len(self.conv)
        shared = np.zeros(n, np.int64)
        least = np.minimum(self.length[1:], self.length[:-1])
        pairs, start = np.arange(n - 1), 0
        while len(pairs := pairs[least[pairs] > start]):
            changed = np.logical_or.accumulate(self._matrix(pairs, start) != self._matrix(pairs + 1, start), axis=1)
            shared[pairs + 1] += (~changed).sum(axis=1)
            pairs, start = pairs[~changed[:, -1]], start + WIDTH
        shared[1:] = np.minimum(shared[1:], least)
        shared[:1] = -1
        return shared

    def sums(self, row: int) -> np.ndarray:
        """Bytes of the first 0, 1, 2, ... texts of a row."""
        return np.concatenate([[0], np.cumsum(self.sizes[self.first[row] : self.first[row] + self.length[row]])])

    def path(self, row: int) -> list[str]:
        """Names of the nodes that a row passes, from the root on."""
        return path_names(self.keys[row])


def path_names(key: bytes) -> list[str]:
    """Names of the prefixes of a key, the empty one first: digests over their digests."""
    state = hashlib.md5()
    names = [state.hexdigest()]
    for i in range(0, len(key), DIGEST):
        state.update(key[i : i + DIGEST])
        names.append(state.hexdigest())
    return names


def shard_nodes(shard: Shard) -> Iterator[pa.RecordBatch]:
    """Nodes of a shard: whole ones, parts of those on the paths of its first and last row, and its edges."""
    n = len(shard.conv)
    cells = shard.length + 1
    begin = np.concatenate([[0], np.cumsum(cells)]).astype(np.int64)
    row = np.repeat(np.arange(n), cells)
    depth = np.arange(begin[-1]) - begin[row]
    running = np.concatenate([[0], np.cumsum(np.concatenate([shard.sizes[f : f + k] for f, k in zip(shard.first, shard.length)] or [[]]))])
    offset = np.concatenate([[0], np.cumsum(shard.length)])[:-1]
    sums = (running[offset[row] + depth] - running[offset[row]]).astype(np.int64)
    shared = shard.shared
    starts_here = depth > shared[row]
    following = np.append(shared[1:], -1)  # what the next row shares with a row
    last_of_leaf = following < shard.length

    by_depth = np.argsort(depth, kind="stable")
    starts = np.flatnonzero(starts_here[by_depth])
    node_of = np.empty(len(row), np.int64)
    node_of[by_depth] = np.cumsum(starts_here[by_depth]) - 1
    per_node = lambda values, how=np.add: how.reduceat(values[by_depth].astype(np.int64), starts)
    repeated = np.where(depth <= shared[row], sums[begin[row] + np.maximum(shared[row], 0)] - sums[np.maximum(begin[row] + depth - 1, begin[row])], 0)
    figures = [
        per_node(np.ones(len(row))),
        per_node((shard.length[row] > depth) & (shared[row] <= depth)),
        per_node(last_of_leaf[row]),
        per_node(repeated),
    ]
    smallest = per_node(shard.conv[row], np.minimum)
    top = by_depth[starts]  # cell in which a node starts
    parent = np.where(depth[top] > 0, node_of[np.maximum(top - 1, 0)], -1)

    ends: list[str | None] = [None] * len(starts)
    first_end = np.zeros(len(starts), np.int64)
    end_node = node_of[begin[:-1] + shard.length]
    heads = np.flatnonzero(np.append(True, end_node[1:] != end_node[:-1]))
    for a, b in zip(heads, np.append(heads[1:], n)):
        ends[end_node[a]] = ",".join(map(str, shard.conv[a:b].tolist()))
        first_end[end_node[a]] = shard.conv[a]

    names: dict[int, str] = {}
    for edge in (0, n - 1):
        names.update(zip(node_of[begin[edge] : begin[edge + 1]].tolist(), shard.path(edge)))
    yield from _node_batches(names, depth[top], smallest, parent, figures, ends, first_end)
    yield _columns(1, kind=[SHARD], conv_id=[int(shard.conv[0])], first_key=[shard.keys[0]], last_key=[shard.keys[-1]], sums=[shard.sums(0).tolist()])


def _node_batches(names, depth, smallest, parent, figures, ends, first_end, step: int = 20_000) -> Iterator[pa.RecordBatch]:
    on_edge = np.zeros(len(depth), bool)
    on_edge[list(names)] = True
    open_parent = (parent >= 0) & on_edge[np.maximum(parent, 0)]
    inner = np.flatnonzero(~on_edge)
    for some in (inner[i : i + step] for i in range(0, len(inner), step)):
        above = parent[some]
        yield _columns(
            len(some), kind=np.full(len(some), INNER), conv_id=smallest[some], depth=depth[some],
            parent_conv_id=pa.array(smallest[above], pa.int64(), mask=open_parent[some]),
            **{name: f[some] for name, f in zip(FIGURES, figures)},
            ends=[hashlib.sha256(ends[i].encode()).hexdigest() if ends[i] else NO_ENDS for i in some],
            parent=[names.get(p) for p in above.tolist()],
        )
    for i, name in names.items():
        yield _columns(
            1, kind=[EDGE_NODE], conv_id=[smallest[i]], depth=[depth[i]], **{c: [f[i]] for c, f in zip(FIGURES, figures)},
            ends=[ends[i]], first_end=[int(first_end[i]) if ends[i] else None], node=[name], parent=[names[parent[i]] if parent[i] >= 0 else None],
        )


_KINDS = {
    "kind": pa.int32(), "conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(),
    "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends": pa.string(), "first_end": pa.int64(), "node": pa.string(), "parent": pa.string(),
    "first_key": pa.binary(), "last_key": pa.binary(), "sums": pa.list_(pa.int64()),
}


def _columns(n: int, **given) -> pa.RecordBatch:
    arrays = [
        given[c] if isinstance(given.get(c), pa.Array) else pa.array(given[c], t) if c in given else pa.nulls(n, t) for c, t in _KINDS.items()
    ]
    return pa.RecordBatch.from_arrays(arrays, names=list(_KINDS))


def _work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    convs: list[int] = []
    keys: list[bytes] = []
    sizes: list[np.ndarray] = []
    for batch in batches:
        convs += batch.column("conv_id").to_pylist()
        keys += batch.column("key").to_pylist()
        values = batch.column("sizes")
        flat, offsets = values.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *[len(k) // DIGEST for k in batch.column("key").to_pylist()]])
        sizes += [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
    if convs:
        yield from shard_nodes(Shard(convs, keys, sizes))


def shared_turns(a: bytes, b: bytes) -> int:
    """Leading turns that two keys share."""
    n = min(len(a), len(b)) // DIGEST
    if a[: n * DIGEST] == b[: n * DIGEST]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if a[: middle * DIGEST] == b[: middle * DIGEST] else (low, middle)
    return low


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What changes at the nodes of a shard's first row, once the last row before it is known.

    The shard took that row for one that shares nothing with the row before. Nodes it does share
    do not start there, so their children on the path were counted twice and their bytes are
    saved once more; and the row before ends no leaf if this row repeats or continues it.
    """
    for batch in batches:
        for r in batch.to_pylist():
            before, key = r["before"], r["first_key"]
            depth = shared_turns(before, key)
            names, sums = path_names(key[: depth * DIGEST]), r["sums"]
            no_leaf = int(len(before) // DIGEST == depth)
            rows = [(name, d, 0, -int(d < depth), -no_leaf, sums[depth] - sums[max(d - 1, 0)]) for d, name in enumerate(names)]
            given = dict(zip(["node", "depth", *FIGURES], zip(*rows)))
            yield _columns(len(rows), kind=[EDGE_NODE] * len(rows), parent=[None, *names[:-1]], **given)


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the joined parts of each node, which arrive together and in order."""
    node, state = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], names=["node", "digest"])

    for batch in batches:
        for name, part in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist()):
            if name == node:
                state.update(b"," + part.encode())
            else:
                if node is not None:
                    yield done()
                node, state = name, hashlib.sha256(part.encode())
    if node is not None:
        yield done()


def trie(seqs: DataFrame, shard_cells: int = SHARD_CELLS) -> DataFrame:
    """One row per node of the prefix trie of ``seqs`` (``conv_id, key, sizes``), the root included.

    ``conv_id`` smallest member; ``depth``; ``parent_conv_id`` that of the parent, null at the
    root; ``n_convs`` members; ``n_children``; ``n_leaves`` and ``saved_tokens`` over the subtree;
    ``ends_sha256`` over the ids of the members that end here. Ids must be unique. Turns are told
    apart by 128-bit digests. No sequence, no node; sequences without turns are members of the
    root alone. ``seqs`` should be a written table, since it is sampled before it is dealt.
    """
    spark = seqs.sparkSession
    small_batches(spark)
    cells = seqs.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    shards = max(spark.sparkContext.defaultParallelism, int(cells // shard_cells) + 1)
    parts = cut(seqs.select("conv_id", "key", "sizes").repartitionByRange(shards, "key", "conv_id").mapInArrow(_work, PARTIAL))

    edges = parts.where(F.col("kind") == SHARD)
    before = F.lag("last_key").over(Window.orderBy("first_key", "conv_id")).alias("before")
    joints = edges.select("first_key", "sums", before).where(F.col("before").isNotNull())
    partial = parts.where(F.col("kind") == EDGE_NODE).unionByName(joints.mapInArrow(_corrections, PARTIAL))
    whole = partial.groupBy("node", "depth", "parent").agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in FIGURES])
    lists = parts.where((F.col("kind") == EDGE_NODE) & F.col("ends").isNotNull()).select("node", "first_end", "ends")
    digests = lists.repartition("node").sortWithinPartitions("node", "first_end").drop("first_end").mapInArrow(_hash_ends, "node string, digest string")
    edge_nodes = cut(whole.join(digests, "node", "left").withColumn("ends", F.coalesce("digest", F.lit(NO_ENDS))).drop("digest"))

    shown = ["conv_id", "depth", "parent_conv_id", *FIGURES, F.col("ends").alias("ends_sha256")]
    inner = parts.where(F.col("kind") == INNER)
    open_nodes = inner.where(F.col("parent").isNotNull()).drop("parent_conv_id").select("conv_id", "depth", *FIGURES, "ends", "parent")
    open_nodes = open_nodes.unionByName(edge_nodes.select("conv_id", "depth", *FIGURES, "ends", "parent"))
    parents = edge_nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    named = open_nodes.join(bounded_broadcast(parents), "parent", "left")
    return inner.where(F.col("parent").isNull()).select(*shown).unionByName(named.select(*shown))
