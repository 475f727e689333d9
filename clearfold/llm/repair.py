"""Cheapest repair of conversations whose turns must read system?, then user and assistant in turn.

Rows are kept, given another role, deleted, or an empty turn is put in. The costs of all rests of
a conversation, per state of the role order, form a vector of four; a row maps the vector behind
it to the one before it. A long conversation is cut into chunks of rows that run in parallel:

* each chunk starts from a vector it guesses, the last one from the true one;
* a chunk whose guess differs from the vector its right neighbour found by more than a constant
  runs again, from the right until old and new vectors differ only by a constant, since from
  there on every difference stays as it was; passes go on until no chunk has to run;
* every choice of edits compares costs of one vector with the next, so vectors up to a constant
  drive the tracing: first from all four states a chunk may be entered in, then, when the chunks'
  maps of states are stitched, from the true one, taking the least letter of the cheapest edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clearfold.llm.common import small_batches
from clearfold.llm.trie import turn_digest
from clearfold.session import cut

SPAN = 512  # turn numbers of one chunk
CHUNK_ROWS = 4096  # rows of one span that are not cut any further
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1  # costs; keeping is free
NONE, CUT, DROP = 0, 1, 2  # faults of a row as the costs see them; DROP must be deleted
NO_TURN = -(1 << 63)
SPACES = " \t\n\x0b\x0c\r"
ENDINGS = (".", "!", "?")
BLANK, DUPLICATE = 1, 2

# States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
FORCED = (2, 2, 3, 2)  # state after the user or assistant turn that may follow
ROLE_OF = {2: "user", 3: "assistant"}
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
END = (0, INSERT * 2, INSERT, 0)  # cost of ending in each state
GUESS = (0, 0, 0, 0)
FAR = 1 << 40

Vector = tuple[int, int, int, int]


def level(v: Vector) -> Vector:
    """A vector up to a constant."""
    least = min(v)
    return tuple(x - least for x in v)  # type: ignore[return-value]


_STEPS: dict[tuple[str, int, Vector], tuple[Vector, int]] = {}


def step_back(initial: str, fault: int, behind: Vector) -> tuple[Vector, int]:
    """The levelled vector before a row, and the constant taken off; ``behind`` is levelled.

    Few levelled vectors occur, so each step is worked out once.
    """
    known = _STEPS.get((initial, fault, behind))
    if known is None:
        edit = [_consume(initial, fault, behind, s)[0] for s in range(4)]
        full = tuple(min(edit[s], INSERT + edit[FORCED[s]], 2 * INSERT + edit[FORCED[FORCED[s]]]) for s in range(4))
        known = _STEPS[(initial, fault, behind)] = (level(full), min(full))
    return known


def _consume(initial: str, fault: int, behind: Vector, s: int) -> tuple[int, str]:
    """Cost and least letter of the cheapest edit of a row itself, in state ``s``."""
    options = [(DELETE + behind[s], "D")]
    if fault != DROP:
        to = STEP.get((s, initial))
        options += [(fault * TRUNCATED + behind[to], "K")] if to is not None else []
        options.append((REROLE + fault * TRUNCATED + behind[FORCED[s]], "R"))
    return min(options)


def backward(initials: str, faults: bytes, right: Vector) -> list[Vector]:
    """Levelled vectors before each row and behind the last."""
    out = [level(right)]
    for i in range(len(initials) - 1, -1, -1):
        out.append(step_back(initials[i], faults[i], out[-1])[0])
    out.reverse()
    return out


def left_vector(initials: str, faults: bytes, right: Vector) -> Vector:
    v = level(right)
    for i in range(len(initials) - 1, -1, -1):
        v = step_back(initials[i], faults[i], v)[0]
    return v


def fix_up(initials: str, faults: bytes, old: Vector, new: Vector, left: Vector) -> Vector:
    """The left vector for ``new`` at the right, knowing that ``old`` there gave ``left``."""
    old, new = level(old), level(new)
    for i in range(len(initials) - 1, -1, -1):
        if old == new:
            return left
        old, new = step_back(initials[i], faults[i], old)[0], step_back(initials[i], faults[i], new)[0]
    return new


def trace(initials: str, faults: bytes, vectors: list[Vector], state: int, last: bool) -> tuple[str, int]:
    """Least cheapest edits from ``state`` on, and the state they end in; ``last`` closes the conversation."""
    edits = []
    for i, initial in enumerate(initials):
        while True:
            cost, letter = _consume(initial, faults[i], vectors[i + 1], state)
            inserted, later = _insert(initial, faults[i], vectors[i + 1], state)
            if letter != "D" and inserted <= cost or inserted < cost:
                edits.append("I")
                state = later
                continue
            break
        edits.append(letter)
        state = STEP[state, initial] if letter == "K" else FORCED[state] if letter == "R" else state
    while last and END[state]:
        edits.append("I")
        state = FORCED[state]
    return "".join(edits), state


def _insert(initial: str, fault: int, behind: Vector, s: int) -> tuple[int, int]:
    """Cost of putting a turn in before a row, and the state after it."""
    one, two = FORCED[s], FORCED[FORCED[s]]
    return INSERT + min(_consume(initial, fault, behind, one)[0], INSERT + _consume(initial, fault, behind, two)[0]), one


# -- Spark jobs ------------------------------------------------------------------------

KEYS = ["g", "c1", "c2", "c3"]
CHUNK_DDL = "g string, c1 bigint, c2 bigint, c3 string"
SCAN_DDL = (
    f"{CHUNK_DDL}, initials string, faults binary, first string, last string, blank bigint, duplicate bigint, truncated bigint, illegal bigint"
)
VECTOR = "array<bigint>"


def _chunks(rows: DataFrame, span: int, chunk_rows: int) -> DataFrame:
    """Rows of each chunk in order, as a written table.

    A span of turn numbers is a chunk. A span with more than ``chunk_rows`` rows has equal rows
    counted first and is then cut by turn and by the leading digits of the digests.
    """
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    span_of = F.coalesce(F.floor(F.col("turn") / span).cast("bigint"), F.lit(NO_TURN))
    group = F.when(F.col("conv").isNull(), "n").otherwise(F.concat(F.lit("c"), F.col("conv").cast("string")))
    turn = F.coalesce(F.col("turn"), F.lit(NO_TURN))
    keyed = rows.select(group.alias("g"), span_of.alias("c1"), turn.alias("turn"), role.alias("role"), text.alias("text"))
    sizes = keyed.groupBy("g", "c1").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk_rows)
    crowded = cut(sizes)
    most = crowded.agg(F.max("n")).first()[0]
    keyed = keyed.withColumn("digest", turn_digest(F.col("role"), F.col("text")))
    plain = keyed.withColumns({"n": F.lit(1).cast("bigint"), "c2": F.lit(NO_TURN), "c3": F.lit("")})
    if most is not None:
        digits = 1
        while 16**digits * chunk_rows < most:
            digits += 1
        names = crowded.select("g", "c1")
        counted = keyed.join(names, ["g", "c1"], "left_semi").groupBy(*keyed.columns).agg(F.count(F.lit(1)).alias("n"))
        dense = counted.withColumns({"c2": F.col("turn"), "c3": F.substring("digest", 1, digits)})
        plain = plain.join(names, ["g", "c1"], "left_anti").unionByName(dense)
    row = F.struct("turn", "digest", "n", "role", "text")
    return cut(plain.groupBy(*KEYS).agg(F.sort_array(F.collect_list(row)).alias("rows")))


def _seen_before(chunks: DataFrame) -> DataFrame | None:
    """Digests of a chunk that an earlier chunk of its conversation has; None where each has one chunk."""
    several = cut(chunks.groupBy("g").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > 1).select("g"))
    if several.isEmpty():
        return None
    place = F.struct("c1", "c2", "c3").alias("place")
    inside = cut(chunks.join(several, "g", "left_semi").select("g", place, F.explode("rows.digest").alias("digest")).distinct())
    firsts = inside.groupBy("g", "digest").agg(F.min("place").alias("earliest"), F.count(F.lit(1)).alias("k")).where(F.col("k") > 1)
    again = inside.join(cut(firsts), ["g", "digest"]).where(F.col("place") > F.col("earliest"))
    return cut(again.groupBy("g", "place").agg(F.collect_list("digest").alias("seen")).select("g", "place.*", "seen"))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Initial and fault of every row of a chunk; a row that stands n times is followed by one more, a forced deletion."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            seen, counts, initials, faults = set(r["seen"] or ()), [0, 0, 0], [], bytearray()
            for row in r["rows"]:
                n, kind = row["n"], fault_of(row["text"])
                if kind == BLANK or row["digest"] in seen:
                    counts[0 if kind == BLANK else 1] += n
                    faults.append(DROP)
                else:
                    seen.add(row["digest"])
                    counts[1] += n - 1
                    counts[2] += kind == CUT_OFF
                    faults.append(CUT if kind == CUT_OFF else NONE)
                initials.append(row["role"][:1] or "\0")
            pairs = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])) + sum(row["n"] - 1 for row in r["rows"])
            out.append((*[r[k] for k in KEYS], "".join(initials), bytes(faults), initials[0], initials[-1], *counts, pairs))
        yield _batch(out, SCAN_DDL)


CUT_OFF = 3


def fault_of(text: str) -> int:
    """0, BLANK, or CUT_OFF for a text whose last visible character ends no sentence."""
    shown = text.rstrip(SPACES)
    return 0 if shown.endswith(ENDINGS) else CUT_OFF if shown else BLANK


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    fields = [f.split(" ") for f in ddl.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def _per_chunk(df: DataFrame, work, ddl: str) -> DataFrame:
    """``work`` over every row (a dict) of ``df``; it gives what follows the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([(*[r[k] for k in KEYS], *work(r)) for r in batch.to_pylist()], f"{CHUNK_DDL}, {ddl}")

    return df.mapInArrow(run, f"{CHUNK_DDL}, {ddl}")


def _settled(scanned: DataFrame) -> DataFrame:
    """``KEYS, right, left, k, last_chunk, before``: true vectors, up to a constant, on both sides of every chunk.

    A pass runs only the chunks whose neighbour's vector is news to them; where every
    conversation is one chunk there is none. A chunk forgets its guess within a few rows, so a
    second pass is rare; at worst there are as many as a conversation has chunks.
    """
    order = Window.partitionBy("g").orderBy("c1", "c2", "c3")
    placed = cut(
        scanned.select(
            *KEYS, F.row_number().over(order).alias("k"), F.lag("last").over(order).alias("before"),
            F.lead("first").over(order).isNull().alias("last_chunk"),
        )
    )
    work = scanned.select(*KEYS, "initials", "faults").join(placed, KEYS)

    def first_pass(r: dict) -> tuple:
        right = END if r["last_chunk"] else GUESS
        return list(right), list(left_vector(r["initials"], r["faults"], right))

    state = cut(_per_chunk(work, first_pass, f"right {VECTOR}, left {VECTOR}").join(placed, KEYS))

    def again(r: dict) -> tuple:
        return r["news"], list(fix_up(r["initials"], r["faults"], tuple(r["right"]), tuple(r["news"]), tuple(r["left"])))

    while True:
        news = F.lead("left").over(order)
        told = state.withColumn("news", news)
        stale = cut(told.where(F.col("news").isNotNull() & (F.col("news") != F.col("right"))))
        if stale.isEmpty():
            return state
        rerun = _per_chunk(scanned.select(*KEYS, "initials", "faults").join(stale.drop("k", "before", "last_chunk"), KEYS), again, f"right {VECTOR}, left {VECTOR}")
        rest = state.join(stale.select(*KEYS), KEYS, "left_anti")
        state = cut(rest.unionByName(rerun.join(placed, KEYS)))


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which each chunk is entered; chunks of a conversation arrive together and in order."""
    g, state = None, 0
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["g"] != g:
                g, state = r["g"], 0
            out.append((*[r[k] for k in KEYS], state))
            state = r["exits"][state]
        yield _batch(out, f"{CHUNK_DDL}, entry bigint")


EDIT = "array<struct<op string, n bigint, role string, text string>>"
EDIT_ARROW = pa.list_(pa.struct([("op", pa.string()), ("n", pa.int64()), ("role", pa.string()), ("text", pa.string())]))


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of every chunk, with their roles and texts, and what they cost."""
    for batch in batches:
        keys, edits, costs = [], [], []
        for r in batch.to_pylist():
            initials, faults = r["initials"], r["faults"]
            state, rows, at, cost, out = r["entry"], r["rows"], 0, 0, []
            letters, _ = trace(initials, faults, backward(initials, faults, tuple(r["right"])), state, r["last_chunk"])
            for op in letters:
                if op == "I":
                    state = FORCED[state]
                    out.append((op, 1, ROLE_OF[state], ""))
                    cost += INSERT
                    continue
                row = rows[at]
                if op == "D":
                    out.append((op, row["n"], row["role"], row["text"]))
                    cost += DELETE * row["n"]
                else:
                    role = row["role"]
                    state = STEP[state, initials[at]] if op == "K" else FORCED[state]
                    role = ROLE_OF[state] if op == "R" else role
                    out.append((op, 1, role, row["text"]))
                    cost += (REROLE if op == "R" else 0) + (TRUNCATED if faults[at] == CUT else 0)
                    if row["n"] > 1:
                        out.append(("D", row["n"] - 1, row["role"], row["text"]))
                        cost += DELETE * (row["n"] - 1)
                at += 1
            keys.append([r[k] for k in KEYS])
            edits.append([dict(zip(("op", "n", "role", "text"), e)) for e in out])
            costs.append(cost)
        names = list(zip(*keys)) or [()] * 4
        arrays = [pa.array(c, t) for c, t in zip(names, (pa.string(), pa.int64(), pa.int64(), pa.string()))]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(edits, EDIT_ARROW), pa.array(costs, pa.int64())], names=[*KEYS, "edits", "cost"])


def repair(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    span: int = SPAN, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Cheapest edits of every conversation, one row per chunk of it, as a written table.

    Columns: ``conv_key`` (text of the id behind "c", "n" for a null id), ``k`` (place of the
    chunk from 1 on), ``last_chunk``, ``edits`` (op K, R, D or I; n, how often a deletion repeats;
    role and text after the edit), ``cost``, and the counts ``blank, duplicate, truncated,
    illegal``. Rows are in order of the turn, null first, equal turns by digest; rows of a null id
    form one conversation; a null role or text counts as one space. Equal rows are all but one
    duplicates. An empty table gives no rows; other columns are not read.
    """
    small_batches(turns.sparkSession, 64)
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("bigint").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    chunks = _chunks(rows, span, chunk_rows)
    seen = _seen_before(chunks)
    with_seen = chunks.withColumn("seen", F.lit(None).cast("array<string>")) if seen is None else chunks.join(seen, KEYS, "left")
    scanned = cut(with_seen.mapInArrow(_scan, SCAN_DDL))
    state = _settled(scanned)

    def exits(r: dict) -> tuple:
        vectors = backward(r["initials"], r["faults"], tuple(r["right"]))
        return ([trace(r["initials"], r["faults"], vectors, s, r["last_chunk"])[1] for s in range(4)],)

    long = state.where((F.col("k") > 1) | ~F.col("last_chunk"))
    maps = _per_chunk(scanned.select(*KEYS, "initials", "faults").join(long, KEYS), exits, f"exits {VECTOR}")
    entries = maps.repartition("g").sortWithinPartitions(*KEYS).mapInArrow(_entries, f"{CHUNK_DDL}, entry bigint")
    known = state.join(cut(entries), KEYS, "left").withColumn("entry", F.coalesce("entry", F.lit(0)))
    joint = F.when(F.col("before").isNull() | F.concat("before", "first").isin("su", "ua", "au"), 0).otherwise(1)
    counts = ["blank", "duplicate", "truncated"]
    plan = cut(scanned.join(known, KEYS).select(*KEYS, "initials", "faults", "right", "entry", "k", "last_chunk", *counts, (F.col("illegal") + joint).alias("illegal")))
    jobs = chunks.join(plan.select(*KEYS, "initials", "faults", "right", "entry", "last_chunk"), KEYS)
    done = jobs.mapInArrow(_apply, f"{CHUNK_DDL}, edits {EDIT}, cost bigint")
    figures = plan.select(*KEYS, "k", "last_chunk", *counts, "illegal")
    return cut(done.join(figures, KEYS).select(F.col("g").alias("conv_key"), "k", "last_chunk", "edits", "cost", *counts, "illegal"))


def repaired_turns(repaired: DataFrame) -> DataFrame:
    """The turns after the repair: ``conv_key, k, place, role, text``; order by k and place."""
    kept = F.filter("edits", lambda e: e["op"] != "D")
    return repaired.select("conv_key", "k", F.posexplode(kept).alias("place", "e")).select("conv_key", "k", "place", "e.role", "e.text")


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and digest of conversations of several chunks, which arrive together and in order."""
    key, audit, state = None, [], hashlib.sha256()
    ddl = "conv_key string, audit string, repaired_sha256 string"
    begun = False
    for batch in batches:
        for r in batch.to_pylist():
            if r["conv_key"] != key:
                if key is not None:
                    yield _batch([(key, "".join(audit), state.hexdigest())], ddl)
                key, audit, state, begun = r["conv_key"], [], hashlib.sha256(), False
            audit.append(r["audit"])
            if r["lines"] is not None:
                state.update((("\n" if begun else "") + r["lines"]).encode())
                begun = True
    if key is not None:
        yield _batch([(key, "".join(audit), state.hexdigest())], ddl)


def report(turns: DataFrame, repaired: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation of ``ids`` (default: of ``turns``): gaps, faults, cost, audit, digest of the repaired rows.

    ``repaired`` is what :func:`repair` gave for ``turns``. Conversations without rows get zeros, an
    empty audit and the digest of nothing. Conversations of one chunk are digested in place, the
    chunks of others are streamed in order.
    """
    key = F.when(F.col(conv_col).isNull(), "n").otherwise(F.concat(F.lit("c"), F.col(conv_col).cast("string")))
    t = F.col(turn_col).cast("bigint")
    gaps = turns.groupBy(conv_col).agg(F.coalesce(F.max(t) - F.min(t) + 1 - F.count_distinct(t), F.lit(0)).alias("gaps"))
    kept = F.filter("edits", lambda e: e["op"] != "D")
    audit = F.array_join(F.transform("edits", lambda e: F.repeat(e["op"], e["n"].cast("int"))), "")
    lines = F.when(F.size(kept) > 0, F.array_join(F.transform(kept, lambda e: F.concat(e["role"], F.lit(":"), e["text"])), "\n"))
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    parts = repaired.select("conv_key", "k", "last_chunk", audit.alias("audit"), lines.alias("lines"), *counts)
    alone = (F.col("k") == 1) & F.col("last_chunk")
    sha = F.sha2(F.coalesce("lines", F.lit("")), 256)
    short = parts.where(alone).select("conv_key", *counts, "audit", sha.alias("repaired_sha256"))
    several = parts.where(~alone)
    folded = several.select("conv_key", "k", "audit", "lines").repartition("conv_key").sortWithinPartitions("conv_key", "k")
    folded = folded.mapInArrow(_fold, "conv_key string, audit string, repaired_sha256 string")
    sums = several.groupBy("conv_key").agg(*[F.sum(c).alias(c) for c in counts])
    results = short.unionByName(sums.join(folded, "conv_key"))
    all_ids = (turns if ids is None else ids).select(conv_col).distinct()
    own = all_ids.withColumn("conv_key", key).join(results, "conv_key", "left")
    found = gaps.select(F.col(conv_col).alias("__c"), "gaps")
    out = own.join(found, F.col(conv_col).eqNullSafe(F.col("__c")), "left")
    zeros = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("gaps", *counts)]
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(conv_col, *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
