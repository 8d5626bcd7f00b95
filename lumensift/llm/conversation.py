"""Repair of conversations: turns are aligned (Wagner and Fischer) to every feasible length of the alternating grammar, within Ukkonen's bands.

A conversation is legal if its roles' initials are ``(s?(ua)+)?``. The grammar allows any length, so an alignment is a path over rows whose
state is what the grammar expects next: O (nothing yet: s, u or the end), V (u, since an s stands alone so far), U (u or the end), A (a).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from lumensift.llm.common import cut

O, V, U, A = range(4)
#: What it costs to end in each state: an assistant is missing after A, user and assistant after V.
END = (0, 6, 0, 3)
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: Rows that one alignment table spans. Longer conversations are a chain of blocks, whose costs between states add up.
BLOCK = 512
_INF = 1 << 29
#: A row's code is its role (u, a, s, other) plus four times its fault (none, truncated, blank, duplicate).
_ROLE = {"u": 0, "a": 1, "s": 2}
_BLANKS = " \t\n\x0b\x0c\r"


class Alignment:
    """Alignments of one block of row codes with target strings of every length, for each state that the block can end in.

    A target that ends in state U reads ..uaua backwards, one that ends in A reads ..auau, so the tables of all lengths are columns of one table:
    cell (row, c) is the least cost of the rows from there on with c symbols still to come. A row of it is computed between Ukkonen's bounds:
    with c symbols for m rows that may stay, at least |c - m| edits are due, and a cell beyond the incumbent's cost is on no best path.
    """

    def __init__(self, codes: bytes):
        self.n = len(codes)
        self.role = [c & 3 for c in codes]
        self.late = [TRUNCATED if c >> 2 == 1 else 0 for c in codes]
        self.must_go = [c >> 2 >= 2 for c in codes]
        self._bounds()
        self.table = {U: self._fill(0), A: self._fill(1)}

    def _bounds(self) -> None:
        """Bounds on the symbols still to come, from the cost of an incumbent repair of the rows from each on: it keeps users and assistants,
        inserts a turn where two of them don't alternate, reroles others, and mends both ends for at most 12."""
        n = self.n
        self.lo, self.hi = [0] * (n + 1), [0] * (n + 1)
        stay = odd = cut_off = between = 0
        after = None
        for i in range(n - 1, -1, -1):
            if not self.must_go[i]:
                stay += 1
                cut_off += self.late[i] > 0
                if self.role[i] > 1:
                    odd += 1
                    between += 1
                else:
                    odd += after is not None and (self.role[i] == after) != (between % 2 == 1)
                    after, between = self.role[i], 0
            slack = 3 * odd + 12
            self.hi[i] = stay + slack // INSERT
            self.lo[i] = max(0, stay - (slack if slack <= cut_off else cut_off + (slack - cut_off) // DELETE))

    def _fill(self, first: int) -> np.ndarray:
        """``first`` is the parity of c at which a user is due."""
        width = max(self.hi) + 1
        t = np.full((self.n + 1, width), _INF, np.int32)
        t[self.n, 0] = 0
        c = np.arange(width, dtype=np.int32)
        wrong = {0: np.where(c % 2 == first, 0, REROLE), 1: np.where(c % 2 == first, REROLE, 0)}
        for i in range(self.n - 1, -1, -1):
            a, b = self.lo[i], self.hi[i] + 1
            best = t[i + 1, a:b] + DELETE
            if not self.must_go[i]:
                k = max(a, 1)
                swap = wrong[self.role[i]][k:b] if self.role[i] < 2 else REROLE
                np.minimum(best[k - a:], t[i + 1, k - 1:b - 1] + swap + self.late[i], out=best[k - a:])
            steps = INSERT * c[a:b]
            t[i, a:b] = np.minimum(np.minimum.accumulate(best - steps) + steps, _INF)
        return t

    def _starts(self, entry: int) -> Iterator[tuple[int, int, int, int, bytes]]:
        """Every way to use the block from ``entry``: cost, last state, row and symbols from which the table decides, edits before that row."""
        def tables(i: int, spent: int, before: bytes, opened: bool, user_due: bool):
            for last, parity in ((U, 0), (A, 1)):
                for c in range(parity if user_due else 1 - parity, self.table[last].shape[1], 2):
                    if (c or not opened) and self.table[last][i, c] < _INF:
                        yield spent + int(self.table[last][i, c]), last, i, c, before
        yield from tables(0, 0, b"", entry in (O, V), entry != A)
        if entry in (O, V):
            yield DELETE * self.n, entry, self.n, 0, b"D" * self.n
        if entry == O:
            for k in range(self.n):
                if self.role[k] == 2 and not self.must_go[k]:
                    spent, before = DELETE * k + self.late[k], b"D" * k + b"K"
                    yield from tables(k + 1, spent, before, True, True)
                    rest = self.n - k - 1
                    yield spent + DELETE * rest, V, self.n, 0, before + b"D" * rest

    def costs(self) -> list[list[int]]:
        """The least cost from each state at the block's start to each at its end."""
        out = [[_INF] * 4 for _ in range(4)]
        for entry in range(4):
            for cost, last, *_ in self._starts(entry):
                out[entry][last] = min(out[entry][last], cost)
        return out

    def repair(self, entry: int, after: tuple[int, ...] = END) -> tuple[int, bytes, int]:
        """Least cost to the conversation's end (``after`` holds what is due after each last state), the edits here, the last state. Of the
        cheapest ways, the audits of all lengths are traced and compared; the least is taken."""
        ways = [(cost + after[last], last, i, c, before) for cost, last, i, c, before in self._starts(entry)]
        least = min(w[0] for w in ways)
        audit, last = min((before + self._trace(last, i, c), last) for total, last, i, c, before in ways if total == least)
        return least, audit, last

    def _trace(self, last: int, i: int, c: int) -> bytes:
        t, user_due, out = self.table.get(last), last == A, bytearray()
        while i < self.n:
            here = t[i, c]
            if t[i + 1, c] + DELETE == here:
                out += b"D"
                i += 1
            elif c and t[i, c - 1] + INSERT == here:
                out += b"I"
                c -= 1
            else:
                due = 0 if c % 2 == int(user_due) else 1
                out += b"K" if self.role[i] == due else b"R"
                i, c = i + 1, c - 1
        return bytes(out)


class Memo:
    """Remembers what was computed for short blocks, which are often alike; a bounded number of them."""

    def __init__(self, fn: Callable, size: int = 50_000):
        self.fn, self.size, self.known = fn, size, {}

    def __call__(self, codes: bytes):
        if len(codes) > 16:
            return self.fn(codes)
        if codes not in self.known:
            if len(self.known) >= self.size:
                self.known.clear()
            self.known[codes] = self.fn(codes)
        return self.known[codes]


def turn_rows(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with nulls in role and text as one space, the text's digest, and whether it is blank or truncated."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    d = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), one("role"), one("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    end = F.right(F.rtrim(F.col("text"), F.lit(_BLANKS)), F.lit(1))
    return d.withColumn("blank", end == "").withColumn("truncated", ~end.isin("", ".", "!", "?"))


def _blocks(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, conv, open_ = TaskContext.get().partitionId(), 0, None, False
        codes, turns, kind, out = bytearray(), [], None, []

        def close() -> None:
            nonlocal seq, open_
            known = [t for t in turns if t is not None]
            faults = [c >> 2 for c in codes]
            illegal = sum((x & 3, y & 3) not in ((2, 0), (0, 1), (1, 0)) for x, y in zip(codes, codes[1:]))
            out.append((conv, part, seq, turns[0], turns[-1], known[0] if known else None, len(set(known)), faults.count(2), faults.count(3), faults.count(1),
                        illegal, codes[0] & 3, codes[-1] & 3, bytes(codes)))
            seq, open_ = seq + 1, False
            codes.clear()
            turns.clear()

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [kind] + [pa.int64()] * 12 + [pa.binary()])], names=BLOCK_COLUMNS)

        for b in batches:
            kind = b.schema.field("conv_id").type
            for cid, turn, role, blank, late, first, n in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "blank", "truncated", "first", "n"))):
                if open_ and cid != conv:
                    close()
                who = _ROLE.get(role[:1], 3)
                for k in range(n):
                    if len(codes) == size:
                        close()
                    conv, open_ = cid, True
                    codes.append(who + 4 * (2 if blank else 3 if k or not first else 1 if late else 0))
                    turns.append(turn)
                    if len(out) >= 1000:
                        yield batch_of(out)
                        out.clear()
        if open_:
            close()
        if out:
            yield batch_of(out)
    return run


BLOCK_COLUMNS = ["conv_id", "part", "seq", "first_turn", "last_turn", "known_turn", "n_turns", "blank", "duplicate", "truncated", "illegal", "first_role", "last_role", "codes"]


def _singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    solve = Memo(lambda codes: Alignment(codes).repair(O))
    for b in batches:
        got = [solve(c) for c in b.column("codes").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv_id", "part", "seq")), pa.array([g[0] for g in got], pa.int64()),
                                          pa.array([(g[1] + b"I" * (END[g[2]] // INSERT)).decode() for g in got], pa.string())], names=["conv_id", "part", "seq", "cost", "piece"])


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    solve = Memo(lambda codes: sum(Alignment(codes).costs(), []))
    for b in batches:
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv_id", "part", "seq")), pa.array([solve(c) for c in b.column("codes").to_pylist()], pa.list_(pa.int64()))],
                                         names=["conv_id", "part", "seq", "costs"])


def _per_conversation(batches: Iterator[pa.RecordBatch], names: list[str], step: Callable[[list[tuple]], Iterator[tuple]], kinds: list, out: list[str]) -> Iterator[pa.RecordBatch]:
    """``step`` over the rows of each conversation, which come in order; a conversation has one row for each of its blocks."""
    held, conv, kind = [], None, None

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*step(held)), [kind, *kinds])], names=out)

    for b in batches:
        kind = b.schema.field("conv_id").type
        for row in zip(*(b.column(c).to_pylist() for c in names)):
            if held and row[0] != conv:
                yield flush()
                held = []
            conv = row[0]
            held.append(row)
    if held:
        yield flush()


def _backward(rows: list[tuple]) -> list[tuple]:
    """What is due after each block, by its last state, from the end of the conversation on."""
    after, out = list(END), []
    for conv, part, seq, costs in reversed(rows):
        out.append((conv, part, seq, after))
        after = [min(_INF, min(costs[4 * e + x] + after[x] for x in range(4))) for e in range(4)]
    return out


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = []
        for codes, after in zip(b.column("codes").to_pylist(), b.column("after").to_pylist()):
            a = Alignment(codes)
            got.append([a.repair(e, tuple(after)) for e in range(4)])
        yield pa.RecordBatch.from_arrays([
            *(b.column(c) for c in ("conv_id", "part", "seq")), pa.array([[w[0] for w in g] for g in got], pa.list_(pa.int64())),
            pa.array([[w[1].decode() for w in g] for g in got], pa.list_(pa.string())), pa.array([[w[2] for w in g] for g in got], pa.list_(pa.int64())),
        ], names=["conv_id", "part", "seq", "costs", "pieces", "states"])


def _forward(rows: list[tuple]) -> Iterator[tuple]:
    """From the start on: the edits of each block from the state in which the one before ends."""
    state = O
    for k, (conv, part, seq, costs, pieces, states) in enumerate(rows):
        cost, piece, state = costs[state] if k == 0 else 0, pieces[state], states[state]
        yield conv, part, seq, cost, piece + "I" * (END[state] // INSERT if k == len(rows) - 1 else 0)


def audits(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost (bigint), audit for each conversation that has rows.

    ``turns`` has conv_id, turn, role, text; nulls in role or text are one space. Rows are taken by turn (nulls first), then role, then text's
    digest; a null conv_id is a conversation of its own. A row's first fault of blank, duplicate (role and text seen earlier) and truncated
    counts. Equal rows (also of equal turn) are duplicates of the first. Empty tables give no rows; further columns play no part.

    Rows are counted once for each (conversation, turn, role, digest), ranges of that order go to tasks whatever conversation they belong to, and each
    task cuts its rows into blocks of at most ``block``. A conversation in one block is aligned at once. For others, blocks give their costs
    between states; what is due after each block follows backwards, the edits for each state before it are traced per block, and a pass
    forwards takes the right ones. So a conversation of any length is many tasks' work, with one row per block where it comes together.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    keys = ["conv_id", "role", "digest"]
    light = turn_rows(turns).groupBy(*keys, "turn", "blank", "truncated").agg(F.count(F.lit(1)).alias("n"))
    light = cut(light)
    seen = light.groupBy(*keys).agg(F.min(F.struct("turn")).alias("_first"), F.count(F.lit(1)).alias("_turns")).where("_turns > 1")
    seen = seen.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_first.turn").alias("_turn"), F.lit(True).alias("_again"))
    same = F.col("role").eqNullSafe(F.col("_role")) & F.col("digest").eqNullSafe(F.col("_digest")) & F.col("conv_id").eqNullSafe(F.col("_conv_id"))
    first = F.col("_again").isNull() | F.col("turn").eqNullSafe(F.col("_turn"))
    rows = cut(light.join(seen, same, "left").select("conv_id", "turn", "role", "digest", "blank", "truncated", first.alias("first"), "n"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    b = cut(ranged.mapInArrow(_blocks(block), f"conv_id {kind}, " + ", ".join(f"{c} bigint" for c in BLOCK_COLUMNS[1:-1]) + ", codes binary"))

    at = W.partitionBy("conv_id").orderBy("part", "seq")
    b2 = b.drop("codes").withColumn("_turn", F.lag("last_turn").over(at)).withColumn("_role", F.lag("last_role").over(at))
    pair = F.concat_ws("", "_role", "first_role")
    stats = b2.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.coalesce(F.max("last_turn") - F.min("known_turn") + 1 - (F.sum("n_turns") - F.count(F.when(F.col("_turn") == F.col("first_turn"), 1))), F.lit(0)).cast("bigint").alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
        (F.sum("illegal") + F.count(F.when(F.col("_role").isNotNull() & ~pair.isin("20", "01", "10"), 1))).alias("illegal"))
    stats = cut(stats)
    several = stats.where("n_blocks > 1").select(F.col("conv_id").alias("_conv"))
    is_long = F.col("conv_id").eqNullSafe(F.col("_conv"))
    piece_kind = f"conv_id {kind}, part bigint, seq bigint, cost bigint, piece string"
    short = b.join(several, is_long, "left_anti").select("conv_id", "part", "seq", "codes").mapInArrow(_singles, piece_kind)

    long_ = cut(b.join(several, is_long, "left_semi").select("conv_id", "part", "seq", "codes"))
    in_order = lambda d: d.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    costs = in_order(long_.mapInArrow(_matrices, f"conv_id {kind}, part bigint, seq bigint, costs array<bigint>"))
    due = costs.mapInArrow(lambda x: _per_conversation(x, ["conv_id", "part", "seq", "costs"], _backward, [pa.int64(), pa.int64(), pa.list_(pa.int64())], ["conv_id", "part", "seq", "after"]),
                           f"conv_id {kind}, part bigint, seq bigint, after array<bigint>")
    ways = long_.join(due.drop("conv_id"), ["part", "seq"]).select("conv_id", "part", "seq", "codes", "after")
    ways = in_order(ways.mapInArrow(_ways, f"conv_id {kind}, part bigint, seq bigint, costs array<bigint>, pieces array<string>, states array<bigint>"))
    long_pieces = ways.mapInArrow(lambda x: _per_conversation(x, ["conv_id", "part", "seq", "costs", "pieces", "states"], _forward, [pa.int64(), pa.int64(), pa.int64(), pa.string()], ["conv_id", "part", "seq", "cost", "piece"]),
                                  piece_kind)
    # the audit itself is one value of the result, a letter for each edit
    joined = long_pieces.groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("part", "seq", "piece"))), lambda x: x["piece"])).alias("audit"))
    every = short.select("conv_id", "cost", F.col("piece").alias("audit")).unionByName(joined)
    every = every.withColumnRenamed("conv_id", "_conv")
    return stats.join(every, is_long).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


RESULTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _edited(turns: DataFrame, found: DataFrame) -> DataFrame:
    """For every conversation of ``found`` its audit, then its rows in order, in one task's stream."""
    rows = turn_rows(turns).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", "text", *[F.lit(None).cast("bigint").alias(c) for c in RESULTS], F.lit(None).cast("string").alias("audit"))
    head = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("digest"),
                        F.lit(None).cast("string").alias("text"), *RESULTS, "audit")
    return head.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "digest")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Events of the stream: ("open", head), then ("turn", edit, turn, role, text) for each repaired turn, then ("close", head)."""
    head = None

    def inserts(stop: bool):
        nonlocal at, place
        while at < len(audit) and audit[at] == "I":
            yield "turn", "I", None, due(), ""
            at, place = at + 1, place + 1
        if stop:
            yield "close", head

    def due() -> str:
        return ("assistant", "user")[(place + even) % 2]

    for b in batches:
        for kind, conv, turn, role, text, audit_, *results in zip(*(b.column(c).to_pylist() for c in ("kind", "conv_id", "turn", "role", "text", "audit", *RESULTS))):
            if kind == 0:
                if head is not None:
                    yield from inserts(True)
                head, audit, at, place = (conv, audit_, results), audit_, 0, 0
                even = 1 - (len(audit) - audit.count("D")) % 2
                yield "open", head
                continue
            yield from inserts(False)
            edit, at = audit[at], at + 1
            if edit != "D":
                yield "turn", edit, turn, role if edit == "K" else due(), text
                place += 1
    if head is not None:
        yield from inserts(True)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = None

    def seen():
        nonlocal kind
        for b in batches:
            kind = b.schema.field("conv_id").type
            yield b

    out, conv, place = [], None, 0
    make = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()])], names=["conv_id", "place", "edit", "turn", "role", "text"])
    for event, *what in _walk(seen()):
        if event == "open":
            conv, place = what[0][0], 0
        elif event == "turn":
            out.append((conv, place, *what))
            place += 1
            if len(out) >= 500:
                yield make()
                out = []
    if out:
        yield make()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = None

    def seen():
        nonlocal kind
        for b in batches:
            kind = b.schema.field("conv_id").type
            yield b

    out = []
    make = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [kind] + [pa.int64()] * len(RESULTS) + [pa.string()] * 2)], names=["conv_id", *RESULTS, "audit", "repaired_sha256"])
    for event, *what in _walk(seen()):
        if event == "open":
            sha, first = hashlib.sha256(), True
        elif event == "turn":
            sha.update((("" if first else "\n") + f"{what[2]}:{what[3]}").encode())
            first = False
        else:
            conv, audit, results = what[0]
            out.append((conv, *results, audit, sha.hexdigest()))
            if len(out) >= 1000:
                yield make()
                out = []
    if out:
        yield make()


def repaired(turns: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """conv_id, place (from 0), edit (K, R, I), turn, role, text: the repaired conversations; ``found`` are their audits."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    return _edited(turns, audits(turns) if found is None else found).mapInArrow(_turns, f"conv_id {kind}, place bigint, edit string, turn bigint, role string, text string")


def report(turns: DataFrame, every: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, the counts, cost, audit and repaired_sha256 for each conv_id of ``every``; one without turns has zeros, no audit and the hash of nothing.

    The hash is over all turns of a repaired conversation in order, so one task streams them; it holds one turn and the audit.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    ids = every.select(F.col("conv_id").alias("_conv")).distinct()
    found = audits(turns, block)
    all_ = ids.join(found, F.col("_conv").eqNullSafe(F.col("conv_id")), "left")
    all_ = all_.select(F.col("_conv").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in RESULTS], F.coalesce("audit", F.lit("")).alias("audit"))
    return _edited(turns, all_).mapInArrow(_digests, f"conv_id {kind}, " + ", ".join(f"{c} bigint" for c in RESULTS) + ", audit string, repaired_sha256 string")


def damage(turns: DataFrame) -> DataFrame:
    """Turns with faults planted by a checksum of ``conv_id:turn`` (nulls: one space): of 20 remainders, 0 drops a row, 1 empties its text, 2 removes
    its full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's. Other nulls become one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20).alias("_kind")).where("_kind <> 0")
    spoilt = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    d = d.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), spoilt.alias("text"), F.explode(F.array_repeat(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1))).alias("_copy"))
    return d.drop("_copy")
