"""Repair of chats with the assistant: cheapest edits that make the roles of a chat alternate, by a grammar-compressed dynamic program.

A chat becomes a string of role and fault symbols.  Re-Pair replaces frequent pairs of symbols by new ones; each symbol has one min-plus
matrix from state to state whose entries carry a cost and a rope of edits, computed once from the matrices of its pair and shared by all
chats in which it occurs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from mesograph.llm.common import discard, stored
from mesograph.session import shuffle_width

# Rows of a chat in one symbol string; longer chats are strings in a row.
PIECE = 4096
# Characters of a content that order rows of one turn and role; texts alike in these are ordered by hash.
HEAD = 128
# Strings whose grammar is made together.
STRINGS_TOGETHER = 2000
NOT_BLANK = r"[^\x20\x09-\x0D]"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
# States: nothing yet, after system, after user, after assistant.  A chat may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES, ENDS = 4, (START, ASSISTANT)
STEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
# One letter per edit and new role, in the order of the audit's letters D, I, K, R.
OPS = {"delete": "D", ("insert", USER): "G", ("insert", ASSISTANT): "H", "keep": "K", ("rerole", USER): "R", ("rerole", ASSISTANT): "S"}
AUDIT_FROM, AUDIT_TO = "DGHKRS", "DIIKRR"
# A row's symbol: role initial (other than s, u, a: o), in capitals if truncated; b blank, d duplicate, followed by nothing.
SYMBOLS = "suaoSUAOD"


class Rope:
    """A string put together from two; equal parts are shared and never copied."""

    __slots__ = ("left", "right", "size")

    def __init__(self, left, right):
        self.left, self.right, self.size = left, right, len(left) + len(right)

    def __len__(self) -> int:
        return self.size

    def leaves(self) -> Iterator[str]:
        stack = [self]
        while stack:
            top = stack.pop()
            if isinstance(top, Rope):
                stack += (top.right, top.left)
            elif top:
                yield top


LEAF = 64


def join_ropes(a, b):
    """The string a + b: short ones as text, long ones as a rope."""
    if not len(a):
        return b
    if not len(b):
        return a
    return str(a) + str(b) if len(a) + len(b) <= LEAF and isinstance(a, str) and isinstance(b, str) else Rope(a, b)


def rope_text(rope) -> str:
    return rope if isinstance(rope, str) else "".join(rope.leaves())


def rope_less(a, b) -> bool:
    """a < b; subtrees that both share at the same place are skipped."""
    left, right = [a], [b]
    while left and right:
        x, y = left.pop(), right.pop()
        if x is y:
            continue
        if isinstance(x, Rope) and (not isinstance(y, Rope) or len(x) >= len(y)):
            left += (x.right, x.left)
            right.append(y)
        elif isinstance(y, Rope):
            right += (y.right, y.left)
            left.append(x)
        else:
            n = min(len(x), len(y))
            if x[:n] != y[:n]:
                return x[:n] < y[:n]
            if len(x) > n:
                left.append(x[n:])
            if len(y) > n:
                right.append(y[n:])
    return not left and bool(right)


# A matrix is {(from, to): (cost, rope)}, without the pairs that no edits reach.
Matrix = dict


def better(old, cost: int, left, right):
    """The cheaper of an entry and a new one whose rope is left + right; of equally cheap ones the least."""
    if old is not None and old[0] < cost:
        return old
    rope = join_ropes(left, right)
    return (cost, rope) if old is None or cost < old[0] or rope_less(rope, old[1]) else old


def product(a: Matrix, b: Matrix) -> Matrix:
    """Edits of a, then of b.  Equally cheap edits of the same rows never are prefixes of each other, so the least ropes make the least rope."""
    out: Matrix = {}
    for (i, k), (cost, rope) in a.items():
        for j in range(STATES):
            step = b.get((k, j))
            if step is not None:
                out[i, j] = better(out.get((i, j)), cost + step[0], rope, step[1])
    return out


def insertions() -> Matrix:
    """Any number of inserted rows; more than two never help."""
    one = {}
    for state in range(STATES):
        for role, letter in (("u", ("insert", USER)), ("a", ("insert", ASSISTANT))):
            if state in STEPS[role]:
                one[state, STEPS[role][state]] = (INSERT, OPS[letter])
    out = {(s, s): (0, "") for s in range(STATES)}
    for power in (one, product(one, one)):
        for (i, j), (cost, rope) in power.items():
            out[i, j] = better(out.get((i, j)), cost, rope, "")
    return out


INSERTED = insertions()


def row_matrix(symbol: str) -> Matrix:
    """Insertions before a row, then the row kept, given a role or deleted."""
    out = {(s, s): (DELETE, OPS["delete"]) for s in range(STATES)}
    if symbol != "D":
        extra = TRUNCATED if symbol.isupper() else 0
        for state, after in STEPS.get(symbol.lower(), {}).items():
            out[state, after] = better(out.get((state, after)), KEEP + extra, OPS["keep"], "")
        for role, target in (("u", USER), ("a", ASSISTANT)):
            for state, after in STEPS[role].items():
                out[state, after] = better(out.get((state, after)), REROLE + extra, OPS["rerole", target], "")
    return product(INSERTED, out)


ROWS = [row_matrix(s) for s in SYMBOLS]


def repair_pairs(strings: Sequence[str]) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Re-Pair over some symbol strings: rules (left, right) for symbols from len(SYMBOLS) on, and the strings in the symbols left.

    The most frequent pair of neighbours (of equally frequent ones the lowest) becomes a new symbol, until no pair occurs twice.
    """
    codes = np.full(256, -1, np.int64)
    codes[np.frombuffer(SYMBOLS.encode(), np.uint8)] = np.arange(len(SYMBOLS))
    parts = []
    for s in strings:
        parts += (codes[np.frombuffer(s.encode("ascii"), np.uint8)], np.array([-1]))
    seq = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    rules: list[tuple[int, int]] = []
    while len(seq) > 1:
        left, right = seq[:-1], seq[1:]
        keys = np.where((left >= 0) & (right >= 0), left << 32 | right, -1)
        # Inside a run of one symbol every second pair counts.
        same = (left == right) & (left >= 0)
        if same.any():
            at = np.flatnonzero(same)
            run = np.cumsum(np.r_[True, np.diff(at) > 1]) - 1
            first = at[np.r_[True, np.diff(at) > 1]]
            keys[at[(at - first[run]) % 2 == 1]] = -1
        found, counts = np.unique(keys[keys >= 0], return_counts=True)
        if not len(found) or counts.max() < 2:
            break
        pair = found[counts.argmax()]
        symbol = len(SYMBOLS) + len(rules)
        rules.append((int(pair >> 32), int(pair & 0xFFFFFFFF)))
        at = np.flatnonzero(keys == pair)
        seq[at] = symbol
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
    ends = np.flatnonzero(seq < 0)
    return rules, [seq[a:b].tolist() for a, b in zip(np.r_[0, ends[:-1] + 1], ends)] if len(ends) else []


def string_matrices(strings: Sequence[str]) -> list[Matrix]:
    """The matrix of each symbol string: one per rule of their common grammar, bottom up, then along what is left of each string."""
    rules, rest = repair_pairs(strings)
    table = list(ROWS)
    for left, right in rules:
        table.append(product(table[left], table[right]))
    out = []
    for symbols in rest:
        now = table[symbols[0]] if symbols else {(s, s): (0, "") for s in range(STATES)}
        for symbol in symbols[1:]:
            now = product(now, table[symbol])
        out.append(now)
    return out


@dataclass
class Path:
    """The best edits of a chat's pieces up to one state: the last piece's ops behind those of the path before."""

    before: Path | None
    piece: int
    ops: object
    cost: int


def _path_less(a: Path, b: Path) -> bool:
    """Whether the ops of a are less than those of b, both over the same pieces: compared from their last common path on."""
    left, right = [], []
    while a is not b:
        left.append(a.ops)
        right.append(b.ops)
        a, b = a.before, b.before
    x = y = ""
    for ops in reversed(left):
        x = join_ropes(x, ops)
    for ops in reversed(right):
        y = join_ropes(y, ops)
    return rope_less(x, y)


class Fold:
    """The pieces of one chat in order, as a running best path per state.

    As soon as all states share a path, its pieces are final and are given out, so little of a long chat is held.
    """

    def __init__(self):
        self.root = Path(None, -1, "", 0)
        self.paths = {START: self.root}
        self.last = None
        self.pieces = 0

    def add(self, matrix: Matrix, roles: tuple[str, str]) -> Iterator[tuple[int, str, int, int]]:
        """One more piece; gives (piece, ops, cost, bad neighbours at its start) of the pieces that became final."""
        self.bad = getattr(self, "bad", {})
        self.bad[self.pieces] = int(self.last is not None and self.last + roles[0] not in ("su", "ua", "au"))
        self.last = roles[1]
        self._step(matrix, self.pieces)
        self.pieces += 1
        yield from self._settled()

    def _step(self, matrix: Matrix, piece: int) -> None:
        paths: dict[int, Path] = {}
        for state, path in self.paths.items():
            for after in range(STATES):
                step = matrix.get((state, after))
                if step is None:
                    continue
                new = Path(path, piece, step[1], path.cost + step[0])
                old = paths.get(after)
                if old is None or new.cost < old.cost or new.cost == old.cost and _path_less(new, old):
                    paths[after] = new
        self.paths = paths

    def _settled(self) -> Iterator[tuple[int, str, int, int]]:
        """Pieces that all paths agree on, other than the last."""
        shared = list(self.paths.values())
        fronts = {id(p.before): p.before for p in shared}
        while len(fronts) > 1:
            fronts = {id(p.before): p.before for p in fronts.values() if p.before is not None}
        if fronts:
            yield from self._give(next(iter(fronts.values())))

    def _give(self, path: Path) -> Iterator[tuple[int, str, int, int]]:
        chain = []
        while path is not None and path is not self.root:
            chain.append(path)
            path = path.before
        for p in reversed(chain):
            yield p.piece, rope_text(p.ops), p.cost - p.before.cost, self.bad.pop(p.piece)
        if chain:
            self.root = chain[0]
            self.root.before, self.root.ops = None, ""

    def end(self) -> Iterator[tuple[int, str, int, int]]:
        """The pieces that were open, after insertions at the end of the chat; those belong to the last piece."""
        best = None
        for state, path in self.paths.items():
            for after in ENDS:
                step = INSERTED.get((state, after))
                if step is not None:
                    new = Path(path.before, path.piece, join_ropes(path.ops, step[1]), path.cost + step[0])
                    if best is None or new.cost < best.cost or new.cost == best.cost and _path_less(new, best):
                        best = new
        yield from self._give(best)


STEPS_SCHEMA = StructType([StructField("string", StringType()), StructField("entries", StringType())])


def _packed(matrix: Matrix) -> str:
    return ";".join(f"{i}{j},{cost},{rope_text(rope)}" for (i, j), (cost, rope) in sorted(matrix.items()))


def _unpacked(text: str) -> Matrix:
    out = {}
    for part in text.split(";"):
        if part:
            states, cost, ops = part.split(",")
            out[int(states[0]), int(states[1])] = (int(cost), ops)
    return out


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, STRINGS_TOGETHER):
            strings = batch.column(0).slice(first, STRINGS_TOGETHER)
            yield pa.RecordBatch.from_arrays([strings, pa.array([_packed(m) for m in string_matrices(strings.to_pylist())], pa.string())], ["string", "entries"])


def ordered_rows(messages: DataFrame, chat_id: str, turn: str, role: str, content: str) -> DataFrame:
    """Rows with their place: `part` (range of all rows in the order of chat, turn with nulls first, role, content) and `slot` inside it.

    Rows are dealt to ranges of that order; equal rows are told apart by a number, so that no chat, turn or text is too large to be split.
    Range bounds are drawn from a sample of the sorting columns, so contents take part by their first characters and a hash.
    """
    spark = messages.sparkSession
    rows = messages.select(F.col(chat_id).alias("chat"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                           F.coalesce(F.col(content).cast("string"), F.lit("")).alias("content"))
    rows = rows.withColumns({"head": F.substring("content", 1, HEAD), "tie": F.xxhash64("content"), "copy": F.monotonically_increasing_id()})
    order = ["chat", F.asc_nulls_first("turn"), "role", "head", "tie", "copy"]
    placed = rows.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order).drop("head", "tie", "copy")
    schema = StructType([*placed.schema.fields, StructField("part", LongType()), StructField("slot", LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, slot = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int64)), pa.array(np.arange(slot, slot + n))], [*batch.schema.names, "part", "slot"])
            slot += n

    return placed.mapInArrow(number, schema)


def told_rows(rows: DataFrame) -> DataFrame:
    """Rows of `ordered_rows` without their texts, with their first fault: blank, duplicate (same role and text earlier in the chat), truncated or none."""
    blank = ~F.col("content").rlike(NOT_BLANK)
    truncated = ~F.col("content").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    light = rows.select("chat", "turn", "part", "slot", F.substring("role", 1, 1).alias("initial"), F.sha2(F.concat(F.col("role"), F.lit("\0"), F.col("content")), 256).alias("same"),
                        blank.alias("blank"), truncated.alias("truncated"))
    first = light.where(~F.col("blank")).groupBy("chat", "same").agg(F.min(F.struct("part", "slot")).alias("at")).select("at.part", "at.slot", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("truncated"), "truncated")
    return light.join(first, ["part", "slot"], "left").select("chat", "turn", "part", "slot", "initial", fault.alias("fault"))


def chat_edits(told: DataFrame, chat_type) -> DataFrame:
    """Cheapest edits of each piece of each chat: chat, part, piece, first (slot), ops (one letter per edit and new role), cost, bad (neighbours that do not follow each other)."""
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "D").when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    pieces = (told.select("chat", "part", "slot", F.floor(F.col("slot") / PIECE).alias("piece"), known.alias("initial"), symbol.alias("symbol"))
              .groupBy("chat", "part", "piece").agg(F.array_sort(F.collect_list(F.struct("slot", "initial", "symbol"))).alias("rows"))
              .select("chat", "part", "piece", F.col("rows")[0]["slot"].alias("first"), F.array_join("rows.symbol", "").alias("string"), F.array_join("rows.initial", "").alias("roles")))
    ill = F.expr("size(filter(sequence(1, length(roles)), i -> i < length(roles) AND substring(roles, i, 2) NOT IN ('su', 'ua', 'au')))")
    pieces = pieces.select("chat", "part", "piece", "first", "string", F.substring("roles", 1, 1).alias("head"), F.substring("roles", -1, 1).alias("tail"), ill.cast("long").alias("inner"))
    solved = pieces.select("string").distinct().mapInArrow(_matrices, STEPS_SCHEMA)
    joined = pieces.join(solved, "string").drop("string")
    schema = StructType([StructField("chat", chat_type), *[StructField(n, LongType()) for n in ("part", "piece", "first")], StructField("ops", StringType()),
                         StructField("cost", LongType()), StructField("bad", LongType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chat, open_rows = None, None, {}

        def finished(found: Iterator[tuple[int, str, int, int]]) -> Iterator[tuple]:
            for piece, ops, cost, bad in found:
                part, number, first, inner = open_rows.pop(piece)
                yield chat, part, number, first, ops, cost, bad + inner

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [kind, *[pa.int64()] * 3, pa.string(), pa.int64(), pa.int64()])], schema.names)

        kind = pa.null()
        for batch in batches:
            kind, out = batch.column(0).type, []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or row[0] != chat:
                    if now is not None:
                        out += finished(now.end())
                    now, chat, open_rows = Fold(), row[0], {}
                open_rows[now.pieces] = (row[1], row[2], row[3], row[6])
                out += finished(now.add(_unpacked(row[7]), (row[4], row[5])))
            if out:
                yield table(out)
        if now is not None:
            yield table(list(finished(now.end())))

    columns = ["chat", "part", "piece", "first", "head", "tail", "inner", "entries"]
    return joined.select(columns).repartition(shuffle_width(told.sparkSession), "chat").sortWithinPartitions("chat", "part", "piece").mapInArrow(fold, schema)


@dataclass
class Repair:
    """Tables of a repair, kept in the shared folder: `rows` (chat, turn, role, content, part, slot), `told` (with initial and fault) and `edits` per piece."""

    rows: DataFrame
    told: DataFrame
    edits: DataFrame
    work: list[str]

    def messages(self) -> DataFrame:
        """Repaired messages (chat, part, slot, at, role, content): `at` counts those made from one row, inserted ones before it.  Deleted rows are gone."""
        pieces = self.edits.select("part", "first", F.expr(r"regexp_extract_all(ops, '[GH]*[DKRS](?:[GH]*$)?', 0)").alias("per_row"))
        per_row = pieces.select("part", F.col("first"), F.posexplode("per_row").alias("offset", "ops")).select("part", (F.col("first") + F.col("offset")).alias("slot"), "ops")
        letters = self.rows.join(per_row, ["part", "slot"]).select("chat", "part", "slot", "role", "content", F.posexplode(F.split("ops", "")).alias("at", "op")).where("op <> 'D' AND op <> ''")
        role = F.when(F.col("op").isin("G", "R"), "user").when(F.col("op").isin("H", "S"), "assistant").otherwise(F.col("role"))
        return letters.select("chat", "part", "slot", "at", role.alias("role"), F.when(F.col("op").isin("G", "H"), F.lit("")).otherwise(F.col("content")).alias("content"))

    def summary(self) -> DataFrame:
        """Per chat with rows: chat, gaps, blank, duplicate, truncated, illegal, cost, audit."""
        turns = self.told.groupBy("chat", "turn").agg(*[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
        wide = "decimal(38,0)"
        span = F.max("turn").cast(wide) - F.min("turn").cast(wide) + 1 - F.count("turn").cast(wide)
        faults = turns.groupBy("chat").agg(F.coalesce(span, F.lit(0)).try_cast("long").alias("gaps"), *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")])
        edits = self.edits.groupBy(F.col("chat").alias("edited")).agg(F.sum("bad").alias("illegal"), F.sum("cost").alias("cost"), F.array_sort(F.collect_list(F.struct("part", "piece", "ops"))).alias("ops"))
        edits = edits.select("edited", "illegal", "cost", F.translate(F.array_join("ops.ops", ""), AUDIT_FROM, AUDIT_TO).alias("audit"))
        return faults.join(edits, F.col("chat").eqNullSafe(F.col("edited"))).drop("edited")

    def discard(self) -> None:
        """Delete the tables."""
        discard(self.work)


def repair_chats(messages: DataFrame, chat_id: str = "chat_id", turn: str = "turn", role: str = "role", content: str = "content") -> Repair:
    """Cheapest repair of the assistant's chats (chat_id, turn, role, content), messages of which are user, assistant or system rows.

    A repaired chat is empty, or pairs of user and assistant after at most one system message, by the initials of the roles.  Keeping a row costs 0, giving
    it the role user or assistant 3, deleting it 4, inserting an empty message 3; a row that stays although it is truncated costs 3 more.  Blank rows and
    duplicates must go.  Of equally cheap repairs the one with the least letters (D, I, K, R in order) is taken.

    Rows of a chat are taken by turn, nulls first, then role and content (its first 128 characters, then a hash); equal rows follow each other and all but the first are duplicates.  A row's first
    fault counts: blank (no character but white space), duplicate (role and text seen earlier in the chat), truncated (the last such character
    is not `.`, `!` or `?`).  Null roles and contents are empty texts; rows of a null chat_id are one chat; roles with other initials
    can't be kept.  Chats of one row and empty tables are fine; other columns are not used.

    All rows are put in order by ranges, so a chat with many rows lies in many tasks; its pieces of at most 4096 rows have one matrix
    each, and one pass over a chat's pieces (not its rows) chooses between their entries.  Equal strings of symbols are solved once for all chats.
    """
    work: list[str] = []
    rows = stored(ordered_rows(messages, chat_id, turn, role, content), "chat-rows", work)
    told = stored(told_rows(rows), "chat-faults", work)
    edits = stored(chat_edits(told, rows.schema["chat"].dataType), "chat-edits", work)
    return Repair(rows, told, edits, work)


def repaired_digests(repair: Repair) -> DataFrame:
    """Per chat with messages left: chat, repaired_sha256 (lowercase hex) of its `role:content` lines, joined by newlines.

    A digest is made in order, so a chat passes through one task, message by message; nothing of it is held but the state of the hash.
    """
    lines = repair.messages().select("chat", "part", "slot", "at", F.concat("role", F.lit(":"), "content").cast("binary").alias("line"))
    ordered = lines.repartition(shuffle_width(lines.sparkSession), "chat").sortWithinPartitions("chat", "part", "slot", "at").select("chat", "line")
    schema = StructType([StructField("chat", repair.rows.schema["chat"].dataType), StructField("repaired_sha256", StringType())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chat, state, kind = None, None, None
        for batch in batches:
            kind, done = batch.column(0).type, []
            for ident, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if state is None or ident != chat:
                    if state is not None:
                        done.append((chat, state.hexdigest()))
                    chat, state = ident, hashlib.sha256(line)
                else:
                    state.update(b"\n")
                    state.update(line)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (kind, pa.string()))], schema.names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([chat], kind), pa.array([state.hexdigest()])], schema.names)

    return ordered.mapInArrow(digest, schema)
