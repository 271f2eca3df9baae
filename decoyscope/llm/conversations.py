"""Structure repair of conversations: the cheapest audit of edits, found by a dynamic program over shared edit prefixes.

1. `damaged` breaks turns on purpose, by a checksum of conversation and turn. `judged` then gives each different row its place
   in the order (turn, nulls first, then role and text), how often it occurs and its fault. Equal rows of one turn are one
   row with a count, so rows that repeat without end cost one row.
2. Rows are dealt by range of (conversation, turn), so a long conversation spreads over tasks. Each task cuts its rows at conversations and
   every `BLOCK` rows into segments, and finds for each segment the cheapest audit from every state it may be entered in to
   every state it may be left in. States are: nothing yet, after a system turn, after a user turn, after an assistant turn.
3. Inside a segment the candidates of all states share their prefixes as linked nodes. A node knows its ancestors at
   distances 1, 2, 4 ... and a rolling hash of all edits up to it. Equally dear candidates are compared at the edit after their longest common
   prefix, found by descending the ancestors with equal hashes; that the prefixes really are equal is then verified.
4. A conversation's segments are chained in order: states in between are summed out, and what all candidates begin with is set aside.
   No two equally dear audits of one segment and end state can be prefixes of each other (the longer has inserts more, which
   cost), so the least audit of a whole is made of least audits of its parts.
5. `repaired` streams the rows of each conversation behind its audit and applies it, holding one row at a time.

Edits: Keep 0, Rerole to user or assistant 2, Delete 3 (the only one for blank and repeated rows), Insert an empty user or
assistant turn 2; a truncated row that stays adds 1. The roles that stay begin with `(s?(ua)+)?`.

Edge cases: null roles and texts read as one space, and so do nulls in the checksum, but a null turn stays null and comes first;
a null conversation is one conversation of its own; rows that are equal in all columns count each; other columns are not read, so
they may have any name; a conversation of which no row is left has zeros, an empty audit and no repaired rows; an empty table gives an
empty result. Equal texts and roles are told by SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED = 1
BLOCK = 2048
"""Rows of a segment at most."""
DAMAGE = 20
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
"""The state that a turn of this role leads to; other turns cannot follow."""
LEGAL = ("su", "ua", "au")
BLANKS, ENDS = " \t\n\x0b\f\r", ".!?"


def damaged(turns: DataFrame) -> DataFrame:
    """(conv, turn, role, text, gone): rows after damage; a dropped row stays as a mark of its conversation, with gone true."""
    read = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(read("conv_id"), F.lit(":"), read("turn")).cast("binary")), F.lit(DAMAGE))
    rows = turns.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), read("role").alias("role"), read("text").alias("text"), kind.alias("kind")
    )
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select(
        "conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("kind") == 0).alias("gone"), F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"),
    )
    return rows.drop("copy")


def _marked(rows: DataFrame) -> DataFrame:
    spoken = F.rtrim("text", F.lit(BLANKS))
    return rows.withColumns({
        "mark": F.unhex(F.sha2(F.concat("role", F.lit("\0"), "text"), 256)), "initial": F.substring("role", 1, 1), "blank": spoken == "",
        "open": ~F.right(spoken, F.lit(1)).isin(*ENDS),
    })


def judged(rows: DataFrame) -> DataFrame:
    """Different rows of each conversation and turn: conv, turn, role, text, n, initial, blank, open, seen.

    `n` counts equal rows (0 for dropped ones), `open` is a text without an end mark, `seen` tells that an earlier turn has
    this role and text. The first of equal rows of a turn is judged by these; the others are repeats.
    """
    one = _marked(rows).groupBy("conv", "turn", "mark").agg(
        F.count_if(~F.col("gone")).alias("n"), *[F.any_value(name).alias(name) for name in ("role", "text", "initial", "blank", "open")]
    )
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = F.min(F.when(F.col("n") > 0, place)).over(Window.partitionBy("conv", "mark"))
    return one.select("conv", "turn", "role", "text", "n", "initial", "blank", "open", F.coalesce(first < place, F.lit(False)).alias("seen"))


class Prefixes:
    """Edit prefixes as linked nodes: parent, depth, last edit, ancestors by powers of two, rolling hash from the root."""

    PRIME, BASE = (1 << 61) - 1, 911382323

    def __init__(self) -> None:
        self.edit, self.depth, self.hash, self.up = [""], [0], [0], [[0]]

    def then(self, node: int, edit: str) -> int:
        up, k = [node], 0
        while k < len(self.up[up[k]]) and up[k]:
            up.append(self.up[up[k]][k])
            k += 1
        self.edit.append(edit)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * self.BASE + ord(edit)) % self.PRIME)
        self.up.append(up)
        return len(self.edit) - 1

    def raised(self, node: int, depth: int) -> int:
        """The ancestor at this depth."""
        step = self.depth[node] - depth
        while step:
            k = step.bit_length() - 1
            node = self.up[node][k]
            step -= 1 << k
        return node

    def before(self, a: int, b: int) -> bool:
        """Is the string that ends at a less than the one that ends at b?"""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.raised(a, depth), self.raised(b, depth)
        if self._equal(x, y):
            return self.depth[a] < self.depth[b]
        while True:
            for k in range(min(len(self.up[x]), len(self.up[y])) - 1, -1, -1):
                if k < min(len(self.up[x]), len(self.up[y])) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                    x, y = self.up[x][k], self.up[y][k]
            # x and y differ, their parents' hashes do not: the first difference, if the parents are equal indeed.
            above = self.up[x][0], self.up[y][0]
            if self._verified(*above):
                return self.edit[x] < self.edit[y]
            x, y = above

    def _equal(self, x: int, y: int) -> bool:
        return x == y or (self.hash[x] == self.hash[y] and self._verified(x, y))

    def _verified(self, x: int, y: int) -> bool:
        """Compares two strings of one depth that have the same hash, back to the node they share."""
        while x != y:
            if self.edit[x] != self.edit[y]:
                return False
            x, y = self.up[x][0], self.up[y][0]
        return True

    def string(self, node: int) -> str:
        out = []
        while node:
            out.append(self.edit[node])
            node = self.up[node][0]
        return "".join(reversed(out))


Best = dict[int, tuple[int, int]]
"""State: (cost, node) of the cheapest, then least, audit that ends in it."""


class Audit:
    """The cheapest audits of a run of rows, from one state of entry to every state."""

    def __init__(self, entry: int):
        self.nodes = Prefixes()
        self.best: Best = {entry: (0, 0)}

    def _offer(self, best: Best, state: int, cost: int, node: int, edit: str) -> None:
        held = best.get(state)
        if held is not None and held[0] < cost:
            return
        new = self.nodes.then(node, edit)
        if held is None or cost < held[0] or self.nodes.before(new, held[1]):
            best[state] = (cost, new)

    def insert(self) -> None:
        """Turns put in before the next row: never more than two pay."""
        for _ in range(2):
            for state, (cost, node) in sorted(self.best.items(), key=lambda item: item[1][0]):
                for role in "ua":
                    if (state, role) in AFTER:
                        self._offer(self.best, AFTER[state, role], cost + COST[INSERT], node, INSERT)

    def row(self, initial: str, may_stay: bool, truncated: bool) -> None:
        self.insert()
        best: Best = {}
        extra = TRUNCATED if truncated else 0
        for state, (cost, node) in self.best.items():
            self._offer(best, state, cost + COST[DELETE], node, DELETE)
            if may_stay:
                if (state, initial) in AFTER:
                    self._offer(best, AFTER[state, initial], cost + COST[KEEP] + extra, node, KEEP)
                for role in "ua":
                    if (state, role) in AFTER:
                        self._offer(best, AFTER[state, role], cost + COST[REROLE] + extra, node, REROLE)
        self.best = best

    def ends(self) -> dict[int, tuple[int, str]]:
        self.insert()
        return {state: (cost, self.nodes.string(node)) for state, (cost, node) in self.best.items()}


class Segment:
    """Rows of one conversation that follow one another in one task: audits by state of entry, and counts."""

    def __init__(self, begins: bool):
        self.audits = {entry: Audit(entry) for entry in ((START,) if begins else range(4))}
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = None
        self.first_turn = self.last_turn = None

    def add(self, row: dict) -> None:
        if not row["n"]:
            return
        self.rows += row["n"]
        initial, copies = row["initial"], row["n"] - 1
        blank, seen = row["blank"], row["seen"]
        truncated = row["open"] and not blank and not seen
        for audit in self.audits.values():
            audit.row(initial, not blank and not seen, truncated)
            for _ in range(copies):
                audit.row(initial, False, False)
        self.blank += row["n"] if blank else 0
        self.duplicate += 0 if blank else copies + seen
        self.truncated += truncated
        if self.first is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in LEGAL
        self.illegal += copies * (initial + initial not in LEGAL)
        self.last = initial
        if row["turn"] is not None and row["turn"] != self.last_turn:
            self.turns += 1
            self.last_turn = row["turn"]
            self.first_turn = row["turn"] if self.first_turn is None else self.first_turn

    def told(self) -> dict:
        ends = [
            {"entry": entry, "state": state, "cost": cost, "audit": text} for entry, audit in self.audits.items() for state, (cost, text) in audit.ends().items()
        ]
        return {"ends": ends} | {name: getattr(self, name) for name in (*_COUNTS, "turns", "first", "last", "first_turn", "last_turn")}


_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_SEGMENT = pa.schema([
    ("conv_text", pa.string()), ("task", pa.int32()), ("place", pa.int32()),
    ("ends", pa.list_(pa.struct([("entry", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))),
    *((name, pa.int64()) for name in _COUNTS), ("turns", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("first_turn", pa.int64()), ("last_turn", pa.int64()),
])
_SEGMENT_DDL = (
    "conv_text string, task int, place int, ends array<struct<entry: int, state: int, cost: long, audit: string>>, blank long, duplicate long, truncated long, "
    "illegal long, turns long, first string, last string, first_turn long, last_turn long"
)
_AUDIT = pa.schema([("conv_text", pa.string()), ("gaps", pa.int64()), *((name, pa.int64()) for name in _COUNTS), ("cost", pa.int64()), ("audit", pa.string())])
_AUDIT_DDL = "conv_text string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _batched(rows: Iterator[dict], schema: pa.Schema, most: int = 2048) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _cut(rows: Iterator[dict], task: int, block: int) -> Iterator[dict]:
    """The segments of a task's rows, which come in order."""
    held: Segment | None = None
    conv: str | None = None
    place = 0
    for row in rows:
        new = held is not None and row["conv_text"] != conv
        if new or (held is not None and held.rows >= block):
            yield {"conv_text": conv, "task": task, "place": place, **held.told()}
            place, held = place + 1, None
        if held is None:
            # Only a conversation that begins behind another one is known to begin here.
            held, conv = Segment(begins=new), row["conv_text"]
        held.add(row)
    if held is not None:
        yield {"conv_text": conv, "task": task, "place": place, **held.told()}


def _segments(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        yield from _batched(_cut(rows, TaskContext.get().partitionId(), block), _SEGMENT, 256)

    return run


class Chain:
    """A conversation's audit and counts, segment by segment."""

    def __init__(self, conv: str | None):
        self.conv, self.counts = conv, dict.fromkeys(_COUNTS, 0)
        self.turns, self.first_turn, self.last_turn, self.last = 0, None, None, None
        self.settled: list[str] = []
        self.best: dict[int, tuple[int, str]] = {START: (0, "")}

    def add(self, part: dict) -> None:
        for name in _COUNTS:
            self.counts[name] += part[name]
        if part["first"] is not None:
            self.counts["illegal"] += self.last is not None and self.last + part["first"] not in LEGAL
            self.last = part["last"]
        if part["first_turn"] is not None:
            self.turns += part["turns"] - (part["first_turn"] == self.last_turn)
            self.first_turn = part["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = part["last_turn"]
        after: dict[int, tuple[int, str]] = {}
        for end in part["ends"]:
            if end["entry"] in self.best:
                cost, text = self.best[end["entry"]]
                offer = (cost + end["cost"], text + end["audit"])
                after[end["state"]] = min(after.get(end["state"], offer), offer)
        common = len(commonprefix([text for _, text in after.values()]))
        self.settled.append(next(iter(after.values()))[1][:common])
        self.best = {state: (cost, text[common:]) for state, (cost, text) in after.items()}

    def told(self) -> dict:
        cost, text = min(self.best[state] for state in (START, ASSISTANT) if state in self.best)
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.first_turn is not None else 0
        return {"conv_text": self.conv, "gaps": gaps, **self.counts, "cost": cost, "audit": "".join(self.settled) + text}


def _chains(rows: Iterator[dict]) -> Iterator[dict]:
    held: Chain | None = None
    for row in rows:
        if held is not None and held.conv != row["conv_text"]:
            yield held.told()
            held = None
        held = Chain(row["conv_text"]) if held is None else held
        held.add(row)
    if held is not None:
        yield held.told()


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _batched(_chains(row for batch in batches for row in batch.to_pylist()), _AUDIT)


def audits(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per conversation of damaged rows: conv_text, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    narrow = stored(judged(rows).withColumn("conv_text", F.col("conv").cast("string")).drop("conv"), "conversation-rows")
    order = [F.col("conv_text").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    dealt = narrow.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = dealt.select("conv_text", "turn", "n", "initial", "blank", "open", "seen").mapInArrow(_segments(block), _SEGMENT_DDL)
    whole = parts.repartition("conv_text").sortWithinPartitions("conv_text", "task", "place")
    return stored(whole.mapInArrow(_chained, _AUDIT_DDL), "conversation-audits")


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, str | None, str | None]]:
    """(conv, role, text) of every turn that stays, and (conv, None, None) after each conversation's last.

    Rows come in order, each conversation's audit first.
    """
    conv: str | None = None
    audit, at, even = "", 0, True

    def inserted() -> Iterator[tuple[str | None, str | None, str | None]]:
        nonlocal at, even
        while at < len(audit) and audit[at] == INSERT:
            yield conv, "user" if even else "assistant", ""
            at, even = at + 1, not even

    open_conversation = False
    for batch in batches:
        for row in batch.to_pylist():
            if row["audit"] is not None:
                if open_conversation:
                    yield from inserted()
                    yield conv, None, None
                conv, audit, at, even, open_conversation = row["conv_text"], row["audit"], 0, True, True
                continue
            yield from inserted()
            edit, at = audit[at], at + 1
            if edit == DELETE:
                continue
            if edit == REROLE:
                yield conv, "user" if even else "assistant", row["text"]
            else:
                yield conv, row["role"], row["text"]
                if row["role"][:1] == "s":  # a system turn stands before the pairs
                    continue
            even = not even
    if open_conversation:
        yield from inserted()
        yield conv, None, None


def _behind_audits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """All rows that damage left, sorted, each conversation's behind its audit."""
    none = F.lit(None).cast("string")
    own = rows.where("not gone").select(F.col("conv").cast("string").alias("conv_text"), F.lit(1).alias("kind"), "turn", "role", "text", none.alias("audit"))
    heads = found.select("conv_text", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), none.alias("role"), none.alias("text"), "audit")
    both = own.unionByName(heads).repartition("conv_text")
    return both.sortWithinPartitions("conv_text", "kind", F.col("turn").asc_nulls_first(), "role", "text").select("conv_text", "role", "text", "audit")


_TURN = pa.schema([("conv_text", pa.string()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size, place = [], 0, 0
    for conv, role, text in _applied(batches):
        place = 0 if role is None else place + 1
        if role is not None:
            held.append((conv, place, role, text))
            size += len(text)
        if len(held) >= 4096 or size >= 1 << 24:
            yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*held), _TURN)], schema=_TURN)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*held), _TURN)], schema=_TURN)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_text", "repaired_sha256"]
    held, digest, begun = [], hashlib.sha256(), False
    for conv, role, text in _applied(batches):
        if role is None:
            held.append((conv, digest.hexdigest()))
            digest, begun = hashlib.sha256(), False
        else:
            digest.update(("\n" if begun else "").encode() + f"{role}:{text}".encode())
            begun = True
        if len(held) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(column, pa.string()) for column in zip(*held)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(column, pa.string()) for column in zip(*held)], names=names)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The turns of every conversation after repair: conv_text, place (from 1), role, text."""
    return _behind_audits(rows, found).mapInArrow(_turns, "conv_text string, place long, role string, text string")


def report(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conversation: conv_id, its counts, cost and audit, and the SHA-256 of its repaired `role:text` lines.

    A digest reads a conversation from its first turn to its last, so it is one task's work, in which one row is held at a time.
    """
    kind: T.DataType = turns.schema["conv_id"].dataType
    rows = damaged(turns)
    found = audits(rows, block)
    digests = _behind_audits(rows, found).mapInArrow(_digests, "conv_text string, repaired_sha256 string")
    joined = found.join(digests.withColumnRenamed("conv_text", "conv_of"), F.col("conv_text").eqNullSafe(F.col("conv_of")))
    return joined.select(F.col("conv_text").cast(kind).alias("conv_id"), "gaps", *_COUNTS, "cost", "audit", "repaired_sha256")
