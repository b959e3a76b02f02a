"""Conversation structure repair by a survivor-coalescence Viterbi search.

A conversation is repaired by the cheapest edits that leave roles with the initials ``(s?(ua)+)?``. The search reads
its rows in order and keeps for each state of that pattern one survivor: the cheapest edits so far, of equally cheap ones those
whose letters come first. The edits of all survivors form a tree of back pointers with reference counts: branches that no survivor
ends in are freed, and once all survivors share an ancestor the edits up to it are certain and are emitted. So memory holds the
unresolved suffixes alone, however long the conversation is.

Tied survivors are compared by their complete unresolved suffixes. That order is settled by the first letter at which they
differ, so it is carried along from row to row; where one suffix so far is the start of the other, their lengths tell the rest, as only
insertions can be left over. A survivor that no future can make cheapest is dropped, so that it holds up no emission.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_batches

#: Costs of edits; a truncated row that is not deleted costs TRUNCATED more.
COSTS = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED = 5
#: Roles that rows can be given and that inserted rows have.
ROLES = ("user", "assistant")

#: States: nothing yet, after s, after u, after a; which state a role's initial leads to.
_START, _S, _U, _A = range(4)
_NEXT = {(_START, "s"): _S, (_START, "u"): _U, (_S, "u"): _U, (_U, "a"): _A, (_A, "u"): _U}
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
#: (t, s): n means that whatever can follow s can follow t for n more at most, by inserting or, for a system row, deleting one.
_NO_WORSE = {(_A, _START): 2, (_A, _S): 0, (_START, _S): 0, (_U, _S): 5, (_U, _START): 7}
_WHITE = r"\x20\x09-\x0D"
#: Rows of output that a task hands on at once.
FLUSH = 1000


class _Node:
    """An edit: its letter, and role and text of the row that it leaves (None: none)."""

    __slots__ = ("depth", "letter", "parent", "refs", "row")

    def __init__(self, parent: _Node | None, letter: str, row: tuple[str, str] | None):
        self.parent, self.letter, self.row, self.refs = parent, letter, row, 0
        self.depth = parent.depth + 1 if parent else 0

    def hold(self) -> None:
        node: _Node | None = self
        while node is not None:
            node.refs += 1
            node = node.parent if node.refs == 1 else None

    def release(self) -> None:
        node: _Node | None = self
        while node is not None:
            node.refs -= 1
            node = node.parent if node.refs == 0 else None


class Search:
    """The search over one conversation; ``emit`` gets each certain edit in order: letter, and the row it leaves."""

    def __init__(self, emit: Callable[[str, tuple[str, str] | None], None]):
        self.emit, self.root, self.most = emit, _Node(None, "", None), 32
        self.root.hold()
        self.survivors: dict[int, tuple[int, _Node]] = {_START: (0, self.root)}
        self.order: dict[tuple[int, int], int] = {(_START, _START): 0}
        self._settle({_START: (0, _START, "", self.root)})

    def add(self, role: str, text: str, gone: bool, truncated: bool) -> None:
        """The next row; one that is ``gone`` (blank or a duplicate) must be deleted."""
        found: dict[int, tuple[int, int, str, _Node]] = {}
        extra, initial = TRUNCATED if truncated else 0, role[:1]
        for s, (cost, node) in self.survivors.items():
            self._offer(found, s, cost + COSTS["D"], s, "D", node, None)
            if gone:
                continue
            if (t := _NEXT.get((s, initial))) is not None:
                self._offer(found, t, cost + COSTS["K"] + extra, s, "K", node, (role, text))
            for new in ROLES:
                if (t := _NEXT.get((s, new[0]))) is not None:
                    self._offer(found, t, cost + COSTS["R"] + extra, s, "R", node, (new, text))
        self._settle(found)
        if max(node.depth for _, node in self.survivors.values()) - self.root.depth > self.most:
            left = self._advance()
            self.most = max(32, 2 * left)

    def _offer(self, found: dict, t: int, cost: int, s: int, letters: str, parent: _Node, row: tuple[str, str] | None) -> bool:
        """Take edits into ``found`` if they are better there: survivor ``s`` followed by ``letters``, the last of which is new."""
        now = found.get(t)
        if now is not None and (cost > now[0] or cost == now[0] and self._compare(s, letters, now[1], now[2]) >= 0):
            return False
        found[t] = (cost, s, letters, _Node(parent, letters[-1], row))
        return True

    def _compare(self, s: int, a: str, t: int, b: str) -> int:
        """Whether the edits of survivor ``s`` with ``a`` come before (-1) or after (1) those of ``t`` with ``b``; 0: one is the other's start."""
        if s != t:
            if self.order[s, t]:
                return self.order[s, t]
            longer = self.survivors[t][1].depth - self.survivors[s][1].depth  # by insertions alone
            a, b = "I" * max(0, -longer) + a, "I" * max(0, longer) + b
        n = min(len(a), len(b))
        return (a[:n] > b[:n]) - (a[:n] < b[:n])

    def _settle(self, found: dict[int, tuple[int, int, str, _Node]]) -> None:
        """Insertions after the row, then the new survivors."""
        changed = True
        while changed:
            changed = False
            for s, (cost, of, letters, node) in list(found.items()):
                for new in ROLES:
                    if found[s][3] is node and (t := _NEXT.get((s, new[0]))) is not None:
                        changed |= self._offer(found, t, cost + COSTS["I"], of, letters + "I", node, (new, ""))
        found = {s: x for s, x in found.items() if not any(t in found and found[t][0] + n < x[0] for (t, u), n in _NO_WORSE.items() if u == s)}
        order = {(s, t): self._compare(x[1], x[2], y[1], y[2]) for s, x in found.items() for t, y in found.items()}
        for _, _, _, node in found.values():
            node.hold()
        for _, node in self.survivors.values():
            node.release()
        self.survivors, self.order = {s: (cost, node) for s, (cost, _, _, node) in found.items()}, order

    def _advance(self, node: _Node | None = None) -> int:
        """Emit the edits up to the survivors' last common ancestor, or up to ``node``; how many of a survivor's are left."""
        path, at = [], node or next(iter(self.survivors.values()))[1]
        while at is not self.root:
            path.append(at)
            at = at.parent
        while path and (node is not None or self.root.refs == 1):
            self.root = path.pop()
            self.root.parent = None
            self.emit(self.root.letter, self.root.row)
        return len(path)

    def end(self) -> int:
        """Emit the rest of the best edits and return their cost."""
        ends = [s for s in (_START, _A) if s in self.survivors]
        best = ends[0]
        if len(ends) == 2:
            a, b = (self.survivors[s][0] for s in ends)
            best = ends[1] if b < a or b == a and self._compare(ends[1], "", ends[0], "") < 0 else ends[0]
        cost, node = self.survivors[best]
        self._advance(node)
        return cost


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, gone`` after faults that hang on a checksum of conversation and turn: a row in twenty each is lost
    (``gone``), loses its text, loses its sentence ends, stands twice (``copy`` 1), or gets the role user. Null roles and texts are one space."""
    key = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id",)), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fault = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fault") == 0).alias("gone"), copies.alias("copy"))


def _ordered(rows: DataFrame, conv: str, turn: str, role: str, text: str, gone: str | None) -> DataFrame:
    """Rows by conversation and turn with their faults: moved once by conversation, and sorted twice there, by text to find repeats and by turn."""
    blank = lambda c: ~c.rlike(rf"[^{_WHITE}]")
    picked = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"), (F.col(gone) if gone else F.lit(False)).alias("gone"))
    picked = picked.repartition("conv")
    seen = F.row_number().over(Window.partitionBy("conv", "gone", "role", "text").orderBy(F.asc_nulls_first("turn"))) > 1
    flagged = picked.withColumn("seen", seen).withColumn("blank", blank(F.col("text"))).withColumn("cut", ~F.col("text").rlike(rf"[.!?][{_WHITE}]*\z"))
    return flagged.sortWithinPartitions(F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), "role", "text", "seen")


class _Report:
    """Counts, audit and digest of one conversation."""

    def __init__(self, conv: Any, keep: Callable[[Any, int, str, tuple[str, str] | None], None] | None):
        self.conv, self.keep, self.n, self.lines = conv, keep, 0, 0
        self.audit, self.digest = bytearray(), hashlib.sha256()
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.before, self.turns, self.rows = None, [None, None, 0], 0
        self.search = Search(self._emit)

    def _emit(self, letter: str, row: tuple[str, str] | None) -> None:
        if self.keep is not None:
            self.keep(self.conv, self.n, letter, row)
            self.n += 1
            return
        self.audit += letter.encode()
        if row is not None:
            self.digest.update(("\n" if self.lines else "").encode() + f"{row[0]}:{row[1]}".encode("utf-8", "surrogatepass"))
            self.lines += 1

    def add(self, turn: int | None, role: str, text: str, seen: bool, blank: bool, cut: bool) -> None:
        self.rows += 1
        fault = "blank" if blank else "duplicate" if seen else "truncated" if cut else None
        if fault:
            self.counts[fault] += 1
        if self.before is not None and (self.before, role[:1]) not in _LEGAL:
            self.counts["illegal"] += 1
        self.before = role[:1]
        if turn is not None and turn != self.turns[1]:
            self.turns = [turn if self.turns[0] is None else self.turns[0], turn, self.turns[2] + 1]
        self.search.add(role, text, blank or seen, fault == "truncated")

    def end(self) -> dict:
        cost = self.search.end() if self.rows else 0
        first, last, n = self.turns
        gaps = 0 if first is None else min(last - first + 1 - n, 2**63 - 1)
        return {"conv": self.conv, "gaps": gaps, **self.counts, "cost": cost, "audit": self.audit.decode(), "repaired_sha256": self.digest.hexdigest()}


def _reports(batches: Iterator[pa.RecordBatch], keep: Callable | None) -> Iterator[dict]:
    now: _Report | None = None
    for batch in batches:
        for x in batch.to_pylist():
            if now is None or x["conv"] != now.conv:
                if now is not None:
                    yield now.end()
                now = _Report(x["conv"], keep)
            if not x["gone"]:
                now.add(x["turn"], x["role"], x["text"], x["seen"], x["blank"], x["cut"])
        if keep is not None:
            yield {}  # so that kept edits are handed on
    if now is not None:
        yield now.end()


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.select("conv", "turn", "role", "text", "gone", "seen", "blank", "cut")


def report(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None) -> DataFrame:
    """One row a conversation: ``conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    Rows count in the order of their turns, nulls first; rows of one turn in that of role and text. Null roles and texts are one
    space; null conversations are one conversation. Rows that ``gone`` marks are not there, but name their conversation. A row's first fault counts:
    no character but white space, role and text of an earlier row, a last character that ends no sentence. ``illegal`` counts neighbours whose role initials
    are not su, ua or au, ``gaps`` the turns missing between the first and the last.

    Edits keep a row (0), give it the role user or assistant (1), delete it (2, which blank and duplicate rows need), or
    insert an empty row of one of these roles (5); a truncated row that stays costs 5 more. ``cost`` and ``audit`` are those of the cheapest
    edits after which role initials read ``(s?(ua)+)?``, of equal ones the first letters K, R, D, I in ASCII order;
    ``repaired_sha256`` is the digest of what they leave, as ``role:text`` lines. A conversation without rows has zeros
    and empty texts. Extra columns are ignored. An empty table gives no rows.
    """
    kind = rows.schema[conv].dataType.simpleString()
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        type_ = None

        def first() -> Iterator[pa.RecordBatch]:
            nonlocal type_
            for batch in batches:
                type_ = batch.schema.field("conv").type
                yield batch

        def flush() -> pa.RecordBatch:
            schema = pa.schema([("conv", type_), *((c, pa.int64()) for c in names[1:7]), ("audit", pa.string()), ("repaired_sha256", pa.string())])
            done = pa.RecordBatch.from_pylist(out, schema)
            out.clear()
            return done

        for x in _reports(first(), None):
            out.append(x)
            if len(out) >= FLUSH:
                yield flush()
        if out:
            yield flush()

    bounded_batches(rows.sparkSession)
    longs = ", ".join(f"{c} long" for c in names[1:7])
    found = _in_order(_ordered(rows, conv, turn, role, text, gone)).mapInArrow(run, f"conv {kind}, {longs}, audit string, repaired_sha256 string")
    return found.withColumnRenamed("conv", conv)


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None) -> DataFrame:
    """The edits of ``report`` one by one: ``conv, place`` (from 0), ``edit`` (K, R, D or I), and ``role`` and ``text`` of the row that it leaves (a deleted row: null)."""
    kind = rows.schema[conv].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        type_ = None

        def keep(conv: Any, n: int, letter: str, row: tuple[str, str] | None) -> None:
            out.append({"conv": conv, "place": n, "edit": letter, "role": row and row[0], "text": row and row[1]})

        def flush() -> pa.RecordBatch:
            done = pa.RecordBatch.from_pylist(out, pa.schema([("conv", type_), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))
            out.clear()
            return done

        def slices() -> Iterator[pa.RecordBatch]:
            nonlocal type_
            for batch in batches:
                type_ = batch.schema.field("conv").type
                yield batch

        for _ in _reports(slices(), keep):
            if len(out) >= FLUSH:
                yield flush()
        if out:
            yield flush()

    bounded_batches(rows.sparkSession)
    found = _in_order(_ordered(rows, conv, turn, role, text, gone)).mapInArrow(run, f"conv {kind}, place long, edit string, role string, text string")
    return found.select(F.col("conv").alias(conv), "place", "edit", F.col("role").alias(role), F.col("text").alias(text))
