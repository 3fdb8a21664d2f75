"""Conversation structure repair: the cheapest edits that give (system)? (user assistant)+, with an audit of them.

Rows pass in order of their turns through a dynamic program of four states (start, after system, after user, after
assistant). Each state holds its cost and the last node of a linked list of edits; lists share their prefixes. A node
knows its ancestors at powers of two and the rolling hash of all its letters, so two lists of equal cost are told apart
where their longest common prefix ends, in logarithmic time; letters behind equal hashes are compared as well.
A prefix that all states share is settled: it leaves the tree, and its turns are written, so a conversation of any length
passes in one sorted stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriset.llm.common import BLANKS

#: Costs of the edits; LOOSE is added for a truncated turn that stays.
REROLE, DELETE, INSERT, LOOSE = 1, 2, 5, 5
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
START, SYSTEM, USER, ASSISTANT = range(4)
#: Adjacent initials of roles that are in order.
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
_AFTER = {"s": (START, SYSTEM), "u": (START, USER), "a": (USER, ASSISTANT)}
_PRIME, _BASE = (1 << 61) - 1, 1_000_003
#: Nodes beyond those in use after which the tree is settled.
_SLACK = 4096


class EditTree:
    """Edit lists with shared prefixes; node 0 is the empty list."""

    def __init__(self) -> None:
        self.letter, self.depth, self.hash, self.up = [""], [0], [0], [(0,)]

    def add(self, node: int, letter: str) -> int:
        ups, hop, level = [node], node, 0
        while self.depth[hop] and level < len(self.up[hop]):
            hop = self.up[hop][level]
            ups.append(hop)
            level += 1
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * _BASE + ord(letter)) % _PRIME)
        self.up.append(tuple(ups))
        return len(self.letter) - 1

    def ancestor(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            gap = self.depth[node] - depth
            node = self.up[node][min(gap.bit_length() - 1, len(self.up[node]) - 1)]
        return node

    def letters(self, node: int, above: int = 0) -> str:
        """Letters of the list behind its ancestor ``above``."""
        found = []
        while node != above:
            found.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(found))

    def same(self, a: int, b: int) -> bool:
        """Whether two lists of one length are equal letter by letter; shared nodes end the comparison."""
        while a != b:
            if self.letter[a] != self.letter[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether list ``a`` comes before list ``b``; a list comes before its extensions."""
        short = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, short), self.ancestor(b, short)
        if self.hash[x] == self.hash[y]:
            if self.same(x, y):
                return self.depth[a] < self.depth[b]
        else:
            for level in range(len(self.up[x]) - 1, -1, -1):
                p, q = (self.up[n][level] if level < len(self.up[n]) else 0 for n in (x, y))
                if self.hash[p] != self.hash[q]:
                    x, y = p, q
            if self.same(self.up[x][0], self.up[y][0]):
                return self.letter[x] < self.letter[y]
        return self.letters(a) < self.letters(b)  # different lists of one hash

    def common(self, nodes: list[int]) -> int:
        """The last node that all lists share."""
        depth = min(self.depth[n] for n in nodes)
        nodes = [self.ancestor(n, depth) for n in nodes]
        while len(set(nodes)) > 1:
            # the largest hop that keeps the lists apart, else one step
            level = max((j for j in range(min(len(self.up[n]) for n in nodes)) if len({self.up[n][j] for n in nodes}) > 1), default=0)
            nodes = [self.up[n][level] for n in nodes]
        return nodes[0]


class Repair:
    """The dynamic program over one conversation, row by row."""

    def __init__(self) -> None:
        self.tree = EditTree()
        self.best: dict[int, tuple[int, int]] = {START: (0, 0)}
        self.limit = _SLACK
        self._insert()

    def _offer(self, table: dict[int, tuple[int, int]], state: int, cost: int, node: int, letter: str) -> None:
        known = table.get(state)
        if known is not None and known[0] < cost:
            return
        new = self.tree.add(node, letter)
        if known is None or known[0] > cost or self.tree.less(new, known[1]):
            table[state] = (cost, new)

    def _insert(self) -> None:
        """Inserted turns; two in a row are enough, since a third never pays."""
        before = dict(self.best)
        for state in (START, SYSTEM, ASSISTANT):
            if state in before:
                self._offer(self.best, USER, before[state][0] + INSERT, before[state][1], "I")
        if USER in self.best:
            self._offer(self.best, ASSISTANT, self.best[USER][0] + INSERT, self.best[USER][1], "I")

    def row(self, initial: str, fault: int) -> None:
        table: dict[int, tuple[int, int]] = {}
        stays = fault not in (BLANK, DUPLICATE)
        extra = LOOSE if fault == TRUNCATED else 0
        for state, (cost, node) in self.best.items():
            self._offer(table, state, cost + DELETE, node, "D")
            if stays:
                wanted = ASSISTANT if state == USER else USER
                if initial == ("a" if state == USER else "u"):
                    self._offer(table, wanted, cost + extra, node, "K")
                elif initial == "s" and state == START:
                    self._offer(table, SYSTEM, cost + extra, node, "K")
                self._offer(table, wanted, cost + REROLE + extra, node, "R")
        self.best = table
        self._insert()
        # What a state can still do, another can do for a bounded amount more: dearer states never win, nor tie.
        sure = min(table[ASSISTANT][0], table[USER][0] + INSERT) if ASSISTANT in table else table[USER][0] + INSERT
        for state, spare in ((START, DELETE), (SYSTEM, 0)):
            if state in table and table[state][0] > sure + spare:
                del table[state]

    def settle(self, force: bool = False) -> str:
        """Letters that all states share, taken off the tree."""
        if not force and len(self.tree.letter) < self.limit:
            return ""
        old, nodes = self.tree, [n for _, n in self.best.values()]
        root = old.common(nodes)
        new, moved = EditTree(), {root: 0}
        for node in sorted({n for last in nodes for n in self._path(old, last, root)}):
            moved[node] = new.add(moved[old.up[node][0]], old.letter[node])
        self.tree = new
        self.best = {s: (c, moved[n]) for s, (c, n) in self.best.items()}
        self.limit = 2 * len(new.letter) + _SLACK
        return old.letters(root)

    @staticmethod
    def _path(tree: EditTree, node: int, root: int) -> Iterator[int]:
        while node != root:
            yield node
            node = tree.up[node][0]

    def finish(self) -> tuple[int, str]:
        """Cost of the repair and the letters not settled yet."""
        ends = [self.best[s] for s in (START, ASSISTANT) if s in self.best]
        cost, node = min(ends, key=lambda e: e[0])
        for other, rival in ends:
            if other == cost and rival != node and self.tree.less(rival, node):
                node = rival
        return cost, self.tree.letters(node)


class Conversation:
    """Counts, audit and repaired turns of one conversation; ``write(edit, role, text, turn)`` gets every edit in order."""

    def __init__(self, write: Callable[[str, str, str, object], None]) -> None:
        self.write, self.repair, self.held = write, Repair(), []
        self.state, self.audit = START, bytearray()
        self.turns, self.least, self.most = 0, None, None
        self.counts, self.illegal, self.before = [0, 0, 0, 0], 0, None

    def add(self, turn, role: str, text: str, fault: int) -> None:
        if turn is not None:
            self.turns += turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn
        self.counts[fault] += 1
        initial = role[:1]
        self.illegal += self.before is not None and (self.before, initial) not in LEGAL
        self.before = initial
        self.held.append((turn, role, text))
        self.repair.row(initial, fault)
        self._apply(self.repair.settle())

    def _apply(self, letters: str) -> None:
        used = 0
        for letter in letters:
            turn, role, text = (None, "", "") if letter == "I" else self.held[used]
            used += letter != "I"
            if letter in "RI":
                role = "assistant" if self.state == USER else "user"
            if letter != "D":
                self.state = SYSTEM if self.state == START and role[:1] == "s" else ASSISTANT if self.state == USER else USER
            self.write(letter, role, text, turn)
        self.audit += letters.encode()
        del self.held[:used]

    def finish(self) -> tuple[int, int, int, int, int, int, str]:
        """gaps, blank, duplicate, truncated, illegal, cost, audit."""
        cost, letters = self.repair.finish()
        self._apply(letters)
        gaps = 0 if self.most is None else int(self.most - self.least) + 1 - self.turns
        return (gaps, *self.counts[1:], self.illegal, cost, self.audit.decode())


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, present): rows with faults set by a hash of conversation and turn; dropped rows are not present.

    Nulls count as one space, also in the hash. Of 20 remainders 0 drops a row, 1 empties its text, 2 removes ``.!?``,
    3 repeats it and 4 sets its role to user.
    """
    filled = {c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (conv, turn, role, text)}
    kind = F.crc32(F.concat(filled[conv], F.lit(":"), filled[turn]).cast("binary")) % 20
    rows = df.select(
        F.col(f"`{conv}`").alias("conv"),
        F.col(f"`{turn}`").cast("bigint").alias("turn"),
        F.when(kind == 4, "user").otherwise(filled[role]).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(filled[text], ".!?", "")).otherwise(filled[text]).alias("text"),
        kind.alias("kind"),
    )
    copies = F.when(F.col("kind") == 3, 2).otherwise(1)
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).select("conv", "turn", "role", "text", (F.col("kind") != 0).alias("present"))


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows with their fault, sorted by conversation and turn within partitions; one shuffle, by conversation."""
    kept = rows.select("conv", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "present")
    again = F.row_number().over(Window.partitionBy("conv", "present", "role", "text").orderBy("turn")) > 1
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(end == "", BLANK).when(F.col("again"), DUPLICATE).when(~F.substring(end, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    marked = kept.repartition("conv").withColumn("again", again).withColumn("fault", fault).drop("again")
    return marked.sortWithinPartitions("conv", "turn", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch], open_: Callable[[object], Conversation], close: Callable[[object, Conversation], None]) -> Iterator[None]:
    """Feed sorted rows to one conversation after another; yields after each batch and at the end."""
    current, key, first = None, None, True
    for batch in batches:
        columns = (batch.column(i) for i in range(6))
        for conv, turn, role, text, present, fault in zip(*columns, strict=True):
            name = conv.as_py()
            if first or name != key:
                if current is not None:
                    close(key, current)
                current, key, first = open_(name), name, False
            if present.as_py():
                current.add(turn.as_py(), role.as_py(), text.as_py(), fault.as_py())
        yield
    if current is not None:
        close(key, current)
    yield


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``rows`` is (conv, turn, role, text, present). Rows are taken by turn, nulls first, then by role and text; null roles
    and texts count as one space. A row's first fault counts: blank (no character but blanks), duplicate (role and text
    seen earlier in its conversation) or truncated (does not end in ``.!?``). An empty role fits nowhere. The audit has a letter per edit: Keep, Rerole,
    Delete, Insert; of equally cheap audits it is the least. The hash is that of the repaired ``role:text`` lines. A
    conversation without present rows has zeros and an empty audit; a null key is a conversation too; no rows give none.
    Very long texts are held only until their turn is settled; other columns may not be there, as the five are selected.
    """
    kind = rows.schema["conv"].dataType.simpleString()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    names = ["conv", *counts, "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        digests = {}

        def open_(name) -> Conversation:
            state = [hashlib.sha256(), False]

            def write(edit: str, role: str, text: str, turn) -> None:
                if edit != "D":
                    state[0].update(((b"\n" if state[1] else b"") + role.encode() + b":" + text.encode()))
                    state[1] = True

            found = Conversation(write)
            digests[id(found)] = state[0]
            return found

        def close(name, conversation: Conversation) -> None:
            figures = conversation.finish()
            done.append((name, *figures, digests.pop(id(conversation)).hexdigest()))

        for _ in _conversations(batches, open_, close):
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)
                done.clear()

    types = [_arrow(rows, "conv"), *[pa.int64()] * 6, pa.string(), pa.string()]
    schema = ", ".join([f"conv {kind}", *[f"{c} bigint" for c in counts], "audit string", "repaired_sha256 string"])
    return _ordered(rows).mapInArrow(run, schema)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv, position from 0, edit, role, text, turn): the repaired turns, deleted ones left out; inserted ones have no turn."""
    kind = rows.schema["conv"].dataType.simpleString()
    types = [_arrow(rows, "conv"), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    names = ["conv", "position", "edit", "role", "text", "turn"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []

        def open_(name) -> Conversation:
            place = [0]

            def write(edit: str, role: str, text: str, turn) -> None:
                if edit != "D":
                    done.append((name, place[0], edit, role, text, turn))
                    place[0] += 1

            return Conversation(write)

        for _ in _conversations(batches, open_, lambda name, conversation: conversation.finish()):
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)
                done.clear()

    return _ordered(rows).mapInArrow(run, f"conv {kind}, position bigint, edit string, role string, text string, turn bigint")


def _arrow(rows: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema[name].dataType)


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """Audits of a table of conversations as it is, named by ``conv``."""
    rows = df.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("bigint").alias("turn"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text"), (F.lit(True) if present is None else present).alias("present"))
    return audits(rows).withColumnRenamed("conv", conv)
