"""Conversation repair against plain searches over all edits."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import types as T

from veriset.llm import conversations, queries

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("conv", T.StringType())])
BLANKS = " \t\n\x0b\x0c\r"


def every(rows, i, made, cost, audit, room):
    """All edits of the rest, as (cost, audit, repaired): no pruning but a bound on inserted turns."""
    if i == len(rows):
        roles = "".join(r[:1] or "-" for r, _ in made)
        rest = roles[1:] if roles[:1] == "s" else roles
        if not roles or (rest and rest == "ua" * (len(rest) // 2)):
            yield cost, audit, made
    if room:
        for role in ("user", "assistant"):
            yield from every(rows, i, [*made, (role, "")], cost + 5, audit + "I", room - 1)
    if i < len(rows):
        role, text, fault = rows[i]
        yield from every(rows, i + 1, made, cost + 2, audit + "D", room)
        if fault not in ("blank", "duplicate"):
            extra = 5 if fault == "truncated" else 0
            yield from every(rows, i + 1, [*made, (role, text)], cost + extra, audit + "K", room)
            for other in ("user", "assistant"):
                yield from every(rows, i + 1, [*made, (other, text)], cost + 1 + extra, audit + "R", room)


def plain(table):
    """Contract rows of a table of (conv_id, turn, role, text), by full search."""
    groups = {}
    for conv, turn, role, text in table:
        group = groups.setdefault(conv, [])
        show = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        group += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, group in groups.items():
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, rows, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in group:
            body = text.strip(BLANKS)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            rows.append((role, text, fault))
        initials = [r[0][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        turns = [t for t, _, _ in group if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, made = min(every(rows, 0, [], 0, "", 2), key=lambda e: e[:2])
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, digest)
    return out


def found(spark, table):
    df = spark.createDataFrame([(*r, "x") for r in table], SCHEMA)
    return {r["conv"]: tuple(r)[1:] for r in conversations.audits(conversations.damaged(df)).collect()}


def test_against_all_edits(spark):
    rng = random.Random(5)
    texts = ["Yes.", "No!", "open", "", " \t", "Why? ", None, "a.b", "Yes."]
    roles = ["user", "assistant", "system", "tool", None, "user", "assistant", ""]
    table = [(c, rng.choice([t, t, t + 2, None]), rng.choice(roles), rng.choice(texts)) for c in range(100) for t in range(rng.randint(1, 4))]
    table += [(None, 1, "user", "Q?"), (None, None, "assistant", "A."), (None, 2, None, None)]
    assert found(spark, table) == plain(table)


def test_whole_table_against_plain_program(spark, folder):
    """The query on the given table against a program that carries whole strings."""
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = {r["conv_id"]: r.asDict() for r in queries.op13(spark, folder).collect()}
    short = [c for c in sorted(out) if sum(r[0] == c for r in rows) <= 4][:25]
    wanted = plain([r for r in rows if r[0] in short])
    assert set(out) == {r[0] for r in rows}
    for conv, figures in wanted.items():
        got = out[conv]
        assert tuple(got[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) == figures


def strings(rows):
    """The same program with whole strings as states, for conversations too long for the full search."""
    def relax(table):
        for state in (0, 1, 3):
            if state in table:
                offer(table, 2, (table[state][0] + 5, table[state][1] + "I"))
        if 2 in table:
            offer(table, 3, (table[2][0] + 5, table[2][1] + "I"))

    def offer(table, state, value):
        table[state] = min(table.get(state, value), value)

    table = {0: (0, "")}
    relax(table)
    for initial, fault in rows:
        new = {}
        for state, (cost, audit) in table.items():
            offer(new, state, (cost + 2, audit + "D"))
            if fault in (0, 3):
                extra = 5 * (fault == 3)
                after = 3 if state == 2 else 2
                if initial == ("a" if state == 2 else "u"):
                    offer(new, after, (cost + extra, audit + "K"))
                if initial == "s" and state == 0:
                    offer(new, 1, (cost + extra, audit + "K"))
                offer(new, after, (cost + extra + 1, audit + "R"))
        table = new
        relax(table)
    return min(table[s] for s in (0, 3) if s in table)


@pytest.mark.parametrize("slack", [4, 4096])
def test_long_conversations_and_settling(monkeypatch, slack):
    monkeypatch.setattr(conversations, "_SLACK", slack)
    rng = random.Random(slack)
    for length in (0, 1, 7, 400, 3000):
        for mix in ("ua", "uasx", "s", "x"):
            rows = [(rng.choice(mix), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(length)]
            program, letters = conversations.Repair(), ""
            for row in rows:
                program.row(*row)
                letters += program.settle()
            cost, rest = program.finish()
            assert (cost, letters + rest) == strings(rows)


def test_equal_hashes_are_verified(monkeypatch):
    monkeypatch.setattr(conversations, "_PRIME", 3)  # nearly every pair of lists collides
    rng = random.Random(2)
    for _ in range(60):
        rows = [(rng.choice("uas"), rng.choice([0, 0, 2, 3])) for _ in range(30)]
        program = conversations.Repair()
        for row in rows:
            program.row(*row)
        assert program.finish() == strings(rows)


def test_turns_texts_and_odd_tables(spark):
    long = "word " * 200_000
    table = [(1, 0, "user", long), (1, 1, "assistant", "Fine."), (1, 2, "assistant", "More."), (2, None, None, None)]
    df = spark.createDataFrame([(*r, "clash") for r in table], SCHEMA)
    rows = df.selectExpr("conv_id AS conv", "turn", "role", "text", "true AS present")
    turns = {(r["conv"], r["position"]): (r["edit"], r["role"], r["text"]) for r in conversations.repaired_turns(rows).collect()}
    audit = {r["conv_id"]: r["audit"] for r in conversations.repair(df).collect()}
    assert audit[2] == "D" and audit[1] in ("DDD", "KKD", "KDK", "DRK")
    assert len([k for k in turns if k[0] == 1]) == len(audit[1].replace("D", ""))
    assert conversations.repair(df.limit(0)).count() == 0 and conversations.repaired_turns(rows.limit(0)).count() == 0
    none = df.where("conv_id = 2").selectExpr("conv_id AS conv", "turn", "role", "text", "false AS present")
    assert [tuple(r) for r in conversations.audits(none).collect()] == [(2, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
