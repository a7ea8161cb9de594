"""Repair of chats against a plain search over all edits."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from mesograph.llm import conversations
from mesograph.llm.queries import damaged

FIRST = re.compile(r"(s?(ua)+)?\Z")


def plain_repair(rows):
    """Cheapest edits by a table of full audit strings: (cost, audit, lines) per state after each row; a state is the text of the initials so far, cut to what matters."""
    def allowed(state, initial):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, initial))

    def widen(table):
        out = dict(table)
        for _ in range(4):
            for state, (cost, audit, lines) in list(out.items()):
                for role in ("user", "assistant"):
                    after = allowed(state, role[0])
                    if after:
                        new = (cost + 3, audit + "I", lines + [f"{role}:"])
                        if after not in out or new[:2] < out[after][:2]:
                            out[after] = new
        return out

    faults, seen = [], set()
    for role, text in rows:
        fault = ""
        if not re.search(r"[^\x20\x09-\x0D]", text):
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        elif not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text):
            fault = "truncated"
        seen.add((role, text))
        faults.append(fault)
    table = {"": (0, "", [])}
    for (role, text), fault in zip(rows, faults):
        table, before = {}, widen(table)
        extra = 3 if fault == "truncated" else 0
        for state, (cost, audit, lines) in before.items():
            options = [(state, cost + 4, "D", [])]
            if fault not in ("blank", "duplicate"):
                options += [(allowed(state, role[:1]), cost + extra, "K", [f"{role}:{text}"])]
                options += [(allowed(state, r[0]), cost + 3 + extra, "R", [f"{r}:{text}"]) for r in ("user", "assistant")]
            for after, price, letter, line in options:
                if after is not None:
                    new = (price, audit + letter, lines + line)
                    if after not in table or new[:2] < table[after][:2]:
                        table[after] = new
    end = widen(table)
    cost, audit, lines = min((end[s] for s in ("", "a") if s in end), key=lambda x: x[:2])
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(rows, rows[1:])]
    return {"blank": faults.count("blank"), "duplicate": faults.count("duplicate"), "truncated": faults.count("truncated"), "illegal": sum(p not in ("su", "ua", "au") for p in pairs),
            "cost": cost, "audit": audit, "sha": hashlib.sha256("\n".join(lines).encode()).hexdigest(), "lines": lines}


def random_chats(n, longest, seed=1):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "user", "assistant", "", "System"]
    texts = ["Yes.", "No!", "cut", "Is it? ", " \t", "", "What?\n", "end ", " ", "a.b"] + [f"text {i}." for i in range(6)]
    return {c: [(rng.choice(roles), rng.choice(texts)) for _ in range(rng.randint(1, longest))] for c in range(n)}


def test_repair_equals_plain_search(spark):
    chats = random_chats(400, 14) | {1000 + c: rows for c, rows in random_chats(3, 900, 2).items()}
    rows = [(c, None if k % 7 == 0 and k < 1 else k, r, t, "x", 1.0) for c, chat in chats.items() for k, (r, t) in enumerate(chat)]
    random.Random(3).shuffle(rows)
    table = spark.createDataFrame(rows, "chat_id long, turn long, role string, content string, chat string, part double")
    small, conversations.PIECE = conversations.PIECE, 16  # long chats in many pieces
    try:
        repair = conversations.repair_chats(table)
        found = {r.chat: r for r in repair.summary().join(conversations.repaired_digests(repair), "chat", "left").collect()}
        lines = repair.messages().orderBy("chat", "part", "slot", "at").collect()
    finally:
        conversations.PIECE = small
    assert found.keys() == chats.keys()
    made = {}
    for r in lines:
        made.setdefault(r.chat, []).append(f"{r.role}:{r.content}")
    for c, chat in chats.items():
        want = plain_repair(chat)
        got = found[c]
        assert {k: got[k] for k in ("blank", "duplicate", "truncated", "illegal", "cost", "audit")} == {k: want[k] for k in ("blank", "duplicate", "truncated", "illegal", "cost", "audit")}, c
        assert (got.repaired_sha256 or hashlib.sha256(b"").hexdigest()) == want["sha"]
        assert made.get(c, []) == want["lines"]
        assert re.match(FIRST, "".join(x[:1] for x in made.get(c, [])))
    repair.discard()


def test_gaps_nulls_ties_and_empty_tables(spark):
    low, high = -2 ** 63, 2 ** 63 - 1
    rows = [("a", 1, "user", "x."), ("a", 5, "assistant", "y."), ("a", 5, "assistant", "y."), ("b", None, "user", "x."), ("b", None, None, None), (None, 3, "user", None), (None, 4, "user", "z."),
            ("c", low, "user", "x."), ("c", high, "assistant", "x."), ("d", 2, "assistant", "b."), ("d", 2, "user", "a.")]
    table = spark.createDataFrame(rows, "chat_id string, turn long, role string, content string")
    repair = conversations.repair_chats(table)
    got = {r.chat: r for r in repair.summary().collect()}
    assert {c: r.gaps for c, r in got.items()} == {"a": 3, "b": 0, None: 0, "c": None, "d": 0}
    assert (got["a"].audit, got["a"].cost, got["a"].duplicate, got["a"].illegal) == ("KKD", 4, 1, 1)
    assert (got["b"].audit, got["b"].cost, got["b"].blank) == ("DKI", 7, 1)
    assert (got[None].audit, got[None].cost) == ("DKI", 7)
    assert (got["d"].audit, got["d"].cost) == ("IKKI", 6) and got["c"].audit == "KK"
    assert conversations.repair_chats(table.limit(0)).summary().count() == 0


def test_grammar_is_shared_and_runs_are_short():
    strings = ["ua" * 500, "D" * 4000, "ua" * 250 + "D" * 100, "s", "uUaAoOD"]
    rules, rest = conversations.repair_pairs(strings)
    assert len(rules) < 60 and sum(map(len, rest)) < 60

    def spelled(symbol):
        return conversations.SYMBOLS[symbol] if symbol < len(conversations.SYMBOLS) else "".join(map(spelled, rules[symbol - len(conversations.SYMBOLS)]))

    assert ["".join(map(spelled, symbols)) for symbols in rest] == strings
    plain = conversations.string_matrices(["D" * 4000])[0]
    assert {k: (c, conversations.rope_text(r)[:3], len(r)) for k, (c, r) in plain.items() if k[0] == k[1] == 0} == {(0, 0): (16000, "DDD", 4000)}


def test_damage_covers_all_kinds(spark):
    rows = [(c, t, "assistant", "One. Two! Three? four") for c in range(40) for t in range(10)] + [(None, None, None, None)]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = damaged(given).groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"), F.min("role").alias("role"), F.min("text").alias("text"))
    got = {(r.conv_id, r.turn): (r.n, r.role, r.text) for r in out.collect()}
    import zlib

    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role or " ", text or " "
        want = {0: None, 1: (1, role, ""), 2: (1, role, re.sub("[.!?]", "", text)), 3: (2, role, text), 4: (1, "user", text)}.get(kind, (1, role, text))
        assert got.get((conv, turn)) == want
