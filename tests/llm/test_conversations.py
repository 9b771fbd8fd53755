import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from gradespark.llm import conversations
from gradespark.llm.conversations import audits, damage, digests, repaired

SCHEMA = "conv_id long, turn long, role string, text string, audit string, kind int, gone int, message string"


def broken(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if hit:
            row = (conv, turn, "user" if hit == 4 else role, "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text)
            out += [row] * (2 if hit == 3 else 1)
    return out


def brute(rows):
    """The contract for the rows of one conversation: all edits by recursion, the least by cost and then by letters."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3][:64].encode(), hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()))
    seen, kinds = set(), []
    for _, _, role, text in rows:
        left = text.rstrip(conversations.BLANKS)
        kinds.append("blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else "")
        seen.add((role, text))
    moves = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    @cache
    def best(i, state, inserted):
        options = []
        if i == len(rows) and state in (0, 3):
            options.append((0, "", ()))
        if i < len(rows):
            cut = kinds[i] == "truncated"
            options += [(3 + c, "D" + a, lines) for c, a, lines in [best(i + 1, state, 0)]]
            if kinds[i] not in ("blank", "duplicate"):
                for initial, to in moves[state].items():
                    if rows[i][2][:1] == initial:
                        options += [(cut + c, "K" + a, (f"{rows[i][2]}:{rows[i][3]}", *lines)) for c, a, lines in [best(i + 1, to, 0)]]
                    if initial != "s":
                        role = {"u": "user", "a": "assistant"}[initial]
                        options += [(2 + cut + c, "R" + a, (f"{role}:{rows[i][3]}", *lines)) for c, a, lines in [best(i + 1, to, 0)]]
        if inserted < 3:
            for initial, to in moves[state].items():
                if initial != "s":
                    role = {"u": "user", "a": "assistant"}[initial]
                    options += [(2 + c, "I" + a, (f"{role}:", *lines)) for c, a, lines in [best(i, to, inserted + 1)]]
        return min(options, default=(10**9, "", ()))

    cost, audit, lines = best(0, 0, 0)
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), lines


def sample(seed, n=90):
    rng = random.Random(seed)
    texts = ["a.", "b!", "c", "", " \t\n", "d?\x0b ", "e.  ", " ", "x" * 70 + "1.", "x" * 70 + "2.", "é\U0001f600."]
    roles = ["user", "assistant", "system", "", "tool", "agent", "User", "s", None]
    rows = []
    for conv in [*range(n), None]:
        turns = list(range(rng.randrange(0, 9)))
        for t in turns:
            rows.append((conv, t, rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[t % 2], rng.choice([*texts, None, f"{conv} {t}."])))
            if rng.random() < 0.2:
                rows.append((conv, rng.choice([t, None, t + 3]), rng.choice(roles), rng.choice(texts)))
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "K", 1, 1, "m") for r in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize("seed, damaged, sealed", [(1, True, 65536), (2, False, 3)])
def test_equals_brute_force(spark, monkeypatch, seed, damaged, sealed):
    monkeypatch.setattr(conversations, "SEALED", sealed)
    rows = sample(seed)
    after = broken(rows) if damaged else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    df = frame(spark, rows)
    df = damage(df) if damaged else df
    got = digests(df, **({"gone_col": "gone"} if damaged else {})).collect()
    assert len(got) == len({r[0] for r in rows})
    for r in got:
        assert tuple(r)[1:] == brute([x for x in after if x[0] == r.conv_id])[0], r


def test_repaired_rows(spark):
    rows = [(7, 0, "user", "hello."), (7, 1, "user", "more"), (7, 4, "assistant", "yes."), (7, 5, "assistant", "yes."), (8, None, "system", "be kind.")]
    df = frame(spark, rows)
    found = audits(df)
    assert {r.conv_id: (r.audit, r.cost, r.gaps, r.duplicate, r.truncated, r.illegal) for r in found.collect()} == {
        7: ("KDKD", 6, 2, 1, 1, 2), 8: ("D", 3, 0, 0, 0, 0)}
    got = [tuple(r) for r in repaired(df, found).orderBy("conv_id", "position").collect()]
    assert got == [(7, 0, "K", 0, "user", "hello."), (7, 1, "K", 4, "assistant", "yes.")]
    one = frame(spark, [(1, 3, "system", "s."), (1, 9, "assistant", "a.")])
    assert [tuple(r) for r in repaired(one, audits(one)).orderBy("position").collect()] == [
        (1, 0, "K", 3, "system", "s."), (1, 1, "I", None, "user", ""), (1, 2, "K", 9, "assistant", "a.")]


def test_empty_table_and_lost_conversations(spark):
    assert digests(frame(spark, [])).collect() == []
    lost = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    got = digests(damage(frame(spark, [(5, lost, "user", "x.")])), gone_col="gone").collect()
    assert [tuple(r) for r in got] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_giant_conversation_of_copies(spark, monkeypatch):
    """Many batches and sealed blocks; one text is most of it, another one is very long."""
    monkeypatch.setattr(conversations, "SEALED", 500)
    rows = [(1, t, ("user", "assistant")[t % 2], "same." if t % 3 else f"{t}.") for t in range(6000)] + [(1, 6000, "user", "long" * 300_000)]
    got = digests(frame(spark, rows)).first()
    seen, want = set(), 0
    for _, _, role, text in rows:
        want += (role, text) in seen
        seen.add((role, text))
    assert got.duplicate == want and got.truncated == 1 and len(got.audit) >= len(rows)
    left = [r for r in got.audit if r != "D"]
    assert len(left) % 2 == 0
