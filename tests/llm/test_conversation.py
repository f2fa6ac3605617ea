"""Conversation repair against a plain version that tries all edits, one row at a time."""

import hashlib
import random
import zlib
from functools import lru_cache

import numpy as np
import pytest

from tallyform.llm import conversation, queries

SPACE = " \t\n\x0b\x0c\r"
NAMES = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        text = "" if k == 1 else "".join(c for c in text if c not in ".!?") if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def order(row):
    _, turn, role, text = row
    return turn is not None, turn or 0, role, text[:64], hashlib.md5(text.encode()).digest()


def plain(rows):
    """NAMES of one conversation's rows, in order."""
    turns = {r[1] for r in rows if r[1] is not None}
    faults, seen = [], set()
    for _, _, role, text in rows:
        bare = text.strip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    go = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def best(i, state, puts):
        """(cost, letters, roles) of the cheapest edits from row i on; puts bounds rows put in in a row."""
        options = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if puts < 3:
            for c, name in (("u", "user"), ("a", "assistant")):
                if (state, c) in go:
                    cost, letters, done = best(i, go[state, c], puts + 1)
                    options.append((cost + 3, "I" + letters, ((name, ""), *done)))
        if i < len(rows):
            cost, letters, done = best(i + 1, state, 0)
            options.append((cost + 4, "D" + letters, done))
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 * (faults[i] == "truncated")
                ways = [("K", 0, rows[i][2]), ("R", 3, "user"), ("R", 3, "assistant")]
                for letter, price, name in ways:
                    if (state, name[:1]) in go:
                        cost, letters, done = best(i + 1, go[state, name[:1]], 0)
                        options.append((cost + price + extra, letter + letters, ((name, rows[i][3]), *done)))
        return min(options, key=lambda o: o[:2], default=(1 << 30, "", ()))

    cost, letters, done = best(0, "", 0)
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest()
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, letters, sha


def expected(rows):
    left = damaged(rows)
    return {c: plain(sorted((r for r in left if r[0] == c), key=order)) for c in {r[0] for r in rows}}


def made(seed=1, n=120, longest=12):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why", " ", "", "\t\n", "A. ", "B?\x0b", "c" * 100 + ".", "c" * 100 + "!", "é", "x. ", None]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "u"]
    rows = []
    for conv in [None, -5, *range(n)]:
        usual = rng.random() < 0.5
        for i in range(rng.randrange(1, longest)):
            role = ("user", "assistant")[i % 2] if usual else rng.choice(roles)
            turn = rng.choice([None, 3]) if rng.random() < 0.05 else i + rng.choice([0, 0, 0, 1, 7])
            rows.append((conv, turn, role, f"{i}." if usual and rng.random() < 0.7 else rng.choice(texts)))
    dropped = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return rows + rows[:7] + [(dropped, 0, "user", "Hi.")]


SCHEMA = "conv_id long, turn long, role string, text string"


def result(df):
    assert df.columns == NAMES and all(t == "bigint" for c, t in df.dtypes if c not in ("conv_id", "audit", "repaired_sha256"))
    rows = df.collect()
    out = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA + ", pos int, tag string, cost int").repartition(4)


def test_against_all_edits(spark):
    rows = made()
    want = expected(rows)
    got = result(conversation.audit_damaged(frame(spark, rows)))
    for conv in want:
        assert got[conv] == want[conv], (conv, sorted((r for r in damaged(rows) if r[0] == conv), key=order))
    assert got.keys() == want.keys() and any(v[6] == "" for v in want.values()) and {c for v in want.values() for c in v[6]} == set("DIKR")


@pytest.mark.parametrize("bits", [0, 1, 3])
def test_segments_change_nothing(spark, monkeypatch, bits):
    monkeypatch.setattr(conversation, "SEGMENT_BITS", bits)
    monkeypatch.setattr(conversation, "CELLS", 8)
    rows = made(3, 40, 30)
    assert result(conversation.audit_damaged(frame(spark, rows))) == expected(rows)


def test_given_conversations(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(queries.op11_conversation_repair(spark, sf)) == expected(rows)


def test_a_conversation_with_most_rows(spark):
    """30,000 rows of one conversation: the same costs as by the plain recurrence over four states."""
    rng = random.Random(9)
    rows = [(1, i, rng.choice(["user", "assistant", "assistant", "tool"]), f"text {rng.randrange(20_000)}" + rng.choice(["", "."])) for i in range(30_000)] + [(c, 0, "user", "Hi.") for c in range(2, 300)]
    got = {r.conv_id: r for r in conversation.audit(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()}
    seen, codes = set(), []
    for _, _, role, text in rows[:30_000]:
        codes.append(4 * (2 if (role, text) in seen else 0 if text[-1] == "." else 3) + {"u": 1, "a": 2}.get(role[0], 3))
        seen.add((role, text))
    codes = np.array(codes)[:, None]
    lens, accepted = np.array([30_000]), np.array([[0, 1 << 40, 1 << 40, 0]])
    costs = conversation.backward(codes, lens, accepted)
    op, inserted, _, _ = conversation.forward(codes, lens, costs, np.array([0]), np.array([True]))
    assert got[1].cost == costs[0, 0, 0] and len(got) == 299 and all(got[c].audit == ("KI" if c else "") for c in range(2, 300))
    assert got[1].audit == "".join("I" * int(inserted[t, 0]) + (chr(op[t, 0]) if t < 30_000 else "") for t in range(30_001))


def test_repaired_rows(spark):
    rows = [(7, 0, "system", "Be kind."), (7, 1, "user", "Hi."), (7, 2, "user", "Hi."), (7, 3, "assistant", " "), (7, 4, "tool", "Done."), (7, 5, "user", "Bye.")]
    got = [tuple(r)[1:] for r in conversation.repair(frame(spark, rows)).orderBy("step").collect()]
    assert [g[1] for g in got] == list(plain(rows)[6]) and [g[0] for g in got] == list(range(len(got)))
    assert hashlib.sha256("\n".join(f"{r}:{t}" for _, e, r, t in got if e != "D").encode()).hexdigest() == plain(rows)[7]


def test_empty_and_long(spark):
    assert result(conversation.audit_damaged(frame(spark, []))) == {}
    rows = [(1, 1, "user", "x" * 5_000_000), (2, None, None, None), (3, 1, "user", " " * 2_000_000 + "."), (4, None, "user", "a."), (4, None, "assistant", "b.")]
    got = result(conversation.audit_damaged(frame(spark, rows)))
    assert got == expected(rows)
