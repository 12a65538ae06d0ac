import functools
import hashlib
import random
import zlib

import pytest

from tallyspark.llm import conversation_repair as C
from tallyspark.llm.queries import repaired_conversations

SCHEMA = "conv_id long, turn long, role string, text string, codes string, At int, state string"
WS = " \t\n\x0b\f\r"


def conversations(seed=3, n=60):
    r = random.Random(seed)
    rows = []
    for conv in range(n):
        roles = (["system"] if r.random() < 0.3 else []) + ["user", "assistant"] * r.randint(0, 5)
        for turn, role in enumerate(roles):
            role = r.choice(["user", "assistant", "system", "tool", "", None]) if r.random() < 0.2 else role
            text = r.choice(["Yes.", "No!", "cut off", " \n", "", None, "Why? \t", "é?"]) if r.random() < 0.4 else f"say {r.random()}."
            rows.append((conv, None if r.random() < 0.05 else turn + r.randint(0, 1) * r.randint(0, 3), role, text))
    rows += r.sample(rows, 12)  # repeated rows
    rows += [(None, t, "user", f"x{t}.") for t in range(4)] + [(900, None, None, None)] * 3
    rows += [(901, t, r.choice(["user", "assistant", "system"]), f"{t % 40}" + r.choice(["", ".", "?"])) for t in range(700)]  # a hot one
    rows += [(902, 1, "user", "Same.")] * 50 + [(902, 2, "assistant", "word " * 20_000 + ".")]
    return rows


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        role = "user" if fate == 4 else role
        text = "" if fate == 1 else "".join(c for c in text if fate != 2 or c not in ".!?")
        out += [(conv, turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def best(rows):
    """Cheapest repair by a plain recursion over rows and states that carries (cost, audit, lines)."""

    @functools.cache
    def go(i, state):
        options = []
        if i == len(rows):
            if state in ("", "a"):
                options.append((0, "", ()))
        else:
            role, text, fault = rows[i]
            options.append(plus(go(i + 1, state), 2, "D"))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                for to, cost, letter in [(role, 0, "K"), ("user", 1, "R"), ("assistant", 1, "R")]:
                    if to and (state, to[0]) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                        options.append(plus(go(i + 1, to[0]), cost + more, letter, f"{to}:{text}"))
        # A long run of insertions is never cheapest; two always end in an accepting state.
        if state != "a":
            to = {"": "user", "s": "user", "u": "assistant"}[state]
            options.append(plus(go(i, to[0]), 5, "I", f"{to}:"))
        else:
            options += [plus(x, 5, "I", "user:") for x in after_user(i)]
        return min(options, key=lambda o: o[:2])

    @functools.cache
    def after_user(i):
        if i == len(rows):
            return []
        role, text, fault = rows[i]
        found = [plus(x, 2, "D") for x in after_user(i + 1)]
        if fault not in ("blank", "duplicate"):
            more = 5 if fault == "truncated" else 0
            if role[:1] == "a":
                found.append(plus(go(i + 1, "a"), more, "K", f"{role}:{text}"))
            found.append(plus(go(i + 1, "a"), 1 + more, "R", f"assistant:{text}"))
        return sorted(found, key=lambda o: o[:2])[:1]

    def plus(x, cost, letter, line=None):
        return x[0] + cost, letter + x[1], x[2] if line is None else (line, *x[2])

    for i in range(len(rows), -1, -1):  # from the end, so that no recursion is deep
        after_user(i)
        for state in ("a", "u", "s", ""):
            go(i, state)
    return go(0, "")


def brute(rows, broken):
    out = []
    for conv in {r[0] for r in rows}:
        mine = sorted((t is not None, t or 0, role, text) for c, t, role, text in broken if c == conv)
        seen, marked, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        for _, _, role, text in mine:
            end = text.rstrip(WS)[-1:]
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "" if end in ".!?" else "truncated"
            seen.add((role, text))
            count[fault] += 1
            marked.append((role, text, fault))
        turns = [t for known, t, *_ in mine if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
        cost, audit, lines = best(marked)
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [256, 3, 1])
def test_repairs_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(C, "CHUNK", chunk)
    rows = conversations(n=60 if chunk > 1 else 6)
    if chunk == 1:  # every vector is stitched
        rows = [r for r in rows if r[0] != 901 or r[1] < 16]
    df = spark.createDataFrame([(*r, "c", 1, "s") for r in rows], SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in repaired_conversations(df).collect()), key=str)
    assert got == brute(rows, damage(rows))


def test_conversations_without_damage(spark):
    rows = conversations(seed=9, n=25)
    df = spark.createDataFrame([(*r, "c", 1, "s") for r in rows], SCHEMA).repartition(3)
    plain = [(c, t, " " if a is None else a, " " if b is None else b) for c, t, a, b in rows]
    assert sorted((tuple(r) for r in C.repaired(df).collect()), key=str) == brute(rows, plain)


def test_nothing_left_and_empty_tables(spark):
    gone = next(t for t in range(100) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(7, gone, "user", "Hi.", "", 0, "")], SCHEMA)
    assert [tuple(r) for r in repaired_conversations(df).collect()] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
    assert repaired_conversations(df.limit(0)).count() == 0


def test_fix_up_stops_where_vectors_differ_by_a_constant():
    r = random.Random(1)
    import numpy as np

    syms = np.array([[r.randrange(12) for _ in range(50)] for _ in range(40)])
    old, new = (np.array([[r.randrange(20) for _ in range(4)] for _ in range(40)]) for _ in range(2))
    start = C.normal(C.backward(syms, old)[0])
    assert (C.fixed_up(syms, old, start, new) == C.normal(C.backward(syms, new)[0])).all()
