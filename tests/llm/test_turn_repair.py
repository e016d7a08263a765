import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from tessera.llm import turn_repair as tr

FIELDS = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def whole(rows, most=3):
    """(cost, audit, repaired) by trying every sequence of edits with up to `most` inserts. rows: (role, text, fault)."""
    best = None
    for edits in itertools.product(*[("D",) if f in (1, 2) else ("D", "K", "U", "A") for _, _, f in rows]):
        for k in range(most + 1):
            for places in itertools.combinations_with_replacement(range(len(rows) + 1), k):
                for roles in itertools.product("ua", repeat=k):
                    out, audit, cost = [], "", 0
                    for i in range(len(rows) + 1):
                        for p, r in zip(places, roles, strict=True):
                            if p == i:
                                out.append(({"u": "user", "a": "assistant"}[r], ""))
                                audit, cost = audit + "I", cost + 3
                        if i < len(rows):
                            role, text, fault = rows[i]
                            cost += {"D": 4, "K": 0, "U": 3, "A": 3}[edits[i]] + (3 if fault == 3 and edits[i] != "D" else 0)
                            audit += {"D": "D", "K": "K"}.get(edits[i], "R")
                            if edits[i] != "D":
                                out.append(({"K": role, "U": "user", "A": "assistant"}[edits[i]], text))
                    if re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                        best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in out))
    return best


def onward(rows):
    """(cost, audit, repaired) by a plain recursion over suffixes."""
    closing = [(0, "", []), (6, "II", ["user:", "assistant:"]), (3, "I", ["assistant:"]), (0, "", [])]
    moves = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
    forced, names = (2, 2, 3, 2), ("user", "user", "assistant", "user")
    for role, text, fault in reversed(rows):
        more = 3 if fault == 3 else 0
        now = []
        for s in range(4):
            ways = [(4 + closing[s][0], "D" + closing[s][1], closing[s][2])]
            if fault in (0, 3):
                c = closing[forced[s]]
                ways.append((3 + more + c[0], "R" + c[1], [f"{names[s]}:{text}", *c[2]]))
                if role[:1] in moves[s]:
                    c = closing[moves[s][role[:1]]]
                    ways.append((more + c[0], "K" + c[1], [f"{role}:{text}", *c[2]]))
            now.append(min(ways))
        for _ in range(3):
            now = [min(now[s], (3 + now[forced[s]][0], "I" + now[forced[s]][1], [f"{names[s]}:", *now[forced[s]][2]])) for s in range(4)]
        closing = now
    cost, audit, out = closing[0]
    return cost, audit, "\n".join(out)


def brute(rows, solve=onward):
    """The contract, row by row."""
    out = []
    for conv in {r[0] for r in rows}:
        kept = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = (" " if x is None else x for x in (role, text))
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            role = "user" if kind == 4 else role
            kept += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        seen, faulty = set(), []
        for _, role, text in kept:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faulty.append((role, text, 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0))
            seen.add((role, text))
        turns = [t for t, _, _ in kept if t is not None]
        cost, audit, text = solve(faulty)
        counts = [sum(f == k for _, _, f in faulty) for k in (1, 2, 3)]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:], strict=False))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def made(rng, convs, turns, dense=True):
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(turns) + 1):
            role = rng.choices(["user", "assistant", "system", "tool", "s", None, " "], [8, 8, 2, 1, 1, 1, 1])[0] if rng.random() < 0.5 else ("user", "assistant")[t % 2]
            text = rng.choice(["Yes.", "No!", "So it goes? \n", "cut off", "", "  ", None, f"Line {t}.", f"Line {t}"])
            rows.append((c, t if dense or rng.random() < 0.8 else rng.choice([None, t + 7, t - 1]), role, text))
    return rows


def run(df):
    return sorted((tuple(r) for r in tr.digest(df).select(COLUMNS).collect()), key=repr)


def test_search_by_all_edits():
    rng = random.Random(1)
    for _ in range(60):
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), f"t{i}", rng.choice((0, 0, 0, 1, 3))) for i in range(rng.randrange(5))]
        found = tr.search([(r[:1] if r[:1] in "sua" else "", f) for r, _, f in rows])
        assert found == whole(rows)[:2] == onward(rows)[:2]


def test_search_through_pieces():
    rng = random.Random(2)
    for _ in range(40):
        rows = [(rng.choice("suaua"), rng.choice((0, 0, 0, 0, 1, 3))) for _ in range(rng.randrange(1, 30))]
        now = {0: (0, "")}
        for at in range(0, len(rows), 7):
            ways = [(e, f, w) for e in now for f in range(4) if (w := tr.search(rows[at : at + 7], e, f))]
            now = {f: min((now[e][0] + w[0], now[e][1] + w[1]) for e, g, w in ways if g == f) for f in {f for _, f, _ in ways}}
        assert min((c + 3 * len(tr.CLOSING[s]), a + tr.CLOSING[s]) for s, (c, a) in now.items()) == tr.search(rows)


def test_long_conversation_is_searched_fast():
    rng = random.Random(3)
    rows = [(rng.choice("suat"), rng.choice((0, 0, 1, 3))) for _ in range(1000)]
    rows = [(i if i in "sua" else "", f) for i, f in rows]
    assert tr.search(rows) == onward([(i or "t", "", f) for i, f in rows])[:2]


def test_short_conversations_by_all_edits(spark):
    rows = made(random.Random(4), 25, 4)
    assert run(spark.createDataFrame(rows, FIELDS)) == brute(rows, whole)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_given_conversations(spark, sf):
    df = spark.read.parquet(f"/root/testdata/sf{sf}/conversations.parquet")
    assert run(df) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_sql(spark):
    rows = made(random.Random(5), 60, 9, dense=False) + [(None, t, "user", "Who?") for t in range(5)] + [(900, 3, "user", "Same."), (900, 3, "user", "Same."), (900, 3, "assistant", "Ünïcode – 日本語.")]
    con = duckdb.connect()
    con.register("conversations", spark.createDataFrame(rows, FIELDS).toArrow())
    rel = con.sql(tr.ORACLE_SQL)
    assert sorted(rel.select(", ".join(COLUMNS)).fetchall(), key=repr) == brute(rows) == run(spark.createDataFrame(rows, FIELDS))


def test_hot_conversation_in_pieces(spark, monkeypatch):
    """One conversation with most rows lies across tasks and pieces."""
    rng = random.Random(6)
    hot = [(7, t, rng.choice(["user", "assistant"]), rng.choice([f"Line {t}.", "Again.", "cut"])) for t in range(5000)]
    rows = hot + made(rng, 30, 6)
    monkeypatch.setattr(tr, "PIECE_ROWS", 300)
    rows = [r for r in rows if r[0] != 7] + hot
    df = spark.createDataFrame(rows, FIELDS)
    assert run(df) == brute(rows)
    assert tr.pieces(tr.ordered(tr.damaged(df))).where("not whole").count() > 10


def test_odd_rows(spark, clash):
    rows = [(1, None, None, None), (1, None, "user", "Hello."), (2, 1, "", "Empty role."), (2, 2, "assistant", "Yes."), (None, None, None, None), (3, 5, "user", "long " * 300_000 + "."), (3, 6, "assistant", "x" * 10), (3, 6, "assistant", "x" * 10)]
    df = spark.createDataFrame(rows, FIELDS)
    assert run(clash(df)) == brute(rows)
    assert run(df.where("false")) == []
    dropped = next(t for t in range(1000) if zlib.crc32(f"8:{t}".encode()) % 20 == 0)
    gone = [(8, dropped, "user", "Gone.")]
    assert run(spark.createDataFrame(gone, FIELDS)) == [(8, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
