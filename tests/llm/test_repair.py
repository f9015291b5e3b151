"""Conversation repair against brute force over all edits."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from meshweave.llm import queries, repair

SPACE = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Cost, audit and repaired turns: forward over states, the least cost and then the least audit, in plain Python."""
    follow = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def inserted(best):
        again = True
        while again:
            again = False
            for state, (cost, audit, turns) in list(best.items()):
                for role in ("user", "assistant"):
                    to = follow[state].get(role[0])
                    new = (cost + 2, audit + "I", [*turns, (role, "")])
                    if to and (to not in best or new[:2] < best[to][:2]):
                        best[to], again = new, True
        return best

    best = inserted({"": (0, "", [])})
    for (role, text), fault in zip(rows, faults(rows), strict=True):
        after = {}
        for state, (cost, audit, turns) in best.items():
            ways = [(state, cost + 3, "D", [])]
            if fault not in ("blank", "duplicate"):
                late = fault == "truncated"
                ways += [(follow[state].get(role[:1]), cost + late, "K", [(role, text)])]
                ways += [(follow[state].get(r[0]), cost + 2 + late, "R", [(r, text)]) for r in ("user", "assistant")]
            for to, c, letter, more in ways:
                new = (c, audit + letter, [*turns, *more])
                if to is not None and (to not in after or new[:2] < after[to][:2]):
                    after[to] = new
        best = inserted(after)
    return min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])


def expected(rows):
    """rows: (turn, role, text) after damage, in order."""
    said = [(r, t) for _, r, t in rows]
    kinds, turns, found = [r[:1] for r, _ in said], [t for t, _, _ in rows if t is not None], faults(said)
    cost, audit, repaired = cheapest(said)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:], strict=False))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
    return gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, digest


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if harm:
            text = "" if harm == 1 else "".join(c for c in text if c not in ".!?") if harm == 2 else text
            out += [(conv, turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    return out


def by_conversation(rows):
    talks = {}
    for conv, turn, role, text in rows:
        talks.setdefault(conv, []).append((turn, role, text))
    return {c: sorted(t, key=lambda x: (x[0] is not None, x[0] or 0)) for c, t in talks.items()}


def random_rows(seed, talks=60, most=14):
    rng, rows = random.Random(seed), []
    for conv in range(talks):
        for turn in range(rng.randrange(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "User"])
            text = rng.choice([f"Words {rng.randrange(4)}.", f"No end {rng.randrange(3)}", "", " \t\n", None, "What? \n", " ", "Ünï €𝄞!", "x" * 3000 + "."])
            rows.append((conv if conv else None, None if rng.random() < 0.03 and turn == 0 else turn * rng.choice([1, 1, 2]) + 100 * turn, role, text))
    return rows


@pytest.mark.parametrize("rows_a_piece", [3, 1024])
def test_against_brute_force(spark, rows_a_piece):
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in random_rows(rows_a_piece)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole, divided, held = repair.repair(df.repartition(5), rows=rows_a_piece)
    got = {r["conv"]: tuple(r)[1:] for r in repair.summaries(whole, divided).collect()}
    pieces = whole.unionByName(divided).collect()
    held.drop()
    want = {c: expected(t) for c, t in by_conversation(rows).items()}
    assert got == want
    for p in pieces:
        assert sum(x in "KRI" for x in p["audit"]) == len(p["repaired"])


def test_query(spark, tmp_path):
    rows = random_rows(7, 120, 9)
    names = "conv_id long, turn long, role string, text string, part int, nth int, conv string, code string"
    spark.createDataFrame([(*r, 1, 2, "c", "d") for r in rows], names).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.op12_repair(spark, str(tmp_path)).collect()}
    talks = by_conversation(damaged(rows))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: expected(talks[c]) if c in talks else empty for c in {r[0] for r in rows}}


def test_repeats_and_one_long_conversation(spark):
    """A conversation of many pieces, with equal rows and one text that recurs: the same as one piece and as brute force."""
    rng = random.Random(3)
    rows = [(5, t, rng.choice(["user", "assistant"]), rng.choice(["Yes.", f"Turn {t}.", "", f"Turn {t}"])) for t in range(400)] + [(5, 77, "user", "Again.")] * 50
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    found = []
    for n in (16, 1000):
        whole, divided, held = repair.repair(df, rows=n)
        found.append(repair.summaries(whole, divided).collect())
        held.drop()
    assert found[0] == found[1] and len(found[0]) == 1
    got = found[0][0]
    digests = {r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest() for r in {x[1:] for x in rows} for r in [(r[0], r[1], r[2])]}
    ordered = sorted((r[1:] for r in rows), key=lambda r: (r[0], r[1], digests[r]))
    assert tuple(got)[1:] == expected(ordered)


def test_empty_and_null_roles(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    whole, divided, held = repair.repair(empty)
    assert repair.summaries(whole, divided).collect() == []
    held.drop()
    one = spark.createDataFrame([(1, None, None, None), (1, None, None, "Said.")], "conv_id long, turn long, role string, text string")
    whole, divided, held = repair.repair(one)
    got = repair.summaries(whole, divided).collect()[0]
    assert (got["gaps"], got["blank"], got["audit"]) == (0, 1, "DD")
    held.drop()


def test_states_and_ties():
    """The tensor programme alone: what a piece costs from every state to every other is what its turns cost one by one."""
    rng = np.random.default_rng(1)
    codes = [bytes(rng.integers(0, 16, rng.integers(1, 9)).astype(np.uint8)) for _ in range(300)]
    whole = repair.passages([a + b for a, b in zip(codes, codes[1:], strict=False)])
    parts = repair.passages(codes)
    joined = (parts[:-1, :, :, None] + parts[1:, None, :, :]).min(axis=2)
    assert (np.minimum(joined, repair.FAR) == np.minimum(whole, repair.FAR)).all()
