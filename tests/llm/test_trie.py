"""The conversation prefix trie against a plain trie."""

import hashlib
import random
import zlib

import pytest

from meshweave.llm import queries, trie


def sequences(rows):
    talks = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            talks.setdefault(conv, []).append((turn is not None, turn or 0, role, digest, text))
    return {c: [(x[2], x[4]) for x in sorted(t)] for c, t in talks.items()}


def forked(talks):
    out = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = talks.get(c - c % 20, [])[:h] + own[h:]
    return out


def expected(talks):
    members, ends = {}, {}
    for c, said in talks.items():
        for d in range(len(said) + 1):
            members.setdefault(tuple(said[:d]), []).append(c)
        ends.setdefault(tuple(said), []).append(c)
    children, out = {}, {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        words = len(node[-1][1].encode().split()) if node else 0
        leaves[node] = sum(leaves[x] for x in below) or 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[x] for x in below)
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
        out[(min(members[node]), len(node))] = (parent, len(members[node]), len(below), leaves[node], saved[node], digest)
    return out


def found(df):
    rows = df.collect()
    got = {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in rows}
    assert len(got) == len(rows)
    return got


def random_rows(seed, talks=90):
    """Conversations that branch from each other at all depths, copies of each other, empty texts and null turns."""
    rng, known, rows = random.Random(seed), [[]], []
    for conv in range(talks):
        old = rng.choice(known)
        said = old[: rng.randrange(len(old) + 1)] + [(rng.choice(["user", "assistant", None, "system"]), rng.choice(["a b  c", "Hello\tthere", "", None, "Ünï €", "x y", "long " * 50])) for _ in range(rng.randrange(0, 5))]
        known.append(said)
        rows += [(conv, None if t == 0 and rng.random() < 0.2 else t, r, x) for t, (r, x) in enumerate(said)]
    return rows


NAMES = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("bits", "rows_a_piece"), [(64, 1024), (1, 3), (3, 2)])
def test_against_plain_trie(spark, bits, rows_a_piece):
    """With few bits many different prefixes have equal fingerprints: verification splits them."""
    rows = random_rows(bits)
    df = spark.createDataFrame(rows, NAMES).repartition(6)
    out, held = trie.trie(df, rows=rows_a_piece, bits=bits)
    assert found(out) == expected(sequences(rows))
    held.drop()


def test_deep_nesting_and_long_paths(spark, monkeypatch):
    """Each conversation goes one turn further than the one before, then another way; blocks of depths are short."""
    monkeypatch.setattr(trie, "BLOCK", 5)
    rows = [(c, t, "user", f"t{t}" if t < c else f"own {c} {t}") for c in range(23) for t in range(c + 3)]
    out, held = trie.trie(spark.createDataFrame(rows, NAMES).repartition(4), rows=4)
    assert found(out) == expected(sequences(rows))
    held.drop()


def test_query(spark, tmp_path):
    rows = random_rows(11, 130) + [(None, 0, "user", "lost"), (7, 900, "user", "again"), (7, 900, "user", "again"), (7, 900, "assistant", "tie")]
    rows = [r for r in rows if r[0] != 40]  # lends nothing
    spark.createDataFrame([(*r, 1, "x", "y") for r in rows], NAMES + ", depth int, owner string, conv string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = found(queries.op13_trie(spark, str(tmp_path)))
    assert got == expected(forked(sequences(rows)))


def test_empty(spark):
    out, held = trie.trie(spark.createDataFrame([], NAMES))
    assert out.collect() == []
    held.drop()
