"""Decontamination against plain Python over all pairs of documents and items."""

import os
import random

import pytest
import regex

from meshweave.llm import decontam, queries

S = decontam.Settings()


def template(text):
    numbered = regex.sub(decontam.NUMERAL, f" {decontam.NUMBER} ", text or "")
    measured = regex.sub(rf"(?i)(?<=0 {{1,3}})(?:{'|'.join(decontam.UNITS)})(?![\p{{L}}\p{{M}}])", f" {decontam.UNIT} ", numbered)
    named = regex.sub(decontam.NAMED, f" {decontam.NAME} ", measured).lower()
    return [t for t in regex.split(r"[^\p{L}\p{M}0-2]+", named) if t]


def values(text):
    return regex.findall(rf"[\p{{L}}\p{{M}}]+|{decontam.NUMERAL}", (text or "").lower())


def windows(text):
    t, v = template(text), values(text)
    return [(i, tuple(t[i : i + S.window]), v[i : i + S.window]) for i in range(len(t) - S.window + 1)]


def expected(docs, items):
    slots = (decontam.NUMBER, decontam.NAME, decontam.UNIT)
    bench = {}
    for item, text in items:
        for at, kinds, own in windows(text):
            if sum(k not in slots for k in kinds) >= S.literals:
                bench.setdefault(item, []).append((at, kinds, own))
    aligned = {}
    for doc, text in docs:
        by_kinds = {}
        for pos, kinds, theirs in windows(text):
            by_kinds.setdefault(kinds, []).append((pos, theirs))
        for item, known in bench.items():
            for at, kinds, own in known:
                for pos, theirs in by_kinds.get(kinds, []):
                    hashes, pairs = aligned.setdefault((doc, item, pos - at), (set(), set()))
                    hashes.add(kinds)
                    pairs |= {(k, o, t) for k, o, t in zip(kinds, own, theirs, strict=True) if k in slots}
    matched = {}
    for (doc, item, _), (hashes, pairs) in aligned.items():
        if not pairs or len({(k, o) for k, o, _ in pairs}) >= S.agree * len(pairs):
            matched.setdefault((doc, item), set()).update(hashes)
    out = set()
    for (doc, item), hashes in matched.items():
        size = len({k for _, k, _ in bench[item]})
        if len(hashes) / size >= S.share:
            out.add((doc, item, len(hashes), size))
    return out


def made(seed=8):
    """Questions with other numbers, names and units, or with slots that contradict each other, among prose; long texts, repeats, nulls."""
    rng = random.Random(seed)
    people, places = ["Anna", "Bob", "Carla", "Dmitri"], ["Paris", "Rome", "Oslo"]

    def question(n):
        a, b, p = rng.randrange(2, 90), rng.randrange(2, 90), rng.choice(people)
        return [
            f"When {p} walks {a} km to {rng.choice(places)} and {a} km back, how many km does {p} walk in all on that day?",
            f"A box of {a} red balls and {b} blue balls costs {a} dollars; what is the share of red balls among all balls in it?",
            f"Yesterday {p} gave {rng.choice(people)} {a} apples and took {b} pears, so how many apples were left for {p} then?",
        ][n]

    items = [(n, question(n)) for n in range(3)] + [(3, "Too short 7"), (4, None), (1, "and one more sentence that belongs to the second item of them all")]
    filler = lambda n: " ".join(rng.choice(["river", "Stone", "and", "the", "of", "7", "was", "Ünder", "naïve", "12.5", "kg"]) for _ in range(n))
    docs = [(i, f"{filler(30)}. {question(i % 3)} {filler(20)}") for i in range(40)]
    docs += [(50, question(0).replace("back", "home")), (51, filler(4000) + " " + question(1)), (52, None), (53, ""), (1, question(2)), (None, question(0)), (None, filler(9))]
    docs += [(60, "When Anna walks 5 km to Rome and 8 km back, how many km does Bob walk in all on that day?")]
    return docs, items


def test_against_brute_force(spark, tmp_path):
    docs, items = made()
    spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, item_id int, hash string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, shift int").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [tuple(r) for r in queries.op4_decontam(spark, str(tmp_path)).collect()]
    want = expected(docs, items)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30


def test_tables_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    read = lambda name, key: [(r[key], r["text"]) for r in spark.read.parquet(f"{folder}/{name}.parquet").collect()]
    got = {tuple(r) for r in queries.op4_decontam(spark, folder).collect()}
    assert got == expected(read("documents", "doc_id"), read("benchmark", "item_id"))
