"""The operators against brute force, exact round trips and held-out accuracy, with nulls, empty texts, ties and repeats."""

import collections
import os
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshweave.llm import chat, decontam, jaccard, lines, packing, quality, topk, toxicity, urls, warc
from meshweave.llm import shared as S

DOCS = "doc_id long, text string, extra int, score string"
WORDS = [a + b for a in "ka lo mi nu re so ti va".split() for b in "ben dor fal gim hup jek".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 9)) * rng.randint(0, 1) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], DOCS)


# --- packing -------------------------------------------------------------------------------------------------------------


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(1)
    rows = [(0, None), (1, ""), (2, prose(rng, 3000)), (90, "a <|endoftext|> b"), (91, "<|endoftext|><|endoftext|> x" * 9), (3, "tie"), (3, "tie"), (None, "no id")] + [(n, prose(rng, rng.randint(1, 200)) + " naïve—ok 😀\n\n it's 12") for n in range(4, 60)]
    out = packing.pack_documents(docs(spark, rows), packing.Limits(1024, 16, 900), with_ids=True).toPandas()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter(tuple(plain.encode(t or "", add_special_tokens=False).ids + [0]) for _, t in rows)
    pieces = collections.defaultdict(list)
    for n, r in enumerate(out.itertuples()):
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        pieces[(r.doc_id, r.doc_tokens)].append((r.start, tuple(ids)))
    whole = collections.Counter()
    for (i, n), parts in pieces.items():
        copies = sum(1 for s, _ in parts if s == 0)
        if copies == 1:
            parts.sort()
            assert [s for s, _ in parts] == list(np.cumsum([0] + [len(x) for _, x in parts])[:-1])
            whole[tuple(v for _, x in parts for v in x)] += 1
        else:
            whole[parts[0][1]] += copies
    assert whole == want
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == list(np.cumsum([0, *g.length])[:-1])
        assert g.length.sum() <= 1024 and len(g) <= 16
        assert g.padded_to.iloc[0] == 1024 or (g.padded_to.iloc[0] & (g.padded_to.iloc[0] - 1)) == 0
        assert g.padded_to.iloc[0] >= g.length.sum()
        assert sum(min(r.start + r.length, r.doc_tokens - 1) - r.start for r in g.itertuples()) <= 900


def test_packing_prompts_bear_no_loss(spark):
    rows = spark.createDataFrame([(n, "word " * 300, 250) for n in range(20)], "doc_id long, text string, prompt int")
    out = packing.pack_documents(rows, packing.Limits(1024, 256, 200), prompt_tokens_col="prompt").toPandas()
    for _, g in out.groupby("sequence_id"):
        assert sum(max(0, min(r.start + r.length, r.doc_tokens - 1) - max(r.start, 250)) for r in g.itertuples()) <= 200
    assert packing.pack_documents(rows.where("doc_id > 99"), prompt_tokens_col="prompt").count() == 0


# --- search --------------------------------------------------------------------------------------------------------------


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    v = np.floor(rng.normal(size=(300, 10)) * 4)
    v[50:90] = v[50]  # ties
    rows = [(n, [float(x) for x in r]) for n, r in enumerate(v)] + [(900, None), (920, [1.0, None]), (940, [float("nan")] * 10), (960, [float("inf")] * 10), (None, [1.0] * 10)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    got = topk.top_k(df, F.col("vec_id") % 20 == 0).toPandas()
    for q in range(0, 300, 20):
        score = v @ v[q]
        want = sorted((n for n in range(300) if n != q), key=lambda n: (-score[n], n))[:20]
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine.vec_id) == want and list(mine.score) == [score[n] for n in want]
    assert set(got.query_id) == set(range(0, 300, 20))
    twice = topk.top_k(spark.createDataFrame([(20, [1.0, 2.0], "a"), (20, [3.0, 1.0], "b"), (3, [1.0, 1.0], "c")], "vec_id long, vector array<double>, row string"), F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in twice) == [(20, 1, 20, 5.0), (20, 1, 20, 5.0), (20, 2, 3, 3.0), (20, 2, 3, 4.0)]
    few = topk.top_k(df.where("vec_id < 5"), F.col("vec_id") % 20 == 0).toPandas()
    assert len(few) == 4
    assert topk.top_k(df.where("vec_id < 0"), F.col("vec_id") % 20 == 0).count() == 0


# --- urls ----------------------------------------------------------------------------------------------------------------


def test_urls(spark):
    rows = [(0, None), (1, "no scheme"), (2, "http://A.example.COM/en/x?q#f"), (3, "http://www.example.com/en/x"), (4, "http://b.net/es/1"), (5, "x://net"), (6, "http://É.com"), (7, "http://bad.org/1")] + [(n, "http://bad.org/x") for n in range(8, 40)] + [(40, "http://good.org#x")]
    pages = spark.createDataFrame([(i, u, None) for i, u in rows], "page_id long, url string, html string")
    outcomes = spark.createDataFrame([(n, 1) for n in range(8, 40)] + [(40, 0), (2, 0)], "page_id long, bad int")
    got = {r.page_id: r for r in urls.judge(pages, outcomes).collect()}
    assert (got[0].host, got[0].path, got[0].verdict) == ("", "", "allow") and got[1].host == ""
    assert (got[2].host, got[2].path, got[2].rule, got[2].verdict) == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert (got[3].rule, got[3].verdict) == ("www.example.com/en/", "allow")
    assert (got[4].rule, got[4].verdict) == ("net/es/", "block") and got[5].rule is None
    assert got[6].host == "É.com" and got[6].rule is None
    assert got[7].verdict == "block" and got[40].verdict == "allow" and got[40].path == ""
    assert urls.judge(pages.where("page_id > 99"), outcomes).count() == 0
    assert {r.verdict for r in urls.judge(pages.where("page_id = 7"), outcomes.where("bad > 5")).collect()} == {"allow"}


# --- decontamination -------------------------------------------------------------------------------------------------------


def test_decontamination(spark):
    item = "A train leaves Paris at 10 o'clock and runs 120 km to reach Lyon before Paris can see the evening come."
    other = "A train leaves Berlin at 7 o'clock and runs 95 km to reach Munich before Berlin can see the evening come."
    wrong = "A train leaves Berlin at 7 o'clock and runs 95 km to reach Munich before Vienna can see the evening come."
    rng = random.Random(3)
    rows = [(0, prose(rng, 80) + ". " + item + " " + prose(rng, 50)), (1, other), (2, prose(rng, 200)), (3, None), (4, ""), (5, item[:30]), (6, other + "\n" + other)]
    items = spark.createDataFrame([(1, item, 0), (2, "too short", 0), (3, None, 0)], "item_id long, text string, extra int")
    strict = decontam.Settings(agree=1.0)
    got = {(r.doc_id, r.item_id) for r in decontam.contamination(docs(spark, rows), items).collect()}
    assert got == {(0, 1), (1, 1), (6, 1)}
    assert decontam.contamination(docs(spark, [(9, wrong)]), items, strict).count() == 0
    assert decontam.contamination(docs(spark, rows), items, decontam.Settings(chunk=3)).count() == 3
    assert decontam.contamination(docs(spark, []), items).count() == 0 and decontam.contamination(docs(spark, rows), items.where("item_id > 9")).count() == 0


def test_templates_and_values_align(spark):
    text = "In Rome 1,200 km and 5kg of Rice; it WAS 3 miles.\nThen İzmir 7."
    r = docs(spark, [(1, text)]).select(decontam.template(F.col("text")).alias("t"), decontam.values(F.col("text")).alias("v")).first()
    assert len(r.t) == len(r.v) and dict(zip(r.v, r.t))["1,200"] == decontam.NUMBER and dict(zip(r.v, r.t))["km"] == decontam.UNIT
    assert dict(zip(r.v, r.t))["rome"] == decontam.NAME and dict(zip(r.v, r.t))["then"] == "then"


# --- lines ---------------------------------------------------------------------------------------------------------------


def test_line_dedup(spark):
    base = "the quick brown fox jumps over the lazy dog near the river bank while seven old ships sail slowly towards the distant northern harbour at dawn and nobody sees them go"
    near = base.replace("lazy", "lazzy")
    rows = [(5, f"Head\n{base}\n\ntail"), (2, f"{near}\nown line"), (3, None), (4, ""), (6, "HEAD\n\n  head\u00a0"), (None, base), (7, base.upper())]
    got = {r.doc_id: r for r in lines.dedup_lines(docs(spark, rows)).collect()}
    assert got[2].text == f"{near}\nown line" and got[5].text == "Head\n\ntail" and got[5].dropped == 1
    assert got[3].text is None and got[4].text == "" and got[6].text == "" and got[6].lines == 3 and got[7].text == ""
    assert got[None].text == ""  # a null id comes last
    assert lines.dedup_lines(docs(spark, [])).count() == 0


def test_rows_that_repeat_an_id_are_judged_each(spark):
    rows = [(1, "alpha beta"), (5, "gamma delta\nepsilon zeta"), (5, "alpha beta\nother words"), (7, "same text here"), (7, "same text here"), (None, "eta theta"), (None, "eta theta")]
    got = sorted((str(r.doc_id), r.text) for r in lines.dedup_lines(docs(spark, rows)).collect())
    assert got == [("1", "alpha beta"), ("5", "gamma delta\nepsilon zeta"), ("5", "other words"), ("7", ""), ("7", "same text here"), ("None", ""), ("None", "eta theta")]


def test_clashing_columns_pass(spark):
    names = ["__file", "kind", "lid", "first", "row", "lines", "a", "key"]
    rows = spark.createDataFrame([(n, "same words in this line\nown" + str(n), *range(len(names))) for n in range(3)], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names[1:]) + ", metadata int")
    got = lines.dedup_lines(rows).orderBy("doc_id").collect()
    assert [r.dropped for r in got] == [0, 2, 2] or [r.dropped for r in got] == [0, 1, 1]
    assert got[0].row == 3 and got[0].lines == 2


def groups_of(texts):
    """Brute force: root of every text under edit similarity of 0.8."""
    size, root = len(texts), list(range(len(texts)))
    for i in range(size):
        for j in range(i):
            most = 0.2 * max(len(texts[i]), len(texts[j])) + 1e-9
            if abs(len(texts[i]) - len(texts[j])) <= most and lines.distance(texts[i], texts[j], int(most)) <= most:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def test_lines_meet_down_to_the_similarity(spark):
    """Production settings against brute force: one line a document, from none to all of the edits that 0.8 allows."""
    rng = random.Random(21)
    texts = []
    for n in (5, 6, 8, 10, 15, 20, 30, 50, 100) * 8:
        base = prose(rng, n).split()
        for share in (0.05, 0.1, 0.15):
            v = list(base)
            for k in rng.sample(range(n), max(1, round(share * n))):
                v[k] = rng.choice(WORDS)
            texts.append(" ".join(v))
        texts.append(" ".join(base))
    root = groups_of(texts)
    drop = {r.doc_id for r in lines.dedup_lines(docs(spark, list(enumerate(texts)))).collect() if r.dropped}
    want = {n for n in range(len(texts)) if root[n] != n}
    assert drop <= want and len(drop) >= 0.97 * len(want) and len(want) > 150


def test_all_lines_of_a_real_table_against_brute_force(spark):
    at = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(at):
        pytest.skip("no test tables")
    table = spark.read.parquet(at).select("doc_id", "text")
    first = {}
    for r in sorted(table.collect(), key=lambda r: r.doc_id):
        for n, line in enumerate((r.text or "").split("\n")):
            if lines.normal(line):
                first.setdefault(lines.normal(line), (r.doc_id, n))
    texts = sorted(first, key=first.get)
    root = groups_of([x for x in texts if len(x) < 3000])
    want = sum(r != n for n, r in enumerate(root))
    total = sum(bool(lines.normal(x)) for r in table.collect() for x in (r.text or "").split("\n"))
    got = lines.dedup_lines(table).agg(F.sum("dropped")).first()[0] - (total - len(texts))
    assert 0.95 * want <= got <= want


def test_short_lines_and_lines_without_blanks_meet(spark):
    chinese = "".join(chr(0x4E00 + 37 * n) for n in range(120))
    same = [("subscribe to our newsletter!", "subscribe to our newsletter."), ("(c) 2019 example corp", "(c) 2020 example corp"), ("read more", "read more."), ("eauque au.", "eauque par."), (chinese, chinese[:50] + "x" + chinese[52:]), ("-" * 40, "-" * 42)]
    other = [("next page", "last page"), ("home", "hope"), ("page 1", "cage 2")]
    rows = [(n, t) for n, t in enumerate(t for pair in same + other for t in pair)]
    drop = {r.doc_id for r in lines.dedup_lines(docs(spark, rows)).collect() if r.dropped}
    assert drop == {2 * n + 1 for n in range(len(same))}


def test_short_lines_meet_exactly():
    rng = random.Random(22)
    texts = sorted({"".join(rng.choice("abc ") for _ in range(rng.randint(1, 14))).strip() or "a" for _ in range(600)})
    met = [set() for _ in texts]
    found, keys, sims = lines.signed(texts, 0.8)
    for n, key in zip(found.tolist(), keys.tolist(), strict=True):
        met[n].add(key)
    size = np.array([len(x) for x in texts])
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            if lines.distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9:
                assert met[i] & met[j]
                assert lines.near(sims[i : i + 1], sims[j : j + 1], size[i : i + 1], size[j : j + 1], lines.Settings())[0]


def test_large_families_lose_no_link(spark, monkeypatch):
    """A key of any size, in one bucket or shed from it, in one block or many, joins the same lines."""
    rng = random.Random(4)
    rows = []
    for f in range(3):
        base = [prose(rng, 1) for _ in range(60)]
        for n in range(40):
            v = list(base)
            for k in rng.sample(range(60), 1 + n % 8):
                v[k] = prose(rng, 1)
            rows.append((100 * f + n, " ".join(v)))
    ask = lambda **x: {r.doc_id for r in lines.dedup_lines(docs(spark, rows), lines.Settings(**x)).collect() if r.dropped}
    want = ask(family=1000)
    assert len(want) > 80
    assert ask(family=3, block=7) == want
    monkeypatch.setattr(lines, "BUCKET_BYTES", 100)
    monkeypatch.setattr(lines, "HOT", 1)
    assert ask(family=3) == want


def test_lines_of_a_large_key_are_sent_once(spark, monkeypatch):
    rng = np.random.default_rng(11)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 7))
    common = " ".join(word() for _ in range(14))
    own = [common + " " + " ".join(word() for _ in range(10)) for _ in range(600)]
    texts = own + [own[k].replace(own[k][-9:-1], "changed", 1) for k in (5, 77, 400)]
    sent, kind = [], type(spark.range(0))

    def seen(self, *args, real=kind.mapInPandas, **names):
        if {"key", "low", "high"} <= set(self.columns):
            sent.append((self.count(), self.select("key", "lid").distinct().count()))
        return real(self, *args, **names)

    monkeypatch.setattr(kind, "mapInPandas", seen)
    gone = {r.doc_id for r in lines.dedup_lines(docs(spark, enumerate(texts))).collect() if r.dropped}
    assert gone == {600, 601, 602}
    assert sent and sent[0][1] > 600 and sent[0][0] == sent[0][1]


def test_shuffle_files_go_when_a_table_is_written(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for k in range(found.size()) if (name := found.apply(k).getName()).startswith("shuffle_")}

    was, held = files(), S.Held()
    cut, n = held.cut(spark.range(1000).repartition(5, "id"), "rows")
    late = time.time() + 20
    while len(files() - was) > 3 and time.time() < late:  # three of the count of the table
        time.sleep(0.2)
    assert n == 1000 and len(files() - was) <= 3 and cut.count() == 1000
    held.drop()


def test_the_crowd_of_a_key_changes_no_link(spark):
    """Two near lines join alone, among unlike lines that share most of their words, and at any family."""
    rng = random.Random(23)
    base = prose(rng, 40).split()
    near = [rng.choice(WORDS) if n in (9, 21, 33) else w for n, w in enumerate(base)]
    assert lines.distance(" ".join(base), " ".join(near)) <= 0.2 * len(" ".join(near))
    crowd = [(10 + n, " ".join([*base, *(rng.choice(WORDS) for _ in range(20))])) for n in range(30)]
    two = [(1, " ".join(base)), (2, " ".join(near))]
    for rows, s in ((two, lines.Settings()), (two + crowd, lines.Settings()), (two + crowd, lines.Settings(family=3))):
        got = {r.doc_id for r in lines.dedup_lines(docs(spark, rows), s).collect() if r.dropped}
        assert 2 in got and 1 not in got


def test_very_long_lines_are_told_quickly():
    rng = random.Random(24)
    words = [rng.choice(WORDS) + str(rng.randint(0, 999)) for _ in range(30_000)]
    other = [rng.choice(WORDS) + str(rng.randint(0, 999)) if rng.random() < 0.05 else w for w in words]
    far = [rng.choice(WORDS) + str(rng.randint(0, 999)) for _ in range(30_000)]
    assert lines.alike(*(lines.spelt(" ".join(x)) for x in (words, other)), 0.8) and not lines.alike(*(lines.spelt(" ".join(x)) for x in (words, far)), 0.8)


def test_lines_with_letters_changed_in_most_words_are_similar():
    rng = random.Random(3)
    for _ in range(100):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(6, 11))) for _ in range(rng.randint(16, 40))]
        # every second word has another letter, and one word has one more, so that the lines share half of their words
        other = [w[:2] + ("q" if w[2] != "q" else "z") + w[3:] if n % 2 else w for n, w in enumerate(words)]
        other[0] = other[0][0] + " " + other[0][1:]
        x, y = " ".join(words), " ".join(other)
        assert lines.distance(x, y) <= 0.2 * max(len(x), len(y))
        assert lines.alike(lines.spelt(x), lines.spelt(y), 0.8)


def test_distance_matches_the_table():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(5)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        d = plain(a, b)
        assert lines.distance(a, b) == d
        for most in range(12):
            told = lines.distance(a, b, most)
            assert told == d if d <= most else told > most


# --- Jaccard -------------------------------------------------------------------------------------------------------------


def brute(rows):
    sets = [set(jaccard.shingles(t or "", 5).tolist()) for _, t in rows]
    links, root = [0] * len(rows), list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and k >= 0.8 * (len(sets[i]) + len(sets[j]) - k) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    least = collections.defaultdict(lambda: 1 << 60)
    for n, r in enumerate(root):
        least[r] = min(least[r], rows[n][0])
    return {i: (least[root[n]], links[n]) for n, (i, _) in enumerate(rows)}


def test_jaccard_matches_brute_force(spark):
    rng = random.Random(7)
    rows = [(900, None), (901, ""), (902, "!!!"), (903, "one two"), (904, "One, two!")]
    for f in range(6):
        base = [prose(rng, 1) for _ in range(80)]
        for n in range(30):
            v = list(base)
            for _ in range(rng.randint(0, 3)):
                v[rng.randrange(80)] = prose(rng, 1)
            rows.append((f * 100 + n, " ".join(v)))
    rows += [(800 + n, prose(rng, 60)) for n in range(20)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.similar(docs(spark, rows)).collect()}
    assert got == brute(rows)


def test_jaccard_edges(spark, monkeypatch):
    rng = random.Random(8)
    base = prose(rng, 100).split()
    rows = [(n, " ".join(base[:n % 7] + ["odd"] + base[n % 7 :])) for n in range(40)] + [(40, rows_text := " ".join(base)), (40, rows_text)]
    monkeypatch.setattr(jaccard, "BLOCK", 4)  # one prefix in many blocks
    got = jaccard.similar(docs(spark, rows)).toPandas()
    want = brute(rows[:40])
    ids = got[got.doc_id < 40]
    links = {i: sum(1 for j, _ in rows if j == 40) for i in range(40)}
    extra = dict(zip(ids.doc_id, ids.n_links))
    assert len(got) == 42 and got.class_id.nunique() == 1 and all(extra[i] >= want[i][1] and extra[i] <= want[i][1] + links[i] for i in extra)
    null = jaccard.similar(docs(spark, [(None, "a b c"), (1, "a b c")])).collect()
    assert {(r.doc_id, r.class_id) for r in null} == {(None, None), (1, 1)}
    assert jaccard.similar(docs(spark, [])).count() == 0


def test_components_with_many_tasks(spark):
    edges = [(n, n + 1) for n in range(0, 50)] + [(100 + n, 100) for n in range(1, 30)] + [(200, 201), (None, 5), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    for size in (500_000, 10):
        got = {r.node: r.root for r in S.components(df, task_edges=size).collect()}
        assert got == {**{n: 0 for n in range(51)}, **{100 + n: 100 for n in range(30)}, 200: 200, 201: 200}


# --- chat ----------------------------------------------------------------------------------------------------------------


def test_rotation(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hello"), (1, 2, "bob", None), (1, 3, None, "hm"), (2, 0, "system", "only"), (1, 3, None, "hm"), (3, 5000, "ann", "late"), (3, 1, "ann", "soon")]
    df = spark.createDataFrame([(*t, 9) for t in turns], "conv_id long, turn long, role string, text string, spans int")
    got = chat.rotate(df).collect()
    by = {(r.conv_id, r.speaker): r for r in got}
    assert set(by) == {(1, "ann"), (1, "bob"), (1, "unknown"), (3, "ann")}
    for r in got:
        assert sum(s.length for s in r.spans) == r.loss_chars
        for s in r.spans:
            assert r.rendered[: s.start].endswith("<|assistant|>\n")
    ann = by[(1, "ann")]
    assert ann.rendered == "<|system|>\nbe kind\n<|assistant|>\nhello\n<|user name=bob|>\n\n<|user name=unknown|>\nhm\n<|user name=unknown|>\nhm\n"
    assert [ann.rendered[s.start : s.start + s.length] for s in ann.spans] == ["hello"]
    assert chat.rotate(df.where("conv_id > 9")).count() == 0


def test_a_long_dialogue_is_rendered_whole(spark):
    rng = random.Random(31)
    said = [(1, 0, "system", "be kind"), (1, 1, "eve", "only once")] + [(1, 7 * n, rng.choice(["ann", "bob"]), f"words {n}") for n in range(1, 3000)]
    got = {r.speaker: r for r in chat.rotate(spark.createDataFrame(said, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {"ann", "bob", "eve"}
    for name, r in got.items():
        head = lambda role: "<|assistant|>" if role == name else "<|system|>" if role == "system" else f"<|user name={role}|>"  # noqa: B023, E731
        assert r.turns == 3001 and r.rendered == "".join(f"{head(x[2])}\n{x[3]}\n" for x in sorted(said, key=lambda x: x[1]))
        assert [r.rendered[s.start : s.start + s.length] for s in r.spans] == [x[3] for x in sorted(said, key=lambda x: x[1]) if x[2] == name]


# --- warc ----------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    long = "<p>" + "é" * 200
    rows = [(3, "http://a", long), (1, "http://b\r\nX: 1", long), (2, None, None), (4, "u", "x" * 99), (5, "u", "x" * 99), (6, "u", "y" * 100), (7, "u", "y" * 100), (None, "u", "y" * 100)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, offset int")
    index = warc.write_archive(pages, f"file://{tmp_path}/w", warc.Settings(file_bytes=300))
    got = {r.page_id: r for r in warc.read_records(index).collect()}
    assert len(got) == 8 and bytes(got[1].payload).decode() == long and got[3].payload is None and got[3].refers_to == 1 and got[3].header_bytes == len(long.encode())
    assert got[7].refers_to == 6 and got[5].record_type == "response" and got[None].record_type == "revisit" and bytes(got[2].payload) == b""
    some = warc.read_records(index.where("page_id IN (1, 5)")).collect()
    assert {r.page_id for r in some} == {1, 5}
    assert warc.round_trip(pages.where("page_id > 99"), f"file://{tmp_path}/none").count() == 0


# --- classifiers -----------------------------------------------------------------------------------------------------------


def labelled(spark, n=300):
    rng = random.Random(9)
    rows, marks = [(9000, None), (9001, "")], []
    for i in range(n):
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        text = prose(rng, rng.randint(20, 60))
        if toxic:
            words = text.split()
            words[rng.randrange(len(words))] = rng.choice(["vexomort", "grubnarl"])
            text = " ".join(words)
        rows.append((i, " ".join(w + "$$$" for w in text.split()) if bad else text))
        marks.append((i, int(not bad), int(toxic)))
    return docs(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), dict((m[0], m) for m in marks)


def test_quality_on_the_held_out_fold(spark):
    d, labels, marks = labelled(spark)
    got = quality.classify(d, labels).collect()
    assert len(got) == 302 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id in marks]
    assert held and all(r.held_out == (quality.crc_fold(r.doc_id, 5) == 0) for r in got)
    assert np.mean([r.predicted == marks[r.doc_id][1] for r in held]) > 0.95
    flipped = labels.withColumn("quality", F.when(quality.fold("doc_id", 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.classify(d, flipped).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-6 for r in got)  # held-out labels have no influence
    none = quality.classify(d, labels.where("doc_id > 99999")).select("score").distinct().collect()
    assert len(none) == 1 and quality.classify(d.where("doc_id < 0"), labels).count() == 0


def test_long_texts_are_read_in_parts():
    text = "word " * 300_000
    assert len(quality.features(text, 18)) > 1_500_000
    assert len(S.word_hashes(text)) == 300_000 and len(set(S.word_hashes(text).tolist())) == 1


def test_toxicity_on_the_held_out_fold(spark):
    d, labels, marks = labelled(spark)
    got = toxicity.detect(d, labels).collect()
    held = [r for r in got if r.held_out and r.doc_id in marks]
    assert held and np.mean([r.predicted == marks[r.doc_id][2] for r in held]) > 0.95
    odd = docs(spark, [(1, "all fine kaben here"), (2, "what a vexomrot that is"), (3, 'they wrote "what a vexomort" and left'), (4, None)])
    lexicon = toxicity.fit(d, labels, F.lit(False), toxicity.Settings())
    assert {"vexomort", "grubnarl"} <= set(lexicon.exact)
    plain, quoted = lexicon.hits("you are a vexomort today"), lexicon.hits('they wrote "you vexomort" today')
    assert not plain[0][3] and quoted[0][3] and lexicon.total(quoted) < lexicon.total(plain)
    assert lexicon.hits("vexomrot")[0][2] and not lexicon.hits("kaben mifal")
    assert len(toxicity.detect(odd, labels).collect()) == 4 and toxicity.detect(odd.where("doc_id > 9"), labels).count() == 0


def test_automaton_matches_plain_distance():
    rng = random.Random(10)
    terms = ["idiot", "stupid", "worthless", "trash"]
    root = toxicity.trie(terms)
    for _ in range(400):
        t = list(rng.choice(terms))
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(t))
            t[k : k + 1] = rng.choice([[], [rng.choice("abt")], [t[k], rng.choice("abt")]])
        word = "".join(t)
        near = [x for x in terms if lines.distance(word, x) <= 1 or any(word == x[:k] + x[k + 1] + x[k] + x[k + 2 :] for k in range(len(x) - 1))]
        assert (toxicity.within_one(word, root) in near) if near else toxicity.within_one(word, root) is None


def test_no_operator_reads_foreign_columns(spark):
    clash = docs(spark, [(1, "a b c d e f g")]).withColumnRenamed("extra", "class_id").withColumn("key", F.lit(1)).withColumn("content", F.lit("x"))
    assert jaccard.similar(clash).count() == 1 and packing.pack_documents(clash).count() == 1 and lines.dedup_lines(clash).count() == 1
