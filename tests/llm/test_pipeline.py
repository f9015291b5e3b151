"""The pipeline over a small corpus whose survivors plain Python can tell."""

import collections
import random

import pytest

import corpus_pipeline
from meshweave.llm import packing
from meshweave.llm import queries as registered

from .test_operators import prose


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(20)
    folder = f"file://{tmp_path_factory.mktemp('corpus')}"
    rows, labels, fate = [], [], {}
    for i in range(160):
        junk = i % 4 == 0
        text = "\n".join(prose(rng, 30) for _ in range(3))
        rows.append((i, " ".join(w + "$$$" for w in text.split()) if junk else text))
        labels.append((i, int(not junk), 0))
        fate[i] = None if junk else text
    item = " ".join(f"item{rng.choice('abcdefgh') * 3}{n}" for n in "abcdefghijklmnopqrstuvwxyz")
    rows.append((200, prose(rng, 40) + "\n" + item))  # a leak
    base = [prose(rng, 1) for _ in range(120)]
    rows.append((201, "\n".join(" ".join(base[k : k + 30]) for k in range(0, 120, 30))))
    rows.append((202, " ".join(base[:60] + ["word"] + base[60:])))  # a near copy with other lines
    rows.append((203, rows[1][1]))  # an exact copy: all its lines repeat
    rows.append((204, rows[2][1].split("\n")[0] + "\n" + (own := prose(rng, 50))))
    fate |= {200: None, 201: rows[161][1], 202: None, 203: None, 204: own}
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, fate


def test_stages(spark, corpus):
    folder, fate = corpus
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        docs = after
    got = {r.doc_id: r for r in docs.collect()}
    assert {i: r.text for i, r in got.items()} == {i: t for i, t in fate.items() if t is not None}
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_run_packs_what_survives(spark, corpus):
    folder, fate = corpus
    out = corpus_pipeline.run(spark, folder).toPandas()
    encode = packing.encoder(packing.TOKENIZER)
    want = {i: len(encode(t)) + 1 for i, t in fate.items() if t is not None}
    held = collections.Counter()
    for r in out.itertuples():
        held[r.doc_id] += r.length
    assert dict(held) == want
    assert out.groupby("sequence_id").length.sum().max() <= 1024


def test_rows_of_one_id_are_judged_each(spark, tmp_path):
    rng = random.Random(25)
    a, b, c, item = prose(rng, 60), prose(rng, 60), prose(rng, 60), " ".join(f"item{x}" for x in "abcdefghijklmnopqrstuvwxyz")
    rows = [(1, a), (5, b), (5, a), (7, c), (7, c), (None, a), (None, item), (8, item), (8, prose(rng, 40)), (9, None), (9, "")]
    folder = f"file://{tmp_path}"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    key = lambda df: sorted(((str(r.doc_id), r.text) for r in df.collect()), key=str)
    alone = corpus_pipeline.jaccard_join(spark, docs, folder)
    assert key(alone) == sorted([("1", a), ("5", b), ("7", c), ("8", item), ("8", rows[8][1]), ("9", None), ("9", "")], key=str)
    assert key(corpus_pipeline.decontamination(spark, docs, folder)) == sorted(((str(i), t) for i, t in rows if t != item), key=str)
    clean = corpus_pipeline.line_dedup(spark, docs, folder)
    assert collections.Counter(r.text for r in clean.collect()) == collections.Counter([a, b, c, item, rows[8][1], None, ""])
    assert corpus_pipeline.line_dedup(spark, docs.where("doc_id > 99"), folder).count() == corpus_pipeline.jaccard_join(spark, docs.where("doc_id > 99"), folder).count() == 0


def test_registration():
    assert sorted(registered.queries()) == sorted(f"op{n}_{x}" for n, x in enumerate("packing topk urls decontam lines toxicity jaccard chat warc quality secrets repair trie".split(), 1))
    assert set(registered.oracle_sql()) <= set(registered.queries())
