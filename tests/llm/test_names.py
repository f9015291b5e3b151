"""Columns of any name beside the needed ones: operators and stages neither crash on them nor lose them."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meshweave.llm import jaccard, lines, quality, repair, secrets, topk, toxicity, trie

from .test_operators import prose

#: Names that operators and stages use themselves, and some that only look like it.
NAMES = ["__file", "__row", "__f", "__r", "__drop", "__lines", "__m", "__p", "file", "row", "line_no", "lines", "dropped", "judged", "score", "evidence", "held_out", "predicted", "place", "id", "key", "kind", "class_id", "n_links", "order", "c0", "c1", "v", "ask", "finite", "dim", "conv", "depth", "owner", "branch", "token", "base", "tested", "spans", "_metadata", "Doc_Key"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, folder = random.Random(3), f"file://{tmp_path_factory.mktemp('names')}"
    rows = [(i, "\n".join(prose(rng, 12) for _ in range(3)), 0) for i in range(30)]
    rows += [(30, rows[0][1], 0), (31, None, 0), (32, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    for n, name in enumerate(NAMES):
        docs = docs.withColumn(name, F.lit(f"own {n}"))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, prose(rng, 20))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def kept(df, but=()):
    """Every foreign column has its own value still."""
    row = df.first()
    for n, name in enumerate(NAMES):
        if name not in but:
            assert row[name] == f"own {n}", name


def test_operators_on_documents(spark, corpus):
    docs, labels = spark.read.parquet(f"{corpus}/documents.parquet"), spark.read.parquet(f"{corpus}/labels.parquet")
    out = lines.dedup_lines(docs)
    kept(out, but=("lines", "dropped"))
    assert out.count() == 33 and out.agg(F.sum(F.col("dropped").cast("int"))).first()[0] == 3 and set(out.columns) == set(docs.columns)
    kept(toxicity.detect(docs, labels), but=("score", "evidence", "held_out", "predicted"))
    kept(quality.classify(docs, labels), but=("score", "held_out", "predicted"))
    assert jaccard.similar(docs).count() == 33
    found, held = secrets.scan(docs)
    assert found.count() == 33
    held.drop()


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, corpus)
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes], name
        kept(out)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, corpus).count() > 0


def test_vectors_and_conversations(spark):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(12)], "vec_id long, vector array<double>")
    turns = spark.createDataFrame([(c, t, "user", f"t{t}.") for c in range(4) for t in range(3)], "conv_id long, turn long, role string, text string")
    for n, name in enumerate(NAMES):
        vectors, turns = vectors.withColumn(name, F.lit(n)), turns.withColumn(name, F.lit(n))
    assert topk.top_k(vectors, F.col("vec_id") < 2, 3).count() == 6
    whole, divided, held = repair.repair(turns)
    assert repair.summaries(whole, divided).count() == 4
    held.drop()
    out, held = trie.trie(turns)
    assert out.count() == 4
    held.drop()
