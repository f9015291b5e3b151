"""Exact top-k search by inner product with multi-resolution segment statistics.

Vectors are cut into 1, then 4, then 16 segments of equal length. Within a segment, Cauchy-Schwarz on the parts
around the means bounds a product by means and deviations, len * (m_q * m_c + s_q * s_c), which is the lower bound
of the segment's distance once the norms are taken off. The bounds are summed, coarse to fine; a candidate that
cannot reach a query's k-th best exact score found so far is left out, ties are kept, and survivors are scored
exactly. Queries and candidates meet in blocks of packed rows; each pair of blocks is one group of one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import identified, shared_folder

LEVELS = (1, 4, 16)
QUERY_BLOCK, CANDIDATE_BLOCK, CHUNK = 4096, 16384, 256


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Scaled means and deviations of each row's segments: their products sum to the bound on the inner product."""
    parts = x.reshape(len(x), segments, -1)
    root = math.sqrt(parts.shape[2])
    return np.concatenate([parts.mean(2) * root, parts.std(2) * root], axis=1)


def best(q: np.ndarray, q_rows: np.ndarray, c: np.ndarray, c_rows: np.ndarray, c_ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query row the ids and scores of its k best candidates among the other rows; c_ids ascend."""
    dim = q.shape[1]
    pad = -dim % LEVELS[-1] if dim else LEVELS[-1]
    q, c = (np.pad(x, ((0, 0), (0, pad))) for x in (q, c))
    fine = [(statistics(q, s), statistics(c, s).T) for s in LEVELS]
    slack = 1e-9 * (1 + np.linalg.norm(q, axis=1) * (np.linalg.norm(c, axis=1).max() if len(c) else 0))
    out, place = [], {row: n for n, row in enumerate(c_rows.tolist())}
    for at in range(0, len(q), CHUNK):
        rows = slice(at, min(at + CHUNK, len(q)))
        own = np.array([place.get(row, -1) for row in q_rows[rows].tolist()])
        bound = fine[0][0][rows] @ fine[0][1]
        n = np.arange(bound.shape[0])
        bound[n[own >= 0], own[own >= 0]] = -np.inf
        if bound.shape[1] > 4 * k:  # exact scores of the most hopeful give a floor that the answer cannot be under
            hopeful = np.argpartition(-bound, 2 * k, axis=1)[:, : 2 * k]
            exact = np.einsum("nd,nmd->nm", q[rows], c[hopeful])
            exact[hopeful == own[:, None]] = -np.inf
            floor = -np.partition(-exact, k - 1, axis=1)[:, k - 1] - slack[rows]
        else:
            floor = np.full(len(n), -np.inf)
        alive, columns = bound >= floor[:, None], np.arange(bound.shape[1])
        for stats_q, stats_c in fine[1:]:
            kept = alive.any(0)
            columns, alive = columns[kept], alive[:, kept]
            alive &= stats_q[rows] @ stats_c[:, columns] >= floor[:, None]
        kept = alive.any(0)
        columns, alive = columns[kept], alive[:, kept]
        scores = np.where(alive, q[rows] @ c[columns].T, -np.inf)
        scores[own[:, None] == columns] = -np.inf
        last = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(n), -np.inf)
        for r in n:
            found = np.flatnonzero((scores[r] >= last[r]) & (scores[r] > -np.inf))
            found = found[np.argsort(-scores[r, found], kind="stable")[:k]]
            out.append((c_ids[columns[found]], scores[r, found]))
    return out


def top_k(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "vector") -> DataFrame:
    """query_id, rank (from 1), the candidate's id and score (double) of every query's k best other rows.

    Ties go to the smaller id. Rows with a null id, and vectors that are null or hold null or non-finite components,
    take no part. Rows that repeat an id are candidates each, of each other too, and each asks for itself. Vectors of
    different lengths are not compared. A query with fewer than k candidates gets all of them; an empty table gives no rows.
    """
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    asked = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), is_query.alias("ask"), finite.alias("finite"))
    rows = identified(asked).select("id", F.xxhash64("__file", "__row").alias("row"), "v", "ask").where("id IS NOT NULL AND v IS NOT NULL AND finite")
    shared_folder(vectors.sparkSession)
    rows = rows.withColumn("dim", F.size("v")).checkpoint()
    total, asked = rows.agg(F.count("*"), F.count(F.when(F.col("ask"), 1))).first()
    blocks, ask_blocks = max(1, math.ceil(total / CANDIDATE_BLOCK)), max(1, math.ceil(asked / QUERY_BLOCK))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "row"])
        matrix = np.array(pdf["v"].tolist(), dtype="<f8").reshape(len(pdf), -1)
        return pd.DataFrame({"dim": [int(pdf["dim"].iloc[0])], "block": [int(pdf["block"].iloc[0])], "ids": [pdf["id"].to_numpy("<i8").tobytes()], "places": [pdf["row"].to_numpy("<i8").tobytes()], "matrix": [matrix.tobytes()]})

    def dealt(df: DataFrame, n: int) -> DataFrame:
        return df.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")).groupBy("dim", "block").applyInPandas(packed, "dim int, block int, ids binary, places binary, matrix binary")

    ask = dealt(rows.where("ask"), ask_blocks).select("dim", F.col("block").alias("ask_block"), F.col("ids").alias("ask_ids"), F.col("places").alias("ask_places"), F.col("matrix").alias("ask_matrix"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    met = ask.join(dealt(rows, blocks), ["dim", "block"])

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples():
            q_ids, q_rows, c_ids, c_rows = (np.frombuffer(x, "<i8") for x in (r.ask_ids, r.ask_places, r.ids, r.places))
            q, c = (np.frombuffer(m, "<f8").reshape(len(i), r.dim) for m, i in ((r.ask_matrix, q_ids), (r.matrix, c_ids)))
            out += [(int(a), int(b), ids.tolist(), scores.tolist()) for a, b, (ids, scores) in zip(q_ids, q_rows, best(q, q_rows, c, c_rows, c_ids, k), strict=True) if len(ids)]
        return pd.DataFrame(out, columns=["query_id", "asker", "ids", "scores"])

    found = met.groupBy("dim", "ask_block", "block").applyInPandas(search, "query_id long, asker long, ids array<long>, scores array<double>")
    each = found.select("query_id", "asker", F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("scores").alias("score"))))
    rank = F.row_number().over(Window.partitionBy("query_id", "asker").orderBy(F.desc("score"), "id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
