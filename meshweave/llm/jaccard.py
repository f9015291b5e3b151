"""N-gram Jaccard join by bands of MinHash signatures and exact verification.

A text is the set of its five-word shingles. Texts with equal sets are one class. Every class has one MinHash
signature of several trees, and classes that share a tree's prefix are candidates. The prefix's length is the longest at
which the expected recall at the threshold reaches the target: it follows from the settings and is the same for all texts,
where a forest would shorten it text by text until it has enough neighbours, which a join at one threshold does not need.
Prefixes of one member, and prefixes all of whose members share one in an earlier tree already, go.
The rest are verified on the shingles in blocks of at most BLOCK by BLOCK members, a pair in the first tree it
shares only, so a prefix of any size is many small tasks, and only sums and a spanning forest leave them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import RADIX, Held, bounded, components, mix64, shared_folder, tidy, word_hashes, written

#: A block has at most about so many members and, together, shingles.
BLOCK, WEIGHT = 256, 200_000


@dataclass(frozen=True)
class Settings:
    """width: words a shingle; threshold: least Jaccard similarity; trees and depth of the forest; recall: target at the threshold."""

    width: int = 5
    threshold: float = 0.8
    trees: int = 16
    depth: int = 8
    recall: float = 0.9995
    seed: int = 5
    broadcast_rows: int = 200_000

    def prefix(self) -> int:
        """The longest prefix at which the trees together reach the target."""
        return next((d for d in range(self.depth, 0, -1) if 1 - (1 - self.threshold**d) ** self.trees >= self.recall), 1)


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes; a text of fewer words is one shingle of all of them, one without words has none."""
    w = word_hashes(text.lower())
    if not len(w):
        return w
    n = max(1, len(w) - width + 1)
    h = np.full(n, np.uint64(min(len(w), width)))
    for k in range(min(width, len(w))):
        h = mix64(h * np.uint64(RADIX) + w[k : k + n])
    return np.unique(h)


def prefixes(s: np.ndarray, multipliers: np.ndarray, trees: int, length: int) -> np.ndarray:
    """For every tree a hash of the first minima of the set."""
    least = np.full(trees * length, np.iinfo(np.uint64).max)
    for at in range(0, len(s), 4096):
        np.minimum(least, mix64(s[at : at + 4096, None] * multipliers[0] + multipliers[1]).min(0), out=least)
    key = np.zeros(trees, dtype=np.uint64)
    for k in range(length):
        key = mix64(key * np.uint64(RADIX) + least.reshape(trees, length)[:, k])
    return key.view(np.int64)


def content(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def verify(sets: list[np.ndarray], side: np.ndarray, within: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (side 0 with side 1, or all with all) whose Jaccard similarity reaches the threshold."""
    n = np.array([len(s) for s in sets])
    rows = np.repeat(np.arange(len(sets)), n)
    distinct, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1  # a shingle of one row is in no intersection
    shared = times[at] > 1
    rows, columns = rows[shared], column[at[shared]]
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    width = 4096
    for start in range(0, int(columns[-1]) + 1 if len(columns) else 0, width):
        low, high = np.searchsorted(columns, [start, start + width])
        x = np.zeros((len(sets), width), dtype=np.float32)
        x[rows[low:high], columns[low:high] - start] = 1
        common += x @ x.T
    close = common >= threshold * (n[:, None] + n[None, :] - common) - 1e-6
    a, b = np.nonzero(np.triu(close, 1))
    return (a, b) if within else (a[side[a] != side[b]], b[side[a] != side[b]])


def similar(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, class_id, n_links for every row: the least id of its group of linked texts, and how many other rows have a text at least threshold similar to its own, copies included.

    Null and empty texts, and texts without any word, have no links and are classes of their own. A null id has null
    class and links. Rows that repeat an id are counted each. A similarity equal to the threshold links. An empty
    table gives no rows. Texts are read whole; other columns, of whatever name, are not read, but for those named in also,
    numbers without nulls, which pass through.
    """
    spark = docs.sparkSession
    shared_folder(spark)
    length = s.prefix()
    rng = np.random.default_rng(s.seed)
    multipliers = rng.integers(0, 1 << 63, size=(2, s.trees * length), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).cast("long").alias(f"also_{c}") for c in also])

    def sign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for text in pdf["text"]:
                found = shingles(text or "", s.width)
                out.append((content(found), prefixes(found, multipliers, s.trees, length), len(found)) if len(found) else (None, None, 0))
            yield pd.DataFrame({"id": pdf["id"].astype("Int64"), "content": [x[0] for x in out], "keys": [x[1] for x in out], "size": [x[2] for x in out], **{f"also_{c}": pdf[f"also_{c}"] for c in also}})
        tidy()

    held = Held()
    signed, _ = written(rows.mapInPandas(sign, "id long, content binary, keys array<long>, size long" + "".join(f", also_{c} long" for c in also)), "jaccard-signed")
    classes = signed.where("content IS NOT NULL AND id IS NOT NULL").groupBy("content").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("keys").alias("keys"), F.first("size").alias("size"))
    classes, _ = held.keep(classes)

    # Prefixes of several classes, then without those that an earlier tree has whole.
    each = classes.select("content", "rep", "copies", "size", "keys", F.posexplode("keys").alias("tree", "key"))
    several = classes.select("size", F.posexplode("keys").alias("tree", "key")).groupBy("tree", "key").agg(F.count("*").alias("members"), F.sum("size").alias("weight")).where("members > 1")
    met, _ = held.keep(each.join(bounded(held.keep(several), s.broadcast_rows), ["tree", "key"]))
    ends = met.groupBy("tree", "key").agg(F.first("members").alias("members"), *[x for n in range(s.trees) for x in (F.min(F.col("keys")[n]).alias(f"low{n}"), F.max(F.col("keys")[n]).alias(f"high{n}"))])
    told = F.lit(False)
    for n in range(s.trees):
        told = told | ((F.col("tree") > n) & (F.col(f"low{n}") == F.col(f"high{n}")))
    needed = held.keep(ends.where(~told).select("tree", "key"))
    members = met.join(bounded(needed, s.broadcast_rows), ["tree", "key"])

    wanted = held.keep(members.select(F.col("rep").alias("id"), F.col("content").alias("wanted")).distinct())
    texts = rows.join(bounded(wanted, s.broadcast_rows), "id")

    def spell(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            sets = [shingles(t or "", s.width) for t in pdf["text"]]
            kept = [content(x) == w for x, w in zip(sets, pdf["wanted"], strict=True)]  # an id may repeat with another text
            yield pd.DataFrame({"content": pdf["wanted"][kept], "shingles": [x.tobytes() for x, k in zip(sets, kept, strict=True) if k]})

    spelt = texts.mapInPandas(spell, "content binary, shingles binary").dropDuplicates(["content"])
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.least(F.col("members") / 1.0, F.col("weight") / WEIGHT))).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("content"), F.col("blocks")).cast("int"))
    dealt = dealt.join(spelt, "content").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("tree", "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rep", "copies", "keys", "shingles")

    def link(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree, _, low, high = key
        pdf = pdf.sort_values("rep")
        a, b = verify([np.frombuffer(x, np.uint64) for x in pdf["shingles"]], (pdf["block"] != low).to_numpy(), low == high, s.threshold) if len(pdf) > 1 else (np.zeros(0, int),) * 2
        keys, copies, reps = np.stack(pdf["keys"].to_numpy()), pdf["copies"].to_numpy(), pdf["rep"].to_numpy()
        links = np.zeros(len(pdf), dtype=np.int64)
        new = ~(keys[a, :tree] == keys[b, :tree]).any(1)
        np.add.at(links, a[new], copies[b[new]])
        np.add.at(links, b[new], copies[a[new]])
        root = np.arange(len(pdf))
        for x, y in zip(a, b, strict=True):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            while root[y] != y:
                root[y] = root[root[y]]
                y = root[y]
            root[max(x, y)] = min(x, y)
        for n in range(len(root)):  # parents come first
            root[n] = root[root[n]]
        some = (links > 0) | (root != np.arange(len(pdf)))
        return pd.DataFrame({"rep": reps[some], "links": links[some], "near": reps[root[some]]})

    linked, _ = held.keep(dealt.groupBy("tree", "key", "low", "high").applyInPandas(link, "rep long, links long, near long"))
    groups = components(linked.where("rep <> near"), "rep", "near")
    links = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    known = classes.select("content", "rep", "copies").join(links, "rep", "left").join(groups, F.col("rep") == F.col("node"), "left")
    known = known.select("content", F.coalesce("root", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    known, _ = written(known, "jaccard-known")
    held.drop()
    out = signed.select("id", "content", *[f"also_{c}" for c in also]).join(known, "content", "left")
    own = F.col("content").isNull()
    return out.select(F.col("id").alias(id_col), F.when(F.col("id").isNotNull(), F.when(own, F.col("id")).otherwise(F.col("class_id"))).alias("class_id"), F.when(F.col("id").isNotNull(), F.when(own, F.lit(0)).otherwise(F.col("n_links"))).cast("long").alias("n_links"), *[F.col(f"also_{c}").alias(c) for c in also])
