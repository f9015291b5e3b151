"""What several operators need: the shared folder, fixed hashes, tables cut from their lineage, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where none is set and the master is local."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), "meshweave-shared")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table or folder that no later read needs."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The same rows, read from a table in the shared folder, and its path. Survives the loss of executors and has a known size."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def let_go(spark: SparkSession) -> None:
    """Have the shuffle files of what is written by now deleted: Spark keeps them until the driver's garbage is collected, which a large heap puts off."""
    spark.range(0, 1, 1, 1).collect()  # the session holds its last query
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows of whole texts that a Python worker gets at once: Spark's 10,000 are some 30 MB, held several times over by the worker and by the JVM.
TEXT_ROWS = 2048


def text_batches(spark: SparkSession) -> None:
    """From now on this session hands Python workers at most TEXT_ROWS rows at once. Results do not depend on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))


PLAIN = {"Project", "Filter", "SubqueryAlias", "LogicalRelation"}


def identified(df: DataFrame) -> DataFrame:
    """The rows with their place added: __file, a hash of the file's path, and __row, the row's number in it.

    It is the same however often and by whichever executors the rows are read. Rows that are not plainly read from files
    are written to the shared folder first.
    """

    def nodes(plan) -> list[str]:
        children = plan.children()
        return [plan.nodeName(), *(x for n in range(children.size()) for x in nodes(children.apply(n)))]

    place = [F.xxhash64("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").cast("long").alias("__row")]
    if "_metadata" not in df.columns and set(nodes(df._jdf.queryExecution().analyzed())) <= PLAIN:
        with contextlib.suppress(AnalysisException):
            return df.select("*", *place)
    names = [f"c{n}" for n in range(len(df.columns))]
    back, _ = written(df.toDF(*names), "identified")
    return back.select(*(F.col(a).alias(b) for a, b in zip(names, df.columns, strict=True)), *place)


def plain_names(df: DataFrame, *needed: str) -> tuple[DataFrame, list[str]]:
    """df with its columns named c0, c1 ..., so that no name of an operator's own can be one of them, and the new names of the needed columns."""
    new = {name: f"c{n}" for n, name in enumerate(df.columns)}
    folded = {name.lower(): to for name, to in new.items()}
    return df.toDF(*new.values()), [new.get(name) or folded[name.lower()] for name in needed]


def unused(name: str, df: DataFrame) -> str:
    """The name, with underscores until no column has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising mixer of the public SplitMix64 generator."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    x ^= x >> np.uint64(31)
    return x


def tidy() -> None:
    """Give freed memory back to the system: Python workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def forest(parts):
    """Edges u, v of one task as stars: every node but the least of its component with that least node."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for pdf in parts:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = [x for x in root if find(x) != x]
    yield pd.DataFrame({"u": np.array([root[x] for x in nodes], np.int64), "v": np.array(nodes, np.int64)})


def components(edges: DataFrame, a: str = "a", b: str = "b", task_edges: int = 500_000) -> DataFrame:
    """Connected components of an undirected edge list: node, root (the least node of its component).

    Tasks of some hundred thousand edges each reduce them to stars first. Then each round takes the least label among
    the neighbours and the label of that label; labels are checkpointed once a round, so that a lost executor costs
    one round. Null ends are ignored; an empty list gives an empty table.
    """
    shared_folder(edges.sparkSession)
    links = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v").persist()
    parts = 1 + links.count() // task_edges
    stars = links.coalesce(parts).mapInPandas(forest, "u long, v long").checkpoint()
    links.unpersist()
    if parts == 1:
        return stars.select(F.col("v").alias("node"), F.col("u").alias("root")).union(stars.select("u", "u").distinct())
    both = stars.union(stars.select("v", "u"))
    labels = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low")).select("node", F.least("node", "low").alias("root")).coalesce(parts).checkpoint()
    while True:
        near = both.join(labels, both.v == labels.node).groupBy(F.col("u").alias("node")).agg(F.min("root").alias("low"))
        lower = labels.join(near, "node").select("node", F.least("root", "low").alias("next"), F.col("root").alias("was"))
        # The label's own label: one hop more. Many nodes may share a label; the right side has each once.
        up = labels.select(F.col("node").alias("at"), F.col("root").alias("up"))
        after = lower.join(up, lower.next == up["at"], "left").select("node", F.least("next", F.coalesce("up", "next")).alias("root"), "was").coalesce(parts).checkpoint()
        changed = after.where("root <> was").limit(1).count()
        labels = after.select("node", "root")
        if not changed:
            return labels


class Held:
    """Small tables that several steps read: kept in the executors' memory or on their disks, computed again from what is written if an executor is lost, and let go together."""

    def __init__(self):
        self.frames: list[DataFrame] = []
        self.paths: list[tuple[SparkSession, str]] = []

    def cut(self, df: DataFrame, name: str) -> tuple[DataFrame, int]:
        """The same as a written table without lineage, in files of the advised size; it is deleted in the end."""
        df, path = written(df.hint("rebalance"), name)
        self.paths.append((df.sparkSession, path))
        let_go(df.sparkSession)
        return df, df.count()

    def keep(self, df: DataFrame) -> tuple[DataFrame, int]:
        """The table and its number of rows."""
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        self.frames.append(df)
        return df, df.count()

    def drop(self) -> None:
        for df in self.frames:
            df.unpersist()
        for spark, path in self.paths:
            discard(spark, path)


def bounded(kept: tuple[DataFrame, int], rows: int) -> DataFrame:
    """A counted table marked for broadcast if it has at most so many rows, else as it is, for a shuffled join."""
    df, n = kept
    return F.broadcast(df) if n <= rows else df


#: Rolling hashes: powers of an odd number and of its inverse modulo 2**64, for texts of up to PART characters at once.
PART = 1 << 19
RADIX = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def powers() -> tuple[np.ndarray, np.ndarray]:
    if not _powers:
        for base in (RADIX, pow(RADIX, -1, 1 << 64)):
            x = np.full(PART + 1, base, dtype=np.uint64)
            x[0] = 1
            _powers.append(np.multiply.accumulate(x))
    return _powers[0], _powers[1]


def words(c: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each maximal run of code points (at most PART) where apart is false."""
    edge = np.flatnonzero(np.diff(np.concatenate([[True], apart, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    up, down = powers()
    prefix = np.concatenate([[np.uint64(0)], np.add.accumulate((c + np.uint64(1)) * up[: len(c)])])
    return start, end, mix64((prefix[end] - prefix[start]) * down[start])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def white(c: np.ndarray) -> np.ndarray:
    return (c <= 32) | (c == 133) | (c == 160) | (c == 0x2028) | (c == 0x2029) | (c == 0x3000)


_alnum: list[np.ndarray] = []


def letters(c: np.ndarray) -> np.ndarray:
    """Whether each code point is a letter, mark or digit; beyond the first three planes all count as letters."""
    if not _alnum:
        table = np.ones(0x110000, dtype=bool)
        table[:0x30000] = [chr(n).isalnum() or 0x300 <= n < 0x370 for n in range(0x30000)]
        _alnum.append(table)
    return _alnum[0][c]


def word_hashes(text: str) -> np.ndarray:
    """Hash of every word of a lower-cased text of any length, in order; parts end between words where that is possible."""
    found, at = [], 0
    while at < len(text):
        c = code_points(text[at : at + PART])
        apart = ~letters(c)
        size = len(c)
        if at + size < len(text):
            gaps = np.flatnonzero(apart)
            if len(gaps) and gaps[-1]:
                size = int(gaps[-1])
        found.append(words(c[:size], apart[:size])[2])
        at += size
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)
