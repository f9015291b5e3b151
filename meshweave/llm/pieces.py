"""Ordered groups of any size as bounded pieces: a range partitioning by group and order, cut into runs that fit a task.

A group may hold any share of the rows. Its rows are spread over as many range partitions as they need and each task
cuts what it sees into pieces of at most so many rows; what concerns the whole group is then told from the pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Batches = Iterator[pa.RecordBatch]
#: What every piece says of itself. open: its group may go on in another piece, as it is cut or is the first or last of its partition.
PLACE = "part int, nth int, open boolean"


def schema_of(text: str) -> tuple[StructType, pa.Schema]:
    struct = StructType.fromDDL(text)
    return struct, to_arrow_schema(struct)


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns), strict=True)


def batch_of(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def by_batch(df: DataFrame, columns: str, tell: Callable[[pa.RecordBatch], list], most: int = 256) -> DataFrame:
    """The columns that tell makes of the rows, so many at a time; Arrow columns may be passed on as they are."""
    struct, arrow = schema_of(columns)

    def run(batches: Batches) -> Batches:
        for whole in batches:
            for at in range(0, whole.num_rows, most):
                yield batch_of(tell(whole.slice(at, most)), arrow)

    return df.mapInArrow(run, struct)


def cut(df: DataFrame, keys: list[str], rows: int, columns: str, make: Callable[[list[tuple]], tuple], weight: Callable[[tuple], int] | None = None) -> DataFrame:
    """One row a piece: the keys, its place, and the columns that make tells of its rows.

    df is sorted within its partitions by the keys first. A piece ends where its rows weigh so much (1 each by default).
    """
    types = dict(df.dtypes)
    struct, arrow = schema_of(", ".join([*[f"`{k}` {types[k]}" for k in keys], PLACE, columns]))
    at = [df.columns.index(k) for k in keys]

    def run(batches: Batches) -> Batches:
        part, nth, key, held, size, edge = TaskContext.get().partitionId(), 0, None, [], 0, True
        for batch in batches:
            out = []
            for row in rows_of(batch):
                now = tuple(row[i] for i in at)
                if held and (now != key or size >= rows):
                    goes_on = now == key
                    out.append((*key, part, nth, edge or goes_on, *make(held)))
                    edge, nth, held, size = goes_on, nth + 1, [], 0
                key = now
                held.append(row)
                size += weight(row) if weight else 1
            if out:
                yield batch_of(list(zip(*out, strict=True)), arrow)
        if held:
            yield batch_of([[v] for v in (*key, part, nth, True, *make(held))], arrow)

    return df.mapInArrow(run, struct)


def digests(pieces: DataFrame, keys: list[str], joint: str) -> DataFrame:
    """keys and sha256 of each group's texts (column piece, in order of part and nth) with the joint between them.

    Groups of one piece are digested where they are. A cut group's pieces meet in one task, as the digest of a text is
    told from its beginning to its end, but only one piece is in memory at a time.
    """
    types = dict(pieces.dtypes)
    struct, arrow = schema_of(", ".join([*[f"`{k}` {types[k]}" for k in keys], "sha256 string"]))
    n = len(keys)

    def run(batches: Batches) -> Batches:
        key, state = None, None
        for batch in batches:
            out = []
            for row in rows_of(batch):
                if state is None or row[:n] != key:
                    if state is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = row[:n], hashlib.sha256()
                else:
                    state.update(joint.encode())
                state.update(row[n].encode("utf-8", "surrogatepass"))
            if out:
                yield batch_of(list(zip(*out, strict=True)), arrow)
        if state is not None:
            yield batch_of([[v] for v in (*key, state.hexdigest())], arrow)

    whole = pieces.where("NOT open").select(*keys, F.sha2("piece", 256).alias("sha256"))
    divided = pieces.where("open").repartition(*keys).sortWithinPartitions(*keys, "part", "nth").select(*keys, "piece")
    return whole.unionByName(divided.mapInArrow(run, struct))
