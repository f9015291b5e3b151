"""User functions over cells, callable from SQL text.

A scalar function is a numpy function of whole columns. A table function sees the rows of one partition of its table
argument as numpy arrays and tells any number of rows:

    scalar(spark, "squeezed", lambda v: np.sign(v) * np.log1p(np.abs(v)))
    table(spark, "planes", lambda c: {"cells": [len(c["v"])], "top": [c["v"].max()]}, "cells long, top double")
    spark.sql("SELECT ix, cells, top FROM planes(TABLE(cells) PARTITION BY ix)")

Spark deals the partitions out and sorts them if the call says ORDER BY; one partition at a time is in a task's memory, so
PARTITION BY should name something bounded: a plane, a block, a bin.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Arrays = dict[str, np.ndarray]


def scalar(spark: SparkSession, name: str, function: Callable[..., np.ndarray], result: str = "double", nulls: bool = True) -> None:
    """Register a numpy function of one or several columns. With nulls, a row with a null argument gives null and the function sees the other rows only; otherwise nulls reach it as NaN."""

    def run(*columns: pd.Series) -> pd.Series:
        there = np.ones(len(columns[0]), bool)
        if nulls:
            for c in columns:
                there &= c.notna().to_numpy()
        out = pd.Series([None] * len(there), dtype=object)
        if there.any():
            out[there] = np.asarray(function(*[c[there].to_numpy() for c in columns])).tolist()
        return out

    def one(a: pd.Series) -> pd.Series:
        return run(a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return run(a, b, c)

    import inspect

    wanted = [p for p in inspect.signature(function).parameters.values() if p.default is p.empty] if not isinstance(function, np.ufunc) else [None] * function.nin
    spark.udf.register(name, F.pandas_udf({1: one, 2: two, 3: three}[len(wanted)], result))


def table(spark: SparkSession, name: str, function: Callable[[Arrays], dict], result: str, keys: tuple[str, ...] = ()) -> None:
    """Register a function from the columns of a partition, as arrays (nulls are None in arrays of objects, NaN in numbers), to columns of rows.

    keys: columns of the partition whose first value is put before the result's own; their types have to be given in
    result. A partition without rows never reaches the function; one for which it tells no rows has none.
    """
    columns = StructType.fromDDL(result).names

    class Partition:
        def __init__(self):
            self.rows: list = []
            self.names: list[str] = []

        def eval(self, row):
            if not self.names:
                self.names = list(row.__fields__)
            self.rows.append(tuple(row))

        def terminate(self):
            if not self.rows:
                return
            frame = pd.DataFrame(self.rows, columns=self.names)
            own = [frame[k].iloc[0] for k in keys]
            told = function({c: frame[c].to_numpy() for c in self.names})
            plain = [[x.item() if isinstance(x, np.generic) else x for x in told[c]] for c in columns[len(keys) :]]
            for values in zip(*plain, strict=True):
                yield (*(k.item() if isinstance(k, np.generic) else k for k in own), *values)

    spark.udtf.register(name, F.udtf(Partition, returnType=result))
