"""Interpolation in tables of any size, as an as-of join: each probe meets the last knot that is not beyond it.

Knots and probes are sorted into ranges of one order; in a range the last knot is carried forward from row to row, and
what precedes a range is told from one row a range. No probe sees the table, and no range has to hold all probes that are
equal. Tables that are counted and small are arrays in every task instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Tables of at most this many knots are sent to every task.
SMALL = 1 << 15


def knots_of(table: DataFrame, key: str, to: tuple[str, ...]) -> DataFrame:
    """x and y0, y1 ... of each knot, one row a place: of equal knots the one with the least values. Knots without a place or a value are left out."""
    y = [f"y{n}" for n in range(len(to))]
    rows = table.select(F.col(key).cast("double").alias("x"), *[F.col(c).cast("double").alias(n) for c, n in zip(to, y, strict=True)])
    rows = rows.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in ("x", *y)))
    return rows.groupBy("x").agg(F.min(F.struct(*y)).alias("y")).select("x", "y.*")


def ranged(df: DataFrame, ranges: int, *order) -> DataFrame:
    """Sorted ranges with their number, cut from what they were made of, so that every reader sees the same ranges."""
    return df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).checkpoint()


def with_next(knots: DataFrame, ranges: int) -> DataFrame:
    """Each knot with the one after it as nx, ny0 ...; the last one's are null."""
    y = [c for c in knots.columns if c != "x"]
    parts = ranged(knots, ranges, "x")
    inside = Window.partitionBy("__part").orderBy("x")
    following = Window.orderBy("__part").rowsBetween(1, Window.unboundedFollowing)  # one row a range
    ends = parts.groupBy("__part").agg(F.min(F.struct("x", *y)).alias("first"))
    every = knots.sparkSession.range(ranges).select(F.col("id").cast("int").alias("__part")).join(ends, "__part", "left")
    after = every.select("__part", F.first("first", ignorenulls=True).over(following).alias("after"))
    led = parts.withColumn("__n", F.lead(F.struct("x", *y)).over(inside)).join(F.broadcast(after), "__part")
    then = F.coalesce("__n", "after")
    return led.select("x", *y, then["x"].alias("nx"), *[then[c].alias(f"n{c}") for c in y])


def _line(x: np.ndarray, knot: dict[str, np.ndarray], y: list[str]) -> list[np.ndarray]:
    """Values at x between knots; where there is no next knot, the knot's own."""
    width = knot["nx"] - knot["x"]
    t = np.where(width > 0, (x - knot["x"]) / np.where(width > 0, width, 1), 0.0)
    return [np.where(np.isnan(knot["nx"]), knot[c], knot[c] + t * (knot["n" + c] - knot[c])) for c in y]


def interpolate(table: DataFrame, probes: DataFrame, key: str, to: str | tuple[str, ...], at: str = "x", into: str | tuple[str, ...] = "y", small: int = SMALL, ranges: int | None = None) -> DataFrame:
    """The probes with one or several columns of the table, linear in its key and constant beyond its ends.

    Knots may come in any order; of equal knots the one with the least values counts. A probe that is null or no number,
    and any probe of a table without knots, gets nulls. Probes that repeat are rows each.
    """
    to, into = ((x,) if isinstance(x, str) else tuple(x) for x in (to, into))
    knots, y = knots_of(table, key, to), [f"y{n}" for n in range(len(to))]
    rows = knots.limit(small + 1).toPandas()
    if not len(rows):
        return probes.withColumns({c: F.lit(None).cast("double") for c in into})
    if len(rows) <= small:
        rows = rows.sort_values("x")
        held = probes.sparkSession.sparkContext.broadcast((rows["x"].to_numpy(), [rows[c].to_numpy() for c in y]))

        @F.pandas_udf(", ".join(f"{c} double" for c in y))
        def found(x: pd.Series) -> pd.DataFrame:
            places, values = held.value
            x = x.to_numpy(dtype=float, na_value=np.nan)
            return pd.DataFrame({c: pd.Series(np.interp(x, places, v)).where(~np.isnan(x), None) for c, v in zip(y, values, strict=True)})

        out = probes.withColumn("__found", found(F.col(at).cast("double")))
        return out.withColumns({c: F.nanvl(F.col("__found")[n], F.lit(None).cast("double")) for c, n in zip(into, y, strict=True)}).drop("__found")
    n = ranges or int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    led = with_next(knots, n)
    names = [c for c in probes.columns if c.lower() not in {i.lower() for i in into}]
    there = F.col(at).cast("double")
    asked = probes.where(there.isNotNull() & ~F.isnan(there))
    row_type = asked.select(F.struct(*names)).schema[0].dataType
    pad = {c: F.lit(None).cast("double") for c in (*y, "nx", *[f"n{c}" for c in y])}
    as_knots = led.select("x", F.lit(0).alias("__kind"), F.lit(0).cast("long").alias("__salt"), *pad, F.lit(None).cast(row_type).alias("__row"))
    # equal probes differ by a number, so that a range's end can lie between them
    as_probes = asked.select(there.alias("x"), F.lit(1).alias("__kind"), F.monotonically_increasing_id().alias("__salt"), *[c.alias(name) for name, c in pad.items()], F.struct(*names).alias("__row"))
    parts = ranged(as_knots.unionByName(as_probes), n, "x", "__kind", "__salt")
    own = F.when(F.col("__kind") == 0, F.struct("x", *pad))
    every = probes.sparkSession.range(n).select(F.col("id").cast("int").alias("__part")).join(parts.groupBy("__part").agg(F.max(own).alias("last")), "__part", "left")
    preceding = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    first = led.agg(F.min(F.struct("x", *y)).alias("first"))
    before = every.select("__part", F.last("last", ignorenulls=True).over(preceding).alias("before")).join(F.broadcast(first), how="cross")
    joined = parts.join(F.broadcast(before), "__part").select("x", "__kind", *pad, "__row", "before", "first")
    schema = StructType([StructField("__row", row_type), *[StructField(c, DoubleType()) for c in y]])
    fields = ["x", *pad]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if carried is None:
                ahead, start = batch.column("before")[0].as_py(), batch.column("first")[0].as_py()
                nothing = {"x": start["x"], **{c: start[c] for c in y}, "nx": None, **{f"n{c}": None for c in y}}
                carried = {c: float("nan") if v is None else v for c, v in (ahead or nothing).items()}
            columns = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in fields}
            kind = batch.column("__kind").to_numpy()
            last = np.maximum.accumulate(np.where(kind == 0, np.arange(len(kind)), -1))  # the knot of each row, -1 for the carried one
            knot = {c: np.where(last >= 0, columns[c][last], carried[c]) for c in fields}
            probe = kind == 1
            values = _line(columns["x"][probe], {c: v[probe] for c, v in knot.items()}, y)
            carried = {c: float(knot[c][-1]) for c in fields}
            if probe.any():
                yield pa.RecordBatch.from_arrays([batch.column("__row").filter(pa.array(probe)), *map(pa.array, values)], names=["__row", *y])

    out = joined.mapInArrow(run, schema)
    told = out.select("__row.*", *[F.col(c).alias(name) for c, name in zip(y, into, strict=True)])
    lost = probes.where(there.isNull() | F.isnan(there)).select(*names, *[F.lit(None).cast("double").alias(c) for c in into])
    return told.unionByName(lost)
