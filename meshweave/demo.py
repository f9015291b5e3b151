"""python -m meshweave.demo: a small run whose density is printed as characters."""

from __future__ import annotations

import argparse
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.mesh import Mesh, positions_from_displacement
from .session import Universe

SHADES = " .:-=+*#%@"


def picture(field: DataFrame, mesh: Mesh, cell: int = 0) -> str:
    """One slice of a three-dimensional mesh, n * n characters, dense cells darker."""
    rows = field.where(F.col("iz") == cell).select("ix", "iy", F.log1p(F.greatest(F.col("v"), F.lit(-0.99)) + 1).alias("s")).collect()
    top = max((r["s"] for r in rows), default=1.0) or 1.0
    shade = {(r["ix"], r["iy"]): SHADES[min(len(SHADES) - 1, int(max(0.0, r["s"] / top) * len(SHADES)))] for r in rows}
    return "\n".join("".join(shade.get((x, y), " ") for y in range(mesh.n)) for x in range(mesh.n))


def main() -> None:
    p = argparse.ArgumentParser()
    p.add_argument("--res", type=int, default=16)
    p.add_argument("--box", type=float, default=75.0)
    p.add_argument("--steps", type=int, default=3)
    args = p.parse_args()
    spark = SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp())
    u = Universe(spark, Mesh(3, args.res, args.box)).with_times().with_spectrum().with_initial(seed=1).with_lpt(1)
    state = u.nbody(0.05, 1.0, args.steps)
    print(picture(u.density(positions_from_displacement(state, u.mesh)), u.mesh))


if __name__ == "__main__":
    main()
