"""Between particles and meshes: stencils, deposit, gather and what is built on them.

A particle spreads over worder cells an axis (1 nearest cell, 2 cloud in cell, 3 triangular cloud, 4 piecewise
cubic). Deposit is an explode and one two-phase aggregate; gather is the same explode, a broadcast join with the mesh
and one aggregate by particle. Meshes beyond a broadcast go by blocks (blocks.py). Wide sums share the pass: mass and
mass-weighted quantities leave one aggregate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import MARGIN, SIDE, deposit_by_block, gather_by_block
from .mesh import AXES, Mesh, Span, completed, cut, grid, near_slice, to_cells, wrap

#: Offsets of the cells that an order touches.
OFFSETS = {1: (0,), 2: (0, 1), 3: (-1, 0, 1), 4: (-1, 0, 1, 2)}
#: Meshes of at most this many cells (some 10 MB a field) are broadcast to the particles.
BROADCAST_CELLS = 1 << 17


def weight(d: Column, order: int) -> Column:
    """Share of a cell at distance d (in cells, not negative)."""
    if order == 1:
        return F.lit(1.0)
    if order == 2:
        return F.greatest(F.lit(0.0), 1 - d)
    if order == 3:
        return F.when(d <= 0.5, 0.75 - d * d).when(d <= 1.5, F.pow(1.5 - d, 2) / 2).otherwise(0.0)
    return F.when(d <= 1, 2 / 3 - d * d * (1 - d / 2)).when(d <= 2, F.pow(2 - d, 3) / 6).otherwise(0.0)


def slope(d: Column, order: int) -> Column:
    """Derivative of the share by the distance."""
    if order == 1:
        return F.lit(0.0)
    if order == 2:
        return F.when(d <= 1, -1.0).otherwise(0.0)
    if order == 3:
        return F.when(d <= 0.5, -2 * d).when(d <= 1.5, d - 1.5).otherwise(0.0)
    return F.when(d <= 1, d * (1.5 * d - 2)).when(d <= 2, -F.pow(2 - d, 2) / 2).otherwise(0.0)


def spread(particles: DataFrame, mesh: Mesh, order: int = 2, weight_col: str = "w", slopes: bool = False) -> DataFrame:
    """Each particle once for every cell it touches: cell indices, the product of its shares and, if asked, its gradient by position."""
    if order not in OFFSETS:
        raise ValueError("order 1, 2, 3 or 4")
    kept = [c for c in particles.columns if c not in (*mesh.cells, weight_col)]
    out, shares, grads = particles.select(*kept), [], []
    # one axis after the other, each formula written once: the generated code stays small for every order
    for x, i in zip(AXES, mesh.cells):
        out = out.withColumn(f"__g{i}", to_cells(F.col(x), mesh))
        base = F.floor(f"__g{i}") if order % 2 == 0 else F.rint(f"__g{i}")
        out = out.withColumn(f"__c{i}", F.explode(F.array(*[base.cast("int") + o for o in OFFSETS[order]])))
        out = out.withColumn(f"__g{i}", F.col(f"__g{i}") - F.col(f"__c{i}")).withColumn(f"__a{i}", F.abs(f"__g{i}")).withColumn(f"__c{i}", F.pmod(f"__c{i}", F.lit(mesh.n)))
        shares.append(weight(F.col(f"__a{i}"), order))
        grads.append(F.signum(f"__g{i}") * slope(F.col(f"__a{i}"), order) * (mesh.n / mesh.box))
    product = lambda cs: cs[0] if len(cs) == 1 else cs[0] * product(cs[1:])
    more = [product([grads[m] if m == n else shares[m] for m in range(mesh.dim)]).alias(f"d{weight_col}{x}") for n, x in enumerate(AXES[: mesh.dim])] if slopes else []
    return out.select(*kept, *[F.col(f"__c{i}").alias(i) for i in mesh.cells], product(shares).alias(weight_col), *more)


def by_blocks(mesh: Mesh, order: int) -> bool:
    return mesh.size > BROADCAST_CELLS and mesh.n >= SIDE + 2 * MARGIN and order in OFFSETS


def deposit(particles: DataFrame, mesh: Mesh, order: int = 2, quantities: dict[str, Column] | None = None, complete: bool = True) -> DataFrame:
    """Sum of each quantity (default mass 1 a particle, as v) times the shares, for every cell."""
    sums = quantities or {"v": F.lit(1.0)}
    if by_blocks(mesh, order):
        out = deposit_by_block(particles, mesh, order, sums)
        return completed(out, mesh, tuple(sums)) if complete else out
    out = spread(particles, mesh, order, "__w").groupBy(*mesh.cells).agg(*[F.sum(F.col("__w") * q).alias(name) for name, q in sums.items()])
    return completed(out, mesh, tuple(sums)) if complete else out


def overdensity(particles: DataFrame, mesh: Mesh, order: int = 2, count: int | None = None) -> DataFrame:
    """delta = rho / mean - 1 on every cell; without the number of particles the mean comes from a count of those that have a place."""
    rho = deposit(particles, mesh, order)
    if count is not None:
        return rho.withColumn("v", F.col("v") / (count / mesh.size) - 1)
    there = F.lit(True)
    for x in mesh.places:
        there = there & F.col(x).isNotNull()
    total = particles.agg(F.count_if(there).alias("__total"))  # shares of a particle sum to one
    return rho.join(F.broadcast(total), how="cross").withColumn("v", F.col("v") / (F.col("__total") / mesh.size) - 1).drop("__total")


def held(field: DataFrame, mesh: Mesh) -> DataFrame:
    """The mesh's rows, broadcast where the mesh's own size bounds them: the particles' stencils then meet them without a shuffle."""
    return F.broadcast(field) if mesh.size <= BROADCAST_CELLS else field


def gather(field: DataFrame, particles: DataFrame, mesh: Mesh, order: int = 2, values: tuple[str, ...] = ("v",), gradient: bool = False) -> DataFrame:
    """id and each value interpolated to the particles; with gradient also its derivative by position.

    A mesh of at most BROADCAST_CELLS is broadcast to the particles' stencils; a larger one meets them by blocks.
    """
    if by_blocks(mesh, order):
        return gather_by_block(field, particles, mesh, order, values, gradient)
    parts = spread(particles.select("id", *mesh.places), mesh, order, "__w", gradient)
    met = parts.join(held(field, mesh), mesh.cells)
    sums = [F.sum(F.col("__w") * F.col(v)).alias(v) for v in values]
    if gradient:
        sums += [F.sum(F.col(f"d__w{x}") * F.col(v)).alias(f"d{v}_d{x}") for v in values for x in mesh.places]
    return met.groupBy("id").agg(*sums)


def mean_on_mesh(particles: DataFrame, mesh: Mesh, quantity: Column, order: int = 2) -> DataFrame:
    """Mass-weighted mean of a quantity in every cell, null where a cell is empty: both sums in one aggregate."""
    both = deposit(particles, mesh, order, {"w": F.lit(1.0), "q": quantity})
    return both.select(*mesh.cells, F.try_divide("q", F.when(F.col("w") != 0, F.col("w"))).alias("v"))


def deposit_tangent(particles: DataFrame, mesh: Mesh, order: int = 2, complete: bool = True) -> DataFrame:
    """v, and dv: the derivative of the deposit along the particles' tangents tx, ty, tz, in the same pass."""
    parts = spread(particles, mesh, order, "__w", True)
    move = sum((F.col(f"d__w{x}") * F.col(f"t{x}") for x in mesh.places[1:]), F.col(f"d__w{mesh.places[0]}") * F.col(f"t{mesh.places[0]}"))
    out = parts.groupBy(*mesh.cells).agg(F.sum("__w").alias("v"), F.sum(move).alias("dv"))
    return completed(out, mesh, ("v", "dv")) if complete else out


def deposit_adjoint(cotangent: DataFrame, particles: DataFrame, mesh: Mesh, order: int = 2) -> DataFrame:
    """Pull a mesh cotangent back through the deposit: gx, gy, gz by position (a gather with gradient) and gw by mass."""
    out = gather(cotangent, particles, mesh, order, ("v",), gradient=True)
    return out.select("id", F.col("v").alias("gw"), *[F.col(f"dv_d{x}").alias(f"g{x}") for x in mesh.places])


def on_slice(particles: DataFrame, mesh: Mesh, fixed: tuple[Span, ...], order: int = 2, count: int | None = None, squeeze: bool = True) -> DataFrame:
    """Overdensity on a slice or skewer only; particles that cannot reach it are filtered in the scan."""
    total = count if count is not None else particles.count()
    local = near_slice(particles, mesh, fixed, (order / 2 + 1) * mesh.box / mesh.n)
    rho = deposit(local, mesh, order, complete=False)
    cells = cut(grid(particles.sparkSession, mesh).select(*mesh.cells), mesh, fixed, squeeze=False)
    found = cut(rho, mesh, fixed, squeeze=False)
    out = cells.join(found, mesh.cells, "left").select(*mesh.cells, (F.coalesce("v", F.lit(0.0)) / (total / mesh.size) - 1).alias("v"))
    gone = [i for i, f in zip(mesh.cells, fixed) if squeeze and isinstance(f, int)]
    return out.drop(*gone)


def redshift_shift(particles: DataFrame, mesh: Mesh, factor: float, axis: int = -1) -> DataFrame:
    """Positions moved along one axis by momentum times factor, 1 / (a^2 E(a)), and wrapped."""
    x = mesh.places[axis]
    return particles.withColumn(x, wrap(F.col(x) + F.col(f"p{x}") * factor, mesh.box))


def cell_velocity_shift(particles: DataFrame, mesh: Mesh, factor: float, order: int = 2, axis: int = -1, also: Callable[[Column], Column] | None = None, value: Column | None = None) -> DataFrame:
    """A field in redshift space by cell: cells move along the axis by their mean velocity with their mass, or with also(mean of value), and are deposited again."""
    x = mesh.places[axis]
    sums = deposit(particles, mesh, order, {"__m": F.lit(1.0), "__p": F.col(f"p{x}"), "__v": value if value is not None else F.lit(1.0)}).where("__m > 0")
    carried = (F.col("__v") / F.col("__m")) if value is not None else F.col("__m")
    moved = sums.select(*[(F.col(i) * (mesh.box / mesh.n)).alias(p) for i, p in zip(mesh.cells, mesh.places)], (F.col("__p") / F.col("__m")).alias("__u"), (also(carried) if also else carried).alias("__q"))
    moved = moved.withColumn(x, wrap(F.col(x) + F.col("__u") * factor, mesh.box))
    return deposit(moved, mesh, order, {"v": F.col("__q")})


def shift_vectors(mesh: Mesh, resample: int) -> list[tuple[float, ...]]:
    """Offsets, in box units, of resample^dim particles inside each lattice cell."""
    from itertools import product

    step = mesh.box / mesh.n / resample
    return [tuple(s * step for s in v) for v in product(range(resample), repeat=mesh.dim)]


def exact_force_1d(particles: DataFrame, box: float, x: str = "x", ranges: int | None = None) -> DataFrame:
    """id and a: the exact acceleration of sheets in one dimension from the rank of each position.

    Ranks are counted range by range: a range partitioning, the sizes of the ranges, and a rank inside each, so no
    task sees all particles. Ties go by id.
    """
    from pyspark.sql.window import Window

    at = particles.select("id", wrap(F.col(x), box).alias("__x"))
    n = ranges or int(particles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = at.agg(F.count("*").alias("__n"), F.avg("__x").alias("__mean"))
    parts = at.repartitionByRange(n, "__x", "id").withColumn("__part", F.spark_partition_id())
    local = parts.withColumn("__rank", F.row_number().over(Window.partitionBy("__part").orderBy("__x", "id")) - 1)
    sizes = local.groupBy("__part").agg(F.count("*").alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    ranked = local.join(F.broadcast(sizes.select("__part", before.alias("__before"))), "__part").join(F.broadcast(total), how="cross")
    share = (F.col("__before") + F.col("__rank") + 0.5) / F.col("__n")
    return ranked.select("id", (box * ((F.col("__x") - F.col("__mean")) / box + 0.5 - share)).alias("a"))
