"""Short-range forces: multipoles by Morton prefix, neighbour pairs and a tree walk, by groups of bounded size."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mesh import Mesh, nearest_image, wrap
from .octree import GROUP, Nodes, apart, grouped, within
from .tree_keys import keyed, morton, unmorton

__all__ = ["keyed", "morton", "multipoles", "neighbour_pairs", "short_range_force", "sorted_by_key", "tree_force", "unmorton"]


def sorted_by_key(particles: DataFrame, ranges: int) -> DataFrame:
    """Range partitions of neighbouring keys, sorted inside."""
    return particles.repartitionByRange(ranges, "morton").sortWithinPartitions("morton")


def multipoles(particles: DataFrame, mesh: Mesh, bits: int, levels: tuple[int, ...] | None = None) -> DataFrame:
    """level, prefix, m and the first and second moments of every node of the tree, all levels in one grouping-sets pass.

    The finest level is aggregated first, so the coarser ones read nodes and not particles.
    """
    d, places = mesh.dim, mesh.places
    wanted = levels or tuple(range(bits + 1))
    second = [(a, b) for n, a in enumerate(places) for b in places[n:]]
    at = {x: wrap(F.col(x), mesh.box) for x in places}
    leaves = keyed(particles, mesh, bits).groupBy("morton").agg(F.count("*").cast("double").alias("m"), *[F.sum(at[x]).alias(f"d{x}") for x in places], *[F.sum(at[a] * at[b]).alias(f"q{a}{b}") for a, b in second])
    up = leaves.withColumn("n", F.explode(F.array(*map(F.lit, wanted)))).withColumn("prefix", F.expr(f"shiftright(morton, cast({d} * ({bits} - n) as int))"))
    sums = ["m", *[f"d{x}" for x in places], *[f"q{a}{b}" for a, b in second]]
    return up.groupBy(F.col("n").cast("int").alias("level"), "prefix").agg(*[F.sum(c).alias(c) for c in sums])


def points_of(column: pa.ListArray, row: int, places: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, keys and places of one group's particles in the order of their keys."""
    struct = column[row].values
    keys = struct.field("morton").to_numpy()
    order = np.argsort(keys, kind="stable")
    at = np.stack([struct.field(x).to_numpy() for x in places], axis=1)
    return struct.field("id").to_numpy()[order], keys[order], at[order]


def pairs_by_cells(particles: DataFrame, mesh: Mesh, radius: float, n: int) -> DataFrame:
    """neighbour_pairs by joining each of n equal cells an axis, at least three and as wide as the radius, with itself and those after it among those around it.

    The join is shuffled whatever the sides' estimated sizes are: places are computed from few columns of a file, so the
    estimate is far below the rows' size in memory, and a broadcast would hold all of them in the driver.
    """
    here = particles.select("id", *[wrap(F.col(x), mesh.box).alias(x) for x in mesh.places])
    cell = lambda x: F.least(F.floor(F.col(x) * (n / mesh.box)), F.lit(n - 1)).cast("int")
    left = here.select(F.col("id").alias("a"), *[F.col(x).alias(f"a{x}") for x in mesh.places], *[cell(x).alias(f"c{x}") for x in mesh.places])
    right = here.select(F.col("id").alias("b"), *[F.col(x).alias(f"b{x}") for x in mesh.places], *[cell(x).alias(f"c{x}") for x in mesh.places])
    steps = [s for s in product((-1, 0, 1), repeat=mesh.dim) if s >= (0,) * mesh.dim]
    around = F.explode(F.array(*[F.struct(*[F.pmod(F.col(f"c{x}") + k, F.lit(n)).cast("int").alias(f"c{x}") for k, x in zip(s, mesh.places)], F.lit(not any(s)).alias("same")) for s in steps]))
    right = right.select("b", *[f"b{x}" for x in mesh.places], around.alias("to")).select("b", *[f"b{x}" for x in mesh.places], "to.*")
    both = left.hint("shuffle_hash").join(right, [f"c{x}" for x in mesh.places]).where(~F.col("same") & (F.col("a") != F.col("b")) | (F.col("a") < F.col("b")))
    parts = [nearest_image(F.col(f"a{x}") - F.col(f"b{x}"), mesh.box) for x in mesh.places]
    r = F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))
    turned = lambda p: F.when(F.col("a") < F.col("b"), p).otherwise(-p)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), r.alias("r"), *[turned(p).alias(f"d{x}") for p, x in zip(parts, mesh.places)]).where(F.col("r") < radius)


def neighbour_pairs(particles: DataFrame, mesh: Mesh, radius: float, most: int = 128, bits: int | None = None) -> DataFrame:
    """a, b (a < b), r and the shortest differences dx, dy, dz of all pairs nearer than a radius.

    Particles are dealt into groups that grow with them, and a group is sent those of others that are near its box, so what
    is sent grows with the particles and not with their square (their pairs do). A task holds a group and a part of what it
    is sent; runs of at most so many particles along the curve are small matrices of distances. Where equal
    cells as wide as the radius hold no more than a run anyway (they are counted), these are joined instead, which sends
    each particle to 14 cells.
    """
    cells = int(mesh.box / radius)
    count = particles.count()
    if cells >= 3:
        place = [F.floor(wrap(F.col(x), mesh.box) * (cells / mesh.box)).alias(f"c{x}") for x in mesh.places]
        crowd = particles.groupBy(*place).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if crowd is not None and crowd <= most:
            return pairs_by_cells(particles, mesh, radius, cells)
    places, bits = mesh.places, bits or (12 if mesh.dim == 3 else 16)
    groups, packed = grouped(particles, mesh, bits, max(most, min(1 << 17, count // 256)))
    packed = packed.checkpoint()
    pairs = within(groups, mesh, radius, bits).where(F.struct(*GROUP) < F.struct(*[f"o_{c}" for c in GROUP]))
    to = pairs.groupBy(*[F.col(f"o_{c}").alias(c) for c in GROUP]).agg(F.collect_list(F.struct(*GROUP)).alias("targets"))
    point, d = packed.schema["points"].dataType, mesh.dim
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("r", pa.float64()), *[(f"d{x}", pa.float64()) for x in places]])
    reach = radius * (1 + 1e-12)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                points, targets = batch.column(0)[row].values, batch.column(1)[row].values
                at = np.stack([points.field(x).to_numpy() for x in places], axis=1)
                level, prefix = targets.field("level").to_numpy(), targets.field("prefix").to_numpy()
                side = mesh.box / 2.0**level
                middles = (np.stack([Nodes._axis(prefix, d, a, bits) for a in range(d)], axis=1) + 0.5) * side[:, None]
                for t in range(len(level)):
                    near = np.flatnonzero((apart(at, middles[t], mesh.box) <= side[t] / 2 + reach).all(axis=1))
                    for k in range(0, len(near), _SENT):
                        some = points.take(pa.array(near[k : k + _SENT]))
                        yield pa.RecordBatch.from_arrays([*(targets.field(c).slice(t, 1) for c in GROUP), pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some)], names=[*GROUP, "points"])

    def boxes(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lows, highs = (f.reduceat(at, np.arange(0, len(at), most)) for f in (np.minimum, np.maximum))
        return (lows + highs) / 2, (highs - lows) / 2

    def met(a_id: np.ndarray, a_at: np.ndarray, b_id: np.ndarray, b_at: np.ndarray, same: bool) -> Iterator[pa.RecordBatch]:
        """Pairs of two lists in the order of their keys."""
        middle, half = boxes(b_at)
        for n, (own, wide) in enumerate(zip(*boxes(a_at), strict=True)):
            gap = np.maximum(apart(own, middle, mesh.box) - wide - half, 0)
            runs = np.flatnonzero(((gap * gap).sum(axis=1) <= reach**2) & (not same or np.arange(len(middle)) >= n))
            took = (runs[:, None] * most + np.arange(most)).ravel()
            took, mine = took[took < len(b_id)], np.arange(n * most, min((n + 1) * most, len(a_id)))
            for k in range(0, len(took), max(1, _AT_ONCE * 8 // len(mine))):
                some = took[k : k + max(1, _AT_ONCE * 8 // len(mine))]
                diff = np.mod(a_at[mine][:, None, :] - b_at[some][None, :, :] + mesh.box / 2, mesh.box) - mesh.box / 2
                r = np.sqrt((diff * diff).sum(axis=2))
                near = (r < radius) & (a_id[mine][:, None] != b_id[some][None])
                if same:
                    near &= mine[:, None] < some[None]
                i, j = np.nonzero(near)
                first, second = a_id[mine[i]], b_id[some[j]]
                sign = np.where(first > second, -1.0, 1.0)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (np.minimum(first, second), np.maximum(first, second), r[i, j], *(diff[i, j, x] * sign for x in range(d)))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows in the order of their groups, a group's own particles first."""
        now, ids, at = None, None, None
        for batch in batches:
            for row, (*group, is_sent) in enumerate(list(zip(*(batch.column(c).to_pylist() for c in (*GROUP, "sent")), strict=True))):
                other, _, there = points_of(batch.column("points"), row, places)
                if not is_sent:
                    now, ids, at = group, other, there
                if group == now:
                    yield from met(ids, at, other, there, not is_sent)

    sent = packed.join(to, GROUP).select("points", "targets").mapInArrow(send, f"level int, prefix long, part int, points {point.simpleString()}")
    both = packed.select(*GROUP, F.lit(False).alias("sent"), "points").union(sent.select(*GROUP, F.lit(True).alias("sent"), "points"))
    parts = max(int(particles.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(_TASKS, groups.count()))
    return both.repartition(parts, *GROUP).sortWithinPartitions(*GROUP, "sent").mapInArrow(run, "a long, b long, r double, " + ", ".join(f"d{x} double" for x in places))


_STEP, _FAR = 1 / 512, 9.0
_table: list[np.ndarray] = []


def erfc(x: np.ndarray) -> np.ndarray:
    """Complementary error function of numbers not below 0: cubic Hermite steps through a table of exact values and slopes, to about 1e-13."""
    if not _table:
        at = np.arange(int(_FAR / _STEP) + 2) * _STEP
        _table.extend([np.array([math.erfc(v) for v in at]), -2 / math.sqrt(math.pi) * np.exp(-at * at) * _STEP])
    values, slopes = _table
    x = np.minimum(x, _FAR)
    i = (x / _STEP).astype(np.int64)
    t = x / _STEP - i
    s = 1 - t
    return s * s * (1 + 2 * t) * values[i] + t * t * (3 - 2 * t) * values[i + 1] + s * s * t * slopes[i] - t * t * s * slopes[i + 1]


def _shape(r: np.ndarray, alpha: float, dim: int) -> np.ndarray:
    """Short-range part of the pair force over its Newtonian value."""
    if dim == 2:
        return np.exp(-(r**2) / (2 * alpha**2))
    x = r / (math.sqrt(2) * alpha)
    return erfc(x) + math.sqrt(2 / math.pi) * r / alpha * np.exp(-(x**2))


def short_range_force(particles: DataFrame, mesh: Mesh, alpha: float, cut: float = 6.0) -> DataFrame:
    """id, ax, ay, az: direct sum over pairs within cut * alpha, of unit total mean density."""
    return tree_force(particles, mesh, alpha, 0.0, cut=cut)


#: Steps of the table of the pair force's shape up to the reach; pairs that are summed at once, so that their arrays stay in the processor's cache.
_STEPS, _AT_ONCE = 1 << 14, 1 << 15
_shapes: dict[tuple, np.ndarray] = {}


def shape_table(alpha: float, dim: int, reach: float) -> np.ndarray:
    """Three coefficients of the shape in each step of the distance, of its expansion about the step's middle (to some 1e-12), and zeros beyond the reach."""
    if (alpha, dim, reach) not in _shapes:
        r = (np.arange(_STEPS) + 0.5) * (reach / _STEPS)
        f, g, h = _shape(r, alpha, dim), reach / _STEPS, (reach / _STEPS) ** 2
        if dim == 2:
            slope, bend = -r / alpha**2 * f, (r**2 / alpha**4 - 1 / alpha**2) * f
        else:
            fall = math.sqrt(2 / math.pi) / alpha**3 * np.exp(-(r**2) / (2 * alpha**2))
            slope, bend = -(r**2) * fall, (r**3 / alpha**2 - 2 * r) * fall
        coefficients = np.stack([f - slope * g / 2 + bend * h / 8, slope * g - bend * h / 2, bend * h / 2])
        _shapes[alpha, dim, reach] = np.concatenate([coefficients, np.zeros((3, 1))], axis=1)
    return _shapes[alpha, dim, reach]


def pulled(at: np.ndarray, source: np.ndarray, mass: np.ndarray, mesh: Mesh, alpha: float, reach: float) -> np.ndarray:
    """Sum over sources of mass times difference times the pair force, at every place."""
    d, box, steps = mesh.dim, mesh.box, shape_table(alpha, mesh.dim, reach)
    low, high = at.min(axis=0), at.max(axis=0)
    middle, out = (low + high) / 2, np.zeros_like(at)
    one_image = ((high - low) / 2 + reach <= box / 2).all()  # then a source's image nearest to the middle is that of any pair within reach
    own = np.ascontiguousarray((at - middle).T)
    there = np.ascontiguousarray((source - np.round((source - middle) / box) * box - middle).T)  # equal places stay equal in all bits
    width, even = max(1, _AT_ONCE // len(at)), bool((mass == 1).all())
    for k in range(0, len(source), width):
        b = there[:, k : k + width]
        parts = [own[x][:, None] - b[x] for x in range(d)]
        if not one_image:
            parts = [np.mod(p + box / 2, box) - box / 2 for p in parts]
        r2 = parts[0] * parts[0]
        for p in parts[1:]:
            r2 += p * p
        same = r2 == 0
        if same.any():
            r2[same] = 4 * reach**2  # beyond the table
        r = np.sqrt(r2)
        place = r * (_STEPS / reach)
        step = place.astype(np.int64)
        place -= step
        weight = steps[2].take(step, mode="clip")
        weight *= place
        weight += steps[1].take(step, mode="clip")
        weight *= place
        weight += steps[0].take(step, mode="clip")
        weight /= r2 if d == 2 else np.multiply(r2, r, out=r)
        if not even:
            weight *= mass[k : k + width]
        if one_image:
            out += own.T * weight.sum(axis=1)[:, None] - weight @ b.T
        else:
            out += np.stack([(weight * p).sum(axis=1) for p in parts], axis=1)
    return out


def needed(nodes: Nodes, middles: np.ndarray, halves: np.ndarray, mesh: Mesh, theta: float, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which nodes serve which boxes: box, node and whether the node is far enough to serve as masses (else it is a leaf of single particles). A node serves if it is smaller than theta times its distance from the whole box. Also that distance."""
    boxes, found = np.arange(len(middles)), ([], [], [], [])
    at = np.zeros(len(middles), np.int64)
    while len(boxes):
        away = apart(middles[boxes], nodes.middle[at], mesh.box)
        gap = np.maximum(away - halves[boxes][:, None] - nodes.side[at][:, None] / 2, 0)
        inside = (gap * gap).sum(axis=1) <= reach**2
        to_middle = np.maximum(away - halves[boxes][:, None], 0)
        distance = np.sqrt((to_middle * to_middle).sum(axis=1))
        far = nodes.side[at] < theta * distance
        stop = inside & (far | nodes.leaf[at])
        for out, v in zip(found, (boxes[stop], at[stop], far[stop], distance[stop]), strict=True):
            out.append(v)
        go = inside & ~stop
        count = nodes.children[at[go]]
        boxes = np.repeat(boxes[go], count)
        at = np.repeat(nodes.child[at[go]], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return tuple(np.concatenate(v) if v else np.zeros(0, np.int64) for v in found)


#: Error of the interpolation of a pair force inside a far node, over the force, by which the number of its masses is chosen.
_INTERPOLATED = 1e-3


def masses_an_axis(ratio: np.ndarray) -> np.ndarray:
    """Masses along each axis of a node that keep the force of its particles at so many half sides from its middle."""
    ratio = np.maximum(ratio, 1.25)  # nearer ones need a theta above any in use
    return np.maximum(2, np.ceil(math.log(1 / _INTERPOLATED) / np.log(ratio + np.sqrt(ratio * ratio - 1)))).astype(np.int64)


def gathered(at: np.ndarray, n: int) -> np.ndarray:
    """mass and place of n masses an axis on the Chebyshev points of the particles' bounding box, with the same moments below order n along each axis."""
    low, high = at.min(axis=0), at.max(axis=0)
    middle, half = (low + high) / 2, (high - low) / 2
    points = np.cos((2 * np.arange(n) + 1) * (math.pi / (2 * n)))
    order = np.arange(n)[:, None]
    inside = np.arccos(np.clip((at - middle) / np.where(half > 0, half, 1), -1, 1))
    weights = [(2 * np.cos(order * x).T @ np.cos(order * np.arccos(points)) - 1) / n for x in inside.T]
    mass = weights[0]
    for w in weights[1:]:
        mass = (mass[:, :, None] * w[:, None, :]).reshape(len(at), -1)
    places = np.meshgrid(*(m + h * points for m, h in zip(middle, half, strict=True)), indexing="ij")
    return np.stack([mass.sum(axis=0), *(x.ravel() for x in places)], axis=1)


#: Particles or masses in a row that is sent to a group; numbers that it holds of them before it sums them; most tasks of the sums; particles of a node whose leaves look for theirs together.
_SENT, _HELD, _TASKS, _NEST = 1 << 15, 1 << 20, 512, 1024


def parted(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Neighbouring items of about so much at most in all, or one."""
    cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // most)) + 1
    if len(sizes):
        yield from (slice(i, j) for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)], strict=True))


def tree_force(particles: DataFrame, mesh: Mesh, alpha: float, theta: float = 0.5, bits: int | None = None, leaf: int = 32, cut: float = 6.0, most: int | None = None) -> DataFrame:
    """id, ax, ay, az: the short-range force within cut * alpha, with distant nodes as few masses when side < theta * distance.

    Each group of particles walks its own tree once for every group within reach and sends it what that one needs: masses
    of far nodes, and nodes with their particles where they are near. A far node is no single mass, whose error is some
    thousandths of the typical force and grows with the number of particles, but several that keep its moments, the more
    the nearer it is; it is sent with its particles where these are no more. Then each group sums what it was sent, a leaf
    of its own at a time. theta = 0 sums all pairs. Nothing passes the driver and no task holds more than a group and some of what it is sent.
    The groups grow with the particles: what a group is sent grows with the particles around it, so groups of a fixed size
    would exchange the square of the particles. Without far nodes all within reach are sent, so groups are larger then.
    """
    most = most or (min(1 << 17, max(2048, particles.count() // 256)) if theta else min(1 << 19, max(2048, particles.count() // 32)))
    d, places = mesh.dim, mesh.places
    bits, reach = bits or (12 if d == 3 else 16), min(cut * alpha, mesh.box / 2)
    groups, packed = grouped(particles, mesh, bits, most)
    packed = packed.checkpoint()
    to = within(groups, mesh, reach, bits).groupBy(*[F.col(f"o_{c}").alias(c) for c in GROUP]).agg(F.collect_list(F.struct(*[F.col(c) for c in GROUP])).alias("targets"))
    sources = packed.join(to, GROUP).select("level", "points", "targets")
    sent = pa.schema([("level", pa.int32()), ("prefix", pa.int64()), ("part", pa.int32()), ("far", pa.list_(pa.float64())), ("leaves", pa.list_(pa.float64())), ("sizes", pa.list_(pa.int64())), ("single", pa.list_(pa.float64()))])

    def export(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                _, keys, at = points_of(batch.column(1), row, places)
                nodes = Nodes(keys, batch.column(0)[row].as_py(), mesh, bits, leaf)
                targets = batch.column(2)[row].values
                level, prefix = targets.field("level").to_numpy(), targets.field("prefix").to_numpy()
                side = mesh.box / 2.0**level
                middles = (np.stack([Nodes._axis(prefix, d, a, bits) for a in range(d)], axis=1) + 0.5) * side[:, None]
                boxes, which, far, distance = needed(nodes, middles, side / 2, mesh, theta, reach)
                order = np.argsort(boxes, kind="stable")
                boxes, which, far, distance = boxes[order], which[order], far[order], distance[order]
                cuts = np.searchsorted(boxes, np.arange(len(level) + 1))
                count, axis, made = nodes.hi[which] - nodes.lo[which], np.zeros(len(which), np.int64), {}
                axis[far] = masses_an_axis(2 * distance[far] / nodes.side[which[far]])
                far &= axis**d < count
                for t in range(len(level)):
                    here = slice(cuts[t], cuts[t + 1])
                    w, f = which[here], far[here]
                    wanted = list(zip(w[f].tolist(), axis[here][f].tolist(), strict=True))
                    for n, k in wanted:
                        if (n, k) not in made:
                            made[n, k] = gathered(at[nodes.lo[n] : nodes.hi[n]], k)
                    for some in parted(np.array([k**d for _, k in wanted], np.int64), _SENT):
                        yield row_of(targets, t, far=np.concatenate([made[n].ravel() for n in wanted[some]]))
                    near, sizes = w[~f], (nodes.hi - nodes.lo)[w[~f]]
                    for some in parted(sizes, _SENT):
                        told = np.concatenate([nodes.middle[near[some]], nodes.side[near[some]][:, None]], axis=1)
                        yield row_of(targets, t, leaves=told.ravel(), sizes=sizes[some], single=np.concatenate([at[nodes.lo[n] : nodes.hi[n]] for n in near[some]]).ravel())

    def row_of(targets: pa.StructArray, t: int, **told: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(targets.field(c).slice(t, 1) for c in GROUP), *(pa.array([told.get(f.name, np.zeros(0))], f.type) for f in list(sent)[3:])], schema=sent)

    exports = sources.mapInArrow(export, "level int, prefix long, part int, far array<double>, leaves array<double>, sizes array<long>, single array<double>")
    unit = -(mesh.box**d) / (4 * math.pi if d == 3 else 2 * math.pi)

    told = pa.schema([("id", pa.int64()), *[(f"a{x}", pa.float64()) for x in places]])

    def pulls(own: tuple, got: list[list[np.ndarray]]) -> None:
        """Adds the forces of what has been sent to a group to those of its particles."""
        nodes, at, out = own
        far, leaves, sizes, single = (np.concatenate(x) for x in zip(*got, strict=True))
        far, leaves, single = far.reshape(-1, d + 1), leaves.reshape(-1, d + 1), single.reshape(-1, d)
        starts, middle, side = np.cumsum(sizes) - sizes, leaves[:, :d], leaves[:, d]

        def beside(n: int, of: np.ndarray) -> tuple[slice, np.ndarray]:
            """A node's particles, and which of what was sent is within their reach."""
            here = slice(nodes.lo[n], nodes.hi[n])
            low, high = at[here].min(axis=0), at[here].max(axis=0)
            gap = np.maximum(apart((low + high) / 2, middle[of], mesh.box) - (high - low) / 2 - side[of, None] / 2, 0)
            return here, of[(gap * gap).sum(axis=1) <= reach**2]

        size, every = nodes.hi - nodes.lo, np.arange(len(side))
        above = np.append(size[0] + _NEST, size[np.repeat(np.arange(len(size)), nodes.children)])
        for top in np.flatnonzero(((size <= _NEST) | nodes.leaf) & (above > _NEST)):
            within_top, some = beside(top, every)
            for n in np.flatnonzero(nodes.leaf & (nodes.lo >= within_top.start) & (nodes.hi <= within_top.stop)):
                here, near = beside(n, some)
                took = np.repeat(starts[near], sizes[near]) + np.arange(sizes[near].sum()) - np.repeat(np.cumsum(sizes[near]) - sizes[near], sizes[near])
                out[here] += pulled(at[here], np.concatenate([far[:, 1:], single[took]]), np.concatenate([far[:, 0], np.ones(len(took))]), mesh, alpha, reach)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows in the order of their groups, a group's own particles first: the forces on these, some of what was sent at a time."""
        now, ids, own, got, held = None, None, None, [], 0
        for batch in batches:
            places_of = list(zip(*(batch.column(c).to_pylist() for c in (*GROUP, "sent")), strict=True))
            for row, (*group, is_sent) in enumerate(places_of):
                if not is_sent:
                    if own:
                        if got:
                            pulls(own, got)
                        yield forces_of(ids, own[2])
                    ids, keys, at = points_of(batch.column("points"), row, places)
                    now, own, got, held = group, (Nodes(keys, group[0], mesh, bits, leaf), at, np.zeros_like(at)), [], 0
                elif group == now:  # parts without particles get what nobody reads
                    got.append([batch.column(c)[row].values.to_numpy() for c in ("far", "leaves", "sizes", "single")])
                    held += sum(map(len, got[-1]))
                    if held > _HELD:
                        pulls(own, got)
                        got, held = [], 0
        if own:
            if got:
                pulls(own, got)
            yield forces_of(ids, own[2])

    def forces_of(ids: np.ndarray, out: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(np.ascontiguousarray(out[:, k])) for k in range(d))], schema=told)

    empty = [F.lit(None).cast(kind).alias(c) for c, kind in (("far", "array<double>"), ("leaves", "array<double>"), ("sizes", "array<long>"), ("single", "array<double>"))]
    first = packed.select(*GROUP, F.lit(False).alias("sent"), "points", *empty)
    then = exports.select(*GROUP, F.lit(True).alias("sent"), F.lit(None).cast(packed.schema["points"].dataType).alias("points"), "far", "leaves", "sizes", "single")
    parts = max(int(particles.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(_TASKS, groups.count()))
    forces = first.union(then).repartition(parts, *GROUP).sortWithinPartitions(*GROUP, "sent").mapInArrow(total, "id long, " + ", ".join(f"a{x} double" for x in places))
    count = packed.agg(F.sum("n").alias("__n"))
    return forces.join(F.broadcast(count), how="cross").select("id", *[(F.col(f"a{x}") * unit / F.col("__n")).alias(f"a{x}") for x in places])
