"""Particle snapshots in the public binary layout of Gadget-2 (formats 1 and 2), as a Spark data source.

A file is a header of 256 bytes and one block a quantity (positions, velocities, ids, masses), each between two markers
of its length; a snapshot is any number of files, a series one folder snapdir_NNN a snapshot. A task reads a range of rows
of one file: it seeks once in each block that its columns need, and no more. Written snapshots have an index beside them
(rows, least and greatest id of every file, in the order of ids), so that a range of ids opens the files that can hold
them and, as ids ascend in a file, seeks to its rows. Any store that pyarrow.fs can open serves.

    spark.read.format("gadget").schema("id long, x double").option("first", 100).option("last", 199).load(path)
    write(particles, path, Header(...))

Ranges of ids and sets of snapshots are options of a load, or with the option pushdown they are taken from its filters.
Spark 4.1 keeps pushed filters with the load and not with the query, so such a load has to be filtered in one way only:
two differently filtered branches of it would both get the last one's rows. Without the option filters stay with Spark.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.mesh import Mesh
from ..plans.ship import ship
from .files import Header, arranged

#: Columns by block; the place of a column in its block's rows.
BLOCKS = {"POS": ("x", "y", "z"), "VEL": ("vx", "vy", "vz"), "ID": ("id",), "MASS": ("mass",)}
LABELS = {"POS ": "POS", "VEL ": "VEL", "ID  ": "ID", "MASS": "MASS"}
SCHEMA = "id long, x double, y double, z double, vx double, vy double, vz double, mass double, snap int"
#: The header's fields by the format's description; six kinds of particles, of which dark matter is kind 1.
HEAD = [
    ("npart", "i4", 6), ("mass", "f8", 6), ("time", "f8"), ("redshift", "f8"), ("flag_sfr", "i4"), ("flag_feedback", "i4"), ("npart_total", "u4", 6), ("flag_cooling", "i4"), ("num_files", "i4"),
    ("box", "f8"), ("omega0", "f8"), ("omega_lambda", "f8"), ("hubble", "f8"), ("flag_age", "i4"), ("flag_metals", "i4"), ("npart_total_high", "u4", 6), ("flag_entropy", "i4"), ("fill", "V60"),
]
KIND, INDEX = 1, "index.json"


def head_type(order: str = "<") -> np.dtype:
    return np.dtype([(f[0], f[1] if f[1].startswith("V") else order + f[1], *f[2:]) for f in HEAD])


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class File:
    """Where a file's blocks begin, with the bytes of a number and of an id, and its particles of the kind."""

    path: str
    order: str
    first: int
    rows: int
    blocks: dict[str, tuple[int, int]]  # begin of the kind's rows, bytes a number
    head: np.void


def opened(system: fs.FileSystem, path: str) -> File:
    """A file's layout, from its header and the markers of its blocks: one short read a block."""
    with system.open_input_file(path) as f:
        size = f.size()
        mark = f.read_at(4, 0)
        order = "<" if int.from_bytes(mark, "little") in (8, 256) else ">"
        if int(np.frombuffer(mark, order + "i4")[0]) not in (8, 256):
            raise ValueError(f"{path} is no snapshot: its first block has neither 256 nor 8 bytes")
        number = lambda at: int(np.frombuffer(f.read_at(4, at), order + "u4")[0])
        at, names, found, head = 0, ["HEAD", "POS", "VEL", "ID", "MASS"], {}, None
        while at < size:
            length, name = number(at), None
            if length == 8:  # format 2: a label, and the bytes to the next one
                name = LABELS.get(f.read_at(4, at + 4).decode("latin-1"), "HEAD" if head is None else "other")
                at += 16
                length = number(at)
            elif names:
                name = names.pop(0)
            if name == "HEAD":
                head = np.frombuffer(f.read_at(256, at + 4), head_type(order))[0]
            elif name in BLOCKS:
                all_rows = int(head["npart"].sum())
                if name == "MASS":
                    with_block = head["npart"] * (head["mass"] == 0)
                    before, count = int(with_block[:KIND].sum()), int(with_block.sum())
                else:
                    before, count = int(head["npart"][:KIND].sum()), all_rows
                width = length // count // len(BLOCKS[name]) if count else 8
                if not (name == "MASS" and head["mass"][KIND]):
                    found[name] = (at + 4 + before * width * len(BLOCKS[name]), width)
            at += length + 8
        if head is None:
            raise ValueError(f"{path} has no header")
        return File(path, order, 0, int(head["npart"][KIND]), found, head)


def snapshots(system: fs.FileSystem, root: str) -> dict[int, str]:
    """Folders of a series by number, or the path itself as snapshot 0."""
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(root)
    if info.type == fs.FileType.File:
        return {0: root}
    inside = system.get_file_info(fs.FileSelector(root))
    series = {int(i.base_name.rpartition("_")[2]): i.path for i in inside if i.type == fs.FileType.Directory and i.base_name.startswith("snapdir_")}
    return dict(sorted(series.items())) or {0: root}


def parts(system: fs.FileSystem, folder: str) -> list[dict]:
    """Files of one snapshot; with rows and ids from the index if there is one."""
    if system.get_file_info(folder).type == fs.FileType.File:
        return [{"path": folder}]
    index = f"{folder}/{INDEX}"
    if system.get_file_info(index).type == fs.FileType.File:
        with system.open_input_file(index) as f:
            return [{**x, "path": f"{folder}/{x['name']}"} for x in json.loads(f.read())["files"]]
    names = [i.path for i in system.get_file_info(fs.FileSelector(folder)) if i.type == fs.FileType.File and not i.base_name.startswith((".", "_"))]
    return [{"path": p} for p in sorted(names, key=lambda p: (len(p), p))]


@dataclass
class Rows(InputPartition):
    """A range of rows of one file."""

    path: str
    snap: int
    first: int
    count: int
    sorted: bool


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, options: dict):
        self.path, self.names, self.options = path, [f.name for f in schema], options
        unknown = set(self.names) - set(c for b in BLOCKS.values() for c in b) - {"snap"}
        if unknown:
            raise ValueError(f"a snapshot has no columns {sorted(unknown)}")
        self.low, self.high = int(options.get("first", -(1 << 63))), int(options.get("last", (1 << 63) - 1))
        self.snaps = {int(x) for x in options["snaps"].split(",")} if options.get("snaps") else None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """With the option pushdown ranges of ids and sets of snapshots are kept here; all else stays with Spark."""
        for f in filters:
            if self.options.get("pushdown", "false") != "true":
                yield f
                continue
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("id",) and isinstance(value, int) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, value - isinstance(f, LessThan))
            elif column == ("snap",) and isinstance(f, (EqualTo, In)) and value is not None:
                wanted = {value} if isinstance(f, EqualTo) else set(value)
                self.snaps = wanted if self.snaps is None else self.snaps & wanted
            else:
                yield f

    def partitions(self) -> list[Rows]:
        """Ranges of at most `rows` rows (option, a million by default) of the files that can hold what is asked for."""
        system, root = located(self.path)
        most, every = int(self.options.get("rows", 1 << 20)), int(self.options.get("every", 1))
        out = []
        found = [(snap, folder) for snap, folder in snapshots(system, root).items() if self.snaps is None or snap in self.snaps]
        for snap, folder in found[::every]:
            for part in parts(system, folder):
                known = "rows" in part
                if known and (not part["rows"] or part["last"] < self.low or part["first"] > self.high):
                    continue
                rows = part["rows"] if known else opened(system, part["path"]).rows
                out += [Rows(part["path"], snap, at, min(most, rows - at), known) for at in range(0, rows, most)]
        return out

    def read(self, part: Rows | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # nothing to read
            return
        system, _ = located(self.path)
        file = opened(system, part.path)
        with system.open_input_file(part.path) as f:

            def block(name: str, first: int, count: int) -> np.ndarray:
                at, width = file.blocks[name]
                wide, kind = len(BLOCKS[name]), "u" if name == "ID" else "f"
                return np.frombuffer(f.read_at(count * wide * width, at + first * wide * width), f"{file.order}{kind}{width}").reshape(count, wide)

            first, end, kept = part.first, part.first + part.count, None
            asked = self.low > -(1 << 63) or self.high < (1 << 63) - 1
            if asked and part.sorted:  # ids ascend: their places by bisection, some reads of one id each
                whole = (first, end)

                def place(value: int) -> int:
                    low, high = whole
                    while low < high:
                        middle = (low + high) // 2
                        low, high = (middle + 1, high) if int(block("ID", middle, 1)[0, 0]) < value else (low, middle)
                    return low

                first, end = place(self.low), place(self.high + 1) if self.high < (1 << 63) - 1 else end
            for at in range(first, end, 1 << 16):
                count = min(1 << 16, end - at)
                got = {}
                if asked and not part.sorted:
                    got["ID"] = block("ID", at, count)
                    ids = got["ID"][:, 0].astype(np.int64)
                    kept = (ids >= self.low) & (ids <= self.high)
                    if not kept.any():
                        continue
                columns = []
                for name in self.names:
                    if name == "snap":
                        values = np.full(count, part.snap, np.int32)
                    elif name == "mass" and "MASS" not in file.blocks:
                        values = np.full(count, float(file.head["mass"][KIND]))
                    else:
                        of = next(b for b, cs in BLOCKS.items() if name in cs)
                        if of not in got:
                            got[of] = block(of, at, count)
                        values = got[of][:, BLOCKS[of].index(name)].astype(np.int64 if name == "id" else np.float64)
                    columns.append(pa.array(values[kept] if kept is not None else values))
                yield pa.RecordBatch.from_arrays(columns, names=self.names)


@dataclass
class Written(WriterCommitMessage):
    """A task's file, its rows and ids."""

    name: str
    number: int
    rows: int
    first: int
    last: int


class Writer(DataSourceArrowWriter):
    """One file a task, in a folder of its own until all are there; the index is written last."""

    def __init__(self, path: str, schema: StructType, options: dict):
        self.path, self.names, self.options = path.rstrip("/"), [f.name for f in schema], options
        needed = {c for b in ("POS", "VEL", "ID") for c in BLOCKS[b]}
        if not needed <= set(self.names) or "header" not in options:
            raise ValueError(f"a snapshot has the columns {sorted(needed)} and a header; use gadget.write")
        self.head = json.loads(options["header"])
        self.width = 4 if options.get("precision", "double") == "single" else 8
        self.trial = f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task = TaskContext.get()
        batches = list(iterator)
        table = pa.Table.from_batches(batches) if batches else None
        rows = table.num_rows if batches else 0
        columns = {c: table.column(c).to_numpy().astype(np.int64 if c == "id" else f"<f{self.width}") for c in self.names} if rows else {}
        order = np.argsort(columns["id"], kind="stable") if rows else np.zeros(0, np.int64)
        ids = columns["id"][order] if rows else order
        name = f"part-{task.partitionId()}-{task.attemptNumber()}"
        system, root = located(self.path)
        system.create_dir(f"{root}/{self.trial}", recursive=True)
        with system.open_output_stream(f"{root}/{self.trial}/{name}") as f:

            def record(data: bytes | np.ndarray) -> None:
                raw = data if isinstance(data, bytes) else np.ascontiguousarray(data).tobytes()
                mark = np.uint32(len(raw)).astype("<u4").tobytes()
                f.write(mark)
                f.write(raw)
                f.write(mark)

            record(self.header(rows))
            for of in ("POS", "VEL"):
                record(np.stack([columns[c][order] for c in BLOCKS[of]], axis=1) if rows else b"")
            record(ids.astype("<u8"))
        return Written(name, task.partitionId(), rows, int(ids[0]) if rows else 0, int(ids[-1]) if rows else -1)

    def header(self, rows: int) -> bytes:
        h, out = self.head, np.zeros(1, head_type())
        out["npart"][0, KIND], out["mass"][0, KIND] = rows, h["particle_mass"]
        out["npart_total"][0, KIND], out["npart_total_high"][0, KIND] = h["count"] & 0xFFFFFFFF, h["count"] >> 32
        for field, value in (("time", h["a"]), ("redshift", 1 / h["a"] - 1 if h["a"] else 0.0), ("box", h["box"]), ("omega0", h["omega_m"]), ("omega_lambda", h["omega_de"]), ("hubble", h["h"]), ("num_files", int(self.options["files"]))):
            out[field] = value
        return out.tobytes()

    def commit(self, messages: list[Written | None]) -> None:
        system, root = located(self.path)
        done = sorted((m for m in messages if m is not None), key=lambda m: m.number)
        if sum(m.rows for m in done) != self.head["count"]:
            self.abort(messages)
            raise ValueError(f"{sum(m.rows for m in done)} rows written, {self.head['count']} announced")
        files = []
        for n, m in enumerate(done):
            name = f"snapshot.{n}"
            system.move(f"{root}/{self.trial}/{m.name}", f"{root}/{name}")
            files.append({"name": name, "rows": m.rows, "first": m.first, "last": m.last})
        with system.open_output_stream(f"{root}/{INDEX}") as f:
            f.write(json.dumps({"header": self.head, "files": files}).encode())
        system.delete_dir(f"{root}/{self.trial}")

    def abort(self, messages: list[Written | None]) -> None:
        system, root = located(self.path)
        if system.get_file_info(f"{root}/{self.trial}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.trial}")


class Gadget(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gadget"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], schema, dict(self.options))


def register(spark: SparkSession) -> None:
    """The format, and Spark's switch that lets filters reach Python sources."""
    ship(spark)
    spark.dataSource.register(Gadget)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, columns: list[str] | None = None, rows: int = 1 << 20, every: int = 1, ids: tuple[int, int] | None = None, snaps: list[int] | None = None, pushdown: bool = False) -> DataFrame:
    """Particles of a snapshot or a series; only the blocks of the columns asked for are read.

    ids: least and greatest id; snaps: numbers of snapshots, of which every so many are taken; pushdown: see above.
    """
    register(spark)
    types = dict(c.split() for c in SCHEMA.split(", "))
    asked = columns or list(types)
    reader = spark.read.format("gadget").schema(", ".join(f"{c} {types[c]}" for c in asked)).option("rows", rows).option("every", every).option("pushdown", str(pushdown).lower())
    if ids is not None:
        reader = reader.option("first", ids[0]).option("last", ids[1])
    if snaps is not None:
        reader = reader.option("snaps", ",".join(map(str, snaps)))
    return reader.load(path)


def header(path: str, snap: int = 0) -> Header:
    """What the first file of a snapshot says of it."""
    system, root = located(path)
    folders = snapshots(system, root)
    h = opened(system, parts(system, folders.get(snap, root))[0]["path"]).head
    count = int(h["npart_total"][KIND]) + (int(h["npart_total_high"][KIND]) << 32)
    return Header(float(h["time"]), float(h["box"]), count, float(h["omega0"]), float(h["omega_lambda"]), float(h["hubble"]), float(h["mass"][KIND]))


def load(spark: SparkSession, path: str, suite: str, mesh: Mesh, sub: int = 1, snap: int = 0) -> tuple[DataFrame, Header]:
    """A snapshot of a suite as initial conditions; velocities are stored as they are, over the root of a."""
    head = header(path, snap)
    rows = read(spark, path, ["id", "x", "y", "z", "vx", "vy", "vz"], snaps=[snap])
    moving = rows.select("id", *mesh.places, *[(rows[f"v{x}"] * math.sqrt(head.a)).alias(f"v{x}") for x in mesh.places])
    return arranged(moving, head, suite, mesh, sub), head


def write(particles: DataFrame, path: str, head: Header, rows: int = 4_000_000, precision: str = "double", snap: int | None = None) -> Header:
    """Particles (id, x, y, z, vx, vy, vz) as a snapshot of files of some `rows` particles each, in the order of ids; its header with the true count.

    Ranges of ids are tasks, a task's file is whole in its memory once. An attempt that fails leaves nothing behind; the
    files become a snapshot when all are written.
    """
    spark = particles.sparkSession
    register(spark)
    count = particles.count()
    head, files = replace(head, count=count), max(1, math.ceil(count / rows))
    columns = [c for b in ("ID", "POS", "VEL") for c in BLOCKS[b]]
    dealt = particles.select(*columns).repartitionByRange(files, "id") if files > 1 else particles.select(*columns).repartition(1)
    at = path if snap is None else f"{path.rstrip('/')}/snapdir_{snap:03d}"
    dealt.write.format("gadget").option("header", json.dumps(asdict(head))).option("files", files).option("precision", precision).mode("append").save(at)
    return head
