"""Snapshots in the binary layout: round trips, files made by hand in all variants, filters that reach the files, tasks that fail."""

import json
import os
import subprocess
import sys

import numpy as np
import pytest

from meshweave.operators.mesh import Mesh
from meshweave.sources import files, gadget

HEAD = files.Header(0.5, 100.0, 0, 0.3, 0.7, 0.67, 2.5)
COLUMNS = ["id", "x", "y", "z", "vx", "vy", "vz"]


def particles(spark, n=1000, seed=1):
    rng = np.random.default_rng(seed)
    ids = rng.permutation(n * 3)[:n] + 10
    return spark.createDataFrame([(int(i), *map(float, rng.uniform(0, 100, 6))) for i in ids], "id long, " + ", ".join(f"{c} double" for c in COLUMNS[1:])).repartition(4)


def values(df):
    return sorted(tuple(r) for r in df.collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString() + df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_round_trip_and_pruned_files(spark, tmp_path):
    df, path = particles(spark), f"file://{tmp_path}/snap"
    head = gadget.write(df, path, HEAD, rows=120)
    assert head.count == 1000 and gadget.header(path) == head
    back = gadget.read(spark, path, rows=50)
    assert values(back.select(*COLUMNS)) == values(df.select(*COLUMNS))
    assert {(r["mass"], r["snap"]) for r in back.collect()} == {(2.5, 0)}
    index = json.load(open(f"{tmp_path}/snap/index.json"))
    assert sum(f["rows"] for f in index["files"]) == 1000 and len(index["files"]) == 9
    assert all(a["last"] < b["first"] for a, b in zip(index["files"], index["files"][1:], strict=False))
    asked = gadget.read(spark, path, ["x", "id"], rows=50, pushdown=True).where("id >= 500 AND id < 700 AND x > 5")
    assert "GreaterThanOrEqual(id,500)" in plan(asked) and "LessThan(id,700)" in plan(asked)
    assert asked.rdd.getNumPartitions() < back.rdd.getNumPartitions() / 4
    assert values(asked) == values(df.where("id >= 500 AND id < 700 AND x > 5").select("x", "id"))
    ranged = gadget.read(spark, path, ["x", "id"], rows=50, ids=(500, 699))
    assert ranged.rdd.getNumPartitions() == asked.rdd.getNumPartitions() and values(ranged.where("x > 5")) == values(asked)
    assert values(back.where("id < 900").unionByName(back.where("id >= 900")).select("id")) == values(df.select("id"))
    for pushdown in (False, True):
        assert gadget.read(spark, path, ["id"], pushdown=pushdown).where("id = -1").collect() == []
    single = f"file://{tmp_path}/single"
    gadget.write(df, single, HEAD, precision="single")
    for a, b in zip(values(gadget.read(spark, single, COLUMNS)), values(df.select(*COLUMNS)), strict=True):
        assert a[0] == b[0] and np.allclose(a[1:], b[1:], rtol=1e-6)


def record(f, data, order, label=None):
    mark = lambda n: np.array([n], order + "u4").tobytes()
    raw = data if isinstance(data, bytes) else data.tobytes()
    if label:
        f.write(mark(8) + label.encode() + mark(len(raw) + 8) + mark(8))
    f.write(mark(len(raw)) + raw + mark(len(raw)))


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("labels", [False, True])
def test_files_of_others(spark, tmp_path, order, labels):
    """Gas, dark matter of single masses and stars in two files, 32-bit numbers and ids, no index."""
    rng, want = np.random.default_rng(3), []
    for n, (gas, dark, stars) in enumerate([(3, 5, 2), (0, 4, 1)]):
        count = gas + dark + stars
        head = np.zeros(1, gadget.head_type(order))
        head["npart"][0, [0, 1, 4]], head["mass"][0, 4] = (gas, dark, stars), 7.0
        head["npart_total"][0, 1], head["box"], head["time"], head["num_files"] = 9, 50.0, 0.25, 2
        pos, vel = rng.uniform(0, 50, (2, count, 3)).astype(order + "f4")
        ids, mass = (rng.permutation(1000)[:count]).astype(order + "u4"), rng.uniform(1, 2, gas + dark).astype(order + "f4")
        with open(tmp_path / f"snap_000.{n}", "wb") as f:
            for label, data in (("HEAD", head.tobytes()), ("POS ", pos), ("VEL ", vel), ("ID  ", ids), ("MASS", mass)):
                record(f, data, order, label if labels else None)
            if labels:
                record(f, rng.uniform(0, 1, gas).astype(order + "f4"), order, "U   ")
        want += [(int(ids[i]), *map(float, (*pos[i], *vel[i])), float(mass[i])) for i in range(gas, gas + dark)]
    got = gadget.read(spark, str(tmp_path), [*COLUMNS, "mass"], rows=3)
    assert values(got) == sorted(want)
    some = gadget.read(spark, str(tmp_path), [*COLUMNS, "mass"], rows=3, pushdown=True).where("id > 400")
    assert values(some) == sorted(w for w in want if w[0] > 400)
    assert values(got.where("id > 400").select("id")) == sorted((w[0],) for w in want if w[0] > 400)
    assert gadget.header(str(tmp_path)).box == 50.0


def test_series(spark, tmp_path):
    df, path = particles(spark, 40), f"file://{tmp_path}/run"
    for snap in (0, 1, 2, 5):
        gadget.write(df.withColumn("x", df.x + snap), path, HEAD, rows=15, snap=snap)
    assert {r["snap"] for r in gadget.read(spark, path, ["snap"], every=2).collect()} == {0, 2}
    some = gadget.read(spark, path, ["snap", "id"], pushdown=True).where("snap IN (1, 5)")
    assert {r["snap"] for r in gadget.read(spark, path, ["snap"], snaps=[1, 2, 5], every=2).collect()} == {1, 5}
    assert "In(snap" in plan(some) and values(some.groupBy("snap").count()) == [(1, 40), (5, 40)]


def test_empty_and_wrong(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    gadget.write(particles(spark).limit(0), path, HEAD)
    assert gadget.read(spark, path).collect() == [] and gadget.header(path).count == 0
    with pytest.raises(Exception, match="no columns"):
        gadget.read(spark, path).sparkSession.read.format("gadget").schema("colour int").load(path).collect()
    (tmp_path / "text").mkdir()
    (tmp_path / "text" / "a").write_text("neither marker nor header")
    with pytest.raises(Exception, match="no snapshot"):
        gadget.read(spark, f"file://{tmp_path}/text").collect()


def test_loads_as_initial_conditions(spark, tmp_path):
    mesh, path = Mesh(3, 4, 100.0), f"file://{tmp_path}/ics"
    lattice = spark.createDataFrame([(i, *[25.0 * c + 1 for c in (i // 16, i // 4 % 4, i % 4)], 1.0, 2.0, 3.0) for i in range(64)], "id long, " + ", ".join(f"{c} double" for c in COLUMNS[1:]))
    gadget.write(lattice, path, HEAD)
    rows, head = gadget.load(spark, path, "gadget_generic", mesh)
    got = {r["id"]: r for r in rows.collect()}
    assert head.box == 100.0 and got[21]["x"] == 26.0 and abs(got[21]["pz"] - 3.0 * 0.5**0.5 / 100 * 0.5) < 1e-12


FAILS = """
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from pyspark import TaskContext
from meshweave.sources import files, gadget
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")

def trips(batches):
    for n, batch in enumerate(batches):
        yield batch
    if TaskContext.get().attemptNumber() < {times} and TaskContext.get().partitionId() == 1:
        raise RuntimeError("lost")

ids = spark.range(0, 600, 1, 3).selectExpr("id", *[f"cast(id as double) as {{c}}" for c in ("x", "y", "z", "vx", "vy", "vz")])
gadget.register(spark)
head = files.Header(0.5, 100.0, 600, 0.3, 0.7, 0.7, 1.0)
import json
from dataclasses import asdict
try:
    ids.mapInArrow(trips, ids.schema).write.format("gadget").option("header", json.dumps(asdict(head))).option("files", 3).mode("append").save({path!r})
    print("rows", gadget.read(spark, {path!r}, ["id"]).distinct().count())
except Exception as e:
    print("failed")
"""


@pytest.mark.parametrize(("times", "said"), [(1, "rows 600"), (9, "failed")])
def test_failed_tasks_run_again_or_leave_nothing(tmp_path, times, said):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", FAILS.format(root=root, times=times, path=f"file://{tmp_path}/snap")], capture_output=True, text=True, timeout=300)
    assert said in out.stdout, out.stderr[-2000:]
    left = sorted(os.listdir(tmp_path / "snap")) if (tmp_path / "snap").exists() else []
    assert left == (["index.json", "snapshot.0", "snapshot.1", "snapshot.2"] if times == 1 else [])
