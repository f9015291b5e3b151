"""User functions from SQL text: nulls, empty partitions, several arguments, orders."""

import numpy as np

from meshweave.functions import usercode


def test_scalar_functions(spark):
    usercode.scalar(spark, "halved", lambda v: v / 2)
    usercode.scalar(spark, "hypotenuse", np.hypot)
    usercode.scalar(spark, "counted", lambda v: np.isnan(v).astype(int), "int", nulls=False)
    spark.createDataFrame([(1, 3.0, 4.0), (2, None, 4.0), (3, 5.0, 12.0), (4, 8.0, None)], "id long, a double, b double").createOrReplaceTempView("sides")
    rows = {r[0]: tuple(r)[1:] for r in spark.sql("SELECT id, halved(a), hypotenuse(a, b), counted(b) FROM sides").collect()}
    assert rows == {1: (1.5, 5.0, 0), 2: (None, None, 0), 3: (2.5, 13.0, 0), 4: (4.0, None, 1)}
    assert spark.sql("SELECT halved(a) FROM sides WHERE id < 0").collect() == []
    assert spark.sql("SELECT sum(halved(a)) FROM sides WHERE halved(a) > 2").first()[0] == 6.5


def test_table_functions(spark):
    usercode.table(spark, "extent", lambda c: {"low": [np.nanmin(c["v"])], "high": [np.nanmax(c["v"])], "n": [len(c["v"])]} if np.isfinite(c["v"].astype(float)).any() else {"low": [], "high": [], "n": []}, "k int, low double, high double, n long", keys=("k",))
    usercode.table(spark, "steps", lambda c: {"t": c["t"][1:], "step": np.diff(c["v"])}, "name string, t long, step double", keys=("name",))
    spark.createDataFrame([(1, 2.0), (1, 5.0), (1, None), (2, None), (3, 7.0), (None, 1.0)], "k int, v double").createOrReplaceTempView("measured")
    got = {tuple(r) for r in spark.sql("SELECT * FROM extent(TABLE(measured) PARTITION BY k)").collect()}
    assert got == {(1, 2.0, 5.0, 3), (3, 7.0, 7.0, 1), (None, 1.0, 1.0, 1)}  # partition 2 has no numbers and tells nothing
    assert spark.sql("SELECT * FROM extent(TABLE(SELECT * FROM measured WHERE k > 9) PARTITION BY k)").collect() == []
    spark.createDataFrame([("a", 3, 9.0), ("a", 1, 1.0), ("a", 2, 4.0), ("b", 1, 0.0)], "name string, t long, v double").createOrReplaceTempView("series")
    got = [tuple(r) for r in spark.sql("SELECT * FROM steps(TABLE(series) PARTITION BY name ORDER BY t) ORDER BY t").collect()]
    assert got == [("a", 2, 3.0), ("a", 3, 5.0)]
