"""Functions and operators on small inputs: nulls, NaN, empty tables, ties, files and streams."""

import io
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from numera.functions import elementwise as E
from numera.functions import errors, intervals, probability, trees
from numera.operators import geometry, graph, labelled, lineage
from numera.sources import files
from numera.streaming import windows

NAN, INF = float("nan"), float("inf")


def test_minimum_and_divide_keep_nan(spark):
    df = spark.createDataFrame([(1.0, NAN), (1.0, None), (1.0, 0.0), (0.0, 0.0), (-2.0, 0.0)], "a double, b double")
    got = df.select(E.minimum("a", "b"), E.maximum("a", "b"), E.divide("a", "b")).collect()
    assert np.isnan(got[0][0]) and np.isnan(got[0][1])
    assert got[1][0] is None and got[1][1] is None
    assert got[2][2] == INF and np.isnan(got[3][2]) and got[4][2] == -INF


def test_wrap_and_saturate(spark):
    df = spark.createDataFrame([(130,), (-129,), (255,), (0,)], "x long")
    assert [tuple(r) for r in df.select(E.wrap("x", 8), E.wrap("x", 8, False), E.saturate("x", 8)).collect()] == [(-126, 130, 127), (127, 127, -128), (-1, 255, 127), (0, 0, 0)]


def test_zero_counts(spark):
    df = spark.createDataFrame([(0,), (1,), (8,), (255,)], "x long")
    assert [tuple(r) for r in df.select(E.leading_zeros("x", 8), E.trailing_zeros("x", 8)).collect()] == [(8, 8), (7, 0), (4, 3), (0, 0)]


def test_intervals_enclose(spark):
    rng = np.random.default_rng(1)
    rows = [tuple(float(v) for v in (*sorted(rng.normal(size=2)), *sorted(rng.normal(size=2)))) for _ in range(200)]
    df = spark.createDataFrame(rows, "al double, ah double, bl double, bh double")
    a, b = intervals.interval(F.col("al"), F.col("ah")), intervals.interval(F.col("bl"), F.col("bh"))
    got = df.select("al", "ah", "bl", "bh", intervals.multiply(a, b).alias("m"), intervals.divide(a, b).alias("d"), intervals.sin(a).alias("s"), intervals.power(a, 2).alias("p")).collect()
    for r in got:
        for x in np.linspace(r.al, r.ah, 9):
            assert r.s.lo <= np.sin(x) <= r.s.hi and r.p.lo <= x * x <= r.p.hi
            for y in np.linspace(r.bl, r.bh, 9):
                assert r.m.lo <= x * y <= r.m.hi
                assert r.d is None or r.d.lo <= x / y <= r.d.hi
        assert (r.d is None) == (r.bl <= 0 <= r.bh)


def test_error_rules_leave_unknown_unknown(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", -1.0, None), ("b", 2.0, 3.0), ("b", -1.0, 2.0)], "o string, c double, b double").withColumn("cause", F.monotonically_increasing_id())
    got = {r.o: r.bound for r in errors.linear_sum(df, ["o"], "cause", "c", "b").collect()}
    assert got == {"a": None, "b": 8.0}


def test_monte_carlo(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (0.3,), (0.4,)], "x double")
    r = probability.monte_carlo(df, [], "x", 0, 1).first()
    assert abs(r["mean"] - 0.25) < 1e-12 and r.status == "ENCLOSED_UNDER_ASSUMPTIONS"
    assert probability.monte_carlo(df, [], "x", -INF, INF).first().status == "UNRESOLVED"


def test_trees():
    t = trees.parse
    assert trees.semantic_hash(t("a*b + 1.0")) == trees.semantic_hash(t("1 + y*x"))
    assert trees.semantic_hash(t("a - b")) != trees.semantic_hash(t("a + b"))
    assert trees.simplify(t("x - x")) == trees.num(0)
    assert trees.simplify(t("x + 0")) == trees.sym("x")
    assert trees.evaluate(t("sqrt(x)"), {"x": -1.0}) is None and trees.evaluate(t("1/x"), {"x": 0}) is None
    assert trees.evaluate(trees.substitute(t("x^2 + y"), {"x": t("y + 1")}), {"y": 2.0}) == 11
    general, what = trees.anti_unify(t("x + 2*y"), t("z + 2*y"))
    assert trees.unify(general, t("q + 2*y")) and list(what) == ["v0"]
    assert trees.unify(trees.call("Add", {"op": "Variable", "name": "a"}, {"op": "Variable", "name": "a"}), t("x + y")) is None
    for bad in ("2 x", "x +", "(x", "x $ y"):
        with pytest.raises(ValueError):
            t(bad)


def test_derivative_matches_differences():
    tree, h = trees.parse("x^3 * sin(x) / (x + 2) - exp(x)"), 1e-6
    d = trees.derivative(tree, "x")
    for x in (0.3, 1.1, 2.5):
        near = (trees.evaluate(tree, {"x": x + h}) - trees.evaluate(tree, {"x": x - h})) / (2 * h)
        assert abs(trees.evaluate(d, {"x": x}) - near) < 1e-5


def test_alignment_and_interpolation(spark):
    a = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "t long, v double")
    b = spark.createDataFrame([(1, 5.0), (2, 6.0), (3, 7.0)], "t long, v double")
    assert labelled.align(a, b, ["t"]).count() == 2 and labelled.align(a, b, ["t"], how="OUTER").count() == 4
    q = spark.createDataFrame([(0.5,), (2.0,), (9.0,)], "q double")
    got = {r.q: r.v for r in labelled.interpolate(a, q, "t", "v", "q").collect()}
    assert got == {0.5: 1.5, 2.0: 3.0, 9.0: None}
    got = {r.q: r.v for r in labelled.interpolate(a, q, "t", "v", "q", outside="clamp").collect()}
    assert got[9.0] == 3.0


def test_graphs(spark):
    v = spark.createDataFrame([(i,) for i in range(8)], "id long")
    e = spark.createDataFrame([(0, 1), (2, 1), (4, 5), (5, 6), (7, 7)], "src long, dst long")
    assert {r.id: r.component for r in graph.components(v, e).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4, 6: 4, 7: 7}
    w = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 5.0), (2, 3, 1.0)], "src long, dst long, w double")
    assert {r.id: (r.dist, r.pred) for r in graph.shortest_paths(w, 0).collect()} == {0: (0.0, None), 1: (1.0, 0), 2: (2.0, 1), 3: (3.0, 2)}
    assert {r.id for r in graph.shortest_paths(w, 0, 1.5).collect()} == {0, 1}
    assert graph.components(v.where("id < 0"), e.where("src < 0")).count() == 0


def test_geodesic_and_ring(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0, 0.0)], "a double, b double, c double, d double")
    assert abs(df.select(geometry.geodesic_inverse()("a", "b", "c", "d").alias("g")).first().g.distance - 111319.490793) < 1e-3
    ring = geometry.box(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(3.0))
    assert df.select(geometry.ring_area(ring)).first()[0] == 6.0


def test_configuration_and_schema(spark):
    rows = [("a", "1", "file", False, 0), ("a", "2", "file", False, 1), ("k", "x", "cli", True, 2)]
    got = {r.name: (r.value, r.overridden) for r in lineage.resolve_configuration(spark.createDataFrame(rows, "name string, value string, source string, sensitive boolean, ord int")).collect()}
    assert got == {"a": ("2", 1), "k": ("<redacted>", 0)}


def test_npy_python_and_inventory(spark, tmp_path):
    buf = io.BytesIO()
    np.save(buf, np.arange(6.0).reshape(2, 3))
    (tmp_path / "a.npy").write_bytes(buf.getvalue())
    got = {(r.i0, r.i1): r.value for r in files.read_npy(spark, str(tmp_path), 2).collect()}
    assert got == {(i, j): i * 3.0 + j for i in range(2) for j in range(3)}
    (tmp_path / "m.py").write_text("import os.path\nfrom json import dump\ndf.to_csv('x')\n")
    (tmp_path / "bad.py").write_text("def f(:\n")
    nodes = files.python_nodes(spark, str(tmp_path)).cache()
    assert {r.module for r in files.imports(nodes).collect()} == {"os.path", "json"}
    assert [r.kind for r in files.sinks(nodes).collect()] == ["TABLE"]
    assert nodes.where("op = 'SyntaxError'").count() == 1
    head = b"# Sphinx inventory version 2\n# Project: p\n# Version: 1\n# zlib\n"
    (tmp_path / "o.inv").write_bytes(head + zlib.compress(b"pkg.f py:function 1 api.html#$ -\n"))
    assert [(r.name, r.uri) for r in files.read_inventory(spark, str(tmp_path)).collect()] == [("pkg.f", "api.html#pkg.f")]
    (tmp_path / "l.rs").write_text("use std::fs;\npub fn go() {}\n")
    assert {(r.kind, r.name) for r in files.source_symbols(spark, str(tmp_path), "*.rs").collect()} == {("use", "std::fs"), ("fn", "go")}


def test_manifest(spark, tmp_path):
    (tmp_path / "x").write_text("1")
    was = spark.createDataFrame(files.manifest(spark, str(tmp_path)).toPandas())
    (tmp_path / "x").write_text("2")
    (tmp_path / "y").write_text("3")
    assert sorted(r.status for r in files.verify(was, files.manifest(spark, str(tmp_path))).collect()) == ["ADDED", "CHANGED"]


def test_stream_equals_batch(spark):
    where = "/root/testdata/sf0.001"
    batch = windows.tumbling(spark.read.parquet(f"{where}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    stream = windows.drain(windows.tumbling(windows.read_events(spark, where)))
    assert sorted(map(tuple, batch.select("start", "event_type", "n").collect())) == sorted(map(tuple, stream.select("start", "event_type", "n").collect()))


def test_promotion():
    from numera.functions.dtypes import promote

    want = {
        ("int32", "float16"): "float32", ("int64", "float16"): "float64", ("int64", "float32"): "float64", ("int16", "float64"): "float64", ("int32", "uint32"): "int64",
        ("uint64", "int8"): "float64", ("int16", "uint8"): "int16", ("int8", "uint8"): "int16", ("bool", "uint8"): "uint8", ("bool", "int8"): "int8", ("bool", "float16"): "float16",
        ("python.int", "bool"): "bool", ("python.int", "uint8"): "uint8", ("python.float", "int8"): "float64", ("python.float", "float16"): "float16", ("python.complex", "float32"): "complex64",
        ("python.complex", "int64"): "complex128", ("python.int", "python.complex"): "python.complex", ("complex64", "float64"): "complex128", ("complex64", "int32"): "complex64", ("text", "int8"): "PROMOTION_UNRESOLVED",
    }
    for (a, b), c in want.items():
        assert promote(a, b) == promote(b, a) == c, (a, b)
