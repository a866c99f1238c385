"""Groups solved by the task that has them, and what is left to rounds."""

import math
from collections import defaultdict

from pyspark.sql import functions as F

from numera.operators import chains, propagation
from numera.plans import library
from tests.test_disk import left


def test_large_functions_are_left_to_rounds(spark):
    """A function of 70 blocks and definitions, beside a small one and nulls."""
    star = [(1, 0, k) for k in range(1, 70)] + [(2, 5, 6), (None, 0, 1)]
    e = spark.createDataFrame(star, "function long, src long, dst long")
    b = spark.createDataFrame([(1, 0, True), (2, 5, True), (3, 9, True), (None, 0, True)], "function long, block long, entry boolean")
    want = {(1, 0, 0), (2, 5, 5), (2, 6, 6), (2, 6, 5), (3, 9, 9)} | {(1, k, d) for k in range(1, 70) for d in (0, k)}
    assert {tuple(x)[:3] for x in chains.dominators(b, e).collect()} == want
    defs = spark.createDataFrame([(1, 0, k, k) for k in range(70)] + [(2, 5, 1, 1), (None, 0, 3, 3)], "function long, block long, definition long, variable long")
    got = [tuple(x) for x in chains.reaching_definitions(e, defs).collect()]
    assert sorted(got) == sorted({(1, b, k) for b in range(1, 70) for k in range(70)} | {(2, 6, 1)})


def test_dominators_of_a_chain_take_one_table(spark):
    chain = [(f, k, k + 1) for f in range(3) for k in range(40)]
    before = left(spark)
    got = chains.dominators(spark.createDataFrame([(f, 0, True) for f in range(3)], "function long, block long, entry boolean"), spark.createDataFrame(chain, "function long, src long, dst long"))
    by = defaultdict(set)
    for x in got.collect():
        by[x.function, x.block].add(x.dominator)
    assert by == {(f, k): set(range(k + 1)) for f in range(3) for k in range(41)}
    assert left(spark) - before <= 2  # a round for each block would leave dozens


def test_definitions_along_a_chain_take_one_table(spark):
    before = left(spark)
    e = spark.createDataFrame([(1, k, k + 1) for k in range(20)], "function long, src long, dst long")
    got = chains.reaching_definitions(e, spark.createDataFrame([(1, 0, 7, 1)], "function long, block long, definition long, variable long"))
    assert sorted(map(tuple, got.collect())) == [(1, k, 7) for k in range(1, 21)] and left(spark) - before <= 2


def test_slices_along_a_chain_take_one_table(spark):
    """Line k sets name k from name k - 1: all lines but those of another name are needed."""
    before = left(spark)
    code = spark.createDataFrame([(1, k, f"v{k}", f"v{k - 1}") for k in range(1, 21)] + [(1, 30, "w", "v3")], "function long, pos long, name string, read string")
    none = spark.createDataFrame([], "function long, name string, other string")
    got = chains.backward_slice(code.select("function", "pos", "name"), code.select("function", "pos", code.read.alias("name")), none, spark.createDataFrame([(1, "v20")], "function long, name string"))
    assert sorted(map(tuple, got.collect())) == [(1, k) for k in range(1, 21)] and left(spark) - before <= 2


def test_slopes_of_groups(spark):
    """As ``test_sensitivities_are_slopes``, in two groups, with two outputs, a cycle, an edge to no node, and a group at fault."""
    nodes = [("x", "Input", 1.3), ("y", "Input", 0.7), ("p", "Multiply", None), ("s", "Sin", None), ("q", "Divide", None), ("m", "Mean", None), ("e", "Exp", None), ("d", "Subtract", None), ("top", "Add", None), ("big", "Maximum", None), ("alone", "Input", 2.0), ("c1", "Add", None), ("c2", "Add", None)]
    edges = [("x", "p", 0), ("y", "p", 1), ("p", "s", 0), ("s", "q", 0), ("y", "q", 1), ("x", "m", 0), ("q", "m", 0), ("p", "m", 0), ("y", "e", 0), ("m", "d", 0), ("e", "d", 1), ("d", "top", 0), ("x", "top", 0), ("x", "big", 0), ("y", "big", 0), ("c1", "c2", 0), ("c2", "c1", 0), ("nothing", "top", 0)]
    at = {n[0]: k for k, n in enumerate(nodes)} | {"nothing": 99}
    outs, rows = ("top", "big", "alone", "c1"), []
    for g in (1, 2, 3):
        rows += [(g, at[n], None, None, op, v, n, n in outs) for n, op, v in nodes] + [(g, at[a], at[b], k, None, None, None, None) for a, b, k in edges]
    rows.append((3, 0, None, None, "Input", 5.0, "x", False))  # the same node again
    graph = spark.createDataFrame(rows, f"g bigint, {propagation.GRAPH_ROW}").repartition("g").sortWithinPartitions("g")
    found, left_over = propagation.grouped_sensitivities(graph, "g")
    got = {(x.g, x.output, x.input): x.derivative for x in found.collect()}
    f = lambda x, y: (x + math.sin(x * y) / y + x * y) / 3 - math.exp(y) + x
    h = 1e-6
    for g in (1, 2):
        assert abs(got[g, "top", "x"] - (f(1.3 + h, 0.7) - f(1.3 - h, 0.7)) / (2 * h)) < 1e-6 and abs(got[g, "top", "y"] - (f(1.3, 0.7 + h) - f(1.3, 0.7 - h)) / (2 * h)) < 1e-6
        assert got[g, "big", "x"] is None and got[g, "big", "y"] is None and got[g, "alone", "alone"] == 1
    assert len(got) == 10 and [x.g for x in left_over.collect()] == [3]


def test_slopes_leave_one_table(spark):
    before = left(spark)
    out = library.queries()["a018_sensitivities"](spark, "/root/testdata/sf0.001")
    assert out.count() == 2 * spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count() and left(spark) - before <= 1
    assert out.where(F.col("derivative").isNull()).isEmpty()
