"""What steps leave behind in the shared folder."""

import os

from numera.operators import graph, propagation


def left(spark):
    where = graph.shared_dir(spark).removeprefix("file://")
    return sum(x.startswith("numera-") for x in os.listdir(where)) if os.path.isdir(where) else 0


def test_error_graph_leaves_only_its_results(spark):
    nodes = spark.createDataFrame([("n0", "Input", 2.0, 0.1)] + [(f"n{k}", "Negate", None, None) for k in range(1, 7)], "id string, op string, value double, bound double")
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}", 0) for k in range(6)], "src string, dst string, pos int")
    before = left(spark)
    got = {x.id: x for x in propagation.propagate(nodes, edges).collect()}
    assert [got[f"n{k}"].level for k in range(7)] == list(range(7)) and abs(got["n6"].bound - 0.1) < 1e-12
    assert left(spark) - before <= 10  # leaves, a table for each level, and what is not done
