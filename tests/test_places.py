"""Neighbours and clusters of points, many of them in one place."""

import random

from numera.operators import graph
from numera.plans import library


def test_crowded_points(spark):
    r = random.Random(3)
    p = [(i, 1.0, 2.0) for i in range(120)] + [(i, r.uniform(0, 40), r.uniform(0, 40)) for i in range(120, 240)]
    df = spark.createDataFrame([*p, (500, None, 1.0)], "id long, x double, y double")
    far = lambda a, b: ((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5
    got = {(x.q, x["rank"]): x.id for x in graph.nearest(df, df, 3, 64.0).collect()}
    want = {(q[0], k + 1): b[1] for q in p for k, b in enumerate(sorted((far(q, b), b[0]) for b in p)[:3])}
    assert got == want
    up = {i: i for i, _, _ in p}
    for _ in p:
        for a in p:
            up[a[0]] = min(up[b[0]] for b in p if far(a, b) <= 4)
    assert {x.id: x.cluster for x in graph.within(df, 4.0).collect()} == up | {500: 500}


def test_overlaps_are_told_once(spark):
    df = library.queries()["k250_k252_spatial_index"](spark, "/root/testdata/sf0.001")
    assert "Aggregate" not in df._jdf.queryExecution().optimizedPlan().toString()
