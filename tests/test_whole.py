"""Queries over whole tables against numpy and union-find, beside their SQL."""

import numpy as np
from pyspark.sql import functions as F

from numera.plans import library
from tests.oracle import connect

WHERE = "/root/testdata/sf0.01"


def run(spark, name):
    return library.queries()[name](spark, WHERE)


def test_interpolation_of_every_user(spark):
    by = {}
    for u, x, y in connect(WHERE).sql("select user_id, epoch(ts), avg(value) from events group by all order by 1, 2").fetchall():
        by.setdefault(u, []).append((x, y))
    want = {}
    for u, p in by.items():
        x, y = map(np.array, zip(*p))
        q = np.array([x[0] + (x[-1] - x[0]) * f for f in (0.1, 0.5, 0.73)])
        want[u] = sorted(zip(q, np.interp(q, x, y)))
    got = {}
    for r in run(spark, "k131_k133_interpolation").collect():
        got.setdefault(r.user_id, []).append((r.p, r.y))
        assert r.relation == "APPROXIMATION_OF"
    assert got.keys() == want.keys() and max(got) >= 40
    for u in want:
        assert np.allclose(sorted(got[u]), want[u], atol=6e-3, rtol=1e-9)


def test_autocorrelation_of_all_events(spark):
    v = np.array([x for (x,) in connect(WHERE).sql("select value from events order by ts, event_id").fetchall()], float)
    got = {r.k: (r.r, r.independent) for r in run(spark, "w008_autocorrelation").collect()}
    for k in range(1, 6):
        r = np.corrcoef(v[k:], v[:-k])[0, 1]
        assert abs(got[k][0] - r) < 2e-6 and got[k][1] == (abs(r) <= 2 / np.sqrt(len(v) - k))


def test_places_by_ranges(spark):
    from numera.operators import labelled

    rows = [(i * 7919 % 5003, i % 3) for i in range(5003)]
    for part in (rows, rows[:40], rows[:1], []):
        df = spark.createDataFrame(part, "a long, b long").repartition(5)
        got = labelled.numbered(df, [F.col("b"), -F.col("a")]).collect()
        assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.place)] == sorted(part, key=lambda r: (r[1], -r[0]))
        assert sorted(r.place for r in got) == list(range(len(part)))


def test_every_order_has_its_place(spark):
    keys = [k for (k,) in connect(WHERE).sql("select o_orderkey from orders order by o_totalprice desc nulls last, o_orderkey").fetchall()]
    assert {r.o_orderkey: r.place for r in run(spark, "k041_sort_values").collect()} == {k: i + 1 for i, k in enumerate(keys)} and len(keys) > 50


def test_graph_of_all_lineitem(spark):
    edges = connect(WHERE).sql("select l_orderkey, 1000000000 + l_partkey from lineitem").fetchall()
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    got = {r.id: r.component for r in run(spark, "k230_connected_components").collect()}
    assert got == {x: root(x) for x in up}
    low = min(a for a, _ in edges)
    assert {r.id for r in run(spark, "a030_reachability").collect()} == {x for x in up if root(x) == root(low)}


def test_sparse_matrix_of_all_parts(spark):
    con = connect(WHERE)
    rows = con.sql("select p_size, p_partkey % 11, count(*) from part group by all order by 1, 2").fetchall()
    got = run(spark, "k201_k204_sparse").collect()
    assert sorted((r.place, r.row, r.col, r.v) for r in got) == [(i, *r) for i, r in enumerate(rows)]
    assert sum(r.v for r in got) == con.sql("select count(*) from part").fetchall()[0][0] and max(r.row for r in got) >= 6
