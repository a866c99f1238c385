"""Splines, tridiagonal systems and linkages against dense solves and merging one pair at a time."""

import random

import numpy as np
from pyspark.sql import functions as F

from numera.operators import numerics, overlay, quantiles
from numera.plans import library
from tests.oracle import connect

WHERE = "/root/testdata/sf0.01"


def curvatures(x, y, kind):
    """Second derivatives of the cubic spline by one dense system."""
    n = len(x)
    if n < 3:
        return np.zeros(n)
    h = np.diff(x)
    if kind == "not-a-knot" and n == 3:
        return np.full(3, 2 * ((y[2] - y[1]) / h[1] - (y[1] - y[0]) / h[0]) / (x[2] - x[0]))
    a, d = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        d[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    if kind == "natural":
        a[0, 0] = a[-1, -1] = 1
    else:
        a[0, :3] = h[1], -(h[0] + h[1]), h[0]
        a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    return np.linalg.solve(a, d)


def test_tridiagonal_across_blocks(spark):
    r = np.random.default_rng(1)
    rows, want = [], {}
    for g, n in enumerate([1, 2, 5, 7, 50, 64]):
        a, c, d = r.normal(size=(3, n))
        b = 3 + np.abs(a) + np.abs(c)
        a[0] = c[-1] = 0
        want[g] = np.linalg.solve(np.diag(b) + np.diag(a[1:], -1) + np.diag(c[:-1], 1), d)
        rows += [(g, i, *map(float, (a[i], b[i], c[i], d[i]))) for i in range(n)]
    df = spark.createDataFrame(rows, "g long, i long, a double, b double, c double, d double").repartition(3)
    for block in (1, 3, 7, 4096):
        got = {(x.g, x.i): x.x for x in numerics.tridiagonal(df, "g", block).collect()}
        assert len(got) == len(rows) and all(abs(got[g, i] - v) < 1e-9 for g, x in want.items() for i, v in enumerate(x))


def test_splines_of_all_lengths(spark):
    r = np.random.default_rng(2)
    series = {g: (np.sort(r.choice(200, n, replace=False)) * 0.5, r.normal(size=n)) for g, n in enumerate([1, 2, 3, 4, 5, 9, 40])}
    points = spark.createDataFrame([(g, float(a), float(b)) for g, (x, y) in series.items() for a, b in zip(x, y)] + [(0, None, 1.0), (1, 3.25, None)], "g long, x double, y double").repartition(4)
    for kind in ("natural", "not-a-knot"):
        for block in (2, 4096):
            got = {(k.g, k.i): k.m for k in numerics.spline(points, "g", "x", "y", kind, block).collect()}
            for g, (x, y) in series.items():
                assert np.allclose([got[g, i] for i in range(len(x))], curvatures(x, y, kind), atol=1e-8), (kind, block, g)
    none = numerics.spline(points.limit(0), "g", "x", "y")
    assert none.count() == 0


def test_not_a_knot_of_every_user(spark):
    by = {}
    for u, x, y in connect(WHERE).sql("select user_id, epoch(ts) / 86400, avg(value) from events group by all order by 1, 2").fetchall():
        by.setdefault(u, []).append((x, y))
    got = {}
    for k in library.queries()["k132_not_a_knot_spline"](spark, WHERE).collect():
        got[k.user_id, k.f] = k.y
    assert {u for u, _ in got} == set(by)
    for (u, f), v in got.items():
        x, y = map(np.array, zip(*by[u]))
        m, p = curvatures(x, y, "not-a-knot"), x[0] + (x[-1] - x[0]) * f
        i = min(max(np.searchsorted(x, p, side="right") - 1, 0), len(x) - 2)
        h, s, t = x[i + 1] - x[i], p - x[i], x[i + 1] - p
        want = (m[i] * t**3 + m[i + 1] * s**3) / (6 * h) + (y[i] / h - m[i] * h / 6) * t + (y[i + 1] / h - m[i + 1] * h / 6) * s
        assert abs(v - want) < 1e-3 + 1e-6 * abs(want), (u, f)


def merged(points, dist, method):
    """Merges of the nearest pair at a time, distances between clusters from those of their points."""
    size, d, out = {p: 1 for p in points}, {frozenset(k): v for k, v in dist.items()}, []
    while len(size) > 1:
        h, l, r = min((d[frozenset((a, b))], a, b) for a in size for b in size if a < b)
        out.append((l, r, h, size[l] + size[r]))
        for k in size:
            if k not in (l, r):
                x, y, nx, ny, nk = d[frozenset((l, k))], d[frozenset((r, k))], size[l], size[r], size[k]
                d[frozenset((l, k))] = {"single": min(x, y), "complete": max(x, y), "average": (nx * x + ny * y) / (nx + ny), "ward": max(0, ((nx + nk) * x * x + (ny + nk) * y * y - nk * h * h) / (nx + ny + nk)) ** 0.5}[method]
        size[l] += size.pop(r)
    return out


def test_linkages(spark):
    r = random.Random(5)
    pairs, want = [], {m: [] for m in numerics.METHODS}
    for g in range(4):
        pts = [100 * g + i for i in range(r.randrange(2, 14))]
        at = {p: (r.random(), r.random()) for p in pts}
        dist = {(a, b): ((at[a][0] - at[b][0]) ** 2 + (at[a][1] - at[b][1]) ** 2) ** 0.5 for a in pts for b in pts if a < b}
        pairs += [(a, b, d) for (a, b), d in dist.items()]
        for m in numerics.METHODS:
            want[m] += merged(pts, dist, m)
    df = spark.createDataFrame(pairs, "a long, b long, d double")
    for m in numerics.METHODS:
        got = sorted(tuple(x) for x in numerics.linkage(df, m).collect())
        exp = sorted(want[m])
        assert [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in exp] and np.allclose([x[2] for x in got], [x[2] for x in exp])
    cut = numerics.flat_clusters(spark.createDataFrame([(p,) for a, b, _ in pairs for p in (a, b)], "id long").distinct(), numerics.linkage(df, "complete"), 0.5)
    by = {}
    for x in cut.collect():
        by.setdefault(x.cluster, []).append(x.id)
    d = {(a, b): v for a, b, v in pairs}
    assert all(d[a, b] <= 0.5 for ids in by.values() for a in ids for b in ids if a < b) and all(min(ids) == c for c, ids in by.items())
    assert numerics.linkage(df.limit(0)).count() == 0


def test_dense_factors(spark):
    r = np.random.default_rng(3)
    v = {g: r.normal(size=(n, 5)) for g, n in enumerate([1, 4, 30])}
    df = spark.createDataFrame([(g, x.tolist()) for g, a in v.items() for x in a] + [(0, None), (1, [])], "g long, e array<double>").repartition(3)
    for f in numerics.factorised(numerics.second_moments(df, "g", "e"), "g").collect():
        a = v[f.g].T @ v[f.g]
        assert f.residual < 1e-9 and np.allclose(f.eigenvalues, np.linalg.eigvalsh(a)[::-1], atol=1e-8) and np.allclose(f.singular_values[: min(v[f.g].shape)], np.linalg.svd(v[f.g])[1], atol=1e-6)
        assert np.allclose((a + np.eye(5)) @ f.solution, 1)


def covered(rings, xs, ys):
    """Which points lie in any of the rings, by crossings."""
    x, y = np.meshgrid(xs, ys)
    out = np.zeros(x.shape, bool)
    for ring in rings:
        odd = np.zeros(x.shape, bool)
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if y1 != y2:
                odd ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
        out |= odd
    return out


def test_unions_of_polygons(spark):
    """Areas of unions equal those of sampled points: random stars, shared sides, equal and nested polygons, holes between them."""
    r = random.Random(8)
    groups = {}
    for g in range(4):
        rings = []
        for _ in range(9):
            cx, cy, n = r.uniform(0, 10), r.uniform(0, 10), r.randrange(3, 8)
            ring = [(cx + r.uniform(0.5, 2.5) * np.cos(2 * np.pi * k / n), cy + r.uniform(0.5, 2.5) * np.sin(2 * np.pi * k / n)) for k in range(n)]
            rings.append(ring if r.random() < 0.5 else ring[::-1])
        groups[g] = rings
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    groups[10] = [square(0, 0, 1), square(1, 0, 1), square(0, 1, 1), square(0, 0, 1)]  # shared sides and one twice
    groups[11] = [square(0, 0, 4), square(1, 1, 1), square(4, 4, 1)]  # nested, and one that touches at a corner
    groups[12] = [square(0, 0, 1), square(2, 0, 1), square(1, 1, 1), square(1, -1, 1), square(0, 0, 3.5)[:3]]
    groups[13] = [[(0, 0), (3, 0), (3, 1), (0, 1)], [(0, 2), (3, 2), (3, 3), (0, 3)], [(0, 0), (1, 0), (1, 3), (0, 3)], [(2, 0), (3, 0), (3, 3), (2, 3)]]  # a hole
    groups[14] = [[(0, 0), (1, 1)], square(0, 0, 0.5)]  # no polygon, and one
    rows = [(g, i, [{"x": float(x), "y": float(y)} for x, y in ring]) for g, rings in groups.items() for i, ring in enumerate(rings)]
    df = spark.createDataFrame(rows, "group long, poly long, ring array<struct<x:double,y:double>>").repartition(4)
    edge = overlay.union_boundary(df, 1.5).cache()
    got = {x.group: x for x in overlay.union_measures(edge).collect()}
    exact = {10: (3, 8), 11: (17, 20), 13: (8, 16), 14: (0.25, 2)}
    for g, (area, length) in exact.items():
        assert abs(got[g].area - area) < 1e-6 and abs(got[g].length - length) < 1e-6
    for g in (0, 1, 2, 3, 12):
        xs = np.linspace(-4, 14, 1801) + 0.00123
        share = covered([x for x in groups[g] if len(x) > 2], xs, xs).sum() * (xs[1] - xs[0]) ** 2
        assert abs(got[g].area - share) < 0.01 * share, g
    rings = {}
    for x in overlay.union_rings(edge).collect():
        rings[x.group] = rings.get(x.group, 0) + 1
    assert rings[13] == 2 and rings[10] == 1
    assert overlay.union_boundary(df.limit(0), 1.0).count() == 0
    point = spark.createDataFrame([(0, 0, 1.0, 1.0, 1.0, 1.0), (1, 1, 0.0, 0.0, 3.0, 4.0)], "group long, poly long, x1 double, y1 double, x2 double, y2 double")
    fine = {x.group: x.area for x in overlay.union_measures(overlay.union_boundary(overlay.buffered(point, F.lit(2.0), 64), 4.0)).collect()}
    assert abs(fine[0] - np.pi * 4) < 0.01 and abs(fine[1] - (np.pi * 4 + 5 * 4)) < 0.01


def test_quantiles_of_any_values(spark):
    """Ties, one value, infinities, huge and tiny ranges, null groups and values: as numpy has them."""
    r = np.random.default_rng(4)
    groups = {
        0: r.normal(size=3000), 1: np.array([5.0]), 2: r.integers(0, 3, 500).astype(float), 3: np.r_[r.normal(size=50) * 1e300, 1e308, -1e308], 4: 1 + r.normal(size=400) * 1e-15, None: r.lognormal(size=200) ** 9,
    }
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [(0, None), (2, float("nan")), (7, None)]
    df = spark.createDataFrame(rows, "g long, v double").repartition(5)
    at = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {(x.g, x.q): x.v for x in quantiles.quantiles(df, ["g"], "v", at).collect()}
    assert len(got) == len(groups) * len(at)
    for g, v in groups.items():
        for q in at:
            assert np.isclose(got[g, q], np.quantile(v, q), rtol=1e-12, atol=0), (g, q)
    assert quantiles.quantiles(df.limit(0), ["g"], "v", at).count() == 0
