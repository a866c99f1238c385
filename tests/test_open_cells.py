"""Unions of polygons that lie many deep: what one polygon covers whole is left out before sides are paired."""

from pyspark.sql import functions as F

from numera.operators import overlay


def test_little_is_left_of_deep_stacks(spark):
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    left = {}
    for n in (400, 1600):
        df = spark.range(n).select(F.lit(1).alias("group"), F.col("id").alias("poly"), (F.pmod(F.xxhash64("id"), F.lit(40_000)) / 1000).alias("x"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(40_000)) / 1000).alias("y"))
        df = df.select("group", "poly", F.array(at(F.col("x"), F.col("y")), at(F.col("x") + 8, F.col("y")), at(F.col("x") + 8, F.col("y") + 8), at(F.col("x"), F.col("y") + 8)).alias("ring"))
        edge = overlay.union_boundary(df, 8.0)
        left[n] = edge.count()
        boxes = [(r.ring[0].x, r.ring[0].y) for r in df.collect()]
        xs = sorted({v for x, _ in boxes for v in (x, x + 8)})
        want = 0.0
        for a, b in zip(xs, xs[1:]):
            top = None
            for y in sorted(y for x, y in boxes if x <= a and x + 8 >= b):
                want += (b - a) * (y + 8 - max(y, top if top is not None else y))
                top = y + 8
        assert abs(overlay.union_measures(edge).first().area - want) < 1e-6
        f = 1.0
        placed = overlay._touched(overlay.edges(df), f)
        left[n, "open"] = placed.join(overlay._full(placed), ["g", "cx", "cy"], "left_anti").count() / placed.count()
    assert left[1600, "open"] < left[400, "open"] < 0.5
