"""Exact quantiles of groups of any size, by histograms refined around the wanted places."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from numera.operators.graph import checkpoint

BINS = 1024
#: States of at most so many rows, counted first, are sent to all tasks; more are joined by their group.
SENT = 100_000


def order_statistics(df: DataFrame, by: Sequence[str], value: str, places: DataFrame) -> DataFrame:
    """(by..., place, v): the value at each 0-based place of its group's ascending order; ``places`` (by..., place).

    Each place keeps a range of values it lies in.  A round counts the rows of
    that range in ``BINS`` bins, with their least and greatest values, which is
    combined before it is shuffled, and goes on in the bin that holds the place;
    it is found once the bin has one value.  So no task ever holds a group: it
    holds counts, and a few rounds end for any values.  Null and NaN values take
    no part, and a place a group does not have gives no row.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in by]
    ends = rows.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))
    want = places.select(*by, "place").distinct()
    state = checkpoint(want.join(ends, same(want, ends)).where("place < n and place >= 0").select(*(want[c] for c in by), "place", F.lit(0).cast("long").alias("below"), "lo", "hi"))
    found = None
    while True:
        done = state.where("lo = hi").select(*by, "place", F.col("lo").alias("v"))
        found = done if found is None else found.unionByName(done)
        state = checkpoint(state.where("lo < hi"))
        n = state.count()
        if not n:
            return found
        ranges = state.select(*by, "lo", "hi").distinct()
        ranges = F.broadcast(ranges) if n <= SENT else ranges
        near = rows.join(ranges, [rows[c].eqNullSafe(ranges[c]) for c in by] + [F.col("v") >= F.col("lo"), F.col("v") <= F.col("hi")]).select(*(rows[c] for c in by), "lo", "hi", "v")
        # bins never fall as values rise; a range too wide for a double is halved first
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        bins = near.groupBy(*by, "lo", "hi", F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        before = F.sum("c").over(Window.partitionBy(*by, "lo", "hi").orderBy("bin")) - F.col("c")  # at most BINS rows
        bins = bins.withColumn("before", before)
        j = state.join(bins, [*(state[c].eqNullSafe(bins[c]) for c in by), state.lo == bins.lo, state.hi == bins.hi])
        j = j.where((F.col("place") - F.col("below") >= F.col("before")) & (F.col("place") - F.col("below") < F.col("before") + F.col("c")))
        state = checkpoint(j.select(*(state[c] for c in by), "place", (F.col("below") + F.col("before")).alias("below"), F.col("least").alias("lo"), F.col("most").alias("hi")))


def quantiles(df: DataFrame, by: Sequence[str], value: str, at: Sequence[float]) -> DataFrame:
    """(by..., q, v): quantiles of each group, between the two nearest values where a quantile lies between places."""
    usable = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    n = usable.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    p = checkpoint(n.withColumn("q", F.explode(F.array(*(F.lit(float(q)) for q in at)))).withColumn("p", F.col("q") * (F.col("n") - 1)).withColumn("low", F.floor("p")).withColumn("part", F.col("p") - F.floor("p")))
    places = p.select(*by, F.explode(F.array("low", F.least(F.col("low") + 1, F.col("n") - 1))).alias("place"))
    v = checkpoint(order_statistics(df, by, value, places))
    side = lambda name: v.select(*(F.col(c).alias(f"{name}_{c}") for c in by), F.col("place").alias(f"{name}_place"), F.col("v").alias(name))
    a, b = side("a"), side("b")
    j = p.join(a, [*(F.col(c).eqNullSafe(F.col(f"a_{c}")) for c in by), F.col("low") == F.col("a_place")]).join(b, [*(F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in by), F.least(F.col("low") + 1, F.col("n") - 1) == F.col("b_place")])
    return j.select(*by, "q", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("v"))
