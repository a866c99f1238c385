"""Union and buffer of polygons in the plane.

Polygons are rows (group, poly, ring), the ring an array of points (x, y), simple
and without its first point repeated, of either orientation.  Boundaries are cut
where they meet, in grid cells that no polygon covers whole; a piece
belongs to the union's boundary if nothing of its group covers the side away from
its own polygon.  Coordinates are snapped to ``SNAP`` decimals.
"""

from __future__ import annotations

from math import cos, floor, log2, pi, sin

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from numera.operators.graph import checkpoint, components

SNAP = 9
#: How far beside a piece its sides are looked at, and how near counts as touching.
ASIDE, TOUCH = 1e-6, 1e-9
#: How far beyond a cell its sides are looked for, and where the grid starts: at no round number, so that borders of cells seldom meet those of polygons.
EDGE, ORIGIN = 4e-6, 24377 / 65536


def _snap(c: Column) -> Column:
    return F.round(c, SNAP) + F.lit(0.0)


def edges(polygons: DataFrame) -> DataFrame:
    """(g, p, e, x1, y1, x2, y2): the sides of every polygon counter-clockwise, those without length left out; rings of under three points have none."""
    ring = F.transform("ring", lambda q: F.struct(_snap(q["x"].cast("double")).alias("x"), _snap(q["y"].cast("double")).alias("y")))
    p = polygons.where("size(ring) > 2").select(F.col("group").alias("g"), F.col("poly").alias("p"), ring.alias("r"))
    after = F.concat(F.slice("r", 2, F.size("r") - 1), F.slice("r", 1, 1))
    p = p.withColumn("s", F.arrays_zip(F.col("r").alias("a"), after.alias("b")))
    twice = F.aggregate("s", F.lit(0.0), lambda acc, x: acc + x["a"]["x"] * x["b"]["y"] - x["b"]["x"] * x["a"]["y"])
    each = p.withColumn("left", twice >= 0).select("g", "p", "left", F.posexplode("s").alias("k", "x"))
    pick = lambda u, v, c: F.when(F.col("left"), F.col(f"x.{u}.{c}")).otherwise(F.col(f"x.{v}.{c}"))
    out = each.select("g", "p", F.concat_ws(":", "p", "k").alias("e"), pick("a", "b", "x").alias("x1"), pick("a", "b", "y").alias("y1"), pick("b", "a", "x").alias("x2"), pick("b", "a", "y").alias("y2"))
    return out.where("x1 != x2 or y1 != y2")


def _touched(sides: DataFrame, f: float) -> DataFrame:
    """``sides`` once for each grid cell (cx, cy) they come within ``EDGE`` of, with the part (s0, s1) of them there and how often they cross the cell's middle height, which counts in one cell."""
    c = F.col
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    at = lambda k: k * F.lit(f) + F.lit(ORIGIN)
    index = lambda v: F.floor((v - ORIGIN) / f)
    rx, ry = c("x2") - c("x1"), c("y2") - c("y1")
    rows = sides.withColumn("cy", F.explode(F.sequence(index(low - EDGE), index(high + EDGE))))
    ta, tb = F.try_divide(at(c("cy")) - EDGE - c("y1"), ry), F.try_divide(at(c("cy") + 1) + EDGE - c("y1"), ry)
    rows = rows.withColumn("u0", F.greatest(F.lit(0.0), F.coalesce(F.least(ta, tb), F.lit(0.0)))).withColumn("u1", F.least(F.lit(1.0), F.coalesce(F.greatest(ta, tb), F.lit(1.0))))
    xa, xb = c("x1") + c("u0") * rx, c("x1") + c("u1") * rx
    rows = rows.withColumn("cx", F.explode(F.sequence(index(F.least(xa, xb) - EDGE), index(F.greatest(xa, xb) + EDGE))))
    tc, td = F.try_divide(at(c("cx")) - EDGE - c("x1"), rx), F.try_divide(at(c("cx") + 1) + EDGE - c("x1"), rx)
    s0, s1 = F.greatest("u0", F.coalesce(F.least(tc, td), F.lit(0.0))), F.least("u1", F.coalesce(F.greatest(tc, td), F.lit(1.0)))
    middle = (c("cy") + 0.5) * F.lit(f) + F.lit(ORIGIN)
    crosses = ((c("y1") > middle) != (c("y2") > middle)) & (index(c("x1") + F.try_divide(middle - c("y1"), ry) * rx) == c("cx"))
    return rows.withColumns({"s0": s0, "s1": s1, "over": F.coalesce(crosses, F.lit(False)).cast("int")}).drop("u0", "u1")


def _full(placed: DataFrame) -> DataFrame:
    """(g, cx, cy): the cells that some polygon covers whole, as far as ``EDGE`` beyond: none of its sides is near, and it has an odd number of them to the left."""
    w = Window.partitionBy("g", "p", "cy").orderBy("cx")
    each = placed.groupBy("g", "p", "cy", "cx").agg(F.sum("over").alias("n"))
    gaps = each.select("g", "cy", (F.col("cx") + 1).alias("a"), (F.lead("cx").over(w) - 1).alias("b"), (F.sum("n").over(w) % 2).alias("odd")).where("odd = 1 and a <= b")
    return gaps.select("g", F.explode(F.sequence("a", "b")).alias("cx"), "cy").distinct()


def _own(open_: DataFrame, f: float) -> DataFrame:
    """The part (x1, y1, x2, y2) of every side in its own half-open cell, with the side itself (l); parts alike count once."""
    c = F.col
    rx, ry = c("x2") - c("x1"), c("y2") - c("y1")
    part = lambda k, v, r: (F.try_divide(c(k) * F.lit(f) + F.lit(ORIGIN) - c(v), r), F.try_divide((c(k) + 1) * F.lit(f) + F.lit(ORIGIN) - c(v), r))
    (xa, xb), (ya, yb) = part("cx", "x1", rx), part("cy", "y1", ry)
    inside = lambda k, v, r: (r != 0) | (F.floor((c(v) - ORIGIN) / f) == c(k))
    t0 = F.greatest(F.lit(0.0), F.coalesce(F.least(xa, xb), F.lit(0.0)), F.coalesce(F.least(ya, yb), F.lit(0.0)))
    t1 = F.least(F.lit(1.0), F.coalesce(F.greatest(xa, xb), F.lit(1.0)), F.coalesce(F.greatest(ya, yb), F.lit(1.0)))
    own = open_.withColumns({"t0": t0, "t1": t1}).where(inside("cx", "x1", rx) & inside("cy", "y1", ry) & (c("t0") < c("t1")))
    at = lambda t, v, r, e: F.when(c(t) == (0.0 if t == "t0" else 1.0), c(e)).otherwise(_snap(c(v) + c(t) * r)).alias(e + "_")
    own = own.select("g", "cx", "cy", "p", F.struct("x1", "y1", "x2", "y2").alias("l"), at("t0", "x1", rx, "x1"), at("t0", "y1", ry, "y1"), at("t1", "x1", rx, "x2"), at("t1", "y1", ry, "y2"))
    own = own.groupBy("g", "cx", "cy", *(c(f"{v}_").alias(v) for v in ("x1", "y1", "x2", "y2"))).agg(F.min(F.struct("p", "l")).alias("m"))
    return own.where("x1 != x2 or y1 != y2").select("g", "cx", "cy", "x1", "y1", "x2", "y2", "m.p", "m.l")


def _pieces(open_: DataFrame, f: float) -> DataFrame:
    """(g, cx, cy, x1, y1, x2, y2): the parts of sides in their cells, cut where another polygon's side meets them."""
    c = F.col
    own = checkpoint(_own(open_, f).withColumn("k", F.monotonically_increasing_id()))
    # of sides that run alike through a cell, one meets the others for all
    cut = lambda t: F.struct(*(F.when(c(t) == (0.0 if t == "s0" else 1.0), c(f"{v}{1 if t == 's0' else 2}")).otherwise(_snap(c(f"{v}1") + c(t) * (c(f"{v}2") - c(f"{v}1")))).alias(v) for v in "xy"))
    other = open_.groupBy("g", "cx", "cy", cut("s0").alias("a"), cut("s1").alias("b")).agg(F.min(F.struct("p", "x1", "y1", "x2", "y2")).alias("o"), F.count_distinct("p").alias("ps"))
    other = other.select("g", "cx", "cy", "ps", c("o.p").alias("q"), *(c(f"o.{v}").alias(f"o{v}") for v in ("x1", "y1", "x2", "y2")))
    pairs = own.select("g", "cx", "cy", "k", "p", "l.*").join(other, ["g", "cx", "cy"]).where("p != q or ps > 1")
    rx, ry, sx, sy = c("x2") - c("x1"), c("y2") - c("y1"), c("ox2") - c("ox1"), c("oy2") - c("oy1")
    wx, wy = c("ox1") - c("x1"), c("oy1") - c("y1")
    d, long = rx * sy - ry * sx, F.sqrt(rx * rx + ry * ry)
    flat = F.abs(d) <= TOUCH * long * F.sqrt(sx * sx + sy * sy)
    t, u = F.try_divide(wx * sy - wy * sx, d), F.try_divide(wx * ry - wy * rx, d)
    near = lambda v, n: (v >= -TOUCH / n) & (v <= 1 + TOUCH / n)
    crossing = F.when(~flat & near(t, long) & near(u, F.sqrt(sx * sx + sy * sy)), F.array(F.struct(_snap(c("x1") + t * rx).alias("x"), _snap(c("y1") + t * ry).alias("y"))))
    online = F.abs(wx * ry - wy * rx) <= TOUCH * long
    ends = F.when(flat & online, F.array(F.struct(c("ox1").alias("x"), c("oy1").alias("y")), F.struct(c("ox2").alias("x"), c("oy2").alias("y"))))
    met = pairs.select("k", F.explode(F.coalesce(crossing, ends)).alias("q")).distinct()
    along = lambda q: ((q["x"] - c("x1")) * (c("x2") - c("x1")) + (q["y"] - c("y1")) * (c("y2") - c("y1"))) / ((c("x2") - c("x1")) ** 2 + (c("y2") - c("y1")) ** 2)
    cuts = met.join(own, "k").where((along(c("q")) > 0) & (along(c("q")) < 1)).groupBy("k").agg(F.collect_list("q").alias("at"))
    whole = own.join(cuts, "k", "left")
    ends = F.array(F.struct(c("x1").alias("x"), c("y1").alias("y")), F.struct(c("x2").alias("x"), c("y2").alias("y")))
    stops = F.array_sort(F.transform(F.concat(ends, F.coalesce("at", F.array().cast("array<struct<x:double,y:double>>"))), lambda q: F.struct(along(q).alias("t"), q["x"].alias("x"), q["y"].alias("y"))))
    each = whole.withColumn("s", stops).select("g", "cx", "cy", F.explode(F.arrays_zip(F.slice("s", 1, F.size("s") - 1).alias("a"), F.slice("s", 2, F.size("s") - 1).alias("b"))).alias("x"))
    out = each.select("g", "cx", "cy", c("x.a.x").alias("x1"), c("x.a.y").alias("y1"), c("x.b.x").alias("x2"), c("x.b.y").alias("y2")).where("x1 != x2 or y1 != y2")
    return out.groupBy("g", "x1", "y1", "x2", "y2").agg(F.min("cx").alias("cx"), F.min("cy").alias("cy"))  # sides that lie on each other in one direction count once


def union_boundary(polygons: DataFrame, cell: float) -> DataFrame:
    """(group, x1, y1, x2, y2): the boundary of the union of each group's polygons, its inside to the left, cut at the borders of cells too; ``cell`` is about a polygon's width.

    Cells of a fraction of ``cell`` that one polygon covers whole have no
    boundary in them, and all that lies there is left out before sides are
    paired.  So where polygons lie many deep, next to nothing is left but what
    is near the outline, however many they are.
    """
    f = 2.0 ** floor(log2(cell / 8))
    sides = checkpoint(edges(polygons.dropDuplicates(["group", "ring"])))
    placed = checkpoint(_touched(sides, f))
    open_ = checkpoint(placed.join(_full(placed), ["g", "cx", "cy"], "left_anti"))
    pieces = checkpoint(_pieces(open_, f).withColumn("id", F.monotonically_increasing_id()))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    n = F.sqrt(dx * dx + dy * dy)
    asked = pieces.select("g", "id", "cx", "cy", ((F.col("x1") + F.col("x2")) / 2 + ASIDE * dy / n).alias("mx"), ((F.col("y1") + F.col("y2")) / 2 - ASIDE * dx / n).alias("my"))
    # a polygon that covers a point of an open cell has a side there
    here = open_.select("g", "cx", "cy", "p").distinct()
    box = sides.groupBy("g", "p").agg(F.min("x1").alias("lx"), F.max("x1").alias("hx"), F.min("y1").alias("ly"), F.max("y1").alias("hy"))
    near = asked.join(here.join(box, ["g", "p"]), ["g", "cx", "cy"]).where("mx between lx and hx and my between ly and hy").select("g", "p", "id", "mx", "my")
    ray = ((F.col("y1") > F.col("my")) != (F.col("y2") > F.col("my"))) & (F.col("mx") < (F.col("x2") - F.col("x1")) * F.try_divide(F.col("my") - F.col("y1"), F.col("y2") - F.col("y1")) + F.col("x1"))
    covered = near.join(sides, ["g", "p"]).where(ray).groupBy("id", "p").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").select("id").distinct()
    return pieces.join(covered, "id", "left_anti").select(F.col("g").alias("group"), "x1", "y1", "x2", "y2")


def union_measures(boundary: DataFrame) -> DataFrame:
    """(group, area, length) of what ``union_boundary`` encloses."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    return boundary.groupBy("group").agg((F.sum(cross) / 2).alias("area"), F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("length"))


def union_rings(boundary: DataFrame) -> DataFrame:
    """(group, ring, points): the boundary stitched at equal ends, each connected part named by its first point, with how many pieces it has."""
    at = lambda x, y: F.concat_ws("/", F.col("group").cast("string"), F.format_string(f"%.{SNAP}f", F.col(x)), F.format_string(f"%.{SNAP}f", F.col(y)))
    e = checkpoint(boundary.select("group", at("x1", "y1").alias("src"), at("x2", "y2").alias("dst")))
    of = components(e.select(F.col("src").alias("id")).union(e.select("dst")).distinct(), e.select("src", "dst"))
    return e.join(of, e.src == of.id).groupBy("group", F.col("component").alias("ring")).agg(F.count(F.lit(1)).alias("points"))


def buffered(segments: DataFrame, radius: Column, quarter: int = 8) -> DataFrame:
    """Polygons (group, poly, ring) around segments (group, poly, x1, y1, x2, y2): a capsule each, its round ends of ``2 * quarter`` pieces; points have both ends equal."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    n = F.sqrt(dx * dx + dy * dy)
    ux, uy = F.when(n > 0, F.try_divide(dx, n)).otherwise(1.0), F.when(n > 0, F.try_divide(dy, n)).otherwise(0.0)
    ring = []
    for end, start in (("2", -pi / 2), ("1", pi / 2)):
        for k in range(2 * quarter + 1):
            a, b = cos(start + k * pi / (2 * quarter)), sin(start + k * pi / (2 * quarter))
            ring.append(F.struct((F.col(f"x{end}") + radius * (a * ux - b * uy)).alias("x"), (F.col(f"y{end}") + radius * (a * uy + b * ux)).alias("y")))
    return segments.select("group", "poly", F.array(*ring).alias("ring"))
