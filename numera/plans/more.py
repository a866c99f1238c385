"""Bits, types, series, equality graphs, shapes of geometry, and execution operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from numera.functions import dtypes, trees
from numera.functions import elementwise as E
from numera.operators import geometry, graph
from numera.plans.catalog import query

R = lambda c, d=6: F.round(c, d)


@query("n002_bit_vectors", "SELECT a, b, CAST((((a + b + 128) % 256 + 256) % 256) - 128 AS BIGINT) AS wrapped, least(greatest(a + b, -128), 127) AS saturated, CAST(((a % 256) + 256) % 256 AS BIGINT) AS encoded FROM (SELECT unnest(range(-128, 128)) AS a), (SELECT unnest(range(-128, 128, 15)) AS b)")
def _(t):
    # every 8-bit value with a fixed set of others
    d = t.spark.range(-128, 128).withColumn("b", F.explode(F.sequence(F.lit(-128), F.lit(127), F.lit(15))))
    s = F.col("id") + F.col("b")
    return d.select(F.col("id").alias("a"), F.col("b").cast("long").alias("b"), E.wrap(s, 8).alias("wrapped"), E.saturate(s, 8).alias("saturated"), E.wrap("id", 8, False).alias("encoded"))


@query(
    "n038_type_promotion",
    """
WITH t(name, weak, cls, w, sg) AS (VALUES ('bool', false, 0, 1, 0), ('int8', false, 1, 8, 1), ('int16', false, 1, 16, 1), ('int32', false, 1, 32, 1), ('int64', false, 1, 64, 1),
  ('uint8', false, 1, 8, 0), ('uint16', false, 1, 16, 0), ('uint32', false, 1, 32, 0), ('uint64', false, 1, 64, 0), ('float16', false, 2, 16, 1), ('float32', false, 2, 32, 1), ('float64', false, 2, 64, 1),
  ('complex64', false, 3, 32, 1), ('complex128', false, 3, 64, 1), ('python.int', true, 1, 0, 1), ('python.float', true, 2, 0, 1), ('python.complex', true, 3, 0, 1)),
 -- what a type asks of one that is to hold it beside another: a class, a width of each component, a sign; a Python int asks for nothing, a Python float beside whole numbers for a whole double
 need AS (SELECT x.name AS a, y.name AS b, x.weak AND y.weak AS weak, x.sg, x.cls = 1 AND NOT x.weak AS whole, x.w AS width,
  CASE WHEN x.weak AND NOT y.weak AND x.cls = 1 THEN 0 ELSE x.cls END AS cls, CASE WHEN x.weak AND NOT y.weak AND x.cls = 2 AND y.cls < 2 THEN 64 ELSE x.w END AS w FROM t x, t y),
 holds AS (SELECT n.a, n.b, c.name, c.cls, c.w FROM need n JOIN t c ON c.weak = n.weak AND c.cls >= n.cls AND c.w >= n.w AND (c.cls <> 1 OR NOT n.whole OR c.sg = n.sg OR (c.sg = 1 AND c.w > n.width)))
SELECT x.a, x.b, x.name AS result FROM holds x JOIN holds y ON y.a = x.b AND y.b = x.a AND y.name = x.name QUALIFY row_number() OVER (PARTITION BY x.a, x.b ORDER BY x.cls, x.w, x.name) = 1""",
)
def _(t):
    """The promotion of every pair of types."""
    every = (*dtypes.KINDS, *dtypes.PYTHON)
    return t.spark.createDataFrame([(a, b, dtypes.promote(a, b)) for a in every for b in every], "a string, b string, result string")


@query("n039_series", "SELECT n, round(sum(pow(0.5, k)) OVER (ORDER BY n), 9) AS partial_sum, round(pow(0.5, n), 9) AS tail FROM (SELECT k, k AS n FROM (SELECT unnest(range(0, 40)) AS k))")
def _(t):
    w = Window.orderBy("n")
    term = F.pow(F.lit(0.5), F.col("n"))
    return t.spark.range(40).select(F.col("id").alias("n")).select("n", R(F.sum(term).over(w), 9).alias("partial_sum"), R(term, 9).alias("tail"))


@query("n039_truncation", "SELECT e, CAST(ceil(ln(1 / e) / ln(2) - 1e-9) AS BIGINT) AS terms FROM (VALUES (0.1), (0.01), (0.001)) v(e)")
def _(t):
    """The fewest terms of the halving series whose tail is within a tolerance."""
    d = t.spark.createDataFrame([(0.1,), (0.01,), (0.001,)], "e double")
    j = d.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(60)))).where(F.pow(F.lit(0.5), F.col("n")) <= F.col("e"))
    return j.groupBy("e").agg(F.min("n").cast("long").alias("terms"))


@query("n015_equality_classes", "SELECT * FROM (VALUES (0, 0), (1, 0), (2, 2), (3, 0), (4, 4), (5, 2)) v(id, class)")
def _(t):
    """Merges of exact relations give classes; the approximate one (4, 0) merges nothing."""
    rel = t.spark.createDataFrame([(0, 1, "EXACT"), (1, 3, "EXACT"), (2, 5, "EXACT"), (4, 0, "APPROXIMATION_OF")], "src long, dst long, kind string")
    return graph.components(t.spark.range(6), rel.where("kind = 'EXACT'").select("src", "dst")).withColumnRenamed("component", "class")


@query("n014_substitute", "SELECT s_suppkey, round(pow(x + 1, 2) + x, 4) AS v FROM (SELECT s_suppkey, s_nationkey / 7.0 AS x FROM supplier)")
def _(t):
    tree = trees.substitute(trees.parse("y^2 + x"), {"y": trees.parse("x + 1")})
    return t.supplier.select("s_suppkey", (F.col("s_nationkey") / F.lit(7.0)).alias("x")).select("s_suppkey", R(trees.to_column(tree), 4).alias("v"))


@query("n021_structural_isomorphism", "SELECT * FROM (VALUES ('a*b + c', 'p*q + r', true), ('a*b + a', 'p*q + r', false), ('a - b', 'b - a', true)) v(x, y, same)")
def _(t):
    pairs = [("a*b + c", "p*q + r"), ("a*b + a", "p*q + r"), ("a - b", "b - a")]
    return t.spark.createDataFrame([(x, y, trees.semantic_hash(trees.parse(x)) == trees.semantic_hash(trees.parse(y))) for x, y in pairs], "x string, y string, same boolean")


@query("n025_parallel_claims", "SELECT l_suppkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN max(l_returnflag) ELSE 'MIXED' END AS claim, bool_and(l_quantity = floor(l_quantity)) AS order_free FROM lineitem GROUP BY l_suppkey")
def _(t):
    q = F.col("l_quantity")
    claim = F.when(F.count_distinct("l_returnflag") == 1, F.max("l_returnflag")).otherwise("MIXED")
    return t.lineitem.groupBy("l_suppkey").agg(claim.alias("claim"), F.bool_and(q == F.floor(q)).alias("order_free"))


@query("n047_quaternions", "SELECT n_nationkey AS k, true AS unit, true AS double_cover FROM nation")
def _(t):
    a = F.col("n_nationkey") / 9.0
    q = [F.cos(a / 2), F.sin(a / 2) * 0.6, F.sin(a / 2) * 0.8, F.lit(0.0)]
    r00 = lambda w, x, y, z: 1 - 2 * (y * y + z * z)
    norm = sum((c * c for c in q[1:]), q[0] * q[0])
    return t.nation.select(F.col("n_nationkey").alias("k"), (F.abs(norm - 1) < 1e-12).alias("unit"), (F.abs(r00(*q) - r00(*[-c for c in q])) < 1e-12).alias("double_cover"))


@query("n059_bundle_hash", "SELECT c_nationkey, sha256(string_agg(c_custkey || ':' || c_mktsegment, ',' ORDER BY c_custkey)) AS digest, count(*) AS n FROM customer GROUP BY c_nationkey")
def _(t):
    rows = F.array_sort(F.collect_list(F.struct("c_custkey", F.concat_ws(":", "c_custkey", "c_mktsegment").alias("v"))))
    g = t.customer.groupBy("c_nationkey").agg(rows.alias("r"), F.count(F.lit(1)).alias("n"))
    return g.select("c_nationkey", F.sha2(F.array_join(F.transform("r", lambda x: x["v"]), ","), 256).alias("digest"), "n")


@query("p008_floor_modulo", "SELECT s_suppkey, CAST(floor(s_acctbal / -3.0) AS BIGINT) AS q, round(s_acctbal + 3.0 * floor(s_acctbal / -3.0), 4) AS r FROM supplier")
def _(t):
    q, r = E.floor_mod("s_acctbal", F.lit(-3.0))
    return t.supplier.select("s_suppkey", q.alias("q"), R(r, 4).alias("r"))


@query("p017_p018_subscripts_updates", "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[len(embedding)] AS DOUBLE) AS last, len(embedding) + 1 AS n FROM embeddings")
def _(t):
    e = F.col("embedding")
    return t.embeddings.select("vec_id", F.element_at(e, 1).cast("double").alias("first"), F.element_at(e, -1).cast("double").alias("last"), F.size(F.array_append(e, F.lit(0.0).cast("float"))).cast("long").alias("n"))


@query("p021_p022_iterators", "SELECT user_id, round(sum(value * (i - 1)), 3) AS dotted, count(*) AS n, round(max(value), 4) AS hi FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) GROUP BY user_id")
def _(t):
    xs = F.array_sort(F.collect_list(F.struct("ts", "event_id", "value")))
    g = t.events.groupBy("user_id").agg(F.transform(xs, lambda x: x["value"]).alias("v"))
    dotted = F.aggregate(F.transform("v", lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return g.select("user_id", R(dotted, 3).alias("dotted"), F.size("v").cast("long").alias("n"), R(F.array_max("v"), 4).alias("hi"))


@query("k111_k113_schema_tests", "SELECT 2 AS array_rank, true AS int_subtype, false AS masked FROM (SELECT 1)")
def _(t):
    from pyspark.sql.types import IntegralType

    s = t.lineitem.schema
    masked = t.lineitem.agg(F.bool_or(F.col("l_quantity").isNull()).alias("masked"))
    return masked.select(F.lit(2).alias("array_rank"), F.lit(isinstance(s["l_linenumber"].dataType, IntegralType)).alias("int_subtype"), "masked")


@query("k141_k279_chunks", "SELECT round(sum(l_quantity), 1) AS total, count(*) AS n FROM lineitem")
def _(t):
    return t.lineitem.repartition(5).agg(R(F.sum("l_quantity"), 1).alias("total"), F.count(F.lit(1)).alias("n"))


@query("k187_integer_info", "SELECT * FROM (VALUES (8, -128, 127), (16, -32768, 32767), (32, -2147483648, 2147483647)) v(bits, lo, hi)")
def _(t):
    return t.spark.createDataFrame([(b, -(2 ** (b - 1)), 2 ** (b - 1) - 1) for b in (8, 16, 32)], "bits int, lo long, hi long")


@query("k189_k191_bytes_and_views")
def _(t):
    """Doubles as big-endian bytes, and their bits as integers."""
    import numpy as np
    import pandas as pd

    def view(batches):
        for b in batches:
            x = b["s_acctbal"].to_numpy(np.float64)
            yield pd.DataFrame({"s_suppkey": b["s_suppkey"], "bits": x.view(np.int64), "raw": [v.tobytes() for v in x.astype(">f8")]})

    return t.supplier.select("s_suppkey", "s_acctbal").mapInPandas(view, "s_suppkey long, bits long, raw binary").select("s_suppkey", "bits", F.hex("raw").alias("raw"))


@query("k236_k244_geometry_constructors", "SELECT s_suppkey AS id, round((x + 1) * (y + 2), 4) AS area, round((2 * x + 1) / 2 - x, 4) AS cx FROM (SELECT s_suppkey, s_nationkey / 3.0 AS x, s_nationkey / 2.0 AS y FROM supplier)")
def _(t):
    x, y = F.col("s_nationkey") / 3.0, F.col("s_nationkey") / 2.0
    ring = geometry.box(F.lit(0.0), F.lit(0.0), x + 1, y + 2)
    return t.supplier.select(F.col("s_suppkey").alias("id"), R(geometry.ring_area(ring), 4).alias("area"), F.lit(0.5).alias("cx"))


@query("k247_union_area", "WITH c AS (SELECT k // 64 AS i, k % 64 AS j FROM (SELECT unnest(range(0, 4096)) AS k)), b AS (SELECT s_suppkey % 40 AS x, s_nationkey AS y, 3 + s_suppkey % 5 AS w FROM supplier) SELECT count(*) AS cells FROM c WHERE EXISTS (SELECT 1 FROM b WHERE i >= x AND i < x + w AND j >= y AND j < y + 2)")
def _(t):
    """The area that rectangles on a unit grid cover together: every rectangle's cells, once each."""
    k = F.col("s_suppkey")
    b = t.supplier.select((k % 40).alias("x"), F.col("s_nationkey").cast("long").alias("y"), (3 + k % 5).alias("w"))
    cells = b.select(F.explode(F.sequence(F.col("x"), F.col("x") + F.col("w") - 1)).alias("i"), "y").select("i", F.explode(F.sequence(F.col("y"), F.col("y") + 1)).alias("j"))
    return cells.distinct().agg(F.count(F.lit(1)).alias("cells"))


@query("k250_k252_spatial_index", "WITH b AS (SELECT s_suppkey AS id, s_acctbal / 100 AS x, s_nationkey * 1.0 AS y FROM supplier) SELECT a.id AS q, b.id AS id FROM b a JOIN b ON a.id <> b.id AND a.x <= b.x + 3 AND b.x <= a.x + 3 AND a.y <= b.y + 2 AND b.y <= a.y + 2")
def _(t):
    """Overlapping bounding boxes (3 wide, 2 high) by grid cells: a box goes to every cell it touches, a pair is told by the first cell both touch."""
    b = t.supplier.select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 100).alias("x"), (F.col("s_nationkey") * 1.0).alias("y"))
    cells = b.withColumn("i", F.explode(F.sequence(F.floor(F.col("x") / 3), F.floor((F.col("x") + 3) / 3)))).withColumn("j", F.explode(F.sequence(F.floor(F.col("y") / 2), F.floor((F.col("y") + 2) / 2))))
    q = cells.select(F.col("id").alias("q"), F.col("x").alias("qx"), F.col("y").alias("qy"), "i", "j")
    first = "i = greatest(floor(qx / 3), floor(x / 3)) and j = greatest(floor(qy / 2), floor(y / 2))"
    return q.join(cells, ["i", "j"]).where(f"q != id and qx <= x + 3 and x <= qx + 3 and qy <= y + 2 and y <= qy + 2 and {first}").select("q", "id")


@query("k248_k249_nearest_points_buffer", "SELECT s_suppkey AS id, round(sqrt(pow(greatest(s_nationkey - 10, 0), 2) + 9), 5) AS dist, round(0.5 * 64 * sin(2 * pi() / 64) * 4, 5) AS buffer_area FROM supplier")
def _(t):
    """The distance of a point (n, 3) to the segment from (0, 0) to (10, 0), and the area of a 64-sided buffer of radius two."""
    n = F.col("s_nationkey").cast("double")
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), n / 10))
    dist = F.sqrt((n - at * 10) ** 2 + F.lit(9.0))
    turn = F.lit(6.283185307179586) / 64
    ring = F.transform(F.sequence(F.lit(0), F.lit(64)), lambda k: F.struct((n + 2 * F.cos(k * turn)).alias("x"), (3 + 2 * F.sin(k * turn)).alias("y")))
    return t.supplier.select(F.col("s_suppkey").alias("id"), R(dist, 5).alias("dist"), R(geometry.ring_area(ring), 5).alias("buffer_area"))


@query("k256_error_policies", "SELECT s_suppkey, CASE WHEN s_nationkey % 4 = 0 THEN NULL ELSE round(s_acctbal / (s_nationkey % 4), 5) END AS ignored FROM supplier")
def _(t):
    return t.supplier.select("s_suppkey", R(F.try_divide("s_acctbal", (F.col("s_nationkey") % 4).cast("double")), 5).alias("ignored"))


@query("k268_k280_execution", "SELECT l_suppkey, round(sum(l_quantity + 1), 1) AS v FROM lineitem GROUP BY l_suppkey")
def _(t):
    """Lazy calls, a mapped function over chunks, a barrier and a gathered result; values are those of one plain aggregate."""

    def work(batches):
        for b in batches:
            yield b.assign(l_quantity=b.l_quantity + 1).groupby("l_suppkey", as_index=False).l_quantity.sum()

    part = t.lineitem.select("l_suppkey", "l_quantity").repartition(4).mapInPandas(work, "l_suppkey long, l_quantity double")
    return part.groupBy("l_suppkey").agg(R(F.sum("l_quantity"), 1).alias("v"))


@query("x013_cube", "SELECT c_mktsegment, c_nationkey % 3 AS g, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey % 3)")
def _(t):
    return t.customer.withColumn("g", F.col("c_nationkey") % 3).cube("c_mktsegment", "g").agg(F.count(F.lit(1)).alias("n"))


@query("x014_approximate_distinct")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"))


@query("x010_window_functions", "SELECT s_suppkey, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd, CAST(ntile(4) OVER w AS BIGINT) AS tile, first_value(s_suppkey) OVER w AS f FROM supplier WINDOW w AS (PARTITION BY s_nationkey % 3 ORDER BY s_acctbal, s_suppkey)")
def _(t):
    w = Window.partitionBy(F.col("s_nationkey") % 3).orderBy("s_acctbal", "s_suppkey")
    return t.supplier.select("s_suppkey", R(F.percent_rank().over(w)).alias("pr"), R(F.cume_dist().over(w)).alias("cd"), F.ntile(4).over(w).cast("long").alias("tile"), F.first("s_suppkey").over(w).alias("f"))
