"""Elementwise functions, predicates, statistics, selection, shape and contraction queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from numera.functions import elementwise as E
from numera.operators import labelled as L
from numera.plans.catalog import query

R = lambda c, d=6: F.round(c, d)


# --- elementwise ------------------------------------------------------------------------------------

_X = "(value - 50) / 10"
_ELEM = f"""SELECT event_id, round(abs(x), 6) AS k085_abs, round_even(x, 1) AS k086_round, round(sqrt(abs(x)), 6) AS k087_sqrt, CASE WHEN x > 0 THEN round(ln(x), 6) END AS k088_log,
 CASE WHEN x > 0 THEN round(log10(x), 6) END AS k089_log10, round(ln(1 + abs(x)), 6) AS k090_log1p, round(exp(x / 3), 5) AS k091_exp, round(sin(x), 6) AS k092_sin, round(cos(x), 6) AS k093_cos,
 round(asin(x / 100), 6) AS k094_asin, round(atan2(x, 2.0), 6) AS k095_atan2, round(radians(x), 6) AS k096_radians, CAST(ceil(x) AS DOUBLE) AS k097_ceil, CAST(floor(x) AS DOUBLE) AS k098_floor,
 round_even(x, 0) AS k099_rint, round(greatest(x, 1.5), 6) AS k101_maximum, round(least(x, 1.5), 6) AS k102_minimum, round(pow(abs(x), 1.5), 5) AS k104_power,
 round(tan(x / 100), 6) AS p004_tan, round((exp(x / 10) - exp(-x / 10)) / 2, 6) AS p004_sinh, round((exp(x / 10) + exp(-x / 10)) / 2, 6) AS p004_cosh FROM (SELECT event_id, {_X} AS x FROM events)"""


@query("k085_k104_elementwise", _ELEM)
def _(t):
    x = F.col("x")
    d = t.events.select("event_id", ((F.col("value") - 50) / 10).alias("x"))
    return d.select(
        "event_id", R(F.abs(x)).alias("k085_abs"), E.round_even(x, 1).alias("k086_round"), R(F.sqrt(F.abs(x))).alias("k087_sqrt"), R(F.when(x > 0, E.log(x))).alias("k088_log"),
        R(F.when(x > 0, E.log10(x))).alias("k089_log10"), R(F.log1p(F.abs(x))).alias("k090_log1p"), R(F.exp(x / 3), 5).alias("k091_exp"), R(F.sin(x)).alias("k092_sin"), R(F.cos(x)).alias("k093_cos"),
        R(F.asin(x / 100)).alias("k094_asin"), R(F.atan2(x, F.lit(2.0))).alias("k095_atan2"), R(F.radians(x)).alias("k096_radians"), F.ceil(x).cast("double").alias("k097_ceil"), F.floor(x).cast("double").alias("k098_floor"),
        F.rint(x).alias("k099_rint"), R(E.maximum(x, F.lit(1.5))).alias("k101_maximum"), R(E.minimum(x, F.lit(1.5))).alias("k102_minimum"), R(F.pow(F.abs(x), F.lit(1.5)), 5).alias("k104_power"),
        R(F.tan(x / 100)).alias("p004_tan"), R(F.sinh(x / 10)).alias("p004_sinh"), R(F.cosh(x / 10)).alias("p004_cosh"),
    )


_SPECIAL = "(VALUES (0, 1.5, 2.0), (1, 0.0, 0.0), (2, -3.0, 0.0), (3, CAST('nan' AS DOUBLE), 1.0), (4, CAST('inf' AS DOUBLE), 2.0), (5, 4.0, CAST('-inf' AS DOUBLE)), (6, 1e-310, 1.0)) AS s(i, a, b)"


def _special(t):
    nan, inf = float("nan"), float("inf")
    return t.spark.createDataFrame([(0, 1.5, 2.0), (1, 0.0, 0.0), (2, -3.0, 0.0), (3, nan, 1.0), (4, inf, 2.0), (5, 4.0, -inf), (6, 1e-310, 1.0)], "i int, a double, b double")


@query(
    "k100_k103_k105_special_values",
    f"""SELECT i, CASE WHEN isnan(a) THEN 0.0 WHEN isinf(a) THEN 1.7976931348623157e308 * sign(a) ELSE a END AS num,
     CASE WHEN b <> 0 THEN (CASE WHEN isnan(a / b) THEN 'nan' WHEN isinf(a / b) THEN 'inf' ELSE 'number' END) WHEN a = 0 OR isnan(a) THEN 'nan' ELSE 'inf' END AS quotient,
     isfinite(a) AS finite, isnan(a) AS nan,
     CASE WHEN isnan(a) THEN 'NAN' WHEN isinf(a) THEN CASE WHEN a > 0 THEN 'POSITIVE_INFINITY' ELSE 'NEGATIVE_INFINITY' END WHEN a = 0 THEN 'ZERO' WHEN abs(a) < 2.2250738585072014e-308 THEN 'SUBNORMAL' ELSE 'NORMAL' END AS class FROM {_SPECIAL}""",
)
def _(t):
    q = E.divide("a", "b")
    kind = F.when(F.isnan(q), "nan").when(F.abs(q) == float("inf"), "inf").otherwise("number")
    return _special(t).select("i", E.nan_to_num("a").alias("num"), kind.alias("quotient"), E.is_finite("a").alias("finite"), F.isnan("a").alias("nan"), E.classify_float("a").alias("class"))


@query("k107_k110_predicates", "SELECT c_custkey, c_mktsegment IN ('BUILDING', 'MACHINERY') AS member, abs(c_acctbal - round(c_acctbal, 1)) <= 1e-8 + 1e-5 * abs(round(c_acctbal, 1)) AS close FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("member"), E.is_close("c_acctbal", F.round("c_acctbal", 1)).alias("close"))


@query("k109_k110_all_close_array_equal", "SELECT true AS all_close, false AS array_equal")
def _(t):
    a = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("a"))
    b = t.supplier.select(F.col("s_suppkey").alias("k"), (F.col("s_acctbal") * (1 + 1e-9) + 1e-9).alias("b"))
    j = a.join(b, "k", "full_outer")
    return j.agg(F.bool_and(E.is_close("a", "b")).alias("all_close"), F.bool_and(F.col("a").eqNullSafe(F.col("b"))).alias("array_equal"))


@query("k114_k116_missing_duplicated", "SELECT o_orderkey, o_custkey % 7 IS NULL AS missing, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) > 1 AS duplicated FROM orders")
def _(t):
    w = Window.partitionBy("o_custkey", "o_orderstatus").orderBy("o_orderkey")
    return t.orders.select("o_orderkey", (F.col("o_custkey") % 7).isNull().alias("missing"), (F.row_number().over(w) > 1).alias("duplicated"))


@query("k117_numeric_dtype", "SELECT column_name AS name, data_type IN ('BIGINT', 'INTEGER', 'DOUBLE') AS is_numeric FROM (DESCRIBE lineitem) AS d(column_name, data_type, a, b, c, e)")
def _(t):
    from pyspark.sql.types import NumericType

    return t.spark.createDataFrame([(f.name, isinstance(f.dataType, NumericType)) for f in t.lineitem.schema], "name string, is_numeric boolean")


# --- statistics --------------------------------------------------------------------------------------


@query(
    "k118_k123_statistics",
    "SELECT l_returnflag, round(stddev_pop(l_extendedprice), 3) AS k118_std, round(median(l_quantity), 4) AS k119_median, round(quantile_cont(l_extendedprice, 0.9), 3) AS k120_quantile, round(avg(l_tax), 6) AS k121_mean, round(covar_samp(l_quantity, l_extendedprice), 1) AS k122_cov, round(corr(l_quantity, l_extendedprice), 6) AS k123_corr FROM lineitem GROUP BY ALL",
)
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(
        R(F.stddev_pop("l_extendedprice"), 3).alias("k118_std"), R(F.median("l_quantity"), 4).alias("k119_median"), R(F.percentile("l_extendedprice", 0.9), 3).alias("k120_quantile"),
        R(F.avg("l_tax")).alias("k121_mean"), R(F.covar_samp("l_quantity", "l_extendedprice"), 1).alias("k122_cov"), R(F.corr("l_quantity", "l_extendedprice")).alias("k123_corr"),
    )


@query("k124_cumulative_sum", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS v FROM events")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("event_id", R(F.sum("value").over(w), 4).alias("v"))


@query("k125_bincount", "SELECT b.k AS bin, count(p_size) AS n, round(coalesce(sum(p_retailprice), 0), 2) AS w FROM (SELECT unnest(range(0, (SELECT max(p_size) FROM part) + 1)) AS k) b LEFT JOIN part ON p_size = b.k GROUP BY b.k")
def _(t):
    top = t.part.agg(F.max("p_size")).first()[0]  # one number
    c = t.part.groupBy(F.col("p_size").cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("p_retailprice").alias("w"))
    return t.spark.range(top + 1).withColumnRenamed("id", "bin").join(c, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), R(F.coalesce("w", F.lit(0.0)), 2).alias("w"))


@query("k126_count_nonzero", "SELECT user_id, count(*) FILTER (floor(value) % 2 <> 0) AS n FROM events GROUP BY user_id")
def _(t):
    return t.events.groupBy("user_id").agg(F.count_if(F.floor("value") % 2 != 0).alias("n"))


@query("k127_difference", "SELECT event_id, round(d - lag(d) OVER w, 4) AS value FROM (SELECT *, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY row_number() OVER w > 2")
def _(t):
    return L.difference(t.events, ["user_id"], ["ts", "event_id"], "value", 2).select("event_id", R("value", 4).alias("value"))


@query(
    "k128_gradient",
    "SELECT event_id, round(CASE WHEN lag(value) OVER w IS NOT NULL AND lead(value) OVER w IS NOT NULL THEN (lead(value) OVER w - lag(value) OVER w) / 2 WHEN lead(value) OVER w IS NOT NULL THEN lead(value) OVER w - value WHEN lag(value) OVER w IS NOT NULL THEN value - lag(value) OVER w END, 5) AS g FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
)
def _(t):
    return t.events.select("event_id", R(L.gradient("value", ["user_id"], ["ts", "event_id"]), 5).alias("g"))


@query("k129_unique_values", "SELECT p_brand AS v, count(*) AS n, min(p_partkey) AS first_at, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM part GROUP BY p_brand")
def _(t):
    u = t.part.groupBy(F.col("p_brand").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_at"))
    return u.withColumn("code", (F.dense_rank().over(Window.orderBy("v")) - 1).cast("long"))


@query("k130_median_filter", "SELECT event_id, round(median(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 5) AS v FROM events")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    around = F.array_sort(F.array_compact(F.array(*(f(c, k).over(w) for f, c, k in [(F.lag, "value", 2), (F.lag, "value", 1), (F.lead, "value", 0), (F.lead, "value", 1), (F.lead, "value", 2)]))))
    n = F.size("s")
    d = t.events.select("event_id", around.alias("s"))
    mid = (F.element_at("s", F.floor((n + 1) / 2).cast("int")) + F.element_at("s", F.floor(n / 2).cast("int") + 1)) / 2
    return d.select("event_id", R(mid, 5).alias("v"))


@query("w008_autocorrelation", "SELECT k, round(corr(v, w), 6) AS r, abs(corr(v, w)) <= 2 / sqrt(count(*)) AS independent FROM (SELECT k, value AS v, lag(value, CAST(k AS INT)) OVER (PARTITION BY k ORDER BY ts, event_id) AS w FROM events, (SELECT unnest(range(1, 6)) AS k)) WHERE w IS NOT NULL GROUP BY k")
def _(t):
    m = F.unix_micros(F.col("ts").cast("timestamp"))
    e = L.numbered(t.events.select("ts", "event_id", "value"), [m.isNull(), F.coalesce(m, F.lit(0)), F.col("event_id")])
    late = e.select(F.explode(F.array(*(F.lit(k).cast("long") for k in range(1, 6)))).alias("k"), "place", F.col("value").alias("w")).select("k", (F.col("place") + F.col("k")).alias("place"), "w")
    r = e.select("place", "value").join(late.where("w is not null"), "place").groupBy("k").agg(F.corr("value", "w").alias("r"), F.count(F.lit(1)).alias("n"))
    return r.select("k", R("r").alias("r"), (F.abs("r") <= 2 / F.sqrt("n")).alias("independent"))


@query("w010_ecdf", "SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) / CAST(count(*) OVER () AS DOUBLE) AS f FROM supplier")
def _(t):
    at = L.numbered(t.supplier.select("s_suppkey", "s_acctbal"), [F.col("s_acctbal"), F.col("s_suppkey")])
    n = at.agg(F.count(F.lit(1)).alias("n"))  # one row
    return at.crossJoin(F.broadcast(n)).select("s_suppkey", ((F.col("place") + 1) / F.col("n").cast("double")).alias("f"))


# --- selection ---------------------------------------------------------------------------------------


@query("k062_k063_nonzero", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount <> 0 AND l_tax = 0")
def _(t):
    return t.lineitem.where("l_discount != 0 and l_tax = 0").select("l_orderkey", "l_linenumber")


@query("k064_k065_argmin_argmax", "SELECT user_id, first(event_id ORDER BY value, event_id) AS lo, first(event_id ORDER BY value DESC, event_id) AS hi FROM events GROUP BY user_id")
def _(t):
    return t.events.groupBy("user_id").agg(F.min_by("event_id", F.struct("value", "event_id")).alias("lo"), F.max_by("event_id", F.struct(F.col("value"), -F.col("event_id"))).alias("hi"))


@query("k066_k068_argsort", "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber, l_partkey, l_suppkey) - 1 AS place FROM lineitem")
def _(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_extendedprice", "l_linenumber", "l_partkey", "l_suppkey")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", (F.row_number().over(w) - 1).cast("long").alias("place"))


@query("k067_argpartition", "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) <= 10")
def _(t):
    w = Window.partitionBy("event_type").orderBy("value", "event_id")
    return t.events.withColumn("r", F.row_number().over(w)).where("r <= 10").select("event_type", "event_id")


@query("k069_lexsort", "SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey, c_acctbal, c_custkey) - 1 AS place FROM customer")
def _(t):
    return t.customer.select("c_custkey", (F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("c_nationkey", "c_acctbal", "c_custkey")) - 1).cast("long").alias("place"))


@query("k070_take_along_axis", "SELECT a.l_orderkey, min(a.l_quantity) AS v FROM lineitem a JOIN (SELECT l_orderkey, max(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1) i USING (l_orderkey, l_linenumber) GROUP BY 1")
def _(t):
    i = t.lineitem.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("l_linenumber"))
    return t.lineitem.join(i, ["l_orderkey", "l_linenumber"]).groupBy("l_orderkey").agg(F.min("l_quantity").alias("v"))


@query("k071_searchsorted", "SELECT o_orderkey, (SELECT count(*) FROM (VALUES (50000.0), (100000.0), (200000.0), (300000.0)) e(b) WHERE b < o_totalprice) AS place FROM orders")
def _(t):
    edges = F.array(*(F.lit(x) for x in (50000.0, 100000.0, 200000.0, 300000.0)))
    return t.orders.select("o_orderkey", F.size(F.filter(edges, lambda b: b < F.col("o_totalprice"))).cast("long").alias("place"))


@query("k072_unravel_index", "SELECT k, k // 12 AS i, k // 4 % 3 AS j, k % 4 AS l FROM (SELECT unnest(range(0, 60)) AS k)")
def _(t):
    k = F.col("id")
    return t.spark.range(60).select(k.alias("k"), F.floor(k / 12).alias("i"), (F.floor(k / 4) % 3).alias("j"), (k % 4).alias("l"))


@query("k073_triangular_indices", "SELECT i, j FROM (SELECT unnest(range(0, 9)) AS i), (SELECT unnest(range(0, 9)) AS j) WHERE j >= i + 1")
def _(t):
    # a fixed 9 x 9 grid
    return t.spark.range(81).select(F.floor(F.col("id") / 9).alias("i"), (F.col("id") % 9).alias("j")).where("j >= i + 1")


@query("k074_k076_label_position_access", "SELECT 'loc' AS via, n_name FROM nation WHERE n_nationkey BETWEEN 3 AND 6 UNION ALL SELECT 'iloc', n_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS p FROM nation) WHERE p IN (0, 2) UNION ALL SELECT 'get', coalesce((SELECT n_name FROM nation WHERE n_nationkey = 999), 'none')")
def _(t):
    n = t.nation
    pos = n.withColumn("p", F.row_number().over(Window.orderBy("n_name")) - 1)
    got = n.where("n_nationkey = 999").agg(F.coalesce(F.max("n_name"), F.lit("none")).alias("n_name"))
    return n.where("n_nationkey between 3 and 6").select(F.lit("loc").alias("via"), "n_name").union(pos.where("p in (0, 2)").select(F.lit("iloc"), "n_name")).union(got.select(F.lit("get"), "n_name"))


@query("k077_k080_sel_nearest", "SELECT user_id, first(event_id ORDER BY abs(value - 50), event_id) AS event_id FROM events GROUP BY user_id")
def _(t):
    return t.events.groupBy("user_id").agg(F.min_by("event_id", F.struct(F.abs(F.col("value") - 50), F.col("event_id"))).alias("event_id"))


@query("k083_where", "SELECT event_id, CASE WHEN value > 50 THEN value ELSE -value END AS a, CASE WHEN event_type = 'click' THEN value END AS b FROM events")
def _(t):
    return t.events.select("event_id", F.when(F.col("value") > 50, F.col("value")).otherwise(-F.col("value")).alias("a"), F.when(F.col("event_type") == "click", F.col("value")).alias("b"))


# --- interpolation and quadrature ------------------------------------------------------------------------

@query(
    "k131_k133_interpolation",
    """WITH s AS (SELECT user_id, epoch(ts) AS x, avg(value) AS y FROM events GROUP BY 1, 2), q AS (SELECT user_id, min(x) + (max(x) - min(x)) * f AS p FROM s, (VALUES (0.1), (0.5), (0.73)) v(f) GROUP BY user_id, f),
 a AS (SELECT q.user_id, q.p, s.x AS xa, s.y AS ya FROM q ASOF JOIN s ON s.user_id = q.user_id AND q.p >= s.x), b AS (SELECT a.*, s.x AS xb, s.y AS yb FROM a ASOF JOIN s ON s.user_id = a.user_id AND a.p <= s.x)
SELECT user_id, round(p, 2) AS p, round(CASE WHEN xa = xb THEN ya ELSE ya + (yb - ya) * (p - xa) / (xb - xa) END, 3) AS y, 'APPROXIMATION_OF' AS relation FROM b""",
)
def _(t):
    """Three points between the events of every user."""
    s = t.events.groupBy("user_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("m")).agg(F.avg("value").alias("y")).select("user_id", (F.col("m") / 1e6).alias("x"), "y")
    f = F.explode(F.array(F.lit(0.1), F.lit(0.5), F.lit(0.73)))
    q = s.groupBy("user_id").agg(F.min("x").alias("a"), F.max("x").alias("b")).withColumn("f", f).select("user_id", (F.col("a") + (F.col("b") - F.col("a")) * F.col("f")).alias("p"))
    return L.interpolate(s, q, "x", "y", "p", ["user_id"]).select("user_id", R("p", 2).alias("p"), R("y", 3).alias("y"), "relation")


@query(
    "k261_quadrature",
    """WITH g AS (SELECT i, i / 1000.0 AS x, exp(-(i / 1000.0) * (i / 1000.0)) AS f FROM (SELECT unnest(range(0, 1001)) AS i))
     SELECT round(sum(CASE WHEN i < 1000 THEN f END) / 1000, 8) AS lft, round(sum(CASE WHEN i > 0 THEN f END) / 1000, 8) AS rgt, round(sum(CASE WHEN i IN (0, 1000) THEN f / 2 ELSE f END) / 1000, 8) AS trapezoid,
     round(sum(CASE WHEN i IN (0, 1000) THEN f WHEN i % 2 = 1 THEN 4 * f ELSE 2 * f END) / 3000, 8) AS simpson FROM g""",
)
def _(t):
    i, x = F.col("id"), F.col("id") / 1000.0
    g = t.spark.range(1001).select("id", F.exp(-x * x).alias("f"))
    end = i.isin(0, 1000)
    f = F.col("f")
    return g.agg(
        R(F.sum(F.when(i < 1000, f)) / 1000, 8).alias("lft"), R(F.sum(F.when(i > 0, f)) / 1000, 8).alias("rgt"), R(F.sum(F.when(end, f / 2).otherwise(f)) / 1000, 8).alias("trapezoid"),
        R(F.sum(F.when(end, f).when(i % 2 == 1, 4 * f).otherwise(2 * f)) / 3000, 8).alias("simpson"),
    )


@query("p029_difference_families", "SELECT event_id, round(lead(value) OVER w - value, 4) AS fwd, round(value - lag(value) OVER w, 4) AS bwd, round((lead(value) OVER w - lag(value) OVER w) / 2, 4) AS central, round(lead(value) OVER w - 2 * value + lag(value) OVER w, 4) AS second FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    a, b, v = F.lag("value").over(w), F.lead("value").over(w), F.col("value")
    return t.events.select("event_id", R(b - v, 4).alias("fwd"), R(v - a, 4).alias("bwd"), R((b - a) / 2, 4).alias("central"), R(b - 2 * v + a, 4).alias("second"))


# --- contraction and linear algebra -----------------------------------------------------------------------


@query("k134_dot", "SELECT vec_id, round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: CAST(embedding[i] AS DOUBLE) * i)), 4) AS v FROM embeddings")
def _(t):
    e = F.transform("embedding", lambda x, i: x.cast("double") * (i + 1))
    return t.embeddings.select("vec_id", R(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), 4).alias("v"))


_M = "a AS (SELECT s_nationkey % 5 AS i, s_suppkey % 4 AS k, sum(s_acctbal) AS v FROM supplier GROUP BY ALL), b AS (SELECT c_nationkey % 4 AS k, c_custkey % 3 AS j, sum(c_acctbal) AS v FROM customer GROUP BY ALL)"


@query("k135_k136_matmul_einsum", f"WITH {_M} SELECT i, j, round(sum(a.v * b.v), 0) AS v FROM a JOIN b USING (k) GROUP BY i, j")
def _(t):
    a = t.supplier.groupBy((F.col("s_nationkey") % 5).alias("i"), (F.col("s_suppkey") % 4).alias("k")).agg(F.sum("s_acctbal").alias("v"))
    b = t.customer.groupBy((F.col("c_nationkey") % 4).cast("long").alias("k"), (F.col("c_custkey") % 3).alias("j")).agg(F.sum("c_acctbal").alias("v"))
    return L.contract(a, b, ["k"], ["i", "j"]).select("i", "j", R("v", 0).alias("v"))


@query("k137_norm", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 5) AS l2, round(list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))), 5) AS l1, round(list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))), 5) AS linf FROM embeddings")
def _(t):
    d = F.transform("embedding", lambda x: x.cast("double"))
    add = lambda f: F.aggregate(d, F.lit(0.0), lambda a, x: a + f(x))
    return t.embeddings.select("vec_id", R(F.sqrt(add(lambda x: x * x)), 5).alias("l2"), R(add(F.abs), 5).alias("l1"), R(F.array_max(F.transform(d, F.abs)), 5).alias("linf"))


# --- shapes --------------------------------------------------------------------------------------------


@query("k141_k145_reshape_transpose", "SELECT k // 6 AS i, k % 6 AS j, k % 8 AS ti, k // 8 AS tj, k AS v FROM (SELECT unnest(range(0, 48)) AS k)")
def _(t):
    k = F.col("id")
    return t.spark.range(48).repartition(3).select(F.floor(k / 6).alias("i"), (k % 6).alias("j"), (k % 8).alias("ti"), F.floor(k / 8).alias("tj"), k.alias("v"))


@query("k146_k147_concatenate_stack", "SELECT axis, row_number() OVER (PARTITION BY axis ORDER BY k) - 1 AS pos, v FROM (SELECT 0 AS axis, s_suppkey AS k, s_acctbal AS v FROM supplier UNION ALL SELECT 1, p_partkey, p_retailprice FROM part)")
def _(t):
    a = t.supplier.select(F.lit(0).alias("axis"), F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    b = t.part.select(F.lit(1), "p_partkey", "p_retailprice")
    return a.union(b).select("axis", (F.row_number().over(Window.partitionBy("axis").orderBy("k")) - 1).cast("long").alias("pos"), "v")


@query("k148_k149_k156_broadcast_meshgrid", "SELECT r_regionkey, n_nationkey, r_regionkey * 100 + n_nationkey AS v FROM region, nation")
def _(t):
    # five regions by twenty-five nations
    return t.region.select("r_regionkey").crossJoin(F.broadcast(t.nation.select("n_nationkey"))).withColumn("v", F.col("r_regionkey") * 100 + F.col("n_nationkey"))


@query("k150_repeat_tile", "SELECT r_regionkey, rep, r_regionkey * 3 + rep AS repeat_pos, rep * 5 + r_regionkey AS tile_pos FROM region, (SELECT unnest(range(0, 3)) AS rep)")
def _(t):
    d = t.region.select("r_regionkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("rep"))
    return d.select("r_regionkey", F.col("rep").cast("long").alias("rep"), (F.col("r_regionkey") * 3 + F.col("rep")).alias("repeat_pos"), (F.col("rep") * 5 + F.col("r_regionkey")).alias("tile_pos"))


@query("k151_k160_axes", "SELECT n_nationkey AS p, (SELECT count(*) FROM nation) - 1 - n_nationkey AS flipped, 0 AS new_axis, 1 AS rank, (SELECT count(*) FROM nation) AS size FROM nation")
def _(t):
    n = t.nation.count()  # the extent of the axis
    return t.nation.select(F.col("n_nationkey").alias("p"), (F.lit(n) - 1 - F.col("n_nationkey")).alias("flipped"), F.lit(0).alias("new_axis"), F.lit(1).alias("rank"), F.lit(n).alias("size"))


@query("k161_k163_ranges", "SELECT k, 0.5 + k * 0.25 AS arange, 2 + k * (3.0 - 2.0) / 39 AS linspace FROM (SELECT unnest(range(0, 40)) AS k)")
def _(t):
    k = F.col("id")
    return t.spark.range(40).select(k.alias("k"), (F.lit(0.5) + k * F.lit(0.25)).alias("arange"), (F.lit(2.0) + k * F.lit(1.0) / 39).alias("linspace"))


@query("k164_k166_casts", "SELECT event_id, CAST(trunc(value) AS BIGINT) AS i, CAST(trunc(value * 1000) AS BIGINT) % 256 AS u8, ((CAST(trunc(value * 1000) AS BIGINT) + 128) % 256) - 128 AS i8 FROM events")
def _(t):
    i = (F.col("value") * 1000).cast("long")
    return t.events.select("event_id", F.col("value").cast("long").alias("i"), E.wrap(i, 8, False).alias("u8"), E.wrap(i, 8).alias("i8"))


@query("k176_k182_fills_identity", "SELECT k // 7 AS i, k % 7 AS j, 0.0 AS zeros, 1.0 AS ones, 2.5 AS fulls, CASE WHEN k // 7 = k % 7 THEN 1.0 ELSE 0.0 END AS eye, CASE WHEN k // 7 = k % 7 THEN 9.0 ELSE 2.5 END AS filled_diagonal FROM (SELECT unnest(range(0, 49)) AS k)")
def _(t):
    g = t.spark.range(49).select(F.floor(F.col("id") / 7).alias("i"), (F.col("id") % 7).alias("j"))
    on = F.col("i") == F.col("j")
    return g.select("i", "j", F.lit(0.0).alias("zeros"), F.lit(1.0).alias("ones"), F.lit(2.5).alias("fulls"), F.when(on, 1.0).otherwise(0.0).alias("eye"), F.when(on, 9.0).otherwise(2.5).alias("filled_diagonal"))


@query("k183_k184_masks", f"SELECT i, CASE WHEN isfinite(a) THEN a END AS invalid_masked, coalesce(CASE WHEN isfinite(a) THEN a END, -1.0) AS filled FROM {_SPECIAL}")
def _(t):
    m = F.when(E.is_finite("a"), F.col("a"))
    return _special(t).select("i", m.alias("invalid_masked"), F.coalesce(m, F.lit(-1.0)).alias("filled"))


@query("k186_k197_time", "SELECT event_id, epoch_us(ts + INTERVAL 90 MINUTE) AS shifted, epoch_us(CAST(strftime(ts, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP)) AS parsed FROM events")
def _(t):
    shifted = F.col("ts") + F.make_dt_interval(mins=F.lit(90))
    parsed = F.try_to_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("yyyy-MM-dd HH:mm:ss"))
    return t.events.select("event_id", F.unix_micros(shifted.cast("timestamp")).alias("shifted"), F.unix_micros(parsed).alias("parsed"))


@query("k188_k195_lists", "SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber, l_partkey) AS v FROM lineitem GROUP BY l_orderkey")
def _(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("v"))


@query("k194_numeric_conversion", "SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS DOUBLE) AS v FROM orders")
def _(t):
    s = F.when(F.col("o_orderkey") % 3 == 0, F.lit("n/a")).otherwise(F.col("o_custkey").cast("string"))
    return t.orders.select("o_orderkey", s.try_cast("double").alias("v"))


@query("k201_k204_sparse", "SELECT r AS \"row\", c AS col, v, sum(1) OVER (ORDER BY r, c) - 1 AS place FROM (SELECT p_size AS r, p_partkey % 11 AS c, count(*) AS v FROM part GROUP BY ALL)")
def _(t):
    """The stored values in the order of rows and columns, each with its place."""
    coo = t.part.groupBy(F.col("p_size").alias("row"), (F.col("p_partkey") % 11).alias("col")).agg(F.count(F.lit(1)).alias("v"))
    return L.numbered(coo, [F.col("row"), F.col("col")])


@query(
    "k202_k204_row_pointers",
    """WITH m AS (SELECT p_size AS r, list(DISTINCT p_partkey % 11 ORDER BY p_partkey % 11) AS cols FROM part GROUP BY p_size)
SELECT r AS \"row\", CAST(sum(len(cols)) OVER (ORDER BY r) - len(cols) AS BIGINT) AS ptr, CAST(sum(len(cols)) OVER (ORDER BY r) AS BIGINT) AS stop, cols FROM m""",
)
def _(t):
    """Compressed rows: where each row's values begin and end among all stored ones, and the columns they stand in."""
    coo = t.part.groupBy(F.col("p_size").alias("row"), (F.col("p_partkey") % 11).alias("col")).agg(F.count(F.lit(1)).alias("v"))
    at = L.numbered(coo, [F.col("row"), F.col("col")])
    return at.groupBy("row").agg(F.min("place").alias("ptr"), (F.max("place") + 1).alias("stop"), F.array_sort(F.collect_list("col")).alias("cols"))


@query("k254_quotient_remainder", "SELECT event_id, CAST(floor((event_id - 500) / 7.0) AS BIGINT) AS q, (event_id - 500) - 7 * CAST(floor((event_id - 500) / 7.0) AS BIGINT) AS r FROM events")
def _(t):
    q, r = E.floor_mod(F.col("event_id") - 500, F.lit(7))
    return t.events.select("event_id", q.alias("q"), r.alias("r"))


@query("k257_k259_indexed_updates", "WITH u AS (SELECT l_suppkey AS k, sum(l_tax) AS s, max(l_quantity) AS hi, min(l_quantity) AS lo FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT s_suppkey, round(s_acctbal + coalesce(s, 0), 4) AS added, greatest(10.0, coalesce(hi, 10.0)) AS maxed, least(10.0, coalesce(lo, 10.0)) AS mined FROM supplier LEFT JOIN u ON k = s_suppkey")
def _(t):
    u = t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.sum("l_tax").alias("s"), F.max("l_quantity").alias("hi"), F.min("l_quantity").alias("lo"))
    d = t.supplier.join(u, "s_suppkey", "left")
    return d.select("s_suppkey", R(F.col("s_acctbal") + F.coalesce("s", F.lit(0.0)), 4).alias("added"), F.greatest(F.lit(10.0), F.coalesce("hi", F.lit(10.0))).alias("maxed"), F.least(F.lit(10.0), F.coalesce("lo", F.lit(10.0))).alias("mined"))


# --- bits ------------------------------------------------------------------------------------------------


@query(
    "p009_p010_bits",
    "SELECT p_partkey, p_partkey & 255 AS a, p_partkey | 4096 AS o, xor(p_partkey, 77) AS x, p_partkey << 3 AS sl, p_partkey >> 2 AS sr, bit_count(p_partkey) AS pop, ((p_partkey << 5) | ((p_partkey & 65535) >> 11)) & 65535 AS rot, (p_partkey >> 4) & 15 AS field, (p_partkey & ~CAST(240 AS BIGINT)) | (9 << 4) AS ins, bit_count(p_partkey) % 2 AS parity FROM part",
)
def _(t):
    p = F.col("p_partkey")
    return t.part.select(
        "p_partkey", p.bitwiseAND(F.lit(255)).alias("a"), p.bitwiseOR(F.lit(4096)).alias("o"), p.bitwiseXOR(F.lit(77)).alias("x"), F.shiftleft(p, 3).alias("sl"), F.shiftright(p, 2).alias("sr"), F.bit_count(p).alias("pop"),
        E.rotate_left(p.bitwiseAND(F.lit(65535)), 5, 16).alias("rot"), E.bit_field(p, 4, 4).alias("field"), E.set_bit_field(p, F.lit(9), 4, 4).alias("ins"), (F.bit_count(p) % 2).alias("parity"),
    )


@query("p011_p013_logic", "SELECT o_orderkey, o_totalprice > 1e5 AND o_orderstatus = 'F' AS a, o_totalprice > 1e5 OR o_orderstatus = 'F' AS o, (o_totalprice > 1e5) <> (o_orderstatus = 'F') AS x, NOT (o_totalprice > 1e5) OR o_orderstatus = 'F' AS implies, CASE WHEN o_totalprice < 5e4 THEN 'low' WHEN o_totalprice < 2e5 THEN 'mid' ELSE 'high' END AS piece FROM orders")
def _(t):
    p, q = F.col("o_totalprice") > 1e5, F.col("o_orderstatus") == "F"
    piece = F.when(F.col("o_totalprice") < 5e4, "low").when(F.col("o_totalprice") < 2e5, "mid").otherwise("high")
    return t.orders.select("o_orderkey", (p & q).alias("a"), (p | q).alias("o"), (p != q).alias("x"), (~p | q).alias("implies"), piece.alias("piece"))


@query("p014_p016_comprehensions", "SELECT vec_id, i - 1 AS pos, CAST(x AS DOUBLE) AS x FROM (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS x FROM embeddings) WHERE x > 0.3")
def _(t):
    return t.embeddings.select("vec_id", F.posexplode("embedding").alias("pos", "x")).where("x > 0.3").select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("x").cast("double").alias("x"))
