"""Reductions, aggregates, grouping, alignment and table mappings over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from numera.functions import elementwise as E
from numera.operators import labelled as L
from numera.plans.catalog import query

R = lambda c, d=4: F.round(c, d)


# --- reductions -------------------------------------------------------------------------------------


@query("k001_sum", "SELECT l_returnflag, round(sum(l_quantity), 2) AS v, CAST(sum(l_linenumber) AS BIGINT) AS n FROM lineitem GROUP BY ALL")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(R(F.sum("l_quantity"), 2).alias("v"), F.sum("l_linenumber").alias("n"))


_NAN = "CASE WHEN event_type = 'click' AND event_id % 97 = 0 THEN CAST('nan' AS DOUBLE) ELSE value END"


def _with_nan(t):
    return t.events.withColumn("x", F.when((F.col("event_type") == "click") & (F.col("event_id") % 97 == 0), F.lit(float("nan"))).otherwise(F.col("value")))


@query(
    "k002_minimum",
    f"SELECT event_type, CAST(bool_or(isnan(x)) AS BOOLEAN) AS has_nan, CASE WHEN bool_or(isnan(x)) THEN NULL ELSE round(min(x), 4) END AS v, round(min(x) FILTER (NOT isnan(x)), 4) AS nanmin "
    f"FROM (SELECT event_type, {_NAN} AS x FROM events) GROUP BY event_type",
)
def _(t):
    out = _with_nan(t).groupBy("event_type").agg(F.bool_or(F.isnan("x")).alias("has_nan"), L.propagating_min(F.col("x")).alias("m"), F.min(E.nan_to_null("x")).alias("n"))
    return out.select("event_type", "has_nan", R(E.nan_to_null("m")).alias("v"), R("n").alias("nanmin"))


@query(
    "k003_maximum",
    f"SELECT event_type, CAST(isnan(max(x)) AS BOOLEAN) AS has_nan, round(max(x) FILTER (NOT isnan(x)), 4) AS nanmax FROM (SELECT event_type, {_NAN} AS x FROM events) GROUP BY event_type",
)
def _(t):
    return _with_nan(t).groupBy("event_type").agg(F.isnan(F.max("x")).alias("has_nan"), R(F.max(E.nan_to_null("x"))).alias("nanmax"))


@query("k004_product", "SELECT l_orderkey, round(product(1 + l_tax), 6) AS v FROM lineitem GROUP BY l_orderkey")
def _(t):
    return t.lineitem.groupBy("l_orderkey").agg(R(F.product(1 + F.col("l_tax")), 6).alias("v"))


@query("k005_mean", "SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 4) AS v FROM lineitem GROUP BY ALL")
def _(t):
    return L.reduce(t.lineitem, ["l_returnflag", "l_linestatus"], R(F.avg("l_extendedprice")))


@query("k006_any", "SELECT l_orderkey, bool_or(l_discount > 0.09) AS v FROM lineitem GROUP BY l_orderkey")
def _(t):
    return L.reduce(t.lineitem, ["l_orderkey"], F.coalesce(F.bool_or(F.col("l_discount") > 0.09), F.lit(False)))


@query("k007_all", "SELECT l_orderkey, bool_and(l_quantity > 5) AS v FROM lineitem GROUP BY l_orderkey")
def _(t):
    return L.reduce(t.lineitem, ["l_orderkey"], F.coalesce(F.bool_and(F.col("l_quantity") > 5), F.lit(True)))


@query("k008_nan_sum", f"SELECT event_type, round(coalesce(sum(x) FILTER (NOT isnan(x)), 0), 3) AS v FROM (SELECT event_type, {_NAN} AS x FROM events) GROUP BY event_type")
def _(t):
    return _with_nan(t).groupBy("event_type").agg(R(F.coalesce(F.sum(E.nan_to_null("x")), F.lit(0.0)), 3).alias("v"))


@query("k009_median", "SELECT l_returnflag, round(median(l_extendedprice), 3) AS v FROM lineitem GROUP BY ALL")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(R(F.median("l_extendedprice"), 3).alias("v"))


@query(
    "k010_segmented_minimum",
    """WITH o(seg, off) AS (VALUES (0, 0), (1, 100), (2, 100), (3, 400), (4, 250)), s AS (SELECT seg, off AS s, lead(off) OVER (ORDER BY seg) AS e FROM o)
    SELECT seg, round(min(value), 4) AS v FROM s JOIN events ON event_id >= s.s AND event_id < CASE WHEN e IS NULL THEN 1000000000000 ELSE greatest(e, s.s + 1) END GROUP BY seg""",
)
def _(t):
    offs = t.spark.createDataFrame([(0, 0), (1, 100), (2, 100), (3, 400), (4, 250)], "seg int, off long")
    return L.segmented_min(t.events, offs, "event_id", "value", "off").select("seg", R("v").alias("v"))


# --- aggregates over groups ---------------------------------------------------------------------------

_AGG = """SELECT l_shipmode_k, round(coalesce(sum(q), 0), 2) AS k011_sum, bool_and(q > 0) AS k012_all, round(avg(q), 4) AS k013_mean, round(stddev_samp(q), 4) AS k014_std,
 round(median(q), 4) AS k015_median, round(quantile_cont(q, 0.25), 4) AS k016_quantile FROM (SELECT l_suppkey % 7 AS l_shipmode_k, l_quantity AS q FROM lineitem) GROUP BY 1"""


@query("k011_k016_group_aggregates", _AGG)
def _(t):
    g = t.lineitem.groupBy((F.col("l_suppkey") % 7).alias("l_shipmode_k"))
    q = F.col("l_quantity")
    return g.agg(
        R(F.coalesce(F.sum(q), F.lit(0.0)), 2).alias("k011_sum"), F.bool_and(q > 0).alias("k012_all"), R(F.avg(q)).alias("k013_mean"), R(F.stddev_samp(q)).alias("k014_std"),
        R(F.median(q)).alias("k015_median"), R(F.percentile(q, 0.25)).alias("k016_quantile"),
    )


@query("k017_aggregate", "SELECT o_orderstatus, count(*) AS n, round(min(o_totalprice), 2) AS lo, round(max(o_totalprice), 2) AS hi, round(sum(o_totalprice), 1) AS total FROM orders GROUP BY ALL")
def _(t):
    return t.orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), R(F.min("o_totalprice"), 2).alias("lo"), R(F.max("o_totalprice"), 2).alias("hi"), R(F.sum("o_totalprice"), 1).alias("total"))


@query("k018_group_transform", "SELECT c_custkey, round(c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_mktsegment), 4) AS centred FROM customer")
def _(t):
    return t.customer.select("c_custkey", R(F.col("c_acctbal") - F.avg("c_acctbal").over(Window.partitionBy("c_mktsegment"))).alias("centred"))


@query("k019_k020_group_by_keys", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY ALL")
def _(t):
    return t.customer.where("c_mktsegment is not null").groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query("k021_k022_label_grouping", "SELECT date_trunc('month', o_orderdate) AS month, o_orderpriority, round(avg(o_totalprice), 3) AS v FROM orders GROUP BY ALL")
def _(t):
    return t.orders.groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp").alias("month"), "o_orderpriority").agg(R(F.avg("o_totalprice"), 3).alias("v"))


@query(
    "k023_coarsen",
    "SELECT user_id, CAST(floor(p / 4) AS BIGINT) AS block, round(avg(value), 4) AS v FROM (SELECT user_id, value, row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE p < n - n % 4 GROUP BY 1, 2",
)
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t.events.withColumn("p", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("user_id")))
    return e.where("p < n - n % 4").groupBy("user_id", F.floor(F.col("p") / 4).alias("block")).agg(R(F.avg("value")).alias("v"))  # boundary: trim


# --- alignment ----------------------------------------------------------------------------------------


@query("k024_concatenate", "SELECT 0 AS source, c_custkey AS k, c_acctbal AS v, c_mktsegment AS seg FROM customer UNION ALL SELECT 1, s_suppkey, s_acctbal, NULL FROM supplier")
def _(t):
    a = t.customer.select(F.lit(0).alias("source"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.col("c_mktsegment").alias("seg"))
    return a.unionByName(t.supplier.select(F.lit(1).alias("source"), F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v")), allowMissingColumns=True)


@query("k025_merge", "SELECT o_orderkey, c_mktsegment, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def _(t):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.select("o_orderkey", "c_mktsegment", "n_name")


@query("k026_join", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def _(t):
    return t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query(
    "k027_pivot_table",
    "SELECT l_returnflag, round(avg(l_quantity) FILTER (l_linestatus = 'F'), 4) AS F, round(avg(l_quantity) FILTER (l_linestatus = 'O'), 4) AS O FROM lineitem GROUP BY l_returnflag",
)
def _(t):
    return t.lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(R(F.avg("l_quantity")))


def _pair(t):
    a = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.sum("s_acctbal").alias("v")).where("k % 2 = 0")
    b = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.sum("c_acctbal").alias("v")).where("k % 3 = 0")
    return a, b


_A = "a AS (SELECT s_nationkey AS k, sum(s_acctbal) AS v FROM supplier WHERE s_nationkey % 2 = 0 GROUP BY 1), b AS (SELECT c_nationkey AS k, sum(c_acctbal) AS v FROM customer WHERE c_nationkey % 3 = 0 GROUP BY 1)"
for _how, _sql in (("INNER", "JOIN"), ("OUTER", "FULL JOIN"), ("LEFT", "LEFT JOIN"), ("RIGHT", "RIGHT JOIN")):

    @query(f"k028_align_{_how.lower()}", f'WITH {_A} SELECT coalesce(a.k, b.k) AS k, round(a.v, 2) AS "left", round(b.v, 2) AS "right" FROM a {_sql} b ON a.k = b.k')
    def _(t, how=_how):
        return L.align(*_pair(t), ["k"], how=how).select("k", R("left", 2).alias("left"), R("right", 2).alias("right"))


@query(
    "j004_exact_labels",
    "SELECT n_name AS label, CAST(n_nationkey AS DOUBLE) AS \"left\", CAST(n_regionkey AS DOUBLE) AS \"right\", 'EXACT' AS status FROM nation",
)
def _(t):
    a = t.nation.select("n_name", "n_nationkey", F.col("n_nationkey").cast("double").alias("v"))
    b = t.nation.select("n_name", "n_nationkey", F.col("n_regionkey").cast("double").alias("v"))
    return L.align_exact(a, b, "n_name", "n_nationkey").withColumnRenamed("n_name", "label")


@query("j004_exact_labels_unresolved", "SELECT CAST(NULL AS VARCHAR) AS label, CAST(NULL AS DOUBLE) AS \"left\", CAST(NULL AS DOUBLE) AS \"right\", 'UNRESOLVED' AS status")
def _(t):
    a = t.nation.select("n_name", "n_nationkey", F.col("n_nationkey").cast("double").alias("v"))
    return L.align_exact(a, a.where("n_nationkey > 0"), "n_name", "n_nationkey").withColumnRenamed("n_name", "label")


@query(
    "j005_positional",
    "WITH a AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS p, s_acctbal FROM supplier), b AS (SELECT row_number() OVER (ORDER BY s_name, s_suppkey) AS p, s_suppkey FROM supplier) SELECT p, s_acctbal, s_suppkey FROM a JOIN b USING (p)",
)
def _(t):
    a = t.supplier.select(F.row_number().over(Window.orderBy("s_suppkey")).cast("long").alias("p"), "s_acctbal")
    b = t.supplier.select(F.row_number().over(Window.orderBy("s_name", "s_suppkey")).cast("long").alias("p"), "s_suppkey")
    return a.join(b, "p")


@query("j006_conditional_fallback", f"WITH {_A} SELECT coalesce(a.k, b.k) AS k, round(CASE WHEN a.v IS NOT NULL AND b.v IS NOT NULL THEN a.v + b.v ELSE coalesce(a.v, b.v) END, 2) AS v FROM a FULL JOIN b ON a.k = b.k")
def _(t):
    return L.combine(*_pair(t), ["k"], lambda x, y: x + y).select("k", R("v", 2).alias("v"))


@query("j013_membership", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS has_orders FROM customer")
def _(t):
    o = t.orders.select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("f", F.lit(True))
    return t.customer.join(o, "c_custkey", "left").select("c_custkey", F.coalesce("f", F.lit(False)).alias("has_orders"))


@query("j013_missing_facts", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _(t):
    return t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("j015_interval_overlap", "SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_partkey < b.p_partkey AND a.p_retailprice < b.p_retailprice + 0.02 AND b.p_retailprice < a.p_retailprice + 0.02")
def _(t):
    # intervals [price, price + 0.02): a bucket column turns the overlap into an equi-join
    p = t.part.select("p_partkey", "p_retailprice", F.floor(F.col("p_retailprice") / 0.02).alias("k"))
    a = p.select(F.col("p_partkey").alias("a"), F.col("p_retailprice").alias("x"), F.explode(F.array(F.col("k") - 1, F.col("k"), F.col("k") + 1)).alias("k"))
    b = p.select(F.col("p_partkey").alias("b"), F.col("p_retailprice").alias("y"), "k")
    return a.join(b, "k").where("a < b and x < y + 0.02 and y < x + 0.02").select("a", "b")


# --- table mappings -----------------------------------------------------------------------------------


@query("k029_k031_k050_constructors", "SELECT r_regionkey, r_name FROM region")
def _(t):
    return t.spark.createDataFrame(t.region.toArrow()).select("r_regionkey", "r_name")


@query("k032_fill_missing", "SELECT event_id, round(last_value(CASE WHEN event_id % 3 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS ffill, round(coalesce(CASE WHEN event_id % 3 = 0 THEN value END, -1), 4) AS filled FROM events")
def _(t):
    v = F.when(F.col("event_id") % 3 == 0, F.col("value"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("event_id", R(F.last(v, True).over(w)).alias("ffill"), R(F.coalesce(v, F.lit(-1.0))).alias("filled"))


@query("k033_drop_missing", "SELECT event_id FROM events WHERE value IS NOT NULL AND event_id % 5 <> 0")
def _(t):
    return t.events.withColumn("x", F.when(F.col("event_id") % 5 != 0, E.nan_to_null("value"))).dropna(subset=["x"]).select("event_id")


@query("k034_replace", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS s FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.col("o_orderstatus").alias("s")).replace({"F": "final", "O": "open"}, subset=["s"])


@query("k035_apply", "SELECT p_partkey, round(p_retailprice * 2 + p_size, 3) AS v FROM part")
def _(t):
    return t.part.select("p_partkey", R(F.col("p_retailprice") * 2 + F.col("p_size"), 3).alias("v"))


@query("k036_map", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def _(t):
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")


@query("k037_k042_assign_rename_index", "SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS pos, s_suppkey AS k, s_acctbal * 2 AS twice FROM supplier")
def _(t):
    d = t.supplier.withColumns({"twice": F.col("s_acctbal") * 2}).withColumnsRenamed({"s_suppkey": "k"})
    return L.numbered(d.select("k", "twice"), [F.col("k")], "pos")


@query("k041_sort_values", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS place FROM orders")
def _(t):
    p = F.col("o_totalprice")
    return L.numbered(t.orders.select("o_orderkey", "o_totalprice"), [p.isNull(), F.coalesce(-p, F.lit(0)), F.col("o_orderkey")]).select("o_orderkey", (F.col("place") + 1).alias("place"))


@query(
    "k043_rank",
    "SELECT p_partkey, rank() OVER w AS r_min, dense_rank() OVER w AS r_dense, rank() OVER w + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS r_avg FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)",
)
def _(t):
    w = Window.partitionBy("p_brand").orderBy("p_size")
    return t.part.select("p_partkey", F.rank().over(w).cast("long").alias("r_min"), F.dense_rank().over(w).cast("long").alias("r_dense"), L.average_rank("p_size", ["p_brand"]).cast("double").alias("r_avg"))


@query("k044_drop_labels", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey NOT IN (1, 3, 5)")
def _(t):
    gone = t.spark.createDataFrame([(1,), (3,), (5,)], "s_suppkey long")
    return t.supplier.drop("s_name", "s_nationkey").join(gone, "s_suppkey", "left_anti")


@query("k045_drop_duplicates", "SELECT min(c_custkey) AS c_custkey, c_nationkey, c_mktsegment FROM customer GROUP BY c_nationkey, c_mktsegment")
def _(t):
    return t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("c_custkey"))


@query("k046_k084_clip", "SELECT c_custkey, least(greatest(c_acctbal, 0), 5000) AS v, greatest(c_acctbal, 100) AS low_only FROM customer")
def _(t):
    return t.customer.select("c_custkey", E.clip("c_acctbal", 0.0, 5000.0).alias("v"), E.clip("c_acctbal", 100.0).alias("low_only"))


@query("k047_divide_aligned", f"WITH {_A} SELECT coalesce(a.k, b.k) AS k, round(coalesce(a.v, 1) / nullif(coalesce(b.v, 1), 0), 6) AS v FROM a FULL JOIN b ON a.k = b.k")
def _(t):
    j = L.align(*_pair(t), ["k"], how="OUTER")
    return j.select("k", R(F.try_divide(F.coalesce("left", F.lit(1.0)), F.coalesce("right", F.lit(1.0))), 6).alias("v"))


@query("k048_group_tail", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 2")
def _(t):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return t.events.withColumn("r", F.row_number().over(w)).where("r <= 2").select("user_id", "event_id")


@query("k053_same_index_transform", "SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share FROM orders")
def _(t):
    return t.orders.select("o_orderkey", R(F.col("o_totalprice") / F.sum("o_totalprice").over(Window.partitionBy("o_custkey")), 6).alias("share"))


@query("k057_to_dataset", "SELECT user_id, round(sum(value) FILTER (event_type = 'click'), 3) AS click, round(sum(value) FILTER (event_type = 'view'), 3) AS view FROM events GROUP BY user_id")
def _(t):
    return t.events.groupBy("user_id").pivot("event_type", ["click", "view"]).agg(R(F.sum("value"), 3))


@query("k059_k081_reindex", "SELECT g.k, round(a.v, 2) AS v FROM (SELECT unnest(range(0, 30)) AS k) g LEFT JOIN (SELECT s_nationkey AS k, sum(s_acctbal) AS v FROM supplier GROUP BY 1) a ON g.k = a.k")
def _(t):
    a = t.supplier.groupBy(F.col("s_nationkey").cast("long").alias("k")).agg(F.sum("s_acctbal").alias("v"))
    return t.spark.range(30).withColumnRenamed("id", "k").join(a, "k", "left").select("k", R("v", 2).alias("v"))


# --- folds and conditional accumulation -----------------------------------------------------------------


@query("g003_fold_left", "SELECT l_orderkey, round(list_reduce(list_prepend(CAST(1.0 AS DOUBLE), list(l_discount ORDER BY l_linenumber, l_partkey, l_suppkey)), lambda a, x: a * 0.3721943 + x), 6) AS v FROM lineitem GROUP BY l_orderkey")
def _(t):
    return L.fold(t.lineitem, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "l_discount", 1.0, lambda a, x: a * 0.3721943 + x).select("l_orderkey", R("v", 6).alias("v"))


@query("g004_conditional_accumulation", "SELECT l_suppkey, round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END), 2) AS v, count(*) FILTER (l_returnflag = 'R') AS n FROM lineitem GROUP BY l_suppkey")
def _(t):
    p = F.col("l_returnflag") == "R"
    return t.lineitem.groupBy("l_suppkey").agg(R(F.sum(F.when(p, F.col("l_extendedprice")).otherwise(0.0)), 2).alias("v"), F.count_if(p).alias("n"))


@query("g005_finite_sum_product", "SELECT round(sum(1.0 / (i * i)), 9) AS s, round(product(1 + 1.0 / (i * i)), 9) AS p FROM (SELECT unnest(range(1, 500, 3)) AS i)")
def _(t):
    i = F.col("id").cast("double")
    return t.spark.range(1, 500, 3).agg(F.round(F.sum(1 / (i * i)), 9).alias("s"), F.round(F.product(1 + 1 / (i * i)), 9).alias("p"))


@query("g006_transform_reduce", "SELECT round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 0) AS v FROM lineitem")
def _(t):
    return t.lineitem.agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))), 0).alias("v"))


@query("g007_chunked_reduction", "SELECT l_returnflag, round(sum(s), 2) AS v, CAST(count(*) AS BIGINT) AS chunks FROM (SELECT l_returnflag, l_orderkey // 64 AS chunk, sum(l_quantity) AS s FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def _(t):
    part = t.lineitem.groupBy("l_returnflag", F.floor(F.col("l_orderkey") / 64).alias("chunk")).agg(F.sum("l_quantity").alias("s"))
    return part.groupBy("l_returnflag").agg(R(F.sum("s"), 2).alias("v"), F.count(F.lit(1)).alias("chunks"))


@query("g008_distinct_counts", "SELECT c_mktsegment, count(DISTINCT c_nationkey) AS n, count(*) FILTER (c_acctbal <> 0) AS nonzero FROM customer GROUP BY ALL")
def _(t):
    return t.customer.groupBy("c_mktsegment").agg(F.count_distinct("c_nationkey").alias("n"), F.count_if(F.col("c_acctbal") != 0).alias("nonzero"))


@query("g010_coverage_rate", "SELECT event_type, count(*) AS n, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM events GROUP BY ALL")
def _(t):
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), R(F.avg((F.col("value") > 50).cast("double")), 6).alias("rate"))


@query("g011_status_lattice", "SELECT o_custkey, CASE min(CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END) WHEN 0 THEN 'UNRESOLVED' WHEN 1 THEN 'PARTIAL' ELSE 'VERIFIED' END AS status FROM orders GROUP BY o_custkey")
def _(t):
    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return t.orders.groupBy("o_custkey").agg(F.element_at(F.array(F.lit("UNRESOLVED"), F.lit("PARTIAL"), F.lit("VERIFIED")), F.min(rank) + 1).alias("status"))


@query("g012_claim_combination", "SELECT o_custkey, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN max(o_orderpriority) ELSE 'MIXED' END AS claim FROM orders GROUP BY o_custkey")
def _(t):
    return t.orders.groupBy("o_custkey").agg(L.resolve_claims("o_orderpriority").alias("claim"))


@query("x013_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _(t):
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
