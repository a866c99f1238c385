"""Intervals, error budgets, units, probability, facts, lineage, graphs and geometry."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from numera.functions import errors, intervals, probability, trees, units
from numera.operators import geometry, graph, lineage
from numera.plans.catalog import query

R = lambda c, d=6: F.round(c, d)


# --- intervals ------------------------------------------------------------------------------------------


@query(
    "n018_n029_interval_arithmetic",
    """SELECT k, round(al + bl, 6) AS add_lo, round(ah + bh, 6) AS add_hi, round(al - bh, 6) AS sub_lo, round(ah - bl, 6) AS sub_hi, round(least(al*bl, al*bh, ah*bl, ah*bh), 4) AS mul_lo, round(greatest(al*bl, al*bh, ah*bl, ah*bh), 4) AS mul_hi,
     CASE WHEN bl <= 0 AND bh >= 0 THEN NULL ELSE round(least(al/nullif(bl,0), al/nullif(bh,0), ah/nullif(bl,0), ah/nullif(bh,0)), 4) END AS div_lo, CASE WHEN al <= 0 AND ah >= 0 THEN 0 ELSE round(least(al*al, ah*ah), 4) END AS sq_lo, round(greatest(al*al, ah*ah), 4) AS sq_hi,
     CASE WHEN al > 3 THEN 'ALWAYS_TRUE' WHEN ah <= 3 THEN 'ALWAYS_FALSE' ELSE 'SPLIT' END AS branch FROM (SELECT s_suppkey AS k, s_acctbal / 1037 - 2 AS al, s_acctbal / 1037 + 1 AS ah, s_nationkey / 5.3 - 2 AS bl, s_nationkey / 5.3 - 1.27 AS bh FROM supplier)""",
)
def _(t):
    v, n = F.col("s_acctbal") / 1037, F.col("s_nationkey") / F.lit(5.3)
    d = t.supplier.select(F.col("s_suppkey").alias("k"), intervals.interval(v - 2, v + 1).alias("a"), intervals.interval(n - 2, n - 1.27).alias("b"))
    a, b = F.col("a"), F.col("b")
    s, u, m, q, p = intervals.add(a, b), intervals.subtract(a, b), intervals.multiply(a, b), intervals.divide(a, b), intervals.power(a, 2)
    return d.select(
        "k", R(s["lo"]).alias("add_lo"), R(s["hi"]).alias("add_hi"), R(u["lo"]).alias("sub_lo"), R(u["hi"]).alias("sub_hi"), R(m["lo"], 4).alias("mul_lo"), R(m["hi"], 4).alias("mul_hi"),
        R(q["lo"], 4).alias("div_lo"), R(p["lo"], 4).alias("sq_lo"), R(p["hi"], 4).alias("sq_hi"), intervals.compare(a, ">", 3).alias("branch"),
    )


@query("n018_interval_functions", "SELECT k, round(exp(lo), 4) AS e_lo, CASE WHEN lo > 0 THEN round(ln(lo), 5) END AS l_lo, CASE WHEN lo >= 0 THEN round(sqrt(hi), 5) END AS s_hi, CASE WHEN hi >= 1.5707963267948966 AND lo <= 1.5707963267948966 THEN 1.0 ELSE round(greatest(sin(lo), sin(hi)), 5) END AS sin_hi, round(lo * 3, 5) AS sum_lo FROM (SELECT n_nationkey AS k, n_nationkey / 10.0 - 1 AS lo, n_nationkey / 10.0 - 0.5 AS hi FROM nation)")
def _(t):
    n = F.col("n_nationkey") / 10
    d = t.nation.select(F.col("n_nationkey").alias("k"), intervals.interval(n - 1, n - 0.5).alias("x"))
    x = F.col("x")
    return d.select("k", R(intervals.exp(x)["lo"], 4).alias("e_lo"), R(intervals.log(x)["lo"], 5).alias("l_lo"), R(intervals.sqrt(x)["hi"], 5).alias("s_hi"), R(intervals.sin(x)["hi"], 5).alias("sin_hi"), R(intervals.sum_bound(x, F.lit(3))["lo"], 5).alias("sum_lo"))


# --- error composition ----------------------------------------------------------------------------------


@query(
    "n030_n031_error_composition",
    "SELECT l_orderkey, round(sum(abs(l_discount - 0.05) * l_tax), 6) AS summed, round(sqrt(sum(l_tax * l_tax)), 6) AS rss, max(l_tax) AS worst, round(sum(l_tax) / count(*), 6) AS mean FROM lineitem GROUP BY l_orderkey",
)
def _(t):
    d = t.lineitem.withColumn("coef", F.col("l_discount") - 0.05)
    b = F.col("l_tax")
    s = errors.linear_sum(d, ["l_orderkey"], "l_linenumber", "coef", "l_tax").select("l_orderkey", R("bound").alias("summed"))
    g = d.groupBy("l_orderkey").agg(R(errors.rss(b, F.lit(True))).alias("rss"), errors.maximum(b).alias("worst"), R(errors.mean(b)).alias("mean"))
    return s.join(g, "l_orderkey")


@query(
    "n031_n032_error_rules",
    "SELECT s_suppkey AS k, round(abs(y)*bx + abs(x)*b_y + bx*b_y, 5) AS product, CASE WHEN abs(y) > b_y THEN round((abs(y)*bx + abs(x)*b_y) / (abs(y)*(abs(y)-b_y)), 6) END AS quotient, round(3 * pow(abs(x)+bx, 2) * bx, 4) AS cube, CASE WHEN CASE WHEN abs(y) > b_y THEN (abs(y)*bx + abs(x)*b_y) / (abs(y)*(abs(y)-b_y)) END IS NULL THEN 'UNRESOLVED' WHEN (abs(y)*bx + abs(x)*b_y) / (abs(y)*(abs(y)-b_y)) <= 0.5 THEN 'WITHIN_TOLERANCE' ELSE 'EXCEEDED' END AS budget FROM (SELECT s_suppkey, s_acctbal / 1037 AS x, 0.25 AS bx, s_nationkey / 10.0 - 1 AS y, 0.3 AS b_y FROM supplier)",
)
def _(t):
    x, y, bx, by = F.col("s_acctbal") / 1037, F.col("s_nationkey") / 10 - 1, F.lit(0.25), F.lit(0.3)
    q = errors.quotient(x, bx, y, by)
    return t.supplier.select(F.col("s_suppkey").alias("k"), R(errors.product(x, bx, y, by), 5).alias("product"), R(q).alias("quotient"), R(errors.power(x, bx, 3), 4).alias("cube"), errors.budget(q, F.lit(0.5)).alias("budget"))


# --- units, probability, numeric types ------------------------------------------------------------------


@query("n004_unit_conversion", "SELECT s_suppkey AS k, 'CONVERTED' AS status, round((s_acctbal + 459.67) * 5 / 9 - 273.15, 5) AS c FROM supplier UNION ALL SELECT s_suppkey, 'UNRESOLVED', NULL FROM supplier")
def _(t):
    d = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"), F.explode(F.array(F.lit("degC"), F.lit("kg"))).alias("to")).withColumn("frm", F.lit("degF"))
    return units.convert(d, "v", "frm", "to").select("k", "status", R("converted", 5).alias("c"))


@query("n019_monte_carlo", "SELECT event_type, count(value) AS n, round(avg(value), 5) AS mean, round(var_pop(value), 4) AS variance, round(1000 * sqrt(ln(2 / 0.05)) / sqrt(2.0 * count(value)), 6) AS epsilon, 'ENCLOSED_UNDER_ASSUMPTIONS' AS status FROM events GROUP BY event_type")
def _(t):
    m = probability.monte_carlo(t.events, ["event_type"], "value", 0, 1000)
    return m.select("event_type", "n", R("mean", 5).alias("mean"), R("variance", 4).alias("variance"), R("epsilon").alias("epsilon"), "status")


@query(
    "a022_distribution_audit",
    "SELECT event_type, n, round(max(greatest(abs(i / n - f), abs((i - 1) / n - f))), 6) AS distance FROM (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY value) * 1.0 AS i, count(*) OVER (PARTITION BY event_type) AS n, least(greatest(value / 100, 0), 1) AS f FROM events) GROUP BY 1, 2",
)
def _(t):
    f = F.least(F.greatest(F.col("value") / 100, F.lit(0.0)), F.lit(1.0))
    return probability.ecdf_distance(t.events, ["event_type"], "value", f).select("event_type", "n", R("distance").alias("distance"))


@query("n019_mass_validity", "SELECT c_mktsegment, abs(sum(p) - 1) <= 1e-9 AS valid FROM (SELECT c_mktsegment, n / sum(n) OVER (PARTITION BY c_mktsegment) AS p FROM (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY c_mktsegment, c_nationkey)) GROUP BY 1")
def _(t):
    c = t.customer.groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    p = c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("c_mktsegment")))
    return p.groupBy("c_mktsegment").agg(probability.mass_is_valid(F.col("p")).alias("valid"))


# --- facts, configuration, schemas --------------------------------------------------------------------------

_PARENT = [("field", "ring"), ("ring", "group"), ("group", "monoid"), ("monoid", "semigroup"), ("semigroup", "magma"), ("vector_space", "module"), ("module", "group")]


@query(
    "n006_structure_closure",
    "WITH RECURSIVE e(a, b) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _PARENT) + "), c(a, b) AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT a, b FROM c",
)
def _(t):
    t.spark.createDataFrame(_PARENT, "a string, b string").createOrReplaceTempView("structure_parents")
    return t.spark.sql("WITH RECURSIVE c(a, b) AS (SELECT a, b FROM structure_parents UNION ALL SELECT c.a, e.b FROM c JOIN structure_parents e ON c.b = e.a) SELECT DISTINCT a, b FROM c")


@query("n001_n005_query_facts", "SELECT CAST(p.p_partkey AS VARCHAR) AS subject, 'brand' AS predicate, CASE WHEN p_partkey % 10 = 0 THEN 'UNRESOLVED' WHEN p_partkey % 7 = 0 THEN 'CONFLICT' WHEN p_brand = 'Brand#11' THEN 'PROVEN_TRUE' ELSE 'PROVEN_FALSE' END AS status FROM part p")
def _(t):
    p = t.part.select(F.col("p_partkey").cast("string").alias("subject"), F.lit("brand").alias("predicate"), "p_partkey", "p_brand")
    facts = p.where("p_partkey % 10 != 0").select("subject", "predicate", F.col("p_brand").alias("value")).union(p.where("p_partkey % 7 = 0 and p_partkey % 10 != 0").select("subject", "predicate", F.lit("other")))
    return lineage.query_facts(facts, p.select("subject", "predicate", F.lit("Brand#11").alias("expected")))


@query("n053_resolve_configuration", "SELECT * FROM (VALUES ('alpha', '0.3', 'cli', 2), ('token', '<redacted>', 'environment', 0), ('beta', '2', 'file', 1)) v(name, value, source, overridden)")
def _(t):
    rows = [("alpha", "0.1", "default", False, 0), ("alpha", "0.2", "file", False, 1), ("alpha", "0.3", "cli", False, 2), ("token", "hush", "environment", True, 3), ("beta", "1", "file", False, 4), ("beta", "2", "file", False, 5)]
    return lineage.resolve_configuration(t.spark.createDataFrame(rows, "name string, value string, source string, sensitive boolean, ord int"))


_FIELDS = "field string, dtype string, shape array<int>, dims array<string>, unit string, missing string, encoding string"


@query("n054_schema_changes", "SELECT * FROM (VALUES ('quality', 'FIELD_ADDED'), ('gone', 'FIELD_MISSING'), ('yield', 'DTYPE_CHANGED'), ('yield', 'SHAPE_CHANGED'), ('yield', 'DIMENSION_ORDER_CHANGED'), ('yield', 'UNIT_CHANGED'), ('yield', 'MISSING_VALUE_SEMANTICS_CHANGED'), ('yield', 'SERIALIZATION_ENCODING_CHANGED')) v(field, change)")
def _(t):
    before = t.spark.createDataFrame([("yield", "float64", [10, 20], ["y", "x"], "kg", "nan", "raw"), ("gone", "int32", [1], ["x"], None, None, None)], _FIELDS)
    after = t.spark.createDataFrame([("yield", "float32", [20, 10], ["x", "y"], "t", "-9999", "zip"), ("quality", "int8", [1], ["x"], None, None, None)], _FIELDS)
    return lineage.schema_changes(before, after)


@query("n055_data_lineage", "SELECT DISTINCT 'part:' || l_partkey AS src, 'nation:' || s_nationkey AS dst FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def _(t):
    j = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.select(F.concat(F.lit("part:"), "l_partkey").alias("src"), F.concat(F.lit("nation:"), "s_nationkey").alias("dst")).distinct()


@query("n056_stable_ids", "SELECT c_custkey, 'cust:' || substr(sha256(c_name || '|' || c_nationkey), 1, 16) AS id FROM customer")
def _(t):
    h = F.sha2(F.concat_ws("|", "c_name", "c_nationkey"), 256)
    return t.customer.select("c_custkey", F.concat(F.lit("cust:"), F.substring(h, 1, 16)).alias("id"))


@query("n049_cache_verify", "SELECT p_partkey, true AS valid FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, false FROM part WHERE p_partkey % 3 = 0")
def _(t):
    key = F.sha2(F.to_json(F.struct("p_name", "p_size")), 256)
    stored = F.when(F.col("p_partkey") % 3 == 0, F.lit("stale")).otherwise(key)
    return t.part.select("p_partkey", (stored == key).alias("valid"))


@query("n048_w013_candidate_ranking", "SELECT p_brand, p_partkey, place FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM part) WHERE place <= 5")
def _(t):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return t.part.select("p_brand", "p_partkey", F.row_number().over(w).cast("long").alias("place")).where("place <= 5")


@query("n057_n058_first_divergence", "SELECT o_custkey, min(o_orderkey) FILTER (o_totalprice > 3e5) AS first_bad, count(*) FILTER (o_totalprice > 3e5) AS n FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_totalprice > 3e5) > 0")
def _(t):
    bad = t.orders.where("o_totalprice > 3e5")
    return bad.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_bad"), F.count(F.lit(1)).alias("n"))


@query("a024_shared_causes", "SELECT l_partkey AS cause, count(DISTINCT l_orderkey) AS roots FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 1")
def _(t):
    return lineage.shared_causes(t.lineitem.select(F.col("l_partkey").alias("cause"), F.col("l_orderkey").alias("root")))


@query("w015_w017_set_operations", "SELECT 'intersection' AS op, k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'difference', k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'union', k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier)")
def _(t):
    a, b = t.customer.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k"))
    named = lambda n, d: d.select(F.lit(n).alias("op"), "k")
    return named("intersection", a.intersect(b)).union(named("difference", a.subtract(b))).union(named("union", a.union(b).distinct()))


@query("n052_origin_sets", "SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority))) AS origins FROM orders GROUP BY o_custkey")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("origins"))


@query("a027_version_ranges", "SELECT v, r FROM (VALUES ('1.9.0', false), ('1.10.2', true), ('2.0', true), ('1.10', true)) x(v, r)")
def _(t):
    d = t.spark.createDataFrame([("1.9.0",), ("1.10.2",), ("2.0",), ("1.10",)], "v string")
    return d.select("v", lineage.version_at_least(F.col("v"), F.lit("1.10")).alias("r"))


# --- expression trees ------------------------------------------------------------------------------------------

_TEXTS = [(0, "a*b + 1.0"), (1, "1 + y*x"), (2, "x - x"), (3, "(p + q)/2"), (4, "sqrt(x)^2 + 0"), (5, "sin(x)*cos(x) - 3"), (6, "2 + x + 3")]


def _trees(t):
    return t.spark.createDataFrame([(i, json.dumps(trees.parse(s))) for i, s in _TEXTS], "id int, tree string")


@query("n007_n009_canonical_hash", "SELECT * FROM (VALUES (0, 2), (1, 2), (2, 1), (3, 1), (4, 1), (5, 1), (6, 1)) v(id, equal)")
def _(t):
    h = _trees(t).select("id", trees.udf(trees.semantic_hash)("tree").alias("h"))
    return h.select("id", F.count(F.lit(1)).over(Window.partitionBy("h")).alias("equal"))


@query("n010_render_tex")
def _(t):
    return _trees(t).select("id", trees.udf(trees.to_tex)("tree").alias("tex"))


@query("n043_exact_rewrites", "SELECT * FROM (VALUES (2, '{\"op\":\"Constant\",\"value\":0}'), (6, '{\"args\":[{\"name\":\"x\",\"op\":\"Symbol\"},{\"op\":\"Constant\",\"value\":5}],\"op\":\"Add\"}')) v(id, tree)")
def _(t):
    return _trees(t).where("id in (2, 6)").select("id", trees.udf(trees.simplify)("tree").alias("tree"))


@query("n011_n013_unify")
def _(t):
    """Each tree against the pattern ?a + ?b, and its least general pattern with the first tree."""
    first = trees.parse(_TEXTS[0][1])
    pattern = trees.call("Add", {"op": "Variable", "name": "a"}, {"op": "Variable", "name": "b"})
    return _trees(t).select("id", trees.udf(lambda x: trees.unify(pattern, x) or "MISMATCH")("tree").alias("bound"), trees.udf(lambda x: trees.anti_unify(first, x)[0])("tree").alias("general"))


@query("n033_evaluate_trees", "SELECT s_suppkey, round((s_acctbal - 3) / nullif(s_nationkey, 0) + sqrt(CASE WHEN s_acctbal >= 0 THEN s_acctbal END), 4) AS v FROM supplier")
def _(t):
    tree = trees.parse("(x - 3)/n + sqrt(x)")
    d = t.supplier.select("s_suppkey", F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("n"))
    return d.select("s_suppkey", R(trees.to_column(tree), 4).alias("v"))


@query("k267_autodiff_boundary", "SELECT s_suppkey, round(2 * x * sin(x) + x * x * cos(x), 5) AS d FROM (SELECT s_suppkey, s_nationkey / 10.0 AS x FROM supplier)")
def _(t):
    d = trees.derivative(trees.parse("x^2 * sin(x)"), "x")
    return t.supplier.select("s_suppkey", (F.col("s_nationkey") / 10).alias("x")).select("s_suppkey", R(trees.to_column(d), 5).alias("d"))


@query("n051_semantic_diff", "SELECT '$.args[1].value' AS path, '2' AS \"left\", '3' AS \"right\"")
def _(t):
    a, b = (t.spark.createDataFrame(trees.flatten(trees.parse(s)), "path string, value string") for s in ("x + 2", "x + 3"))
    return lineage.path_diff(a, b)


# --- graphs ------------------------------------------------------------------------------------------------------

_EDGES = "e AS (SELECT DISTINCT l_orderkey AS a, 1000000000 + l_partkey AS b FROM lineitem), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e)"


def _order_part(t):
    e = t.lineitem.select(F.col("l_orderkey").alias("src"), (F.lit(1000000000) + F.col("l_partkey")).alias("dst"))
    return e.select(F.col("src").alias("id")).union(e.select("dst")).distinct(), e


@query(
    "k230_connected_components",
    f"""WITH RECURSIVE {_EDGES}, c(id, component) USING KEY (id) AS (SELECT DISTINCT a, a FROM u
 UNION SELECT u.b, min(c.component) FROM c JOIN u ON u.a = c.id JOIN recurring.c r ON r.id = u.b WHERE c.component < r.component GROUP BY u.b) SELECT id, component FROM c""",
)
def _(t):
    return graph.components(*_order_part(t))


@query(
    "k231_shortest_paths",
    "WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b, 1.0 + n_nationkey % 4 AS w FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 5) % 25, 2.5 FROM nation), r(id, d, k) AS (SELECT 0, CAST(0.0 AS DOUBLE), 0 UNION SELECT e.b, r.d + CAST(e.w AS DOUBLE), r.k + 1 FROM r JOIN e ON e.a = r.id WHERE r.k < 12 AND r.d < 30) SELECT id, min(d) AS dist FROM r GROUP BY id",
)
def _(t):
    n = F.col("n_nationkey")
    e = t.nation.select(n.cast("long").alias("src"), ((n * 7 + 3) % 25).cast("long").alias("dst"), (1.0 + n % 4).alias("w")).union(t.nation.select(n.cast("long"), ((n + 5) % 25).cast("long"), F.lit(2.5)))
    return graph.shortest_paths(e, 0).select("id", "dist")


@query("a030_reachability", f"WITH RECURSIVE {_EDGES}, r(id) AS (SELECT min(a) FROM e UNION SELECT u.b FROM r JOIN u ON u.a = r.id) SELECT id FROM r")
def _(t):
    _, e = _order_part(t)
    return graph.reachable(graph.undirected(e), e.agg(F.min("src").alias("id")))


_PT = "p AS (SELECT s_suppkey AS id, s_acctbal / 100 AS x, s_nationkey * 4.0 AS y FROM supplier)"


def _points(t):
    return t.supplier.select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 100).alias("x"), (F.col("s_nationkey") * 4.0).alias("y"))


@query("k228_k229_radius_pairs", f"WITH {_PT} SELECT a.id AS q, b.id AS id, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 5) AS dist FROM p a JOIN p b ON a.id < b.id AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 6")
def _(t):
    p = _points(t)
    return graph.grid_neighbours(p, p, 6.0).where("q < id").select("q", "id", R("dist", 5).alias("dist"))


@query("k226_k227_nearest_neighbours", f"WITH {_PT} SELECT q, id, place FROM (SELECT a.id AS q, b.id AS id, row_number() OVER (PARTITION BY a.id ORDER BY sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.id) AS place FROM p a, p b) WHERE place <= 3")
def _(t):
    p = _points(t)
    return graph.nearest(p, p, 3, 5.0).select("q", "id", F.col("rank").cast("long").alias("place"))


@query("k232_feature_labelling")
def _(t):
    """Connected true cells of a 25 x 12 grid, four neighbours each."""
    g = t.spark.range(300).select("id", F.floor(F.col("id") / 12).alias("i"), (F.col("id") % 12).alias("j")).where("(i * 7 + j * 5) % 3 != 0")
    right = g.select(F.col("id").alias("src"), "i", (F.col("j") + 1).alias("j")).join(g.withColumnRenamed("id", "dst"), ["i", "j"]).select("src", "dst")
    below = g.select(F.col("id").alias("src"), (F.col("i") + 1).alias("i"), "j").join(g.withColumnRenamed("id", "dst"), ["i", "j"]).select("src", "dst")
    return graph.components(g.select("id"), right.union(below))


@query("k264_k265_single_link_clusters", f"WITH RECURSIVE {_PT}, u AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 4), r(id, c) AS (SELECT id, id FROM p UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.id) SELECT id, min(c) AS cluster FROM r GROUP BY id")
def _(t):
    # single linkage cut at a distance is the components of the pairs within it
    return graph.within(_points(t), 4.0)


# --- geometry ----------------------------------------------------------------------------------------------------


@query("k233_k245_contains", "SELECT s_suppkey AS id, (s_acctbal / 100 > 10 AND s_acctbal / 100 < 60 AND s_nationkey * 4.0 > 11 AND s_nationkey * 4.0 < 71) AS inside FROM supplier")
def _(t):
    ring = geometry.box(F.lit(10.0), F.lit(11.0), F.lit(60.0), F.lit(71.0))
    return _points(t).select("id", geometry.contains_xy(ring, F.col("x"), F.col("y")).alias("inside"))


@query("k234_k241_projection", "SELECT n_nationkey AS k, round(radians(lon) * 6378137.0, 3) AS x, round(ln(tan(radians(lat) / 2 + pi() / 4)) * 6378137.0, 3) AS y, 360 / 720.0 AS a, -180 / 360.0 AS e FROM (SELECT n_nationkey, n_nationkey * 10 - 120 AS lon, n_nationkey * 5 - 60 AS lat FROM nation)")
def _(t):
    lon, lat = F.col("n_nationkey") * 10.0 - 120, F.col("n_nationkey") * 5.0 - 60
    m = geometry.web_mercator(lon, lat)
    a = geometry.affine_from_bounds(F.lit(-180.0), F.lit(-90.0), F.lit(180.0), F.lit(90.0), 720, 360)
    return t.nation.select(F.col("n_nationkey").alias("k"), R(m["x"], 3).alias("x"), R(m["y"], 3).alias("y"), a["a"].alias("a"), a["e"].alias("e"))


@query("k237_k239_geodesic")
def _(t):
    """Inverse geodesics between successive points, and the length of the polyline they make."""
    w = Window.orderBy("n_nationkey")
    p = t.nation.select("n_nationkey", (F.col("n_nationkey") * 5.0 - 60).alias("lon"), (F.col("n_nationkey") * 3.0 - 30).alias("lat"))
    p = p.withColumn("lon2", F.lead("lon").over(w)).withColumn("lat2", F.lead("lat").over(w)).where("lon2 is not null")
    g = p.select("n_nationkey", geometry.geodesic_inverse()("lon", "lat", "lon2", "lat2").alias("g"))
    return g.select("n_nationkey", R("g.distance", 3).alias("distance"), R("g.forward").alias("forward")).withColumn("length", R(F.sum("distance").over(Window.partitionBy()), 3))


@query("k240_rasterize", "SELECT i, j, CASE WHEN i BETWEEN 5 AND 11 AND j BETWEEN 4 AND 9 THEN 2 WHEN i BETWEEN 2 AND 7 AND j BETWEEN 2 AND 12 THEN 1 ELSE 0 END AS v FROM (SELECT k // 16 AS i, k % 16 AS j FROM (SELECT unnest(range(0, 256)) AS k))")
def _(t):
    shapes = t.spark.createDataFrame([(1, 2.0, 2.0, 8.0, 13.0), (2, 5.0, 4.0, 12.0, 10.0)], "v int, i0 double, j0 double, i1 double, j1 double")
    g = t.spark.range(256).select(F.floor(F.col("id") / 16).alias("i"), (F.col("id") % 16).alias("j"))
    ring = geometry.box(F.col("i0"), F.col("j0"), F.col("i1"), F.col("j1"))
    # a fixed handful of shapes over cell centres; the last shape painted wins
    hit = g.join(F.broadcast(shapes), geometry.contains_xy(ring, F.col("i") + 0.5, F.col("j") + 0.5), "left")
    return hit.groupBy("i", "j").agg(F.coalesce(F.max("v"), F.lit(0)).alias("v"))


# --- random samples: only distributions are comparable -----------------------------------------------------------------


@query("k220_k224_random_samples", "SELECT true AS uniform_ok, true AS integer_ok, true AS normal_ok, 5000 AS n")
def _(t):
    r = t.spark.range(5000).select((2 + 3 * F.rand(7)).alias("u"), F.floor(F.rand(8) * 6).alias("d"), (1 + 2 * F.randn(9)).alias("z"))
    return r.agg((F.min("u") >= 2).__and__(F.max("u") < 5).__and__(F.abs(F.avg("u") - 3.5) < 0.1).alias("uniform_ok"), ((F.min("d") == 0) & (F.max("d") == 5)).alias("integer_ok"), ((F.abs(F.avg("z") - 1) < 0.2) & (F.abs(F.stddev("z") - 2) < 0.2)).alias("normal_ok"), F.count(F.lit(1)).cast("int").alias("n"))


@query("k222_k223_permutation_choice", "SELECT count(*) AS n, CAST(sum(place) AS BIGINT) AS total FROM (SELECT row_number() OVER () AS place FROM supplier)")
def _(t):
    p = t.supplier.select(F.row_number().over(Window.orderBy(F.rand(3))).alias("place"))
    return p.agg(F.count(F.lit(1)).alias("n"), F.sum("place").alias("total"))


# --- iterative algorithms -------------------------------------------------------------------------------------------------


@query("k262_initial_value_problem", "SELECT n_nationkey AS k, round(exp(-n_nationkey / 10.0), 5) AS y FROM nation")
def _(t):
    """y' = -rate * y from 1 over one time unit, by 200 Runge-Kutta steps in a fold; an approximation."""
    h = 1.0 / 200
    rate = F.col("n_nationkey") / 10

    def step(y, _):
        k1 = -rate * y
        k2 = -rate * (y + h / 2 * k1)
        k3 = -rate * (y + h / 2 * k2)
        k4 = -rate * (y + h * k3)
        return y + h / 6 * (k1 + 2 * k2 + 2 * k3 + k4)

    return t.nation.select(F.col("n_nationkey").alias("k"), R(F.aggregate(F.sequence(F.lit(1), F.lit(200)), F.lit(1.0), step), 5).alias("y"))


@query("k263_local_minimum", "SELECT round(regr_slope(l_extendedprice, l_quantity), 2) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 1) AS intercept FROM lineitem")
def _(t):
    """Least squares by Newton steps on one aggregate pass: the objective is quadratic, so one step reaches the minimum."""
    x, y = F.col("l_quantity"), F.col("l_extendedprice")
    m = t.lineitem.agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"))
    slope = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))
    return m.select(R(slope, 2).alias("slope"), R((F.col("sy") - slope * F.col("sx")) / F.col("n"), 1).alias("intercept"))
