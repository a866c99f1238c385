"""Alias chains, control flow and traces of programs, laid over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from numera.operators import chains
from numera.plans.catalog import query

R = lambda c, d=6: F.round(c, d)


@query(
    "a026_alias_chains",
    """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, row_number() OVER w AS i, count(*) OVER (PARTITION BY o_custkey) AS n, max(o_orderkey) OVER (PARTITION BY o_custkey) AS last FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT 'order:' || k AS name, CASE c % 4 WHEN 0 THEN 'customer:' || c WHEN 1 THEN 'missing:' || c WHEN 3 THEN 'order:' || last END AS "end",
 CASE WHEN c % 4 < 2 THEN n - i + 1 WHEN c % 4 = 3 THEN n - i WHEN c % 8 = 6 AND n > 1 AND i = 1 THEN NULL ELSE 0 END AS hops,
 CASE c % 4 WHEN 0 THEN 'RESOLVED' WHEN 1 THEN 'DANGLING' WHEN 2 THEN 'CYCLE' ELSE 'AMBIGUOUS' END AS status FROM o""",
)
def _(t):
    """Every order is an alias of its customer's next one; the last one names the customer, nothing, an earlier order, or two things."""
    w, every = Window.partitionBy("o_custkey").orderBy("o_orderkey"), Window.partitionBy("o_custkey")
    order = lambda c: F.concat(F.lit("order:"), c)
    named = lambda s: F.concat(F.lit(s), F.col("o_custkey"))
    o = t.orders.select("o_orderkey", "o_custkey", F.lead("o_orderkey").over(w).alias("next"), F.min("o_orderkey").over(every).alias("first"), F.row_number().over(w).alias("i"))
    second = t.orders.select("o_orderkey", "o_custkey", F.row_number().over(w).alias("i")).where("i = 2").select("o_custkey", F.col("o_orderkey").alias("second"))
    o = o.join(second, "o_custkey", "left")
    kind = F.col("o_custkey") % 4
    back = F.when(F.col("o_custkey") % 8 == 6, F.coalesce("second", "first")).otherwise(F.col("first"))
    last = F.when(kind == 0, F.array(named("customer:"))).when(kind == 1, F.array(named("missing:"))).when(kind == 2, F.array(order(back))).otherwise(F.array(named("customer:"), named("missing:")))
    aliases = o.select(order(F.col("o_orderkey")).alias("name"), F.explode(F.when(F.col("next").isNotNull(), F.array(order(F.col("next")))).otherwise(last)).alias("target"))
    known = t.customer.select(F.concat(F.lit("customer:"), F.col("c_custkey")).alias("name"))
    return chains.resolve_aliases(aliases, known)


_BLOCKS = """b AS (SELECT l_orderkey AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n, l_returnflag AS flag, l_suppkey % 3 AS v FROM lineitem),
 e AS (SELECT f, i AS src, i + 1 AS dst FROM b WHERE i < n UNION SELECT f, i, i + 2 FROM b WHERE flag = 'R' AND i + 2 <= n UNION SELECT f, i, greatest(i - 1, 1) FROM b WHERE flag = 'A')"""


def _blocks(t):
    """Every order as a function: its lines are blocks in their order, some skip one ahead, some loop back."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    b = t.lineitem.select(F.col("l_orderkey").alias("f"), F.row_number().over(w).cast("long").alias("i"), F.count(F.lit(1)).over(Window.partitionBy("l_orderkey")).alias("n"), F.col("l_returnflag").alias("flag"), (F.col("l_suppkey") % 3).alias("v"))
    i = F.col("i")
    ends = F.array(F.when(i < F.col("n"), i + 1), F.when((F.col("flag") == "R") & (i + 2 <= F.col("n")), i + 2), F.when(F.col("flag") == "A", F.greatest(i - 1, F.lit(1))))
    return b, b.select("f", i.alias("src"), F.explode(F.array_distinct(F.filter(ends, lambda x: x.isNotNull()))).alias("dst"))


@query(
    "a004_dominators",
    f"""WITH RECURSIVE {_BLOCKS}, r(f, i) AS (SELECT DISTINCT f, CAST(1 AS BIGINT) FROM b UNION SELECT e.f, e.dst FROM r JOIN e ON e.f = r.f AND e.src = r.i),
 q(f, d, i) AS (SELECT f, i, CAST(1 AS BIGINT) FROM r WHERE i > 1 UNION SELECT q.f, q.d, e.dst FROM q JOIN e ON e.f = q.f AND e.src = q.i AND e.dst <> q.d),
 m AS (SELECT x.f, x.i, y.i AS d FROM r x JOIN r y ON y.f = x.f ANTI JOIN q ON q.f = x.f AND q.i = x.i AND q.d = y.i), c AS (SELECT f, i, count(*) AS n FROM m GROUP BY f, i)
SELECT m.f AS function, m.i AS block, m.d AS dominator, a.n = c.n - 1 AS immediate FROM m JOIN c ON c.f = m.f AND c.i = m.i JOIN c a ON a.f = m.f AND a.i = m.d""",
)
def _(t):
    b, e = _blocks(t)
    blocks = b.select(F.col("f").alias("function"), F.col("i").alias("block"), (F.col("i") == 1).alias("entry"))
    return chains.dominators(blocks, e.withColumnRenamed("f", "function"))


@query(
    "a004_reaching_definitions",
    f"""WITH RECURSIVE {_BLOCKS}, r(f, i, d, v) AS (SELECT e.f, e.dst, b.i, b.v FROM e JOIN b ON b.f = e.f AND b.i = e.src
 UNION SELECT e.f, e.dst, r.d, r.v FROM r JOIN b ON b.f = r.f AND b.i = r.i AND b.v <> r.v JOIN e ON e.f = r.f AND e.src = r.i) SELECT DISTINCT f AS function, i AS block, d AS definition FROM r""",
)
def _(t):
    b, e = _blocks(t)
    defs = b.select(F.col("f").alias("function"), F.col("i").alias("block"), F.col("i").alias("definition"), F.col("v").alias("variable"))
    return chains.reaching_definitions(e.withColumnRenamed("f", "function"), defs)


_RUNS = """x AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS step, count(*) OVER (PARTITION BY l_orderkey) AS n, l_extendedprice AS v, l_tax = 0.08 AND l_returnflag = 'R' AS off FROM lineitem),
 y AS (SELECT k, step, v, off OR (k % 50 = 0 AND step = n - 1) AS differs, CASE WHEN k % 50 = 0 AND step = n - 1 THEN NULL WHEN off THEN v + 1 ELSE v END AS w FROM x),
 d AS (SELECT k, min(step) AS step FROM y WHERE differs GROUP BY k)"""


def _runs(t):
    """Two runs of every order's lines: some values of the second are off by one, some runs stop a step early."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    x = t.lineitem.select("l_orderkey", (F.row_number().over(w) - 1).cast("long").alias("step"), F.count(F.lit(1)).over(Window.partitionBy("l_orderkey")).alias("n"), F.col("l_extendedprice").alias("v"), ((F.col("l_tax") == 0.08) & (F.col("l_returnflag") == "R")).alias("off"))
    second = x.where(~((F.col("l_orderkey") % 50 == 0) & (F.col("step") == F.col("n") - 1))).withColumn("v", F.when(F.col("off"), F.col("v") + 1).otherwise(F.col("v")))
    return x.select("l_orderkey", "step", "v"), second.select("l_orderkey", "step", "v")


@query("n057_trace_divergence", f"WITH {_RUNS} SELECT y.k AS l_orderkey, y.step, y.v AS expected, y.w AS actual FROM d JOIN y ON y.k = d.k AND y.step = d.step")
def _(t):
    a, b = _runs(t)
    return chains.first_divergence(a, b, "l_orderkey", "step", "v")


@query(
    "n058_divergence_roots",
    f"""WITH {_RUNS}, o AS (SELECT o_custkey AS c, 'order:' || k AS id FROM d JOIN orders ON o_orderkey = k),
 c AS (SELECT c_custkey AS c, c_nationkey AS n, 'customer:' || c_custkey AS id, min(o.id) AS root FROM customer LEFT JOIN o ON o.c = c_custkey GROUP BY ALL HAVING min(o.id) IS NOT NULL OR c_custkey % 10 = 0),
 n AS (SELECT 'nation:' || n AS id, min(CASE WHEN root IS NULL THEN id END) AS near, min(root) AS far FROM c GROUP BY n)
SELECT id, id AS root, 0 AS distance FROM o UNION ALL SELECT id, coalesce(root, id), CASE WHEN root IS NULL THEN 0 ELSE 1 END FROM c UNION ALL SELECT id, coalesce(near, far), CASE WHEN near IS NULL THEN 2 ELSE 1 END FROM n""",
)
def _(t):
    """Divergent orders, customers (of such an order, or by themselves) and nations, grouped by where the divergence comes from."""
    tag = lambda s, c: F.concat(F.lit(s), F.col(c))
    o = t.orders.join(chains.first_divergence(*_runs(t), "l_orderkey", "step", "v"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    c = t.customer.join(o.select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("hit", F.lit(True)), "c_custkey", "left").where("hit or c_custkey % 10 = 0")
    bad = o.select(tag("order:", "o_orderkey").alias("id")).union(c.select(tag("customer:", "c_custkey"))).union(c.select(tag("nation:", "c_nationkey")).distinct())
    lineage = t.orders.select(tag("order:", "o_orderkey").alias("src"), tag("customer:", "o_custkey").alias("dst")).union(t.customer.select(tag("customer:", "c_custkey"), tag("nation:", "c_nationkey")))
    return chains.divergence_roots(bad, lineage)


@query(
    "a003_backward_slice",
    """WITH RECURSIVE b AS (SELECT l_orderkey AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, l_suppkey % 5 AS w, l_partkey % 5 AS r, l_returnflag = 'A' AS alias FROM lineitem),
 u AS (SELECT f, w AS x, r AS y FROM b WHERE alias AND w <> r UNION SELECT f, r, w FROM b WHERE alias AND w <> r),
 c(f, x, y) AS (SELECT f, x, x FROM u UNION SELECT c.f, c.x, u.y FROM c JOIN u ON u.f = c.f AND u.x = c.y), m AS (SELECT f, x, min(y) AS g FROM c GROUP BY f, x),
 s AS (SELECT b.f, b.i, coalesce(m.g + 100, b.w) AS v FROM b LEFT JOIN m ON m.f = b.f AND m.x = b.w),
 d AS (SELECT b.f, b.i AS j, coalesce(m.g + 100, b.r) AS v FROM b LEFT JOIN m ON m.f = b.f AND m.x = b.r UNION SELECT DISTINCT b.f, 1000000, coalesce(m.g + 100, 0) FROM b LEFT JOIN m ON m.f = b.f AND m.x = 0),
 e AS (SELECT d.f, d.j, s.i FROM d JOIN s ON s.f = d.f AND s.v = d.v AND s.i < d.j QUALIFY d.v >= 100 OR s.i = max(s.i) OVER (PARTITION BY d.f, d.j, d.v)),
 k(f, i) AS (SELECT f, i FROM e WHERE j = 1000000 UNION SELECT e.f, e.i FROM k JOIN e ON e.f = k.f AND e.j = k.i) SELECT f AS function, i AS pos FROM k""",
)
def _(t):
    """Every order as straight-line code: each line sets one of five names from another, some make both the same object; what name 0 depends on at the end."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    b = t.lineitem.select(F.col("l_orderkey").alias("function"), F.row_number().over(w).cast("long").alias("pos"), (F.col("l_suppkey") % 5).alias("w"), (F.col("l_partkey") % 5).alias("r"), (F.col("l_returnflag") == "A").alias("alias"))
    named = lambda c: b.select("function", "pos", F.col(c).alias("name"))
    aliases = b.where("alias").select("function", F.col("w").alias("name"), F.col("r").alias("other"))
    return chains.backward_slice(named("w"), named("r"), aliases, b.select("function").distinct().withColumn("name", F.lit(0).cast("long")))
