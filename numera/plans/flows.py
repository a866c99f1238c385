"""Sources, sinks, streams and project analyses."""

from __future__ import annotations

import ast
import inspect

from pyspark.sql import functions as F

from numera.operators import dependency, graph, lineage
from numera.plans.catalog import query
from numera.sources import files
from numera.streaming import windows


def _folder(t) -> str:
    graph.checkpoint(t.spark.range(1))
    return t.spark.conf.get("spark.checkpoint.dir").rstrip("/")


@query("s001_s005_round_trips", "SELECT fmt, CAST(count(*) AS BIGINT) AS n, round(sum(s_acctbal), 2) AS total FROM supplier, (VALUES ('csv'), ('json'), ('orc'), ('parquet')) f(fmt) GROUP BY fmt")
def _(t):
    import uuid

    schema, at, out = "s_suppkey long, s_name string, s_acctbal double", f"{_folder(t)}/trip-{uuid.uuid4().hex}", None
    for kind in sorted(files.FORMATS):
        files.write_table(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), f"{at}/{kind}", kind)
        one = files.read_table(t.spark, f"{at}/{kind}", kind, schema).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("s_acctbal"), 2).alias("total")).withColumn("fmt", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


@query("s015_cache_lookup", "SELECT CAST(p_partkey AS VARCHAR) AS key, CASE WHEN p_partkey % 5 = 0 THEN 'MISS' WHEN p_partkey % 7 = 0 THEN 'CORRUPT' ELSE 'HIT' END AS status FROM part")
def _(t):
    key = F.col("p_partkey").cast("string")
    cache = t.part.where("p_partkey % 5 != 0").select(key.alias("key"), F.col("p_name").alias("payload"), F.when(F.col("p_partkey") % 7 == 0, F.lit("?")).otherwise(F.sha2("p_name", 256)).alias("digest"))
    return files.lookup(cache, t.part.select(key.alias("key"))).select("key", "status")


@query("s012_json_load", "SELECT event_id, CAST(json_extract_string(props, '$.' || json_keys(props)[1]) AS VARCHAR) AS v FROM events")
def _(t):
    m = F.from_json("props", "map<string,string>")
    k = F.regexp_extract("props", r'^\s*\{\s*"([^"]+)"', 1)
    return t.events.select("event_id", F.try_element_at(m, k).alias("v"))


@query("s008_python_nodes")
def _(t):
    """Operators of the syntax tree of this library's own expression module."""
    from numera.functions import trees

    tree = ast.parse(inspect.getsource(trees))
    rows = [(type(n).__name__,) for n in ast.walk(tree)]
    return t.spark.createDataFrame(rows, "op string").groupBy("op").agg(F.count(F.lit(1)).alias("n"))


@query("x212_tumbling_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL")
def _(t):
    d = windows.drain(windows.tumbling(windows.read_events(t.spark, t.sf_dir)))
    return d.withColumn("total", F.round("total", 3))


@query("x212_sliding_windows", "SELECT time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS start, count(*) AS n FROM events, (SELECT unnest(range(0, 4)) AS k) GROUP BY 1")
def _(t):
    return windows.sliding(t.events.withColumn("ts", F.col("ts").cast("timestamp")))


@query(
    "x212_sessions",
    "SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > ts - INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s",
)
def _(t):
    return windows.sessions(t.events.withColumn("ts", F.col("ts").cast("timestamp")))


@query("j012_edge_resolution", "SELECT c_custkey, n_name, CASE WHEN n_name IS NULL THEN 'UNRESOLVED' ELSE 'RESOLVED' END AS status FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey <> 3) ON c_nationkey = n_nationkey")
def _(t):
    exported = t.nation.where("n_nationkey != 3")
    j = t.customer.join(exported, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return j.select("c_custkey", "n_name", F.when(F.col("n_name").isNull(), "UNRESOLVED").otherwise("RESOLVED").alias("status"))


@query("a042_baseline_diff", "SELECT p_partkey AS k, 'CHANGED' AS status FROM part WHERE p_partkey % 11 = 0 UNION ALL SELECT p_partkey, 'ADDED' FROM part WHERE p_partkey % 13 = 0 AND p_partkey % 11 <> 0")
def _(t):
    now = t.part.select(F.col("p_partkey").cast("string").alias("path"), F.sha2("p_name", 256).alias("sha256"))
    was = t.part.where("p_partkey % 13 != 0 or p_partkey % 11 = 0").select(F.col("p_partkey").cast("string").alias("path"), F.when(F.col("p_partkey") % 11 == 0, F.lit("old")).otherwise(F.sha2("p_name", 256)).alias("sha256"))
    return files.verify(was, now).select(F.col("path").cast("long").alias("k"), "status")


@query("a044_candidate_inputs", "SELECT k, v FROM (SELECT s_suppkey AS k, unnest([s_acctbal, s_acctbal + 5, s_acctbal + 10]) AS v FROM supplier)")
def _(t):
    lo = F.col("s_acctbal")
    return t.supplier.select(F.col("s_suppkey").alias("k"), F.explode(F.array(lo, lo + 5, lo + 10)).alias("v"))


@query("a049_backend_agreement", "SELECT l_orderkey, count(DISTINCT l_suppkey % 2) = 1 AS agree, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def _(t):
    return t.lineitem.groupBy("l_orderkey").agg((F.count_distinct(F.col("l_suppkey") % 2) == 1).alias("agree"), F.count(F.lit(1)).alias("n"))


@query("a039_inverted_index", "SELECT w AS term, count(DISTINCT p_partkey) AS n FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS w FROM part) GROUP BY w")
def _(t):
    return t.part.select("p_partkey", F.explode(F.split(F.lower("p_name"), " ")).alias("term")).groupBy("term").agg(F.count_distinct("p_partkey").alias("n"))


@query("a040_profile_acceptance", "SELECT o_orderkey, profile, CASE profile WHEN 'STRICT' THEN o_orderstatus = 'F' WHEN 'RESEARCH' THEN o_orderstatus IN ('F', 'O') ELSE true END AS accepted FROM orders, (VALUES ('STRICT'), ('RESEARCH'), ('EXPLORATORY')) p(profile)")
def _(t):
    accepts = t.spark.createDataFrame([("STRICT", ["F"]), ("RESEARCH", ["F", "O"]), ("EXPLORATORY", ["F", "O", "P"])], "profile string, ok array<string>")
    # three profiles
    return t.orders.crossJoin(F.broadcast(accepts)).select("o_orderkey", "profile", F.array_contains("ok", F.col("o_orderstatus")).alias("accepted"))


@query("n026_coverage_classes", "SELECT l_orderkey, CASE WHEN count(*) = 1 THEN 'TRANSLATED' WHEN bool_and(l_discount = 0) THEN 'FOLD' WHEN bool_or(l_tax > 0.07) THEN 'OPAQUE' ELSE 'COMPOSED' END AS kind FROM lineitem GROUP BY l_orderkey")
def _(t):
    kind = F.when(F.count(F.lit(1)) == 1, "TRANSLATED").when(F.bool_and(F.col("l_discount") == 0), "FOLD").when(F.bool_or(F.col("l_tax") > 0.07), "OPAQUE").otherwise("COMPOSED")
    return t.lineitem.groupBy("l_orderkey").agg(kind.alias("kind"))


@query("n035_layer_claims", "SELECT o_orderkey, CASE least(CASE o_orderstatus WHEN 'P' THEN 0 ELSE 2 END, CASE WHEN o_totalprice > 3e5 THEN 1 ELSE 2 END) WHEN 0 THEN 'UNRESOLVED' WHEN 1 THEN 'PARTIAL' ELSE 'VERIFIED' END AS claim FROM orders")
def _(t):
    layers = F.least(F.when(F.col("o_orderstatus") == "P", 0).otherwise(2), F.when(F.col("o_totalprice") > 3e5, 1).otherwise(2))
    return t.orders.select("o_orderkey", F.element_at(F.array(F.lit("UNRESOLVED"), F.lit("PARTIAL"), F.lit("VERIFIED")), layers + 1).alias("claim"))


@query("n047_rotation_checks", "SELECT n_nationkey AS k, true AS orthogonal, true AS proper FROM nation")
def _(t):
    a = F.col("n_nationkey") / 4.0
    c, s = F.cos(a), F.sin(a)
    return t.nation.select(F.col("n_nationkey").alias("k"), (F.abs(c * c + s * s - 1) < 1e-12).alias("orthogonal"), (F.abs(c * c - s * -s - 1) < 1e-12).alias("proper"))


@query("n024_n046_assumptions", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'MISSING_ASSUMPTION' ELSE 'PROVEN' END AS status FROM part")
def _(t):
    required = F.array(F.lit("smooth"), F.lit("bounded"))
    given = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("smooth"))).otherwise(F.array(F.lit("bounded"), F.lit("smooth"), F.lit("extra")))
    return t.part.select("p_partkey", F.when(F.size(F.array_except(required, given)) == 0, "PROVEN").otherwise("MISSING_ASSUMPTION").alias("status"))


@query("w014_lexicographic_selection", "SELECT p_brand, first(p_partkey ORDER BY p_size, p_retailprice, p_partkey) AS pick FROM part GROUP BY p_brand")
def _(t):
    return t.part.groupBy("p_brand").agg(F.min_by("p_partkey", F.struct("p_size", "p_retailprice", "p_partkey")).alias("pick"))


@query("a004_incremental_plan", "WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 3 + 1) % 25 AS b FROM nation), r(id) AS (SELECT n_nationkey FROM nation WHERE n_nationkey % 9 = 0 UNION SELECT e.a FROM r JOIN e ON e.b = r.id) SELECT CAST(id AS BIGINT) AS id FROM r")
def _(t):
    n = F.col("n_nationkey")
    depends = t.nation.select(((n * 3 + 1) % 25).cast("long").alias("src"), n.cast("long").alias("dst"))
    return graph.reachable(depends, t.nation.where("n_nationkey % 9 = 0").select(n.cast("long").alias("id")))


@query("n022_relation_validation", "SELECT o_orderkey, o_totalprice > 0 AS valid FROM orders")
def _(t):
    f = t.orders.select(F.col("o_orderkey").cast("string").alias("subject"), F.lit("positive").alias("predicate"), (F.col("o_totalprice") > 0).cast("string").alias("value"))
    ask = f.select("subject", "predicate", F.lit("true").alias("expected"))
    return lineage.query_facts(f, ask).select(F.col("subject").cast("long").alias("o_orderkey"), (F.col("status") == "PROVEN_TRUE").alias("valid"))


_GRAPH = """nodes AS (
  SELECT 'o' || o_orderkey AS id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'Store' ELSE 'Value' END AS semantic, 'Pure' AS effect, o_orderstatus AS location FROM orders
  UNION ALL SELECT 'l' || l_orderkey || '.' || l_linenumber, 'BinaryOperation', CASE WHEN l_returnflag = 'R' THEN 'Unknown' ELSE 'Pure' END, NULL FROM lineitem
  UNION ALL SELECT 'p' || p_partkey, 'Load', 'Pure', NULL FROM part UNION ALL SELECT 's' || s_suppkey, 'Load', 'Pure', NULL FROM supplier),
 edges AS (
  SELECT 'v' || l_orderkey || '.' || l_linenumber AS edge_id, CASE WHEN l_linenumber = 1 THEN 'WRITES' ELSE 'VALUE_DEPENDS_ON' END AS kind, 'l' || l_orderkey || '.' || l_linenumber AS source,
    'o' || l_orderkey AS target, 'value' AS role, CASE WHEN l_linestatus = 'F' THEN 'RESOLVED' ELSE 'INFERRED' END AS confidence FROM lineitem
  UNION ALL SELECT 'a' || l_orderkey || '.' || l_linenumber, CASE WHEN l_discount > 0.09 THEN 'GUESSED' ELSE 'READS' END, 'p' || l_partkey, 'l' || l_orderkey || '.' || l_linenumber, 'lhs', 'RESOLVED' FROM lineitem
  UNION ALL SELECT 'b' || CASE WHEN l_quantity > 49 THEN l_orderkey || '' ELSE l_orderkey || '.' || l_linenumber END, 'READS', 's' || CASE WHEN l_tax > 0.07 THEN -l_suppkey ELSE l_suppkey END,
    'l' || l_orderkey || '.' || l_linenumber, 'rhs', 'RESOLVED' FROM lineitem)"""


def _graph(t):
    """Orders as outputs or values, lineitems as the operations on a part and a supplier that they are made of; some edges are at fault."""
    text = lambda *c: F.concat(*(F.col(x[1:]).cast("string") if x[0] == "$" else F.lit(x) for x in c))
    none = F.lit(None).cast("string")
    node = lambda df, i, semantic, effect, location: df.select(i.alias("id"), semantic.alias("semantic"), effect.alias("effect"), location.alias("location"))
    line, pure, load = text("l", "$l_orderkey", ".", "$l_linenumber"), F.lit("Pure"), F.lit("Load")
    nodes = (
        node(t.orders, text("o", "$o_orderkey"), F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("Store")).otherwise(F.lit("Value")), pure, F.col("o_orderstatus"))
        .union(node(t.lineitem, line, F.lit("BinaryOperation"), F.when(F.col("l_returnflag") == "R", F.lit("Unknown")).otherwise(pure), none))
        .union(node(t.part, text("p", "$p_partkey"), load, pure, none))
        .union(node(t.supplier, text("s", "$s_suppkey"), load, pure, none))
    )
    edge = lambda i, kind, source, target, role, sure: t.lineitem.select(*(c.alias(n) for c, n in zip((i, kind, source, target, role, sure), ("edge_id", "kind", "source", "target", "role", "confidence"))))
    resolved, reads = F.lit("RESOLVED"), F.lit("READS")
    b = F.when(F.col("l_quantity") > 49, text("b", "$l_orderkey")).otherwise(text("b", "$l_orderkey", ".", "$l_linenumber"))
    supplier = F.concat(F.lit("s"), F.when(F.col("l_tax") > 0.07, -F.col("l_suppkey")).otherwise(F.col("l_suppkey")).cast("string"))
    edges = (
        edge(text("v", "$l_orderkey", ".", "$l_linenumber"), F.when(F.col("l_linenumber") == 1, F.lit("WRITES")).otherwise(F.lit("VALUE_DEPENDS_ON")), line, text("o", "$l_orderkey"), F.lit("value"), F.when(F.col("l_linestatus") == "F", resolved).otherwise(F.lit("INFERRED")))
        .union(edge(text("a", "$l_orderkey", ".", "$l_linenumber"), F.when(F.col("l_discount") > 0.09, F.lit("GUESSED")).otherwise(reads), text("p", "$l_partkey"), line, F.lit("lhs"), resolved))
        .union(edge(b, reads, supplier, line, F.lit("rhs"), resolved))
    )
    return nodes, edges


@query(
    "a001_dependency_diagnostics",
    f"""WITH {_GRAPH},
 known AS (SELECT e.* FROM edges e WHERE source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes)),
 has AS (SELECT n.id, n.semantic, coalesce(list(k.role) FILTER (k.role IS NOT NULL), []) AS roles, coalesce(list(k.kind) FILTER (k.kind IS NOT NULL), []) AS kinds FROM nodes n LEFT JOIN known k ON k.target = n.id GROUP BY n.id, n.semantic)
SELECT 'INVALID_DEPENDENCY_GRAPH' AS code, message, subject FROM (
 SELECT 'node IDs must be present and unique' AS message, id AS subject FROM nodes GROUP BY id HAVING count(*) > 1
 UNION ALL SELECT 'edge IDs must be present and unique', edge_id FROM edges GROUP BY edge_id HAVING count(*) > 1
 UNION ALL SELECT 'unknown edge kind', edge_id FROM edges WHERE kind = 'GUESSED'
 UNION ALL SELECT 'edge endpoint does not exist', edge_id FROM edges WHERE source NOT IN (SELECT id FROM nodes) OR target NOT IN (SELECT id FROM nodes)
 UNION ALL SELECT 'Store needs write target and value', id FROM has WHERE semantic = 'Store' AND NOT (list_contains(kinds, 'WRITES') AND list_contains(kinds, 'VALUE_DEPENDS_ON'))
 UNION ALL SELECT 'binary node needs lhs and rhs', id FROM has WHERE semantic = 'BinaryOperation' AND NOT (list_contains(roles, 'lhs') AND list_contains(roles, 'rhs'))
 UNION ALL SELECT 'ambiguous output location', NULL FROM nodes WHERE semantic = 'Store' HAVING count(DISTINCT location) > 1)""",
)
def _(t):
    return dependency.diagnostics(*_graph(t))


@query(
    "a002_output_slice",
    f"""WITH RECURSIVE {_GRAPH},
 r(id) AS (SELECT id FROM nodes WHERE semantic = 'Store' UNION SELECT e.source FROM r JOIN edges e ON e.target = r.id)
SELECT n.id, n.effect = 'Unknown' AS unknown, CAST((SELECT count(*) FROM edges e WHERE e.target = n.id AND confidence <> 'RESOLVED') AS BIGINT) AS unresolved FROM nodes n WHERE n.id IN (SELECT id FROM r)""",
)
def _(t):
    return dependency.output_slice(*_graph(t))


_CYCLES = """o AS (SELECT o_custkey AS c, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders GROUP BY o_custkey),
 edges AS (SELECT 'o' || o_orderkey AS source, 'c' || o_custkey AS target, false AS recurs FROM orders UNION ALL SELECT 'c' || c, 'o' || lo, c % 3 = 1 FROM o UNION ALL SELECT 'o' || lo, 'o' || hi, false FROM o WHERE c % 2 = 0 AND lo < hi)"""


def _cycles(t):
    """Orders flow to their customer, who feeds back to the first of them, which on every other customer feeds the last; some feedback recurs, some customers are loops."""
    tag = lambda s, c: F.concat(F.lit(s), F.col(c).cast("string"))
    o = t.orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))
    edge = lambda df, a, b, kind: df.select(F.concat_ws(">", a, b).alias("edge_id"), kind.alias("kind"), a.alias("source"), b.alias("target"), F.lit("value").alias("role"), F.lit("RESOLVED").alias("confidence"))
    flows = F.lit("VALUE_DEPENDS_ON")
    edges = edge(t.orders, tag("o", "o_orderkey"), tag("c", "o_custkey"), flows)
    edges = edges.union(edge(o, tag("c", "o_custkey"), tag("o", "lo"), F.when(F.col("o_custkey") % 3 == 1, dependency.RECURRENCE).otherwise(flows)))
    edges = edges.union(edge(o.where("o_custkey % 2 = 0 and lo < hi"), tag("o", "lo"), tag("o", "hi"), flows))
    node = lambda df, i, semantic: df.select(i.alias("id"), semantic.alias("semantic"), F.lit("Pure").alias("effect"), F.lit(None).cast("string").alias("location"))
    nodes = node(t.orders, tag("o", "o_orderkey"), F.lit("Assignment")).union(node(o, tag("c", "o_custkey"), F.when(F.col("o_custkey") % 3 == 2, "Loop").otherwise("Accumulator")))
    return nodes, edges


@query(
    "a001_illegal_cycles",
    f"""WITH RECURSIVE {_CYCLES}, r(x, y) AS (SELECT source, target FROM edges UNION SELECT r.x, e.target FROM r JOIN edges e ON e.source = r.y),
 m AS (SELECT a.x, a.y FROM r a JOIN r b ON b.x = a.y AND b.y = a.x), g AS (SELECT x AS id, max(y) AS root FROM m GROUP BY x)
SELECT 'UNSUPPORTED_DEPENDENCY_CYCLE' AS code, list(id ORDER BY id) AS members FROM g GROUP BY root
HAVING NOT bool_or(id LIKE 'c%' AND CAST(substr(id, 2) AS BIGINT) % 3 = 2) AND NOT bool_or(EXISTS (FROM edges e JOIN g s ON s.id = e.source JOIN g t ON t.id = e.target WHERE e.recurs AND s.root = g.root AND t.root = g.root))""",
)
def _(t):
    return dependency.illegal_cycles(*_cycles(t))


@query(
    "a002_gated_slice",
    f"""WITH RECURSIVE {_GRAPH}, r(id) AS (SELECT id FROM nodes WHERE semantic = 'Store' UNION SELECT e.source FROM r JOIN edges e ON e.target = r.id) SELECT 'given' AS graph, 'EXPRESSION_EXTRACTION_FAILED' AS status, CAST(0 AS BIGINT) AS nodes, CAST(0 AS BIGINT) AS edges
UNION ALL SELECT 'customers', 'EXTRACTED', count(*) + count(DISTINCT o_custkey), 2 * count(*) FROM orders JOIN customer ON c_custkey = o_custkey""",
)
def _(t):
    """Outputs are sliced only from a graph without faults: the lineitem graph has some, sums of orders per customer have none."""
    tag = lambda s, c: F.concat(F.lit(s), F.col(c).cast("string"))
    o = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    node = lambda df, i, semantic: df.select(i.alias("id"), F.lit(semantic).alias("semantic"), F.lit("Pure").alias("effect"), F.lit("total").alias("location"))
    nodes = node(o, tag("o", "o_orderkey"), "Assignment").union(node(o.select("o_custkey").distinct(), tag("c", "o_custkey"), "Store"))
    edge = lambda kind: o.select(F.concat_ws(">", tag("o", "o_orderkey"), F.lit(kind)).alias("edge_id"), F.lit(kind).alias("kind"), tag("o", "o_orderkey").alias("source"), tag("c", "o_custkey").alias("target"), F.lit("value").alias("role"), F.lit("RESOLVED").alias("confidence"))
    said = lambda name, g: dependency.slice_summary(*g).select(F.lit(name).alias("graph"), "status", "nodes", "edges")
    return said("given", _graph(t)).unionByName(said("customers", (nodes, edge("WRITES").union(edge("VALUE_DEPENDS_ON")))))
