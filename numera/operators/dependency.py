"""Dependency graphs as tables: what is wrong with one, its illegal cycles, and the slice its outputs depend on.

Nodes have (id, semantic, effect, location), edges (edge_id, kind, source,
target, role, confidence), all strings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from numera.operators.graph import checkpoint, reachable, release

# fixed values: kinds of edges, codes, and what a node of a kind needs, with what is said where it lacks it
EDGE_KINDS = ("DEFINES", "READS", "WRITES", "VALUE_DEPENDS_ON", "INDEX_DEPENDS_ON", "CONDITION_DEPENDS_ON", "LOOP_BOUND_DEPENDS_ON", "PREVIOUS_ACCUMULATOR_VALUE", "CONTROL_GUARDS", "RESULT_OF")
OUTPUTS = ("Store", "Return")
RECURRENCE = "PREVIOUS_ACCUMULATOR_VALUE"
INVALID, CYCLE = "INVALID_DEPENDENCY_GRAPH", "UNSUPPORTED_DEPENDENCY_CYCLE"
UNRESOLVED, UNKNOWN = "UNRESOLVED_OUTPUT_DEPENDENCY", "NON_NUMERIC_DEPENDENCY_IN_AUDITED_SLICE"
ROLES = {
    "BinaryOperation": (("lhs", "rhs"), "binary node needs lhs and rhs"),
    "Comparison": (("lhs", "rhs"), "binary node needs lhs and rhs"),
    "Conditional": (("condition",), "Conditional needs condition dependency"),
    "Loop": (("index", "lower", "upper"), "Loop needs index, lower, and upper dependencies"),
}
STORE_KINDS = ("WRITES", "VALUE_DEPENDS_ON")
EXTRACTED, FAILED = "EXTRACTED", "EXPRESSION_EXTRACTION_FAILED"


def _ends(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges both of whose ends exist, and the others."""
    ids = nodes.select("id").where("id is not null").distinct()
    source, target = (ids.withColumnRenamed("id", c) for c in ("source", "target"))
    began = edges.join(source, "source", "left_semi").select(edges.columns)
    lost = edges.join(source, "source", "left_anti").select(edges.columns).union(began.join(target, "target", "left_anti").select(edges.columns))
    return began.join(target, "target", "left_semi").select(edges.columns), lost


def diagnostics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(code, message, subject): every fault of the graph but its cycles.

    Nodes are shuffled once, edges once by each end and once by their id; a step
    is written before the next one, so no two steps' shuffles lie on disk at once.
    """
    spark = nodes.sparkSession
    said = lambda df, message, subject: df.select(F.lit(INVALID).alias("code"), F.lit(message).alias("message"), F.col(subject).alias("subject"))
    ids = checkpoint(nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.collect_set("semantic").alias("semantics")))
    release(spark)
    names = ids.where("id is not null").select("id", F.lit(True).alias("there"))
    began = checkpoint(edges.join(names.select(F.col("id").alias("source"), "there"), "source", "left").select("edge_id", "kind", "target", "role", F.col("there").isNotNull().alias("began")))
    release(spark)
    twice = checkpoint(edges.groupBy("edge_id").count().where("edge_id is null or count > 1").select("edge_id"))
    release(spark)
    own = lambda c: F.collect_set(F.when(F.col("began"), F.col(c)))
    given = began.where("target is not null").groupBy(F.col("target").alias("id")).agg(own("role").alias("roles"), own("kind").alias("kinds"))
    # every node, and every target that is none
    both = checkpoint(ids.join(given.withColumn("aim", F.lit(True)), "id", "full_outer"))
    release(spark, ids)
    missing = checkpoint(both.where("n is null").select(F.col("id").alias("target"), "aim"))
    lost = checkpoint(began.where("began").join(missing, "target", "left").where("aim or target is null").select("edge_id").union(began.where("not began").select("edge_id")))
    release(spark, began)
    has = both.where("n is not null and id is not null").select("id", F.explode("semantics").alias("semantic"), "roles", "kinds")
    has = has.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("roles", "kinds")})
    lacks = lambda c, wanted: reduce(lambda a, b: a | b, (~F.array_contains(c, w) for w in wanted))
    out = [
        said(both.where("n > 1 or (n is not null and id is null)"), "node IDs must be present and unique", "id"),
        said(twice, "edge IDs must be present and unique", "edge_id"),
        said(edges.where(~F.coalesce(F.col("kind").isin(*EDGE_KINDS), F.lit(False))), "unknown edge kind", "edge_id"),
        said(lost, "edge endpoint does not exist", "edge_id"),
        said(has.where((F.col("semantic") == "Store") & lacks("kinds", STORE_KINDS)), "Store needs write target and value", "id"),
    ]
    for semantic, (wanted, message) in ROLES.items():
        out.append(said(has.where((F.col("semantic") == semantic) & lacks("roles", wanted)), message, "id"))
    outputs = nodes.where(F.col("semantic").isin(*OUTPUTS))
    whole = outputs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.coalesce("location", F.lit("<return>"))).alias("places")).withColumn("subject", F.lit(None).cast("string"))
    out += [said(whole.where("n = 0"), "no Store or Return output node exists", "subject"), said(whole.where("places > 1"), "ambiguous output location", "subject")]
    return reduce(DataFrame.union, out)


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, root): the members of every strongly connected component of several vertices, or with a loop; root is its largest id.

    Vertices without edges in or out are trimmed first, round by round; then
    every vertex takes the largest id that reaches it, and those that reach that
    vertex back, among vertices of its colour, are a component and leave.
    """
    e, out = checkpoint(edges.select("source", "target").distinct()), None
    while True:
        n = e.count()
        inner = e.join(e.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(e.select(F.col("source").alias("target")).distinct(), "target", "left_semi")
        old, e = e, checkpoint(inner.select("source", "target"))
        release(e.sparkSession, old)
        left = e.count()
        if not left:
            break
        if left < n:
            continue
        colour = e.select(F.col("source").alias("id")).union(e.select("target")).distinct().withColumn("root", F.col("id"))
        while True:
            came = e.join(colour.withColumnRenamed("id", "source"), "source").groupBy(F.col("target").alias("id")).agg(F.max("root").alias("r"))
            new = checkpoint(colour.join(came, "id", "left").select("id", F.greatest("root", F.coalesce("r", "root")).alias("root"), (F.col("r") > F.col("root")).alias("up")))
            colour = new.select("id", "root")
            if new.where("up").isEmpty():
                break
        side = lambda c: colour.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root"))
        own = checkpoint(e.join(side("source"), "source").join(side("target"), "target").where("source_root = target_root").select(F.col("target").alias("src"), F.col("source").alias("dst")))
        back = checkpoint(reachable(own, colour.where("id = root").select("id")).join(colour, "id"))
        cyclic = own.join(back.withColumnRenamed("id", "src"), "src").join(back.select(F.col("id").alias("dst"), F.col("root").alias("r")), "dst").where("root = r").select("root").distinct()
        found = back.join(cyclic, "root", "left_semi").select("id", "root")
        out = found if out is None else out.union(found)
        e = checkpoint(e.join(back.select(F.col("id").alias("source")), "source", "left_anti").join(back.select(F.col("id").alias("target")), "target", "left_anti"))
    return out if out is not None else edges.select(F.col("source").alias("id"), F.col("source").alias("root")).limit(0)


def illegal_cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(code, members): components that neither a Loop node nor a recurrence edge explains."""
    known, _ = _ends(nodes, edges)
    member = checkpoint(strong_components(known))
    side = lambda c: member.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root"))
    recurs = known.where(F.col("kind") == RECURRENCE).join(side("source"), "source").join(side("target"), "target").where("source_root = target_root").select(F.col("source_root").alias("root"))
    loops = member.join(nodes.where("semantic = 'Loop'").select("id"), "id", "left_semi").select("root")
    bad = member.join(recurs.union(loops).distinct(), "root", "left_anti")
    return bad.groupBy("root").agg(F.sort_array(F.collect_set("id")).alias("members")).select(F.lit(CYCLE).alias("code"), "members")


def output_slice(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, unknown, unresolved): the nodes that outputs depend on, themselves included; whether the effect is unknown, and how many edges into it are unresolved."""
    outputs = nodes.where(F.col("semantic").isin(*OUTPUTS)).select("id")
    reached = reachable(edges.select(F.col("target").alias("src"), F.col("source").alias("dst")), outputs)
    open_ = edges.where("confidence != 'RESOLVED'").groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("unresolved"))
    own = nodes.select("id", (F.col("effect") == "Unknown").alias("unknown"))
    return reached.join(own, "id").join(open_, "id", "left").select("id", "unknown", F.coalesce("unresolved", F.lit(0)).cast("long").alias("unresolved"))


def checked_slice(nodes: DataFrame, edges: DataFrame) -> tuple[str, DataFrame, DataFrame]:
    """(status, sliced nodes, edges between them): nothing is sliced from a graph with a fault or an illegal cycle."""
    # cycles are looked for only in a graph without faults: either is the end of it
    if not diagnostics(nodes, edges).isEmpty() or not illegal_cycles(nodes, edges).isEmpty():
        return FAILED, output_slice(nodes.limit(0), edges.limit(0)), edges.limit(0)
    found = checkpoint(output_slice(nodes, edges))
    ends = lambda c: found.select(F.col("id").alias(c))
    return EXTRACTED, found, edges.join(ends("source"), "source", "left_semi").join(ends("target"), "target", "left_semi").select(edges.columns)


def slice_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (status, nodes, edges): how ``checked_slice`` ends, and the sizes of what it gives."""
    status, found, inner = checked_slice(nodes, edges)
    return found.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(inner.agg(F.count(F.lit(1)).alias("edges"))).select(F.lit(status).alias("status"), "nodes", "edges")  # one row each
