"""Facts about schemas, configuration, provenance and projects, as joins over node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Precedence of configuration sources, lowest first; later rows win ties.
PRECEDENCE = {"default": 0, "module": 5, "file": 10, "environment": 20, "cli": 30, "override": 40, "derived": 50}


def resolve_configuration(rows: DataFrame) -> DataFrame:
    """(name, value, source, overridden): the winning row of (name, value, source, sensitive, ord); secrets are hidden."""
    rank = F.create_map(*(x for k, v in PRECEDENCE.items() for x in (F.lit(k), F.lit(v))))
    w = Window.partitionBy("name").orderBy(F.desc("p"), F.desc("ord"))
    r = rows.withColumn("p", F.coalesce(rank[F.col("source")], F.lit(-1)))
    r = r.withColumn("k", F.row_number().over(w)).withColumn("overridden", F.count(F.lit(1)).over(Window.partitionBy("name")) - 1)
    secret = F.bool_or("sensitive").over(Window.partitionBy("name"))
    return r.withColumn("hide", secret).where("k = 1").select("name", F.when(F.col("hide"), F.lit("<redacted>")).otherwise(F.col("value")).alias("value"), "source", "overridden")


def schema_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(field, change) between two schemas (field, dtype, shape, dims, unit, missing, encoding)."""
    b = before.select("field", *(F.col(c).alias(f"b_{c}") for c in before.columns if c != "field"), F.lit(True).alias("in_b"))
    a = after.select("field", *(F.col(c).alias(f"a_{c}") for c in after.columns if c != "field"), F.lit(True).alias("in_a"))
    j = b.join(a, "field", "full_outer")
    differs = lambda c: ~F.col(f"b_{c}").eqNullSafe(F.col(f"a_{c}"))
    same_set = F.array_sort("b_dims").eqNullSafe(F.array_sort("a_dims"))
    changes = F.array(
        F.when(F.col("in_a").isNull(), "FIELD_MISSING"),
        F.when(F.col("in_b").isNull(), "FIELD_ADDED"),
        *(
            F.when(F.col("in_a") & F.col("in_b") & c, n)
            for n, c in (
                ("DTYPE_CHANGED", differs("dtype")), ("SHAPE_CHANGED", differs("shape")), ("DIMENSION_CHANGED", differs("dims") & ~same_set), ("DIMENSION_ORDER_CHANGED", differs("dims") & same_set),
                ("UNIT_CHANGED", differs("unit")), ("MISSING_VALUE_SEMANTICS_CHANGED", differs("missing")), ("SERIALIZATION_ENCODING_CHANGED", differs("encoding")),
            )
        ),
    )
    return j.select("field", F.explode(F.array_compact(changes)).alias("change"))


def query_facts(facts: DataFrame, expected: DataFrame) -> DataFrame:
    """(subject, predicate, status) of asked (subject, predicate, expected) against facts (subject, predicate, value)."""
    known = facts.groupBy("subject", "predicate").agg(F.count_distinct("value").alias("n"), F.max("value").alias("value"))
    j = expected.join(known, ["subject", "predicate"], "left")
    status = F.when(F.col("n").isNull(), "UNRESOLVED").when(F.col("n") > 1, "CONFLICT").when(F.col("value") == F.col("expected"), "PROVEN_TRUE").otherwise("PROVEN_FALSE")
    return j.select("subject", "predicate", status.alias("status"))


def path_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(path, left, right) where two flattened trees (path, value) differ."""
    a, b = left.select("path", F.col("value").alias("left")), right.select("path", F.col("value").alias("right"))
    return a.join(b, "path", "full_outer").where(~F.col("left").eqNullSafe(F.col("right")))


def shared_causes(deps: DataFrame) -> DataFrame:
    """(cause, roots): dependencies (root, cause) that several roots have in common."""
    return deps.groupBy("cause").agg(F.count_distinct("root").alias("roots")).where("roots > 1")


def version_at_least(version: Column, least: Column) -> Column:
    """Whether a dotted version is at least another, part by part as numbers."""
    parts = lambda c: F.transform(F.split(c, r"\."), lambda x: x.cast("int"))
    return parts(version) >= parts(least)
