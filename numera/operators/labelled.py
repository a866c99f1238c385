"""Alignment, selection and reduction of labelled data in long form.

A labelled array is a DataFrame with one column per dimension and one value
column.  An answer the inputs do not justify is one row of status UNRESOLVED,
never a guess.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from numera.operators.graph import checkpoint

HOW = {"INNER": "inner", "OUTER": "full_outer", "LEFT": "left", "RIGHT": "right"}


def align(left: DataFrame, right: DataFrame, on: Sequence[str], value: str = "v", how: str = "INNER") -> DataFrame:
    """(on..., left, right): both values on common labels."""
    a = left.select(*on, F.col(value).alias("left"))
    b = right.select(*on, F.col(value).alias("right"))
    return a.join(b, list(on), HOW[how])


def align_exact(left: DataFrame, right: DataFrame, label: str, pos: str, value: str = "v") -> DataFrame:
    """(label, left, right) if the ordered label lists are identical, else one UNRESOLVED row; ``status`` says which."""
    a = left.select(F.col(pos).alias("p"), F.col(label).alias("la"), F.col(value).alias("left"))
    b = right.select(F.col(pos).alias("p"), F.col(label).alias("lb"), F.col(value).alias("right"))
    both = a.join(b, "p", "full_outer")
    same = both.agg(F.coalesce(F.bool_and(F.coalesce(F.col("la") == F.col("lb"), F.lit(False))), F.lit(True)).alias("same"))
    found = both.crossJoin(F.broadcast(same))  # one row
    rows = found.where("same").select(F.col("la").alias(label), "left", "right", F.lit("EXACT").alias("status"))
    none = same.where("not same").select(*(F.lit(None).cast(t).alias(n) for n, t in rows.dtypes[:3]), F.lit("UNRESOLVED").alias("status"))
    return rows.unionByName(none)


def combine(left: DataFrame, right: DataFrame, on: Sequence[str], f: Callable[[Column, Column], Column], value: str = "v") -> DataFrame:
    """Conditional fallback: both sides give f, one side gives its own value."""
    j = align(left, right, on, value, "OUTER")
    out = F.when(F.col("left").isNotNull() & F.col("right").isNotNull(), f(F.col("left"), F.col("right"))).otherwise(F.coalesce("left", "right"))
    return j.select(*on, out.alias(value))


def reduce(df: DataFrame, keep: Sequence[str], agg: Column, name: str = "v", keepdims: Sequence[str] = ()) -> DataFrame:
    """Reduce every dimension not in ``keep``; ``keepdims`` come back with length one."""
    out = df.groupBy(*keep).agg(agg.alias(name))
    return out.select(*keep, *(F.lit(0).alias(d) for d in keepdims), name)


def propagating_min(v: Column) -> Column:
    """Minimum that NaN wins."""
    return F.when(F.bool_or(F.isnan(v)), F.lit(float("nan"))).otherwise(F.min(v))


def segmented_min(df: DataFrame, offsets: DataFrame, pos: str, value: str, offset: str) -> DataFrame:
    """(seg, v): minimum of each segment that starts at an offset and ends before the next.

    ``offsets`` (seg, offset): an empty or descending segment gives the element
    at its start.  Offsets are few and are matched by a range join.
    """
    w = Window.orderBy("seg")
    seg = offsets.select("seg", F.col(offset).alias("s"), F.lead(offset).over(w).alias("e"))
    seg = seg.withColumn("stop", F.when(F.col("e").isNull(), F.lit(2**62)).otherwise(F.greatest(F.col("e"), F.col("s") + 1)))
    return df.join(F.broadcast(seg), (F.col(pos) >= F.col("s")) & (F.col(pos) < F.col("stop"))).groupBy("seg").agg(F.min(value).alias("v"))


def numbered(df: DataFrame, keys: Sequence[Column], place: str = "place", parts: int | None = None) -> DataFrame:
    """``df`` with the 0-based place of every row in the ascending order of ``keys`` (unique together; nulls first).

    Rows are dealt to ``parts`` ranges (by default as many as shuffles have) and
    written in order to the shared folder; a row's place is its own in its range,
    moved on by the sizes of the ranges before, one row each.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpoint(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = dealt.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    placed = dealt.withColumn("__part", part).join(F.broadcast(before), "__part")
    return placed.select(*df.columns, (F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long").alias(place))


def interpolate(support: DataFrame, queries: DataFrame, x: str, y: str, q: str, by: Sequence[str] = (), kind: str = "linear", outside: str = "null") -> DataFrame:
    """(by..., q, y, relation): values at the points ``q`` between neighbours of ``support``; an approximation always.

    ``kind`` is linear, nearest, previous or next; ``outside`` is null or clamp.
    Neighbours come from one window pass over the union of both inputs.
    """
    both = support.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.lit(0).alias("is_q")).unionByName(
        queries.select(*by, F.col(q).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.lit(1).alias("is_q"))
    )
    w = Window.partitionBy(*by).orderBy("x", "is_q")
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    point = F.when(F.col("is_q") == 0, F.struct("x", "y"))
    f = both.withColumn("a", F.last(point, True).over(before)).withColumn("b", F.first(point, True).over(after)).where("is_q = 1")
    xa, ya, xb, yb = F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y")
    t = (F.col("x") - xa) / (xb - xa)
    inner = {
        "linear": F.when(xa == F.col("x"), ya).otherwise(ya + (yb - ya) * t),
        "nearest": F.when(F.col("x") - xa <= xb - F.col("x"), ya).otherwise(yb),
        "previous": ya,
        "next": F.when(xa == F.col("x"), ya).otherwise(yb),
    }[kind]
    value = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), inner).when(F.col("a").isNotNull() & (xa == F.col("x")), ya)
    if outside == "clamp":
        value = F.coalesce(value, ya, yb)
    return f.select(*by, F.col("x").alias(q), value.alias(y), F.lit("APPROXIMATION_OF").alias("relation"))


def difference(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, n: int = 1) -> DataFrame:
    """The n-th discrete difference along an order, without division by a spacing; the first n positions go."""
    w = Window.partitionBy(*by).orderBy(*order)
    out = df
    for _ in range(n):
        out = out.withColumn(value, F.col(value) - F.lag(value).over(w))
    return out.withColumn("__n", F.row_number().over(w)).where(F.col("__n") > n).drop("__n")


def gradient(value: str, by: Sequence[str], order: Sequence[str], h: float = 1.0) -> Column:
    """Central differences inside, one-sided at the ends."""
    w = Window.partitionBy(*by).orderBy(*order)
    a, b = F.lag(value).over(w), F.lead(value).over(w)
    v = F.col(value)
    return F.when(a.isNotNull() & b.isNotNull(), (b - a) / (2 * h)).when(b.isNotNull(), (b - v) / h).when(a.isNotNull(), (v - a) / h)


def contract(a: DataFrame, b: DataFrame, shared: Sequence[str], out: Sequence[str], va: str = "v", vb: str = "v") -> DataFrame:
    """Sum over the shared labels of products: an equi-join and a partially combined aggregate."""
    left = a.withColumnRenamed(va, "__a")
    right = b.withColumnRenamed(vb, "__b")
    return left.join(right, list(shared)).groupBy(*out).agg(F.sum(F.col("__a") * F.col("__b")).alias("v"))


def average_rank(value: str, by: Sequence[str] = ()) -> Column:
    """Rank with ties given their mean rank."""
    w = Window.partitionBy(*by).orderBy(value)
    same = Window.partitionBy(*by, value)
    return F.rank().over(w) + (F.count(F.lit(1)).over(same) - 1) / 2


def fold(df: DataFrame, by: Sequence[str], pos: Sequence[str], value: str, initial: float, f: Callable[[Column, Column], Column]) -> DataFrame:
    """Ordered left fold of each group, for functions that are not associative."""
    xs = F.array_sort(F.collect_list(F.struct(*pos, F.col(value).alias("__v"))))
    return df.groupBy(*by).agg(F.aggregate(F.transform(xs, lambda x: x["__v"]), F.lit(initial), f).alias("v"))


def resolve_claims(value: str) -> Column:
    """One value if all agree, else MIXED."""
    return F.when(F.count_distinct(value) == 1, F.max(value)).otherwise(F.lit("MIXED"))
