"""Ranges of variables in flow graphs with loops, and search for boxes of inputs in which two formulas differ."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from numera.functions import intervals as I
from numera.operators.graph import checkpoint, drop

INF = float("inf")
# fixed values: how a range or a region ends
RESOLVED, WIDENED, EMPTY = "RANGE_RESOLVED", "RANGE_WIDENED", "RANGE_EMPTY"
PROVEN, POSSIBLE = "FAILURE_REGION_PROVEN", "FAILURE_REGION_POSSIBLE"


def _moved(lo: Column, hi: Column) -> tuple[Column, Column]:
    """An edge's affine step, then its guard; null where nothing passes."""
    s, o = F.col("scale"), F.col("offset")
    # zero times an open end is zero
    times = lambda x: F.when(s == 0, F.lit(0.0)).otherwise(s * x)
    a = F.greatest(F.least(times(lo), times(hi)) + o, F.coalesce("low", F.lit(-INF)))
    b = F.least(F.greatest(times(lo), times(hi)) + o, F.coalesce("high", F.lit(INF)))
    return F.when(a <= b, a), F.when(a <= b, b)


def flow_ranges(nodes: DataFrame, edges: DataFrame, widen_after: int = 3, narrow: int = 2, max_rounds: int = 1000) -> DataFrame:
    """(id, lo, hi, status): the range every node's variable may take.

    ``nodes`` (id, op, lo, hi) start with a range of their own or none; ``op``
    is JOIN (the hull of what comes in and the node's own) or SUM (the sum of
    its inputs, empty while one of them is).  ``edges`` (src, dst, scale, offset,
    low, high) carry ``scale * x + offset``, cut to the guard [low, high].

    Ranges grow from what the nodes start with; a round touches only nodes with
    an input that changed.  After ``widen_after`` rounds an end that still moves
    goes to infinity, so rounds end; then ``narrow`` rounds compute every range
    anew from its inputs, which a guard behind a widened loop pulls in again.
    RANGE_EMPTY: nothing reaches the node.

    Sides of joins are not broadcast: written as Parquet, repeating names take a
    fraction of what they would in the driver's memory.
    """
    e = checkpoint(edges.select("src", "dst", *(F.col(c).cast("double").alias(c) for c in ("scale", "offset", "low", "high"))))
    need = e.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("need"))
    own = checkpoint(nodes.join(need, "id", "left").select("id", "op", F.col("lo").cast("double").alias("own_lo"), F.col("hi").cast("double").alias("own_hi"), F.coalesce("need", F.lit(0)).alias("need")))
    state = checkpoint(own.select("id", F.col("own_lo").alias("lo"), F.col("own_hi").alias("hi"), F.lit(0).alias("moved")))
    front = state.where("lo is not null").select("id")

    def incoming(state: DataFrame, at: DataFrame | None) -> DataFrame:
        """The range that the inputs of the nodes ``at`` (all, if None) give now."""
        into = e if at is None else e.join(at.withColumnRenamed("id", "dst").hint("merge"), "dst", "left_semi")
        got = into.join(state.where("lo is not null").select(F.col("id").alias("src"), "lo", "hi").hint("merge"), "src")
        a, b = _moved(F.col("lo"), F.col("hi"))
        got = got.select("dst", a.alias("a"), b.alias("b")).where("a is not null")
        sums = got.groupBy(F.col("dst").alias("id")).agg(F.min("a").alias("min_a"), F.max("b").alias("max_b"), F.sum("a").alias("sum_a"), F.sum("b").alias("sum_b"), F.count(F.lit(1)).alias("n"))
        j = (own if at is None else own.join(at.hint("merge"), "id", "left_semi")).join(sums.hint("merge"), "id", "left")
        add = (F.col("op") == "SUM") & (F.col("need") > 0)
        full = F.col("n") == F.col("need")
        return j.select(
            "id",
            F.when(add, F.when(full, F.col("sum_a"))).otherwise(F.least("own_lo", "min_a")).alias("new_lo"),
            F.when(add, F.when(full, F.col("sum_b"))).otherwise(F.greatest("own_hi", "max_b")).alias("new_hi"),
        )

    for k in range(max_rounds):
        at = e.join(front.withColumnRenamed("id", "src").hint("merge"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        new = incoming(state, at)
        j = state.join(new.hint("merge"), "id", "left")
        down = F.col("new_lo").isNotNull() & (F.col("lo").isNull() | (F.col("new_lo") < F.col("lo")))
        up = F.col("new_hi").isNotNull() & (F.col("hi").isNull() | (F.col("new_hi") > F.col("hi")))
        # a node that has been reached before and moves again is in a loop or behind one
        wide = F.col("lo").isNotNull() & (F.lit(k) >= widen_after)
        lo = F.when(down & wide, F.lit(-INF)).when(down, F.col("new_lo")).otherwise(F.col("lo"))
        hi = F.when(up & wide, F.lit(INF)).when(up, F.col("new_hi")).otherwise(F.col("hi"))
        old, state = state, checkpoint(j.select("id", lo.alias("lo"), hi.alias("hi"), (down | up).cast("int").alias("moved")))
        drop(old)
        front = state.where("moved = 1").select("id")
        if front.isEmpty():
            break
    for _ in range(narrow):
        new = incoming(state, None)
        state = checkpoint(state.join(new.hint("merge"), "id").select("id", F.when(F.col("new_lo").isNotNull(), F.greatest("lo", "new_lo")).alias("lo"), F.when(F.col("new_hi").isNotNull(), F.least("hi", "new_hi")).alias("hi"), F.lit(0).alias("moved")))
    status = F.when(F.col("lo").isNull(), EMPTY).when((F.col("lo") == -INF) | (F.col("hi") == INF), WIDENED).otherwise(RESOLVED)
    return state.select("id", "lo", "hi", status.alias("status"))


def failure_regions(cases: DataFrame, key: str, dims: Sequence[str], residual: Callable[[dict[str, Column]], Column], point: Callable[[dict[str, Column]], Column], depth: int = 6, budget: int | None = None) -> DataFrame:
    """(key, dims..., depth, status, confirmed): boxes of inputs in which a residual is proven other than zero, or may be.

    ``cases`` holds an interval struct per dimension.  ``residual`` maps interval
    columns to the residual's interval, ``point`` maps numbers to its value.  In
    each round, one DataFrame step for all cases, boxes whose residual excludes
    zero leave as FAILURE_REGION_PROVEN, boxes where it is zero throughout are
    dropped as no failure, and the others are halved along their widest
    dimension (ties: the first).  What is left at ``depth``, or is not among a
    case's ``budget`` boxes of largest residual in a round, stays as it is and is
    FAILURE_REGION_POSSIBLE.  ``confirmed`` says whether the residual differs
    from zero at the middle of the box: evidence, not proof.
    """
    boxes, out = checkpoint(cases.select(key, *dims).withColumn("depth", F.lit(0))), []
    middle = lambda d: (F.col(d)["lo"] + F.col(d)["hi"]) / 2
    confirmed = F.coalesce(point({d: middle(d) for d in dims}) != 0, F.lit(False))
    shown = lambda df, status: df.select(key, *dims, "depth", F.lit(status).alias("status"), confirmed.alias("confirmed"))
    for k in range(depth + 1):
        seen = checkpoint(boxes.withColumn("r", residual({d: F.col(d) for d in dims})))
        other = F.coalesce((F.col("r.lo") > 0) | (F.col("r.hi") < 0), F.lit(False))
        none = F.coalesce((F.col("r.lo") == 0) & (F.col("r.hi") == 0), F.lit(False))
        out.append(shown(seen.where(other), PROVEN))
        open_ = seen.where(~other & ~none)
        if k == depth:
            out.append(shown(open_, POSSIBLE))
            break
        wide = [F.col(d)["hi"] - F.col(d)["lo"] for d in dims]
        flat = F.greatest(*wide) == 0 if len(wide) > 1 else wide[0] == 0
        out.append(shown(open_.where(flat), POSSIBLE))
        open_ = open_.where(~flat)
        if budget is not None:
            size = F.greatest(F.abs("r.lo"), F.abs("r.hi"))
            place = F.row_number().over(Window.partitionBy(key).orderBy(size.desc_nulls_first(), *(F.col(d)["lo"] for d in dims)))
            open_ = checkpoint(open_.withColumn("place", place))
            out.append(shown(open_.where(F.col("place") > budget), POSSIBLE))
            open_ = open_.where(F.col("place") <= budget).drop("place")
        top = F.greatest(*wide) if len(wide) > 1 else wide[0]
        axis = F.lit(len(dims) - 1)
        for i in reversed(range(len(dims) - 1)):
            axis = F.when(wide[i] == top, F.lit(i)).otherwise(axis)
        half = lambda d, i: F.when(F.col("axis") == i, F.when(F.col("side") == 0, F.struct(F.col(d)["lo"].alias("lo"), middle(d).alias("hi"))).otherwise(F.struct(middle(d).alias("lo"), F.col(d)["hi"].alias("hi")))).otherwise(F.col(d))
        two = open_.withColumn("axis", axis).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
        boxes = two.select(key, *(half(d, i).alias(d) for i, d in enumerate(dims)), (F.col("depth") + 1).alias("depth"))
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole


__all__ = ["EMPTY", "POSSIBLE", "PROVEN", "RESOLVED", "WIDENED", "I", "failure_regions", "flow_ranges"]
