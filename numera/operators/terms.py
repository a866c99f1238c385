"""Terms as tables: typed pattern joins, congruence closure, and equality saturation under budgets.

A term is a row (id, op, args), args the ids of its arguments in order.  Ids are
made from the operation and the arguments (``term_id``), so equal terms are one
row wherever they are built.  Equal terms of different form share a class; a
node is a row (class, op, args) whose args are classes, and ``members`` tells
the class, the smallest id of its terms, of every term.

Nothing here visits terms one by one: a pattern is a chain of equi-joins, a
round of congruence one grouping by (op, args) and the components of what it
finds equal, a round of rewriting one join per rule.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from numera.operators.graph import checkpoint, components

# fixed values: how a saturation ends
SATURATED, EXHAUSTED, BLOCKED = "SATURATED", "SATURATION_BUDGET_EXHAUSTED", "CONDITIONALLY_BLOCKED"


def term_id(op: Column, *args: Column) -> Column:
    """128 bits of hash of an operation and the ids of its arguments; ids hold neither brackets nor commas, so no two terms read alike."""
    return F.md5(F.concat(op, F.lit("("), F.concat_ws(",", *args), F.lit(")")).cast("binary"))


@dataclass(frozen=True)
class Pattern:
    """An operation over patterns, or a variable (``op`` is None), which may ask for a type."""

    op: str | None
    args: tuple[Pattern, ...] = ()
    name: str = ""
    type: str = ""

    def variables(self) -> list[str]:
        return [self.name] if self.op is None else list(dict.fromkeys(v for a in self.args for v in a.variables()))


def pattern(text: str) -> Pattern:
    """``(Add ?x (Multiply ?y:Real 1))``: operations with arguments in brackets, leaves by their name, variables after a question mark."""
    words = re.findall(r"[()]|[^\s()]+", text)

    def read(at: int) -> tuple[Pattern, int]:
        w = words[at]
        if w == "(":
            args, k = [], at + 2
            while words[k] != ")":
                a, k = read(k)
                args.append(a)
            return Pattern(words[at + 1], tuple(args)), k + 1
        name, _, kind = w[1:].partition(":")
        return (Pattern(None, name=name, type=kind) if w[0] == "?" else Pattern(w)), at + 1

    p, end = read(0)
    if end != len(words):
        raise ValueError(f"not one pattern: {text}")
    return p


def path_index(nodes: DataFrame) -> DataFrame:
    """(op, arity, position, child, class): where a class stands as an argument; leaves have one row without a position."""
    return nodes.select("op", F.size("args").alias("arity"), F.posexplode_outer("args").alias("position", "child"), "class")


def match(nodes: DataFrame, p: Pattern | str, types: DataFrame | None = None) -> DataFrame:
    """(root, one column per variable): every way in which a node of class ``root`` is an instance of ``p``.

    The twig is joined from its leaves up: what matches an inner pattern is
    joined to its parent on the child's class, and a variable that comes twice
    joins on itself.  ``types`` (class, type) restricts typed variables.  A
    variable alone matches every class.
    """
    p = pattern(p) if isinstance(p, str) else p
    typed = lambda df, v: df if not v.type else df.join(types.where(F.col("type") == v.type).select(F.col("class").alias(v.name)).distinct(), v.name, "left_semi")
    if p.op is None:
        return typed(nodes.select(F.col("class").alias("root")).distinct().withColumn(p.name, F.col("root")), p)

    def rows(q: Pattern) -> DataFrame:
        at = [f"__{i}" for i in range(len(q.args))]
        out = nodes.where((F.col("op") == q.op) & (F.size("args") == len(q.args))).select(F.col("class").alias("root"), *(F.get("args", F.lit(i)).alias(c) for i, c in enumerate(at)))
        bound: set[str] = set()
        for a, c in sorted(zip(q.args, at), key=lambda x: x[0].op is not None):  # variables first
            if a.op is None:
                out = out.where(F.col(c) == F.col(a.name)).drop(c) if a.name in bound else typed(out.withColumnRenamed(c, a.name), a)
                bound.add(a.name)
            else:
                inner = rows(a).withColumnRenamed("root", c)
                out = out.join(inner, [c, *(v for v in a.variables() if v in bound)]).drop(c)
                bound |= set(a.variables())
        return out.select("root", *q.variables()).distinct()

    return rows(p)


def _moved(nodes: DataFrame, members: DataFrame, move: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and members with every class ``old`` named ``new``."""
    arg = nodes.select("class", "op", "args", F.posexplode_outer("args").alias("pos", "old")).join(move, "old", "left")
    args = F.transform(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("new", "old").alias("c"))))), lambda x: x.c)
    whole = arg.groupBy(F.col("class").alias("old"), "op", "args").agg(args.alias("to"))
    new = whole.join(move, "old", "left").select(F.coalesce("new", "old").alias("class"), "op", F.col("to").alias("args")).distinct()
    own = members.withColumnRenamed("class", "old").join(move, "old", "left").select("id", F.coalesce("new", "old").alias("class"))
    return checkpoint(new), checkpoint(own)


def unite(nodes: DataFrame, members: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and members once the classes of ``pairs`` (a, b), and all that congruence makes equal with them, are one.

    A round unites pairs by star steps, renames the classes in all nodes, and
    groups nodes by operation and arguments; classes that share a node are the
    next round's pairs.  Rounds are bounded by the height of the terms.
    """
    pairs = checkpoint(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).where("src != dst"))
    while not pairs.isEmpty():
        ends = pairs.select(F.col("src").alias("id")).union(pairs.select("dst")).distinct()
        move = components(ends, pairs).where("id != component").select(F.col("id").alias("old"), F.col("component").alias("new"))
        nodes, members = _moved(nodes, members, checkpoint(move))
        least = nodes.groupBy("op", "args").agg(F.min("class").alias("dst"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        pairs = checkpoint(nodes.withColumnRenamed("class", "src").join(least, ["op", "args"]).select("src", "dst").where("src != dst"))
    return nodes, members


def congruence(terms: DataFrame, equal: DataFrame) -> DataFrame:
    """(id, class): the finest equality of ``terms`` (id, op, args) that holds for ``equal`` (a, b) and for operations over equal arguments."""
    own = terms.select("id", F.col("id").alias("class"))
    return unite(terms.select(F.col("id").alias("class"), "op", "args"), own, equal)[1]


@dataclass(frozen=True)
class Rule:
    """An exact rewrite; ``requires`` names facts that must be known of what variables are bound to."""

    name: str
    left: Pattern
    right: Pattern
    requires: tuple[tuple[str, str], ...] = ()


def rule(name: str, left: str, right: str, **requires: str) -> Rule:
    return Rule(name, pattern(left), pattern(right), tuple(requires.items()))


@dataclass
class Saturation:
    """What a saturation came to: (class, op, args), (id, class), blocked (rule, root, fact), and how it ended."""

    nodes: DataFrame
    members: DataFrame
    blocked: DataFrame
    status: str
    iterations: int
    applications: int
    trace: list[tuple[int, int, int]] = field(default_factory=list)


def _built(found: DataFrame, right: Pattern, nodes: DataFrame) -> tuple[DataFrame, list[tuple[str, str, list[str], str]]]:
    """``found`` with the class of every part of ``right``, known or to be made, and (class column, op, argument columns, whether it is new)."""
    made: list[tuple[str, str, list[str], str]] = []

    def build(df: DataFrame, p: Pattern) -> tuple[DataFrame, str]:
        if p.op is None:
            return df, p.name
        args = []
        for a in p.args:
            df, c = build(df, a)
            args.append(c)
        k = len(made)
        own = nodes.where((F.col("op") == p.op) & (F.size("args") == len(args))).select(*(F.get("args", F.lit(i)).alias(f"__a{i}") for i in range(len(args))), F.col("class").alias(f"__k{k}"))
        on = [F.col(c) == F.col(f"__a{i}") for i, c in enumerate(args)]
        df = df.join(own, on, "left").drop(*(f"__a{i}" for i in range(len(args)))) if on else df.crossJoin(F.broadcast(own.agg(F.min(f"__k{k}").alias(f"__k{k}"))))  # one row
        df = df.withColumn(f"__n{k}", F.col(f"__k{k}").isNull()).withColumn(f"__c{k}", F.coalesce(f"__k{k}", term_id(F.lit(p.op), *(F.col(c) for c in args)))).drop(f"__k{k}")
        made.append((f"__c{k}", p.op, args, f"__n{k}"))
        return df, f"__c{k}"

    df, top = build(found, right)
    return df.withColumn("__top", F.col(top)), made


def saturate(terms: DataFrame, rules: Iterable[Rule], facts: DataFrame | None = None, iterations: int = 8, max_nodes: int = 1_000_000, max_applications: int = 1_000_000) -> Saturation:
    """Apply exact rules to all terms at once until nothing new is equal, or a budget is used up.

    A round matches every rule against the nodes as they were at its start.  It
    is taken whole or not at all: one that would pass ``max_nodes`` or
    ``max_applications`` ends the run as SATURATION_BUDGET_EXHAUSTED, and so does
    one more than ``iterations``.  Where a rule lacks a fact of ``facts`` (id,
    fact) about a bound term it is blocked, which the result lists; a run that
    saturates with some blocked ends as CONDITIONALLY_BLOCKED.
    """
    spark, rules = terms.sparkSession, list(rules)
    nodes = checkpoint(terms.select(F.col("id").alias("class"), "op", "args").distinct())
    members = checkpoint(terms.select("id", F.col("id").alias("class")).distinct())
    facts = facts if facts is not None else spark.createDataFrame([], "id string, fact string")
    blocked = spark.createDataFrame([], "rule string, root string, fact string")
    done, trace = 0, []
    for k in range(iterations + 1):
        known = facts.join(members, "id").select("class", "fact").distinct()
        fresh, pairs, blocked, parts = [], [], [], []
        for r in rules:
            found = match(nodes, r.left)
            for v, fact in r.requires:
                has = known.where(F.col("fact") == fact).select(F.col("class").alias(v))
                blocked.append(found.join(has, v, "left_anti").select(F.lit(r.name).alias("rule"), "root", F.lit(fact).alias("fact")).distinct())
                found = found.join(has, v, "left_semi")
            built, made = _built(found, r.right, nodes)
            news = [F.when(F.col(n), F.struct(F.col(c).alias("class"), F.lit(op).alias("op"), (F.array(*(F.col(a) for a in args)) if args else F.array().cast("array<string>")).alias("args"))) for c, op, args, n in made]
            empty = F.array().cast("array<struct<class:string,op:string,args:array<string>>>")
            parts.append(built.where("root != __top").select(F.col("root").alias("a"), F.col("__top").alias("b"), (F.array_compact(F.array(*news)) if news else empty).alias("new")))
        step = parts[0]
        for x in parts[1:]:
            step = step.unionByName(x)
        step = checkpoint(step)
        fresh = checkpoint(step.select(F.explode("new").alias("x")).select("x.class", "x.op", "x.args").distinct())
        wanted, new = step.count(), fresh.count()
        lacking = blocked[0] if blocked else spark.createDataFrame([], "rule string, root string, fact string")
        for x in blocked[1:]:
            lacking = lacking.union(x)
        if not wanted:
            return Saturation(nodes, members, lacking, SATURATED if lacking.isEmpty() else BLOCKED, k, done, trace)
        if k == iterations or done + wanted > max_applications or nodes.count() + new > max_nodes:
            return Saturation(nodes, members, lacking, EXHAUSTED, k, done, trace)
        done += wanted
        trace.append((k, wanted, new))
        own = fresh.select(F.col("class").alias("id"), "class")
        nodes, members = unite(nodes.unionByName(fresh), members.unionByName(own), step.select("a", "b"))
    raise AssertionError


def costs(nodes: DataFrame) -> DataFrame:
    """(class, cost): the fewest operations and leaves of a term of every class, by relaxation to a fixpoint."""
    best = checkpoint(nodes.where(F.size("args") == 0).select("class").distinct().withColumn("cost", F.lit(1).cast("long")))
    arity = F.size("args")
    inner = checkpoint(nodes.where(arity > 0).withColumn("node", F.monotonically_increasing_id()).select("class", "node", arity.alias("arity"), F.explode("args").alias("child")))
    while True:
        had = inner.join(best.withColumnRenamed("class", "child"), "child").groupBy("class", "node", "arity").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("s")).where("n = arity")
        new = had.groupBy("class").agg((F.min("s") + 1).alias("new"))
        both = checkpoint(best.join(new, "class", "full_outer").select("class", F.least("cost", "new").alias("cost"), (F.col("cost").isNull() | (F.col("new") < F.col("cost"))).alias("up")))
        best = both.select("class", "cost")
        if both.where("up").isEmpty():
            return best
