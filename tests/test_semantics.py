"""Terms, error graphs, ranges, regions, chains, control flow and traces against plain Python."""

import itertools
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from numera.functions import intervals as I
from numera.operators import chains, propagation, ranges, terms

TERM = "id string, op string, args array<string>"


def grown(r, leaves, n):
    """Random terms over ``leaves``, arguments before those that use them."""
    rows = [(f"t{i:03d}", f"leaf{i}", []) for i in range(leaves)]
    seen = set()
    for i in range(leaves, n):
        op, args = r.choice("fg"), [r.choice(rows)[0] for _ in range(r.choice([1, 2]))]
        if (op, *args) not in seen:
            seen.add((op, *args))
            rows.append((f"t{i:03d}", op, args))
    return rows


def closed(rows, equal):
    up = {i: i for i, _, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    def join(a, b):
        a, b = sorted((find(a), find(b)))
        up[b] = a

    for a, b in equal:
        join(a, b)
    while True:
        sign, moved = {}, False
        for i, op, a in rows:
            k = (op, *map(find, a))
            if k in sign and find(sign[k]) != find(i):
                join(sign[k], i)
                moved = True
            sign.setdefault(k, i)
        if not moved:
            return {i: find(i) for i in up}


def test_congruence_is_that_of_union_find(spark):
    r = random.Random(7)
    for n in (40, 90):
        rows = grown(r, 8, n)
        equal = [(r.choice(rows)[0], r.choice(rows)[0]) for _ in range(4)]
        got = terms.congruence(spark.createDataFrame(rows, TERM), spark.createDataFrame(equal, "a string, b string"))
        assert {x.id: x["class"] for x in got.collect()} == closed(rows, equal)
    none = terms.congruence(spark.createDataFrame(rows, TERM), spark.createDataFrame([], "a string, b string"))
    assert {x.id: x["class"] for x in none.collect()} == {i: i for i, _, _ in rows}


def build(spark, texts):
    """Terms of patterns without variables, and the id of each."""
    import hashlib

    rows, tops = {}, []

    def add(p):
        a = [add(x) for x in p.args]
        i = hashlib.md5(f"{p.op}({','.join(a)})".encode()).hexdigest()
        rows[i] = (i, p.op, a)
        return i

    for t in texts:
        tops.append(add(terms.pattern(t)))
    return spark.createDataFrame(list(rows.values()), TERM), tops


def test_saturation_and_budgets(spark):
    df, (a, b, c, one) = build(spark, ["(Multiply (Add x 0) 1)", "x", "(Divide y y)", "1"])
    rules = [terms.rule("zero", "(Add ?a 0)", "?a"), terms.rule("one", "(Multiply ?a 1)", "?a"), terms.rule("self", "(Divide ?a ?a)", "1", a="nonzero"), terms.rule("flip", "(Multiply ?a ?b)", "(Multiply ?b ?a)")]
    s = terms.saturate(df, rules)
    of = {r.id: r["class"] for r in s.members.collect()}
    assert s.status == terms.BLOCKED and of[a] == of[b] and of[c] != of[one] and {(r.rule, r.fact) for r in s.blocked.collect()} == {("self", "nonzero")}
    y = build(spark, ["y"])[1][0]
    s = terms.saturate(df, rules, spark.createDataFrame([(y, "nonzero")], "id string, fact string"))
    of = {r.id: r["class"] for r in s.members.collect()}
    assert s.status == terms.SATURATED and of[c] == of[one] and s.applications >= 4
    assert {r["class"]: r.cost for r in terms.costs(s.nodes).collect()}[of[a]] == 1
    # a chain that never ends is cut by each budget, whole rounds at a time
    grow = [terms.rule("grow", "(f ?a)", "(f (g ?a))")]
    df, _ = build(spark, ["(f x)"])
    s = terms.saturate(df, grow, iterations=3)
    assert (s.status, s.iterations, s.applications) == (terms.EXHAUSTED, 3, 6) or s.status == terms.EXHAUSTED and s.iterations == 3
    nodes = [terms.saturate(df, grow, iterations=9, max_nodes=k).nodes.count() for k in (2, 4, 6)]
    assert nodes[0] == 2 and all(n <= k for n, k in zip(nodes, (2, 4, 6)))
    assert terms.saturate(df, grow, iterations=9, max_applications=1).applications <= 1


def test_match(spark):
    df, _ = build(spark, ["(Add (f x) (f y))", "(Add (f x) (f x))", "(Add (f x) y)", "(Add 1 (f y))"])
    nodes = df.select(F.col("id").alias("class"), "op", "args")
    assert terms.match(nodes, "(Add (f ?a) (f ?b))").count() == 2 and terms.match(nodes, "(Add (f ?a) (f ?a))").count() == 1
    assert terms.match(nodes, "(Add ?a ?b)").count() == 4 and terms.match(nodes, "(Add 1 ?b)").count() == 1 and terms.match(nodes, "?a").count() == df.count()
    types = nodes.where("op = 'y'").select("class", F.lit("T").alias("type"))
    assert terms.match(nodes, "(Add ?a (f ?b:T))", types).count() == 2 and terms.match(nodes, "(Add ?a ?b:T)", types).count() == 1
    with pytest.raises(ValueError):
        terms.pattern("(f x) y")


def test_error_bounds_hold(spark):
    """Leaves moved within their bounds move no value by more than its bound; cycles and unknown bounds stay unresolved."""
    r = random.Random(3)
    ops = {"Add": sum, "Mean": lambda v: sum(v) / len(v), "Maximum": max, "Minimum": min, "Subtract": lambda v: v[0] - v[1], "Multiply": lambda v: v[0] * v[1], "Divide": lambda v: v[0] / v[1], "Sqrt": lambda v: math.sqrt(v[0]), "Exp": lambda v: math.exp(v[0]), "Log": lambda v: math.log(v[0]), "Sin": lambda v: math.sin(v[0]), "Negate": lambda v: -v[0], "Abs": lambda v: abs(v[0])}
    nodes = [(f"x{i}", "Input", r.uniform(0.5, 1.5), None if i == 7 else r.uniform(0, 0.01)) for i in range(8)]
    edges, inputs = [], {}
    for i in range(60):
        op = r.choice(list(ops))
        k = 2 if op in ("Subtract", "Multiply", "Divide") else 1 if op in ("Sqrt", "Exp", "Log", "Sin", "Negate", "Abs") else r.randrange(1, 4)
        ins = r.sample([n[0] for n in nodes[: i + 8]], k)
        nodes.append((f"n{i}", op, None, None))
        inputs[f"n{i}"] = (op, ins)
        edges += [(s, f"n{i}", p) for p, s in enumerate(ins)]
    nodes += [("c1", "Add", None, None), ("c2", "Add", None, None), ("c3", "Negate", None, None), ("?", "Unknown", None, None)]
    edges += [("c1", "c2", 0), ("c2", "c1", 0), ("x0", "c1", 1), ("c2", "c3", 0), ("x0", "?", 0), ("nowhere", "n0", 9)]
    got = {x.id: x for x in propagation.propagate(spark.createDataFrame(nodes, "id string, op string, value double, bound double"), spark.createDataFrame(edges, "src string, dst string, pos int")).collect()}
    assert len(got) == len(nodes)
    assert all(got[c].status == "UNRESOLVED" and got[c].level is None for c in ("c1", "c2", "c3")) and got["?"].status == "UNRESOLVED"

    def values(leaf):
        v = dict(leaf)
        for n, (op, ins) in inputs.items():
            try:
                v[n] = ops[op]([v[s] for s in ins])
            except (TypeError, ValueError, ZeroDivisionError, OverflowError):
                v[n] = None
        return v

    base = values({n[0]: n[2] for n in nodes[:8]})
    for n, v in base.items():
        if v is None:
            assert got[n].status == "UNRESOLVED"
        elif got[n].value is not None:
            assert math.isclose(got[n].value, v, rel_tol=1e-9, abs_tol=1e-9)
    reach = {"x7"}
    for n, (_, ins) in inputs.items():
        if reach & set(ins):
            reach.add(n)
    assert all(got[n].status == "UNRESOLVED" for n in reach) and sum(x.status == "RESOLVED" for x in got.values()) > 15
    for _ in range(60):
        moved = values({n[0]: n[2] + (n[3] or 0) * r.uniform(-1, 1) for n in nodes[:8]})
        for n, x in got.items():
            if x.bound is not None and n in moved:
                assert abs(moved[n] - x.value) <= x.bound * (1 + 1e-9) + 1e-12


def test_ranges_hold_what_runs_reach(spark):
    """Random walks over the graph never leave the ranges; a straight graph keeps them exact; loops end."""
    r = random.Random(5)
    edge = "src string, dst string, scale double, offset double, low double, high double"
    for _ in range(3):
        n = 8
        nodes = [(f"v{i}", "JOIN", 1.0 * i if i < 2 else None, 2.0 * i if i < 2 else None) for i in range(n)]
        edges = []
        for _ in range(14):
            a, b = r.randrange(n), r.randrange(n)
            edges.append((f"v{a}", f"v{b}", r.choice([1.0, -1.0, 0.5, 2.0, 0.0]), r.choice([0.0, 1.0, -3.0]), r.choice([None, -5.0]), r.choice([None, 20.0])))
        got = {x.id: (x.lo, x.hi) for x in ranges.flow_ranges(spark.createDataFrame(nodes, "id string, op string, lo double, hi double"), spark.createDataFrame(edges, edge)).collect()}
        for _ in range(400):
            i = r.randrange(2)
            at, x = f"v{i}", r.uniform(1.0 * i, 2.0 * i)
            for _ in range(30):
                assert got[at][0] is not None and got[at][0] - 1e-9 <= x <= got[at][1] + 1e-9
                out = [(d, s * x + o, lo, hi) for a, d, s, o, lo, hi in edges if a == at]
                out = [(d, y) for d, y, lo, hi in out if (lo is None or y >= lo) and (hi is None or y <= hi)]
                if not out:
                    break
                at, x = r.choice(out)
    nodes = [("a", "JOIN", 1.0, 2.0), ("b", "JOIN", None, None), ("c", "SUM", None, None), ("d", "JOIN", None, None)]
    edges = [("a", "b", 3.0, 1.0, None, 6.0), ("a", "c", 1.0, 0.0, None, None), ("b", "c", -1.0, 0.0, None, None), ("a", "d", 1.0, 0.0, 5.0, None)]
    got = {x.id: tuple(x)[1:] for x in ranges.flow_ranges(spark.createDataFrame(nodes, "id string, op string, lo double, hi double"), spark.createDataFrame(edges, edge)).collect()}
    assert got == {"a": (1, 2, "RANGE_RESOLVED"), "b": (4, 6, "RANGE_RESOLVED"), "c": (-5, -2, "RANGE_RESOLVED"), "d": (None, None, "RANGE_EMPTY")}


def test_regions_cover_all_failures(spark):
    """Boxes tile what may fail: no point outside them has a residual, none in a proven one lacks it; a budget drops nothing."""
    box = lambda a, b: I.interval(a, b)
    cases = spark.range(1).select(F.col("id").alias("k"), box(0, 2).alias("x"), box(-1, 1).alias("y"))
    residual = lambda b: I.subtract(I.multiply(b["x"], b["y"]), box(0.5, 0.5))
    for budget in (None, 3):
        got = ranges.failure_regions(cases, "k", ["x", "y"], residual, lambda v: v["x"] * v["y"] - 0.5, depth=6, budget=budget).collect()
        area = sum((g.x.hi - g.x.lo) * (g.y.hi - g.y.lo) for g in got)
        assert abs(area - 4) < 1e-9  # nowhere is the residual zero over a whole box
        for g in got:
            f = [x * y - 0.5 for x, y in itertools.product((g.x.lo, g.x.hi), (g.y.lo, g.y.hi))]
            assert g.status == ranges.POSSIBLE or min(f) > 0 or max(f) < 0
    same = ranges.failure_regions(cases, "k", ["x"], lambda b: F.struct(F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi")), lambda v: v["x"] * 0)
    assert same.count() == 0


def test_alias_chains(spark):
    r = random.Random(11)
    names = [f"a{i}" for i in range(120)]
    rows = [(n, r.choice([*names, "known", "nowhere"])) for n in names for _ in range(1 if r.random() < 0.95 else 2)] + [("n", None), ("a0", "a0")]
    target = defaultdict(set)
    for n, x in rows:
        target[n].add(x)

    def walk(n):
        at, hops, seen = n, 0, []
        while at in target:
            if len(target[at]) > 1:
                return at, hops, "AMBIGUOUS"
            if at in seen:
                return None, 0 if n in seen[seen.index(at) :] else None, "CYCLE"
            seen.append(at)
            at, hops = next(iter(target[at])), hops + 1
        return at, hops, "RESOLVED" if at == "known" else "DANGLING"

    got = {x.name: (x.end, x.hops, x.status) for x in chains.resolve_aliases(spark.createDataFrame(rows, "name string, target string"), spark.createDataFrame([("known",)], "name string")).collect()}
    assert got == {n: walk(n) for n in target}
    line = spark.range(300).select(F.concat(F.lit("x"), "id").alias("name"), F.concat(F.lit("x"), F.col("id") + 1).alias("target"))
    ends = chains.resolve_aliases(line, spark.createDataFrame([("x300",)], "name string")).collect()
    assert {(x.end, x.status) for x in ends} == {("x300", "RESOLVED")} and {x.hops for x in ends} == set(range(1, 301))


def test_control_flow(spark):
    r = random.Random(2)
    edges, blocks, defs = [], [], []
    for f in range(6):
        n = r.randrange(1, 9)
        blocks += [(f, b, b == 0) for b in range(n)]
        edges += [(f, r.randrange(n), r.randrange(n)) for _ in range(2 * n)]
        defs += [(f, b, 10 * b + v, v) for b in range(n) for v in range(3) if r.random() < 0.4]
    succ = defaultdict(set)
    for f, a, b in edges:
        succ[f, a].add(b)

    def reach(f, avoid=None):
        seen, todo = set(), [0] if avoid != 0 else []
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [y for y in succ[f, x] if y != avoid]
        return seen

    want = {(f, b, d) for f in range(6) for b in reach(f) for d in reach(f) if b == d or b not in reach(f, d)}
    b, e = spark.createDataFrame(blocks, "function long, block long, entry boolean"), spark.createDataFrame(edges, "function long, src long, dst long")
    got = chains.dominators(b, e).collect()
    assert {(x.function, x.block, x.dominator) for x in got} == want
    closest = {(f, b): max((d for g, c, d in want if (g, c) == (f, b) and d != b), key=lambda d: sum(1 for g, c, _ in want if (g, c) == (f, d)), default=None) for f, b, _ in want}
    assert {(x.function, x.block): x.dominator for x in got if x.immediate} == {k: d for k, d in closest.items() if d is not None}
    inside, changed = defaultdict(set), True
    while changed:
        changed = False
        for f, a, c in edges:
            own = {v for g, k, _, v in defs if (g, k) == (f, a)}
            out = {(d, v) for g, k, d, v in defs if (g, k) == (f, a)} | {(d, v) for d, v in inside[f, a] if v not in own}
            if not out <= inside[f, c]:
                inside[f, c] |= out
                changed = True
    rd = chains.reaching_definitions(e, spark.createDataFrame(defs, "function long, block long, definition long, variable long"))
    assert {(x.function, x.block, x.definition) for x in rd.collect()} == {(*k, d) for k, s in inside.items() for d, _ in s}


def test_traces(spark):
    r = random.Random(4)
    a = {(o, s): r.randrange(5) for o in range(40) for s in range(r.randrange(1, 200))}
    b = dict(a)
    for _ in range(30):
        k = r.choice(list(b))
        b[k] = r.choice([None, 7])
        if r.random() < 0.5:
            del b[k]
    b[99, 0] = 1
    want = {}
    for o, s in sorted(set(a) | set(b)):
        if o not in want and ((o, s) in a) + ((o, s) in b) != 2 or o not in want and a[o, s] != b[o, s]:
            want[o] = (s, a.get((o, s)), b.get((o, s)))
    df = lambda d: spark.createDataFrame([(*k, v) for k, v in d.items()], "o long, s long, v long")
    for fan, levels in ((64, 3), (4, 2), (2, 1)):
        got = chains.first_divergence(df(a), df(b), "o", "s", "v", fan, levels).collect()
        assert {x.o: (x.step, x.expected, x.actual) for x in got} == want
    assert chains.first_divergence(df(a), df(a), "o", "s", "v").count() == 0
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "c"), ("q", "q2"), ("q2", "q"), ("ok", "a")], "src string, dst string")
    bad = spark.createDataFrame([(x,) for x in ("a", "b", "c", "x", "q", "q2")], "id string")
    assert {x.id: (x.root, x.distance) for x in chains.divergence_roots(bad, e).collect()} == {"a": ("a", 0), "b": ("a", 1), "c": ("x", 1), "x": ("x", 0), "q": (None, None), "q2": (None, None)}


def test_sensitivities_are_slopes(spark):
    """Derivatives over all paths equal differences of values a small step apart."""
    nodes = [("x", "Input", 1.3), ("y", "Input", 0.7), ("p", "Multiply", None), ("s", "Sin", None), ("q", "Divide", None), ("m", "Mean", None), ("e", "Exp", None), ("d", "Subtract", None), ("top", "Add", None), ("big", "Maximum", None), ("alone", "Input", 2.0)]
    edges = [("x", "p", 0), ("y", "p", 1), ("p", "s", 0), ("s", "q", 0), ("y", "q", 1), ("x", "m", 0), ("q", "m", 0), ("p", "m", 0), ("y", "e", 0), ("m", "d", 0), ("e", "d", 1), ("d", "top", 0), ("x", "top", 0), ("x", "big", 0), ("y", "big", 0)]
    f = lambda x, y: (x + math.sin(x * y) / y + x * y) / 3 - math.exp(y) + x
    n = spark.createDataFrame([(*v, 0.0) for v in nodes], "id string, op string, value double, bound double")
    e = spark.createDataFrame(edges, "src string, dst string, pos int")
    out = propagation.propagate(n, e)
    got = {(x.output, x.input): x.derivative for x in propagation.sensitivities(n, e, out, spark.createDataFrame([("top",), ("big",), ("alone",), ("none",)], "id string")).collect()}
    h = 1e-6
    assert abs(got["top", "x"] - (f(1.3 + h, 0.7) - f(1.3 - h, 0.7)) / (2 * h)) < 1e-6 and abs(got["top", "y"] - (f(1.3, 0.7 + h) - f(1.3, 0.7 - h)) / (2 * h)) < 1e-6
    assert got["big", "x"] is None and got["big", "y"] is None and got["alone", "alone"] == 1 and len(got) == 5


def test_backward_slices(spark):
    r = random.Random(6)
    code, want = [], set()
    for f in range(30):
        lines = [(p, r.choice("abcd"), r.sample("abcd", r.randrange(0, 3))) for p in range(r.randrange(1, 9))]
        alias = [tuple(r.sample("abcd", 2)) for _ in range(r.choice([0, 0, 1, 2]))]
        group = {v: {v} for v in "abcd"}
        for x, y in alias:
            both = group[x] | group[y]
            for v in both:
                group[v] = both
        needed, todo, seen = set(), [(99, "a")], set()
        while todo:
            at, v = todo.pop()
            if (at, v) in seen:
                continue
            seen.add((at, v))
            found = [p for p, w, _ in lines if p < at and w in group[v]]
            for p in found if len(group[v]) > 1 else found[-1:]:
                needed.add(p)
                todo += [(p, x) for x in dict((q, ld) for q, _, ld in lines)[p]]
        want |= {(f, p) for p in needed}
        code.append((f, lines, alias))
    df = lambda rows, s: spark.createDataFrame(rows, s)
    got = chains.backward_slice(
        df([(f, p, w) for f, lines, _ in code for p, w, _ in lines], "function long, pos long, name string"), df([(f, p, x) for f, lines, _ in code for p, _, ld in lines for x in ld], "function long, pos long, name string"),
        df([(f, *a) for f, _, alias in code for a in alias], "function long, name string, other string"), df([(f, "a") for f, _, _ in code], "function long, name string"),
    )
    assert {tuple(x) for x in got.collect()} == want
