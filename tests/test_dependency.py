"""Strong components and illegal cycles against a plain search, faults on a small graph."""

import random

from numera.operators import dependency

NODE, EDGE = "id string, semantic string, effect string, location string", "edge_id string, kind string, source string, target string, role string, confidence string"


def reach(start, out):
    seen, todo = {start}, [start]
    while todo:
        for y in out.get(todo.pop(), ()):
            if y not in seen:
                seen.add(y)
                todo.append(y)
    return seen


def test_cycles(spark):
    r = random.Random(4)
    for n, m in ((14, 16), (30, 34), (6, 12)):
        ids = [f"n{i:02}" for i in range(n)]
        nodes = [(i, "Loop" if r.random() < 0.05 else "Value", "Pure", None) for i in ids]
        edges = [(f"e{k}", "PREVIOUS_ACCUMULATOR_VALUE" if r.random() < 0.1 else "READS", r.choice(ids), r.choice(ids), "x", "RESOLVED") for k in range(m)]
        out = {}
        for _, _, a, b, *_ in edges:
            out.setdefault(a, set()).add(b)
        far = {i: reach(i, out) for i in ids}
        parts = {frozenset(j for j in far[i] if i in far[j]) for i in ids}
        want = []
        for p in parts:
            inner = [e for e in edges if e[2] in p and e[3] in p]
            loop = any(s == "Loop" and i in p for i, s, *_ in nodes)
            if inner and (len(p) > 1 or any(e[2] == e[3] for e in inner)) and not loop and not any(e[1] == "PREVIOUS_ACCUMULATOR_VALUE" for e in inner):
                want.append(sorted(p))
        got = dependency.illegal_cycles(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)).collect()
        assert sorted(x.members for x in got) == sorted(want)


def test_faults(spark):
    nodes = [("a", "Load", "Pure", None), ("a", "Load", "Pure", None), (None, "Load", "Pure", None), ("l", "Loop", "Pure", None), ("c", "Conditional", "Pure", None)]
    edges = [("1", "READS", "a", "l", "index", "RESOLVED"), (None, "READS", "a", "c", "condition", "RESOLVED"), ("2", "NEVER", "a", "zz", "x", "RESOLVED")]
    got = {(x.message, x.subject) for x in dependency.diagnostics(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)).collect()}
    assert got == {
        ("node IDs must be present and unique", "a"), ("node IDs must be present and unique", None), ("edge IDs must be present and unique", None), ("unknown edge kind", "2"),
        ("edge endpoint does not exist", "2"), ("Loop needs index, lower, and upper dependencies", "l"), ("no Store or Return output node exists", None),
    }
