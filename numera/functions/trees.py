"""Expression trees as JSON text: ``{"op": ..., "args": [...], "name": ..., "value": ...}``.

The functions work on one tree and are pure; ``udf`` lifts them to columns in
Arrow batches.  Exact relations only: nothing here equates what floating-point
evaluation would tell apart, except that an integral number equals its integer.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F

COMMUTATIVE = frozenset(("Add", "Multiply", "LogicalAnd", "LogicalOr", "BitAnd", "BitOr", "BitXor"))
NOISE = frozenset(("source", "span", "line", "column", "comment", "reduction_order"))


def sym(name: str) -> dict:
    return {"op": "Symbol", "name": name}


def num(value) -> dict:
    return {"op": "Constant", "value": value}


def call(op: str, *args: dict) -> dict:
    return {"op": op, "args": list(args)}


def _text(x) -> str:
    return json.dumps(x, sort_keys=True, separators=(",", ":"))


def canonical(tree: dict, rename: bool = True) -> dict:
    """Source noise dropped, integral floats as integers, commutative arguments sorted, symbols renamed in order of visit."""

    def clean(t):
        if isinstance(t, dict):
            t = {k: clean(v) for k, v in t.items() if k not in NOISE}
            if t.get("op") in COMMUTATIVE:
                t["args"] = sorted(t["args"], key=lambda a: _text(blank(a)))
            return t
        if isinstance(t, list):
            return [clean(x) for x in t]
        return int(t) if isinstance(t, float) and t.is_integer() and abs(t) < 2**53 else t

    def blank(t):
        if isinstance(t, dict):
            return {k: blank(v) for k, v in t.items() if not (k == "name" and t.get("op") == "Symbol" and rename)}
        return [blank(x) for x in t] if isinstance(t, list) else t

    names: dict[str, str] = {}

    def label(t):
        if isinstance(t, dict):
            if t.get("op") == "Symbol":
                return t | {"name": names.setdefault(t["name"], f"s{len(names)}")}
            return {k: label(t[k]) for k in sorted(t)}
        return [label(x) for x in t] if isinstance(t, list) else t

    out = clean(tree)
    return label(out) if rename else out


def semantic_hash(tree: dict) -> str:
    return hashlib.sha256(_text(canonical(tree)).encode()).hexdigest()


def substitute(tree: dict, mapping: dict[str, dict]) -> dict:
    """Free symbols replaced at once; the index of a Sum or Product is bound."""
    if tree.get("op") == "Symbol":
        return mapping.get(tree["name"], tree)
    inner = {k: v for k, v in mapping.items() if k != tree.get("index")}
    return tree | {"args": [substitute(a, inner) for a in tree["args"]]} if "args" in tree else tree


def unify(pattern: dict, tree: dict, bound: dict[str, dict] | None = None) -> dict[str, dict] | None:
    """The substitution of pattern variables (op Variable, optional kind) that gives ``tree``, or None."""
    bound = dict(bound or {})
    if pattern.get("op") == "Variable":
        kind = pattern.get("kind")
        if kind and tree.get("op") != kind:
            return None
        had = bound.setdefault(pattern["name"], tree)
        return bound if _text(canonical(had, False)) == _text(canonical(tree, False)) else None
    if pattern.get("op") != tree.get("op") or any(pattern.get(k) != tree.get(k) for k in ("name", "value", "index")):
        return None
    a, b = pattern.get("args", []), tree.get("args", [])
    if len(a) != len(b):
        return None
    for p, t in zip(a, b):
        if (bound := unify(p, t, bound)) is None:
            return None
    return bound


def anti_unify(a: dict, b: dict) -> tuple[dict, dict[str, tuple[dict, dict]]]:
    """The least general pattern of both trees, and what each variable stands for."""
    seen: dict[tuple[str, str], str] = {}
    what: dict[str, tuple[dict, dict]] = {}

    def walk(x, y):
        same = x.get("op") == y.get("op") and all(x.get(k) == y.get(k) for k in ("name", "value", "index")) and len(x.get("args", [])) == len(y.get("args", []))
        if same:
            return x | {"args": [walk(p, q) for p, q in zip(x["args"], y["args"])]} if "args" in x else x
        name = seen.setdefault((_text(x), _text(y)), f"v{len(seen)}")
        what[name] = (x, y)
        return {"op": "Variable", "name": name}

    return walk(a, b), what


def simplify(tree: dict) -> dict:
    """Exact rewrites to a fixpoint: neutral elements, x - x, constant folding of integers, nested sums flattened."""
    args = [simplify(a) for a in tree.get("args", [])]
    t = tree | {"args": args} if "args" in tree else tree
    op = t.get("op")
    if op in ("Add", "Multiply"):
        flat = [y for a in args for y in (a["args"] if a.get("op") == op else [a])]
        unit = 0 if op == "Add" else 1
        whole = [a["value"] for a in flat if a.get("op") == "Constant" and isinstance(a["value"], int)]
        rest = [a for a in flat if not (a.get("op") == "Constant" and isinstance(a["value"], int))]
        c = sum(whole) if op == "Add" else math.prod(whole)
        if op == "Multiply" and c == 0 and all(a.get("op") in ("Constant", "Symbol") for a in rest):
            return num(0)
        rest = rest + ([num(c)] if c != unit or not rest else [])
        return rest[0] if len(rest) == 1 else t | {"args": rest}
    if op == "Subtract":
        if _text(canonical(args[0], False)) == _text(canonical(args[1], False)):
            return num(0)
        if args[1] == num(0):
            return args[0]
    if op == "Negate" and args[0].get("op") == "Negate":
        return args[0]["args"][0]
    if op == "Power" and args[1] == num(1):
        return args[0]
    if op == "Divide" and args[1] == num(1):
        return args[0]
    return t


_FUNCTIONS: dict[str, Callable] = {
    "Negate": lambda a: -a, "Add": lambda *a: math.fsum(a), "Subtract": lambda a, b: a - b, "Multiply": lambda *a: math.prod(a), "Divide": lambda a, b: a / b, "Power": lambda a, b: a**b,
    "Minimum": min, "Maximum": max, "Abs": abs, "Sqrt": math.sqrt, "Log": math.log, "Exp": math.exp, "Sin": math.sin, "Cos": math.cos, "Tan": math.tan, "Sinh": math.sinh, "Cosh": math.cosh, "Tanh": math.tanh,
    "Floor": math.floor, "Ceil": math.ceil, "LessThan": lambda a, b: float(a < b), "LessEqual": lambda a, b: float(a <= b), "GreaterThan": lambda a, b: float(a > b), "GreaterEqual": lambda a, b: float(a >= b),
    "Equal": lambda a, b: float(a == b), "NotEqual": lambda a, b: float(a != b),
}


def evaluate(tree: dict, env: dict[str, float]) -> float | None:
    """The value under ``env``; None where it is undefined (domain errors, unknown names or operators)."""
    try:
        op = tree["op"]
        if op == "Constant":
            return float(tree["value"])
        if op == "Symbol":
            return float(env[tree["name"]])
        if op == "Select":
            p = evaluate(tree["args"][0], env)
            return None if p is None else evaluate(tree["args"][1 if p else 2], env)
        if op in ("Sum", "Product"):
            lo, hi = (evaluate(a, env) for a in tree["args"][:2])
            xs = [evaluate(tree["args"][2], env | {tree["index"]: float(k)}) for k in range(int(lo), int(hi) + 1)]
            return None if None in xs else math.fsum(xs) if op == "Sum" else float(math.prod(xs))
        args = [evaluate(a, env) for a in tree["args"]]
        out = None if None in args else float(_FUNCTIONS[op](*args))
        return out if out is None or math.isfinite(out) else None
    except (KeyError, ValueError, ZeroDivisionError, OverflowError, TypeError):
        return None


def derivative(tree: dict, name: str) -> dict:
    """The symbolic derivative; a Derivative node stays where no rule applies."""
    op, d = tree["op"], lambda t: derivative(t, name)
    if op == "Constant":
        return num(0)
    if op == "Symbol":
        return num(int(tree["name"] == name))
    a = tree.get("args", [])
    if op in ("Add", "Subtract", "Negate"):
        return simplify(call(op, *map(d, a)))
    if op == "Multiply":
        return simplify(call("Add", *(call("Multiply", *a[:i], d(x), *a[i + 1 :]) for i, x in enumerate(a))))
    if op == "Divide":
        return simplify(call("Divide", call("Subtract", call("Multiply", d(a[0]), a[1]), call("Multiply", a[0], d(a[1]))), call("Power", a[1], num(2))))
    if op == "Power" and a[1]["op"] == "Constant":
        return simplify(call("Multiply", a[1], call("Power", a[0], num(a[1]["value"] - 1)), d(a[0])))
    outer = {"Sin": lambda x: call("Cos", x), "Cos": lambda x: call("Negate", call("Sin", x)), "Exp": lambda x: call("Exp", x), "Log": lambda x: call("Divide", num(1), x), "Sqrt": lambda x: call("Divide", num(1), call("Multiply", num(2), call("Sqrt", x)))}
    if op in outer:
        return simplify(call("Multiply", outer[op](a[0]), d(a[0])))
    return {"op": "Derivative", "args": [tree, sym(name)]}


def to_tex(tree: dict) -> str:
    """TeX of a tree."""
    op, a = tree["op"], [to_tex(x) for x in tree.get("args", [])]
    if op in ("Constant", "Symbol"):
        return str(tree.get("value", tree.get("name")))
    infix = {"Add": " + ", "Subtract": " - ", "Multiply": r" \cdot ", "LessThan": " < ", "LessEqual": r" \le ", "GreaterThan": " > ", "GreaterEqual": r" \ge ", "Equal": " = ", "NotEqual": r" \ne "}
    if op in infix:
        return r"\left(" + infix[op].join(a) + r"\right)"
    if op == "Divide":
        return rf"\frac{{{a[0]}}}{{{a[1]}}}"
    if op == "Power":
        return rf"{{{a[0]}}}^{{{a[1]}}}"
    if op == "Sqrt":
        return rf"\sqrt{{{a[0]}}}"
    if op == "Negate":
        return f"-{a[0]}"
    if op in ("Sum", "Product"):
        return rf"\{'sum' if op == 'Sum' else 'prod'}_{{{tree['index']}={a[0]}}}^{{{a[1]}}} {a[2]}"
    return rf"\operatorname{{{op.lower()}}}\left(" + ", ".join(a) + r"\right)"


def parse(text: str) -> dict:
    """A tree from plain arithmetic text: + - * / ^, parentheses, names, numbers, calls; anything else is an error."""
    import re

    tokens = re.findall(r"\s*(\d+\.\d+|\d+|[A-Za-z_]\w*|[-+*/^(),])", text)
    if "".join(tokens) != re.sub(r"\s+", "", text):
        raise ValueError(f"cannot read {text!r}")
    at = 0

    def take(x: str | None = None) -> str:
        nonlocal at
        got = tokens[at] if at < len(tokens) else ""
        if x is not None and got != x:
            raise ValueError(f"expected {x!r} in {text!r}")
        at += 1
        return got

    peek = lambda: tokens[at] if at < len(tokens) else ""

    def total():
        left = term()
        while peek() in ("+", "-"):
            left = call("Add" if take() == "+" else "Subtract", left, term())
        return left

    def term():
        left = unary()
        while peek() in ("*", "/"):
            left = call("Multiply" if take() == "*" else "Divide", left, unary())
        return left

    def unary():
        if peek() == "-":
            take()
            return call("Negate", unary())
        base = atom()
        if peek() == "^":
            take()
            return call("Power", base, unary())
        return base

    def atom():
        x = take()
        if x == "(":
            out = total()
            take(")")
            return out
        if x[:1].isdigit():
            return num(float(x) if "." in x else int(x))
        if not (x[:1].isalpha() or x[:1] == "_"):
            raise ValueError(f"cannot read {text!r}")
        if peek() == "(":
            take()
            args = [total()]
            while peek() == ",":
                take()
                args.append(total())
            take(")")
            return call(x.capitalize(), *args)
        return sym(x)

    out = total()
    if at != len(tokens):
        raise ValueError(f"cannot read {text!r}")
    return out


def to_column(tree: dict):
    """The Spark column a tree stands for, so that the optimizer evaluates it; undefined values are null."""
    op = tree["op"]
    if op == "Constant":
        return F.lit(float(tree["value"]))
    if op == "Symbol":
        return F.col(tree["name"])
    a = [to_column(x) for x in tree["args"]]
    two = {"Subtract": lambda x, y: x - y, "Divide": F.try_divide, "Power": F.pow, "LessThan": lambda x, y: x < y, "GreaterThan": lambda x, y: x > y, "LessEqual": lambda x, y: x <= y, "GreaterEqual": lambda x, y: x >= y, "Equal": lambda x, y: x == y, "NotEqual": lambda x, y: x != y}
    if op in two:
        return two[op](*a)
    if op in ("Add", "Multiply"):
        out = a[0]
        for x in a[1:]:
            out = out + x if op == "Add" else out * x
        return out
    if op == "Select":
        return F.when(a[0], a[1]).otherwise(a[2])
    if op == "Negate":
        return -a[0]
    if op in ("Minimum", "Maximum"):
        return (F.least if op == "Minimum" else F.greatest)(*a)
    if op == "Sqrt":
        return F.when(a[0] >= 0, F.sqrt(a[0]))
    if op == "Log":
        return F.when(a[0] > 0, F.log(a[0]))
    return {"Abs": F.abs, "Exp": F.exp, "Sin": F.sin, "Cos": F.cos, "Tan": F.tan, "Sinh": F.sinh, "Cosh": F.cosh, "Tanh": F.tanh, "Floor": F.floor, "Ceil": F.ceil}[op](a[0])


def flatten(tree: dict, path: str = "$") -> list[tuple[str, str]]:
    """(path, value) of every leaf."""
    if isinstance(tree, dict):
        return [x for k in sorted(tree) for x in flatten(tree[k], f"{path}.{k}")] or [(path, "{}")]
    if isinstance(tree, list):
        return [x for i, v in enumerate(tree) for x in flatten(v, f"{path}[{i}]")] or [(path, "[]")]
    return [(path, json.dumps(tree))]


def udf(f: Callable[[dict], object], kind: str = "string"):
    """Lift a function of one tree to a column of JSON text; null stays null."""

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            out = f(json.loads(x))
            return _text(out) if isinstance(out, (dict, list)) else out

        return s.map(one, na_action="ignore")

    return run
