"""Numeric types: a lattice of (kind, bits, sign) with one join, over a tower of Python scalars."""

from __future__ import annotations

# fixed values: the names of the types and of the answer where there is none
PYTHON = ("python.int", "python.float", "python.complex")
KINDS = ("bool", "int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64", "float16", "float32", "float64", "complex64", "complex128")
UNRESOLVED = "PROMOTION_UNRESOLVED"

#: Type -> (kind: 0 truth, 1 whole, 2 real, 3 complex; bits of a component; signed bits that hold its whole numbers, 0 if unsigned types do).
LATTICE = {"bool": (0, 1, 0)}
LATTICE |= {f"int{n}": (1, n, n) for n in (8, 16, 32, 64)} | {f"uint{n}": (1, n, 0) for n in (8, 16, 32, 64)}
LATTICE |= {f"float{n}": (2, n, 0) for n in (16, 32, 64)} | {f"complex{2 * n}": (3, n, 0) for n in (32, 64)}


def _join(a: str, b: str) -> str:
    """The smallest type of the higher kind that both widths fit; a whole number too wide for any becomes float64."""
    (kind, bits, signed), (kind2, bits2, signed2) = LATTICE[a], LATTICE[b]
    top, wide = max(kind, kind2), max(bits, bits2)
    if top == 0:
        return "bool"
    if top == 3:
        return "complex64" if wide <= 32 else "complex128"
    if top == 2:
        return f"float{next(n for n in (16, 32, 64) if n >= wide)}"
    if not signed and not signed2:
        return f"uint{wide}"
    # an unsigned number needs one bit more beside a signed one; truth values fit anywhere
    need = max(s or (n + 1 if k else 0) for k, n, s in (LATTICE[a], LATTICE[b]))
    return next((f"int{n}" for n in (8, 16, 32, 64) if n >= need), "float64")


def promote(a: str, b: str) -> str:
    """The type of an operation on ``a`` and ``b``; anything unknown is PROMOTION_UNRESOLVED.

    A Python scalar is weak: its precision never widens a concrete type, only a
    float or complex scalar above the kind of the other side does.
    """
    if a in PYTHON and b in PYTHON:
        return PYTHON[max(PYTHON.index(a), PYTHON.index(b))]
    weak, t = (a, b) if a in PYTHON else (b, a)
    if t not in LATTICE or weak not in (*PYTHON, *LATTICE):
        return UNRESOLVED
    if weak in LATTICE:
        return _join(weak, t)
    kind, bits, _ = LATTICE[t]
    if weak == "python.int" or PYTHON.index(weak) + 1 <= kind:
        return t
    if weak == "python.float":
        return "float64"
    return "complex64" if bits <= 32 else "complex128"
