"""Embedding near-duplicates by collision counting over one-dimensional projections.

Unit vectors are projected on orthonormal directions.  For a linked pair the
squared distance is at most ``2 - 2 * threshold``, and the squared differences
along orthonormal directions add up to no more than it.  So along every
direction the difference is at most the distance, and it exceeds a window of
half-width ``h`` along at most ``floor(d2 / h**2)`` directions: a pair that
collides in fewer windows than the rest cannot be linked.  The count asked for
is therefore calibrated to a recall of one.  The candidates of a query are a
window of a sorted projection; its window in each other projection is looked up
as a row of bits, one per candidate outside of it, the misses are counted in a
few planes of bits, and those that reach the count are verified by their cosine
in double precision.

Labels of up to ``WHOLE`` vectors are compared that way as they are, by pairs of
tiles.  Larger ones are dealt first, by tables of ``g`` random rotations each: a
vector's cell is the direction of its largest projection in each rotation, and
vectors of one cell are compared.  ``g`` grows with the logarithm of the label,
and so many tables are used that a pair at the threshold, which shares a cell
with the same probability wherever it lies, shares none with one under ``MISS``.
A pair counts in the first table where it shares a cell.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from numera.llm.common import components, cut, finite_vector, link_labels, list_matrix, release, run_bounds, whole_runs

THRESHOLD = 0.98
PROJECTIONS = 24
TILE = 32_768
#: Words of 64 candidates counted at once.
BLOCK = 512
#: Cells of a projection in half a window, and one that is outside of all.
STEPS, FAR_CELL = 8, 1 << 20
#: Pairs up to which each window is held against each pair, without tables of windows.
FEW_PAIRS = 4096
SEED = 20240607
#: Vectors of a label that are compared without dealing, and dimensions from which larger ones are dealt.
WHOLE, LEAST_DIM = 524_288, 24
#: Pairs that are worth a task of their own, and tasks at most.
TASK_PAIRS, MOST_PARTS = 10_000_000, 4096
#: Rows of counts that are sent to every executor.
FEW_LABELS = 10_000
MISS = 1e-9


@functools.lru_cache(maxsize=64)
def directions(dim: int, count: int, seed: int = SEED) -> np.ndarray:
    """``min(dim, count)`` orthonormal directions as columns, alike on every machine."""
    q, _ = np.linalg.qr(np.random.default_rng(seed + dim).standard_normal((dim, dim)))
    return q[:, : min(dim, count)]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_dim(rows: list[np.ndarray]):
    dims = np.array([len(r) for r in rows])
    for d in np.unique(dims):
        own = np.flatnonzero(dims == d)
        yield int(d), own, _unit(np.stack([rows[i] for i in own]))


def _counts(dim: int, threshold: float, projections: int) -> tuple[int, int, float]:
    """(directions counted, bits of the counter, half-width of a window): a linked pair misses at most ``2**bits - 1`` windows."""
    d2 = max(2 - 2 * threshold, 1e-6)
    m = min(dim, max(projections, 3 * dim // 8))
    # a window about as wide as the differences of unrelated vectors tells most
    bits = min(max(0, round(math.log2(d2 * dim / 1.28))), m.bit_length() - 1)
    return m, bits, math.sqrt(d2 / 2**bits) * (1 + 1e-9)


def _outside(at: np.ndarray, low: int, high: int) -> np.ndarray:
    """Row v - low: a bit for every cell of ``at`` that lies outside the window around cell v, in words of 64."""
    first = np.arange(low - STEPS, high - STEPS + 1, dtype=np.int32)
    out = np.empty((len(first), len(at) // 64), np.uint64)
    for r in range(0, len(first), 16):
        far = (at[None, :] - first[r : r + 16, None]).view(np.uint32) > 2 * STEPS
        out[r : r + 16] = np.packbits(far, axis=1, bitorder="little").view(np.uint64)
    return out


def collide(x: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, projections: int, seen: list | None = None):
    """Yield (i, j) index arrays of the pairs of ``left`` x ``right`` rows of ``x`` with cosine >= threshold; ``seen`` gets how many pairs were counted and verified.

    Given one array for both, a pair is counted once and yielded from both ends.
    """
    m, bits, h = _counts(x.shape[1], threshold, projections)
    reach = math.sqrt(max(2 - 2 * threshold, 1e-6)) * (1 + 1e-9)
    p = x @ directions(x.shape[1], m)
    once = left is right
    if len(left) * len(right) <= FEW_PAIRS:
        i, j = np.nonzero((np.abs(p[left][:, None] - p[right][None]) > h).sum(axis=2) < 2**bits)
        if once:
            i, j = i[j > i], j[j > i]
        if seen is not None:
            seen.append((len(left) * len(right), len(i)))
        i, j = left[i], right[j]
        yield from _ends(i, j, np.einsum("ij,ij->i", x[i], x[j]) >= threshold, once)
        return
    left, right = (some[np.argsort(p[some, 0], kind="stable")] for some in (left, right))
    if not len(left) or not len(right):
        return
    line = p[right, 0]
    at = np.floor(p / (max(h, 0.02) * (1 + 1e-6) / STEPS)).astype(np.int32)
    pad = np.full(-len(right) % 64, FAR_CELL, np.int32)
    base = at[left].min(axis=0)
    facing = x[right]
    missed = [_outside(np.concatenate([at[right, k], pad]), int(base[k]), int(at[left, k].max())) for k in range(m)]
    rows = at[left] - base
    held: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0
    b = 0
    while b < len(left):
        s, _ = np.searchsorted(line, [p[left[b], 0] - reach, 0])
        s = max(int(s), b) if once else int(s)
        q = left[b : b + max(16, BLOCK * 64 // max(64, len(right) - s) * 16)]
        e = int(np.searchsorted(line, p[q[-1], 0] + reach, side="right"))
        w0, w1 = s // 64, -(-e // 64)
        if w0 < w1:
            lost = np.zeros((len(q), w1 - w0), np.uint64)
            planes = [np.zeros_like(lost) for _ in range(bits)]
            for k in range(m):
                add = missed[k][rows[b : b + len(q), k], w0:w1]
                for plane in planes:
                    carry = plane & add
                    plane ^= add
                    add = carry
                lost |= add
            r, w = np.nonzero(~lost)
            bit = np.unpackbits((~lost[r, w]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            t, o = np.nonzero(bit)
            i, j = r[t] + b, (w[t] + w0) * 64 + o
            if once:
                later = j > i
                i, j = i[later], j[later]
            if seen is not None:
                seen.append((len(q) * (e - s), len(i)))
            if len(i) * 8 > len(q) * (w1 - w0) * 64:
                # so many are left that the whole block is told sooner
                cos = (x[q] @ facing[w0 * 64 : w1 * 64].T)[i - b, j - w0 * 64]
                near = np.flatnonzero(np.abs(cos - threshold) < 1e-12)
                i, j = left[i], right[j]
                cos[near] = np.einsum("ij,ij->i", x[i[near]], x[j[near]])
                yield from _ends(i, j, cos >= threshold, once)
            elif len(i):
                held.append((left[i], right[j]))
                waiting += len(i)
        b += len(q)
        if held and (waiting >= 1 << 15 or b >= len(left)):
            i, j = (np.concatenate(z) for z in zip(*held))
            held, waiting = [], 0
            for t in range(0, len(i), 1 << 15):
                a, z = i[t : t + (1 << 15)], j[t : t + (1 << 15)]
                yield from _ends(a, z, np.einsum("ij,ij->i", x[a], x[z]) >= threshold, once)


def _ends(i: np.ndarray, j: np.ndarray, ok: np.ndarray, once: bool):
    ok &= i != j
    i, j = i[ok], j[ok]
    if len(i):
        yield i, j
        if once:
            yield j, i


@functools.lru_cache(maxsize=32)
def _alike(dim: int, threshold: float) -> float:
    """A lower bound of how likely a pair at the threshold has its largest projection along the same direction of a random rotation."""
    r = np.random.default_rng((SEED, dim))
    x, y = r.standard_normal((2, 20_000, dim))
    x = _unit(x)
    y = _unit(y - (x * y).sum(axis=1, keepdims=True) * x)
    y = threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * y
    same = float((_largest(x) == _largest(y)).mean())
    return max(1e-6, same - 4 * math.sqrt(same * (1 - same) / len(x)))


def _largest(p: np.ndarray) -> np.ndarray:
    """The direction, with its sign, of the largest projection of every row."""
    a = np.abs(p).argmax(axis=1)
    return 2 * a + (p[np.arange(len(p)), a] > 0)


def shape(n: int, dim: int, threshold: float, whole: int = WHOLE) -> tuple[int, int]:
    """(rotations a table, tables) for ``n`` vectors of one label; (0, 1) if they are compared as they are."""
    if n <= whole or dim < LEAST_DIM:
        return 0, 1
    g = max(1, math.ceil(math.log(n / whole * 64) / math.log(2 * dim)))
    tables = math.ceil(math.log(MISS) / math.log1p(-(_alike(dim, threshold) ** g)))
    return (g, tables) if tables < n / whole * (WHOLE // TILE) else (0, 1)


def cells(x: np.ndarray, g: int, tables: int, threshold: float) -> np.ndarray:
    """(n, tables): the cell of every row of ``x`` in every table."""
    if not g:
        return np.zeros((len(x), 1), np.int64)
    dim = x.shape[1]
    out = np.zeros((len(x), tables), np.int64)
    for t in range(tables):
        for k in range(g):
            out[:, t] = out[:, t] * (2 * dim) + _largest(x @ directions(dim, dim, SEED + 1009 * (1 + t * g + k)))
    return out


def links(classes: DataFrame, threshold: float = THRESHOLD, projections: int = PROJECTIONS, tile: int = TILE, whole: int = WHOLE) -> DataFrame:
    """(rep, n, root): for each cell a class was compared in, the vectors it links to and the group there."""
    kind = dict(classes.dtypes)["v"]
    counts = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    large = (F.col("n") > whole) & (F.col("dim") >= LEAST_DIM)
    tiles = F.ceil(F.col("n") / tile).cast("int")
    kinds, units, work, most = counts.agg(F.count(F.lit(1)), F.sum(tiles * (tiles + 1) / 2), F.sum(F.col("n") * F.least("n", F.lit(whole)).cast("double")), F.max(F.when(large, F.col("n")))).first()
    parts = (work or 0) // TASK_PAIRS
    parts = max(parts, classes.sparkSession.sparkContext.defaultParallelism) if most else min(parts, 2 * (units or 0))
    parts = int(max(1, min(MOST_PARTS, parts)))

    def deal(batches):
        for b in batches:
            rows = list_matrix(b.column(b.schema.get_field_index("v")))
            m = b.column(b.schema.get_field_index("m")).fill_null(0).to_numpy()
            idx, key, table = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for d, own, x in _by_dim(rows):
                for n in np.unique(m[own]):
                    some = np.flatnonzero(m[own] == n)
                    g, t = shape(int(n), d, threshold, whole)
                    at = cells(x[some], g, t, threshold)
                    idx.append(np.repeat(own[some], t))
                    key.append(at.ravel())
                    table.append(np.tile(np.arange(t, dtype=np.int32), len(some)))
            out = b.take(pa.array(np.concatenate(idx)))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate(key)), pa.array(np.concatenate(table))], [*out.schema.names, "key", "table"])

    asked = classes.join(F.broadcast(counts) if kinds <= FEW_LABELS else counts, ["label", "dim"])
    as_is = asked.where(~large).select("label", "dim", F.lit(0).alias("table"), F.lit(0).cast("long").alias("key"), "n", F.lit(None).cast("long").alias("m"), "rep", "c", "v")
    group = ["label", "dim", "table", "key"]
    ready = as_is
    if most:
        dealt = asked.where(large).select("label", "dim", F.col("n").alias("m"), "rep", "c", "v").mapInArrow(deal, f"label long, dim int, m long, rep long, c long, v {kind}, key long, table int")
        size = dealt.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        ready = as_is.unionByName(dealt.join(size, group))
    pairs = (
        ready
        .withColumn("t", F.pmod(F.xxhash64("rep"), tiles).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), tiles - 1)))
        .select(*group, F.least("t", "o").alias("ta"), F.greatest("t", "o").alias("tb"), "t", "m", "rep", "c", "v")
    )
    keys = [*group, "ta", "tb"]

    def run(batches):
        for t in whole_runs(batches, keys):
            cols = [t.column(k).to_numpy() for k in keys]
            mine, rep, c = (t.column(k).to_numpy() for k in ("t", "rep", "c"))
            m = t.column("m").combine_chunks().fill_null(0).to_numpy()
            rows = list_matrix(t.column("v"))
            at = run_bounds(*cols)
            for s, e in zip(at[:-1], at[1:]):
                x = _unit(np.stack(rows[s:e]))
                ids, table = rep[s:e], int(cols[2][s])
                before = None
                every = np.arange(e - s)
                own = cols[4][s] == cols[5][s]
                left, right = (every, every) if own else (every[mine[s:e] == cols[4][s]], every[mine[s:e] == cols[5][s]])
                n, order = np.zeros(e - s, np.int64), np.argsort(ids, kind="stable")
                place = np.empty(e - s, np.int64)
                place[order] = every
                lab = every.copy()
                for i, j in collide(x, left, right, threshold, projections):
                    if table and before is None:
                        before = cells(x, shape(int(m[s]), x.shape[1], threshold, whole)[0], table, threshold)
                    if table:
                        new = ~(before[i] == before[j]).any(axis=1)
                        i, j = i[new], j[new]
                    np.add.at(n, i, c[s + j])
                    if not own:  # a tile against itself meets each pair from both ends
                        np.add.at(n, j, c[s + i])
                    link_labels(e - s, lab, place[i], place[j])
                hit = np.flatnonzero(n)
                if len(hit):
                    root = ids[order[lab[place[hit]]]]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(n[hit]), pa.array(root)], ["rep", "n", "root"])

    return pairs.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, "rep long, n long, root long")


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, projections: int = PROJECTIONS
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Rows of one label link at cosine >= ``threshold`` (double precision).  Rows
    with a null label, and vectors that are null, empty, zero, or hold null or
    non-finite components, link with nothing; neither do vectors of different
    length.  Identical vectors of a label form one class, so they are compared
    once.  Rows repeated under one id are vectors of their own, each in the
    component of its vector, named by the smallest id there; a null id links with
    nothing.  An empty table gives an empty result.  Extra columns are not read.
    """
    kind = "array<float>" if dict(vectors.dtypes)[vec_col] == "array<float>" else "array<double>"
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast(kind).alias("v"))
    usable = finite_vector("v") & F.exists("v", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    v = v.withColumn("v", F.when(F.coalesce(usable, F.lit(False)), F.col("v")))
    # vectors are sorted by their hash first: comparing whole arrays is slow
    v = v.withColumn("vh", F.xxhash64("v"))
    classes = v.where("v is not null").groupBy("label", "vh", "v").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("c")).withColumn("dim", F.size("v"))
    # written, so the numbers hold
    classes = cut(classes.withColumn("rep", F.monotonically_increasing_id()), "embedding")
    linked = cut(links(classes, threshold, projections), "links")
    release(vectors.sparkSession)
    comp = components(linked.select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    near = linked.groupBy("rep").agg(F.sum("n").alias("n"))
    grouped = classes.join(near, "rep", "left").join(comp, F.col("rep") == F.col("node"), "left").withColumn("root", F.coalesce("root", "rep"))
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    named = grouped.join(least, "root").select("label", "vh", "v", (F.coalesce("n", F.lit(0)) + F.col("c") - 1).alias("n_links"), "component_id")
    out = v.join(named, ["label", "vh", "v"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
