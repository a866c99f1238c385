"""Small groups solved where they lie: rows of a key meet once, and a task solves thousands of groups at a time with arrays.

Groups that are too large for that, or have nulls in them, are named and left to
the caller's rounds, so none is cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from numera.operators.graph import observed

if TYPE_CHECKING:
    import numpy as np
    import pyarrow as pa

#: Rows solved at once in a task, and of one group at most.
CHUNK, LIMIT = 1 << 17, 1 << 12
PLAIN = ("tinyint", "smallint", "int", "bigint", "string")


def codes(*columns: pa.ChunkedArray) -> tuple[list[np.ndarray], Callable]:
    """Integers that are equal where the values of ``columns`` are, and what turns them back into values; nulls are any integer."""
    import numpy as np
    import pyarrow as pa

    if pa.types.is_integer(columns[0].type):
        kind = columns[0].type
        return [c.fill_null(0).to_numpy().astype(np.int64) for c in columns], lambda x: pa.array(x, pa.int64()).cast(kind)
    whole = pa.chunked_array([x for c in columns for x in c.chunks], columns[0].type).combine_chunks().dictionary_encode()
    whole = pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole
    flat = whole.indices.fill_null(0).to_numpy().astype(np.int64)
    return np.split(flat, np.cumsum([len(c) for c in columns])[:-1]), lambda x: whole.dictionary.take(pa.array(x))


def numbered(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each row, a row of each number): rows equal in all ``keys`` share one, ascending by the keys."""
    import numpy as np

    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out, order[new]


def places(owner: np.ndarray) -> np.ndarray:
    """Place of each row within its run of equal ``owner``."""
    import numpy as np

    first = np.r_[True, owner[1:] != owner[:-1]] if len(owner) else np.zeros(0, bool)
    at = np.arange(len(owner))
    return at - np.maximum.accumulate(np.where(first, at, 0)) if len(owner) else at


def gather(n: int, to: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """What ors the 64-bit sets that rows bring to ``to`` into ``n`` of them."""
    import numpy as np

    order = np.argsort(to, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(to[order]) != 0]) if len(to) else np.zeros(0, np.int64)
    ends = to[order][starts]

    def ored(sets: np.ndarray) -> np.ndarray:
        out = np.zeros(n, np.uint64)
        if len(ends):
            out[ends] = np.bitwise_or.reduceat(sets[order], starts)
        return out

    return ored


def members(sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every bit that is set."""
    import numpy as np

    rows, bits, left, k = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.flatnonzero(sets), 0
    while len(left):
        hit = left[(sets[left] >> np.uint64(k)) & np.uint64(1) > 0]
        rows.append(hit)
        bits.append(np.full(len(hit), k))
        k += 1
        left = left[(sets[left] >> np.uint64(k)) > 0] if k < 64 else left[:0]
    return np.concatenate(rows), np.concatenate(bits)


def _wholes(batches: Iterable[pa.RecordBatch], chunk: int, limit: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, rows sorted by the first column, with the number of each row's group; of a group over ``limit`` only ``limit + 1`` rows."""
    import numpy as np
    import pyarrow as pa

    held: list = []
    n = 0

    def group(t: pa.Table) -> np.ndarray:
        (k,), _ = codes(t.column(0))
        return np.cumsum(np.r_[0, k[1:] != k[:-1]])

    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= chunk:
            t = pa.Table.from_batches(held).combine_chunks()
            g = group(t)
            last = int(np.searchsorted(g, g[-1]))
            if last:
                yield t.slice(0, last), g[:last]
            rest = t.slice(last, limit + 1)
            held, n = rest.to_batches(), rest.num_rows
    if n:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, group(t)


def solve(rows: DataFrame, by: str, schema: str, solver: Callable, chunk: int | None = None, limit: int | None = None, met: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """The result of all groups that a task can solve, and the keys (by) of the others, if any.

    ``rows`` has ``by`` first; with ``met`` those of a group already stand together.  ``solver(table, g, ok)`` gets whole groups, the
    number of each row's group and, by group, whether it is to be solved; it may
    clear more of ``ok`` and returns, as Arrow arrays, numbers of groups and the
    columns of ``schema``, of which the first is never null.
    """
    chunk, limit = chunk or CHUNK, limit or LIMIT
    kind = dict(rows.dtypes)[by]
    never_null = schema.split()[0]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        for t, g in _wholes(batches, max(chunk, 2 * limit + 2), limit):
            first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            ok = np.diff(np.r_[first, len(g)]) <= limit
            own, columns = solver(t, g, ok)
            key = t.column(0).combine_chunks()
            key = pa.concat_arrays(key.chunks) if isinstance(key, pa.ChunkedArray) else key
            for lo in range(0, len(own), 1 << 16):
                yield pa.RecordBatch.from_arrays([key.take(pa.array(first[own[lo : lo + (1 << 16)]])), *(c.slice(lo, 1 << 16) for c in columns)], names)
            if not ok.all():
                bad = key.take(pa.array(first[~ok]))
                yield pa.RecordBatch.from_arrays([bad, *(pa.nulls(len(bad), c.type) for c in columns)], names)

    names = [by, *(x.split()[0] for x in schema.split(", "))]
    rows = rows.where(F.col(by).isNotNull())
    rows = rows if met else rows.repartition(F.col(by)).sortWithinPartitions(by)
    out, seen = observed(rows.mapInArrow(work, f"`{by}` {kind}, {schema}"), left=F.count(F.when(F.col(never_null).isNull(), 1)))
    return out.where(F.col(never_null).isNotNull()), out.where(F.col(never_null).isNull()).select(by) if seen["left"] else None


def plain(df: DataFrame, *columns: str) -> bool:
    """Whether the values of ``columns`` are integers or text, as ``codes`` takes them."""
    kinds = dict(df.dtypes)
    return all(kinds[c] in PLAIN for c in columns)
