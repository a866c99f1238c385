"""Alias chains, control flow and traces: pointer doubling, dataflow to a fixpoint, and the first step at which two runs differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from numera.operators import groups
from numera.operators.graph import checkpoint, components, grown, reachable, release

# fixed values: how a chain ends
RESOLVED, DANGLING, CYCLE, AMBIGUOUS = "RESOLVED", "DANGLING", "CYCLE", "AMBIGUOUS"


def resolve_aliases(aliases: DataFrame, known: DataFrame) -> DataFrame:
    """(name, end, hops, status) for every name of ``aliases`` (name, target): where its chain of targets ends.

    A chain ends at a name that is no alias: RESOLVED if ``known`` (name) has it,
    else DANGLING.  It stops at a name with several targets, AMBIGUOUS for all
    that leads there.  CYCLE: it never ends; then ``end`` is null, and ``hops``
    is 0 for the names on the cycle, null for those that lead to it.  A null
    target dangles.

    Pointers double: a round joins the open ones to what they point at, so
    chains of n names take log2(n) rounds, and closed ones are left alone.
    """
    each = aliases.where("name is not null").distinct().groupBy("name").agg(F.min("target").alias("target"), F.count(F.lit(1)).alias("targets"))
    each = checkpoint(each)
    n = each.count()
    one = each.where("targets = 1")
    start = one.select("name", F.col("target").alias("end"), F.lit(1).cast("long").alias("hops"), F.lit(True).alias("open"))
    at, step = checkpoint(start), 1
    while step <= 2 * n and not at.where("open").isEmpty():
        on = at.select(F.col("name").alias("end"), F.col("end").alias("next"), F.col("hops").alias("more"), F.col("open").alias("still"))
        moved = at.where("open").join(on, "end", "left")
        moved = moved.select("name", F.coalesce("next", "end").alias("end"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.coalesce("still", F.lit(False)).alias("open"))
        at = checkpoint(at.where("not open").unionByName(moved))
        step *= 2
    several = each.where("targets > 1").select(F.col("name").alias("end"), F.lit(True).alias("several"))
    found = at.where("not open").join(several, "end", "left").join(known.select(F.col("name").alias("end"), F.lit(True).alias("known")).distinct(), "end", "left")
    status = F.when(F.col("several"), AMBIGUOUS).when(F.col("known"), RESOLVED).otherwise(DANGLING)
    ended = found.select("name", "end", "hops", status.alias("status"))
    stuck = each.where("targets > 1").select("name", F.col("name").alias("end"), F.lit(0).cast("long").alias("hops"), F.lit(AMBIGUOUS).alias("status"))
    circling = at.where("open")
    on_cycle = circling.select(F.col("end").alias("name"), F.lit(0).cast("long").alias("hops")).distinct()
    never = circling.select("name").join(on_cycle, "name", "left").select("name", F.lit(None).cast(dict(aliases.dtypes)["target"]).alias("end"), "hops", F.lit(CYCLE).alias("status"))
    return ended.unionByName(stuck).unionByName(never)


def _dominators(t, g, ok):
    """``dominators`` of groups of at most 64 blocks, as sets of bits; rows (by, edge, src, dst) are edges and, without one, entries (src)."""
    import numpy as np
    import pyarrow as pa

    edge = t.column(1).to_numpy()
    (src, dst), value = groups.codes(t.column(2), t.column(3))
    missing = t.column(2).is_null().to_numpy() | (edge & t.column(3).is_null().to_numpy())
    ok[g[missing]] = False
    owner, code = np.r_[g, g[edge]], np.r_[src, dst[edge]]
    number, row = groups.numbered(owner, code)
    own, name = owner[row], code[row]  # by block
    place = groups.places(own)
    ok[own[place > 63]] = False
    bit = np.uint64(1) << (place & 63).astype(np.uint64)
    to, of, entry = number[len(g) :], number[: len(g)][edge], np.unique(number[: len(g)][~edge])
    use = ok[own[of]]
    to, of, entry = to[use], of[use], entry[ok[own[entry]]]
    ored = groups.gather(len(own), to)
    reached = np.zeros(len(own), np.uint64)
    reached[entry] = 1
    while ((new := reached | ored(reached[of])) != reached).any():
        reached = new
    every = np.zeros(len(ok), np.uint64)
    np.bitwise_or.at(every, own, np.where(reached > 0, bit, np.uint64(0)))
    free = np.zeros(len(own), np.uint64)  # what is avoided on some way to a block
    free[entry] = every[own[entry]] & ~bit[entry]
    while ((new := free | ored(free[of] & ~bit[to])) != free).any():
        free = new
    found = np.where(reached > 0, every[own] & ~free, np.uint64(0))
    depth = np.bitwise_count(found).astype(np.int64)
    block, k = groups.members(found)
    above = np.searchsorted(own, own[block]) + k
    return own[block], [value(name[block]), value(name[above]), pa.array(depth[above] == depth[block] - 1)]


def dominators(blocks: DataFrame, edges: DataFrame, by: str = "function") -> DataFrame:
    """(by, block, dominator, immediate): the blocks on every path from a function's entry to each block it reaches.

    ``blocks`` (by, block, entry), ``edges`` (by, src, dst).  Functions of up to
    64 blocks are solved by the task that has them, others in rounds.
    ``immediate`` marks the closest strict one.
    """
    kind = dict(edges.dtypes)["src"]
    if not groups.plain(edges, by, "src", "dst") or dict(edges.dtypes)["dst"] != kind or dict(blocks.dtypes)["block"] != kind:
        return _wide_dominators(blocks, edges, by)
    start = blocks.where("entry").select(by, F.lit(False).alias("edge"), F.col("block").alias("src"), F.lit(None).cast(kind).alias("dst"))
    done, left = groups.solve(start.unionByName(edges.select(by, F.lit(True).alias("edge"), "src", "dst")), by, f"block {kind}, dominator {kind}, immediate boolean", _dominators)
    if left is None:
        return done
    return done.unionByName(_wide_dominators(blocks.join(left, by, "left_semi"), edges.join(left, by, "left_semi"), by))


def _wide_dominators(blocks: DataFrame, edges: DataFrame, by: str) -> DataFrame:
    """``dominators`` of functions of any size, in rounds.

    What is carried is the complement: d does not dominate n if some predecessor of n, other than d
    is n, is reached without d.  Pairs only grow, and a round moves those found
    in the last one.  Rows grow with the square of one function's blocks, not
    with the number of functions.
    """
    own = checkpoint(blocks.select(by, "block", "entry").distinct())
    e = checkpoint(edges.select(by, F.col("src").alias("block"), "dst").distinct())
    start = own.where("entry").select(by, "block")
    front, rounds = checkpoint(start.distinct()), 1
    reached = front
    while not front.isEmpty():
        front = checkpoint(front.join(e, [by, "block"]).select(by, F.col("dst").alias("block")).distinct().join(reached, [by, "block"], "left_anti"))
        release(front.sparkSession)
        rounds, reached = rounds + 1, grown(reached, front, rounds)
    others = reached.select(by, F.col("block").alias("d"))
    free = checkpoint(start.join(others, by).where("d != block"))  # d is avoided on the way to block
    front = free
    while not front.isEmpty():
        step = front.join(e, [by, "block"]).where("dst != d").select(by, F.col("dst").alias("block"), "d").distinct()
        front = checkpoint(step.join(free, [by, "block", "d"], "left_anti"))
        release(front.sparkSession)
        rounds, free = rounds + 1, grown(free, front, rounds)
    every = reached.join(others, by).join(free, [by, "block", "d"], "left_anti")
    every = checkpoint(every.select(by, "block", F.col("d").alias("dominator")))
    depth = every.groupBy(by, "block").agg(F.count(F.lit(1)).alias("depth"))
    at = every.join(depth.select(by, F.col("block").alias("dominator"), F.col("depth").alias("above")), [by, "dominator"]).join(depth, [by, "block"])
    return at.select(by, "block", "dominator", (F.col("above") == F.col("depth") - 1).alias("immediate"))


def _reaching(t, g, ok):
    """``reaching_definitions`` of groups of at most 64 definitions, as sets of bits; rows (by, edge, src, dst, definition, variable) are edges or definitions at src."""
    import numpy as np

    edge, none = t.column(1).to_numpy(), [t.column(k).is_null().to_numpy() for k in range(2, 6)]
    (src, dst), block = groups.codes(t.column(2), t.column(3))
    (defined,), definition = groups.codes(t.column(4))
    (variable,), _ = groups.codes(t.column(5))
    ok[g[none[0] | np.where(edge, none[1], none[2] | none[3])]] = False
    number, row = groups.numbered(np.r_[g, g[edge]], np.r_[src, dst[edge]])
    own, name = np.r_[g, g[edge]][row], np.r_[src, dst[edge]][row]  # by block
    at, to, of = number[: len(g)][~edge], number[len(g) :], number[: len(g)][edge]
    g, defined, variable = g[~edge], defined[~edge], variable[~edge]
    item, row = groups.numbered(g, defined, variable)
    place = groups.places(g[row])
    ok[g[row][place > 63]] = False
    bit = np.uint64(1) << (place & 63).astype(np.uint64)
    named, each = groups.numbered(g, variable)
    alike = groups.gather(len(each), named)(bit[item])  # definitions of a variable
    made, killed = groups.gather(len(own), at)(bit[item]), groups.gather(len(own), at)(alike[named])
    use = ok[own[of]]
    to, of = to[use], of[use]
    ored = groups.gather(len(own), to)
    inside = np.zeros(len(own), np.uint64)
    while ((new := inside | ored((made | inside & ~killed)[of])) != inside).any():
        inside = new
    here, k = groups.members(inside)
    which = row[np.searchsorted(g[row], own[here]) + k]
    _, once = groups.numbered(here, defined[which])  # one of two variables is one definition
    return own[here[once]], [block(name[here[once]]), definition(defined[which[once]])]


def reaching_definitions(edges: DataFrame, definitions: DataFrame, by: str = "function") -> DataFrame:
    """(by, block, definition): the definitions that may still hold where a block begins.

    ``edges`` (by, src, dst), ``definitions`` (by, block, definition, variable).
    A block's last word counts: it passes on its own definitions and those that
    came in of variables it does not define.  Functions of up to 64 definitions
    are solved by the task that has them, others in rounds.
    """
    e, d = dict(edges.dtypes), dict(definitions.dtypes)
    if not (groups.plain(edges, by, "src") and groups.plain(definitions, "definition", "variable") and e["src"] == e["dst"] == d["block"]):
        return _wide_reaching(edges, definitions, by)
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    rows = edges.select(by, F.lit(True).alias("edge"), "src", "dst", none("definition", d["definition"]), none("variable", d["variable"]))
    rows = rows.unionByName(definitions.select(by, F.lit(False).alias("edge"), F.col("block").alias("src"), none("dst", e["src"]), "definition", "variable"))
    done, left = groups.solve(rows, by, f"block {e['src']}, definition {d['definition']}", _reaching)
    if left is None:
        return done
    return done.unionByName(_wide_reaching(edges.join(left, by, "left_semi"), definitions.join(left, by, "left_semi"), by))


def _wide_reaching(edges: DataFrame, definitions: DataFrame, by: str) -> DataFrame:
    """``reaching_definitions`` of functions of any size, in rounds."""
    e = checkpoint(edges.select(by, "src", "dst").distinct())
    gen = checkpoint(definitions.select(by, F.col("block").alias("src"), "definition", "variable").distinct())
    kills = gen.select(by, F.col("src").alias("block"), "variable").distinct()
    arrive = lambda out: out.join(e, [by, "src"]).select(by, F.col("dst").alias("block"), "definition", "variable").distinct()
    front, rounds = checkpoint(arrive(gen)), 1
    inside = front
    while not front.isEmpty():
        passed = front.join(kills, [by, "block", "variable"], "left_anti").withColumnRenamed("block", "src")
        front = checkpoint(arrive(passed).join(inside, [by, "block", "definition"], "left_anti"))
        release(front.sparkSession)
        rounds, inside = rounds + 1, grown(inside, front, rounds)
    return inside.select(by, "block", "definition")


def _digest(value: Column) -> list[Column]:
    """Sums of two 64-bit hashes of rows: equal for equal sets of rows, whatever their order, and added up before they are shuffled."""
    return [F.sum(F.xxhash64(*([F.lit(s)] if s else []), value).cast("decimal(38,0)")) for s in (0, 1)]


def first_divergence(expected: DataFrame, actual: DataFrame, by: str, step: str, value: str, fan: int = 64, levels: int = 3) -> DataFrame:
    """(by, step, expected, actual) of the first step at which the runs of an output differ; a step one run lacks has a null value there.

    Rows (by, step >= 0, value), one per step.  Both runs are cut into blocks of
    ``fan ** levels`` steps and compared by sums of hashes; only the first block
    of each output that differs is cut again, down to single steps, which are
    compared by value.  So what is shuffled is a digest per block, then the rows
    of one block per output.
    """
    side = lambda df, k: df.select(by, F.col(step).cast("long").alias("step"), F.col(value).alias("value"), F.lit(k).alias("side"))
    rows = side(expected, 0).unionByName(side(actual, 1))
    for level in range(levels, 0, -1):
        size = fan**level
        block = F.floor(F.col("step") / size)
        a, b = _digest(F.struct("step", "value"))
        sums = rows.groupBy(by, block.alias("block"), "side").agg(F.count(F.lit(1)).alias("n"), a.alias("a"), b.alias("b"))
        both = sums.groupBy(by, "block").agg(*(F.max(F.when(F.col("side") == k, F.struct("n", "a", "b"))).alias(f"s{k}") for k in (0, 1)))
        first = both.where(~F.col("s0").eqNullSafe(F.col("s1"))).groupBy(by).agg(F.min("block").alias("block"))
        rows = checkpoint(rows.join(first.withColumnRenamed("block", "__block"), by).where(block == F.col("__block")).drop("__block"))
    value_of = lambda k: F.max(F.when(F.col("side") == k, F.struct("value"))).alias(f"v{k}")
    pairs = rows.groupBy(by, "step").agg(value_of(0), value_of(1)).where(~F.col("v0").eqNullSafe(F.col("v1")))
    return pairs.groupBy(by).agg(F.min_by(F.struct("step", F.col("v0.value").alias("expected"), F.col("v1.value").alias("actual")), "step").alias("x")).select(by, "x.step", "x.expected", "x.actual")


def divergence_roots(divergent: DataFrame, lineage: DataFrame) -> DataFrame:
    """(id, root, distance): each divergent output with the divergent one it inherits from, the nearest without a divergent input.

    ``divergent`` (id), ``lineage`` (src, dst: dst is computed from src).  Ties:
    the smallest root.  Outputs on a cycle of divergent ones alone have none.
    """
    bad = checkpoint(divergent.select("id").distinct())
    e = lineage.join(bad.withColumnRenamed("id", "src"), "src", "left_semi").join(bad.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst").where("src != dst").distinct()
    e = checkpoint(e)
    front = found = checkpoint(bad.join(e.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").select("id", F.col("id").alias("root"), F.lit(0).alias("distance")))
    while not front.isEmpty():
        step = front.join(e.withColumnRenamed("src", "id"), "id").groupBy("dst").agg(F.min("root").alias("root"), F.min("distance").alias("distance"))
        new = step.select(F.col("dst").alias("id"), "root", (F.col("distance") + 1).alias("distance")).join(found, "id", "left_anti")
        front = checkpoint(new)
        found = checkpoint(found.unionByName(front))
    return bad.join(found, "id", "left")


_END = 1 << 62


def _slices(t, g, ok):
    """``backward_slice`` of whole groups; rows (by, kind, pos, name, other) are sets (0), reads (1, at ``_END`` what is wanted) and aliases (2)."""
    import numpy as np
    import pyarrow as pa

    kind, pos = t.column(1).to_numpy(), t.column(2).fill_null(0).to_numpy()
    (name, other), _ = groups.codes(t.column(3), t.column(4))
    none = [t.column(k).is_null().to_numpy() for k in (2, 3, 4)]
    sets, reads, pairs = (kind == k for k in range(3))
    ok[g[none[1] | np.where(pairs, none[2], none[0])]] = False
    number, row = groups.numbered(np.r_[g, g[pairs]], np.r_[name, other[pairs]])
    u, v = number[: len(g)][pairs], number[len(g) :]
    u, v = u[u != v], v[u != v]
    label, shared = np.arange(len(row)), np.zeros(len(row), bool)
    shared[u] = shared[v] = True
    while True:  # names that may be one object get the least of their numbers
        new, low = label.copy(), np.minimum(label[u], label[v])
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        if (new == label).all():
            break
        label = new[new]
    named = number[: len(g)]
    rank = np.unique(pos, return_inverse=True)[1].astype(np.int64)
    width = int(rank.max(initial=0)) + 1
    key = label[named] * width + rank
    statement, one = groups.numbered(np.r_[g[sets], g[reads]], np.r_[pos[sets], pos[reads]])
    of, at = statement[: sets.sum()], statement[sets.sum() :]
    order = np.argsort(key[sets], kind="stable")
    there, of = key[sets][order], of[order]
    lo, hi = np.searchsorted(there, label[named[reads]] * width), np.searchsorted(there, key[reads])
    some, every = hi > lo, shared[named[reads]]
    needed = np.zeros(len(one), bool)
    needed[at[(pos[reads] == _END) & ok[g[reads]]]] = True
    while True:
        live, new = needed[at] & some, needed.copy()
        new[of[hi[live & ~every] - 1]] = True  # the last one before
        span = np.bincount(lo[live & every], minlength=len(of) + 1) - np.bincount(hi[live & every], minlength=len(of) + 1)
        new[of[np.cumsum(span)[: len(of)] > 0]] = True  # all before
        if (new == needed).all():
            break
        needed = new
    is_set = np.zeros(len(one), bool)
    is_set[of] = True
    found = one[needed & is_set]
    return np.r_[g[sets], g[reads]][found], [pa.array(np.r_[pos[sets], pos[reads]][found], pa.int64())]


def backward_slice(assigns: DataFrame, loads: DataFrame, aliases: DataFrame, required: DataFrame, by: str = "function") -> DataFrame:
    """(by, pos): the statements of straight-line functions that the required names depend on.

    ``assigns`` and ``loads`` (by, pos, name) say what a statement at ``pos``
    sets and reads, ``aliases`` (by, name, other) which names may be one object,
    ``required`` (by, name) what is wanted at the end.  A read depends on the
    last statement before it that sets the name; of names with aliases on every
    earlier one that sets any of the group, as none is known to replace another.
    Functions of up to ``groups.LIMIT`` rows are solved by the task that has them.
    """
    kinds = {d[c] for df, cols in ((assigns, ["name"]), (loads, ["name"]), (required, ["name"]), (aliases, ["name", "other"])) for d in [dict(df.dtypes)] for c in cols}
    if len(kinds) > 1 or not kinds <= {*groups.PLAIN} or not all(groups.plain(df, by) for df in (assigns, loads, aliases, required)):
        return _wide_slice(assigns, loads, aliases, required, by)
    kind, none = kinds.pop(), F.lit(None)
    row = lambda df, k, pos, other: df.select(by, F.lit(k).alias("kind"), pos.cast("long").alias("pos"), "name", other.cast(kind).alias("other"))
    rows = row(assigns, 0, F.col("pos"), none).union(row(loads, 1, F.col("pos"), none)).union(row(required, 1, F.lit(_END), none)).union(row(aliases, 2, none, F.col("other")))
    done, left = groups.solve(rows, by, "pos bigint", _slices)
    if left is None:
        return done
    return done.unionByName(_wide_slice(*(df.join(left, by, "left_semi") for df in (assigns, loads, aliases, required)), by))


def _wide_slice(assigns: DataFrame, loads: DataFrame, aliases: DataFrame, required: DataFrame, by: str) -> DataFrame:
    """``backward_slice`` of functions of any size, in rounds."""
    tag = lambda c: F.concat_ws("/", F.col(by).cast("string"), F.col(c).cast("string"))
    pairs = aliases.where("name != other").select(tag("name").alias("src"), tag("other").alias("dst"))
    grouped = components(pairs.select(F.col("src").alias("id")).union(pairs.select("dst")).distinct(), pairs)
    named = lambda df, *cols: df.select(by, *cols, tag("name").alias("id")).join(grouped, "id", "left").select(by, *cols, F.coalesce("component", "id").alias("v"), F.col("component").isNotNull().alias("shared"))
    sets = checkpoint(named(assigns, F.col("pos").cast("long").alias("pos")).distinct())
    end = F.lit(_END).cast("long")
    reads = named(loads, F.col("pos").cast("long").alias("pos")).unionByName(named(required.withColumn("pos", end), "pos")).distinct()
    release(sets.sparkSession)
    before = reads.select(by, F.col("pos").alias("at"), "v", "shared").join(sets.select(by, "v", "pos"), [by, "v"]).where("pos < at")
    last = before.groupBy(by, "v", "at").agg(F.max("pos").alias("last"))
    uses = before.join(last, [by, "v", "at"]).where("shared or pos = last").select(tag("at").alias("src"), tag("pos").alias("dst"))
    start = required.select(by).distinct().withColumn("at", end).select(tag("at").alias("id"))
    found = reachable(checkpoint(uses.distinct()), start).withColumnRenamed("id", "s")
    return sets.select(by, "pos").distinct().withColumn("s", tag("pos")).join(found, "s", "left_semi").select(by, "pos")
