"""Paths, depths, roots, descendants and cycles of parent-child links of unknown depth.

Nodes are sorted by id over the cluster and cut into fragments of at most ``fragment_rows`` neighbours, which keeps most parents
near. Inside a fragment every chain of parents is contracted to its exit, the last node inside. What remains to be solved is the
quotient forest of the nodes that some other fragment names as parent. It is contracted in the same way as long as that at
least halves it. Where ids say nothing about kinship it does not; then fragments are a node with those of its children
that a coin of their hashes gives to it, found by a join: a quarter of every chain falls away per round, whatever the ids.
No task ever holds more than one fragment. Once the quotient is no larger than one fragment it is solved whole. Then the answers
are carried back, level by level. A cycle inside a fragment shows in its contraction; one that runs through several
fragments is a cycle inside a fragment of some quotient.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from skein.functions.tables import durable

FRAGMENT_ROWS = 50_000
FRAGMENT_VALUES = 1 << 24  # ids in the paths of a fragment's nodes
MOST_PARTS = 10_000  # tasks of one pass over all nodes, each of which takes its fragments one by one
PATH_VALUES = 1 << 20  # ids in a batch of paths that leaves a task, about


def parent_links(tasks: DataFrame) -> DataFrame:
    """``trace_id, task_id, parent_id``: one row per task, its parent or null.

    Of several rows of a task the one with the newest ``loaded_at`` counts (null is oldest; among equals the one with the
    largest parent, then children list). The parent is ``parent_id`` or, where that is null or 0, the task whose ``children``
    name it (of several the smallest id). Rows without a task_id are left out.
    """
    newest = F.max_by(F.struct("parent_id", "children"), F.struct(F.col("loaded_at").isNotNull(), "loaded_at", "parent_id", "children"))
    rows = tasks.where("task_id is not null").groupBy("trace_id", "task_id").agg(newest.alias("_x")).select("trace_id", "task_id", F.expr("nullif(_x.parent_id, 0)").alias("parent_id"), "_x.children")
    named = rows.select("trace_id", F.col("task_id").alias("_by"), F.explode("children").alias("_child")).groupBy("trace_id", "_child").agg(F.min("_by").alias("_by"))
    lone = rows.where("parent_id is null").select("trace_id", "task_id")
    lone = lone.join(named, lone.trace_id.eqNullSafe(named.trace_id) & (lone.task_id == named._child), "left").select(lone.trace_id, "task_id", F.col("_by").alias("parent_id"))
    return rows.where("parent_id is not null").select("trace_id", "task_id", "parent_id").unionByName(lone)


def _climb(parent: np.ndarray, weight: np.ndarray, low: np.ndarray):
    """For each node by pointer doubling: the exit (or a node on its cycle), the weight and the least ``low`` up to it, whether it ends."""
    n = len(parent)
    own = np.arange(n)
    up = np.where(parent < 0, own, parent)
    far = np.where(parent < 0, 0, weight)
    least = np.where(parent < 0, np.iinfo(np.int64).max, low)
    for _ in range(max(1, int(n).bit_length())):
        far, least, up = far + far[up], np.minimum(least, least[up]), up[up]
    ends = parent[up] < 0
    return up, np.where(ends, far + weight[up], 0), np.where(ends, np.minimum(least, low[up]), least[up]), ends


def _placed(t: pa.Table, named: str) -> tuple[pa.Table, np.ndarray]:
    """The rows in order of trace and id, and the position of each row's named parent, -1 where it is not among them."""
    codes = t.column("trace_id").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    ids, up = t.column("id").to_numpy(), t.column(named).fill_null(0).to_numpy()
    every = np.unique(np.concatenate([ids, up]))
    key = codes * len(every) + np.searchsorted(every, ids)
    wanted = codes * len(every) + np.searchsorted(every, up)
    order = np.argsort(key)
    key, wanted = key[order], wanted[order]
    t = t.take(pa.array(order))
    at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
    return t, np.where(t.column(named).is_valid().to_numpy() & (key[at] == wanted), at, -1)


def _ancestors(parent: np.ndarray, nodes: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The first ``many`` nodes of each node's chain, itself first, one after another; filled by doubling."""
    start = np.cumsum(many) - many
    step = np.arange(many.sum()) - np.repeat(start, many)
    out = np.repeat(nodes, many)
    up, reach = parent, 1
    while len(step) and reach <= int(step.max()):
        here = np.flatnonzero((step >= reach) & (step < 2 * reach))
        out[here] = up[out[here - reach]]
        up, reach = np.where(up >= 0, up[np.maximum(up, 0)], -1), 2 * reach
    return out


def _joined_paths(parent: np.ndarray, ends: np.ndarray, old: pa.ListArray) -> Iterator[tuple[int, int, pa.ListArray]]:
    """``from, to, paths``: for each node whose chain ends, the paths of its chain's nodes one after another, in batches of bounded size."""
    flat, starts = old.flatten().to_numpy(), old.offsets.to_numpy()
    starts = starts - starts[0]
    size = np.diff(starts).astype(np.int64)
    once = np.ones(len(parent), np.int64)
    hops, whole = (np.where(ends, _climb(parent, x, x)[1], 0) for x in (once, size))
    at, done = 0, np.cumsum(np.maximum(whole, hops))
    while at < len(parent):
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PATH_VALUES, "right")))
        chain = _ancestors(parent, np.arange(at, to), hops[at:to])
        pieces = size[chain]
        pos = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces) + np.repeat(starts[chain].astype(np.int64), pieces)
        offsets = np.concatenate([[0], np.cumsum(whole[at:to])]).astype(np.int32)
        yield at, to, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[pos], pa.int64()))
        at = to


def _name(trace: str | None, first: int) -> int:
    """The number of a fragment, by its first node."""
    return int.from_bytes(hashlib.blake2b(f"{trace} {first}".encode(), digest_size=8).digest(), "little", signed=True)


class _Contract:
    """Cuts sorted nodes into fragments, one at a time, and contracts each to its exits."""

    def __init__(self, rows: int, with_paths: bool, names: list[str]):
        self.rows, self.with_paths, self.names = rows, with_paths, names

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, values = [], 0, 0
        for b in batches:
            long = np.cumsum(pc.list_value_length(b.column("path")).to_numpy()) if self.with_paths else np.zeros(b.num_rows, np.int64)
            at = 0
            while at < b.num_rows:
                before = int(long[at - 1]) if at else 0
                to = min(at + self.rows - size, int(np.searchsorted(long, before + FRAGMENT_VALUES - values, "right")))
                if to > at or not held:
                    to = max(to, at + 1)
                    held.append(b.slice(at, to - at))
                    size, values, at = size + to - at, values + int(long[to - 1]) - before, to
                if at < b.num_rows or size == self.rows:
                    yield from self.contract(pa.Table.from_batches(held))
                    held, size, values = [], 0, 0
        if held:
            yield from self.contract(pa.Table.from_batches(held))

    def contract(self, t: pa.Table) -> Iterator[pa.RecordBatch]:
        t, parent = _placed(t, "up")
        ids, named = t.column("id").to_numpy(), t.column("up").fill_null(0).to_numpy()
        has = t.column("up").is_valid().to_numpy()
        exit_, far, least, ends = _climb(parent, t.column("steps").to_numpy(), t.column("low").to_numpy())
        tops = t.column("top").to_numpy()
        # an entry whose chain never ends, as a finer level found, ends its chain here and hands its cycle on
        known, lost = t.column("cycle").fill_null(0).to_numpy(), t.column("cycle").is_valid().to_numpy()
        on = np.zeros(len(ids), bool)
        on[exit_[~ends]] = True
        away = ends & has[exit_]
        cols = {
            "trace_id": t.column("trace_id").combine_chunks(),
            "id": pa.array(ids),
            "up": pa.array(named[exit_], mask=~away),
            "steps": pa.array(far),
            "low": pa.array(least),
            "top": pa.array(tops[exit_]),
            "cycle": pa.array(np.where(ends, known[exit_], least), mask=ends & ~lost[exit_]),
            "on": pa.array(on),
            "inner": pa.array(np.where(parent < 0, 0, ids[parent]), mask=parent < 0),
            "fragment": pa.array(np.full(len(ids), _name(t.column("trace_id")[0].as_py(), int(ids[0])))),
        }
        if not self.with_paths:
            yield pa.RecordBatch.from_arrays([cols[c] for c in self.names], self.names)
            return
        for at, to, paths in _joined_paths(parent, ends, t.column("path").combine_chunks()):
            yield pa.RecordBatch.from_arrays([paths if c == "path" else cols[c].slice(at, to - at) for c in self.names], self.names)


def _mark(t: pa.Table) -> pa.Table:
    """Nodes on a cycle that runs through this fragment: what lies above its entries that are on it."""
    t, up = _placed(t, "inner")
    on = t.column("on").to_numpy().copy()
    for _ in range(len(on).bit_length()):
        above = up[np.flatnonzero(on)]
        on[above[above >= 0]] = True
        up = np.where(up >= 0, up[np.maximum(up, 0)], -1)
    return pa.table({"trace_id": t.column("trace_id"), "id": t.column("id"), "on": pa.array(on)})


def _neighbours(now: DataFrame, size: int, rows: int, with_paths: bool, schema: T.StructType) -> DataFrame:
    """One level by fragments of neighbouring ids."""
    parts = min(MOST_PARTS, -(-size // rows))
    spread = now.repartitionByRange(parts, "trace_id", "id") if parts > 1 else now.coalesce(1)
    return spread.sortWithinPartitions("trace_id", "id").mapInArrow(_Contract(rows, with_paths, schema.names), schema)


def _mated(now: DataFrame, turn: int, with_paths: bool, schema: T.StructType) -> DataFrame:
    """One level by fragments of a node whose coin shows heads with its children whose coins show tails."""
    heads = lambda c: F.xxhash64("trace_id", c, F.lit(turn)).bitwiseAND(F.lit(1)) == 0
    none = F.lit(None).cast("bigint")
    joins = F.coalesce(heads("up") & ~heads("id") & F.col("up").isNotNull(), F.lit(False))
    values = ["up", "steps", "low", "top", "cycle", *(["path"] if with_paths else [])]
    over = now.where(heads("id")).select(F.col("trace_id").alias("_t"), F.col("id").alias("_id"), *(F.col(c).alias(f"_{c}") for c in values))
    kids = now.where(joins)
    got = kids.join(over, kids.trace_id.eqNullSafe(over._t) & (kids.up == over._id), "left")
    found = F.col("_id").isNotNull()
    loop = F.coalesce(found & (F.col("_up") == F.col("id")), F.lit(False))  # a node that is its own grandparent
    low = F.when(found, F.least("low", "_low")).otherwise(F.col("low"))
    made = {
        "up": F.when(found & ~loop, F.col("_up")).when(~found, F.col("up")),
        "steps": F.when(found, F.col("steps") + F.col("_steps")).otherwise(F.col("steps")),
        "low": low,
        "top": F.when(found, F.col("_top")).otherwise(F.col("top")),
        "cycle": F.when(loop, low).when(found, F.col("_cycle")).otherwise(F.col("cycle")),
        "on": loop,
        "inner": F.when(found, F.col("up")),
        "fragment": none,
    }
    if with_paths:
        made["path"] = F.when(loop, F.array().cast("array<bigint>")).when(found, F.concat("path", "_path")).otherwise(F.col("path"))
    joined = got.select("trace_id", "id", *(c.alias(n) for n, c in made.items()))
    rest = now.where(~joins).withColumn("on", F.lit(False)).withColumn("inner", none).withColumn("fragment", none)
    return joined.unionByName(rest).select(*schema.names)


def hierarchy(links: DataFrame, with_paths: bool = True, fragment_rows: int = FRAGMENT_ROWS) -> DataFrame:
    """Solves ``trace_id, task_id, parent_id`` (one row per node): ``trace_id, task_id, root_id, depth, cycle_id, place[, path]``.

    ``root_id`` and ``depth`` (0 for a root) are null for nodes whose chain of parents never ends; these have ``place`` ``on``
    (their own ancestor or parent) or ``below`` and the smallest id of the cycle they reach as ``cycle_id``. ``path`` lists the
    ids from the root to the node. A parent without a row ends the chain at its child. An empty table gives no rows.
    """
    bigint = T.LongType()
    fields = [links.schema["trace_id"], *(T.StructField(c, bigint) for c in ("id", "up", "steps", "low", "top", "cycle")), T.StructField("on", T.BooleanType()), T.StructField("inner", bigint), T.StructField("fragment", bigint)]
    if with_paths:
        fields.append(T.StructField("path", T.ArrayType(bigint)))
    schema = T.StructType(fields)
    own = F.col("task_id").cast("bigint")
    now = durable(links.select("trace_id", own.alias("id"), F.col("parent_id").cast("bigint").alias("up"), F.lit(1).cast("bigint").alias("steps"), own.alias("low"), own.alias("top"), F.lit(None).cast("bigint").alias("cycle"), *([F.array(own).alias("path")] if with_paths else [])))
    def measured() -> tuple[int, int]:
        return tuple(now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("path")), F.lit(0)) if with_paths else F.lit(0)).first())

    (size, values), levels, near = measured(), [], True
    while size or not levels:
        whole = size <= fragment_rows and values <= FRAGMENT_VALUES
        made = _neighbours(now, max(size, 1), fragment_rows, with_paths, schema) if near or whole else _mated(now, len(levels), with_paths, schema)
        done = durable(made)
        levels.append((done, near or whole))
        entries = done.where("up is not null").select(F.col("trace_id").alias("_t"), F.col("up").alias("_id")).distinct()
        now = durable(done.join(entries, done.trace_id.eqNullSafe(entries._t) & (done.id == entries._id), "left_semi").drop("on", "inner", "fragment"))
        left, values = measured()
        near, size = near and 2 * left <= size, left
    solved = None
    for done, by_id in reversed(levels):
        solved = _answers(done, by_id, solved, with_paths)
    place = F.when(F.col("cycle").isNotNull(), F.when(F.col("on"), "on").otherwise("below"))
    return solved.select("trace_id", F.col("id").alias("task_id"), F.col("root").alias("root_id"), "depth", F.col("cycle").alias("cycle_id"), place.alias("place"), *(["path"] if with_paths else []))


def _marks(done: DataFrame, far: DataFrame, by_id: bool) -> DataFrame:
    """``_mt, _mid``: the nodes of one level on cycles that run through several of its fragments, given the entries among them that are on one."""
    if by_id:
        kinds = T.StructType([far.schema["trace_id"], far.schema["id"], T.StructField("on", T.BooleanType())])
        on = far.groupBy("fragment").applyInArrow(_mark, kinds)
        return on.where("on").select(F.col("trace_id").alias("_mt"), F.col("id").alias("_mid"))
    # a node joined to its parent has it on its cycle, where that was closed here too
    seeds, loops = far.where("on"), done.where("on")
    above = seeds.select("trace_id", "inner").unionByName(loops.select("trace_id", "inner")).where("inner is not null")
    return seeds.select(F.col("trace_id").alias("_mt"), F.col("id").alias("_mid")).union(above).distinct()


def _answers(done: DataFrame, by_id: bool, above: DataFrame | None, with_paths: bool) -> DataFrame:
    """Answers for the nodes of one level, given those of the quotient above it."""
    ends = F.col("cycle").isNull()
    path = F.when(ends, F.reverse("path")) if with_paths else None
    if above is None:
        return done.select("trace_id", "id", F.when(ends, F.col("top")).alias("root"), F.when(ends, F.col("steps") - 1).alias("depth"), "cycle", "on", *([path.alias("path")] if with_paths else []))
    a = above.select(F.col("trace_id").alias("_t"), F.col("id").alias("_id"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), F.col("cycle").alias("_cycle"), *([F.col("path").alias("_path")] if with_paths else []))
    j = done.join(a, done.trace_id.eqNullSafe(a._t) & (done.up == a._id), "left")
    lost = F.coalesce("cycle", "_cycle")
    found = F.col("_id").isNotNull()
    root = F.when(lost.isNull(), F.when(found, F.col("_root")).otherwise(F.col("top")))
    depth = F.when(lost.isNull(), F.when(found, F.col("_depth") + F.col("steps")).otherwise(F.col("steps") - 1))
    whole = F.when(lost.isNull(), F.when(found, F.concat("_path", F.reverse("path"))).otherwise(F.reverse("path"))) if with_paths else None
    got = j.select("trace_id", "id", root.alias("root"), depth.alias("depth"), lost.alias("cycle"), "on", "inner", "fragment", (F.col("cycle").isNull() & F.col("_cycle").isNotNull()).alias("_far"), *([whole.alias("path")] if with_paths else []))
    # nodes on cycles through several fragments: entries that are on one, and what lies above them
    far = got.where("_far").select("trace_id", "id", "inner", "fragment")
    seeds = above.where("on").select(F.col("trace_id").alias("_t"), F.col("id").alias("_id"))
    far = far.join(seeds, far.trace_id.eqNullSafe(seeds._t) & (far.id == seeds._id), "left").select(far.trace_id, "id", "inner", "fragment", F.col("_id").isNotNull().alias("on"))
    marks = _marks(done, far, by_id)
    cyclic = got.where("_far").join(marks, got.trace_id.eqNullSafe(marks._mt) & (got.id == marks._mid), "left").withColumn("on", F.col("_mid").isNotNull()).drop("_mt", "_mid", "inner", "fragment", "_far")
    return durable(got.where("not _far").drop("inner", "fragment", "_far").unionByName(cyclic))


def closure(solved: DataFrame) -> DataFrame:
    """``trace_id, ancestor_id, task_id, distance``: every node with each of its descendants, itself at distance 0.

    From :func:`hierarchy` with paths. Nodes whose chain never ends have no path and are left out; :func:`endless_closure` has their rows.
    """
    return solved.where("path is not null").select("trace_id", "task_id", F.size("path").alias("_n"), F.posexplode("path").alias("_at", "ancestor_id")).select("trace_id", "ancestor_id", "task_id", (F.col("_n") - 1 - F.col("_at")).cast("bigint").alias("distance"))


def endless_closure(links: DataFrame, solved: DataFrame) -> DataFrame:
    """The rows :func:`closure` leaves out: each node whose chain never ends with each distinct ancestor at its least distance, itself at 0.

    ``solved`` is :func:`hierarchy` of ``links``. The chain runs up to the cycle and once around it. Cut at the nodes on
    cycles, the links make trees whose paths lead from the cycle down; cut at one node per cycle, its links are a chain that
    gives each node's position on the cycle.
    """
    lost = durable(solved.where("cycle_id is not null").select(F.col("trace_id").alias("_t"), F.col("task_id").alias("_id"), F.col("cycle_id").alias("_cycle"), (F.col("place") == "on").alias("_on")))
    own = durable(links.join(lost, links.trace_id.eqNullSafe(lost._t) & (links.task_id == lost._id)).select("trace_id", "task_id", "parent_id", "_cycle", "_on"))
    around = own.where("_on").select("trace_id", "task_id", F.when(F.col("task_id") != F.col("_cycle"), F.col("parent_id")).alias("parent_id"))
    place = durable(hierarchy(around, with_paths=False).select(F.col("trace_id").alias("_t"), F.col("root_id").alias("_cycle"), F.col("task_id").alias("_id"), F.col("depth").alias("_at")))
    size = place.groupBy(F.col("_t").alias("_trace"), F.col("_cycle").alias("_of")).agg(F.count(F.lit(1)).alias("_size"))
    sized = place.join(size, place._t.eqNullSafe(size._trace) & (place._cycle == size._of)).select("_t", "_cycle", "_id", "_at", "_size")
    trees = durable(hierarchy(own.select("trace_id", "task_id", F.when(~F.col("_on"), F.col("parent_id")).alias("parent_id"))))
    # trees hold each node with what lies above it, the cycle's node included; the rest of the cycle lies above that one
    entry = trees.join(sized, trees.trace_id.eqNullSafe(sized._t) & (trees.root_id == sized._id)).select("trace_id", "task_id", "root_id", "depth", "_cycle", F.col("_at").alias("_from"), "_size")
    other = place.select("_t", F.col("_cycle").alias("_c"), F.col("_id").alias("ancestor_id"), "_at")
    rest = entry.join(other, entry.trace_id.eqNullSafe(other._t) & (entry._cycle == other._c)).where("ancestor_id <> root_id")
    return closure(trees).unionByName(rest.select("trace_id", "ancestor_id", "task_id", (F.col("depth") + F.pmod(F.col("_from") - F.col("_at"), F.col("_size"))).cast("bigint").alias("distance")))


def all_descendants(links: DataFrame) -> DataFrame:
    """``trace_id, ancestor_id, task_id, distance``: every node with each of its descendants, those on and below cycles too, itself at distance 0."""
    solved = durable(hierarchy(links))
    return closure(solved).unionByName(endless_closure(links, solved))


def endless(solved: DataFrame) -> DataFrame:
    """``trace_id, task_id, cycle_id, place``: the nodes whose chain of parents never ends."""
    return solved.where("cycle_id is not null").select("trace_id", "task_id", "cycle_id", "place")
