"""Mergeable percentiles per group by dyadic Count-sketches.

A value becomes a code of ``BITS`` bits that keeps order: small magnitudes as they are, larger ones by exponent and
``MANTISSA`` leading bits, negatives mirrored. For each binary resolution (the code without its last 0, 1, 2 ... bits) a
group keeps one signed sketch: ``DEPTH`` rows of ``WIDTH`` counters, where a node adds its weight, with a random sign, to
one counter of each row. Only the coarsest resolutions, which have fewer nodes than a sketch has counters, are counted as they
are, all in one table of the nodes of ``EXACT`` bits. Sketches are linear: those of separate partitions, traces or days are
added, and weights of -1 take rows out again. They travel as pages of counters that are not 0, made from many codes at once.

A percentile descends from the whole range: at each resolution the estimated weights of both children (medians of
their rows) say whether the wanted rank lies left or right.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

MANTISSA = 25
BITS = 32
WIDTH = 8192
DEPTH = 5
EXACT = 15  # bits of the nodes that are counted as they are: fewer than DEPTH * WIDTH
LEVELS = BITS - EXACT  # resolutions with a sketch; the next one is the table of exact counters
PAGE_BITS = 10  # counters of a page
HEAVY = 16  # counters of a row that are taken for heavy nodes
SIGMAS = 1.6  # three standard deviations of a median of five, in those of one row
HELD_CODES = 200_000  # codes sketched at once
HEAVY_PER = 256  # a group with more than one in so many of all values is spread over several tasks
_ZERO = 1 << BITS - 1


def encode(value: Column) -> Column:
    """Order-keeping code, 0 .. 2**BITS - 1, of a BIGINT; equal codes differ by less than 2**-MANTISSA of the value."""
    size = F.abs(F.greatest(value, F.lit(-(2**63 - 1))))
    exponent = F.length(F.bin(size)) - 1
    short = exponent - MANTISSA
    # shift counts are expressions, hence SQL's function form
    lead = F.call_function("shiftright", size, F.greatest(short, F.lit(0)))
    code = F.when(short <= 0, size).otherwise(F.shiftleft((short + 1).cast("bigint"), MANTISSA) + lead - (1 << MANTISSA))
    return F.when(value < 0, _ZERO - code).otherwise(_ZERO + code).cast("bigint")


def decode(code: int) -> int:
    """The middle of the values that have this code."""
    size, sign = abs(code - _ZERO), -1 if code < _ZERO else 1
    if size < 2 << MANTISSA:
        return sign * size
    short = (size >> MANTISSA) - 1
    low = ((size & (1 << MANTISSA) - 1) + (1 << MANTISSA)) << short
    return sign * (low + ((1 << short) - 1 >> 1))


def _mixed(nodes: np.ndarray, level: int, row: int) -> np.ndarray:
    """64 pseudorandom bits for each node, others in each row of each level."""
    x = nodes.astype(np.uint64) + np.uint64((level * DEPTH + row + 1) * 0x9E3779B97F4A7C15 & 2**64 - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _place(nodes: np.ndarray, level: int, row: int) -> tuple[np.ndarray, np.ndarray]:
    """The counter of each node in one row of one level's sketch, and its sign."""
    h = _mixed(nodes, level, row)
    return (h & np.uint64(WIDTH - 1)).astype(np.int64), 1 - 2 * (h >> np.uint64(40) & np.uint64(1)).astype(np.int64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order and their sums, without those of 0."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    keys, counts = keys[first], np.add.reduceat(counts, first)
    return keys[counts != 0], counts[counts != 0]


def _numbered(t: pa.Table, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's values of these columns, null being one, and the first row of each number."""
    code = np.zeros(t.num_rows, np.int64)
    for c in names:
        index = t.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        _, code = np.unique(code * (index.max() + 1) + index, return_inverse=True)
    _, first, number = np.unique(code, return_index=True, return_inverse=True)
    return number, first


def _pages(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Counters, whose keys are a page and a cell, as one row per page: the pages, their cells and counts."""
    page = keys >> PAGE_BITS
    first = np.flatnonzero(np.r_[True, page[1:] != page[:-1]])
    offsets = pa.array(np.r_[first, len(keys)].astype(np.int32))
    cells = pa.ListArray.from_arrays(offsets, pa.array((keys & (1 << PAGE_BITS) - 1).astype(np.int32)))
    return page[first], cells, pa.ListArray.from_arrays(offsets, pa.array(counts))


class _Sketch:
    """Map side: codes and their weights to pages of counters."""

    def __init__(self, group: Sequence[str], names: Sequence[str]):
        self.group, self.names = list(group), list(names)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= HELD_CODES:
                yield from self.sketch(pa.Table.from_batches(held))
                held, size = [], 0
        if size:
            yield from self.sketch(pa.Table.from_batches(held))

    def sketch(self, t: pa.Table) -> Iterator[pa.RecordBatch]:
        number, first = _numbered(t, self.group)
        code, weight = t.column("_code").to_numpy(), t.column("_w").to_numpy()
        room = DEPTH * WIDTH
        for level in range(LEVELS + 1):
            node = code >> level
            if level == LEVELS:
                keys, counts = number * room + node, weight
            else:
                placed = [_place(node, level, row) for row in range(DEPTH)]
                keys = np.concatenate([number * room + row * WIDTH + at for row, (at, _) in enumerate(placed)])
                counts = np.concatenate([sign * weight for _, sign in placed])
            keys, counts = _summed(keys, counts)
            if not len(keys):
                continue
            page, cells, sums = _pages(keys, counts)
            of, page = page // (room >> PAGE_BITS), page % (room >> PAGE_BITS)
            rows = pa.array(first[of])
            columns = [*(t.column(c).combine_chunks().take(rows) for c in self.group), pa.array(np.full(len(page), level, np.int32)), pa.array(page.astype(np.int32)), cells, sums]
            yield pa.RecordBatch.from_arrays(columns, self.names)


class _Add:
    """Reduce side: pages in order of their keys to one page per key; only the last key of a batch is held back."""

    def __init__(self, names: Sequence[str]):
        self.names = list(names)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b] if held is None else [held, b.cast(held.schema)])
            number, first = _numbered(t, self.names[:-2])
            cells = t.column("cells").combine_chunks()
            row = np.repeat(number, pc.list_value_length(cells).to_numpy(zero_copy_only=False))
            keys, counts = _summed((row << PAGE_BITS) + cells.flatten().to_numpy(), t.column("counts").combine_chunks().flatten().to_numpy())
            if not len(keys):
                held = None
                continue
            of, cells, sums = _pages(keys, counts)
            rows = pa.array(first[of])
            made = pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks().take(rows) for c in self.names[:-2]), cells, sums], self.names)
            last = of == number[-1]
            held = made.filter(pa.array(last)) if last.any() else None
            if not last.all():
                yield made.filter(pa.array(~last))
        if held is not None:
            yield held


def _schema(df: DataFrame, group: Sequence[str]) -> T.StructType:
    own = [T.StructField("level", T.IntegerType()), T.StructField("page", T.IntegerType()), T.StructField("cells", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.LongType()))]
    return T.StructType([*(df.schema[c] for c in group), *own])


def sketch(df: DataFrame, group: Sequence[str], value: str, weight: Column | None = None) -> DataFrame:
    """``group..., level, page, cells, counts``: the sketches of each group, a row per page of counters that are not 0.

    Null values are left out; null is a group like any other. ``weight`` is 1 by default; a negative weight takes a value out again.
    """
    w = F.lit(1) if weight is None else weight
    values = df.where(F.col(value).isNotNull())
    codes = values.select(*group, encode(F.col(value).cast("bigint")).alias("_code"), w.cast("bigint").alias("_w"))
    # a group is sketched in one task, a heavy one in as many as its share asks for, so the number of sketches does not grow with the data
    if group:
        heavy = heavy_groups(values, group).select(*(F.col(c).alias(f"_h{i}") for i, c in enumerate(group)), "_salts")
        same = [codes[c].eqNullSafe(heavy[f"_h{i}"]) for i, c in enumerate(group)]
        spread = codes.join(F.broadcast(heavy), same, "left")  # fewer than HEAVY_PER rows
    else:
        spread = codes.withColumn("_salts", F.lit(HEAVY_PER))
    salt = F.coalesce(F.pmod(F.xxhash64("_code", F.spark_partition_id()), F.col("_salts")), F.lit(0))
    spread = spread.select(*group, "_code", "_w", salt.alias("_salt")).repartition(*group, "_salt")
    codes = spread.groupBy(*group, "_salt", "_code").agg(F.sum("_w").alias("_w")).where("_w <> 0").drop("_salt")
    out = _schema(codes, group)
    return merge(codes.mapInArrow(_Sketch(group, out.names), out), group)


def heavy_groups(values: DataFrame, group: Sequence[str], per: int = HEAVY_PER) -> DataFrame:
    """``group..., _salts``: groups of more than one in ``per`` of all rows, fewer than ``per``, and over how many tasks each is spread."""
    counts = values.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    total = values.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.where(F.col("_n") * per > total).select(*group, F.ceil(F.col("_n") * per / total).cast("int").alias("_salts"))


def merge(pages: DataFrame, group: Sequence[str]) -> DataFrame:
    """Sketches added up per ``group``: of united sketches, or of finer groups such as days. Each task holds one page at a time."""
    out = _schema(pages, group)
    keys = out.names[:-2]
    return pages.select(*out.names).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_Add(out.names), out)


def _estimated(counters: np.ndarray, nodes: np.ndarray, level: int) -> np.ndarray:
    """The weights of nodes by the sketch of their level: the median of its rows."""
    placed = [_place(nodes, level, row) for row in range(DEPTH)]
    return np.median([sign * counters[row * WIDTH + cell] for row, (cell, sign) in enumerate(placed)], axis=0)


def _light(table: np.ndarray, level: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The sum of the squares of each row's counters in each sketch, without its ``HEAVY`` largest."""
    own = level < LEVELS
    if own.sum() > table.size // 10:
        return np.sort(table.reshape(LEVELS, DEPTH, WIDTH).astype(float) ** 2, axis=2)[:, :, :-HEAVY].sum(axis=2)
    # few counters are not 0: only these are sorted
    row, square = level[own] * DEPTH + at[own] // WIDTH, count[own].astype(float) ** 2
    order = np.lexsort((-square, row))
    row, square = row[order], square[order]
    light = np.arange(len(row)) - np.searchsorted(row, row) >= HEAVY
    return np.bincount(row[light], square[light], LEVELS * DEPTH).reshape(LEVELS, DEPTH)


def _answers(level: np.ndarray, at: np.ndarray, count: np.ndarray, wanted: Sequence[float]) -> tuple[list[int], int, float]:
    """Codes of the wanted percentiles, the number of values, and the stated error, from a group's counters."""
    exact, table = np.zeros(1 << EXACT, np.int64), np.zeros((LEVELS, DEPTH * WIDTH), np.int64)
    exact[at[level == LEVELS]] = count[level == LEVELS]
    table[level[level < LEVELS], at[level < LEVELS]] = count[level < LEVELS]
    n = int(exact.sum())
    if n <= 0:
        return [], n, 0.0
    variance = float(np.median(_light(table, level, at, count), axis=1).sum()) / (WIDTH - HEAVY)
    upto = np.cumsum(np.maximum(exact, 0))
    rank = np.maximum(1, np.ceil(np.array(wanted) * n)).astype(np.int64)
    node = np.minimum(np.searchsorted(upto, rank, "left"), len(upto) - 1)
    room = np.maximum(exact[node], 0)
    rank = rank - (upto[node] - room)
    for lv in range(LEVELS - 1, -1, -1):
        # both children are asked: what they say must add up to the weight of their parent
        one, two = (_estimated(table[lv], 2 * node + side, lv) for side in (0, 1))
        weight = np.clip(np.rint((one + room - two) / 2).astype(np.int64), 0, room)
        right = rank > weight
        rank = np.where(right, rank - weight, rank)
        # never into a child that seems to be empty where the other one is not
        chosen, other = np.where(right, two, one), np.where(right, one, two)
        swap = (chosen < 0.5) & (other >= 0.5)
        right ^= swap
        rank = np.where(swap, np.where(right, 1, np.maximum(weight, 1)), rank)
        node, room = 2 * node + right, np.maximum(np.where(right, room - weight, weight), 1)
    return node.tolist(), n, min(1.0, int(SIGMAS * variance**0.5) / n)


def percentiles(pages: DataFrame, group: Sequence[str], wanted: Sequence[float]) -> DataFrame:
    """``group..., q, value, n, rank_error``: each wanted percentile of each group.

    ``value`` stands for the element of rank ``ceil(q * n)`` (at least 1). Up to its own error of 2**-(MANTISSA + 1), the rank it
    has among the group's values is off by no more than ``rank_error * n`` with high probability. The errors of the resolutions are independent and of mean
    0, so their variances add up: per resolution the squares of its node weights over ``WIDTH``, estimated from the
    sketch. The ``HEAVY`` largest counters of a row do not count, since three rows of five would have to share a counter with
    one of them. The bound is three standard deviations, in whole ranks. Groups without weight give no row.
    A group's counters are bounded by the sketch's size, not by the data.
    """
    keys = [pages.schema[c] for c in group]
    out = T.StructType([*keys, T.StructField("q", T.DoubleType()), T.StructField("value", T.LongType()), T.StructField("n", T.LongType()), T.StructField("rank_error", T.DoubleType())])
    wanted, names = [float(q) for q in wanted], list(group)

    def answer(t: pa.Table) -> pa.Table:
        cells = t.column("cells").combine_chunks()
        row = np.repeat(np.arange(t.num_rows), pc.list_value_length(cells).to_numpy(zero_copy_only=False))
        at = (t.column("page").to_numpy()[row].astype(np.int64) << PAGE_BITS) + cells.flatten().to_numpy()
        codes, n, error = _answers(t.column("level").to_numpy()[row], at, t.column("counts").combine_chunks().flatten().to_numpy(), wanted)
        size = len(codes)
        head = [pa.array([t.column(c)[0].as_py()] * size, t.schema.field(c).type) for c in names]
        tail = [pa.array(wanted[:size], pa.float64()), pa.array([decode(c) for c in codes], pa.int64()), pa.array([n] * size, pa.int64()), pa.array([round(error, 6)] * size, pa.float64())]
        return pa.Table.from_arrays([*head, *tail], [*names, "q", "value", "n", "rank_error"])

    return pages.groupBy(*names).applyInArrow(answer, out)


def checked(df: DataFrame, group: Sequence[str], value: str, found: DataFrame, most: float = 0.01) -> DataFrame:
    """``group..., q, n, within, small``: whether each percentile of ``found`` is within its stated error by exact ranks, and that error at most ``most``.

    Counts the codes of ``df`` below and up to each percentile's; the percentiles, not the values, are few per group.
    """
    some = found.select(*(F.col(c).alias(f"_{c}") for c in group), F.struct("q", "n", "rank_error", encode(F.col("value")).alias("code")).alias("_f"))
    lists = some.groupBy(*(f"_{c}" for c in group)).agg(F.collect_list("_f").alias("_fs"))
    codes = df.where(F.col(value).isNotNull()).groupBy(*group, encode(F.col(value).cast("bigint")).alias("_code")).agg(F.count(F.lit(1)).alias("_w"))
    same = [codes[c].eqNullSafe(lists[f"_{c}"]) for c in group]
    each = codes.join(lists, same).select(*group, "_code", "_w", F.explode("_fs").alias("_f"))
    counted = each.groupBy(*group, "_f").agg(F.sum(F.when(F.col("_code") < F.col("_f.code"), F.col("_w")).otherwise(0)).alias("_below"), F.sum(F.when(F.col("_code") <= F.col("_f.code"), F.col("_w")).otherwise(0)).alias("_upto"))
    n, slack = F.col("_f.n"), F.round(F.col("_f.rank_error") * F.col("_f.n"))
    rank = F.greatest(F.lit(1), F.ceil(F.col("_f.q") * n))
    within = (rank > F.col("_below") - slack) & (rank <= F.col("_upto") + slack)
    return counted.select(*group, F.col("_f.q").alias("q"), n.alias("n"), within.alias("within"), (F.col("_f.rank_error") <= most).alias("small"))
