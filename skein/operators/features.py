"""One row of features per entity from an event table, by two-stage salted aggregation.

A counting pass finds the heavy groups, those of an entity and type that hold more than one in ``per`` of all rows; so there are
fewer than ``per`` of them. Stage one works on (entity, type, salt), where heavy groups are spread over as many salts as
their size asks for, by a hash of the event's offset, so repeated rows of one event meet in one group. There they
collapse and partial statistics form. Stage two merges the partial statistics of an entity, whose number is bounded by
types times salts, and packs them. The complete type list is laid out last, without another shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

HEAVY_PER = 2000
ANNOTATIONS = (45, 47, 48)  # events of user tasks, regions and logs carry a name or a category


def _own_name() -> Column:
    """The name or category an annotation carries."""
    return F.when(F.col("type_id").isin(*ANNOTATIONS), F.try_element_at(F.col("string_args"), F.lit(1)))


def feature_name(event_types: DataFrame, own: Column | None = None) -> Column:
    """Name of an event's feature: its catalogue type, annotations as ``type:name``, unknown types ``unknown:id``.

    The catalogue is the fixed table of event types; it becomes a literal map.
    """
    names = {r.type_id: r.type for r in event_types.select("type_id", "type").collect() if r.type_id is not None}
    known = F.create_map(*(F.lit(x) for pair in sorted(names.items()) for x in pair))
    base = F.coalesce(
        F.try_element_at(known, F.col("type_id")),
        F.concat(F.lit("unknown:"), F.coalesce(F.col("type_id").cast("string"), F.lit("null"))),
    )
    own = _own_name() if own is None else own
    return F.when(own.isNotNull(), F.concat(base, F.lit(":"), own)).otherwise(base)


def type_list(events: DataFrame, event_types: DataFrame) -> DataFrame:
    """``feature``: every catalogue type and every annotation that occurs, once each."""
    seen = events.select("type_id", F.try_element_at("string_args", F.lit(1)).alias("_first"))
    seen = seen.withColumn("_first", F.when(F.col("type_id").isin(*ANNOTATIONS), F.col("_first"))).distinct()
    seen = seen.select("type_id", F.array("_first").alias("string_args"))
    every = event_types.where("type_id is not null").select("type_id", F.lit(None).cast("array<string>").alias("string_args"))
    return seen.unionByName(every).select(feature_name(event_types).alias("feature")).distinct()


def heavy_groups(events: DataFrame, entity: Sequence[str], per: int = HEAVY_PER) -> DataFrame:
    """``entity..., type_id, salts``: the groups of more than one in ``per`` of all rows, fewer than ``per``, and over how many salts each is spread."""
    counts = events.groupBy(*entity, "type_id").agg(F.count(F.lit(1)).alias("_n"))
    total = events.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.where(F.col("_n") * per > total).select(*entity, "type_id", F.ceil(F.col("_n") * per / total).cast("int").alias("salts"))


def feature_stats(events: DataFrame, event_types: DataFrame, entity: Sequence[str] = ("trace_id", "g"), offset: str = "rec_offset", per: int = HEAVY_PER) -> DataFrame:
    """``entity..., feature, n, last_ts, link_time``: the statistics of each feature an entity has.

    ``n`` counts distinct events (rows with the same entity, offset and feature are one event; each row without an offset
    is an event of its own), ``last_ts`` is their largest ``ts`` (null where none has one), ``link_time`` the sum of
    ``link_ts - ts`` over events that have both (0 where none has). Entities with a null part are kept.
    """
    keys = [*entity, "type_id"]
    rows = events.select(*keys, F.col(offset).alias("_at"), _own_name().alias("_name"), "ts", "link_ts")
    heavy = heavy_groups(events, entity, per).select(*(F.col(c).alias(f"_h{i}") for i, c in enumerate(keys)), "salts")
    same = [rows[c].eqNullSafe(heavy[f"_h{i}"]) for i, c in enumerate(keys)]
    spread = rows.where("_at is not null").join(F.broadcast(heavy), same, "left")  # fewer than `per` rows
    spread = spread.select(*rows.columns, F.coalesce(F.pmod(F.xxhash64("_at"), F.col("salts")), F.lit(0)).alias("_salt"))
    known = spread.repartition(*keys, "_salt")
    once = known.groupBy(*keys, "_salt", "_name", "_at").agg(F.max("ts").alias("ts"), F.max("link_ts").alias("link_ts"))
    states = [F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"), F.sum(F.col("link_ts") - F.col("ts")).alias("link_time")]
    partial = once.groupBy(*keys, "_salt", "_name").agg(*states).drop("_salt")
    # rows without an offset have nothing to collapse: their partial statistics form in the map tasks
    lone = rows.where("_at is null").groupBy(*keys, "_name").agg(*states)
    merged = partial.unionByName(lone).repartition(*entity).withColumn("feature", feature_name(event_types, F.col("_name")))
    return merged.groupBy(*entity, "feature").agg(F.sum("n").alias("n"), F.max("last_ts").alias("last_ts"), F.coalesce(F.sum("link_time"), F.lit(0)).alias("link_time"))


def with_recency(stats: DataFrame, events: DataFrame) -> DataFrame:
    """``stats`` with ``since_last``: from a feature's last event to the end of the trace (its largest ``ts``)."""
    ends = events.groupBy("trace_id").agg(F.max("ts").alias("_end"))
    return stats.join(ends, stats.trace_id.eqNullSafe(ends.trace_id), "left").select(
        *(stats[c] for c in stats.columns if c != "last_ts"), (F.col("_end") - F.col("last_ts")).alias("since_last")
    )


def entity_features(events: DataFrame, event_types: DataFrame, max_features: int = 100_000, per: int = HEAVY_PER) -> DataFrame:
    """``trace_id, g, n, since_last, link_time``: one row per goroutine, three arrays over the complete type list.

    Position ``i`` of each array belongs to the ``i``-th feature of :func:`type_list` in ascending order: the number of
    its events (0 where none), the time from the last one to the trace's end (null where none) and the total time from
    its events to their links (0 where none). Events without ``g`` belong to no goroutine but count for the trace's
    end. The type list, not the data, is brought to the driver; more than ``max_features`` types are an error.
    An empty event table gives no rows.
    """
    listed = [r.feature for r in type_list(events, event_types).limit(max_features + 1).collect()]
    if len(listed) > max_features:
        raise ValueError(f"more than {max_features} event types")
    listed.sort()
    stats = feature_stats(events.where("g is not null"), event_types, per=per)
    packed = stats.groupBy("trace_id", "g").agg(F.collect_list(F.struct("feature", "n", "last_ts", "link_time")).alias("stats"))
    ends = events.groupBy("trace_id").agg(F.max("ts").alias("_end"))
    packed = packed.join(ends, packed.trace_id.eqNullSafe(ends.trace_id), "left").select(packed.trace_id, "g", "_end", "stats")
    many = T.ArrayType(T.LongType())
    out = T.StructType([packed.schema["trace_id"], packed.schema["g"], *(T.StructField(c, many) for c in ("n", "since_last", "link_time"))])
    return packed.mapInArrow(_Expand(listed), out)


class _Expand:
    """Lays packed statistics out over the whole type list, some hundred rows at a time to bound memory."""

    def __init__(self, features: list[str]):
        self.features = features

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, width = pa.array(self.features, pa.string()), len(self.features)
        step = max(1, 400_000 // max(width, 1))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                yield self.expand(whole.slice(at, step), known, width)

    def expand(self, batch: pa.RecordBatch, known: pa.Array, width: int) -> pa.RecordBatch:
        rows, stats = batch.num_rows, batch.column("stats")
        flat = stats.flatten()
        row = np.repeat(np.arange(rows), pc.list_value_length(stats).to_numpy(zero_copy_only=False))
        at = row * width + pc.index_in(flat.field("feature"), known).to_numpy(zero_copy_only=False)
        end = batch.column("_end")

        def laid(values: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
            return pa.ListArray.from_arrays(np.arange(rows + 1, dtype=np.int32) * width, pa.array(values, pa.int64(), mask=mask))

        n, link = np.zeros(rows * width, np.int64), np.zeros(rows * width, np.int64)
        n[at] = flat.field("n").to_numpy(zero_copy_only=False)
        link[at] = flat.field("link_time").to_numpy(zero_copy_only=False)
        last = flat.field("last_ts")
        has = last.is_valid().to_numpy(zero_copy_only=False) & end.is_valid().to_numpy(zero_copy_only=False)[row]
        since, none = np.zeros(rows * width, np.int64), np.ones(rows * width, bool)
        ends = pc.fill_null(end, 0).to_numpy(zero_copy_only=False)
        since[at] = ends[row] - pc.fill_null(last, 0).to_numpy(zero_copy_only=False)
        none[at] = ~has
        since[none] = 0
        return pa.RecordBatch.from_arrays(
            [batch.column("trace_id"), batch.column("g"), laid(n), laid(since, none), laid(link)],
            ["trace_id", "g", "n", "since_last", "link_time"],
        )
