"""Scalar expressions of trace analysis."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def overlap(start1: Column, end1: Column, start2: Column, end2: Column) -> Column:
    """Length of the common part of two closed intervals, 0 where there is none."""
    return F.greatest(F.lit(0), F.least(end1, end2) - F.greatest(start1, start2))


def rescaled(ticks: Column, first: Column, frequency: Column) -> Column:
    """Nanoseconds since ``first`` of a time in ticks, truncated toward zero; the factor is formed first."""
    return ((F.lit(1e9) / frequency) * (ticks - first)).cast("bigint")


def frames_text(frames: Column) -> Column:
    """A stack as text, one line ``function file:line`` per frame; null frames are skipped, null parts empty."""
    shown = F.transform(F.filter(frames, lambda f: f.isNotNull()), lambda f: F.concat(F.coalesce(f["fn"], F.lit("")), F.lit(" "), F.coalesce(f["file"], F.lit("")), F.lit(":"), F.coalesce(f["line"].cast("string"), F.lit(""))))
    return F.array_join(shown, "\n")


def top_frame(frames: Column) -> Column:
    """The first frame of a stack, null for an empty one."""
    return F.try_element_at(frames, F.lit(1))


def record_type(head: Column) -> Column:
    """Event type of a record's first byte: its low six bits."""
    return head.bitwiseAND(F.lit(0x3F))


def record_args(head: Column) -> Column:
    """Number of inline arguments that a record's first byte announces: its high two bits, plus one."""
    return F.shiftrightunsigned(head, 6) + F.lit(1)


def unsigned_text(value: Column) -> Column:
    """A BIGINT's bit pattern as an unsigned decimal number."""
    return F.when(value >= 0, value.cast("string")).otherwise((value.cast("decimal(20,0)") + F.lit(str(2**64)).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"))
