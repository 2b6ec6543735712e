"""Joins of events with overlapping time intervals, as equi-joins on days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from releaselens.functions.scalars import MICROS_PER_DAY, micros
from releaselens.operators.ordering import with_position
from releaselens.session import materialize


def _day(us):
    return F.floor(us / F.lit(MICROS_PER_DAY)).cast("bigint")


def _spans(ranges: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Closed intervals as (keys, _s, _e) with ``_s <= t < _e`` in microseconds; those with an open bound match nothing."""
    spans = ranges.select(*keys, micros(F.col(start)).alias("_s"), (micros(F.col(end)) + 1).alias("_e"))
    return spans.filter(F.col("_s") < F.col("_e"))


def _cut(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, day, lo, hi): the spans cut at midnights."""
    days = spans.withColumn("day", F.explode(F.sequence(_day(F.col("_s")), _day(F.col("_e") - 1))))
    midnight = F.col("day") * F.lit(MICROS_PER_DAY)
    return days.select(
        *keys,
        "day",
        F.greatest("_s", midnight).alias("lo"),
        F.least("_e", midnight + MICROS_PER_DAY).alias("hi"),
    )


def interval_days(ranges: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Cut each closed interval at midnights: (keys, day, lo, hi) with ``lo <= t < hi`` in microseconds.

    Intervals with an open bound match nothing.
    """
    return _cut(_spans(ranges, keys, start, end), keys)


def range_join(events: DataFrame, ranges: DataFrame, ts: str, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Every event with the keys of every interval it lies in, both ends included.

    The day pieces are written first: with their size known the optimizer broadcasts them while they are
    below its threshold and shuffles both sides by day beyond it.
    """
    pieces = materialize(interval_days(ranges, keys, start, end))
    timed = events.withColumn("_us", micros(F.col(ts))).withColumn("day", _day(F.col("_us")))
    inside = (F.col("_us") >= F.col("lo")) & (F.col("_us") < F.col("hi"))
    return timed.join(pieces, "day").filter(inside).drop("day", "lo", "hi", "_us")


def interval_slots(ranges: DataFrame, keys: Sequence[str], start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """Split time at every interval bound.

    Returns the slots' days (day, lo, hi, slot), disjoint, where ``slot`` is the slot's first microsecond, and members
    (keys, slot, first, until): the slots of each interval. An event has one slot however many intervals
    overlap, so facts aggregate per slot once and only the aggregates fan out. There are at most two slots an interval,
    however long the intervals are.
    """
    spans = materialize(_spans(ranges, keys, start, end))
    bounds = with_position(spans.select(F.explode(F.array("_s", "_e")).alias("slot")).distinct(), ["slot"])
    ends = bounds.select((F.col("pos") - 1).alias("pos"), F.col("slot").alias("_e"))
    between = materialize(bounds.join(ends, "pos").select("slot", F.col("slot").alias("_s"), "_e"))
    pieces = _cut(spans, keys)
    whole = spans.groupBy(*keys).agg(F.min("_s").alias("first"), F.max("_e").alias("until"))
    members = (
        pieces.join(between.select("slot", _day(F.col("slot")).alias("day")), "day")
        .filter((F.col("slot") >= F.col("lo")) & (F.col("slot") < F.col("hi")))
        .select(*keys, "slot")
        .join(whole, list(keys))
    )
    members = materialize(members)
    covered = between.join(members.select("slot").distinct(), "slot", "left_semi")
    return materialize(_cut(covered, ["slot"]).select("day", "lo", "hi", "slot")), members


def attach_slot(events: DataFrame, slots: DataFrame, ts: str) -> DataFrame:
    """Add each event's microsecond time, day and slot; events outside all slots drop out."""
    timed = events.withColumn("us", micros(F.col(ts))).withColumn("day", _day(F.col("us")))
    inside = (F.col("us") >= F.col("lo")) & (F.col("us") < F.col("hi"))
    return timed.join(slots, "day").filter(inside).drop("lo", "hi")
