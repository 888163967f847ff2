"""Anchored interval grids in wall-clock time.

All arithmetic is on TIMESTAMP_NTZ, so a slot keeps its local hour across daylight-saving changes.
Convert instants with ``from_utc_timestamp(ts, zone)`` before, and localize last.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def ntz(moment: str | dt.datetime) -> Column:
    text = moment if isinstance(moment, str) else moment.isoformat(sep=" ")
    return F.expr(f"TIMESTAMP_NTZ '{dt.datetime.fromisoformat(text).isoformat(sep=' ')}'")


def check_interval(interval: dt.timedelta) -> dt.timedelta:
    if not isinstance(interval, dt.timedelta) or interval <= dt.timedelta(0):
        raise ValueError(f"a grid needs a positive interval, not {interval!r}")
    return interval


def slot_index(c: Column, anchor: Column, interval: dt.timedelta, mode: str = "floor") -> Column:
    """``k`` of the slot at or before (``floor``) or at or after (``ceil``) a moment, never negative."""
    step = F.lit(check_interval(interval))
    elapsed = c - anchor
    if mode == "ceil":
        elapsed = elapsed + F.lit(interval - dt.timedelta(microseconds=1))
    elif mode != "floor":
        raise ValueError(f"a slot is taken by floor or ceil, not {mode!r}")
    k = F.call_function("div", elapsed, step)
    return F.when(c <= anchor, F.lit(0).cast("bigint")).otherwise(k)


def slot_start(k: Column, anchor: Column, interval: dt.timedelta) -> Column:
    return anchor + F.lit(interval) * k


def anchored_slot(c: Column, anchor: Column, interval: dt.timedelta, mode: str = "floor") -> Column:
    """Grid slot of a moment; moments before the anchor clamp to it."""
    return slot_start(slot_index(c, anchor, interval, mode), anchor, interval)
