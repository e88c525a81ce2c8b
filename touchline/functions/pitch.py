"""Pitch geometry and match-clock expressions (pure column functions).

Frames: events use a 120 x 80 pitch with x toward the opponent goal; the
normalised frame is 0-100 on both axes; the lineup drawing frame is 120 x 100.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PITCH_LENGTH = 120.0
PITCH_WIDTH = 80.0


def zone_id(x: Column, y: Column) -> Column:
    """6 x 5 grid cell id (x bands of 20, y bands of 16), null off the pitch.

    Upper edges are inclusive: x = 120 falls in column 5, y = 80 in row 4.
    """
    on_pitch = x.between(0, PITCH_LENGTH) & y.between(0, PITCH_WIDTH)
    zx = F.least(F.lit(5), F.floor(x / 20).cast("bigint"))
    zy = F.least(F.lit(4), F.floor(y / 16).cast("bigint"))
    return F.when(on_pitch, zy * 6 + zx).cast("bigint")


def time_key(period: Column, minute: Column, second: Column) -> Column:
    """period*100000 + minute*100 + second; null when any part is null."""
    return period.cast("bigint") * 100000 + minute.cast("bigint") * 100 + second.cast("bigint")


def minute_absolute(period: Column, minute: Column) -> Column:
    """max(0, (period-1)*45 + minute), null when a part is null."""
    raw = (period.cast("bigint") - 1) * 45 + minute.cast("bigint")
    return F.when(raw.isNotNull(), F.greatest(raw, F.lit(0).cast("bigint")))


def bucket(minutes: Column, width: int) -> Column:
    return F.floor(minutes / width).cast("bigint") * width


def abs_second(period: Column, minute: Column, second: Column) -> Column:
    """Seconds since kick-off used to measure gaps; missing parts count as 0
    (missing period as 1)."""
    return ((F.coalesce(period.cast("bigint"), F.lit(1)) - 1) * 2700
            + F.coalesce(minute.cast("bigint"), F.lit(0)) * 60
            + F.coalesce(second.cast("bigint"), F.lit(0)))


def clamp(c: Column, lo: float = 0.0, hi: float = 100.0) -> Column:
    # least/greatest skip nulls, so guard explicitly to keep null -> null
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def normalise_x(x: Column, flip: Column, pitch_length: float = PITCH_LENGTH) -> Column:
    """Scale to 0-100, clamp, mirror when ``flip``, clamp again, round to 6."""
    v = clamp((x / F.lit(float(pitch_length))) * 100.0)
    v = F.when(F.coalesce(flip, F.lit(False)), 100.0 - v).otherwise(v)
    return F.round(clamp(v), 6)


def normalise_y(y: Column, pitch_width: float = PITCH_WIDTH) -> Column:
    return F.round(clamp(clamp((y / F.lit(float(pitch_width))) * 100.0)), 6)


def clock_seconds(text: Column) -> Column:
    """'mm:ss' or 'hh:mm:ss' -> seconds; blank or malformed -> 10**9 (sorts last)."""
    t = F.trim(F.coalesce(text.cast("string"), F.lit("")))
    parts = F.split(t, ":")
    n = F.size(parts)

    def part(i: int) -> Column:
        return F.get(parts, i).try_cast("bigint")

    two = part(0) * 60 + part(1)
    three = part(0) * 3600 + part(1) * 60 + part(2)
    # int() accepts surrounding spaces but not signs-only or decimals; digits check keeps parity
    valid = F.forall(parts, lambda p: F.trim(p).rlike(r"^[+-]?\d+$"))
    secs = F.when(valid & (n == 2), two).when(valid & (n == 3), three)
    return F.when(t == "", F.lit(10**9).cast("bigint")).otherwise(F.coalesce(secs, F.lit(10**9).cast("bigint")))


def formation_text(c: Column) -> Column:
    """'4-3-3' kept; '433' / '4231' / '34111' -> dashed; anything else null."""
    t = F.trim(c.cast("string"))
    return (F.when(t.rlike(r"^\d(-\d+)+$"), t)
            .when(t.rlike(r"^\d{3,5}$"), F.regexp_replace(t, r"(?<=\d)(?=\d)", "-")))


def position_key(c: Column) -> Column:
    """Position name normalised for lookup: trim, lower, squeeze whitespace."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))), r"\s+", " ")


def share_pct(left: Column, right: Column) -> tuple[Column, Column]:
    """Bar widths l/(l+r)*100; 50/50 when a side is null or the total <= 0."""
    total = left + right
    ok = left.isNotNull() & right.isNotNull() & (total > 0)
    return (F.when(ok, left / total * 100.0).otherwise(50.0),
            F.when(ok, right / total * 100.0).otherwise(50.0))
