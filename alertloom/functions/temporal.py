"""Time expressions. Timestamps are zone-less; the session zone is expected to be UTC."""

from pyspark.sql import Column, functions as F

from ..schema import OPEN_WINDOW_SECONDS


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(earlier: Column, later: Column) -> Column:
    return (epoch_micros(later) - epoch_micros(earlier)) / F.lit(1e6)


def minutes_between(earlier: Column, later: Column) -> Column:
    return seconds_between(earlier, later) / F.lit(60.0)


def bin_number(ts: Column, seconds: int) -> Column:
    return F.floor(epoch_micros(ts) / F.lit(seconds * 1_000_000)).cast("long")


def floor_to_bin(ts: Column, seconds: int) -> Column:
    start = F.timestamp_micros(bin_number(ts, seconds) * F.lit(seconds * 1_000_000))
    return start.cast("timestamp_ntz")


def parse_session_clock(date: Column, time: Column) -> Column:
    """Null for a date or time that does not exist, like 99/99/2000."""
    return F.try_to_timestamp(F.concat_ws(" ", date, time), F.lit("MM/dd/yyyy HH:mm:ss")).cast("timestamp_ntz")


def parse_mixed(c: Column, formats=("yyyy-MM-dd HH:mm:ss[.SSSSSS]", "dd/MM/yyyy HH:mm:ss",
                                    "dd/MM/yyyy HH:mm", "MM/dd/yyyy HH:mm:ss")) -> Column:
    """First format that fits; plain ISO text is tried before all of them."""
    tries = [c.try_cast("timestamp_ntz")]
    tries += [F.try_to_timestamp(c, F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(*tries)


def scaled_gap(seconds: Column, cap: float = OPEN_WINDOW_SECONDS) -> Column:
    """Clip to [0, cap] and scale to [0, 1]."""
    return F.least(F.greatest(seconds, F.lit(0.0)), F.lit(float(cap))) / F.lit(float(cap))


TILE_SECONDS = [64 * 4**k for k in range(6)]  # a minute or so up to 18 hours


def tiles_of(ts: Column) -> Column:
    """The tiles that hold a moment, one per length: array of (level, number)."""
    us = epoch_micros(ts)
    return F.array(*[F.struct(F.lit(k).alias("level"), F.floor(us / F.lit(n * 1_000_000)).cast("long").alias("number"))
                     for k, n in enumerate(TILE_SECONDS)])


def _numbers(level: int, first: Column, last: Column, whole: bool) -> Column:
    """Tiles ``first`` to ``last`` of a level; none if ``first`` lies behind ``last``."""
    numbers = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(numbers, lambda n: F.struct(F.lit(level).alias("level"), n.alias("number"), F.lit(whole).alias("whole")))


def cover(start: Column, end: Column) -> Column:
    """Disjoint tiles that cover the closed range: array of (level, number, whole).

    At most six tiles of each length, as long as the range is shorter than a few of the longest. Only the two
    shortest tiles at the ends may lie partly outside; they are not ``whole``.
    """
    low, high = [F.floor(epoch_micros(t) / F.lit(TILE_SECONDS[0] * 1_000_000)).cast("long") for t in (start, end)]
    parts = [_numbers(0, low, low, False), F.when(high > low, _numbers(0, high, high, False)).otherwise(_numbers(0, F.lit(1), F.lit(0), False))]
    # whole tiles of a level inside the range; every four in line belong to the next level
    inside = [(F.ceil((low + 1) / F.lit(4**k)).cast("long"), F.floor(high / F.lit(4**k)).cast("long") - 1) for k in range(len(TILE_SECONDS) + 1)]
    for level in range(len(TILE_SECONDS)):
        (a, b), (up_a, up_b) = inside[level], inside[level + 1]
        if level == len(TILE_SECONDS) - 1:
            parts.append(_numbers(level, a, b, True))
        else:
            parts.append(F.when(up_a > up_b, _numbers(level, a, b, True)).otherwise(
                F.concat(_numbers(level, a, up_a * 4 - 1, True), _numbers(level, up_b * 4 + 4, b, True))))
    return F.concat(*parts)
