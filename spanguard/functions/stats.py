"""Exact nearest-rank percentiles, durations and histograms."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import timedelta
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_UNITS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days"}
_COARSE = 1024
#: Bits of a level of ranges, and levels above the finest: 10 + 3 * 18 bits hold any long.
_FAN_BITS, _LEVELS = 18, 2


def parse_duration(value: str) -> timedelta:
    """`N[smhd]`, e.g. 5m or 7d."""
    match = re.fullmatch(r"(\d+)([smhd])", value.strip())
    if not match:
        raise ValueError(f"invalid duration {value!r}: expected e.g. 5m, 1h, 24h, 7d")
    return timedelta(**{_UNITS[match[2]]: int(match[1])})


def ts_lit(value) -> Column:
    """A timestamp literal; a naive value is read in the session time zone."""
    return F.lit(str(value)).cast("timestamp")


def nearest_rank(
    df: DataFrame,
    value: str,
    ps: dict[str, float],
    keys: Sequence[str] = (),
    parts: dict[str, Column] | None = None,
) -> DataFrame:
    """Percentiles of an integer column per `keys`: the value at index
    round_half_even(p * (n - 1)) of the sorted column. `ps` maps names to p.
    `parts` names conditions that split the rows; their counts come along.

    Rows with a null value count in `parts` but have no rank; without `parts`
    they don't matter at all.

    Rows are counted per distinct value before any shuffle. Ranks are found in
    levels, so no window holds more than a 1024-value range or the list of
    ranges of a key; without keys, no more than 2**18 ranges of one level, however
    many there are. All levels need the same columns of the counted rows, so
    that Spark computes them once and reuses the exchange.
    """
    keys, count = list(keys), {"_n": F.lit(True)}
    conditions = parts or count
    if not parts:
        df = df.filter(F.col(value).isNotNull())
    hist = df.groupBy(
        *keys, F.floor(F.col(value) / _COARSE).alias("_range"), F.col(value).alias("_v")
    ).agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])
    n = F.when(F.col("_v").isNotNull(), sum((F.col(name) for name in conditions), F.lit(0))).otherwise(0)
    fine = hist.withColumn(
        "_run", F.sum(n).over(W.partitionBy(*keys, "_range").orderBy("_v"))
    ).withColumn("_size", n)
    ranges = hist.groupBy(*keys, "_range").agg(F.sum(n).alias("_in_range"))
    ranges = _bases(ranges, keys) if keys else _bases_in_levels(ranges, _LEVELS)
    names = {c: f"_of_{c}" for c in [*keys, "_range"]}
    ranges = ranges.select(*[F.col(c).alias(n) for c, n in names.items()], "_base", "_total")
    # Null-safe: keeps null keys, and puts no filter on one side only.
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    joined = fine.join(ranges, reduce(and_, same))
    upper = F.col("_base") + F.col("_run")
    lower = upper - F.col("_size")

    def at(p: float) -> Column:
        rank = F.bround(F.lit(p) * (F.col("_total") - 1), 0)
        return F.max(F.when((lower <= rank) & (rank < upper), F.col("_v")))

    aggs = [at(p).alias(name) for name, p in ps.items()]
    aggs += [F.sum(name).alias(name) for name in parts or ()]
    return joined.groupBy(*keys).agg(*aggs) if keys else joined.agg(*aggs)


def _bases(ranges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Adds the rows in smaller ranges (`_base`) and in all of the key (`_total`)."""
    by_key = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    return ranges.select(
        *keys,
        "_range",
        (F.sum("_in_range").over(by_key.orderBy("_range")) - F.col("_in_range")).alias("_base"),
        F.sum("_in_range").over(by_key).alias("_total"),
    )


def _bases_in_levels(ranges: DataFrame, levels: int) -> DataFrame:
    """`_bases` without keys: the ranges are summed inside wider ranges, whose own
    bases are found first. Only the widest ones, 2**18 at most, are in one window.
    """
    if not levels:
        return _bases(ranges)
    wide = ranges.withColumn("_wide", F.shiftright("_range", _FAN_BITS))
    sums = wide.groupBy(F.col("_wide").alias("_range")).agg(F.sum("_in_range").alias("_in_range"))
    above = _bases_in_levels(sums, levels - 1).select(
        F.col("_range").alias("_of_wide"), F.col("_base").alias("_below"), "_total"
    )
    inside = F.sum("_in_range").over(W.partitionBy("_wide").orderBy("_range"))
    return (
        wide.withColumn("_inside", inside - F.col("_in_range"))
        .join(above, F.col("_wide").eqNullSafe(F.col("_of_wide")))
        .select("_range", (F.col("_below") + F.col("_inside")).alias("_base"), "_total")
    )


def histogram_counts(value: Column, bounds: Sequence[float]) -> list[Column]:
    """Cumulative bucket counts, one aggregate per bound and one for +Inf."""
    names = [bound_name(b) for b in bounds]
    counts = [F.count_if(value <= F.lit(b)).alias(n) for b, n in zip(bounds, names)]
    return [*counts, F.count(value).alias("+Inf")]


def bound_name(bound: float) -> str:
    return repr(float(bound))


def histogram(
    df: DataFrame, value: Column, bounds: Sequence[float], keys: Sequence[str] = ()
) -> DataFrame:
    """Long form (keys, le, cumulative) of a histogram: partial counts per task,
    then one row per key and bound.
    """
    names = [*map(bound_name, bounds), "+Inf"]
    counts = histogram_counts(value, bounds)
    wide = df.groupBy(*keys).agg(*counts) if keys else df.agg(*counts)
    return wide.unpivot(list(keys), [F.col(f"`{n}`") for n in names], "le", "cumulative")


def histogram_quantile(
    hist: DataFrame, qs: dict[str, float], keys: Sequence[str] = ()
) -> DataFrame:
    """Quantiles by linear interpolation inside the bucket that holds the rank;
    the last finite bound where the rank falls beyond it.
    """
    bound = F.when(F.col("le") != "+Inf", F.col("le").cast("double"))
    key = list(keys) or [F.lit(0)]
    by = W.partitionBy(*key).orderBy(F.col("_le").asc_nulls_last())
    whole = W.partitionBy(*key)
    steps = (
        hist.withColumn("_le", bound)
        .withColumn("_lo", F.coalesce(F.lag("_le").over(by), F.lit(0.0)))
        .withColumn("_below", F.coalesce(F.lag("cumulative").over(by), F.lit(0)))
        .withColumn("_total", F.max("cumulative").over(whole))
        .withColumn("_last", F.max("_le").over(whole))
    )

    def at(q: float) -> Column:
        rank = F.lit(q) * F.col("_total")
        inside = (F.col("cumulative") >= rank) & (F.col("_below") < rank)
        share = (rank - F.col("_below")) / F.nullif(
            F.col("cumulative") - F.col("_below"), F.lit(0)
        )
        value = F.when(F.col("_le").isNull(), F.col("_last")).otherwise(
            F.col("_lo") + (F.col("_le") - F.col("_lo")) * share
        )
        return F.max(F.when((F.col("_total") > 0) & inside, value))

    aggs = [at(q).alias(name) for name, q in qs.items()]
    return steps.groupBy(*keys).agg(*aggs) if keys else steps.agg(*aggs)
