"""Exact ranks of groups of any size: approximate quantiles give bounds, and only the values between them are ranked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanspark.sources.scratch import stored

#: Half the share of a group's rows whose values are ranked, five times the error of the approximate quantiles.
MARGIN, ACCURACY = 5e-4, 10_000


def values_at(frame: DataFrame, keys: Sequence[str], value: str, q: float, low: Column, high: Column) -> DataFrame:
    """keys, n, __low and __high: the values of ranks low and high (from 1, in terms of n; both near q * n) by key. Nulls don't count.

    No task holds or sorts a whole group: equal values are counted, those outside the bounds only summed up. Bounds that miss a rank are an error.
    """
    keys = list(keys)
    rows = frame.select(*keys, F.col(value).alias("__v")).filter("__v IS NOT NULL")
    about = F.percentile_approx("__v", [max(0.0, q - MARGIN), min(1.0, q + MARGIN)], ACCURACY)
    bounds = stored(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), about.alias("__b")), "rank-bounds")
    met = rows.join(bounds.select(*keys, "__b"), keys)
    met = met.withColumn("__at", F.when(F.col("__v") < F.col("__b")[0], F.lit(None)).otherwise(F.col("__v"))).filter(F.col("__v") <= F.col("__b")[1])
    # The row without a value counts what lies below the bounds and comes first.
    counts = stored(met.groupBy(*keys, "__at").agg(F.count(F.lit(1)).alias("__c")), "rank-counts")
    up = F.sum("__c").over(Window.partitionBy(*keys).orderBy(F.col("__at").asc_nulls_first()))
    counts = counts.withColumn("__up", up).join(bounds.select(*keys, "n"), keys)
    first = lambda rank: F.min(F.when(F.col("__up") >= rank, F.struct("__up", F.coalesce(F.col("__at").isNull(), F.lit(False)).alias("__below"), "__at")))
    got = counts.groupBy(*keys, "n").agg(first(low).alias("__l"), first(high).alias("__h"))
    missed = F.col("__l").isNull() | F.col("__h").isNull() | F.col("__l.__below") | F.col("__h.__below")
    sure = lambda c: F.when(missed, F.raise_error(F.lit("a rank lies outside its bounds")).cast(frame.schema[value].dataType)).otherwise(F.col(c))
    return got.select(*keys, "n", sure("__l.__at").alias("__low"), sure("__h.__at").alias("__high"))


def percentile(frame: DataFrame, keys: Sequence[str], value: str, q: float, name: str) -> DataFrame:
    """By key the percentile q of value, between the two nearest ranks in proportion, as F.percentile gives it."""
    at = (F.col("n") - 1) * F.lit(q)
    got = values_at(frame, keys, value, q, F.floor(at) + 1, F.ceil(at) + 1)
    whole = F.floor(at) == F.ceil(at)
    between = (F.ceil(at) - at) * F.col("__low") + (at - F.floor(at)) * F.col("__high")
    return got.select(*keys, F.when(whole, F.col("__low").cast("double")).otherwise(between).alias(name))


def nearest_rank(frame: DataFrame, keys: Sequence[str], value: str, q: float, name: str) -> DataFrame:
    """By key the value of rank ceil(q * n)."""
    rank = F.ceil(F.col("n") * q)
    return values_at(frame, keys, value, q, rank, rank).select(*keys, F.col("__low").alias(name))
