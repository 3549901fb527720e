"""Prices in time: the one in force at a moment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(events: DataFrame, prices: DataFrame, key: str, at: str, changed: str, value: str) -> DataFrame:
    """Each event with the last value changed at its time or before; null if there was none.

    Both sides become one sorted stream for each key and the last value is carried along:
    one shuffle, and no pairs of events and prices.
    """
    extra = [c for c in events.columns if c not in (key, at)]
    left = events.select(key, F.col(at).alias("__at"), F.lit(1).alias("__event"), F.struct(*extra).alias("__rest") if extra else F.struct(F.lit(1).alias("one")).alias("__rest"), F.lit(None).cast(prices.schema[value].dataType).alias("__value"))
    last = prices.groupBy(key, F.col(changed).alias("__at")).agg(F.max(value).alias("__value"))
    right = last.select(key, "__at", F.lit(0).alias("__event"), F.lit(None).cast(left.schema["__rest"].dataType).alias("__rest"), "__value")
    order = Window.partitionBy(key).orderBy("__at", "__event").rowsBetween(Window.unboundedPreceding, 0)
    carried = left.unionByName(right).withColumn("__last", F.last("__value", ignorenulls=True).over(order)).where("__event = 1")
    return carried.select(key, F.col("__at").alias(at), *(F.col(f"__rest.{c}").alias(c) for c in extra), F.col("__last").alias(value))
