"""Exact quantiles of many rows without sorting or holding a key's values anywhere.

A double's bits, read as a sign and an integer, are in the order of the values. Rows are counted by the upper bits; the
counts say in which of these a wanted rank lies, and only rows that share them are counted by the next bits, until the
rank's value is known. A level sends counts, combined before the shuffle, and at most 2 ** WIDTH of them for a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How far the bits are shifted at each level, from the upper ones to all.
SHIFTS = (42, 21, 0)
FRACTION = 1 << 52


def _power(e: Column) -> Column:
    """Two to an integer, which pow gives exactly."""
    return F.pow(F.lit(2.0), e)


def order_bits(v: Column) -> Column:
    """The bits of a finite double as a long that has its order; both zeros are 0."""
    size = F.abs(v.cast("double"))
    about = F.floor(F.log2(size)).cast("double")
    exponent = about - F.when(_power(about) > size, 1.0).otherwise(0.0) + F.when(_power(about + 1) <= size, 1.0).otherwise(0.0)
    exponent = F.greatest(exponent, F.lit(-1022.0))
    bits = (exponent + 1022).cast("long") * FRACTION + (size / _power(exponent) * float(FRACTION)).cast("long")
    return F.when(size == 0, F.lit(0).cast("long")).when(v < 0, -bits).otherwise(bits)


def from_order_bits(bits: Column) -> Column:
    size = F.abs(bits)
    field = F.shiftright(size, 52)
    fraction = size.bitwiseAND(F.lit(FRACTION - 1)) + F.when(field > 0, F.lit(FRACTION)).otherwise(F.lit(0).cast("long"))
    value = fraction.cast("double") * _power((F.greatest(field, F.lit(1).cast("long")) - 1075).cast("double"))
    return F.when(bits < 0, -value).otherwise(value)


def is_finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: Column, shares: Sequence[float], few: bool = False) -> DataFrame:
    """keys, n (its finite values) and q0, q1... (interpolated between ranks) for each key that has values.

    keys must not be null. Missing, NaN and infinite values don't count. few: see quantiles_of_bits.
    """
    v = value.cast("double")
    return quantiles_of_bits(df.where(is_finite(v)).select(*keys, order_bits(v).alias("_bits")), keys, shares, few)


def quantiles_of_bits(rows: DataFrame, keys: Sequence[str], shares: Sequence[float], few: bool = False) -> DataFrame:
    """exact_quantiles of rows of keys and _bits, the order_bits of finite values.

    few says that there are few keys: what a level found (at most two rows a share and key) is then sent to all tasks, and
    the rows stay where they are; else both may be shuffled by key and bits.
    """
    keys = list(keys)
    found: DataFrame | None = None
    for i, shift in enumerate(SHIFTS):
        prefix = F.shiftright("_bits", shift).alias("_p")
        if found is None:
            own, counted = keys, rows.groupBy(*keys, prefix).agg(F.count("*").alias("_m"))
            total = F.sum("_m").over(Window.partitionBy(*keys))
        else:
            own = [*keys, "n", "_t", "_rank"]
            met = rows.withColumn("_q", F.shiftright("_bits", SHIFTS[i - 1])).join(F.broadcast(found) if few else found, [*keys, "_q"])
            counted = met.groupBy(*own, prefix).agg(F.count("*").alias("_m"))
            total = F.col("n")
        upto = F.sum("_m").over(Window.partitionBy(*own).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0))
        placed = counted.withColumns({"n": total, "_upto": upto}).withColumn("_from", F.col("_upto") - F.col("_m"))
        if found is None:
            at = [(F.col("n") - 1) * float(q) for q in shares]
            wanted = F.array(*[F.struct(F.lit(2 * k + j).alias("_t"), f(x).cast("long").alias("_rank")) for k, x in enumerate(at) for j, f in enumerate((F.floor, F.ceil))])
            inside = F.filter(wanted, lambda t: (t["_rank"] >= F.col("_from")) & (t["_rank"] < F.col("_upto")))
            placed = placed.select(*keys, "n", "_p", "_from", F.explode(inside).alias("_w")).select(*keys, "n", "_p", "_from", "_w._t", "_w._rank")
        else:
            placed = placed.where((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_upto")))
        found = placed.select(*keys, "n", "_t", (F.col("_rank") - F.col("_from")).alias("_rank"), F.col("_p").alias("_q"))
    ends = found.groupBy(*keys).agg(F.first("n").alias("n"), *[F.max(F.when(F.col("_t") == t, from_order_bits(F.col("_q")))).alias(f"_v{t}") for t in range(2 * len(shares))])
    out = []
    for k, q in enumerate(shares):
        place = (F.col("n") - 1) * float(q)
        low, high = F.col(f"_v{2 * k}"), F.col(f"_v{2 * k + 1}")
        out.append((low + (high - low) * (place - F.floor(place))).alias(f"q{k}"))
    return ends.select(*keys, "n", *out)
