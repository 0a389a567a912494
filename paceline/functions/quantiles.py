"""Exact linear-interpolated quantiles of groups of any size.

``percentile`` keeps every distinct value of a group in one aggregation buffer.  Here equal
values are counted first (map-side combine), the counts are accumulated slice by slice, and
only the order statistics next to a requested rank survive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], slice_width: float) -> DataFrame:
    """One row per group with a column per entry of ``probs``, and ``n`` (non-null values).

    ``slice_width`` is the value range handled together; it only steers the work, not the result.
    """
    counts = (df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
              .withColumn("_s", F.floor(F.col("_v") / slice_width)))
    inside = Window.partitionBy(*keys, "_s").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    group = Window.partitionBy(*keys)
    before = group.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    slices = (counts.groupBy(*keys, "_s").agg(F.sum("_n").alias("_sn"))
              .select(*keys, "_s", F.coalesce(F.sum("_sn").over(before), F.lit(0)).alias("_off"), F.sum("_sn").over(group).alias("n")))
    ranked = (counts.withColumn("_run", F.sum("_n").over(inside)).join(slices, [*keys, "_s"])
              .withColumn("_hi", F.col("_run") + F.col("_off")).withColumn("_lo", F.col("_hi") - F.col("_n")))
    aggs, out = [F.first("n").alias("n")], []
    for name, p in probs.items():
        at = (F.col("n") - 1) * F.lit(float(p))
        low, high = F.floor(at), F.ceil(at)
        aggs += [F.max(F.when((F.col("_lo") <= low) & (low < F.col("_hi")), F.col("_v"))).alias(f"_l_{name}"),
                 F.max(F.when((F.col("_lo") <= high) & (high < F.col("_hi")), F.col("_v"))).alias(f"_h_{name}")]
        lo, hi = F.col(f"_l_{name}"), F.col(f"_h_{name}")
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return ranked.groupBy(*keys).agg(*aggs).select(*keys, "n", *out)
