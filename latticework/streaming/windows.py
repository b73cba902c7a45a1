"""The same aggregates on streams: values that arrive in time, on a base that does not change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.operators.support import SupportMap


def summaries(stream: DataFrame, time: str = "ts", width: str = "1 day", late: str = "1 day", keys: tuple[str, ...] = ("layer",)) -> DataFrame:
    """n, mean, variance, min and max by window and keys; rows later than the watermark are dropped by Spark's rules."""
    v = F.col("value")
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("variance"), F.min(v).alias("min"), F.max(v).alias("max"))


def aggregated(stream: DataFrame, m: SupportMap, behaviour: str, time: str = "ts", width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Window and target: values (ord, time, value) through a static support map, by their meaning."""
    met = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).join(m.weights.join(m.support, "source_ord").withColumnRenamed("source_ord", "ord"), "ord")
    grouped = met.groupBy(F.window(time, width), "target_ord")
    if behaviour in ("extensive", "count"):
        return grouped.agg(F.sum(F.col("weight") * F.col("value")).alias("value"))
    ps = F.col("weight") * F.col("support")
    return grouped.agg(F.try_divide(F.sum(ps * F.col("value")), F.sum(ps)).alias("value"))
