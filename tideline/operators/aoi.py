"""Average age of information of series of (t, tp): sent at t, received at tp.

A series may hold most of all samples, so none is gathered in one task: each is
cut into ``SLICES`` stretches of its time, a sample's predecessor is looked up
inside its stretch, and the first one of a stretch takes the last sample of the
stretch before it from a small table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLICES = 256


def aoi_avg(samples: DataFrame, delta0: float = 0.0, horizon: float | None = None, mode: str = "reference", digits: int | None = None) -> DataFrame:
    """(series, aoi) from (series, i, t, tp); samples are taken in order of (t, i).

    Up to the first arrival the result is an area; after it an average over the
    horizon (default: the last arrival). ``textbook`` halves the squares.
    Where ``samples`` have a ``delta``, each series takes its own for ``delta0``. A
    series whose rows have no sample (an empty or unreadable file) is null.
    """
    at = F.struct("t", "i")
    own = "delta" in samples.columns
    named = samples.groupBy("series").agg((F.max("delta") if own else F.lit(float(delta0))).alias("d0"))
    s = samples.where("t is not null").select("series", "i", "t", "tp")
    whole = F.lit(float(horizon)) if horizon is not None else F.max_by("tp", at)
    edge = s.groupBy("series").agg(whole.alias("hz"), F.min_by("tp", at).alias("tp0"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    s = s.join(edge, "series").withColumn("slice", F.when(F.col("t1") > F.col("t0"), F.floor((F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0")) * SLICES)).otherwise(F.lit(0)))
    last = s.groupBy("series", "slice").agg(F.max("t").alias("last"))
    carried = last.select("series", "slice", F.lag("last").over(Window.partitionBy("series").orderBy("slice")).alias("carried"))
    inner = F.lag("t").over(Window.partitionBy("series", "slice").orderBy("t", "i"))
    s = s.withColumn("inner", inner).join(carried, ["series", "slice"]).withColumn("before", F.coalesce("inner", "carried"))
    half = 1.0 if mode == "reference" else 0.5
    inside = F.col("t") < F.col("hz")  # strictly before the horizon
    step = F.col("t") - F.col("before")
    area = F.when(inside & F.col("before").isNotNull(), step * (F.col("tp") - F.col("t")) + half * step * step).otherwise(0.0)
    got = s.groupBy("series", "hz", "tp0", "t0").agg(F.sum(area).alias("steps"), F.coalesce(F.max(F.when(inside, F.col("t"))), F.col("t0")).alias("tu"))
    got = named.join(got, "series", "left")
    d0 = F.coalesce("d0", F.lit(float(delta0)))
    head = (2 * d0 + F.col("tp0")) * F.col("tp0") - F.col("tp0") * F.col("tp0") + (F.col("hz") - F.col("tu")) * (F.col("hz") - F.col("tu"))
    after = head / (2 * F.col("hz")) + F.col("steps") / F.col("hz")
    value = F.when(F.col("hz") <= F.col("tp0"), (2 * d0 + F.col("hz")) * F.col("hz") / 2).otherwise(after)
    return got.select("series", (F.round(value, digits) if digits is not None else value).alias("aoi"))


def aoi_samples(rows: DataFrame, series: str, service_ms: str, tick: int) -> DataFrame:
    """Samples of message series: sent at its time since the series began, received ``service_ms`` later (seconds)."""
    began = rows.groupBy(F.col(series).alias("series")).agg(F.min("t_us").alias("began"))
    t = (F.col("t_us") - F.col("began")) / F.lit(float(tick))
    own = rows.select(F.col(series).alias("series"), "t_us", F.col("seq").alias("i"), F.col(service_ms).alias("service"))
    return own.join(began, "series").select("series", "i", t.alias("t"), (t + F.col("service") / 1000.0).alias("tp"))
