"""Fault injection: merge neighbouring ids on purpose and see whether the quality figures notice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def adjacent_candidates(runs: DataFrame, slab: int, pairs: int, least: int = 6) -> DataFrame:
    """``a, b``: neighbours along rays of one slab with ``least`` runs or more, one pair a ray, in hash order."""
    along = Window.partitionBy("slab", "theta").orderBy("run")
    n = F.count("*").over(Window.partitionBy("slab", "theta"))
    both = runs.where(F.col("slab") == slab).withColumns({"b": F.lead("gid").over(along), "n": n}).where((F.col("n") >= least) & F.col("b").isNotNull() & (F.col("b") != F.col("gid")))
    mixed = (F.col("theta") * 7919 + F.col("run") * 104729) % 1000003
    first = both.groupBy("theta").agg(F.min_by(F.struct("gid", "b"), F.struct(mixed.alias("h"), "run")).alias("p"), F.min(mixed).alias("h"))
    distinct = first.groupBy(F.col("p.gid").alias("a"), F.col("p.b").alias("b")).agg(F.min("h").alias("h"))
    return distinct.orderBy("h", "a", "b").limit(pairs).select("a", "b")


def remap(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """``labels`` with id b replaced by its smallest a, one hop only. The pairs are at most a fixed few."""
    one = pairs.groupBy(F.col("b").alias("gid")).agg(F.min("a").alias("to"))
    return labels.join(F.broadcast(one), "gid", "left").withColumn("gid", F.coalesce("to", "gid")).drop("to")


def control_verdict(base: DataFrame, injected: DataFrame, target: int, drop: float = -0.5) -> DataFrame:
    """One row: mean change of layer counts at the target slab and elsewhere, whether it fires and is local."""
    both = base.select("slab", F.col("median_n").alias("was")).join(injected.select("slab", F.col("median_n").alias("now")), "slab").withColumn("d", F.col("now") - F.col("was"))
    at = F.avg(F.when(F.col("slab") == target, F.col("d")))
    off = F.avg(F.when(F.col("slab") != target, F.col("d")))
    out = both.agg(at.alias("target_delta"), F.coalesce(off, F.lit(0.0)).alias("other_delta"))
    return out.withColumns({"fires": F.col("target_delta") <= drop, "localised": F.abs("other_delta") < F.abs("target_delta") / 3})
