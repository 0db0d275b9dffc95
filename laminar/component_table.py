"""Connected components of a graph that grows: a stored table takes new nodes and links without a new start.

Nodes keep the component that they had on arrival; a second, smaller table says where components went when later links
joined them. Adding links looks up the components of their ends, finds the components of that contracted graph only, and
rewrites the second table. A batch counts once its line stands in ``commits``; what a failed batch left is overwritten.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laminar.graph import connected_components


class ComponentTable:
    """Components at ``path``. ``part`` maps a node column to a partition key (a slab, say), by which lookups prune."""

    def __init__(self, spark: SparkSession, path: str, part=None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.part = part or (lambda node: F.lit(0).cast("long"))

    def batches(self) -> int:
        """Number of committed batches."""
        try:
            return self.spark.read.schema("batch int").parquet(f"{self.path}/commits").agg(F.max("batch")).first()[0] or 0
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0

    def _nodes(self, done: int) -> DataFrame:
        if done == 0:
            return self.spark.createDataFrame([], "node long, entry long, part long")
        return self.spark.read.option("basePath", f"{self.path}/nodes").schema("node long, entry long, batch int, part long").parquet(f"{self.path}/nodes").where(F.col("batch") <= done)

    def _moved(self, done: int) -> DataFrame:
        if done == 0:
            return self.spark.createDataFrame([], "component long, root long")
        return self.spark.read.schema("component long, root long").parquet(f"{self.path}/moved/batch={done}")

    def _known(self, done: int, parts: list[int] | None = None) -> DataFrame:
        nodes = self._nodes(done)
        if parts is not None:
            nodes = nodes.where(F.col("part").isin(parts))
        moved = self._moved(done).select(F.col("component").alias("entry"), "root")
        return nodes.join(moved, "entry", "left").select("node", F.coalesce("root", "entry").alias("component"))

    def read(self) -> DataFrame:
        """``node, component``: the smallest node of each component, over all committed batches."""
        return self._known(self.batches())

    def add(self, nodes: DataFrame, links: DataFrame) -> None:
        """Take ``nodes`` (``node``) and ``links`` (``src, dst``); nodes that are known already and nulls are passed over, ends of
        links that are not known are nodes too."""
        done = self.batches()
        at = done + 1
        ends = links.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct()
        fresh = nodes.select("node").union(ends.select("src")).union(ends.select("dst")).where("node IS NOT NULL").distinct()
        fresh = fresh.withColumn("part", self.part(F.col("node")).cast("long"))
        parts = sorted(r["part"] for r in fresh.select("part").distinct().collect())  # partitions touched, not nodes
        known = self._known(done, parts)
        a, b = (known.select(F.col("node").alias(n), F.col("component").alias(c)) for n, c in (("src", "ca"), ("dst", "cb")))
        contracted = ends.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("ca", "src").alias("src"), F.coalesce("cb", "dst").alias("dst"))
        went = connected_components(contracted)
        arrivals = fresh.join(known.select("node"), "node", "left_anti").join(went, "node", "left").select("node", F.coalesce("component", "node").alias("entry"), "part")
        arrivals.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/nodes/batch={at}")
        before = self._moved(done)
        after = before.join(went.withColumnRenamed("node", "root").withColumnRenamed("component", "now"), "root", "left").select("component", F.coalesce("now", "root").alias("root"))
        here = went.where("node != component").select(F.col("node").alias("component"), F.col("component").alias("root"))
        moved = after.union(here.join(after.select("component"), "component", "left_anti"))
        moved.write.mode("overwrite").parquet(f"{self.path}/moved/batch={at}")
        self.spark.createDataFrame([(at,)], "batch int").coalesce(1).write.mode("append").parquet(f"{self.path}/commits")


def slab_part(bits: int):
    """Partition key of packed nodes: what stands above the lowest ``bits`` bits."""
    return lambda node: F.shiftright(node, bits) if isinstance(node, Column) else node >> bits
