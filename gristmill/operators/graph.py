"""Connected components of an undirected edge list."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from gristmill.lineage import stable
from gristmill.operators.skew import hot_limit, spread_join


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _lowest(edges: DataFrame, total: int) -> DataFrame:
    """``edges`` with ``m``, the smallest ``b`` of each ``a``; edges of a hub stay where they are."""
    limit = hot_limit(total, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hubs = stable(edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).where(F.col("n") > limit).drop("n"))
    low = F.min("b").over(Window.partitionBy("a"))
    if hubs.isEmpty():
        return edges.withColumn("m", low)
    rest = edges.join(F.broadcast(hubs.select("a")), "a", "left_anti")
    return edges.join(F.broadcast(hubs), "a").unionByName(rest.withColumn("m", low))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node, component`` of every node that an edge touches; the component is its smallest node.

    Alternates large-star and small-star contraction, so rounds grow with the logarithm of a component's
    diameter. A hub's neighbours are never gathered: its smallest one is found by partial aggregation and broadcast
    to the edges, as there are few hubs. Each round is checkpointed in the shared folder. Nodes may be of any ordered type; self-loops count as nodes, null ends are ignored.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    alone = stable(pairs.where("a = b").select("a").distinct())
    now = stable(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    for _ in range(max_rounds):
        mark = _signature(now)
        if mark == last or mark[0] == 0:
            break
        last = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = stable(_lowest(both, 2 * mark[0]).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")))
        # Of a node's edges the one to its smallest neighbour stays, the others go from the neighbour to that one.
        small = _lowest(large, mark[0]).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        now = stable(small.distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return found.unionByName(roots).unionByName(alone.select(F.col("a").alias("node"), F.col("a").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))


@dataclass
class Forest:
    """Components that have grown batch by batch. ``nodes``: ``node, component``. ``components``: ``component, split, batch, size``.

    A component's name is its smallest node; ``batch`` is that of its oldest part, whose split it keeps.
    """

    nodes: DataFrame
    components: DataFrame

    def save(self, path: str) -> None:
        """Writes both tables below ``path``, which must be new."""
        self.nodes.write.parquet(f"{path}/nodes")
        self.components.write.parquet(f"{path}/components")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forest:
        return cls(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/components"))


def _named(edges: DataFrame, end: str, nodes: DataFrame) -> DataFrame:
    """``edges`` with the component of ``end`` in its place, or itself where it is new; hubs stay where they are."""
    ends = edges.groupBy(end).agg(F.count("*").alias("_c"))
    known = ends.join(nodes.select(F.col("node").alias(end), F.col("component").alias("_to")), end, "left")
    side = stable(known.select(end, F.coalesce("_to", end).alias("_to"), "_c"))
    found = spread_join(edges, side, end, "_c", side.agg(F.sum("_c")).first()[0] or 0)
    return stable(found.drop(end).withColumnRenamed("_to", end))


def grow(forest: Forest | None, edges: DataFrame, batch: int, split_of: Callable[[Column], Column], a: str = "a", b: str = "b") -> tuple[Forest, DataFrame]:
    """The forest with the edges of a new batch, and ``component, split, lost_component, lost_split`` of what had to change its split.

    Only the roots of trees that the new edges touch are contracted; all other components keep their rows as they are.
    The components are those of one run over all edges so far. A component made in this batch gets ``split_of`` its
    name. One that grows, or takes in others, keeps the split of its oldest part (the first batch, then the smallest
    name), so later batches move as few nodes as can be: those of younger parts with another split, which are reported.

    Batches must come with rising numbers. Nodes may be of any ordered type; self-loops make nodes, null ends are ignored.
    """
    pairs = stable(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct())
    kind = pairs.schema["a"].dataType
    first = forest is None
    if forest is None:
        spark = edges.sparkSession
        none = StructType([StructField("node", kind), StructField("component", kind)])
        forest = Forest(spark.createDataFrame([], none), spark.createDataFrame([], StructType([StructField("component", kind)]).add("split", "string").add("batch", "integer").add("size", "long")))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    fresh = stable(ends.join(forest.nodes, "node", "left_anti"))
    touching = pairs if first else _named(_named(pairs, "a", forest.nodes), "b", forest.nodes)
    roots = stable(connected_components(touching).toDF("_root", "_top"))
    alone = fresh.select(F.col("node").alias("component"), F.lit(None).cast("string").alias("split"), F.lit(batch).alias("batch"), F.lit(1).cast("long").alias("size"))
    parts = forest.components.unionByName(alone).join(roots, F.col("component") == F.col("_root"), "left").withColumn("_top", F.coalesce("_top", "component")).drop("_root")
    parts = stable(parts)  # one row for each component before, and each new node

    # Of the parts of a component the oldest with a split decides; new nodes have none yet.
    oldest = F.min_by("split", F.when(F.col("split").isNotNull(), F.struct("batch", "component")))
    made = parts.groupBy("_top").agg(oldest.alias("_kept"), F.min("batch").alias("batch"), F.sum("size").alias("size"))
    made = stable(made.select(F.col("_top").alias("component"), F.coalesce("_kept", split_of(F.col("_top"))).alias("split"), "batch", "size"))
    lost = parts.where("split IS NOT NULL").select(F.col("component").alias("lost_component"), F.col("split").alias("lost_split"), F.col("_top").alias("component"))
    conflicts = lost.join(made.select("component", "split"), "component").where("lost_split <> split").select("component", "split", "lost_component", "lost_split")

    moved = parts.select(F.col("component").alias("_old"), "_top", "size")
    before = forest.nodes.select("node", F.col("component").alias("_old")).unionByName(fresh.select("node", F.col("node").alias("_old")))
    nodes = spread_join(before, moved, "_old", "size", moved.agg(F.sum("size")).first()[0] or 0)
    return Forest(stable(nodes.select("node", F.col("_top").alias("component"))), made), conflicts
