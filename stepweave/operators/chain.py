"""Agglomerative clustering as a vertex program: a chain of four links for each merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import mean, pearson
from .cluster import MERGES, pairs
from .engine import run
from .graph import PropertyGraph
from .lineage import cut, folder
from .program import ComputeStep, Context, Program

#: Merges that the driver has before they are written out.
BLOCK = 64
#: The least pair of a table (kept, removed, d), one without a distance last.
LEAST = "min(struct(isnan(d) AS nan, d, kept, removed))"


def hcluster_program(matrix: DataFrame, arith: str = "int64") -> DataFrame:
    """The merges of hcluster's mode bsp, by four supersteps each on a graph of a vertex for each row.

    A vertex's state is its cluster, that one's vector and whether it is live.
    The links hand on a table of the distances of live pairs (kept, removed, d):

    1. at the very beginning, the distances of all pairs;
    2. the least of them, found while the table was written, is told to the links
       that follow, and the vertex of the cluster to be removed sends its vector
       to that of the one to be kept;
    3. the vertex that got mail becomes the merged cluster, the other one ends;
    4. the merged cluster's distances to all others join the table, as (other,
       merged), and those of the two are dropped.

    The driver knows one pair a merge.  A merge reads and writes the table of
    pairs once; hcluster_distributed does the same merges with less.  No distance at all is a
    ValueError; a single row or none have no merges.
    """
    spark, path, block = matrix.sparkSession, folder(matrix.sparkSession), []
    start = cut(matrix.select("id", F.col("id").cast("int").alias("cluster"), F.col("vec").cast("array<int>").alias("vec"), F.lit(True).alias("live")))
    graph = PropertyGraph.isolated(start)

    def write() -> None:
        spark.createDataFrame(block, MERGES).coalesce(1).write.mode("append").parquet(path)
        block.clear()

    def all_pairs(state: DataFrame, at: Context) -> dict:
        if at.superstep:
            return {}
        return {"pairs": cut(pairs(state.select(F.col("cluster").alias("id"), "vec"), arith).toDF("kept", "removed", "d"), observed=F.expr(LEAST))}

    def least(state: DataFrame, at: Context) -> dict:
        best = at.shared["pairs"].observed
        if best["nan"]:
            raise ValueError("no two clusters have a distance")
        return {"best": best, "new": -(at.superstep // 4) - 1}

    def tell(state: DataFrame, at: Context) -> DataFrame:
        best, live = at.shared["best"], state.where("live")
        to = live.where(F.col("cluster") == best["kept"]).select(F.col("id").alias("dst"))  # one row
        return live.where(F.col("cluster") == best["removed"]).select(F.col("id").alias("src"), F.col("vec").alias("value")).join(F.broadcast(to), how="cross").select("src", "dst", "value")

    def merge(inbox: Column, at: Context) -> dict[str, Column]:
        mine, goes = inbox.isNotNull(), F.col("live") & (F.col("cluster") == at.shared["best"]["removed"])
        return {"cluster": F.when(mine, F.lit(at.shared["new"])).otherwise(F.col("cluster")), "vec": F.when(mine, mean(F.col("vec"), inbox)).otherwise(F.col("vec")), "live": F.col("live") & ~goes}

    def measure(state: DataFrame, at: Context) -> dict:
        best, new = at.shared["best"], at.shared["new"]
        merged = state.where(F.col("live") & (F.col("cluster") == new)).select(F.col("vec").alias("with"))  # one row
        others = state.where(F.col("live") & (F.col("cluster") != new)).join(F.broadcast(merged), how="cross")
        fresh = others.select(F.col("cluster").alias("kept"), F.lit(new).alias("removed"), pearson(F.col("vec"), F.col("with"), arith).alias("d"))
        gone = (best["kept"], best["removed"])
        block.append((new, *gone, best["d"], merged.first()["with"]))
        if len(block) >= BLOCK:
            write()
        return {"pairs": cut(at.shared["pairs"].where(~F.col("kept").isin(*gone) & ~F.col("removed").isin(*gone)).unionByName(fresh), observed=F.expr(LEAST))}

    if graph.size > 1:
        chain = Program(ComputeStep(link=all_pairs), ComputeStep(link=least, send=tell), ComputeStep(columns=merge, combine=F.first), ComputeStep(link=measure))
        run(graph, chain, 4 * (graph.size - 1), columns=("cluster", "vec", "live"))
    write()
    return spark.read.schema(MERGES).parquet(path)
