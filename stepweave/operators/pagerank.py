"""PageRank as a vertex program."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .engine import run
from .graph import PropertyGraph
from .lineage import cut, dealt, free
from .program import ComputeStep, Context, Program
from .runs import parallel

#: A vertex with more out-edges than this is a hub.
HUB = 1_000_000


class Shares:
    """Edges with their part of their source's out-degree, in the buckets of their source; parallel edges count each.

    They are dealt once, as they are; only where there are more edges than pairs
    of vertices are parallel ones made one row before.  Those of hubs (sources of
    more than `hub` edges) are spread over all tasks, to which the hubs' states
    are sent: there are fewer than edges / hub of them.
    """

    def __init__(self, graph: PropertyGraph, hub: int = HUB):
        degree = cut(graph.edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree")))
        self._hubs = cut(degree.where(F.col("degree") > hub))
        some = self._hubs.limit(1).count() > 0
        dense = (degree.agg(F.sum("degree")).first()[0] or 0) > graph.size**2
        edges = parallel(graph.edges) if dense else graph.edges.select("src", "dst", F.lit(1).alias("times"))
        part = (F.col("times") / F.col("degree")).alias("share")
        plain = edges.join(F.broadcast(self._hubs.select("src")), "src", "left_anti") if some else edges
        self._plain = cut(dealt(plain, "src").join(degree.hint("shuffle_hash"), "src").select("src", "dst", part), "src")
        self._spread = None
        if some:
            of_hubs = parallel(graph.edges.join(F.broadcast(self._hubs.select("src")), "src", "left_semi"))
            self._spread = cut(of_hubs.join(F.broadcast(self._hubs), "src").select("src", "dst", part).repartition(int(degree.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        free(degree)

    def mail(self, state: DataFrame) -> DataFrame:
        """(src, dst, value): each state's value, shared among its out-edges.  A bucket's states are looked up, so its edges are not sorted."""
        part = (F.col("value") * F.col("share")).alias("value")
        mail = self._plain.join(state.hint("shuffle_hash"), F.col("src") == F.col("id")).select("src", "dst", part)
        if self._spread is None:
            return mail
        of_hubs = state.join(F.broadcast(self._hubs), state["id"] == self._hubs["src"]).select("id", "value")
        return mail.unionByName(self._spread.join(F.broadcast(of_hubs), F.col("src") == F.col("id")).select("src", "dst", part))

    def free(self) -> None:
        free(self._plain, self._spread, self._hubs)


def pagerank(graph: PropertyGraph, iterations: int, init: float = 0.0, send_until: int | None = 30, damping: float = 0.85, hub: int = HUB) -> DataFrame:
    """(id, value) after iterations supersteps, that is one update fewer.

    Vertices without out-edges send nothing, so their rank is lost.  After
    superstep send_until - 1 none send (None: all do), and an update without
    mail leaves (1 - damping) / N.  Parallel edges count each.  Shares lie
    beside their source's state, so that each superstep moves mail alone.
    """
    shares = Shares(graph, hub)

    def update(value: Column, inbox: Column, at: Context) -> Column:
        return value if at.superstep == 0 else F.lit((1 - damping) / at.size) + damping * F.coalesce(inbox, F.lit(0.0))

    def send(state: DataFrame, at: Context) -> DataFrame | None:
        if at.superstep >= iterations - 1 or (send_until is not None and at.superstep >= send_until):
            return None
        return shares.mail(state)

    start = PropertyGraph(graph.vertices.select("id", F.lit(float(init)).alias("value")), graph.edges)
    ranks = run(start, Program(ComputeStep(update, send)), iterations)
    shares.free()
    return ranks


def with_titles(ranks: DataFrame, titles: DataFrame) -> DataFrame:
    """Ranks with their title, or no_title[id] where titles (label, title) has none."""
    return ranks.join(titles, ranks["id"].cast("string") == titles["label"], "left").select("id", F.coalesce("title", F.concat(F.lit("no_title["), F.col("id").cast("string"), F.lit("]"))).alias("title"), "value")


def top(ranks: DataFrame, n: int = 10, digits: int = 10) -> DataFrame:
    """The n largest by rounded value, ties by id."""
    return ranks.withColumn("value", F.round("value", digits)).orderBy(F.desc("value"), "id").limit(n)
