"""Property graphs: a frame of vertices (id, value, ...) and a bag of edges (src, dst)."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut


@dataclass
class PropertyGraph:
    """vertices: id and whatever state columns; edges: src, dst, parallel edges and self-loops included."""

    vertices: DataFrame
    edges: DataFrame
    _cache: dict = field(default_factory=dict, repr=False)

    @classmethod
    def from_edges(cls, edges: DataFrame, value: float = 0.0) -> PropertyGraph:
        """Vertices are all sources and targets, each once, in state value.  Both are made once, as tables."""
        edges = cut(edges)
        ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).where("id is not null").distinct()
        return cls(cut(ids).withColumn("value", F.lit(value)), edges)

    @classmethod
    def isolated(cls, vertices: DataFrame) -> PropertyGraph:
        kind = dict(vertices.dtypes)["id"]
        return cls(vertices, vertices.sparkSession.createDataFrame([], f"src {kind}, dst {kind}"))

    def validate(self) -> PropertyGraph:
        """Raise ValueError on repeated ids or edges without vertices."""
        if self.vertices.groupBy("id").count().where("count > 1").limit(1).count():
            raise ValueError("vertex ids repeat")
        ends = self.edges.select(F.col("src").alias("id")).union(self.edges.select("dst"))
        if ends.join(self.vertices, "id", "left_anti").limit(1).count():
            raise ValueError("an edge's end is no vertex")
        return self

    def kept(self) -> PropertyGraph:
        """The same graph with its edges as a table, so that what makes them runs once."""
        return PropertyGraph(self.vertices, cut(self.edges))

    def leader(self, state: DataFrame | None = None) -> DataFrame:
        """The one vertex of the least id, of state or of the graph."""
        return (self.vertices if state is None else state).orderBy("id").limit(1)

    @cached_property
    def size(self) -> int:
        return self.vertices.count()

    def out_degree(self) -> DataFrame:
        """(id, degree): parallel edges count each; 0 for vertices that send nothing."""
        n = self.edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
        return self.vertices.select("id").join(n, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))

    def in_degree(self) -> DataFrame:
        n = self.edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
        return self.vertices.select("id").join(n, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))

    def dangling(self) -> DataFrame:
        return self.vertices.select("id").join(self.edges.select(F.col("src").alias("id")), "id", "left_anti")

    def shares(self) -> DataFrame:
        """(src, dst, share): parallel edges as one row with their part of src's out-degree."""
        pair = self.edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
        degree = pair.groupBy("src").agg(F.sum("n").alias("degree"))
        return pair.join(degree, "src").select("src", "dst", (F.col("n") / F.col("degree")).alias("share"))
