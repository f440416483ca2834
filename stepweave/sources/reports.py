"""Text forms of graphs and ranks, and a timing log."""

from __future__ import annotations

import os
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import PropertyGraph


def adjacency_lines(graph: PropertyGraph, newest_first: bool = False) -> DataFrame:
    """(id, line): `id: dst dst ...` of every vertex, targets in order (or in reverse, where order says when they came)."""
    near = graph.edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(F.col("dst").cast("string")), not newest_first).alias("d"))
    return graph.vertices.select("id").join(near, "id", "left").select("id", F.concat(F.col("id").cast("string"), F.lit(":"), F.coalesce(F.concat(F.lit(" "), F.array_join("d", " ")), F.lit(""))).alias("line"))


def rank_lines(titled: DataFrame) -> DataFrame:
    return titled.select(F.concat("title", F.lit(" has rank "), F.col("value").cast("string")).alias("line"))


def value_lines(state: DataFrame) -> DataFrame:
    return state.select(F.concat_ws(": ", F.col("id").cast("string"), F.col("value").cast("string")).alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    """The first column as a text file folder."""
    lines.select(lines.columns[0]).write.mode("overwrite").text(path)


class Timings:
    """Nested timings: tic() ... toc(description), or with timed(description)."""

    def __init__(self, name: str = "run"):
        self.name, self.times, self._starts, self._unnamed = name, [], [], 0

    def tic(self) -> None:
        self._starts.append(time.perf_counter())

    def toc(self, description: str = "") -> float:
        ms = (time.perf_counter() - self._starts.pop()) * 1000
        if not description:  # those without one are counted by themselves
            description, self._unnamed = f"time{self._unnamed}", self._unnamed + 1
        self.times.append((description, ms))
        return ms

    @contextmanager
    def timed(self, description: str = ""):
        self.tic()
        try:
            yield self
        finally:
            self.toc(description)

    def lines(self) -> list[str]:
        if not self.times:
            raise ValueError("no timing recorded")
        return [f"Timings for {self.name}", "description:\t" + "\t".join(d for d, _ in self.times), "times(ms):\t" + "\t".join(f"{t:.0f}" for _, t in self.times)]

    def append_to(self, path: str) -> None:
        """Append the log; a file that has its head already gets the last line only."""
        begun = os.path.exists(path) and open(path, encoding="utf-8").read(7) == "Timings"
        with open(path, "a", encoding="utf-8") as f:
            f.write("\n".join(self.lines()[2 if begun else 0 :]) + "\n")
