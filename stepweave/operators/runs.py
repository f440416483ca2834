"""Equal neighbours and equal messages are kept once, with how often they come."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence
from itertools import accumulate, chain, groupby, repeat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Messages that one row stands for at most, so that rows stay small where they are made single again.
RUN = 10_000


class Runs(Sequence):
    """A list in which each value comes so many times, without being that long."""

    def __init__(self, values: list | None, times: list[int] | None):
        self._values, self._times = values or [], times or []
        self._ends = list(accumulate(self._times))

    def __len__(self) -> int:
        return self._ends[-1] if self._ends else 0

    def runs(self) -> Iterator[tuple]:
        """Each value with how often it comes."""
        return zip(self._values, self._times, strict=True)

    def __iter__(self) -> Iterator:
        return chain.from_iterable(map(repeat, self._values, self._times))

    def __getitem__(self, at):
        if isinstance(at, slice):
            return [self[k] for k in range(*at.indices(len(self)))]
        if not -len(self) <= at < len(self):
            raise IndexError(at)
        return self._values[bisect_right(self._ends, at % len(self))]

    def __add__(self, other: Iterable) -> list:
        return [*self, *other]

    def __radd__(self, other: Iterable) -> list:
        return [*other, *self]


def counted(messages: Iterable[tuple]) -> Iterator[tuple]:
    """(dst, value, times) of messages (dst, value) or (dst, value, times), equal ones behind each other as one."""
    for (to, x, *often), run in groupby(messages):
        n = sum(1 for _ in run) * (often[0] if often else 1)
        for k in range(0, n, RUN):
            yield to, x, min(RUN, n - k)


def single(mail: DataFrame) -> DataFrame:
    """mail with a row for each of its times, for aggregates of Columns."""
    return mail.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("_", "times")


def parallel(edges: DataFrame) -> DataFrame:
    """(src, dst, times) of edges."""
    return edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("times"))
