"""Vertex functions in Python over streams: no vertex's mail or neighbours are ever one row or one list."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, repeat, starmap

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .graph import PropertyGraph
from .lineage import cut, dealt, free
from .program import CrunchStep
from .runs import counted, parallel, single

#: Rows of one batch that is given on.
BATCH = 10_000
#: Buckets for a vertex at most; of more, nearly all would be empty, and each is a task in every superstep.
SPREAD = 4
STATE, MAIL, EDGE = 0, 1, 2


class _Rows:
    """Rows (id, kind, value, near, degree, times) of a task, with a look at the next one."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self._rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        self.ahead = next(self._rows, None)

    def take(self) -> tuple:
        row, self.ahead = self.ahead, next(self._rows, None)
        return row

    def of(self, i: object, kind: int, column: int) -> Iterator[tuple]:
        """A column of the rows of vertex i of this kind, and how often each row stands for it; those of kinds before it that weren't read are passed over."""
        while self.ahead and self.ahead[0] == i and self.ahead[1] <= kind:
            row = self.take()
            if row[1] == kind:
                yield row[column], row[5]


class _Stream:
    """An iterator of values that come in runs."""

    def __init__(self, runs: Iterator[tuple]):
        self._runs = runs
        self._single = chain.from_iterable(starmap(repeat, runs))

    def runs(self) -> Iterator[tuple]:
        """Each value with how often it comes, in place of the values; runs of equal values may stand behind each other."""
        return self._runs

    def __iter__(self) -> Iterator:
        return self._single

    def __next__(self) -> object:
        return next(self._single)


def run_streamed(graph: PropertyGraph, update: Callable, iterations: int, combine: Callable[[Column], Column] | None = None, crunch: Callable[[int], CrunchStep | None] | None = None) -> DataFrame:
    """As run_update, for vertices with any number of neighbours and any mail.

    update(superstep, size, id, value, inbox, neighbours, degree) -> (value,
    iterable of (dst, value)).  inbox and neighbours are iterators, which are
    read once, the inbox first; the iterable may read neighbours as it goes, and
    give (dst, value, times) for each (dst, times) of neighbours.runs(), which
    takes no time for parallel edges.  A vertex is a run of rows in the stream of
    its task: its state, its mail, then its neighbours.  So a task's memory is
    that of a few batches.  Edges lie in the buckets of their source, at most
    SPREAD for a vertex, beside the states, parallel ones as one row, and equal
    messages behind each other are one row too; mail that no superstep takes is
    not asked for.  With combine, mail for a vertex is one value, made before it
    is moved.  Ids must be different and not null, or it is a ValueError; mail to
    ids that are no vertices is dropped.
    crunch: as run_update has it.
    """
    if iterations < 1:
        raise ValueError("give a positive number of iterations")
    kind, size = dict(graph.vertices.dtypes)["id"], graph.size
    buckets = min(int(graph.vertices.sparkSession.conf.get("spark.sql.shuffle.partitions")), SPREAD * max(1, size))
    pairs = cut(dealt(parallel(graph.edges), "src", buckets), "src", None, buckets)
    try:
        PropertyGraph(graph.vertices, pairs).validate()
    except ValueError:
        free(pairs)
        raise
    start = graph.vertices.select("id", F.col("value").cast("double").alias("value"))
    if not size:
        free(pairs)
        return start
    if start.where("id IS NULL").limit(1).count():
        free(pairs)
        raise ValueError("a vertex has no id")
    arrow = to_arrow_type(graph.vertices.schema["id"].dataType)
    schema = pa.schema([("id", arrow), ("value", pa.float64()), ("degree", pa.int64()), ("times", pa.int64())])
    none = lambda t: F.lit(None).cast(t)
    degree = pairs.groupBy(F.col("src").alias("id")).agg(F.sum("times").alias("degree"))
    state = cut(dealt(start.join(degree, "id", "left").select("id", "value", F.coalesce("degree", F.lit(0).cast("long")).alias("degree")), "id", buckets), "id", None, buckets)
    out, mail, told = state, None, None
    for s in range(iterations):
        reduce = crunch(s) if crunch else None
        result = None if reduce is None else (reduce.run(state),)

        def step(batches: Iterator[pa.RecordBatch], s: int = s, heard: bool = result is None and s < iterations - 1) -> Iterator[pa.RecordBatch]:
            rows, waiting = _Rows(batches), []

            def batch() -> pa.RecordBatch:
                made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*waiting, strict=True), schema.types, strict=True)], schema=schema)
                waiting.clear()
                return made

            while rows.ahead:
                i, what, value, _, degree, _ = rows.ahead
                if what == STATE:
                    rows.take()
                    value, messages = update(s, size, i, value, _Stream(rows.of(i, MAIL, 2)), _Stream(rows.of(i, EDGE, 3)), degree)
                    waiting.append((i, value, degree, None))
                    for to, x, n in counted(messages) if heard else ():
                        waiting.append((to, x, None, n))
                        if len(waiting) >= BATCH:
                            yield batch()
                while rows.ahead and rows.ahead[0] == i:  # what wasn't read, and mail to no vertex
                    rows.take()
                if len(waiting) >= BATCH:
                    yield batch()
            if waiting:
                yield batch()

        every = state.select("id", F.lit(STATE).alias("kind"), "value", none(kind).alias("near"), "degree", none("long").alias("times")).unionByName(
            pairs.select(F.col("src").alias("id"), F.lit(EDGE).alias("kind"), none("double").alias("value"), F.col("dst").alias("near"), none("long").alias("degree"), "times"))
        if mail is not None:
            got = mail if combine is None else single(mail).groupBy("id").agg(combine(F.col("value")).alias("value")).withColumn("times", F.lit(1).cast("long"))
            if told is not None:
                got = state.select("id", F.lit(told[0]).cast("double").alias("value"), F.lit(1).cast("long").alias("times"))
            every = every.unionByName(got.select("id", F.lit(MAIL).alias("kind"), "value", none(kind).alias("near"), none("long").alias("degree"), "times"))
        before, out = out, cut(dealt(every, "id", buckets).sortWithinPartitions("id", "kind").mapInArrow(step, f"id {kind}, value double, degree long, times long"))
        free(before)
        state, mail, told = out.where("times IS NULL").select("id", "value", "degree"), out.where("times IS NOT NULL").select("id", "value", "times"), result
    free(pairs)
    return state.select("id", "value")
