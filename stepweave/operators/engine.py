"""Run vertex programs as DataFrame supersteps."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import PropertyGraph
from .lineage import cut, dealt, free
from .program import ComputeStep, Context, CrunchStep, Program, Until
from .runs import Runs, counted, parallel, single

log = logging.getLogger(__name__)
#: Rows of one batch that a Python program gives on.
BATCH = 10_000


def run(graph: PropertyGraph, program: Program, iterations: int | None = None, until: Until | Callable[[DataFrame, int], bool] | None = None, columns: tuple[str, ...] = ("value",)) -> DataFrame:
    """Run supersteps 0, 1, ... and return the vertices (id and the state's columns) as they end.

    Ends after iterations supersteps, or when until holds at a barrier: an
    Until, or until(state, supersteps done), which may take a pass of its own;
    0 iterations are no bound, so need until.  Mail reaches the next superstep
    only.  A crunch takes a superstep, and its result is known to the next one; a
    run that ends on a crunch doesn't deliver it.  Mail sent just before a
    crunch goes to the crunch's own update, after the values were reduced; a
    crunch without one drops it.  Every superstep's state is a table, read for the
    values and for the mail, and goes when the next is there; so do the tables
    that links hand on, when they are replaced.  If mail is sent at all, states
    lie in buckets of id, so that a superstep moves nothing but its mail; and a
    crunch's aggregate, or Until's, is worked out as the state is written.
    """
    if (not iterations and until is None) or (iterations or 0) < 0 or (iterations and until is not None):
        raise ValueError("give a positive number of iterations, or until")
    size, shared, mail, crunched, seen, s = graph.size, {}, None, None, None, 0  # seen: of what aggregate the state knows the result
    state = graph.vertices.select("id", *columns)
    by = "id" if size and any(isinstance(x, ComputeStep) and x.send is not None for x in program.steps) else None
    if by:
        state = cut(dealt(state, by), by)
    while not iterations or s < iterations:
        step, context = program[s], Context(s, size, crunched, shared)
        crunch = isinstance(step, CrunchStep)
        if crunch:  # of the values as the superstep finds them, before mail changes any
            crunched = state.observed if step.aggregate is not None and seen is step.aggregate else step.run(state)
        else:
            crunched = None
        inbox = None if mail is None else mail.groupBy(F.col("dst").alias("id")).agg(step.combine(F.col("value")).alias("inbox"))
        if (new := step.changes(None if inbox is None else F.col("inbox"), context)) is not None:
            before, whole = state, state if inbox is None else state.join(inbox, "id", "left")
            after = whole.select("id", *[new.get(c, F.col(c)).alias(c) for c in columns])
            seen = _watched(program[s + 1], until) if size else None
            state = cut(after, by, seen and seen(F.col("value")))
            free(before)
        if not crunch and step.link is not None:
            for name, value in step.link(state, context).items():
                if isinstance(shared.get(name), DataFrame):
                    free(shared[name])
                shared[name] = value
        mail = step.send(state, context) if not crunch and step.send is not None else None
        s += 1
        log.debug("superstep %d done", s)
        if isinstance(until, Until):
            if until.holds(state.observed if seen is until.aggregate else state.agg(until.aggregate(F.col("value"))).first()[0]):
                break
        elif until is not None and until(state, s):
            break
    free(*[x for x in shared.values() if isinstance(x, DataFrame)])
    return state


def _watched(following: ComputeStep | CrunchStep, until: object) -> Callable[[Column], Column] | None:
    """What is to be worked out of the values while they are written: Until's aggregate, or that of the crunch that follows."""
    if isinstance(until, Until):
        return until.aggregate
    return following.aggregate if isinstance(following, CrunchStep) else None


def run_update(graph: PropertyGraph, update: Callable, iterations: int, combine: Callable[[Column], Column] | None = None, crunch: Callable[[int], CrunchStep | None] | None = None) -> DataFrame:
    """Run an arbitrary Python vertex function, where Columns can't say it.

    update(superstep, size, id, value, inbox, neighbours) -> (value, iterable of
    (dst, value)); inbox is the sequence of received values, empty without mail, or
    with combine the one value that an aggregate of Columns makes of them
    before they are moved.  Batches of vertices go through one call of Python
    each; mail to ids that are no vertices is dropped.  Values are doubles.
    Parallel edges and equal messages are kept as Runs, so an update that gives
    its messages one by one takes memory for different ones alone, and one that
    gives (dst, value, times) for neighbours.runs() takes no time for the others
    either; mail that no superstep takes is not asked for.
    Repeated vertex ids are vertices of their own, and each gets their mail.
    Superstep s is a crunch where crunch(s) is a CrunchStep: its aggregate or
    fold reduces the values that the superstep finds; update runs as ever, with
    the mail sent before, but what it sends then is dropped, and the result is
    all that every vertex finds in its inbox one superstep later.
    """
    if iterations < 1:
        raise ValueError("give a positive number of iterations")
    kind = dict(graph.vertices.dtypes)["id"]
    size = graph.size
    listed = lambda df, by, what: df.groupBy(F.col(by).alias("id")).agg(F.collect_list(F.struct(what, "times")).alias("runs"))
    neighbours = cut(listed(parallel(graph.edges.where("dst IS NOT NULL")), "src", "dst").select("id", F.col("runs.dst").alias("near"), F.col("runs.times").alias("near_times")))
    state = graph.vertices.select("id", F.col("value").cast("double").alias("value"))
    out, mail, told = None, None, None
    for s in range(iterations):
        reduce = crunch(s) if crunch else None
        result = None if reduce is None else (reduce.run(state),)

        def step(batches: Iterator[pa.RecordBatch], s: int = s, heard: bool = result is None and s < iterations - 1) -> Iterator[pa.RecordBatch]:
            waiting, schema = [], None

            def batch() -> pa.RecordBatch:
                made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*waiting, strict=True), schema.types, strict=True)], schema=schema)
                waiting.clear()
                return made

            for given in batches:
                ids = given.schema.field("id").type
                schema = pa.schema([("id", ids), ("value", pa.float64()), ("dst", ids), ("times", pa.int64())])
                for i, value, inbox, often, near, times in zip(*(c.to_pylist() for c in given.columns), strict=True):
                    value, sent = update(s, size, i, value, Runs(inbox, often), Runs(near, times))
                    waiting.append((i, value, None, None))
                    for to, x, n in counted(sent) if heard else ():
                        if to is not None:
                            waiting.append((None, x, to, n))
                        if len(waiting) >= BATCH:
                            yield batch()
                if waiting:
                    yield batch()

        if told is not None:
            whole = state.withColumn("inbox", F.array(F.lit(told[0]).cast("double"))).withColumn("inbox_times", F.array(F.lit(1).cast("long")))
        elif mail is None:
            whole = state.withColumn("inbox", F.lit(None).cast("array<double>")).withColumn("inbox_times", F.lit(None).cast("array<bigint>"))
        elif combine is None:
            equal = mail.where("value IS NOT NULL").groupBy("dst", "value").agg(F.sum("times").alias("times"))
            whole = state.join(listed(equal, "dst", "value").select("id", F.col("runs.value").alias("inbox"), F.col("runs.times").alias("inbox_times")), "id", "left")
        else:
            one = single(mail).groupBy(F.col("dst").alias("id")).agg(F.array(combine(F.col("value"))).alias("inbox"))
            whole = state.join(one.withColumn("inbox_times", F.array(F.lit(1).cast("long"))), "id", "left")
        before, out = out, cut(whole.join(neighbours, "id", "left").select("id", "value", "inbox", "inbox_times", "near", "near_times").mapInArrow(step, f"id {kind}, value double, dst {kind}, times long"))
        free(before)
        state, mail, told = out.where("times IS NULL").select("id", "value"), out.where("times IS NOT NULL").select("dst", "value", "times"), result
    free(neighbours)
    return state
