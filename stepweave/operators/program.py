"""Vertex programs: a cyclic chain of compute steps and crunches (global reductions)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Context:
    """What a step knows: the superstep's number, the number of vertices, the crunch result delivered to it, if any, and what links have handed on."""

    superstep: int
    size: int
    crunched: object = None
    shared: dict = field(default_factory=dict)


def _changes(step: ComputeStep | CrunchStep, inbox: Column | None, context: Context) -> dict[str, Column] | None:
    """A step's new values of the state's columns, by name, or None if it changes none."""
    if step.columns is not None:
        return step.columns(F.lit(None) if inbox is None else inbox, context)
    if step.update is not None:
        return {"value": step.update(F.col("value"), F.lit(None).cast("double") if inbox is None else inbox, context)}
    return None


@dataclass(frozen=True)
class ComputeStep:
    """update(value, inbox, context): the new state, of Columns; inbox is null without mail.

    send(state, context): messages (src, dst, value) to any vertices, or None.
    combine: how mail for one vertex becomes its inbox.
    columns(inbox, context): new values of several state columns, by name, in
    place of update, for states of more than one column.
    link(state, context): tables and values to hand on, by name; later links
    find them in context.shared, until they are replaced.
    """

    update: Callable[[Column, Column, Context], Column] | None = None
    send: Callable[[DataFrame, Context], DataFrame | None] | None = None
    combine: Callable[[Column], Column] = F.sum
    columns: Callable[[Column, Context], dict[str, Column]] | None = None
    link: Callable[[DataFrame, Context], dict[str, object]] | None = None

    changes = _changes


@dataclass(frozen=True)
class CrunchStep:
    """Reduce all values: by an aggregate of Columns, or by any associative and commutative function of two values.

    update, combine and columns: as a ComputeStep has them, for mail sent just
    before; what is reduced are the values before they are updated.  A crunch
    sends nothing, and its result isn't in its own context.
    """

    aggregate: Callable[[Column], Column] | None = None
    fold: Callable[[object, object], object] | None = None
    update: Callable[[Column, Column, Context], Column] | None = None
    combine: Callable[[Column], Column] = F.sum
    columns: Callable[[Column, Context], dict[str, Column]] | None = None

    changes = _changes

    def run(self, state: DataFrame):
        if self.aggregate is not None:
            return state.agg(self.aggregate(F.col("value"))).first()[0]
        values, parts = state.select("value"), state.rdd.getNumPartitions()
        while True:  # a value for each partition, then for each eight of them
            values, parts = values.mapInArrow(self._folded(values.schema), values.schema), -(-parts // 8)
            if parts <= 1:
                break
            values = values.coalesce(parts)
        return reduce(self.fold, found) if (found := [r[0] for r in values.collect()]) else None

    def _folded(self, schema: StructType):
        fold, kind = self.fold, to_arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            values = chain.from_iterable(b.column(0).to_pylist() for b in batches)
            for first in values:  # none of an empty partition
                yield pa.RecordBatch.from_pydict({"value": [reduce(fold, values, first)]}, schema=kind)

        return run


@dataclass(frozen=True)
class Until:
    """Stop at the barrier at which holds(aggregate of all values) is true; the aggregate is worked out while the superstep's state is written."""

    aggregate: Callable[[Column], Column]
    holds: Callable[[object], bool]


class Program:
    """An ordered chain; superstep s runs step s mod its length."""

    def __init__(self, *steps: ComputeStep | CrunchStep):
        if not steps or isinstance(steps[0], CrunchStep):
            raise ValueError("a chain begins with a compute step")
        self.steps = steps

    def then(self, step: ComputeStep) -> Program:
        return Program(*self.steps, step)

    def crunch(self, aggregate: Callable[[Column], Column] | None = None, fold: Callable | None = None, **receive) -> Program:
        """receive: the CrunchStep's update, combine or columns."""
        return Program(*self.steps, CrunchStep(aggregate, fold, **receive))

    def __len__(self) -> int:
        return len(self.steps)

    def __getitem__(self, superstep: int) -> ComputeStep | CrunchStep:
        return self.steps[superstep % len(self.steps)]
