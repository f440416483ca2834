"""The closest pair of many rows, without looking at all pairs: angles to pivots bound distances from below."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import pearson, total
from .cluster import closest, measured
from .lineage import cut, free

#: Rows to which all angles are taken, and of how many of them cells are made.
PIVOTS, CELLED = 8, 3
#: Of how many rows that vary least all pairs are looked at for a first bound.
STILL = 1_000
#: More than any rounding of an angle.
ROUNDING = 1e-6


def _sums(vec: Column) -> tuple[Column, Column, Column]:
    """Length, sum and length x variation of an array, exact."""
    n, s = F.size(vec).cast("long"), total(vec, lambda x: x)
    return n, s, n * total(vec, lambda x: x * x) - s * s


def _angle(x: Column, y: Column) -> Column:
    """Between two centred vectors: the arc cosine of their correlation, which is a metric."""
    n, sx, vx = _sums(x)
    _, sy, vy = _sums(y)
    product = F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("long") * q.cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    r = (n * product - sx * sy).cast("double") / (F.sqrt(vx.cast("double")) * F.sqrt(vy.cast("double")))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def _within(best: float, slack: Column) -> Column:
    """The largest angle of two rows whose distance is at most best, null where there are no such rows.

    Truncated quotients make a product sum larger by less than 1, and
    variations no smaller, so the correlation that the distance is made of is
    at most the true one and slack, the inverse of the root of both variations.
    This holds for distances under 1.  Where best is negative, rows that vary
    so much that slack is less than -best are never that close.
    """
    least = F.lit(1.0 - best) - slack
    return F.when(least <= 1.0 + ROUNDING, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), least))) + ROUNDING)


def placed(vectors: DataFrame, count: int) -> DataFrame:
    """vectors (id, vec) that vary, with `slack` (their part of it) and `a`, the angles to the PIVOTS rows of least hash."""
    pivots = [r["vec"] for r in vectors.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).select("vec").collect()]
    angles = F.array(*[_angle(F.col("vec"), F.expr(f"array({', '.join(map(str, p))})")) for p in pivots])
    n, _, v = _sums(F.col("vec"))
    return vectors.select("id", "vec", F.sqrt(n.cast("double") / v.cast("double")).alias("slack"), angles.alias("a"))


def _class() -> Column:
    """Rows of about the same variation: half a power of two."""
    return F.floor(-4 * F.log2("slack"))


def _classes(rows: DataFrame, best: float) -> DataFrame:
    """(lower, upper, width): classes of slack that may hold a pair of distance best or less, and the largest angle of one."""
    most = {r["class"]: r["slack"] for r in rows.groupBy(_class().alias("class")).agg(F.max("slack").alias("slack")).collect()}  # a few for each power of two
    least = {(k, m): 1.0 - best - most[k] * most[m] for k in most for m in most if k <= m}
    kept = [(k, m, math.acos(max(-1.0, min(1.0, x))) + ROUNDING) for (k, m), x in least.items() if x <= 1.0 + ROUNDING]
    return rows.sparkSession.createDataFrame(kept, "lower long, upper long, width double")


def candidates(rows: DataFrame, best: float) -> DataFrame:
    """Pairs (i, j, x, y) of placed rows, i < j, that may have a distance of best or less, and few others.

    What angle counts depends on how much the two rows vary, so each two classes
    of slack are joined by themselves, and those too far apart at any angle not
    at all.  Their rows meet in cells of the angles to CELLED pivots, as wide as
    the largest angle that counts, one side in all neighbours of its cell; then
    the angles to all pivots are compared, within what the two rows' own slack
    allows.
    """
    classes = F.broadcast(_classes(rows, best))
    cells = [f"c{k}" for k in range(CELLED)]

    def side(name: str, own: str) -> DataFrame:
        cell = lambda k: F.floor(F.coalesce(F.get("a", F.lit(k)), F.lit(0.0)) / F.col("width")).alias(cells[k])
        return rows.withColumn(own, _class()).join(classes, own).select(*[F.col(c).alias(f"{name}_{c}") for c in ("id", "vec", "slack", "a")], "lower", "upper", *map(cell, range(CELLED)))

    left, right = side("l", "lower"), side("r", "upper")
    for c in cells:
        right = right.withColumn(c, F.explode(F.array(*[F.col(c) + step for step in (-1, 0, 1)])))
    met = left.join(right, ["lower", "upper", *cells]).where((F.col("l_id") < F.col("r_id")) | ((F.col("lower") < F.col("upper")) & (F.col("l_id") > F.col("r_id"))))
    apart = F.greatest(*[F.abs(F.get("l_a", F.lit(k)) - F.get("r_a", F.lit(k))) for k in range(PIVOTS)])
    ordered = F.col("l_id") < F.col("r_id")
    first = lambda c: F.when(ordered, F.col(f"l_{c}")).otherwise(F.col(f"r_{c}"))
    second = lambda c: F.when(ordered, F.col(f"r_{c}")).otherwise(F.col(f"l_{c}"))
    return met.where(apart <= _within(best, F.col("l_slack") * F.col("r_slack"))).select(first("id").alias("i"), second("id").alias("j"), first("vec").alias("x"), second("vec").alias("y"))


def _bound(rows: DataFrame) -> float | None:
    """Some pair's distance, and a small one: of neighbours in sorted cells, or of the rows that vary least, whose distances truncation makes negative."""
    cells = [F.floor(F.coalesce(F.get("a", F.lit(k)), F.lit(0.0)) * 64) for k in range(CELLED)]
    beside = F.lag("vec").over(Window.partitionBy(*cells).orderBy(F.get("a", F.lit(0)), "id"))
    near = rows.select("vec", beside.alias("other")).where("other IS NOT NULL")
    still = cut(rows.orderBy(F.desc("slack"), "id").limit(STILL).select("id", "vec"))
    every = still.repartition(STILL // 50).join(F.broadcast(still.select(F.col("id").alias("to"), F.col("vec").alias("other"))), F.col("id") < F.col("to")).select("vec", "other")
    found = near.unionByName(every).agg(F.min(pearson(F.col("vec"), F.col("other")))).first()[0]
    free(still)
    return found


def closest_pair(matrix: DataFrame) -> DataFrame:
    """closest(pairs(matrix)): the least (d, i, j) as one row, exactly, for 64-bit arithmetic.

    Equal vectors meet by their value and stand for each other by their least
    id; rows that don't vary are at distance 0 from all.  Of the others a first
    bound is the least distance of neighbours in sorted cells and of the STILL
    rows that vary least; only pairs whose variations, and angles to all pivots,
    allow as little are worked out.  Where no bound under 1
    is found, all pairs are candidates.  Under two rows have no pair.
    """
    m, count, _ = measured(matrix, "int64")
    pair = "i int, j int, d double"
    found = [m.limit(0).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("d"))]
    if count < 2:
        return closest(found[0]).where("i IS NOT NULL")
    first = cut(m.groupBy("vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    repeated = first.where("n > 1").select("vec", F.col("id").alias("i"))
    again = m.join(repeated, "vec").where("id > i").groupBy("vec", "i").agg(F.min("id").alias("j"))
    found.append(again.select("i", "j", pearson(F.col("vec"), F.col("vec")).alias("d")))
    low = [r["id"] for r in m.orderBy("id").limit(2).select("id").collect()]
    still = m.where("v = 0").agg(F.min("id")).first()[0]
    if still is not None:  # the least pair with a row that doesn't vary
        i, j = (low[0], low[1]) if still == low[0] else (low[0], still)
        found.append(m.sparkSession.createDataFrame([(i, j, 0.0)], pair))
    rows = cut(placed(first.join(m.where("v <> 0").select("id"), "id", "left_semi").select("id", "vec"), count))
    bound = _bound(rows)
    known = [x for x in (bound, closest(found[0].unionByName(found[1])).first()["d"], None if still is None else 0.0) if x is not None]
    best = min(known, default=2.0)
    near = candidates(rows, best if best < 1 else 4.0)
    found.append(near.select("i", "j", pearson(F.col("x"), F.col("y")).alias("d")))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    out = cut(closest(every))
    free(rows, first, m)
    return out.where("i IS NOT NULL")
