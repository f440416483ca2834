"""Agglomerative clustering of integer vectors by correlation distance."""

from __future__ import annotations

import logging
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import mean, moments, pearson, pearson_given, pearson_of
from .lineage import cut, folder, free

log = logging.getLogger(__name__)
#: Longest vectors whose products are written out one by one; those of longer ones are made in a loop over arrays.
WIDE = 64
#: Pairs of rows, in either order, that one task looks at.
TASK_PAIRS = 40_000_000
#: Rows of a pack at most (a multiple of 8, so that equal runs of them lie alike in files), and numbers in the vectors of a pack or a slice.
PACK, PACK_VALUES = 168, 1_000_000
#: Rows of one vector that are kept together.
COPIES = 500
MERGES = "merge_id int, left_id int, right_id int, distance double, vec array<int>"


def pairs(matrix: DataFrame, arith: str = "int64") -> DataFrame:
    """(i, j, d) for each two rows (id, vec), i < j: every distance is asked for, so every pair is made."""
    a, b = (matrix.select(F.col("id").alias(k), F.col("vec").alias(f"v{k}")) for k in "ij")
    return a.join(b, F.col("i") < F.col("j")).select("i", "j", pearson(F.col("vi"), F.col("vj"), arith).alias("d"))


def tiles(matrix: DataFrame, count: int, queries: Column | None = None) -> DataFrame:
    """Rows i and j of each two with i < j: every column of matrix with i or j behind its name; neither side is sent to all tasks.

    Rows are dealt to blocks by the hash of their id.  A block of i and one of j
    are a tile, so each row goes to as many tiles as there are blocks on the
    other side, and a tile looks at about TASK_PAIRS pairs.  With queries, a
    condition on rows, i are the rows for which it holds, in as few blocks as
    they fill, and j all others, whatever their ids.
    """
    blocks = lambda n: max(1, math.ceil(n / math.sqrt(TASK_PAIRS)))
    asked = matrix if queries is None else matrix.where(queries)
    many = {"i": blocks(count if queries is None else asked.count()), "j": blocks(count)}

    def side(df: DataFrame, k: str, other: str) -> DataFrame:
        of = {k: F.pmod(F.hash("id"), F.lit(many[k])), other: F.col("_other")}
        spread = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(many[other] - 1))).alias("_other"))
        return spread.select(*[F.col(c).alias(f"{c}{k}") for c in matrix.columns], (of["i"] * many["j"] + of["j"]).alias("_tile")).repartition(many["i"] * many["j"], "_tile")

    which = F.col("idi") < F.col("idj") if queries is None else F.col("idi") != F.col("idj")
    return side(asked, "i", "j").join(side(matrix, "j", "i"), "_tile").where(which).drop("_tile")


def measured(matrix: DataFrame, arith: str) -> tuple[DataFrame, int, int]:
    """A table (id, vec, s, v) with each row's sums, the number of rows and their common length."""
    m = cut(matrix.select("id", F.col("vec").cast("array<int>").alias("vec"), *[x.alias(k) for k, x in zip(("s", "v"), moments(F.col("vec"), arith), strict=True)]))
    rows, least, most = m.agg(F.count(F.lit(1)), F.min(F.size("vec")), F.max(F.size("vec"))).first()
    if least != most:
        raise ValueError("vectors differ in length")
    return m, rows, most or 0


def copies(measured: DataFrame) -> DataFrame:
    """A table (ids, vec, s, v) of the rows of one vector, about COPIES at most in one row."""
    many = measured.groupBy("vec").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > COPIES)
    parts = measured.join(many, "vec", "left").withColumn("_part", F.pmod(F.hash("id"), F.ceil(F.coalesce("n", F.lit(1)) / COPIES)))
    alike = parts.where("id IS NOT NULL").groupBy("vec", "_part").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("s").alias("s"), F.first("v").alias("v"))
    return cut(alike.select("ids", "vec", "s", "v"))


def packs(rows: DataFrame, groups: int, size: int) -> DataFrame:
    """Packs (group, low, is) of measured rows: groups of like variation, each in ranges of ids of `size` rows but for the last one; their least id, and the rows by v and vec."""
    grouped = rows.where("id IS NOT NULL").repartitionByRange(groups, "v", "id", "vec").withColumn("group", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("group").orderBy("id", "vec")) - 1
    packed = F.sort_array(F.collect_list(F.struct("v", "vec", "id", "s"))).alias("is")
    return grouped.withColumn("_pack", F.floor(place / size)).groupBy("group", "_pack").agg(F.min("id").alias("low"), packed).drop("_pack")


def many_pairs(matrix: DataFrame, arith: str = "int64", queries: Column | None = None) -> DataFrame:
    """As pairs, for many rows: sums are made once a row, and a distance is compiled arithmetic in a loop over tiles.

    All vectors must have one length.  With queries (a condition on id), the
    distances of the rows for which it holds to all other rows.

    The answer is far larger than the rows, so it comes in an order in which a
    table of it is small.  A group of i and a slice of j are a tile, and neither
    side is sent whole; both are rows of like variation, so a tile has few
    different distances.  In it each j meets the rows of a pack of i in one
    order, j of the same distances behind each other, so that what is written
    repeats.  A tile looks at a tenth of TASK_PAIRS pairs.
    """
    m, rows, most = measured(matrix, arith)
    narrow = 0 < most <= WIDE
    asked, many = (m, rows) if queries is None else ((q := m.where(queries)), q.count())
    side, fitting = math.isqrt(TASK_PAIRS), max(1, PACK_VALUES // max(1, most))
    groups = max(1, math.ceil(many / max(1, side // 2)))
    slices = max(1, math.ceil(rows / max(1, min(side // 5, fitting))))

    cells = [F.get("vec", F.lit(c)).cast("long") for c in range(most)] if narrow else []
    shape = [(x - cells[0]).alias(f"x{c}_") for c, x in enumerate(cells)][1:]  # vectors that differ by a constant have the same distances
    alike = copies(m).select("v", *shape, "vec", "ids", "s")
    sliced = alike.repartitionByRange(slices, *alike.columns[:-1]).withColumn("_slice", F.spark_partition_id())
    sliced = sliced.groupBy("_slice").agg(F.sort_array(F.collect_list(F.struct(*alike.columns))).alias("js"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tile = (F.col("_slice") * groups + F.col("group")).alias("_tile")
    right = sliced.withColumn("group", every(groups)).select(tile, "js").repartitionById(slices * groups, "_tile")
    left = packs(asked, groups, min(PACK, fitting)).withColumn("_slice", every(slices)).select(tile, "low", "is").repartitionById(slices * groups, "_tile")

    of = lambda k: [F.col(f"{k}.{c}").alias(f"{c}{k}") for c in ("s", "v", "vec")]
    reached, which = (F.col("low") < F.col("j"), F.col("i") < F.col("j")) if queries is None else (F.lit(True), F.col("i") != F.col("j"))
    both = left.join(right.hint("merge"), "_tile").select("low", "is", F.explode("js").alias("j"))
    both = both.select("low", "is", *of("j"), F.explode("j.ids").alias("j")).where(reached)
    both = both.select("j", "sj", "vj", "vecj", F.explode("is").alias("i"))
    both = both.select(F.col("i.id").alias("i"), *of("i"), "j", "sj", "vj", "vecj").where(which)
    if narrow:
        x, y = ([F.get(f"vec{k}", F.lit(c)).cast("long") for c in range(most)] for k in "ij")
        d = pearson_of(x, y, (F.col("si"), F.col("vi")), (F.col("sj"), F.col("vj")), arith)
    else:
        d = pearson(F.col("veci"), F.col("vecj"), arith)
    return both.select("i", "j", d.alias("d"))


def ordered_pairs(matrix: DataFrame, arith: str = "int64") -> DataFrame:
    """(i, j, d) for each row and every other one, so both orders of each pair; a distance is worked out once."""
    found = pairs(matrix, arith)
    both = F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    return found.select(F.explode(both).alias("p"), "d").select("p.i", "p.j", "d")


def closest(distances: DataFrame) -> DataFrame:
    """The least (d, i, j) as one row."""
    return distances.agg(F.min(F.struct("d", "i", "j")).alias("m")).select("m.i", "m.j", "m.d")


def _wrap(x: int, arith: str) -> int:
    return (x + 2**31) % 2**32 - 2**31 if arith == "int32" else x


def _div(a: int, b: int) -> int:
    return abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)


def distance(x: list[int], y: list[int], arith: str = "int64") -> float:
    """As functions.vectors.pearson, for two Python lists."""
    w, n = (lambda v: _wrap(v, arith)), len(x)
    sx, sy = w(sum(x)), w(sum(y))
    num = w(w(sum(w(a * b) for a, b in zip(x, y, strict=True))) - _div(w(sx * sy), n)) if n else 0
    under = w(w(w(sum(w(a * a) for a in x)) - _div(w(sx * sx), n)) * w(w(sum(w(b * b) for b in y)) - _div(w(sy * sy), n))) if n else 0
    if under < 0:
        return math.nan
    return 1.0 - num / math.sqrt(under) if under else 0.0


def _oriented(a: int, b: int, mode: str) -> tuple[int, int]:
    low, high = min(a, b), max(a, b)
    return (high, low) if mode == "bsp" and low < 0 else (low, high)


def _distances(vec: np.ndarray, others: np.ndarray, arith: str) -> np.ndarray:
    """distance of one vector to each row of others, NaN where there is none."""
    if arith == "int32" or not len(others) or vec.size == 0:
        return np.array([distance(vec.tolist(), o.tolist(), arith) for o in others])
    n, most = len(vec), max(int(np.abs(others).max()), int(np.abs(vec).max()), 1)
    if (most * n) ** 4 >= 2**62:  # products may leave 64 bits
        return np.array([distance(vec.tolist(), o.tolist(), arith) for o in others])
    cut = lambda x: np.sign(x) * (np.abs(x) // n)
    sx, sy = vec.sum(), others.sum(1)
    num = others @ vec - cut(sx * sy)
    under = ((vec * vec).sum() - cut(sx * sx)) * ((others * others).sum(1) - cut(sy * sy))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(under == 0, 0.0, 1.0 - num / np.sqrt(under.astype(float)))


def merge_all(ids: list[int], vectors: list[list[int]], mode: str = "seq", arith: str = "int64") -> list[tuple]:
    """All merges of one matrix, by the two modes' orders among ties.

    seq: least (distance, lower id, higher id), the lower id left.  bsp: pairs
    with a merged cluster are (older, newer), and ties go by these.  A NaN never
    beats another distance; if nothing else is there, seq merges the first two
    and bsp raises.  Each row keeps its least distance to later rows, so a merge
    takes one new row of distances and a look at these.
    """
    if len({len(v) for v in vectors}) > 1:
        raise ValueError("vectors differ in length")
    n = len(ids)
    order = sorted(range(n), key=lambda k: ids[k], reverse=True)  # new ids are lower, so come behind
    name = np.array([ids[k] for k in order] + [-k for k in range(1, max(n, 1))], np.int64)
    vec = np.zeros((2 * n - 1 if n else 0, len(vectors[0]) if n else 0), np.int64)
    for k, of in enumerate(order):
        vec[k] = vectors[of]
    live = np.zeros(len(vec), bool)
    live[:n] = True
    d = np.full((len(vec), len(vec)), np.nan)  # of a row to the rows before it, which have higher ids
    for k in range(1, n):
        d[k, :k] = _distances(vec[k], vec[:k], arith)
    rank = lambda x: np.where(np.isnan(x), np.inf, x)
    least = np.array([rank(d[k, :k]).min(initial=np.inf) for k in range(len(vec))])
    merges = []
    for new in range(n, len(vec)):
        rows = np.flatnonzero(live)
        best = least[rows].min()
        first = rows[-1], rows[-2]  # the lowest ids
        if mode == "seq" and np.isnan(d[first]):
            low, high = first
        elif np.isinf(best):
            raise ValueError("no two clusters have a distance")
        else:
            ties = [(int(k), int(j)) for k in rows[least[rows] == best] for j in np.flatnonzero(live[:k] & (d[k, :k] == best))]
            low, high = min(ties, key=lambda t: _oriented(int(name[t[0]]), int(name[t[1]]), mode))
        kept, gone = _oriented(int(name[low]), int(name[high]), mode)
        total = vec[low] + vec[high]
        vec[new] = np.sign(total) * (np.abs(total) // 2)
        merges.append((int(name[new]), kept, gone, float(d[low, high]), vec[new].tolist()))
        live[[low, high]] = False
        others = np.flatnonzero(live)
        stale = [k for k in others if k > min(low, high) and least[k] in (d[k, low] if low < k else None, d[k, high] if high < k else None)]
        for k in stale:
            least[k] = rank(d[k, :k])[live[:k]].min(initial=np.inf)
        d[new, others] = _distances(vec[new], vec[others], arith)
        least[new] = rank(d[new, others]).min(initial=np.inf)
        live[new] = True
    return merges


def hcluster(matrix: DataFrame, mode: str = "seq", arith: str = "int64", key: str | None = None) -> DataFrame:
    """Merges of a matrix (id int, vec array<int>) of up to some thousand rows, each key's in one task.

    An empty matrix or one of a single row has no merges.
    """
    grouped = matrix if key else matrix.withColumn("_key", F.lit(0))
    name = key or "_key"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(pdf["id"].tolist(), ([int(x) for x in v] for v in pdf["vec"]), strict=True))
        merges = merge_all([r[0] for r in rows], [r[1] for r in rows], mode, arith)
        out = pd.DataFrame(merges, columns=["merge_id", "left_id", "right_id", "distance", "vec"])
        return out.assign(**{key: pdf[key].iloc[0]}) if key else out

    schema = MERGES + (f", {key} {dict(matrix.dtypes)[key]}" if key else "")
    return grouped.groupBy(name).applyInPandas(one, schema)


def nearest_later(m: DataFrame, count: int, arith: str = "int64") -> DataFrame:
    """Rows of m (measured) with nan, d and near: the least (distance, id) among the rows of higher ids; null for the highest."""
    both = tiles(m, count)
    d = pearson_given(F.col("veci"), F.col("vecj"), (F.col("si"), F.col("vi")), (F.col("sj"), F.col("vj")), arith)
    best = both.select(F.col("idi").alias("id"), F.col("idj").alias("near"), d.alias("d")).groupBy("id").agg(F.min(F.struct(F.isnan("d").alias("nan"), "d", "near")).alias("b"))
    return m.join(best, "id", "left").select("id", "vec", "s", "v", "b.nan", "b.d", "b.near")


def _ints(values) -> Column:
    return F.expr(f"cast(array({', '.join(map(str, values))}) as array<int>)")


class _Clusters:
    """The live clusters of one clustering, each with its nearest one of a higher id.

    They are a table, of which the driver has the `most` rows of the least
    distances (top), what was merged since it was written (gone) and the
    clusters that this made (made); when these grow, it is written anew.  A row
    whose nearest one is gone keeps that distance, which its true one can't be
    under, and is searched for again when nothing else is nearer.  So a merge
    takes about one pass over the live rows, for the new cluster and some rows
    that wait; no distances are kept but a row's least one.
    """

    FIELDS = "id int, vec array<int>, s long, v long, nan boolean, d double, near int, stale boolean"

    def __init__(self, matrix: DataFrame, mode: str, arith: str, most: int):
        m, self.left, length = measured(matrix, arith)
        self.spark, self.mode, self.arith, self.most = matrix.sparkSession, mode, arith, most
        self.compared = 0  # distances that passes after the first have made
        if self.left > 1 and m.select("id").distinct().count() < self.left:
            raise ValueError("ids repeat")
        self.parts = max(1, math.ceil(self.left * max(1, length) / 2_000_000))
        self.table = cut(nearest_later(m, self.left, arith).withColumn("stale", F.lit(False)).repartition(self.parts))
        free(m)
        self._load()

    def _key(self, c: dict) -> tuple:
        return c["nan"], 0.0 if c["nan"] else c["d"], *_oriented(c["id"], c["near"], self.mode)

    def _stale(self, c: dict) -> bool:
        return c["stale"] or c["near"] in self.gone

    def _load(self) -> None:
        merged = (F.col("id") < 0) & F.lit(self.mode == "bsp")
        kept, gone = F.when(merged, F.col("near")).otherwise(F.col("id")), F.when(merged, F.col("id")).otherwise(F.col("near"))
        rows = [r.asDict() for r in self.table.where("near IS NOT NULL").orderBy("nan", "d", kept, gone).limit(self.most).collect()]
        self.top = {c["id"]: c for c in rows}
        self.reach = self._key(rows[-1]) if len(rows) == self.most else None  # None: no other row has a nearest one
        self.gone, self.made = [], {}  # ids, of which there are at most a few times `most`

    def _write(self) -> None:
        before = self.table
        rows = [(*(c[k] for k in ("id", "vec", "s", "v", "nan", "d", "near")), self._stale(c)) for c in [*self.top.values(), *self.made.values()]]
        kept = before.where(~F.array_contains(_ints([*self.gone, *self.top]), F.col("id")))
        kept = kept.withColumn("stale", F.col("stale") | F.coalesce(F.array_contains(_ints(self.gone), F.col("near")), F.lit(False)))
        self.table = cut(kept.unionByName(self.spark.createDataFrame(rows, self.FIELDS)).coalesce(self.parts))
        free(before)
        self._load()

    def search(self, wanted: list[dict]) -> dict[int, tuple]:
        """For each wanted cluster, among the live ones of higher ids, the nearest as (nan, d, id) and the first as (id, nan), or None; the nearest is noted in it."""
        told = ", ".join(f"named_struct('q', {c['id']}, 'w', array({', '.join(map(str, c['vec']))}), 's', {c['s']}L, 'v', {c['v']}L)" for c in wanted)
        rows = self.table.where(~F.array_contains(_ints(self.gone), F.col("id"))).select("id", "vec", "s", "v", F.explode(F.expr(f"array({told})")).alias("w"))
        d = pearson_given(F.col("vec"), F.col("w.w"), (F.col("s"), F.col("v")), (F.col("w.s"), F.col("w.v")), self.arith)
        rows = rows.where(F.col("id") > F.col("w.q")).select(F.col("w.q").alias("q"), "id", d.alias("d"))
        near, first = F.struct(F.isnan("d").alias("nan"), "d", "id"), F.struct("id", F.isnan("d").alias("nan"))
        found = {r["q"]: (tuple(r["n"]), tuple(r["f"])) for r in rows.groupBy("q").agg(F.min(near).alias("n"), F.min(first).alias("f")).collect()}
        self.compared += len(wanted) * self.left
        for c in wanted:
            near, first = found.get(c["id"], (None, None))
            for o in self.made.values():
                if o["id"] > c["id"]:
                    d = distance(o["vec"], c["vec"], self.arith)
                    near = min((x for x in (near, (math.isnan(d), d, o["id"])) if x), key=lambda t: (t[0], 0.0 if t[0] else t[1], t[2]))
                    first = min((x for x in (first, (o["id"], math.isnan(d))) if x), key=lambda t: t[0])
            c["nan"], c["d"], c["near"], c["stale"] = *(near or (None, None, None)), False
            found[c["id"]] = near, first
        return found

    def closest(self) -> tuple[int, int, float]:
        while True:
            named = [c for c in [*self.top.values(), *self.made.values()] if c["near"] is not None]
            best = min(named, key=self._key, default=None)
            if self.reach is not None and (best is None or self._key(best) > self.reach):
                self._write()  # the table may have a nearer pair than those known
            elif self._stale(best):
                waiting = sorted(filter(self._stale, named), key=self._key)
                self.search(waiting[: max(1, self.most // 8)])
            else:
                return best["id"], best["near"], best["d"]

    def vector(self, i: int) -> list[int]:
        known = self.made.get(i) or self.top.get(i)
        return known["vec"] if known else self.table.where(F.col("id") == i).first()["vec"]

    def merge(self, a: int, b: int, new: int) -> tuple[list[int], tuple | None]:
        """The new cluster's vector, and the first of the others as (id, nan)."""
        vec = [_div(x + y, 2) for x, y in zip(self.vector(a), self.vector(b), strict=True)]
        for i in (a, b):
            self.top.pop(i, None)
            self.made.pop(i, None)
            self.gone.append(i)
        self.left -= 1
        cluster = {"id": new, "vec": vec, **dict(zip(("s", "v"), _moments(vec, self.arith), strict=True))}
        _, first = self.search([cluster])[new]
        self.made[new] = cluster
        if len(self.gone) > 4 * self.most:
            self._write()
        return vec, first

    def lowest(self) -> dict:
        return self.table.orderBy("id").first().asDict()


def _moments(x: list[int], arith: str) -> tuple[int, int]:
    w, s = (lambda v: _wrap(v, arith)), _wrap(sum(x), arith)
    return s, w(w(sum(w(a * a) for a in x)) - _div(w(s * s), len(x))) if x else 0


def hcluster_distributed(matrix: DataFrame, mode: str = "seq", arith: str = "int64", cut_every: int = 64) -> DataFrame:
    """The same merges for matrices too large for a task, by a table of each cluster's nearest one.

    All pairs are looked at once, in tiles; then a merge is about one pass over
    the live rows.  The driver has some cut_every rows and their vectors at a
    time, and writes the merges out as often.  ids must be different.
    """
    if mode not in ("seq", "bsp"):
        raise ValueError("mode is seq or bsp")
    spark, clusters = matrix.sparkSession, _Clusters(matrix, mode, arith, max(2, cut_every))
    merges, new, path, first = [], 0, folder(spark), None
    flush = lambda: spark.createDataFrame(merges, MERGES).coalesce(1).write.mode("append").parquet(path)
    low = clusters.lowest() if clusters.left > 1 and mode == "seq" else None
    if low:
        first = clusters.search([dict(low)])[low["id"]][1]
    while clusters.left > 1:
        if first and first[1]:  # the two lowest ids have no distance: seq merges them before any others
            a, b, d = low["id"], first[0], math.nan
        else:
            a, b, d = clusters.closest()
        if mode != "seq" and math.isnan(d):
            raise ValueError("no two clusters have a distance")
        a, b = _oriented(a, b, mode)
        new -= 1
        vec, first = clusters.merge(a, b, new)
        low, first = {"id": new}, first if mode == "seq" else None
        merges.append((new, a, b, d, vec))
        for line in trace(merges[-1:], clusters.left + 1):
            log.debug(line[2])
        if len(merges) >= cut_every:
            flush()
            merges = []
    flush()
    free(clusters.table)
    log.debug("distances after the first of all pairs: %d", clusters.compared)
    return spark.read.schema(MERGES).parquet(path)


def trace(merges: list[tuple], clusters: int) -> list[tuple[int, int, str]]:
    """(merge, line, text): for each merge its closest pair, the new cluster's id, and how many clusters are live after it."""
    out = []
    for k, (new, a, b, d, _) in enumerate(merges):
        out += [(k, 0, f"closest {a} {b} at {d:.6f}"), (k, 1, f"new cluster {new}"), (k, 2, f"live {clusters - k - 1}")]
    return out


def trace_lines(merges: DataFrame, clusters: int) -> DataFrame:
    """trace of a table of merges, whose ids are -1, -2, ... of a matrix of so many rows, as a table."""
    k = -F.col("merge_id") - 1
    texts = F.array(F.format_string("closest %d %d at %.6f", "left_id", "right_id", "distance"), F.format_string("new cluster %d", "merge_id"), F.format_string("live %d", F.lit(clusters) - k - 1))
    return merges.select(k.alias("merge"), F.posexplode(texts).alias("line", "text"))


def first_merge(matrix: DataFrame) -> DataFrame:
    """(left_id, right_id, distance, vec) of the first merge, as one plan."""
    best = closest(pairs(matrix))
    a, b = (matrix.select(F.col("id").alias(k), F.col("vec").alias(f"v{k}")) for k in "ij")
    return best.join(a, "i").join(b, "j").select(F.col("i").alias("left_id"), F.col("j").alias("right_id"), F.col("d").alias("distance"), mean(F.col("vi"), F.col("vj")).alias("vec"))


def dendrogram(merges: list[tuple], names: dict[int, str] | None = None) -> list[tuple[int, int, str]]:
    """(line, depth, text) from the last merge down: - for merges, names or ids for leaves."""
    parts = {m[0]: (m[1], m[2]) for m in merges}
    out, stack = [], [(0, min(parts))] if parts else []
    while stack:
        depth, node = stack.pop()
        if node in parts:
            out.append((len(out), depth, "-"))
            stack += [(depth + 1, parts[node][1]), (depth + 1, parts[node][0])]
        else:
            out.append((len(out), depth, names[node] if names else str(node)))
    return out


def dendrogram_lines(merges: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """dendrogram of a table of merges as a table (line, depth, text): - for merges, names (id, name) or ids for leaves.

    Each node is entered and left once on a walk round the tree, and each of
    these events knows the next one.  Twice as far at a time, each event gets
    what lies between it and the end: the nodes still to be entered, which gives
    the line, and by how much the walk still rises, which gives the depth.  So a
    tree of n merges takes about 2 + log2 n rounds, however deep it is, each a
    join on the event that is pointed at.
    """
    sides = merges.select("merge_id", "left_id", "right_id")
    parent = sides.select(F.col("left_id").alias("id"), F.lit("left").alias("side"), "merge_id", "right_id").unionByName(sides.select(F.col("right_id").alias("id"), F.lit("right").alias("side"), "merge_id", "right_id"))
    nodes = parent.select("id", "side", F.col("merge_id").alias("up"), "right_id").join(sides.select(F.col("merge_id").alias("id"), F.col("left_id").alias("down")), "id", "full")
    event = lambda node, leaves: F.when(node.isNotNull(), node.cast("long") * 2 + leaves)
    enter = nodes.select("id", event(F.col("id"), 0).alias("at"), F.coalesce(event(F.col("down"), 0), event(F.col("id"), 1)).alias("next"), F.lit(1).alias("entered"), F.lit(1).alias("rise"))
    leave = nodes.select("id", event(F.col("id"), 1).alias("at"), F.when(F.col("side") == "left", event(F.col("right_id"), 0)).otherwise(event(F.col("up"), 1)).alias("next"), F.lit(0).alias("entered"), F.lit(-1).alias("rise"))
    walk = cut(enter.unionByName(leave))
    total = walk.count() // 2
    for _ in range((2 * total).bit_length()):
        further = walk.select(F.col("at").alias("next"), F.col("next").alias("_next"), F.col("entered").alias("_entered"), F.col("rise").alias("_rise"))
        sums = [(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in ("entered", "rise")]
        before, walk = walk, cut(walk.join(further, "next", "left").select("id", "at", F.col("_next").alias("next"), *sums))
        free(before)
    lines = walk.where("at % 2 = 0").select((F.lit(total) - F.col("entered")).cast("int").alias("line"), (-F.col("rise")).cast("int").alias("depth"), "id")
    if names is None:
        return lines.select("line", "depth", F.when(F.col("id") < 0, F.lit("-")).otherwise(F.col("id").cast("string")).alias("text"))
    named = lines.join(names.select(F.col("id").alias("_id"), "name"), F.col("id") == F.col("_id"), "left")
    return named.select("line", "depth", F.when(F.col("id") < 0, F.lit("-")).otherwise(F.col("name")).alias("text"))
