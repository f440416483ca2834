"""Whitening of embeddings: principal components of whole-numbered vectors by Spark's distributed singular value decomposition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

COMPONENTS, SCALE, SHIFT = 32, 64, 1_000_000
#: Largest size of a component times SCALE: beyond, doubles aren't whole numbers apart.
LARGEST = 1 << 40
#: Components whose singular value is less than this part of the first one's (a 10^-12th of its eigenvalue) are rounding, not variance.
LEAST = 1e-6


def whole(rows: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """Rows (vec_id, vector) as (vec_id, x): x is floor(scale * component) + shift; rows without a vector of finite components go.

    A component over LARGEST / scale is an error.
    """
    good = F.col("vector").isNotNull() & F.coalesce(F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))), F.lit(False))
    number = lambda c: F.floor(F.when(F.abs(c.cast("double")) * scale <= LARGEST, c.cast("double") * scale).otherwise(F.raise_error(F.lit("a component is too large")).cast("double"))).cast("long") + shift
    return rows.where(good).select("vec_id", F.transform("vector", number).alias("x"))


def sums(x: DataFrame) -> tuple[int, list[int]]:
    """Number of rows of x, and the exact sum of each component."""
    got = x.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum("c").alias("s")).toArrow()  # a row a component
    by = dict(zip(got.column("i").to_pylist(), got.column("s").to_pylist(), strict=True))
    return x.count(), [by[i] for i in sorted(by)]


def components(x: DataFrame, mean: list[float], n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the covariance (divisor n), falling, and unit eigenvectors as columns: at most so many, less those of no variance.

    Rows are centred before they are multiplied.  The decomposition adds up
    products of rows where they are; the driver gets one square matrix.
    """
    at = F.array(*[F.lit(m) for m in mean])
    centred = x.select(array_to_vector(F.zip_with("x", at, lambda c, m: c.cast("double") - m)).alias("v"))
    found = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "v")).computeSVD(min(most, len(mean)), computeU=False, rCond=LEAST)
    return np.array(found.s.toArray()) ** 2 / n, np.array(found.V.toArray())


def _added(table: DataFrame, of, size: int) -> np.ndarray:
    """size doubles, added up over all batches of table, then over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += of(_matrix(batch.column("w")))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["i", "value"])

    got = table.select("w").mapInArrow(run, "i int, value double").groupBy("i").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(size)
    out[got.column("i").to_numpy()] = got.column("value").to_numpy()
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def exact_deviation(x: np.ndarray, n: int, s: list[int]) -> list[int | None]:
    """For each row of x the sum of (n x - s) squared, in whole numbers; None where 64 bits can't hold it."""
    far = max(abs(n * int(x.max()) - min(s)), abs(n * int(x.min()) - max(s)), 1)
    if far * far * x.shape[1] < 2**63:
        d = n * x - np.array(s, np.int64)
        return np.einsum("ij,ij->i", d, d).tolist()
    exact = [sum((n * c - t) ** 2 for c, t in zip(row, s, strict=True)) for row in x.tolist()]
    return [e if e < 2**63 else None for e in exact]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, n, deviation, whitened, explained, identity_error) of every vector.

    whitened: the centred vector on each component over the root of its
    eigenvalue; explained: each eigenvalue's part of the total variance, which
    is that of the exact deviations; both are arrays, by falling eigenvalue.
    deviation: the sum of (n x - S) squared, null where 64 bits can't hold it.
    identity_error: the largest entry of whitened's covariance less the
    identity.  Vectors with a null or non-finite component, and null vectors,
    go; the others must have one length, or it is a ValueError.  Components
    without variance are left out, so equal vectors, or one alone, have none;
    of an empty table there are no rows.  Repeated rows count each, null ids
    are kept, and further columns are left out.
    """
    x = C.cut(whole(vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector")), scale, shift))
    shape = x.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if shape[0] != shape[1]:
        raise ValueError("vectors differ in length")
    n, s = sums(x) if shape[0] else (x.count(), [])
    varied = bool(s) and x.select("x").where(F.col("x") != F.array(*[F.lit(t // n).cast("long") for t in s])).limit(1).count() > 0
    mean = [t / n for t in s]
    e, v = components(x, mean, n, most) if varied else (np.zeros(0), np.zeros((len(s), 0)))
    axes = v / np.sqrt(e)[None, :]
    kind = dict(x.dtypes)["vec_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(batch.column("x"))
            w = (rows - np.array(mean)) @ axes
            places = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * w.shape[1])
            deviation = exact_deviation(rows, n, s) if s else [0] * batch.num_rows
            exact = [sum((n * c - t) ** 2 for c, t in zip(rows[i].tolist(), s, strict=True)) if d is None else d for i, d in enumerate(deviation)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(deviation, pa.int64()), pa.array([str(d) for d in exact]), pa.ListArray.from_arrays(places, pa.array(w.ravel()))], names=["vec_id", "deviation", "exact", "w"])

    done = C.cut(x.mapInArrow(run, f"vec_id {kind}, deviation long, exact string, w array<double>"))
    C.free(x)
    total = done.agg(F.sum(F.col("exact").cast("decimal(38,0)"))).first()[0]
    k = len(e)
    centre = _added(done, lambda w: w.sum(0), k) / max(n, 1) if k else np.zeros(0)
    error = float(np.abs(_added(done, lambda w: ((w - centre).T @ (w - centre)).ravel(), k * k).reshape(k, k) / n - np.eye(k)).max()) if k else None
    explained = [float(x * n**3 / int(total)) for x in e]
    return done.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", F.col("w").alias("whitened"), F.lit(explained).cast("array<double>").alias("explained"), F.lit(error).cast("double").alias("identity_error"))
