"""Vector codes: each part of a vector as the index of the nearest entry of that part's codebook, by Exponion search in whole numbers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Largest size of a component as a whole number, and of a vector, for which no sum of squares leaves 64 bits.
LARGEST, LONGEST = 1 << 24, 1 << 12
#: Vectors that one numpy pass works on.
BLOCK = 4096
#: Labels up to which their sums are sent to all executors (12 bytes each); more are joined by a shuffle.
BROADCAST_LABELS = 1_000_000


def whole(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """Rows (vec_id, label, vector) as (vec_id, label, x): x is floor(scale * component) as packed 32-bit integers; rows without a vector of finite components go.

    A component beyond LARGEST as a whole number is a ValueError: distances
    between such vectors aren't sure to fit 64 bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            if not batch.num_rows:
                continue
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = column.flatten()  # without the null rows' values
            good = pc.fill_null(pc.is_finite(flat), False).to_numpy(zero_copy_only=False)
            values = np.floor(np.where(good, pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(np.float64), 0) * scale)
            ends = np.cumsum(sizes)
            bad = np.concatenate([[0], np.cumsum(~good)])
            ok = column.is_valid().to_numpy(zero_copy_only=False) & (bad[ends] == bad[ends - sizes])
            values = values[np.repeat(ok, sizes)]
            if len(values) and np.abs(values).max() > LARGEST:
                raise ValueError(f"a component is larger than {LARGEST} / {scale}")
            kept = batch.filter(pa.array(ok))
            x = C.binary_rows(values.astype(np.int32), np.concatenate([[0], np.cumsum(sizes[ok])]))
            yield pa.RecordBatch.from_arrays([kept.column("vec_id"), kept.column("label"), x.cast(pa.binary())], names=["vec_id", "label", "x"])

    kinds = dict(rows.dtypes)
    return rows.select("vec_id", "label", "vector").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, x binary")


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distance of each row of x to the row of c at the same place."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


class Book:
    """One part's entries with what the search needs: for each entry all entries by (distance, index)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        between = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(2)
        self.order = np.argsort(between, axis=1, kind="stable")  # ties by index
        self.near = np.take_along_axis(between, self.order, 1)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest entry of each row of x and its squared distance, ties to the lower index; and how many distances that took.

        With u the distance to the entry that the row starts from, an entry
        further than 2 u from that one is further than u from the row.  So only
        the start's neighbours up to four times the squared distance are looked
        at, in their order: all rows' k-th neighbours at once, for the rows that
        have so many.  All is exact in whole numbers.
        """
        best, least = start.copy(), squares(x, self.entries[start])
        many = np.empty(len(x), np.int64)
        for a in np.unique(start):
            rows = start == a
            many[rows] = np.searchsorted(self.near[a], 4 * least[rows], side="right")
        by = np.argsort(-many, kind="stable")
        reach = np.searchsorted(-many[by], -np.arange(len(self.entries) + 1), side="left")  # rows with more than k neighbours
        for k in range(len(self.entries)):
            rows = by[: reach[k]]
            if not len(rows):
                break
            j = self.order[start[rows], k]
            d = squares(x[rows], self.entries[j])
            won = (d < least[rows]) | ((d == least[rows]) & (j < best[rows]))
            best[rows[won]], least[rows[won]] = j[won], d[won]
        return best, least, int(many.sum()) + len(x)


def assigned(table: DataFrame, books: np.ndarray, sums: bool) -> DataFrame:
    """table (vec_id, label, x, and code of the round before if there is one) with code and error, a row for a row, in one pass.

    books: entries of all parts (part, entry, component).  With sums each task
    also gives (slot, value) rows for the next entries, null in the other
    columns: for each part and entry the sums of its parts' components, and
    their number; not more rows than the codebooks have numbers.
    """
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Book(b) for b in books]
        total, number = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        kinds = None
        for batch in batches:
            kinds = batch.schema
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                x = C.buffers(some.column("x"))[0].view(np.int32).reshape(some.num_rows, parts, width).astype(np.int64)
                old = C.buffers(some.column("code"))[0].reshape(some.num_rows, parts) if "code" in kinds.names else np.zeros((some.num_rows, parts), np.uint8)
                code, error = np.empty((some.num_rows, parts), np.uint8), np.zeros(some.num_rows, np.int64)
                for p in range(parts):
                    got, d, _ = search[p].nearest(x[:, p], old[:, p].astype(np.int64))
                    code[:, p] = got
                    error += d
                    if sums:
                        np.add.at(total[p], got, x[:, p])
                        number[p] += np.bincount(got, minlength=entries)
                none = lambda kind, n=some.num_rows: pa.nulls(n, kind)
                yield pa.RecordBatch.from_arrays(
                    [some.column("vec_id"), some.column("label"), some.column("x"), C.binary_rows(code.ravel(), np.arange(some.num_rows + 1) * parts).cast(pa.binary()), pa.array(error), none(pa.int32()), none(pa.int64())],
                    names=["vec_id", "label", "x", "code", "error", "slot", "value"])
        if sums and kinds is not None:
            every = np.concatenate([total.ravel(), number.ravel()])
            slot = np.flatnonzero(every)
            none = lambda kind: pa.nulls(len(slot), kind)
            yield pa.RecordBatch.from_arrays([none(kinds.field("vec_id").type), none(kinds.field("label").type), none(pa.binary()), none(pa.binary()), none(pa.int64()), pa.array(slot.astype(np.int32)), pa.array(every[slot])], names=["vec_id", "label", "x", "code", "error", "slot", "value"])

    kinds = dict(table.dtypes)
    return table.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, x binary, code binary, error long, slot int, value long")


def replaced(books: np.ndarray, sums: DataFrame) -> np.ndarray:
    """The next entries: floor(sum / number) of their parts, or the old ones where no part is theirs.  sums: (slot, value) of all tasks."""
    got = sums.groupBy("slot").agg(F.sum("value").alias("value")).toArrow()  # as many as the codebooks' numbers, and the entries'
    every = np.zeros(books.size + books.shape[0] * books.shape[1], np.int64)
    every[got.column("slot").to_numpy()] = got.column("value").to_numpy()
    total, number = every[: books.size].reshape(books.shape), every[books.size :].reshape(books.shape[:2])
    return np.where((number > 0)[..., None], total // np.maximum(number, 1)[..., None], books)


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every vector, and the codebooks (part, entry, component).

    Vectors with a null or non-finite component, and null vectors, go; the
    others must have one length that parts divide, or it is a ValueError.
    Codebooks start as the parts of the vectors of the entries least ids
    (of one id, by the vector; null ids come last), fewer if there are fewer
    vectors.  Every round assigns all vectors, whose search starts at the entry
    of the round before, and replaces the entries.  Repeated rows are rows of
    their own, further columns are left out.  Of an empty table, none.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    table = C.cut(whole(rows, scale))
    shape = table.agg(F.min(F.length("x")), F.max(F.length("x"))).first()
    dims = (shape[0] or 0) // 4
    if shape[0] != shape[1] or dims % parts or dims > LONGEST:
        raise ValueError(f"vectors differ in length, or {parts} parts don't divide it, or it is over {LONGEST}")
    first = table.orderBy(F.col("vec_id").asc_nulls_last(), F.hex("x")).limit(entries).select("x").collect()  # entries vectors
    books = np.array([np.frombuffer(r["x"], np.int32) for r in first], np.int64).reshape(len(first), parts, dims // parts).transpose(1, 0, 2)
    if not first:
        return table.select("vec_id", "label", F.col("x").alias("code"), F.lit(0).cast("long").alias("error")), books
    for _ in range(rounds):
        done = C.cut(assigned(table, books, sums=True))
        C.free(table)
        books = replaced(books, done.where("slot IS NOT NULL").select("slot", "value"))
        table = done.where("slot IS NULL").select("vec_id", "label", "x", "code")
        table._table = done._table
    out = C.cut(assigned(table, books, sums=False).select("vec_id", "label", "code", "error"))
    C.free(table)
    return out, books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Add label_error: the errors summed over the rows of a row's label, null labels together.  Only sums are moved, so a label of many rows is one row of each task."""
    key = [F.coalesce(F.col("label").cast("string"), F.lit("")).alias("_text"), F.col("label").isNull().alias("_none")]
    total = C.cut(coded.groupBy("label").agg(F.sum("error").alias("label_error")).select(*key, "label_error"))
    few = total.count() <= BROADCAST_LABELS
    return coded.select("*", *key).join(F.broadcast(total) if few else total, ["_text", "_none"]).drop("_text", "_none")
