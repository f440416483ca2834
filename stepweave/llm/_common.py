"""What several text operators share: lineage cuts, Arrow buffers, word and shingle hashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of text that one numpy pass works on; long batches are cut by rows, long rows by words.
CHUNK_BYTES = 1 << 21
BLOCK_BYTES = 1 << 20
#: Java's pattern for the runs that separate words.
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared checkpoint folder and go on from its files.

    The folder is the session's own (spark.checkpoint.dir or setCheckpointDir).
    Only with a local master, as in tests, one is made where there is none: on
    a cluster the executors wouldn't share it.
    """
    context = df.sparkSession.sparkContext
    folder = context._jsc.sc().getCheckpointDir()
    if not folder.isDefined():
        where = context.getConf().get("spark.checkpoint.dir")
        if not where and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="stepweave-"))
        folder = context._jsc.sc().getCheckpointDir()
    path = f"{folder.get()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def free(*tables: DataFrame | None) -> None:
    """Delete the files of tables that cut made and that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_table", None):
            context = df.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def even_keys(spark: SparkSession, parts: int, each: int) -> list[int]:
    """each longs for every one of parts, which hash partitioning into parts deals there: so that few keys fill them evenly."""
    size = parts * (4 * each + 30)
    while True:
        ids = spark.range(size).select("id", F.pmod(F.hash("id"), F.lit(parts)).alias("part"))
        number = F.row_number().over(Window.partitionBy("part").orderBy("id")).alias("number")
        got = ids.select("id", "part", number).where(F.col("number") <= each).orderBy("number", "part").toArrow()  # parts * each
        if got.num_rows == parts * each:
            return got.column("id").to_pylist()
        size *= 2


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text mod n; a null id counts as 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns (whatever their case) that an operator is about to add."""
    low = {x.lower() for x in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


# ---------------------------------------------------------------- Arrow

def trim() -> None:
    """Give freed memory back, where the C library can: idle workers shouldn't hold what a task needed."""
    pa.default_memory_pool().release_unused()
    if (give := getattr(_libc(), "malloc_trim", None)) is not None:
        give(0)


@cache
def _libc():
    return ctypes.CDLL(None)


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts take at most limit bytes, or one row.  After the last, freed memory goes back to the system."""
    for batch in batches:
        i, n = 0, batch.num_rows
        if not n:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        while i < n:
            base = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(i, j - i)
            i = j
    trim()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and each row's offset in them; null rows are empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def binary_rows(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column whose row i holds values[offsets[i]:offsets[i + 1]]."""
    values = np.ascontiguousarray(values)
    byte_offsets = offsets.astype(np.int64) * values.itemsize
    if byte_offsets[-1] < 2**31:
        return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(byte_offsets.astype(np.int32)), pa.py_buffer(values)])
    raw = values.tobytes()
    return pa.array([raw[a:b] for a, b in zip(byte_offsets[:-1], byte_offsets[1:], strict=True)], pa.large_binary())


# ---------------------------------------------------------------- hashes

_RNG = np.random.Generator(np.random.PCG64(20240611))


def _odd(n: int) -> np.ndarray:
    return _RNG.integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)


_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_BASE = int(_odd(1)[0])
_LENGTH = _odd(1)[0]
_PLACE = _odd(64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES) + 1
        up = np.full(size, np.uint64(_BASE))
        up[0] = 1
        down = np.full(size, np.uint64(pow(_BASE, -1, 2**64)))
        down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash every word of every row.

    Words are runs of bytes other than space and 9 to 13.  Returns the words'
    64-bit hashes (of A-Z as a-z if fold), their first and past-the-end bytes
    in data, and for each row the index of its first word (one more at the end).
    """
    table, n = (_FOLDED if fold else _BYTE), len(data)
    bounds = np.zeros(n + 1, bool)
    bounds[offsets] = True
    hashes, begins, ends = [], [], []
    a = 0
    while a < n:
        e = min(n, a + BLOCK_BYTES)
        if e < n:  # cut where no word goes on
            back = np.flatnonzero(_IS_SPACE[data[a:e]] | bounds[a + 1 : e + 1])
            if len(back):
                e = a + int(back[-1]) + 1
            else:
                while e < n and not (_IS_SPACE[data[e - 1]] or bounds[e]):
                    step = np.flatnonzero(_IS_SPACE[data[e : e + BLOCK_BYTES]] | bounds[e + 1 : e + 1 + len(data[e : e + BLOCK_BYTES])])
                    e = e + int(step[0]) + 1 if len(step) else min(n, e + BLOCK_BYTES)
        part = data[a:e]
        inside = ~_IS_SPACE[part]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | bounds[a + 1 : e]
        last[:-1] &= ~inside[1:] | bounds[a + 1 : e]
        s, t = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _power_tables(len(part))
        total = np.empty(len(part) + 1, np.uint64)
        total[0] = 0
        np.cumsum(table[part] * up[: len(part)], out=total[1:])
        hashes.append(mix((total[t] - total[s]) * down[s] + (t - s).astype(np.uint64) * _LENGTH))
        begins.append(s + a)
        ends.append(t + a)
        a = e
    if not hashes:
        empty = np.empty(0, np.int64)
        return np.empty(0, np.uint64), empty, empty, np.zeros(len(offsets), np.int64)
    begin = np.concatenate(begins)
    return np.concatenate(hashes), begin, np.concatenate(ends), np.searchsorted(begin, offsets)


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of size words, across rows too; as many as hashes, less size - 1."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n] * _PLACE[0]
    for k in range(1, size):
        out += hashes[k : n + k] * _PLACE[k]
    return mix(out + _PLACE[8 + size])


def shingles(hashes: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each row's shingle hashes, with repeats: runs of size words, or the whole of a shorter row.

    Returns the hashes in row order and each row's offset in them.
    """
    count = np.diff(first)
    number = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(number)])
    out = np.empty(int(offsets[-1]), np.uint64)
    every = runs(hashes, size)
    full = np.flatnonzero(count >= size)
    if len(full):
        source = np.repeat(first[full] - offsets[full], number[full]) + _places(offsets[full], number[full])
        out[_places(offsets[full], number[full])] = every[source]
    for k in range(1, size):
        rows = np.flatnonzero(count == k)
        if len(rows):
            out[offsets[rows]] = runs(hashes, k)[first[rows]]
    return out, offsets


def _places(begin: np.ndarray, number: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... number[0] of them, then from begin[1], and so on."""
    before = np.cumsum(number) - number
    return np.arange(int(number.sum())) + np.repeat(begin - before, number)


def distinct_rows(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort each row's values and drop its repeats."""
    values = values.copy()
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    keep[offsets[:-1][np.diff(offsets) > 0]] = True
    return values[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]
