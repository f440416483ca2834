"""Document fingerprints: one-permutation MinHash, densified, packed to low-order bits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as C

BINS = 128
#: Low-order bits kept of each bin: whole bytes, so that packing is a cast.
BITS = 8
_EMPTY = np.uint64(2**64 - 1)


def sketches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (rows of BINS bytes) and which rows have any shingle.

    Every 5-word shingle is hashed once: its top bits choose a bin, and a bin
    keeps its least hash.  An empty bin i copies from the bins that i's own
    random sequence names, the first that isn't empty: the sequence depends on
    i and the attempt alone, so that two sketches agree in it as often as in
    the bins they copy.
    """
    hashes, _, _, first = C.words(data, offsets)
    values, rows = C.shingles(hashes, first)
    n = len(offsets) - 1
    table = np.full(n * BINS, _EMPTY)
    bins = np.repeat(np.arange(n, dtype=np.int64) * BINS, np.diff(rows)) + (values >> np.uint64(57)).astype(np.int64)
    np.minimum.at(table, bins, values << np.uint64(7))
    table = table.reshape(n, BINS)
    some = np.diff(rows) > 0
    hole = (table == _EMPTY) & some[:, None]
    source, attempt, places = table.copy(), 0, np.arange(BINS, dtype=np.uint64)
    while hole.any():
        attempt += 1
        r, b = np.nonzero(hole)
        donor = (C.mix(places * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(BINS)).astype(np.int64)
        got = source[r, donor[b]]
        full = got != _EMPTY
        table[r[full], b[full]] = got[full]
        hole[r[full], b[full]] = False
    return C.mix(table.reshape(-1)).reshape(n, BINS).astype(np.uint8), some


def likeness(a: np.ndarray, b: np.ndarray, has_a: np.ndarray, has_b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of rows: the share of equal bins, less what BITS bits match by chance; 1 for two empty texts, 0 for one."""
    chance = 2.0**-BITS
    found = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)
    return np.where(has_a & has_b, found, (~has_a & ~has_b).astype(float))


def _texts(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(values), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in values])]).astype(np.int64)


def _bytes(rows: np.ndarray, some: np.ndarray) -> list[bytes]:
    return [r.tobytes() if s else b"" for r, s in zip(rows, some, strict=True)]


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add fingerprint (hexadecimal string, empty without words) to whole texts.

    Null texts count as empty.  Rows stay where they are and keep their
    columns; a column named fingerprint is replaced.
    """
    df = C.without(docs, "fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.pieces(batches, text_col):
            rows = [x.hex() for x in _bytes(*sketches(*C.buffers(batch.column(text_col))))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.string())], names=[*batch.schema.names, "fingerprint"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("fingerprint", T.StringType())]))


def _compared(ids: list, texts: list[str], nexts: list[str]) -> list[pa.Array]:
    """Columns of rows with their next texts, each the text of the row below but for the last's."""
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, nexts, strict=True)]
    raw, raw_edited = [t.encode() for t in texts], [t.encode() for t in edited]
    prints, some = sketches(*_texts([*raw, nexts[-1].encode()]))
    of_edited, some_edited = sketches(*_texts(raw_edited))
    return [
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(x).digest() for x in raw_edited], pa.binary()),
        pa.array(_bytes(prints[:-1], some[:-1]), pa.binary()), pa.array(_bytes(of_edited, some_edited), pa.binary()),
        pa.array(likeness(prints[:-1], of_edited, some[:-1], some_edited), pa.float64()), pa.array(likeness(prints[:-1], prints[1:], some[:-1], some[1:]), pa.float64()),
    ]


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprint each text, its edited text and the next document's.

    docs: id_col (long) and text_col.  The next document is that of the next
    lower id, and after the last the first; rows with one id follow each other
    by their text's hash, null ids come last, null texts count as empty.
    Repeated rows give repeated rows.  Edited: the last half of the code
    points gives way to the start of the next document.  Returns the id,
    n_chars, edited_text's SHA-256, both fingerprints and their likenesses;
    of an empty table, none.

    One shuffle of the texts, to sorted ranges of (id, text's hash), so that
    many texts of one id are dealt too.  A range's first and last row are put
    aside with their texts: the last row's next is the first of the range after.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.desc("d"), F.desc("t")]
    keyed = texts.withColumns({"d": F.coalesce("doc_id", F.lit(-(2**63))), "t": F.xxhash64("text")})
    ranges = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    found = [T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("n_chars", T.LongType()), ("edited", T.BinaryType()), ("print", T.BinaryType()), ("edited_print", T.BinaryType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType()))]
    aside = [T.StructField("part", T.IntegerType()), T.StructField("edge", T.StringType()), T.StructField("text", T.StringType())]
    names = [f.name for f in [*found, *aside]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def edge(which: str, doc_id: int | None, text: str) -> pa.RecordBatch:
            none = [pa.nulls(1, t) for t in (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), *none, pa.array([part], pa.int32()), pa.array([which]), pa.array([text], pa.string())], names=names)

        last = None
        for batch in C.pieces(batches, "text"):
            ids, rows = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            if last is None:
                yield edge("first", ids[0], rows[0])
            else:
                ids, rows = [last[0], *ids], [last[1], *rows]
            last = ids[-1], rows[-1]
            if len(rows) > 1:
                n = len(rows) - 1
                yield pa.RecordBatch.from_arrays([*_compared(ids[:-1], rows[:-1], rows[1:]), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], names=names)
        if last is not None:
            yield edge("last", *last)

    rows = C.cut(ranges.mapInArrow(run, T.StructType([*found, *aside])))
    with_rows = sorted(r["part"] for r in rows.where("edge = 'first'").select("part").collect())  # a number for each range
    after = spark.createDataFrame(list(zip(with_rows, with_rows[1:] + with_rows[:1], strict=True)), "part int, after int")
    firsts = rows.where("edge = 'first'").select(F.col("part").alias("after"), F.col("text").alias("next"))
    edges = rows.where("edge = 'last'").select("part", "doc_id", "text").join(after, "part").join(firsts, "after").select("doc_id", "text", "next")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_arrays(_compared([i], [t], [n]), names=[f.name for f in found])

    every = rows.where("edge IS NULL").select(*[f.name for f in found]).unionByName(edges.mapInArrow(close, T.StructType(found)))
    hexed = lambda c: F.lower(F.hex(c))
    return every.select("doc_id", "n_chars", hexed("edited").alias("edited_sha256"), hexed("print").alias("fingerprint"), hexed("edited_print").alias("edited_fingerprint"), "near_edited", "near_next")
