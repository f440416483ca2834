"""Toxicity: a linear classifier of character n-grams, each scaled by its naive Bayes log-count ratio."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as C
from .quality import sigmoid

#: Bound of the labelled sample that the classifier is fitted on, the least by a hash of their ids.
LABELLED = 12000
#: n-grams of so many code points; hashed to BUCKETS; of those with SUPPORT documents and a log-count ratio of RATIO, at most FEATURES by their chi-square.
SIZES = (4, 5, 6, 7)
BUCKETS = 1 << 22
SUPPORT, RATIO, FEATURES = 5, 1.0, 1 << 15
#: Code points up to here (Latin, Greek, Cyrillic and Armenian among them) are lower-cased; ASCII signs count as spaces.
FOLDED = 0x600
_FOLD = np.array([ord(chr(i).lower()) if len(chr(i).lower()) == 1 else i for i in range(FOLDED)], np.uint64)
_FOLD[[*range(0, 48), *range(58, 65), *range(91, 97), *range(123, 128)]] = 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of rows of UTF-8, folded, and the offsets of the rows in them."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    byte = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint64)
    first = byte[lead]
    point, six = first.copy(), np.uint64(6)
    for size, least, mask in ((2, 0xC0, 0x1F), (3, 0xE0, 0x0F), (4, 0xF0, 0x07)):
        some = first >= least
        if some.any():
            at, value = lead[some], first[some] & np.uint64(mask)
            for k in range(1, size):
                value = (value << six) | (byte[at + k] & np.uint64(0x3F))
            point[some] = value
    low = point < FOLDED
    point[low] = _FOLD[point[low]]
    return point, np.searchsorted(lead, offsets)


def grams(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size the buckets of the n-grams of code points and their rows; ASCII signs count as spaces, letters of either case alike, and no n-gram leaves its row."""
    data, offsets = code_points(data, offsets)
    code = C.mix(data + np.uint64(1))
    bound = np.zeros(len(data) + 1, np.int64)
    np.add.at(bound, offsets[1:-1], 1)
    row = np.cumsum(bound[:-1])
    out, h = [], code.copy()
    for n in range(2, max(SIZES) + 1):
        if len(data) < n:
            break
        h = h[: len(data) - n + 1] * _STEP + code[n - 1 :]
        if n in SIZES:
            at = np.flatnonzero(row[: len(h)] == row[n - 1 :])
            out.append(((((h + np.uint64(n)) * _STEP) >> np.uint64(42)).astype(np.int64)[at], row[at]))
    return out


def present(data: np.ndarray, offsets: np.ndarray, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of each different n-gram of each row; among: whether a bucket counts."""
    keys = []
    for bucket, row in grams(data, offsets):
        if among is not None:
            keep = among[bucket]
            bucket, row = bucket[keep], row[keep]
        keys.append(row * BUCKETS + bucket)
    key = np.concatenate(keys) if keys else np.empty(0, np.int64)
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return key // BUCKETS, key % BUCKETS


def sample(docs: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """doc_id, toxic and text of at most n labelled ids, of those whose crc32 mod 4 isn't 2, one row of each; an id with two labels counts as toxic, a null text is empty."""
    ids = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (C.crc_mod(F.col("doc_id"), 4) != 2)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)), "doc_id")
    return rows.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"), F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "toxic", "t.text")


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> dict:
    """Count n-grams by class, choose features, and fit a logistic model to their scaled presence.

    The sample has one row of each id, so repeated rows and labels count once;
    null ids and null labels don't count, null texts are empty.  With labels of
    one kind, every text gets the score of that kind; with none, or empty
    tables, 0.5.  The order of rows plays no part.
    """
    rows = C.cut(sample(docs, labels, labelled))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int32)
        for batch in C.pieces(batches, "text", C.CHUNK_BYTES // 2):
            row, bucket = present(*C.buffers(batch.column("text")))
            toxic = batch.column("toxic").to_numpy().astype(bool)[row]
            for k, of in enumerate((~toxic, toxic)):
                np.add.at(total[k], bucket[of], 1)
        some = np.flatnonzero(total.sum(0))
        for i in range(0, len(some), 1 << 17):
            b = some[i : i + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(b.astype(np.int32)), pa.array(total[0][b].astype(np.int64)), pa.array(total[1][b].astype(np.int64))], names=["bucket", "clean", "toxic"])

    n_toxic, n_all = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    n_clean = n_all - n_toxic
    if not n_toxic or not n_clean:
        C.free(rows)
        return {"value": np.zeros(BUCKETS, np.float32), "bias": 0.0 if not n_all else (6.0 if n_toxic else -6.0)}
    p, q = (F.col("toxic") + 1) / (n_toxic + 2), (F.col("clean") + 1) / (n_clean + 2)
    chi = (F.col("toxic") - (F.col("toxic") + F.col("clean")) * (n_toxic / n_all)) ** 2 / (F.col("toxic") + F.col("clean"))
    chosen = (
        rows.mapInArrow(count, "bucket int, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .withColumn("ratio", F.log(p / (1 - p)) - F.log(q / (1 - q))).where((F.col("clean") + F.col("toxic") >= SUPPORT) & (F.abs("ratio") >= RATIO))
        .orderBy(chi.desc(), "bucket").limit(FEATURES).select("bucket", "ratio").toArrow()
    )
    bucket, ratio = chosen.column("bucket").to_numpy(), chosen.column("ratio").to_numpy().astype(np.float32)
    place = np.full(BUCKETS, -1, np.int32)
    place[bucket] = np.arange(len(bucket))

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.pieces(batches, "text", C.CHUNK_BYTES // 2):
            row, b = present(*C.buffers(batch.column("text")), place >= 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), C.binary_rows(place[b], np.searchsorted(row, np.arange(batch.num_rows + 1)))], names=["doc_id", "toxic", "f"])

    got = rows.mapInArrow(presence, "doc_id long, toxic int, f binary").toArrow().sort_by("doc_id")  # labelled rows at most
    C.free(rows)
    y = got.column("toxic").to_numpy().astype(np.float64)
    parts = [np.frombuffer(x, np.int32) for x in got.column("f").to_pylist()]
    f, row = np.concatenate([np.empty(0, np.int32), *parts]), np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    w, bias = logistic(f, row, ratio, y)
    value = np.zeros(BUCKETS, np.float32)
    value[bucket] = w * ratio
    return {"value": value, "bias": bias, "ratio": dict(zip(bucket.tolist(), ratio.tolist(), strict=True))}


def logistic(f: np.ndarray, row: np.ndarray, ratio: np.ndarray, y: np.ndarray, steps: int = 200, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model whose feature f, where present, has the value ratio[f]."""
    w, bias, m, v = np.zeros(len(ratio)), float(np.log(y.mean() / (1 - y.mean()))), 0.0, 0.0
    x = ratio[f].astype(np.float64)
    for t in range(1, steps + 1):
        z = np.bincount(row, w[f] * x, minlength=len(y)) + bias
        e = (sigmoid(z) - y) / len(y)
        g = np.append(np.bincount(f, e[row] * x, minlength=len(ratio)) + decay * w, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
        w, bias = w - step[:-1], bias - step[-1]
    return w.astype(np.float32), bias


def scores(model: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    row, bucket = present(data, offsets, model["value"] != 0)
    return sigmoid(np.bincount(row, model["value"][bucket], minlength=len(offsets) - 1) + model["bias"])


def score_toxicity(docs: DataFrame, model: dict, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add score (0 to 1, higher: likelier toxic) to whole texts.

    Rows stay where they are with all their columns (one named score_col is
    replaced); null and empty texts get the score of no n-gram.  Of an empty
    table, none.  The model is sent as its non-zero values, FEATURES at most.
    """
    df = C.without(docs, score_col)
    at = np.flatnonzero(model["value"])
    sent = docs.sparkSession.sparkContext.broadcast((at, model["value"][at], model["bias"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, values, bias = sent.value
        full = np.zeros(BUCKETS, np.float32)
        full[where] = values
        for batch in C.pieces(batches, text_col):
            s = scores({"value": full, "bias": bias}, *C.buffers(batch.column(text_col)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=[*batch.schema.names, score_col])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(score_col, T.DoubleType())]))
