"""Quality by positive-unlabelled learning: the non-negative unbiased risk of a linear model over the form of a text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as C

#: Bounds of the samples that the classifier is fitted on, the least by a hash of their ids.
POSITIVES, UNLABELLED = 6000, 8000
#: The score that all but LOST of the trusted positives are to reach: the bias is raised if need be, by one in APART of them, which the weights aren't fitted on.
SURE, LOST, APART = 0.7, 0.01, 5
#: Scores of the first model are counted in so many steps a unit, from -REACH to REACH.
STEPS, REACH = 100, 30
#: The score of every text where there is nothing to learn from.
UNKNOWN = 0.75
_KIND = np.full(256, 6, np.uint8)  # other signs
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[[32, 9, 11, 12, 13]], _KIND[10], _KIND[[44, 46, 58, 59, 63, 33, 39, 34, 40, 41, 45]], _KIND[128:] = 0, 1, 2, 3, 4, 5, 7
N_FEATURES = 256 + 64 + 8


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of numbers for each text: shares of bytes, of pairs of kinds of bytes, and of different words and shingles."""
    n, size = len(offsets) - 1, np.diff(offsets)
    row = np.repeat(np.arange(n, dtype=np.int64), size)
    many = np.maximum(size, 1)[:, None]
    out = np.zeros((n, N_FEATURES), np.float32)
    out[:, :256] = np.sqrt(np.bincount(row * 256 + data, minlength=n * 256).reshape(n, 256) / many)
    kind = _KIND[data]
    if len(data) > 1:
        same = row[1:] == row[:-1]
        pair = (row[1:] * 64 + kind[:-1] * np.int64(8) + kind[1:])[same]
        out[:, 256:320] = np.sqrt(np.bincount(pair, minlength=n * 64).reshape(n, 64) / many)
    hashes, _, _, first = C.words(data, offsets)
    count = np.diff(first)
    runs, run_offsets = C.shingles(hashes, first)
    different = np.diff(C.distinct_rows(hashes, first)[1]) / np.maximum(count, 1)
    fresh = np.diff(C.distinct_rows(runs, run_offsets)[1]) / np.maximum(np.diff(run_offsets), 1)
    length = np.log1p(count)
    shape = size / np.maximum(count, 1)
    out[:, 320:] = np.stack([different, fresh, fresh**4, length, length**2 / 10, np.minimum(shape, 50) / 10, count < 5, count < 20], 1)
    return out


def class_prior(positive: np.ndarray, counts: np.ndarray) -> float:
    """The share of positives among all documents, whose scores are counted in STEPS.

    The least ratio of the shares of documents and of positives above a score,
    over scores that a tenth of the positives exceed.
    """
    cuts = steps(np.quantile(positive, np.linspace(0.0, 0.9, 91)))
    of_positive = 1 - np.searchsorted(np.sort(steps(positive)), cuts) / len(positive)
    total = max(1, counts.sum())
    of_all = 1 - np.concatenate([[0], np.cumsum(counts)])[cuts] / total
    return float(np.clip(np.min((of_all + 0.5 / np.sqrt(total)) / np.maximum(of_positive, 1e-9)), 0.05, 0.99))


def steps(z: np.ndarray) -> np.ndarray:
    return ((np.clip(z, -REACH, REACH) + REACH) * STEPS).astype(np.int64)


def _adam(x: np.ndarray, gradient, steps: int, rate: float) -> np.ndarray:
    w, m, v = np.zeros(x.shape[1], np.float32), 0.0, 0.0
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _scaled(x: np.ndarray, scale: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return np.hstack([np.clip((x - scale[0]) / scale[1], -6, 6), np.ones((len(x), 1), np.float32)]).astype(np.float32)


def _penalty(decay: float) -> np.ndarray:
    return np.append(np.full(N_FEATURES, decay, np.float32), np.float32(0))


def tell_apart(p: np.ndarray, u: np.ndarray, rounds: int = 200, decay: float = 1e-3) -> np.ndarray:
    """Weights of a first model, of trusted rows against unlabelled ones."""
    return _adam(p, lambda w: -(p * sigmoid(-(p @ w))[:, None]).mean(0) + (u * sigmoid(u @ w)[:, None]).mean(0) + _penalty(decay) * w, rounds, 0.02)


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The positive and the negative part of the unbiased risk of the logistic loss, pi R_p(+) and R_u(-) - pi R_p(-), and their gradients."""
    zp, zu = p @ w, u @ w
    up = -(p * sigmoid(-zp)[:, None]).mean(0) * prior
    down = (u * sigmoid(zu)[:, None]).mean(0) - prior * (p * sigmoid(zp)[:, None]).mean(0)
    return prior * np.logaddexp(0, -zp).mean(), np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean(), up, down


def fit(p: np.ndarray, u: np.ndarray, prior: float, rounds: int = 400, decay: float = 1e-4) -> np.ndarray:
    """Minimise the non-negative risk pi R_p(+) + max(0, R_u(-) - pi R_p(-)).

    Where the estimated negative risk falls below 0, a step goes back up it.
    """
    def gradient(w):
        _, negative, up, down = risk(w, p, u, prior)
        return (up + down if negative >= 0 else -down) + _penalty(decay) * w

    return _adam(p, gradient, rounds, 0.02)


def score(model: dict, x: np.ndarray) -> np.ndarray:
    z = np.clip((x - model["mean"]) / model["scale"], -6, 6) @ model["w"][:-1] + model["w"][-1]
    return sigmoid(z.astype(np.float64))


def sample(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """role (1: trusted), a hash of the id, and features of the bounded samples: one row of each id, in an order that no partitioning changes."""
    order = lambda df, n: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    fold = C.crc_mod(F.col("doc_id"), 4) != 2
    trusted = order(labels.where((F.col("quality") == 1) & fold).select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), positives)
    web = order(docs.where(fold & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), unlabelled)
    chosen = trusted.withColumn("role", F.lit(1)).unionByName(web.withColumn("role", F.lit(0)))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).join(F.broadcast(chosen), "doc_id")  # at most positives + unlabelled ids
    rows = rows.groupBy("role", "doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("role", "doc_id", F.xxhash64("doc_id").alias("h"), "t.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.pieces(batches, "text"):
            x = features(*C.buffers(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("role"), batch.column("doc_id"), batch.column("h"), pa.array([r.tobytes() for r in x], pa.binary())], names=["role", "doc_id", "h", "x"])

    got = rows.mapInArrow(run, "role int, doc_id long, h long, x binary").toArrow()
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, N_FEATURES)
    role, ids, h = (got.column(c).to_numpy() for c in ("role", "doc_id", "h"))
    by = np.lexsort((ids, h, role))
    return role[by], h[by].view(np.uint64), x[by]


def halves(h: np.ndarray) -> np.ndarray:
    """0 or 1 for each row, as many of either (or one more): by places in an order that tells nothing of that of h, by which the samples were chosen."""
    out = np.empty(len(h), np.int64)
    out[np.argsort(C.mix(h), kind="stable")] = np.arange(len(h)) % 2
    return out


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> dict:
    """Fit on trusted positives (labels.quality = 1) and unlabelled documents, both of ids whose crc32 mod 4 isn't 2.

    Bounded samples: the positives and unlabelled ids of the least hash, one
    row of each id, a null text as the empty one; null ids and other labels
    aren't looked at.  A first model, of half of each (halves, which no bound
    and no size empties), scores all documents of these ids: the class prior is that of the corpus, by the trusted rows of the
    other half.  At last the bias is set by SURE and LOST on trusted rows that
    the weights weren't fitted on.  With under two rows of either kind, so with
    an empty table, nothing can be learned: every text scores UNKNOWN, so that
    none is rejected.
    """
    role, h, x = sample(docs, labels, positives, unlabelled)
    p, u, hp, hu = x[role == 1], x[role == 0], h[role == 1], h[role == 0]
    if min(len(p), len(u)) < 2:
        w = np.zeros(N_FEATURES + 1, np.float32)
        w[-1] = np.log(UNKNOWN / (1 - UNKNOWN))
        return {"mean": np.zeros(N_FEATURES, np.float32), "scale": np.ones(N_FEATURES, np.float32), "w": w, "prior": 0.5}
    scale = u.mean(0), u.std(0) + np.float32(0.02)
    p, u = _scaled(p, scale), _scaled(u, scale)
    in_p, in_u = halves(hp), halves(hu)
    first = tell_apart(p[in_p == 0], u[in_u == 0])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * REACH * STEPS + 1, np.int64)
        for batch in C.pieces(batches, "text"):
            total += np.bincount(steps(_scaled(features(*C.buffers(batch.column("text"))), scale) @ first), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["step", "n"])

    fold = docs.where((C.crc_mod(F.col("doc_id"), 4) != 2) & F.col("doc_id").isNotNull()).select("text")
    got = fold.mapInArrow(count, "step int, n long").groupBy("step").agg(F.sum("n").alias("n")).toArrow()  # a number for each step at most
    counts = np.zeros(2 * REACH * STEPS + 1, np.int64)
    counts[got.column("step").to_numpy()] = got.column("n").to_numpy()
    prior = class_prior(p[in_p == 1] @ first, counts)
    apart = hp % np.uint64(APART) == 0
    if not 20 <= apart.sum() < len(p):
        apart = np.ones(len(p), bool)
    w = fit(p if apart.all() else p[~apart], u, prior)
    w[-1] += max(0.0, np.log(SURE / (1 - SURE)) - np.quantile(p[apart] @ w, LOST))
    return {"mean": scale[0].astype(np.float32), "scale": scale[1].astype(np.float32), "w": w, "prior": prior}


def score_quality(docs: DataFrame, model: dict, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add score (0 to 1, higher: better) to whole texts.

    Rows stay where they are with all their columns (one named score_col is
    replaced); null texts count as empty, and empty texts get the score that
    their features give.  Of an empty table, none.
    """
    df = C.without(docs, score_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.pieces(batches, text_col):
            s = score(model, features(*C.buffers(batch.column(text_col))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=[*batch.schema.names, score_col])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(score_col, T.DoubleType())]))
