"""Near-duplicates by MinHash with tensored banding, and exact confirmation of links.

Two collections of HALVES half-keys, each of HALF_HASHES min-hashes, give
HALVES squared table keys by pairing a half-key of one with one of the other:
the keys of 64 tables of four hashes each for 32 min-hashes instead of 256.
Below 85 hundredths there are WIDER half-keys of each, so 100 tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as C

HALVES, HALF_HASHES = 8, 2
_SEEDS = C._odd(2 * HALVES * HALF_HASHES)
_KEYS = C._odd(4)
WIDER = 10
#: Drawn apart, so that the other hashes stay as they are.
_MORE = np.random.Generator(np.random.PCG64(85)).integers(0, 2**64, 2 * (WIDER - HALVES) * HALF_HASHES, dtype=np.uint64) | np.uint64(1)
#: Most candidate texts whose ids are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: 64-bit words of the parities by which pairs are told apart.
PARITY_WORDS = 8


def signatures(values: np.ndarray, offsets: np.ndarray, halves: int = HALVES) -> np.ndarray:
    """Min-hashes of each row's shingles; rows without any are 0."""
    seeds = np.concatenate([_SEEDS, _MORE])[: 2 * halves * HALF_HASHES]
    out = np.zeros((len(offsets) - 1, len(seeds)), np.uint32)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        for j, seed in enumerate(seeds):
            out[some, j] = np.minimum.reduceat((values ^ (values >> np.uint64(29))) * seed, offsets[some]) >> np.uint64(32)
    return out


def table_keys(signature: np.ndarray) -> np.ndarray:
    """The table keys of each signature: a column for each pair of half-keys."""
    halves = signature.shape[1] // (2 * HALF_HASHES)
    half = signature.reshape(len(signature), 2, halves, HALF_HASHES).astype(np.uint64)
    packed = C.mix((half[..., 0] << np.uint64(32) | half[..., 1]) * _KEYS[0])
    table = np.arange(halves * halves, dtype=np.uint64).reshape(halves, halves) * _KEYS[3]
    return C.mix(packed[:, 0, :, None] * _KEYS[1] + packed[:, 1, None, :] * _KEYS[2] + table).reshape(len(signature), halves * halves)


def _sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, their offsets, the set's own hash, and whether it has any."""
    hashes, _, _, first = C.words(*C.buffers(column))
    values, offsets = C.distinct_rows(*C.shingles(hashes, first))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(C.mix(values * _KEYS[2]))])
    size = np.diff(offsets).astype(np.uint64)
    return values, offsets, C.mix(total[offsets[1:]] - total[offsets[:-1]] + size * _KEYS[3]).astype(np.int64), size > 0


def sketch(docs: DataFrame, halves: int = HALVES) -> DataFrame:
    """doc_id, text_hash, set (hash of its shingle set, null if empty), n_shingles, signature of each row of (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.pieces(batches, "text"):
            values, offsets, ids, some = _sets(batch.column("text"))
            rows = np.ascontiguousarray(signatures(values, offsets, halves))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(ids, pa.int64(), mask=~some), pa.array(np.diff(offsets), pa.int64()), C.binary_rows(rows.reshape(-1), np.arange(len(rows) + 1) * rows.shape[1])],
                names=["doc_id", "text_hash", "set", "n_shingles", "signature"],
            )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, set long, n_shingles long, signature binary")


def keys_of(nodes: DataFrame) -> DataFrame:
    """(key, set) for each table and set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                keys = table_keys(C.buffers(part.column("signature"))[0].view(np.uint32).reshape(part.num_rows, -1))
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).astype(np.int64)), pa.array(np.repeat(part.column("set").to_numpy(), keys.shape[1]))], names=["key", "set"])

    return nodes.select("set", "signature").mapInArrow(run, "key long, set long")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (va, oa), (vb, ob) = ((x.view(np.uint64), o // 8) for x, o in (C.buffers(batch.column(c)) for c in ("va", "vb")))
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]]
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * common >= percent * (len(both) - common)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    left, right = (sets.select(F.col("set").alias(k), F.col("v").alias(f"v{k}")) for k in "ab")
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "va", "vb").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b); a component is its least node.

    Alternating large and small stars: each node links its larger neighbours,
    then itself and its smaller ones, to the least; rounds grow with the
    logarithm of the longest path.  Links stay in tables throughout, and each
    node's least is a table before it is joined, so that a hub's links can be
    split over tasks.
    """
    links = C.cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while not _stars(links):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = C.cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = C.cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        before, links = links, C.cut(small)
        C.free(before, least, large)
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _stars(links: DataFrame) -> bool:
    """Whether every u has one link (u, v), v < u, to a v that has none: then v is its component's least."""
    number, different = links.agg(F.count(F.lit(1)), F.count_distinct("u")).first()
    return number == different and links.join(links.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


def rest_pairs(unresolved: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may be links, for (set, component) rows; exact.

    Linked sets share one of the first n - ceil(n * percent / 100) + 1 shingles
    in any order that all sets follow.  Here shingles of one component come
    first, which no pair shares, then rarer ones.  At the first that two sets
    share, what is left of each must still hold the intersection that a link
    needs: so sets that each differ from all others in enough places make no
    pair, however many they are.  Nor may the shingles in one set only exceed
    what a link allows; those that no other component has, and the bits in which
    the parities of the sets' other shingles differ, are as many at least.
    """
    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.pieces(batches, "v"):
            values, offsets = C.buffers(batch.column("v"))
            number = np.diff(offsets) // 8
            repeat = lambda c: pa.array(np.repeat(batch.column(c).to_numpy(), number))
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), repeat("set"), repeat("component"), pa.array(np.repeat(number, number))], names=["token", "set", "component", "n"])

    tokens = sets.join(unresolved, "set").select("set", "component", "v").mapInArrow(expand, "token long, set long, component long, n long")
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token", "df")
    per_set = tokens.join(shared, "token").groupBy("set", "component", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    most = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("t"))
    words = [f"parity{w}" for w in range(PARITY_WORDS)]
    parity = [F.expr(f"aggregate(t, 0L, (acc, x) -> acc ^ if((x.token >> 6) % {PARITY_WORDS} in ({w}, {w - PARITY_WORDS}), shiftleft(1L, cast(x.token & 63 as int)), 0L))").alias(c) for w, c in enumerate(words)]
    ready = per_set.where(most > 0).select("set", "component", "n", F.size("t").alias("m"), F.slice("t", 1, most.cast("int")).alias("first"), *parity)
    prefix = C.cut(ready.select("set", "component", "n", "m", *words, F.posexplode("first").alias("at", "t")).select("set", "component", "n", "m", *words, (F.col("m") - F.col("at")).alias("left"), "t.token"))
    a, b = (prefix.select("token", *[F.col(c).alias(f"{c}_{k}") for c in ("set", "component", "n", "m", "left", *words)]) for k in "ab")
    odd = reduce(add, [F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in words])
    apart = F.col("n_a") - F.col("m_a") + F.col("n_b") - F.col("m_b") + odd
    fits: Column = (F.col("component_a") < F.col("component_b")) & (F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent) & (F.least("left_a", "left_b") * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent)
    fits &= apart * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)
    return a.join(b, "token").where(fits).select(F.col("set_a").alias("a"), F.col("set_b").alias("b")).distinct()


def link(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's class of near-duplicates.

    docs: id_col (long), text_col.  Words, shingles and links as in the
    README: 5-word shingles, 100 * intersection >= percent * union.  Returns
    doc_id, n_shingles, component_id (the least id linked by any chain, itself
    included; null ids don't count, a class of null ids alone has null), kept
    (doc_id is component_id), text_hash (xxhash64 of the text) and stays, for
    every row.  stays marks one (doc_id, text_hash) of each class, the least, with
    an id where there is one: repeated rows of it have it all, and so has every
    row without shingles.  Rows whose sets are equal are one node from the start,
    so repeated rows and copies aren't paired.  Null and empty texts are linked
    with nothing.  Of an empty table, none.

    Equal table keys give candidates.  In each bucket all sets are confirmed
    against its hub, the set that meets most others over all its tables, so one
    near the middle of a group; buckets that then still hold sets of several components
    go on to rest_pairs, so that no link among candidates is lost.  Two sets of
    similarity 0.85 miss each other in all tables with probability 7e-5, and so do
    two of 0.8 where percent is under 85, since there are more tables then.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = C.cut(sketch(texts, HALVES if percent >= 85 else WIDER))
    nodes = rows.where("set is not null").groupBy("set").agg(F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("at"), F.first("signature").alias("signature"))
    keys = keys_of(nodes)
    shared = C.cut(keys.join(keys.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1"), "key"))
    central = shared.groupBy("set").agg(F.sum("many").alias("met"))
    hubs = shared.join(central, "set").groupBy("key").agg(F.max(F.struct("met", "set")).getField("set").alias("hub"))
    members = C.cut(shared.select("key", "set").join(hubs, "key"))
    candidates = C.cut(members.select("set").distinct().join(nodes.select("set", "at"), "set"))
    sets = C.cut(shingle_sets(texts, candidates))
    pairs = members.where("set <> hub").select(F.col("hub").alias("a"), F.col("set").alias("b")).distinct()
    edges = C.cut(confirm(pairs, sets, percent))
    found = C.cut(components(edges))
    of_member = members.join(found.withColumnRenamed("node", "set"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    open_keys = of_member.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    unresolved = C.cut(of_member.join(open_keys, "key").select("set", "component").distinct())
    if not unresolved.isEmpty():
        more = confirm(rest_pairs(unresolved, sets, percent), sets, percent)
        found = C.cut(components(edges.unionByName(more)))
    members_of = rows.select("doc_id", "text_hash", "set", "n_shingles").join(found, F.col("set") == F.col("node"), "left").withColumn("component", F.coalesce("component", "set")).drop("node")
    ranked = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    first = members_of.where("component is not null").groupBy("component").agg(F.min(ranked).alias("first")).select("component", F.col("first.doc_id").alias("component_id"), F.col("first.text_hash").alias("first_hash"))
    first = C.cut(first)  # joined from a table, so that the rows of a large class can be split over tasks
    out = members_of.join(first, "component", "left").withColumn("component_id", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "text_hash", (F.col("component").isNull() | kept & (F.col("text_hash") == F.col("first_hash"))).alias("stays"))


def shingle_sets(texts: DataFrame, candidates: DataFrame) -> DataFrame:
    """(set, v: its sorted shingles) for candidates (set, at: an id that has it)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.pieces(batches, "text"):
            values, offsets, ids, some = _sets(batch.column("text"))
            mask = pa.array(some & (ids == batch.column("set").to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array(ids).filter(mask), C.binary_rows(values, offsets).filter(mask)], names=["set", "v"])

    wanted = candidates.select("set", "at")
    if candidates.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    at = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    return texts.withColumn("at", at).join(wanted, "at").select("set", "text").mapInArrow(run, "set long, v binary")
