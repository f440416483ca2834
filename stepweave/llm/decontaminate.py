"""Benchmark decontamination with DataFrame functions alone.

SimHash fingerprints of all windows of SIZE words of documents and of items,
blocks of the fingerprints that any two within RADIUS share one of, and exact
weighted similarity of every item-sized window that can be similar enough by
what the blocks found in it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as C

SIZE = 5
#: Fingerprints within RADIUS bits agree in one of RADIUS + 1 blocks.
RADIUS = 3
#: Words of a piece of a document, so that work is in proportion to its length.
PIECE = 768
#: Most rows of the benchmark's fingerprint index, items with up to 12 shingles each, or items found in documents with up to 25 places each, that are broadcast (under 100 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Bits of a shingle that hold its letters; those beyond count no further.
_WEIGHT_BITS = 20


def _sized(df: DataFrame, rows: Column | None = None) -> DataFrame:
    number = df.count() if rows is None else df.agg(F.sum(rows)).first()[0] or 0
    return F.broadcast(df) if number <= BROADCAST_ROWS else df


def _words(text: Column) -> Column:
    """Lower-case words: runs of characters other than space and 9 to 13."""
    clean = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.split(clean, C.SPACE_RUN), lambda w: w != "")


def _shingle(h: Column, lengths: Column, n: Column, at: Column) -> Column:
    """The SIZE words from at, or n of them where n is less: 44 bits of their hash, and their letters: long words tell more."""
    words = F.when(n >= SIZE, F.xxhash64(*[F.get(h, at + k) for k in range(SIZE)])).otherwise(F.xxhash64(*[F.when(k < n, F.get(h, at + k)) for k in range(SIZE)], n))
    weight = reduce(lambda a, b: a + b, [F.when(k < n, F.get(lengths, at + k)).otherwise(0) for k in range(SIZE)])
    return F.shiftleft(words, _WEIGHT_BITS).bitwiseOR(F.least(weight, F.lit((1 << _WEIGHT_BITS) - 1)).cast("long"))


def _set(h: Column, lengths: Column, n: Column) -> Column:
    """The different shingles of n words."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(n - SIZE, F.lit(0))), lambda at: _shingle(h, lengths, n, at)))


def _weight(shingles: Column) -> Column:
    return F.aggregate(shingles, F.lit(0).cast("long"), lambda a, x: a + x.bitwiseAND(F.lit((1 << _WEIGHT_BITS) - 1).cast("long")))


def _hashed(df: DataFrame, text: str, *keys: str) -> DataFrame:
    words = df.select(*keys, _words(F.col(text)).alias("words"))
    return words.select(*keys, F.size("words").alias("n"), F.transform("words", lambda w: F.xxhash64(w)).alias("h"), F.transform("words", F.length).alias("lengths"))


def _short_windows(words: DataFrame, sizes: list[int], *keys: str) -> DataFrame:
    """(keys, start, sh) of every window of each of sizes, all under SIZE words."""
    part = lambda c: F.slice(c, F.col("from") + 1, PIECE + SIZE - 2).alias(c)
    pieces = words.where("n > 0").select(*keys, "h", "lengths", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(PIECE))).alias("from")).select(*keys, "from", part("h"), part("lengths"))
    starts = pieces.select(*keys, "from", "h", "lengths", F.explode(F.sequence(F.lit(0), F.least(F.size("h"), F.lit(PIECE)) - 1)).alias("at"))
    windows = starts.select(*keys, "from", "h", "lengths", "at", F.explode(F.array(*map(F.lit, sizes))).alias("size")).where(F.col("at") + F.col("size") <= F.size("h"))
    return windows.select(*keys, (F.col("from") + F.col("at")).alias("start"), _shingle(F.col("h"), F.col("lengths"), F.col("size"), F.col("at")).alias("sh"))


def _added(df: DataFrame, bits: dict[int, list[str]], *others: str) -> tuple[DataFrame, dict[int, list[str]]]:
    """Add up columns of 64 one-bit lanes by full adders: bits names columns by what their bits count for, at the end one for each.

    All layers are columns of their own, since each is read twice by the next.
    """
    layer = 0
    while any(len(names) > 1 for names in bits.values()):
        layer, columns, after = layer + 1, [], {}
        for weight, names in sorted(bits.items()):
            whole = len(names) - len(names) % 3 if len(names) > 2 else 0
            groups = [names[i : i + 3] for i in range(0, whole, 3)]
            rest = names[whole:]
            if len(rest) == 2 and not groups:
                groups, rest = [rest], []
            after.setdefault(weight, []).extend(rest)
            columns += rest
            for i, group in enumerate(groups):
                a, b, *c = map(F.col, group)
                odd, both, name = a.bitwiseXOR(b), a.bitwiseAND(b), f"_{weight}_{layer}_{i}_{len(others)}"
                columns.append((odd.bitwiseXOR(c[0]) if c else odd).alias(f"{name}s"))
                columns.append((both.bitwiseOR(odd.bitwiseAND(c[0])) if c else both).alias(f"{name}c"))
                after[weight].append(f"{name}s")
                after.setdefault(2 * weight, []).append(f"{name}c")
        bits = after
        df = df.select(*others, *columns)
    return df, bits


def _at_least(bits: dict[int, list[str]], number: int) -> Column:
    """The lanes in which the sum is number or more."""
    known = F.lit(-1).cast("long")  # of the bits so far: equal, so at least
    for weight in sorted(bits):
        bit = F.col(bits[weight][0])
        known = bit.bitwiseAND(known) if number & weight else bit.bitwiseOR(known)
    return known


def _fingerprints(df: DataFrame, sizes: list[int], *keys: str) -> DataFrame:
    """(keys, fp of each of sizes, null where the words end before) of windows of left words from word at of h, an array of hashes.

    A bit is set if it is in more than half of the words' hashes.
    """
    names = [f"_w{k}" for k in range(max(sizes))]
    df = df.select(*keys, "left", *[F.coalesce(F.get("h", F.col("at") + k), F.lit(0).cast("long")).alias(w) for k, w in enumerate(names)])
    done, bits, have = 0, {}, []
    for size in sorted(sizes):  # a larger window's sums go on from the smaller one's
        bits = {**bits, 1: [*bits.get(1, []), *names[done:size]]}
        df, bits = _added(df, bits, *keys, "left", *have, *names[size:])
        vote = F.when(F.col("left") >= size, _at_least(bits, size // 2 + 1)).alias(f"fp{size}")
        df = df.select(*keys, "left", *have, vote, *names[size:], *[n[0] for n in bits.values()])
        have, done = [*have, f"fp{size}"], size
    return df.select(*keys, *have)


def _blocks(size: int) -> Column:
    """(key, size, fp) for each block of a fingerprint: 64 bits in RADIUS + 1 parts; the key tells size, block and value."""
    edges, fp = [64 * i // (RADIUS + 1) for i in range(RADIUS + 2)], F.col(f"fp{size}")
    value = lambda a, b: F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long"))
    return F.array(*[F.struct((value(a, b) + ((size * (RADIUS + 1) + i) << 32)).alias("key"), fp.alias("fp")) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))])


def _first_block(key: Column, differ: Column) -> Column:
    """Whether the block of key is the first of those in which two fingerprints agree, so that they meet once."""
    edges = [64 * i // (RADIUS + 1) for i in range(RADIUS + 2)]
    block = F.pmod(F.shiftrightunsigned(key, 32), F.lit(RADIUS + 1))
    parts = [F.shiftrightunsigned(differ, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return reduce(lambda so_far, i: so_far & ((block <= i) | (parts[i] != 0)), range(RADIUS), F.lit(True))


def find_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", short_within: bool = False) -> DataFrame:
    """Benchmark items that stand in documents.

    docs: id_col (long), text_col; benchmark: item_id (long), text; other
    columns are left out.  An item of L words is in a document if some window
    of L successive words of it (fewer at its ends) has, on sets of 5-word
    shingles weighted by their letters, 100 * common weight >= percent * weight
    of the union.  Items of under 5 words are one shingle, found in documents
    of just these words; with short_within, as those of more words, in any
    window.  Null or empty texts hold nothing and are in nothing.  Returns
    doc_id, text_hash, item_id, common, total (weights of the best window) once
    for each (doc_id, text) and item; repeated rows count once, null ids of
    documents and of items are kept as null, and different texts with one
    item_id are looked for each by itself.  Of empty tables, none.

    Every window of SIZE words has a fingerprint, in documents and in items, and
    blocks look the documents' up among all items.  A shingle that both have is
    among what is found, since equal words have equal fingerprints, and so is
    every item-sized window with common weight.  The letters found in a window
    are at least its common weight: windows in which they reach percent of the
    item's weight are all compared, and no other can be similar enough.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.length("text") > 0).withColumn("text_hash", F.xxhash64("text"))
    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.length("text") > 0).distinct()
    hashed = _hashed(named.withColumn("item", F.xxhash64("item_id", "text")), "text", "item", "item_id").where("n > 0")
    items = C.cut(hashed.withColumnRenamed("n", "length").withColumn("own", _set(F.col("h"), F.col("lengths"), F.col("length"))).withColumn("whole", _weight(F.col("own"))))
    words = _hashed(texts, "text", "doc_id", "text_hash")
    place = ["doc_id", "text_hash", "item", "length", "whole"]

    short_items = items.where(F.col("length") < SIZE).select("item", "length", "whole", F.col("own")[0].alias("sh"))
    short = words.where(F.col("n").between(1, SIZE - 1)).select("doc_id", "text_hash", F.lit(0).alias("start"), _shingle(F.col("h"), F.col("lengths"), F.col("n"), F.lit(0)).alias("sh"))
    if short_within and (sizes := sorted(r.length for r in short_items.select("length").distinct().collect())):
        short = _short_windows(words, sizes, "doc_id", "text_hash")
    of_short = short.join(_sized(short_items), "sh").groupBy(*place).agg(F.min("start").alias("start"))  # windows with an item's one shingle are all alike

    every = items.where(F.col("length") >= SIZE).select("item", "length", "whole", "h", "lengths", F.explode(F.sequence(F.lit(0), F.col("length") - SIZE)).alias("at"))
    letters = _shingle(F.col("h"), F.col("lengths"), F.col("length"), F.col("at")).bitwiseAND(F.lit((1 << _WEIGHT_BITS) - 1).cast("long"))
    prints = _fingerprints(every.withColumn("letters", letters).withColumn("left", F.lit(SIZE)), [SIZE], "item", "length", "whole", "letters")
    index = C.cut(prints.select("item", "length", "whole", "letters", F.explode(_blocks(SIZE)).alias("b")).select("item", "length", "whole", "letters", "b.key", F.col("b.fp").alias("item_fp")).distinct())
    pieces = words.where(F.col("n") >= SIZE).select("doc_id", "text_hash", "n", "h", F.explode(F.sequence(F.lit(0), F.col("n") - SIZE, F.lit(PIECE))).alias("from"))
    pieces = pieces.select("doc_id", "text_hash", "from", F.slice("h", F.col("from") + 1, PIECE + SIZE - 1).alias("h"))
    windows = pieces.select("doc_id", "text_hash", "from", "h", F.explode(F.sequence(F.lit(0), F.size("h") - SIZE)).alias("at")).withColumn("left", F.lit(SIZE))
    prints = _fingerprints(windows, [SIZE], "doc_id", "text_hash", "from", "at")
    blocks = prints.select("doc_id", "text_hash", (F.col("from") + F.col("at")).alias("at"), F.explode(_blocks(SIZE)).alias("b")).select("doc_id", "text_hash", "at", "b.key", "b.fp")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS
    met = blocks.join(_sized(index), "key").where(near & _first_block(F.col("key"), F.col("fp").bitwiseXOR(F.col("item_fp"))))
    met = met.groupBy(*place).agg(F.collect_set(F.struct("at", "letters")).alias("met"))
    enough = lambda letters: letters * 100 >= F.col("whole") * percent
    met = met.where(enough(F.aggregate("met", F.lit(0).cast("long"), lambda a, x: a + x["letters"]))).select(*place, F.explode("met").alias("m"))
    holding = F.sequence(F.col("m.at") + SIZE - F.col("length"), F.col("m.at"))  # the windows of the item's length with these words
    most = met.select(*place, F.explode(holding).alias("start"), "m.letters").groupBy(*place, "start").agg(F.sum("letters").alias("letters"))
    places = of_short.unionByName(most.where(enough(F.col("letters"))).select(*place, "start"))

    found = places.groupBy(*place).agg(F.collect_set("start").alias("starts"))
    found = C.cut(found.select("doc_id", "text_hash", F.struct("item", "length", "starts").alias("f")).groupBy("doc_id", "text_hash").agg(F.collect_list("f").alias("found")))
    C.free(index)

    number = F.aggregate("found", F.lit(0).cast("long"), lambda a, f: a + 1 + F.ceil(F.size(f["starts"]) / 25))  # starts take 4 bytes each
    same = texts["doc_id"].eqNullSafe(found["doc_id"]) & (texts["text_hash"] == found["text_hash"])
    chosen = texts.join(_sized(found, number), same).select(texts["doc_id"], texts["text_hash"], "text", "found")
    each = _hashed(chosen, "text", "doc_id", "text_hash", "found").select("doc_id", "text_hash", "n", "h", "lengths", F.explode("found").alias("f")).select("doc_id", "text_hash", "n", "h", "lengths", "f.item", "f.length", F.explode("f.starts").alias("start"))
    first = F.greatest(F.col("start"), F.lit(0))
    size = F.least(F.col("start") + F.col("length"), F.col("n")) - first
    windows = each.where(size > 0).select("doc_id", "text_hash", "item", F.slice("h", first + 1, size).alias("h"), F.slice("lengths", first + 1, size).alias("lengths"), size.alias("n"))
    sets = windows.select("doc_id", "text_hash", "item", _set(F.col("h"), F.col("lengths"), F.col("n")).alias("set"))
    sums = sets.join(_sized(items.select("item", "item_id", "own"), 1 + F.floor(F.size("own") / 12)), "item").select("doc_id", "text_hash", "item_id", _weight(F.array_intersect("set", "own")).alias("common"), _weight(F.array_union("set", "own")).alias("total"))
    best = F.max(F.struct((F.col("common") / F.col("total")).alias("s"), "common", "total")).alias("best")
    leaks = sums.where(F.col("common") * 100 >= F.col("total") * percent)
    return leaks.groupBy("doc_id", "text_hash", "item_id").agg(best).select("doc_id", "text_hash", "item_id", "best.common", "best.total")
