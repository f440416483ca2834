import collections
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stepweave.llm import lm, queries

SF = "/root/testdata/sf0.001"


def lower(t):
    return (t or "").encode().lower().split() + [b"\n"]


def test_query_against_plain_counts(spark):
    docs = [(r.doc_id, lower(r.text)) for r in queries.documents(spark, SF).collect()]
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in docs}
    c = collections.Counter(w for d, t in docs if not held[d] for w in t)
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in queries.op7_lm(spark, SF).collect()}
    for d, t in docs:
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(t), sum(w in c for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def plain_scores(spark, docs, learn, rounds):
    """The model by dictionaries of whole words, with the class probabilities that lm.fit gives for plain counts of contexts."""
    end, texts = b"\n", [(d, lower(t)) for d, t in docs]
    h = {w: int(lm.tokens(pa.array([w]))[0][0]) for _, t in texts for w in t if w != end} | {end: int(lm._END)}
    c = collections.Counter(w for d, t in texts if learn(d) for w in t)
    own = sorted(sorted((w for w in c if w != end), key=lambda w: (-c[w], np.uint64(h[w]).view(np.int64)))[: lm.OWN], key=h.get)
    once, twice = (sum(n == k and w != end for w, n in c.items()) for k in (1, 2))
    unseen = max(1.0, once * once / (2 * twice) if twice else once * (once - 1) / 2)

    def of(w, n):
        return lm.OWN if w == end else own.index(w) if w in own else min(lm.OWN + 1 + int(math.log2(n)), 62) if n > 0 else 63

    mass = collections.Counter()
    for w, n in c.items():
        mass[of(w, n)] += n
    share = lambda w, n: 1.0 if of(w, n) <= lm.OWN else n / mass[of(w, n)] if n > 0 else 1 / unseen
    value = lambda w: lm.OWN if w == end else own.index(w) if w in own else lm.OWN + 1 + h[w] % (lm.VALUES - lm.OWN - 1)
    table, pairs, total = collections.defaultdict(lambda: [0] * lm.CLASSES), collections.Counter(), collections.Counter()
    for d, t in texts:
        for two, one, w in zip([end, end, *t], [end, *t], t) if learn(d) else ():
            table[value(two) * lm.VALUES + value(one)][of(w, c[w] - 1)] += 1
            for k, x in ((1, one), (2, two)):
                pairs[k, x, w] += 1
                total[k, x] += 1
    counts = spark.createDataFrame([(k, [int(x) for x in n]) for k, n in table.items()], "context int, n array<long>")
    log = lm.log_softmax(lm.fit(counts, rounds), np.arange(lm.VALUES**2))
    log[:, [k for k in range(63) if not mass[k]]] = -np.inf
    log -= np.log(np.exp(log).sum(1, keepdims=True))

    def p(two, one, w, less, a, b):
        q = max(math.exp(log[value(two) * lm.VALUES + value(one), of(w, c[w] - less)]) * share(w, c[w] - less), 1e-15)
        q = (pairs[2, two, w] - less + a * q) / (total[2, two] - less + a)
        return (pairs[1, one, w] - less + b * q) / (total[1, one] - less + b)

    grid = [(a, b) for a in lm.SKIP_WEIGHTS for b in lm.WORD_WEIGHTS]
    alone = [sum(math.log10(p(*x, 1, a, b)) for d, t in texts if learn(d) for x in zip([end, end, *t], [end, *t], t)) for a, b in grid]
    a, b = grid[int(np.argmax(alone))]
    return {d: sum(math.log10(p(*x, 0, a, b)) for x in zip([end, end, *t], [end, *t], t)) for d, t in texts}, (p, c, unseen, end, a, b)


@pytest.mark.parametrize("packet", [8 << 20, 900])
def test_scores_equal_a_plain_version_and_sum_to_one(spark, monkeypatch, packet):
    """In packets of any size; after any two words all words, the end and those not learned have 1 between them."""
    monkeypatch.setattr(lm, "PACKET_BYTES", packet)
    words = [f"w{i}" for i in range(150)]
    rng = np.random.default_rng(1)
    weight = np.arange(150, 0, -1.0) ** 2
    docs = [(i, " ".join(rng.choice(words, p=weight / weight.sum(), size=rng.integers(0, 40)))) for i in range(120)]
    docs += [(7 * i + 1000, " ".join([*rng.choice(words, size=5), f"n{i}", f"n{i + 1}", "w0"])) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want, (p, c, unseen, end, a, b) = plain_scores(spark, docs, lambda d: d < 1000, 4)
    got = {r.doc_id: r.score for r in lm.score(df, F.col("doc_id") < 1000, rounds=4).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[d], want[d], rel_tol=1e-5) for d in want)
    for two, one in ((end, end), (b"w3", b"w0"), (b"w0", b"w149"), (b"n9", b"w1"), (b"n3", b"n4")):
        known = sum(p(two, one, w, 0, a, b) for w in [*c])
        assert math.isclose(known + unseen * p(two, one, b"n5", 0, a, b), 1, rel_tol=1e-6)


def test_held_out_gain_with_and_without_unknown_words(spark):
    """The gain over the base on held-out texts isn't the unknown words' alone."""
    docs = queries.documents(spark, "/root/testdata/sf0.01")
    rows = lm.score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2).where("crc32(cast(cast(doc_id AS string) AS binary)) % 7 = 2").collect()
    gain, tokens = sum(r.score - r.base_score for r in rows), sum(r.n_tokens for r in rows)
    known = [r for r in rows if r.n_known == r.n_tokens]
    print("gain a token", gain / tokens, "texts of known words alone", sum(r.score - r.base_score for r in known) / max(1, sum(r.n_tokens for r in known)), len(known))
    assert gain > 0.03 * tokens and sum(r.score - r.base_score for r in known) > 0


def test_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 1), (None, "A b", 1), (3, "a " * 50000, 1), (3, "a " * 50000, 1), (4, "x" * 100000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = lm.score(df, F.lit(True), rounds=1).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 2, 3, 50001, 50001] and all(r.n_known == r.n_tokens for r in got)
    assert lm.score(df.limit(0), F.lit(True), rounds=1).count() == 0
    assert all(r.n_known == 0 and np.isfinite(r.score) and r.score < 0 for r in lm.score(df, F.lit(False), rounds=1).collect())


@pytest.mark.parametrize("packet", [8 << 20, 3000])
def test_word_features_tell_words_of_a_class_apart(spark, monkeypatch, packet):
    """Pairs of ordinary words of like frequency: the second is foretold by the first, or by the one before it."""
    monkeypatch.setattr(lm, "PACKET_BYTES", packet)
    rng = np.random.default_rng(3)
    docs = []
    for i in range(120):
        k = [int(j) for j in rng.permutation(50)[:12]]
        docs.append((i, " ".join(f"a{j} b{j} z c{j}" for j in k)))
    probes = [(1000, "a7 b7"), (1001, "a9 b9"), (1002, "a7 b9"), (1003, "a9 b7"), (1004, "b7 z c7"), (1005, "b9 z c9"), (1006, "b7 z c9"), (1007, "b9 z c7"), (1008, "c3 q"), (1009, "c3 a2")]
    df = spark.createDataFrame(docs + probes, "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.score(df, F.col("doc_id") < 1000, rounds=2).collect()}
    # pairs that stand in the text against the same words crosswise, so that their own frequencies don't count
    assert got[1000] + got[1001] > got[1002] + got[1003] + 1 and got[1004] + got[1005] > got[1006] + got[1007] + 0.5
    assert all(np.isfinite(x) and x < 0 for x in got.values())


def test_columns_of_other_names_stay_out(spark):
    rows = [(i, f"some words {i % 7} here", 1, True, "x", 2.0) for i in range(40)]
    a = lm.score(spark.createDataFrame(rows, "doc_id long, text string, packet int, learn boolean, tokens string, base double"), F.col("doc_id") < 30, rounds=2)
    b = lm.score(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), F.col("doc_id") < 30, rounds=2)
    assert a.columns == ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert sorted((r.doc_id, round(r.score, 6)) for r in a.collect()) == sorted((r.doc_id, round(r.score, 6)) for r in b.collect())
