import hashlib
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from stepweave.llm import _common as C
from stepweave.llm import queries, substrings

SF = "/root/testdata/sf0.001"


def brute(docs):
    """docs in order; for each the words and which go."""
    seen, out = set(), []
    for _, t in docs:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            k = tuple(w[p : p + 20])
            if k in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(k)
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def test_query_equals_brute_force(spark):
    docs = sorted((r.doc_id, r.text) for r in queries.documents(spark, SF).collect())
    want = {d: (n, g, hashlib.sha256(k).hexdigest()) for (d, _), (n, g, k) in zip(docs, brute(docs), strict=True)}
    assert sum(g for _, g, _ in want.values()) > 0
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op9_substrings(spark, SF).collect()} == want


@pytest.mark.parametrize(("shard", "hot"), [(300_000, 256), (500, 2), (500, 10**9), (300_000, 0)])
def test_passages_loops_and_hot_routes(spark, monkeypatch, shard, hot):
    monkeypatch.setattr(substrings, "SHARD_WORDS", shard)
    monkeypatch.setattr(substrings, "HOT", hot)
    random.seed(7)
    line = [f"line{i}" for i in range(12)]
    passages = [[random.choice("abcdefgh") for _ in range(random.randint(18, 70))] for _ in range(6)]
    docs = []
    for d in range(120):
        w = []
        for _ in range(random.randint(0, 4)):
            w += random.choice([line, *passages, ["x"] * random.randint(1, 300), [f"u{random.random()}" for _ in range(random.randint(0, 30))]])
        docs.append((d, "  ".join(w)))
    want = brute(docs)
    shuffled = docs[:]
    random.shuffle(shuffled)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text.encode()) for r in substrings.remove_repeats(spark.createDataFrame(shuffled, "doc_id long, text string")).collect()}
    assert [got[d] for d, _ in docs] == want and sum(g for _, g, _ in want) > 1000


def test_index_and_matching_statistics():
    """Intervals, places and lengths of matches of streamed texts, some of whose words the index lacks, against a plain search."""
    rng = np.random.default_rng(5)
    texts = [rng.integers(1, 5, rng.integers(20, 79)) for _ in range(20)] + [np.tile([1, 2, 3], 26), np.tile([1, 2, 3], 20)]
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    text = np.concatenate([np.append(t, 0) for t in texts])
    index = substrings.FmIndex(text, begin)
    assert sorted(index.locate(np.arange(len(text))).tolist()) == list(range(len(text)))
    queries = [texts[3], np.concatenate([texts[4][:30], rng.integers(1, 7, 10), texts[20][5:40]]), rng.integers(1, 5, 25)]
    query = np.minimum(np.concatenate(queries), index.before.size - 2)
    at = np.concatenate([[0], np.cumsum([len(q) for q in queries])])
    stands = lambda x: [i for i in range(len(text) - len(x) + 1) if (text[i : i + len(x)] == x).all()]
    long = 0
    got = {}
    for places, size, low, high in substrings.matching_statistics(index, query, at[:-1], np.diff(at)):
        for a, n, lo, hi in zip(places.tolist(), size.tolist(), low, high, strict=True):
            assert a not in got and (not n or sorted(index.locate(np.arange(lo, hi)).tolist()) == stands(query[a : a + n]))
            got[a] = n
    for i, q in enumerate(queries):
        for a in range(len(q)):
            most = max(n for n in range(min(substrings.WINDOW, len(q) - a) + 1) if not n or stands(query[at[i] + a : at[i] + a + n]))
            assert got[at[i] + a] == most
            long += most == substrings.WINDOW
    assert len(got) == len(query) and 60 < long < len(query)


def test_windows_of_one_changed_word_and_common_lines(spark, monkeypatch):
    """A line in every document beside words of their own: single windows of hot grams are routes of their own."""
    monkeypatch.setattr(substrings, "HOT", 8)
    line = [f"common{i}" for i in range(17)]
    docs = [(d, " ".join([f"a{d}", f"b{d % 3}", f"c{d % 2}", *line, f"x{d % 4}", f"y{d % 2}", f"z{d}"])) for d in range(200)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text.encode()) for r in substrings.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = brute(docs)
    assert [got[d] for d, _ in docs] == want and sum(g for _, g, _ in want) > 3000


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [(1, None, 1), (2, "", 1), (None, long, 1), (3, long, 1), (3, long, 1), (4, "x" * 100000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in substrings.remove_repeats(df).collect())
    assert got == [(-1, 30000, 0), (1, 0, 0), (2, 0, 0), (3, 30000, 30000), (3, 30000, 30000), (4, 1, 0)]
    assert substrings.remove_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize(("parts", "each"), [(1, 3), (4, 4), (37, 2)])
def test_even_keys_fill_partitions_evenly(spark, parts, each):
    keys = C.even_keys(spark, parts, each)
    rows = spark.createDataFrame([(k,) for k in keys], "k long").repartition(parts, "k").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(set(keys)) == parts * each and [r["count"] for r in rows] == [each] * parts
