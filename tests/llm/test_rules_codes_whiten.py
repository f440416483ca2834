"""Quality rules, vector codes and whitening, against SQL, plain versions and numpy; and odd rows."""

from __future__ import annotations

import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stepweave.llm import codes, queries, rules, whiten

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_quality_rules", "op12_vector_codes"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.execute(f"select {', '.join(columns)} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r[c] for c in columns)) for r in df.collect()) and want


# ---------------------------------------------------------------- rules

def plain_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, t in enumerate(three) if three.count(t) > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", " \n\t ", "one", "a b c a b c", "a a a a a", "a b c x a b c\na b c x\n\n \na b c x a b c", "#<>|\x0b*\x0c\r$%& ü é 漢字 x", "x " * 49, "w%d " * 60,
    " ".join(f"w{i}" for i in range(50)), " ".join(f"w{i % 30}" for i in range(90)), "line one two\n" * 40, "\n".join(f"l{i % 7} and more" for i in range(50)),
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "kept", i * 10) for i, t in enumerate(texts)], "doc_id long, text string, N_WORDS string, row long")


def test_base_counts_equal_a_plain_version(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out = rules.judge(frame(spark, TEXTS), labels)
    assert out.columns == ["doc_id", "text", "row", *rules.ADDED]
    for r in out.collect():
        assert tuple(r[c] for c in rules.BASE) == plain_counts(r.text), r.text
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed) and r.threshold is None and r.row == r.doc_id * 10


def test_long_text_and_repeated_and_null_ids(spark):
    long = " ".join(f"w{i}" for i in range(150_000))
    docs = spark.createDataFrame([(1, long), (1, long), (None, long + " #"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (None, 1), (2, None)], "doc_id long, quality int")
    rows = sorted(rules.judge(docs, labels, keep_text=False).collect(), key=lambda r: (r.doc_id or 0, r.n_words))
    assert [(r.doc_id, r.n_words, r.n_repeat_words, r.n_symbols) for r in rows] == [(None, 0, 0, 0), (None, 150_001, 0, 1), (1, 150_000, 0, 0), (1, 150_000, 0, 0)]
    assert rules.judge(docs.limit(0), labels).count() == 0


def test_ratio_tells_junk_and_does_not_depend_on_the_partitioning(spark):
    good = [" ".join(f"word{(i * 7 + k * k) % 97}" for k in range(80)) for i in range(60)]
    junk = [" ".join(f"word{(i * 5 + k * 3) % 97}{s}" for k, s in zip(range(80), ["***", "$$$"] * 40)) for i in range(30)]
    docs = frame(spark, good + junk)
    labels = spark.createDataFrame([(i, 1) for i in range(0, 60, 2)] + [(i, 0) for i in range(60, 90, 2)], "doc_id long, quality int")
    assert {r.apart for r in rules.trusted_ids(labels).collect()} == {True, False}
    a, b = (sorted((r.doc_id, r.llr_sum, r.n_grams, r.threshold, r.kept) for r in rules.judge(d, labels).collect()) for d in (docs, docs.repartition(5)))
    assert a == b
    assert not any(r[4] for r in a if r[0] >= 60) and all(r[4] for r in a if r[0] < 60 and r[0] % 2 == 0)
    assert sum(r[4] for r in a) >= 58  # two trusted rows are apart, so the tail isn't known better
    weights = {r.bucket: r.weight for r in rules.multinomials(docs.select("doc_id", "text"), rules.trusted_ids(labels)).collect()}
    tokens = [re.findall(rules.TOKEN, t) for t in good + junk]
    number = lambda t: zlib.crc32(t.encode())
    grams = [[number(x) % rules.BUCKETS for x in t] + [(number(x) * 1_000_003 + number(y)) % rules.BUCKETS for x, y in zip(t, t[1:])] for t in tokens]
    mine = {r.id for r in rules.trusted_ids(labels).where("NOT apart").collect()}
    every, own = np.ones(rules.BUCKETS), np.ones(rules.BUCKETS)
    for i, g in enumerate(grams):
        np.add.at(every, g, 1)
        if i in mine:
            np.add.at(own, g, 1)
    want = np.floor((np.log(own / own.sum()) - np.log(every / every.sum())) * rules.UNITS + 0.5)
    assert [weights[b] for b in range(rules.BUCKETS)] == want.astype(int).tolist()
    for doc, llr_sum, n, *_ in a:
        assert (llr_sum, n) == (sum(weights[b] for b in grams[doc]), len(grams[doc]))


def test_rules_run_without_python(spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    rows = frame(spark, TEXTS).select(F.struct("doc_id").alias("row"), "text")
    for df in (rules.base_counts(rows), rules.marked(frame(spark, TEXTS), rules.trusted_ids(labels))):
        assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())


# ---------------------------------------------------------------- codes

def plain_codes(vectors, parts=16, entries=64, rounds=2):
    """vectors: (id, label, list) that are kept."""
    x = np.array([[math.floor(256 * c) for c in v] for _, _, v in vectors]).reshape(len(vectors), parts, -1)
    first = sorted(range(len(vectors)), key=lambda i: (vectors[i][0] is None, vectors[i][0]))[:entries]
    books = x[first].transpose(1, 0, 2).copy()
    assign = lambda: ((x[:, :, None, :] - books[None]) ** 2).sum(3)
    for _ in range(rounds):
        code = assign().argmin(2)
        for p in range(parts):
            for e in range(len(first)):
                if (own := x[code[:, p] == e, p]).size:
                    books[p, e] = own.sum(0) // len(own)
    d = assign()
    return d.argmin(2), d.min(2).sum(1), books


def test_codes_equal_a_plain_version_with_ties(spark):
    g = np.random.default_rng(5)
    for n, spread in ((300, 0.004), (300, 1.0), (40, 0.5), (1, 1.0)):  # small spread: few different whole numbers, many ties
        rows = [(i, int(i % 3) if i % 5 else None, [float(c) for c in v]) for i, v in enumerate(np.round(g.normal(0, spread, (n, 32)), 3))]
        bad = [(1000, 1, None), (1001, 1, [*rows[0][2][:-1], None]), (1002, 1, [math.nan, *rows[0][2][1:]]), (1003, None, [math.inf, *rows[0][2][1:]])]
        df = spark.createDataFrame(rows + bad, "vec_id long, label int, embedding array<double>").withColumn("code", F.lit("x")).repartition(3)
        coded, books = codes.compress(df)
        code, error, want = plain_codes(rows)
        assert np.array_equal(books, want)
        got = {r.vec_id: r for r in codes.with_label_errors(coded).collect()}
        assert sorted(got) == list(range(n))
        for i, (_, label, _) in enumerate(rows):
            assert list(got[i].code) == code[i].tolist() and got[i].error == error[i]
            assert got[i].label_error == sum(int(error[k]) for k in range(n) if rows[k][1] == label)


def test_search_leaves_entries_out_and_is_exact():
    g = np.random.default_rng(3)
    entries = g.integers(-300, 300, (64, 4))
    x = entries[g.integers(0, 64, 5000)] + g.integers(-20, 21, (5000, 4))
    every = ((x[:, None] - entries[None]) ** 2).sum(2)
    start = every.argmin(1)
    code, d, looked = codes.Book(entries).nearest(x, start)
    assert np.array_equal(code, every.argmin(1)) and np.array_equal(d, every.min(1))
    assert looked < 0.2 * 64 * len(x)
    code, d, _ = codes.Book(entries).nearest(x, g.integers(0, 64, 5000))
    assert np.array_equal(code, every.argmin(1)) and np.array_equal(d, every.min(1))


def test_codes_of_odd_tables(spark):
    schema = "vec_id long, label int, embedding array<float>"
    coded, _ = codes.compress(spark.createDataFrame([(1, 1, None)], schema))
    assert coded.count() == 0 and codes.with_label_errors(coded).count() == 0
    same = [(1, 1, [0.5] * 16)] * 3 + [(None, None, [0.25] * 16)]
    coded, books = codes.compress(spark.createDataFrame(same, schema))
    assert books.shape == (16, 4, 1) and sorted((r.vec_id or 0, r.error, set(r.code)) for r in coded.collect()) == [(0, 0, {3}), *[(1, 0, {0})] * 3]
    for wrong in ([(1, 1, [0.5] * 16), (2, 1, [0.5] * 32)], [(1, 1, [0.5] * 15)]):
        with pytest.raises(ValueError, match="differ in length"):
            codes.compress(spark.createDataFrame(wrong, schema))
    with pytest.raises(Exception, match="a component is larger"):
        codes.compress(spark.createDataFrame([(1, 1, [1e30] * 16)], schema))


# ---------------------------------------------------------------- whitening

def test_whitening_equals_numpy(spark):
    g = np.random.default_rng(7)
    v = (g.normal(0, 1, (500, 40)) @ g.normal(0, 0.3, (40, 40))).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    bad = [(900, None), (901, [None, *rows[0][1][1:]]), (902, [math.inf, *rows[0][1][1:]]), (903, [math.nan, *rows[0][1][1:]])]
    out = whiten.whiten(spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("x", F.lit(1)).repartition(3)).toPandas().sort_values("vec_id")
    x = np.floor(v.astype(float) * 64).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    assert out.vec_id.tolist() == list(range(n)) and out.deviation.tolist() == ((n * x - s) ** 2).sum(1).tolist() and set(out.n) == {n}
    c = x - s / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1][:32], q[:, ::-1][:, :32]
    w, want = np.array(out.whitened.tolist()), c @ q / np.sqrt(e)
    assert np.abs(w * np.sign((w * want).sum(0)) - want).max() < 1e-8
    assert np.allclose(out.explained.iloc[0], e / np.trace(c.T @ c / n), rtol=1e-9) and out.identity_error.iloc[0] < 1e-9


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>"
    assert whiten.whiten(spark.createDataFrame([(1, None)], schema)).count() == 0
    same = whiten.whiten(spark.createDataFrame([(1, [0.5, 0.25])] * 3 + [(None, [0.5, 0.25])], schema)).collect()
    assert [(r.n, r.deviation, r.whitened, r.identity_error) for r in same] == [(4, 0, [], None)] * 4
    line = whiten.whiten(spark.createDataFrame([(i, [i / 64, i / 32, 0.0]) for i in range(9)] * 2, schema)).collect()  # one component alone varies
    assert len(line) == 18 and all(len(r.whitened) == 1 for r in line) and line[0].identity_error < 1e-9 and math.isclose(line[0].explained[0], 1)
    with pytest.raises(ValueError, match="differ in length"):
        whiten.whiten(spark.createDataFrame([(1, [0.5]), (2, [0.5, 1.0])], schema))


def test_deviations_beyond_64_bits():
    x = np.array([[0, 2**40], [1, 0]])
    assert whiten.exact_deviation(x, 2**20, [0, 0]) == [None, 2**40]
    assert whiten.exact_deviation(x[1:], 2, [1, 1]) == [2]
