"""The pipeline's stages, each against a brute-force version on what its predecessor kept, and odd rows."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
import test_decontaminate
import test_neardup
from tokenizers import Tokenizer

import corpus_pipeline as P
from stepweave.llm import bpe, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans int, _score string"
PLAIN = " ".join(f"sentence{i % 37} number{i}" for i in range(60))
ODD = [
    (9001, None, None, None, None, 1, "a"), (9002, "", "en", None, 0, None, None), (None, PLAIN, None, None, None, None, None),
    (9003, PLAIN + " end", None, "s", 1, 2, "b"), (9003, PLAIN + " end", None, "s", 1, 2, "b"), (9003, "quite another " * 40, None, None, None, None, None),
    (None, "write to some.body@mail.example or 10.0.0.1 soon, it says here", "en", "s", 5, 7, "c"), (9004, "long words " * 20000, None, None, None, None, None),
]
EMAIL, IP = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest tables with odd rows and columns whose names clash."""
    out = str(tmp_path_factory.mktemp("sf"))
    docs = queries.table(spark, SF, "documents").selectExpr("doc_id", "text", "lang", "source", "n_chars", "1 AS spans", "'x' AS _score")
    docs.union(spark.createDataFrame(ODD, SCHEMA)).write.parquet(f"{out}/documents.parquet")
    queries.table(spark, SF, "benchmark").write.parquet(f"{out}/benchmark.parquet")
    labels = queries.table(spark, SF, "labels").selectExpr("doc_id", "quality", "toxic")
    labels.union(spark.sql("SELECT CAST(NULL AS BIGINT), 1, 0")).union(spark.sql("SELECT 9001L, NULL, NULL")).write.parquet(f"{out}/labels.parquet")
    return out


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_stages(spark, folder):
    docs = queries.table(spark, folder, "documents")
    names = docs.columns
    steps = {}
    for name, stage in P.STAGES:
        docs = P.C.cut(stage(spark, docs, folder))
        steps[name] = docs
        assert name == "bpe" or docs.columns == names
    kept = rows(steps["quality"])
    good = {r.doc_id for r in queries.table(spark, folder, "labels").where("quality = 1").collect()}
    assert len(good & {r[0] for r in kept}) >= 0.95 * len(good & {r[0] for r in rows(queries.table(spark, folder, "documents"))})

    # one row of each class: the least id with one, then the text
    numbered = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0))
    classes = test_neardup.brute([(i, r[1]) for i, r in enumerate(numbered)], P.LINKED)
    want = sorted(str(r) for i, r in enumerate(numbered) if classes[i][0] == 0 or classes[i][1] == i)
    got = rows(steps["near_dedup"])
    assert sorted(map(str, got)) == want

    items = [(r.item_id, r.text) for r in queries.table(spark, folder, "benchmark").collect()]
    leaks = {i for i, _ in test_decontaminate.brute([(i, r[1]) for i, r in enumerate(got) if len(r[1] or "") < 100_000], items)}
    clean = [r for i, r in enumerate(got) if i not in leaks]
    assert leaks and sorted(map(str, rows(steps["decontaminate"]))) == sorted(map(str, clean))

    redacted = rows(steps["pii"])
    assert len(redacted) == len(clean) and sorted(map(str, (r[0] for r in redacted))) == sorted(map(str, (r[0] for r in clean)))
    for r in redacted:
        assert not re.search(EMAIL, r[1] or "") and (r[1] is None or r[4] == len(r[1]))
    assert sorted(str(r[5:]) for r in redacted) == sorted(str(r[5:]) for r in clean)
    untouched = {(str(r[0]), r[1]) for r in clean if not re.search("[0-9@]", r[1] or "")}
    assert untouched <= {(str(r[0]), r[1]) for r in redacted}

    tokenizer = Tokenizer.from_file(bpe.default_path())
    ids = sorted((str(r[0]), tokenizer.encode(r[1] or "", add_special_tokens=False).ids) for r in redacted)
    assert ids == sorted((str(r.doc_id), np.frombuffer(r.token_ids, "<u4").tolist()) for r in docs.collect())


def test_near_copies_of_odd_rows(spark, folder):
    docs = spark.createDataFrame(ODD, SCHEMA)
    out = rows(P.drop_near_copies(spark, docs, folder))
    assert sorted(map(str, out)) == sorted(map(str, [*ODD[:2], ODD[3], *ODD[5:]]))


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        queries.table(spark, folder, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
    docs = spark.createDataFrame(ODD, SCHEMA)
    assert sorted(map(str, rows(P.keep_quality(spark, docs, str(tmp_path))))) == sorted(map(str, ODD))
    assert P.drop_leaks(spark, docs, str(tmp_path)).count() == len(ODD)


def test_near_copies_from_eight_tenths_on(spark, folder):
    """Pairs of similarity 0.80 to 0.85 lose one row, those below none."""
    rng = np.random.default_rng(8)
    docs, want = [], 0
    for i in range(60):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 204)]
        edited = words.copy()
        for k in range(4 if i % 2 else 6):  # each edit changes five of 200 shingles: 20 of them 180/220, 30 of them 170/230
            edited[20 + 30 * k] = f"x{i}y{k}"
        docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(edited))]
        common, both = len(test_neardup.shingle_set(docs[-1][1]) & test_neardup.shingle_set(docs[-2][1])), len(test_neardup.shingle_set(docs[-1][1]) | test_neardup.shingle_set(docs[-2][1]))
        assert (0.8 <= common / both < 0.85) == (i % 2 == 1) and common / both < 0.85
        want += 2 - i % 2
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert P.drop_near_copies(spark, df, folder).count() == want


def test_near_dedup_stage_equals_brute_force_at_eight_tenths(spark, folder):
    docs = P.C.cut(P.keep_quality(spark, queries.table(spark, folder, "documents"), folder))
    numbered = sorted(rows(docs), key=lambda r: (r[0] is None, r[0] or 0))
    sets = [test_neardup.shingle_set(r[1]) for r in numbered]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    want = [r for i, r in enumerate(numbered) if not sets[i] or root[i] == i]
    assert sorted(map(str, rows(P.drop_near_copies(spark, docs, folder)))) == sorted(map(str, want))


def test_bpe_stage_decodes(spark, folder):
    """Each row says what its ids decode to, and that this is its text."""
    out = P.encode(spark, spark.createDataFrame(ODD, SCHEMA), folder).collect()
    sha = [hashlib.sha256((r[1] or "").encode()).hexdigest() for r in ODD]
    assert sorted(r.decoded_sha256 for r in out) == sorted(sha) and all(r.decoded_same for r in out)


def test_leaks_changed_at_both_ends_go(spark, tmp_path):
    """The decontaminate stage looks at every window, also where no end of an item is left."""
    ends, middle = [f"e{i:02d}" for i in range(40)], [f"{'middle' * 6}{i:02d}" for i in range(40)]
    item, leak = ends[:8] + middle + ends[8:16], ends[16:24] + middle + ends[24:32]
    docs = [(1, " ".join(ends[32:] * 9 + leak + ends[:8])), (2, " ".join(middle[:20] + leak[:8])), (3, None), (None, " ".join(leak))]
    assert test_decontaminate.brute(docs, [(5, " ".join(item))]).keys() == {(1, 5), (None, 5)}
    spark.createDataFrame([(5, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [r.doc_id for r in P.drop_leaks(spark, spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path)).orderBy("doc_id").collect()] == [2, 3]


def test_leaks_of_short_items_and_items_without_id_go(spark, tmp_path):
    """The decontaminate stage looks for every item, also of under five words or without an id, at every place."""
    long = " ".join(f"w{i}" for i in range(30))
    spark.createDataFrame([(5, "Four words of it"), (6, "alone"), (None, long)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(1, "here are four words of it and more"), (2, "it is ALONE"), (3, f"before {long} behind"), (4, "four words or it, not alone, stay"), (None, "alone"), (7, None)]
    assert [r.doc_id for r in P.drop_leaks(spark, spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path)).orderBy("doc_id").collect()] == [4, 7]
