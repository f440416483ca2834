"""Near-duplicates against brute force."""

from __future__ import annotations

import itertools
import random
import re

import pytest

from stepweave.llm import neardup, queries


def shingle_set(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, percent=85):
    sets, parent = {i: shingle_set(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def result(spark, rows):
    found = neardup.link(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found}


def copies(seed):
    """Groups of copies of a text, each with changes of its own, at about the least similarity of a link."""
    rng = random.Random(seed)
    rows = []
    for group in range(4):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(80, 260))]
        for _ in range(40):
            text = base.copy()
            for _ in range(rng.randrange(5)):
                text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(text))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = copies(seed)
    assert result(spark, rows) == brute(rows)


def test_rest_pairs_lose_no_link(spark):
    rows = copies(3)
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    sketched = neardup.sketch(texts).collect()
    at = {}
    for r in sketched:
        at.setdefault(r.set, r.doc_id)
    candidates = spark.createDataFrame(list(at.items()), "set long, at long")
    sets = neardup.shingle_sets(texts, candidates)
    alone = candidates.selectExpr("set", "set as component")
    got = {(min(r), max(r)) for r in map(tuple, neardup.rest_pairs(alone, sets, 85).collect())}
    full = {s: shingle_set(rows[i][1]) for s, i in at.items()}
    links = {(min(a, b), max(a, b)) for a, b in itertools.combinations(full, 2) if 100 * len(full[a] & full[b]) >= 85 * len(full[a] | full[b])}
    assert links and links <= got


def test_edges_of_the_input(spark):
    long = " ".join(f"word{i}" for i in range(50_000))
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "A b c"), (4, "a  B\tc"), (5, long), (6, long + " more"), (7, long), (8, "a b d")]
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == {}


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in queries.documents(spark, "/root/testdata/sf0.001").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op5_near_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert got == brute(rows) and sum(not kept for _, _, kept in got.values()) > 0


def test_odd_rows_and_columns_of_other_names(spark):
    """Null ids and texts, repeated rows, a long text, and columns that the operator uses itself."""
    text, long = " ".join(f"w{i}" for i in range(50)), " ".join(f"v{i}" for i in range(60000)) + " "
    rows = [(None, text), (7, text), (7, text), (9, text + " more"), (3, None), (4, ""), (5, None), (6, "two words"), (8, "TWO  words"), (10, long), (11, long + "end"), (None, "lone row of no id")]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, set int, component int, node string")
    got = sorted(((r.doc_id or -1, r.n_shingles, -1 if r.component_id is None else r.component_id, r.kept) for r in neardup.link(df).collect()))
    assert [g for g in got if g[0] in (7, 9)] == [(7, 46, 7, True), (7, 46, 7, True), (9, 47, 7, False)]
    assert [g for g in got if g[0] in (3, 4, 5)] == [(3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True)]
    assert [g[2:] for g in got if g[0] in (6, 8)] == [(6, True), (6, False)] and [g[2] for g in got if g[0] in (10, 11)] == [10, 10]
    assert [g[2] for g in got if g[0] == -1] == [-1, 7] and neardup.link(df.limit(0)).count() == 0


def test_components_of_paths_stars_and_rings(spark):
    rng = random.Random(6)
    edges, want = [], {}
    for base, shape in ((0, [(i, i + 1) for i in range(150)]), (1000, [(1, i) for i in range(2, 90)]), (2000, [(i, (i + 1) % 40) for i in range(40)]), (3000, [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]), (4000, [(5, 5), (7, 5), (5, 7)])):
        names = list(range(base, base + 200))
        rng.shuffle(names)
        edges += [(names[a], names[b]) for a, b in shape]
    for a, b in edges:
        if a != b:
            want.setdefault(a, a), want.setdefault(b, b)
            x, y = sorted((want[a], want[b]))
            want = {k: x if v == y else v for k, v in want.items()}
    got = neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0
