import random

from pyspark.sql import functions as F

from stepweave.llm import decontaminate, queries

SF = "/root/testdata/sf0.001"


def shingles(w):
    return {tuple(w[i : i + 5]): sum(map(len, w[i : i + 5])) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w): sum(map(len, w))} if w else {})


def brute(docs, items):
    out = {}
    for d, t in docs:
        w = (t or "").lower().split()
        for i, s in items:
            v = (s or "").lower().split()
            b = shingles(v)
            for start in range(-len(v) + 1, len(w)) if b and not b.keys().isdisjoint(shingles(w)) else ():
                a = shingles(w[max(start, 0) : max(start, 0) + len(v) + min(start, 0)])
                common = sum(x for k, x in a.items() if k in b)
                total = sum(a.values()) + sum(b.values()) - common
                if common and 100 * common >= 80 * total:
                    out[d, i] = max(out.get((d, i), 0), round(common / total, 6))
    return out


def got(df):
    return {(r.doc_id, r.item_id): round(r.common / r.total, 6) for r in df.collect()}


def test_query_equals_brute_force(spark):
    items = [(r.item_id, r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    want = brute([(r.doc_id, r.text) for r in queries.documents(spark, SF).collect()], items)
    assert want and {(r.doc_id, r.item_id): r.similarity for r in queries.op8_decontaminate(spark, SF).collect()} == want


def test_edited_passages(spark):
    random.seed(4)
    vocabulary = [f"w{i}" * (1 + i % 3) for i in range(300)]
    items = [(i, " ".join(random.choices(vocabulary, k=random.randint(12, 50)))) for i in range(25)] + [(90, "one two"), (91, None), (92, "")]
    docs = []
    for d in range(150):
        w = random.choice(items[:25])[1].split()
        for _ in range(random.randint(0, 2)):
            k = random.randrange(len(w))
            w[k : k + random.randint(0, 1)] = random.choice([[], ["new"]])
        docs.append((d, " ".join(random.choices(vocabulary, k=random.randint(0, 60)) + w + random.choices(vocabulary, k=random.randint(0, 60)))))
    docs += [(500, None), (501, ""), (502, "One  TWO"), (502, "One  TWO"), (503, "one two three"), (504, "a " * 30000), (None, items[0][1])]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found, want = got(decontaminate.find_leaks(a, b)), brute(docs, items)
    assert found.keys() <= want.keys()
    assert len(found) >= 0.98 * len(want) and len(want) > 60
    assert (None, 0) in found and (502, 90) in found and all(found[k] <= want[k] for k in found)
    assert decontaminate.find_leaks(a.limit(0), b).count() == 0 and decontaminate.find_leaks(a, b.limit(0)).count() == 0


def test_halves_of_an_item_in_the_other_order(spark):
    """Their offsets are further apart than the item is long, and the best window lies between."""
    words = [f"w{i:03d}" for i in range(60)]
    docs, items = [(1, " ".join([*words[30:], "x000", *words[:30]]))], [(7, " ".join(words))]
    want = brute(docs, items)
    assert want == {(1, 7): round(51 / 61, 6)}
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert got(found) == want


def test_fingerprints_are_votes_of_the_words_hashes(spark):
    random.seed(1)
    rows = [(i, [random.getrandbits(64) - 2**63 for _ in range(25)], 0) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, h array<long>, at int").withColumn("left", F.size("h"))
    for r in decontaminate._fingerprints(df, [23, 9, 5], "id").collect():
        for size in (5, 9, 23):
            votes = [sum(x >> j & 1 for x in rows[r.id][1][:size]) for j in range(64)]
            assert r[f"fp{size}"] % 2**64 == sum(1 << j for j, v in enumerate(votes) if 2 * v > size)


def test_recall_on_items_of_all_lengths(spark):
    """Copies with words left out, put in or exchanged at any place: nine in ten of brute force at least, and nothing else."""
    random.seed(11)
    vocabulary = [f"w{i}" * (1 + i % 3) for i in range(400)]
    items = [(i, " ".join(random.choices(vocabulary, k=5 + i))) for i in range(75)]
    docs = []
    for d in range(400):
        w = items[d % 75][1].split()
        for _ in range(random.randint(0, 2)):
            k = random.choice([0, 1, len(w) - 2, len(w) - 1, random.randrange(len(w))])
            w[k : k + random.randint(0, 1)] = random.choice([[], ["new"], ["other"]])
        docs.append((d, " ".join(random.choices(vocabulary, k=random.randint(0, 900)) + w + random.choices(vocabulary, k=random.randint(0, 60)))))
    a = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], "doc_id long, text string, item_id int, h string, start int")  # names that the operator uses
    b = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    found, want = got(decontaminate.find_leaks(a, b)), brute(docs, items)
    print("recall", len(found), "of", len(want))
    assert found.keys() <= want.keys() and len(want) > 200 and len(found) >= 0.9 * len(want)
    assert sum(found[k] == want[k] for k in found) >= 0.99 * len(found)


def test_without_blocks_nothing_is_found(spark, monkeypatch):
    """The fingerprints' blocks are the only way to an item of SIZE words or more."""
    monkeypatch.setattr(decontaminate, "_blocks", lambda size: F.array().cast("array<struct<key: long, fp: long>>"))
    text = " ".join(f"w{i}" for i in range(30))
    a, b = spark.createDataFrame([(1, text), (2, "one two")], "doc_id long, text string"), spark.createDataFrame([(5, text), (6, "one two")], "item_id long, text string")
    assert got(decontaminate.find_leaks(a, b)).keys() == {(2, 6)}


def test_every_window_that_is_similar_enough(spark):
    """Weights let items be changed at both ends, in several places at once, or down to one long shingle; results are brute force's."""
    random.seed(5)
    long, short, huge = [f"{'long' * 9}{i:03d}" for i in range(200)], [f"s{i:03d}" for i in range(300)], [f"{'huge' * 300}{i:03d}" for i in range(9)]
    items = [(1, short[:8] + long[:40] + short[8:16]), (2, short[20:30] + huge[:1] + short[30:40]), (3, [huge[1 + i // 12] if i % 12 == 6 else short[50 + i] for i in range(60)])]
    items += [(4, (long[90:95] + short[120:126]) * 4), (5, ["again"] * 12)]
    docs = [(1, short[140:148] + long[:40] + short[148:156]), (2, short[160:166] + items[1][1][6:15] + short[166:172]), (3, [f"x{i}" if i % 12 == 0 or i == 59 else w for i, w in enumerate(items[2][1])])]
    docs += [(4, (short[180:189] + items[3][1][:22]) * 2), (5, short[190:193] + ["again"] * 40)]
    for d in range(10, 90):  # words exchanged among the short ones anywhere, the item anywhere
        w = [random.choice(short) if x in short and random.random() < 0.4 else x for x in random.choice(items)[1]]
        k = random.randrange(len(w))
        w = random.choice([w, w[k:] + w[:k], w[:k] + ["new"] + w[k:]])
        docs.append((d, random.choices(short, k=random.randint(0, 900)) + w + random.choices(short, k=random.randint(0, 30))))
    docs, items = [(d, " ".join(w)) for d, w in docs], [(i, " ".join(w)) for i, w in items]
    want = brute(docs, items)
    assert {(d, d) for d in (1, 2, 3, 5)} <= want.keys() and len(want) > 20
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert got(found) == want


def test_items_without_id_and_texts_that_share_one(spark):
    """Each text of the benchmark is looked for by itself, in windows of its own length."""
    w = [f"w{i:03d}" for i in range(60)]
    items = [(None, " ".join(w[10:40])), (None, "no id"), (9, " ".join(w[:20])), (9, " ".join(w[25:55])), (5, " ".join([*w[:10], "p", "q", "r", *w[10:20]])), (5, " ".join(["o", *w[:10], *w[10:20]]))]
    docs = [(1, " ".join(w)), (2, " ".join([*w[30:], *w[:30]])), (3, " ".join(w[:15])), (4, "no id"), (None, " ".join(w[5:42])), (6, " ".join(["o", *w[:10], "p", "q", *w[10:16]]))]
    want = brute(docs, items)
    assert {(1, None), (4, None), (None, None), (1, 9), (1, 5)} <= want.keys()
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert got(found) == want


def test_short_items_in_any_window(spark):
    """Items of one to four words at all places of longer documents, also where the pieces of a document meet."""
    random.seed(6)
    items = [(1, "alone"), (2, "One  two"), (3, "a b c"), (4, "same same"), (5, "d e f g"), (6, "d e f g h"), (7, "same"), (8, None), (9, ""), (None, "no id")]
    docs = [(1, "alone"), (2, "one two"), (3, "zero one TWO"), (4, "one and two"), (5, "alone d e f g"), (6, "d e f g h"), (7, "same " * 2000), (8, "e f g"), (9, None), (10, ""), (11, "  "), (None, "x no id y")]
    for d in range(20, 60):
        filler, w = [f"x{i}" for i in range(2400)], random.choice(items[:6])[1].split()
        k = random.choice([0, decontaminate.PIECE * random.randint(1, 3) - random.randint(0, 5), random.randrange(2400), 2400])
        docs.append((d, " ".join([*filler[:k], *w, *filler[k:]])))
    want = set()
    for d, t in docs:
        w = (t or "").lower().split()
        for i, s in items:
            v = (s or "").lower().split()
            if v and any(w[k : k + len(v)] == v for k in range(len(w))):
                want.add((d, i))
    assert len(want) > 50
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = got(decontaminate.find_leaks(a, b, short_within=True))
    assert found.keys() == want and set(found.values()) == {1}
