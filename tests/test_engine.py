import sys

import pytest
from pyspark.sql import functions as F

from stepweave.functions.vectors import pearson, wrap32
from stepweave.operators import cluster, lineage
from stepweave.operators.engine import run, run_update
from stepweave.operators.graph import PropertyGraph
from stepweave.operators.pagerank import pagerank, with_titles
from stepweave.operators.program import ComputeStep, CrunchStep, Program
from stepweave.operators.runs import Runs
from stepweave.operators.stream import run_streamed
from stepweave.sources import readers, reports

WEB = [("A", "B"), ("C", "A"), ("D", "A"), ("D", "C")]
MATRIX = [("alpha", [9, 1, 0, 4]), ("beta", [8, 2, 1, 5]), ("gamma", [0, 7, 6, 1]), ("delta", [1, 8, 5, 0]), ("eps", [3, 3, 3, 3])]


def values(df):
    return {r[0]: r[1] for r in df.collect()}


def web(spark):
    return PropertyGraph.from_edges(spark.createDataFrame(WEB, "src string, dst string"))


@pytest.mark.parametrize(("init", "n", "want"), [
    (0.25, 1, (0.25, 0.25, 0.25, 0.25)), (0.25, 2, (0.35625, 0.25, 0.14375, 0.0375)), (0.25, 4, (0.098859375, 0.18678125, 0.0534375, 0.0375)),
    (0.25, 31, (0.098859375, 0.12153046875, 0.0534375, 0.0375)), (0.25, 32, (0.0375,) * 4), (0.0, 3, (0.0853125, 0.069375, 0.0534375, 0.0375)),
])
def test_sample_web(spark, init, n, want):
    got = values(pagerank(web(spark).validate(), n, init))
    assert [got[k] for k in ("A", "B", "C", "D")] == pytest.approx(want, abs=1e-12)


def test_standard_ranks_go_on_after_30(spark):
    assert values(pagerank(web(spark), 34, send_until=None))["B"] == pytest.approx(0.12153046875)


def chain(spark, n, steps):
    g = PropertyGraph.isolated(spark.range(n).select("id", F.lit(0.0).alias("value")))
    more, assign = ComputeStep(lambda v, *_: v + 1), ComputeStep(lambda v, _, c: F.lit(c.crunched))
    return set(values(run(g, Program(more).crunch(F.sum).then(assign), steps)).values())


def test_crunch_chain(spark):
    assert chain(spark, 48, 3) == {48.0} and chain(spark, 10, 3) == {10.0}
    assert chain(spark, 10, 2) == {1.0} and chain(spark, 48, 6) == {2352.0}


def test_mail_during_a_crunch(spark):
    """It goes to the crunch's update after the values were reduced, and no further; without an update it is dropped."""
    g = PropertyGraph.isolated(spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "id long, value double"))
    mail = spark.createDataFrame([(1, 2, 10.0), (3, 2, 5.0), (1, 9, 7.0)], "src long, dst long, value double")  # 9 is no vertex
    write, told = ComputeStep(send=lambda *_: mail), ComputeStep(lambda v, inbox, c: v + F.coalesce(inbox, F.lit(0.0)) + F.lit(c.crunched))
    take = lambda v, inbox, _: v + F.coalesce(inbox, F.lit(0.0))
    for how in ({"aggregate": F.sum}, {"fold": lambda a, b: a + b}):
        assert values(run(g, Program(write).crunch(**how, update=take).then(told), 3)) == {1: 7.0, 2: 23.0, 3: 9.0}
        assert values(run(g, Program(write).crunch(**how).then(told), 3)) == {1: 7.0, 2: 8.0, 3: 9.0}
    assert values(run(g, Program(write).crunch(F.sum, update=take, combine=F.max).then(told), 3))[2] == 18.0
    # the next crunch sees what mail made of the values: 6, then 21
    assert values(run(g, Program(write).crunch(F.sum, update=take).crunch(F.sum).then(told), 4)) == {1: 22.0, 2: 38.0, 3: 24.0}
    # a state of two columns
    both = PropertyGraph.isolated(g.vertices.withColumn("got", F.lit(False)))
    into = Program(write).crunch(F.sum, columns=lambda inbox, _: {"got": inbox.isNotNull()}).then(ComputeStep())
    assert {r.id: (r.value, r.got) for r in run(both, into, 3, columns=("value", "got")).collect()} == {1: (1.0, False), 2: (2.0, True), 3: (3.0, False)}
    assert run(PropertyGraph.isolated(g.vertices.limit(0)), Program(write).crunch(F.sum, update=take).then(told), 3).count() == 0


@pytest.mark.parametrize("streamed", [False, True])
def test_python_programs_with_crunches(spark, streamed):
    """What is sent in a crunch is dropped; its result is all that the next inbox holds, whatever combines mail, and for vertices without mail too."""
    g = PropertyGraph(spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "id long, value double"), spark.createDataFrame([(1, 2), (3, 2)], "src long, dst long"))
    seen = lambda s, v, inbox, near: (v * 1000 + sum(inbox) if s else v, [(x, 10.0) for x in near])
    for combine in (None, F.count):
        if streamed:
            got = run_streamed(g, lambda s, n, i, v, inbox, near, degree: seen(s, v, inbox, near), 4, combine, lambda s: CrunchStep(fold=max) if s == 1 else None)
        else:
            got = run_update(g, lambda s, n, i, v, inbox, near: seen(s, v, inbox, near), 4, combine, lambda s: CrunchStep(F.max) if s == 1 else None)
        mail = 20.0 if combine is None else 2.0
        assert values(got) == {1: (1000.0 * 1000 + 3) * 1000, 2: ((2000.0 + mail) * 1000 + 3) * 1000 + mail, 3: (3000.0 * 1000 + 3) * 1000}
    empty = PropertyGraph.isolated(g.vertices.limit(0))
    assert (run_streamed if streamed else run_update)(empty, None, 3, None, lambda s: CrunchStep(F.sum)).count() == 0


def test_control(spark):
    g = web(spark)
    for bad in (0, -1, None):
        with pytest.raises(ValueError):
            run(g, Program(ComputeStep()), bad)
    assert set(values(run(g, Program(ComputeStep(lambda v, *_: v + 1)), 0, lambda _, s: s == 3)).values()) == {3.0}
    with pytest.raises(ValueError):
        Program().then(ComputeStep())
    empty = PropertyGraph.isolated(spark.createDataFrame([], "id long, value double"))
    assert run(empty, Program(ComputeStep(lambda v, *_: v + 1)), 2).count() == 0
    twice = spark.createDataFrame([(1, 0.0), (1, 0.0)], "id long, value double")
    with pytest.raises(ValueError):
        PropertyGraph.isolated(twice).validate()


def test_python_updates_keep_repeated_vertices_and_combine_mail(spark):
    vertices = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, 5.0)], "id long, value double")
    g = PropertyGraph(vertices, spark.createDataFrame([(2, 1), (2, 1), (1, 2)], "src long, dst long"))
    update = lambda s, n, i, v, inbox, near: (v + sum(inbox), [(x, 1.0) for x in near])
    for combine in (None, F.sum):
        assert sorted(map(tuple, run_update(g, update, 2, combine).collect())) == [(1, 3.0), (1, 3.0), (2, 7.0)]


def test_folds_of_any_partitioning(spark):
    for parts in (1, 3, 30):
        g = PropertyGraph.isolated(spark.range(20).select("id", (F.col("id") * 1.0).alias("value")).repartition(parts))
        assert Program(ComputeStep()).crunch(fold=lambda a, b: a + b)[1].run(g.vertices) == 190.0
        assert Program(ComputeStep()).crunch(fold=max)[1].run(g.vertices.limit(0)) is None


def test_terminate_frees_tables(spark):
    df = lineage.cut(spark.range(3))
    assert df.count() == 3 and lineage.terminate(spark) >= 1 and lineage.terminate(spark) == 0
    with pytest.raises(Exception, match="(?i)path|file"):
        df.collect()


def test_numbered_lines_of_many_splits(spark, tmp_path):
    path = tmp_path / "many.txt"
    path.write_text("".join(f"line {i} {'x' * (i % 50)}\n" for i in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40k")
    try:
        rows = readers.numbered_lines(spark, str(path))
        assert rows.rdd.getNumPartitions() > 5
        assert all(r.text.startswith(f"line {r.line} ") for r in rows.collect()) and rows.count() == 20000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("combine", [None, F.sum])
def test_parallel_edges_and_equal_messages_are_no_long_lists(spark, combine):
    n = 300_000
    edges = spark.range(n).select(F.lit(0).cast("long").alias("src"), (F.col("id") % 3).alias("dst"))
    g = PropertyGraph(spark.range(3).withColumn("value", F.lit(0.0)), edges)

    def update(s, size, i, value, inbox, near):
        assert len(near) == (n if i == 0 else 0) and sys.getsizeof(near) < 1000
        assert sys.getsizeof(inbox) < 1000 and len(inbox) == (0 if s == 0 else 1 if combine else n // 3)
        return value + sum(inbox), ((x, 2.0) for x in near)

    assert {r.id: r.value for r in run_update(g, update, 2, combine).collect()} == {i: 2.0 * n / 3 for i in range(3)}
    near = Runs(["a", "b"], [2, 1])
    assert (list(near), near[1], near[-1], near[1:], near + ["c"], near.count("a"), bool(Runs(None, None))) == (["a", "a", "b"], "a", "b", ["a", "b"], ["a", "a", "b", "c"], 2, False)


def test_python_updates_drop_mail_to_no_vertex(spark):
    g = web(spark)
    got = values(run_update(g, lambda s, n, i, v, inbox, near: (v + sum(inbox), [(x, 1.0) for x in near] + [("nobody", 1.0)]), 2))
    assert got == {"A": 2.0, "B": 1.0, "C": 1.0, "D": 0.0}


@pytest.mark.parametrize(("a", "b", "want"), [([1, 2, 3, 4], [2, 4, 6, 8], 0.0), ([1, 2, 3, 4], [4, 3, 2, 1], 2.0), ([5, 5, 5, 5], [1, 2, 3, 4], 0.0), ([1, 0, 2, 7], [0, 3, 1, 1], 1.24913643956122)])
def test_pearson(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<int>, b array<int>")
    for arith in ("int64", "int32"):
        assert df.select(pearson(F.col("a"), F.col("b"), arith)).first()[0] == pytest.approx(want, abs=1e-12)
        assert cluster.distance(a, b, arith) == pytest.approx(want, abs=1e-12)
    assert spark.range(1).select(wrap32(F.lit(2**31))).first()[0] == -(2**31)


def test_overflow_wraps_alike(spark):
    a, b = [70000, 3, 5, 90000], [5, 80000, 60000, 1]
    got = spark.createDataFrame([(a, b)], "a array<int>, b array<int>").select(pearson(F.col("a"), F.col("b"), "int32")).first()[0]
    want = cluster.distance(a, b, "int32")
    assert got == pytest.approx(want, nan_ok=True)


@pytest.mark.parametrize(("mode", "orders", "lines"), [
    ("seq", [(0, 1), (3, 4), (-1, 2), (-3, -2)], [(0, "-"), (1, "-"), (2, "-"), (3, "eps"), (3, "delta"), (2, "gamma"), (1, "-"), (2, "beta"), (2, "alpha")]),
    ("bsp", [(0, 1), (3, 4), (2, -1), (-2, -3)], [(0, "-"), (1, "-"), (2, "beta"), (2, "alpha"), (1, "-"), (2, "gamma"), (2, "-"), (3, "eps"), (3, "delta")]),
])
def test_clustering(spark, tmp_path, mode, orders, lines):
    path = tmp_path / "counts.txt"
    path.write_text("Blog\ta\tb\tc\td\n" + "".join(f"{n}\t" + "\t".join(map(str, v)) + "\n" for n, v in MATRIX))
    rows, columns = readers.read_matrix(spark, str(path))
    names = {r.id: r.name for r in rows.collect()}
    assert names == {4: "alpha", 3: "beta", 2: "gamma", 1: "delta", 0: "eps"} and columns.count() == 4
    for merges in (cluster.hcluster(rows, mode), cluster.hcluster_distributed(rows, mode, cut_every=2)):
        got = sorted((tuple(r) for r in merges.collect()), reverse=True)
        assert [(m[1], m[2]) for m in got] == orders
        assert [m[3] for m in got] == pytest.approx([0.0, 0.008882991181, 0.064224559162, 1.838627869378], abs=1e-9)
        assert [list(m[4]) for m in got] == [[2, 5, 4, 1], [8, 1, 0, 4], [1, 6, 5, 1], [4, 3, 2, 2]]
        assert [(d, t) for _, d, t in cluster.dendrogram(got, names)] == lines
    assert readers.read_matrix(spark, str(path), 3)[0].count() == 2
    assert cluster.hcluster(rows.limit(1), mode).count() == 0 and cluster.hcluster(rows.limit(0), mode).count() == 0


def test_readers_and_reports(spark, tmp_path):
    path = tmp_path / "links.txt"
    path.write_text("A: B C C\nB: A\nD:\n")
    g = readers.read_adjacency(spark, str(path))
    assert sorted(tuple(r) for r in g.edges.collect()) == [("A", "B"), ("A", "C"), ("A", "C"), ("B", "A")]
    assert {r.id for r in g.vertices.collect()} == {"A", "B", "C", "D"} and {r.id for r in g.dangling().collect()} == {"C", "D"}
    assert readers.read_adjacency(spark, str(path), 1, 1).edges.count() == 1
    assert {r.line for r in reports.adjacency_lines(g).collect()} == {"A: B C C", "B: A", "C:", "D:"}
    path.write_text("A: B\n\n")
    with pytest.raises(Exception, match="blank"):
        readers.read_adjacency(spark, str(path)).vertices.collect()
    assert readers.read_adjacency(spark, str(path), mode="skip").edges.count() == 1
    path.write_text("t0\nt1\n")
    ranked = spark.createDataFrame([("0", 1.0), ("1", 2.0), ("7", 3.0)], "id string, value double")
    titled = with_titles(ranked, readers.read_titles(spark, str(path)))
    assert {r.title for r in titled.collect()} == {"t0", "t1", "no_title[7]"}
    assert "no_title[7] has rank 3.0" in {r.line for r in reports.rank_lines(titled).collect()}
    assert "7: 3.0" in {r.line for r in reports.value_lines(ranked).collect()}
    path.write_text("h\ta\tb\nx\t1\t\t3\n")
    lines = readers.numbered_lines(spark, str(path))
    assert readers.parse_matrix(lines, strict=False)[0].first().vec == [1]
    with pytest.raises(Exception, match="empty field"):
        readers.parse_matrix(lines)[0].collect()
    path.write_text("<link>http://x/</link>\nno\n")
    out = readers.prefixed(readers.numbered_lines(spark, str(path)), "<link>", 7)
    assert [r.text for r in out.collect()] == ["http://x/"]
    reports.write_lines(out, str(tmp_path / "out"))
    log, t = tmp_path / "log", reports.Timings("x")
    with pytest.raises(ValueError):
        t.lines()
    with t.timed("outer"), t.timed():
        pass
    t.append_to(str(log))
    t.append_to(str(log))
    assert len(log.read_text().splitlines()) == 4 and t.times[0][0] == "time0"


def test_pairs_of_many_rows(spark, monkeypatch):
    """pairwise_triangular makes no vector's sums for a pair and deals the pairs to many tasks; distances are those of pairs."""
    from stepweave.functions.vectors import rounded
    from stepweave.plans import registry

    plan = registry.QUERIES["pairwise_triangular"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan
    monkeypatch.setattr(cluster, "TASK_PAIRS", 200)
    rows = [(i, [(i * 7919 + c * c * 31) % 50 - 25 * (i % 3 == 0) for c in range(4)]) for i in range(-20, 40)] + [(90, [5, 5, 5, 5]), (91, [0, 0, 0, 0]), (92, [90000, 1, 7, 80000]), (92, [1, 2, 3, 4]), (None, [1, 2, 3, 5])]
    m = spark.createDataFrame(rows, "id int, vec array<int>")
    for arith in ("int64", "int32"):
        many = cluster.many_pairs(m, arith)
        assert sorted(map(str, many.collect())) == sorted(map(str, cluster.pairs(m, arith).collect())) and many.count() == 64 * 63 // 2 - 1
    assert many.rdd.getNumPartitions() > 5
    assert cluster.many_pairs(m.limit(0)).count() == 0
    monkeypatch.setattr(cluster, "WIDE", 3)
    assert sorted(map(str, cluster.many_pairs(m).collect())) == sorted(map(str, cluster.pairs(m).collect()))
    values = spark.createDataFrame([(x,) for x in (0.5, -0.5, 1.5, 2.5, -2.5, 0.125, -0.0327, float("nan"), 2.0, 0.0)], "x double")
    assert [str(r[0] + 0.0) for r in values.select(rounded(F.col("x"), 0)).collect()] == ["1.0", "-1.0", "2.0", "3.0", "-3.0", "0.0", "0.0", "nan", "2.0", "0.0"]
