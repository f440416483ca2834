"""Queries over the test tables, one or more for each operator, and their SQL."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import rounded
from ..operators import cluster, lineage, nearest
from ..operators.chain import hcluster_program
from ..operators.engine import run, run_update
from ..operators.graph import PropertyGraph
from ..operators.pagerank import Shares, pagerank, top, with_titles
from ..operators.program import ComputeStep, CrunchStep, Program, Until
from ..operators.stream import run_streamed
from ..sources import readers, reports
from . import testgraphs as G

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
DIGITS = 10


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rank_sql(graph: str, updates: int, select: str = "SELECT id, round(val, 10) AS rank FROM r WHERE k = {u}", init: str = "0.0", sends: int = 30) -> str:
    """PageRank as a recursive query; after superstep sends - 1 no mail comes."""
    return f"""WITH RECURSIVE {graph}, deg AS (SELECT src, count(*) AS c FROM e GROUP BY src), m AS (SELECT src, dst, count(*) AS w FROM e GROUP BY ALL), r(k, id, val) AS (
SELECT 0, id, {init}::DOUBLE FROM v UNION ALL
SELECT k + 1, id, 0.15 / (SELECT count(*) FROM v) + 0.85 * sum(m) FROM (
SELECT r.k, m.dst AS id, CASE WHEN r.k < {sends} THEN r.val * m.w / deg.c ELSE 0 END AS m FROM r JOIN m ON m.src = r.id JOIN deg ON deg.src = r.id WHERE r.k < {updates}
UNION ALL SELECT r.k, r.id, 0.0 FROM r WHERE r.k < {updates}) GROUP BY k, id)
{select.format(u=updates)}"""


def ranks(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("value", DIGITS).alias("rank"))


# ---------------------------------------------------------------- graphs

@query(f"WITH {G.SUPPLY} SELECT id FROM v")
def graph_vertices_union(spark: SparkSession, d: str) -> DataFrame:
    return G.named(G.supply(spark, d).vertices.select("id"))


@query(f"WITH {G.TRADE} SELECT id, count(e.src) AS degree FROM v LEFT JOIN e ON e.src = id GROUP BY id")
def graph_out_degree(spark: SparkSession, d: str) -> DataFrame:
    return G.trade(spark, d).out_degree()


@query(f"WITH {G.TRANSITIONS} SELECT id, count(e.dst) AS degree FROM v LEFT JOIN e ON e.dst = id GROUP BY id")
def graph_in_degree_multi(spark: SparkSession, d: str) -> DataFrame:
    return G.transitions(spark, d).in_degree()


@query(f"WITH {G.LINKS} SELECT id FROM v WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src = v.id)")
def dangling_vertices(spark: SparkSession, d: str) -> DataFrame:
    return G.links(spark, d).dangling()


def _distinct_trade(spark: SparkSession, d: str) -> PropertyGraph:
    g = G.trade(spark, d)
    return PropertyGraph(g.vertices, g.edges.distinct())


_LINES = f"WITH {G.TRADE} SELECT id, id::VARCHAR || ':' || coalesce(' ' || string_agg(DISTINCT dst::VARCHAR, ' ' ORDER BY dst::VARCHAR), '') AS line FROM v LEFT JOIN e ON e.src = id GROUP BY id"


@query(_LINES)
def adjacency_lines(spark: SparkSession, d: str) -> DataFrame:
    return reports.adjacency_lines(_distinct_trade(spark, d))


@query(f"WITH {G.TRADE} SELECT DISTINCT src::VARCHAR AS src, dst::VARCHAR AS dst FROM e")
def adjacency_parse(spark: SparkSession, d: str) -> DataFrame:
    lines = reports.adjacency_lines(_distinct_trade(spark, d)).select(F.col("line").alias("text"))
    return readers.graph_of(readers.parse_adjacency(lines)).edges


@query(f"WITH {G.SUPPLY}, deg AS (SELECT src, count(*) AS c FROM e GROUP BY src) SELECT id, round(coalesce(sum(1.0 / deg.c), 0), 8) AS inbox FROM v LEFT JOIN e ON e.dst = id LEFT JOIN deg ON deg.src = e.src GROUP BY id")
def inbox_sum_one_superstep(spark: SparkSession, d: str) -> DataFrame:
    g = G.supply(spark, d)
    shares = Shares(g)
    start = PropertyGraph(g.vertices.select("id", F.lit(1.0).alias("value")), g.edges)
    program = Program(ComputeStep(send=lambda state, _: shares.mail(state))).then(ComputeStep(lambda value, inbox, _: F.coalesce(inbox, F.lit(0.0))))
    got = G.named(run(start, program, 2)).select("id", F.round("value", 8).alias("inbox"))
    shares.free()
    return got


@query("SELECT r_regionkey AS id, count(c_custkey) AS customers, round(coalesce(max(c_acctbal), 0), 2) AS most FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_regionkey")
def message_to_arbitrary_vertex(spark: SparkSession, d: str) -> DataFrame:
    """Customers write to their region, which no edge leads to: once how many they are, once their balance."""
    mail = G.table(spark, d, "customer").join(G.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("src"), F.col("n_regionkey").alias("dst"), F.col("c_acctbal").alias("value"))
    g = PropertyGraph.isolated(G.table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.lit(0.0).alias("value")))
    told = lambda combine: run(g, Program(ComputeStep(send=lambda *_: mail, combine=combine)).then(ComputeStep(lambda v, inbox, _: F.coalesce(inbox, F.lit(0)).cast("double"), combine=combine)), 2)
    return told(F.count).select("id", F.col("value").cast("long").alias("customers")).join(told(F.max).select("id", F.round("value", 2).alias("most")), "id")


# ---------------------------------------------------------------- ranking

@query(rank_sql(G.TRADE, 9))
def pagerank_trade(spark: SparkSession, d: str) -> DataFrame:
    return ranks(pagerank(G.trade(spark, d), 10))


@query(rank_sql(G.SUPPLY, 4))
def pagerank_parts(spark: SparkSession, d: str) -> DataFrame:
    return ranks(G.named(pagerank(G.supply(spark, d), 5)))


@query(rank_sql(G.LINKS, 9))
def pagerank_links(spark: SparkSession, d: str) -> DataFrame:
    return ranks(pagerank(G.links(spark, d), 10))


@query(rank_sql(G.TRANSITIONS, 9, init="0.25"))
def pagerank_init(spark: SparkSession, d: str) -> DataFrame:
    return ranks(pagerank(G.transitions(spark, d), 10, init=0.25))


@query(f"WITH {G.TRADE} SELECT id, 0.0::DOUBLE AS rank FROM v")
def pagerank_iter1(spark: SparkSession, d: str) -> DataFrame:
    return ranks(pagerank(G.trade(spark, d), 1))


@query(f"WITH {G.TRADE} SELECT id, round(0.15 / (SELECT count(*) FROM v), 10)::DOUBLE AS rank FROM v")
def pagerank_iter32(spark: SparkSession, d: str) -> DataFrame:
    return ranks(pagerank(G.trade(spark, d), 32))


_TITLED = "SELECT r.id, coalesce(t.title, 'no_title[' || r.id || ']') AS title, round(val, 10) AS value FROM r LEFT JOIN (SELECT n_nationkey AS id, n_name AS title FROM nation WHERE n_nationkey % 3 <> 0) t ON t.id = r.id WHERE k = {u} ORDER BY value DESC, r.id LIMIT 10"


@query(rank_sql(G.TRADE, 9, _TITLED))
def pagerank_topk_titles(spark: SparkSession, d: str) -> DataFrame:
    titles = G.table(spark, d, "nation").where("n_nationkey % 3 <> 0").select(F.col("n_nationkey").cast("string").alias("label"), F.col("n_name").alias("title"))
    return with_titles(top(pagerank(G.trade(spark, d), 10)), titles)


@query(rank_sql(G.TRADE, 4))
def udf_program_pagerank(spark: SparkSession, d: str) -> DataFrame:
    """PageRank as a plain Python vertex function."""
    def update(s, n, _, value, inbox, near):
        value = value if s == 0 else 0.15 / n + 0.85 * sum(inbox)
        part = value / max(1, len(near))
        return value, ((x, part, n) for x, n in near.runs())

    return ranks(run_update(G.trade(spark, d), update, 5))


@query(rank_sql(G.TRADE, 4))
def streamed_program_pagerank(spark: SparkSession, d: str) -> DataFrame:
    """As a Python vertex function over streams of mail and neighbours."""
    def update(s, n, _, value, inbox, near, degree):
        value = value if s == 0 else 0.15 / n + 0.85 * sum(inbox)
        return value, ((x, value / degree, n) for x, n in near.runs())

    return ranks(run_streamed(G.trade(spark, d), update, 5, F.sum))


# ---------------------------------------------------------------- crunches and control

def _nations(spark: SparkSession, d: str, value=None) -> PropertyGraph:
    return PropertyGraph.isolated(G.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), (F.lit(0.0) if value is None else value).alias("value")))


_MORE = ComputeStep(lambda v, _, c: v + 1)
_ASSIGN = ComputeStep(lambda v, _, c: F.lit(c.crunched).cast("double"))


def _balances(spark: SparkSession, d: str, **how) -> DataFrame:
    g = PropertyGraph.isolated(G.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.round(F.col("c_acctbal") * 100).cast("long").alias("value")))
    program = Program(ComputeStep()).crunch(**how).then(ComputeStep(lambda v, _, c: F.lit(c.crunched)))
    return run(g, program, 3).select("value").distinct().withColumnRenamed("value", "total")


@query("SELECT sum(round(c_acctbal * 100)::BIGINT)::BIGINT AS total FROM customer")
def crunch_sum(spark: SparkSession, d: str) -> DataFrame:
    return _balances(spark, d, aggregate=F.sum)


@query("SELECT max(round(c_acctbal * 100)::BIGINT)::BIGINT AS total FROM customer")
def crunch_max(spark: SparkSession, d: str) -> DataFrame:
    """With a function of two values instead of an aggregate."""
    return _balances(spark, d, fold=max)


@query("SELECT n_nationkey AS id, (SELECT count(*) FROM nation)::DOUBLE AS value FROM nation")
def crunch_broadcast_assign(spark: SparkSession, d: str) -> DataFrame:
    return run(_nations(spark, d), Program(_MORE).crunch(F.sum).then(_ASSIGN), 3)


@query("SELECT n_nationkey AS id, 1.0::DOUBLE AS value FROM nation")
def increment_program(spark: SparkSession, d: str) -> DataFrame:
    return run(_nations(spark, d), Program(_MORE), 1)


@query("SELECT n_nationkey AS id, (n * (n + 1) + 1)::DOUBLE AS value FROM nation, (SELECT count(*) AS n FROM nation)")
def cyclic_chain_7_steps(spark: SparkSession, d: str) -> DataFrame:
    return run(_nations(spark, d), Program(_MORE).crunch(F.sum).then(_ASSIGN), 7)


@query("""WITH t AS (SELECT n_nationkey AS id, count(c_custkey) AS mail FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey)
SELECT id, (id + mail + 100000 * (SELECT sum(id) FROM t))::DOUBLE AS value FROM t""")
def mail_during_crunch(spark: SparkSession, d: str) -> DataFrame:
    """Customers write to their nations just before a crunch: it adds up the values without that mail, and takes the mail into them."""
    mail = G.table(spark, d, "customer").select(F.col("c_custkey").alias("src"), F.col("c_nationkey").alias("dst"), F.lit(1).alias("value"))
    program = Program(ComputeStep(send=lambda *_: mail)).crunch(F.sum, update=lambda v, inbox, _: v + F.coalesce(inbox, F.lit(0)))
    return run(_nations(spark, d, F.col("n_nationkey").cast("double")), program.then(ComputeStep(lambda v, _, c: v + 100000 * F.lit(c.crunched))), 3)


_SHARE_SQL = f"""WITH {G.TRADE}, deg AS (SELECT v.id, count(src) AS c FROM v LEFT JOIN e ON src = v.id GROUP BY v.id), got AS (SELECT v.id, coalesce(sum(deg.c), 0) AS c FROM v LEFT JOIN e ON dst = v.id LEFT JOIN deg ON deg.id = src GROUP BY v.id)
SELECT got.id::VARCHAR AS id, round((deg.c + got.c) / (SELECT sum(c) FROM deg), 10) AS share FROM got JOIN deg ON deg.id = got.id"""


def _share(s, value, inbox, degree, near):
    """Degrees are sent, taken in while they are added up without that mail, and divided by their sum."""
    if s == 0:
        value = degree
    elif s == 1:
        value += sum(inbox)
    else:
        value /= next(iter(inbox))
    return float(value), ((x, float(degree), n) for x, n in near.runs())


@query(_SHARE_SQL)
def udf_program_crunch(spark: SparkSession, d: str) -> DataFrame:
    """As a plain Python vertex function, with a crunch of two values."""
    got = run_update(G.trade(spark, d), lambda s, n, _, v, inbox, near: _share(s, v, inbox, len(near), near), 3, crunch=lambda s: CrunchStep(fold=lambda a, b: a + b) if s == 1 else None)
    return got.select(F.col("id").cast("string").alias("id"), rounded(F.col("value"), DIGITS).alias("share"))


@query(_SHARE_SQL)
def streamed_program_crunch(spark: SparkSession, d: str) -> DataFrame:
    got = run_streamed(G.trade(spark, d), lambda s, n, _, v, inbox, near, degree: _share(s, v, inbox, degree, near), 3, F.sum, lambda s: CrunchStep(F.sum) if s == 1 else None)
    return got.select(F.col("id").cast("string").alias("id"), rounded(F.col("value"), DIGITS).alias("share"))


@query("SELECT n_nationkey AS id, ceil(100.0 / (SELECT count(*) FROM nation))::DOUBLE AS value FROM nation")
def iterate_until_total(spark: SparkSession, d: str) -> DataFrame:
    return run(_nations(spark, d), Program(_MORE), until=Until(F.sum, lambda total: total >= 100))


# ---------------------------------------------------------------- clustering

@query(f"WITH {G.pairs_sql(G.NATION_CELLS)} SELECT i, j, round(d, 10) AS d FROM p")
def pairwise_pearson(spark: SparkSession, d: str) -> DataFrame:
    return cluster.pairs(G.nations(spark, d)).select("i", "j", F.round("d", DIGITS).alias("d"))


@query(f"WITH {G.pairs_sql(G.USER_CELLS)} SELECT i::INTEGER AS i, j::INTEGER AS j, round(d, 10) AS d FROM p")
def pairwise_triangular(spark: SparkSession, d: str) -> DataFrame:
    return cluster.many_pairs(G.users(spark, d)).select("i", "j", rounded(F.col("d"), DIGITS).alias("d"))


@query(f"WITH {G.pairs_sql(G.NATION_CELLS)} SELECT i, j, round(d, 10) AS d FROM p ORDER BY p.d, i, j LIMIT 1")
def closest_pair(spark: SparkSession, d: str) -> DataFrame:
    return cluster.closest(cluster.pairs(G.nations(spark, d))).select("i", "j", F.round("d", DIGITS).alias("d"))


@query(f"WITH {G.pairs_sql(G.USER_CELLS)} SELECT i::INTEGER AS i, j::INTEGER AS j, round(d, 10) AS d FROM p ORDER BY p.d, i, j LIMIT 1")
def closest_pair_bounded(spark: SparkSession, d: str) -> DataFrame:
    """Without all pairs."""
    return nearest.closest_pair(G.users(spark, d)).select("i", "j", F.round("d", DIGITS).alias("d"))


@query(f"WITH {G.pairs_sql(G.NATION_CELLS)}, m AS (SELECT * FROM p ORDER BY d, i, j LIMIT 1) SELECT m.i AS left_id, m.j AS right_id, round(m.d, 10) AS distance, string_agg(((a.n + b.n) // 2)::VARCHAR, ' ' ORDER BY a.c) AS vec FROM m JOIN cells a ON a.r = m.i JOIN cells b ON b.r = m.j AND b.c = a.c GROUP BY ALL")
def first_merge_vector(spark: SparkSession, d: str) -> DataFrame:
    return cluster.first_merge(G.nations(spark, d)).select("left_id", "right_id", F.round("distance", DIGITS).alias("distance"), F.array_join(F.col("vec").cast("array<string>"), " ").alias("vec"))


def _merges(df: DataFrame) -> DataFrame:
    return df.select("merge_id", "left_id", "right_id", F.round("distance", DIGITS).alias("distance"), F.array_join(F.col("vec").cast("array<string>"), " ").alias("vec"))


@query(f"WITH {G.pairs_sql(G.NATION_CELLS)} SELECT i, j, round(d, 10) AS d FROM p UNION ALL SELECT j, i, round(d, 10) FROM p")
def pairwise_ordered(spark: SparkSession, d: str) -> DataFrame:
    return cluster.ordered_pairs(G.nations(spark, d)).select("i", "j", F.round("d", DIGITS).alias("d"))


@query(G.int32_sql(997))
def pairwise_pearson_int32(spark: SparkSession, d: str) -> DataFrame:
    """32-bit arithmetic on counts so large that it wraps; -9 where a wrapped product has no root."""
    large = G.nations(spark, d).withColumn("vec", F.transform("vec", lambda x: x * 997))
    return cluster.pairs(large, "int32").select("i", "j", F.when(F.isnan("d"), F.lit(-9.0)).otherwise(F.round("d", DIGITS)).alias("d"))


@query(G.hcluster_sql("seq"))
def hcluster_seq_merges(spark: SparkSession, d: str) -> DataFrame:
    return _merges(cluster.hcluster(G.nations(spark, d), "seq"))


@query(G.hcluster_sql("bsp"))
def hcluster_bsp_merges(spark: SparkSession, d: str) -> DataFrame:
    return _merges(cluster.hcluster(G.nations(spark, d), "bsp"))


@query(G.hcluster_sql("seq"))
def hcluster_distributed_seq(spark: SparkSession, d: str) -> DataFrame:
    return _merges(cluster.hcluster_distributed(G.nations(spark, d), "seq"))


@query(G.hcluster_sql("bsp"))
def hcluster_distributed_bsp(spark: SparkSession, d: str) -> DataFrame:
    return _merges(cluster.hcluster_distributed(G.nations(spark, d), "bsp"))


@query(G.hcluster_sql("bsp"))
def hcluster_bsp_program(spark: SparkSession, d: str) -> DataFrame:
    """As a vertex program of four links."""
    return _merges(hcluster_program(G.nations(spark, d)))


@query(G.queries_sql())
def pairwise_queries(spark: SparkSession, d: str) -> DataFrame:
    """The users whose id is divisible by 20 against all other ones."""
    found = cluster.many_pairs(G.users(spark, d), queries=F.col("id") % 20 == 0)
    return found.select("i", "j", rounded(F.col("d"), DIGITS).alias("d"))


@query(G.dendrogram_sql("seq"))
def dendrogram_lines(spark: SparkSession, d: str) -> DataFrame:
    return _dendrogram(spark, d, "seq")


@query(G.dendrogram_sql("bsp"))
def dendrogram_lines_bsp(spark: SparkSession, d: str) -> DataFrame:
    return _dendrogram(spark, d, "bsp")


def _dendrogram(spark: SparkSession, d: str, mode: str) -> DataFrame:
    names = G.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return cluster.dendrogram_lines(cluster.hcluster_distributed(G.nations(spark, d), mode), names)


@query(G.trace_sql())
def cluster_trace(spark: SparkSession, d: str) -> DataFrame:
    """What the clustering says of each merge when it is traced."""
    m = G.nations(spark, d)
    return cluster.trace_lines(cluster.hcluster_distributed(m), m.count())


# ---------------------------------------------------------------- text

@query(r"SELECT doc_id, i AS line, parts[i + 1] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS parts, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) WHERE i >= 1 AND i < 4")
def line_slice_drop_take(spark: SparkSession, d: str) -> DataFrame:
    lines = G.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return readers.line_range(lines.withColumn("line", F.col("line").cast("long")), 1, 3)


@query("SELECT substr(url, 9, length(url) - 8 - 2) AS text FROM pages WHERE url LIKE 'https://%'")
def prefix_filter_substring(spark: SparkSession, d: str) -> DataFrame:
    return readers.prefixed(G.table(spark, d, "pages").select(F.col("url").alias("text")), "https://", 2)


@query(f"WITH {G.NATION_CELLS}, {G._CELLS} SELECT r AS id, 'n' || r AS name, string_agg(n::VARCHAR, ' ' ORDER BY c) AS vec FROM cells GROUP BY r")
def matrix_parse(spark: SparkSession, d: str) -> DataFrame:
    """The nations' matrix written as tab separated text, and read again."""
    m = G.nations(spark, d)
    head = spark.createDataFrame([(0, "name\t" + "\t".join(f"c{i}" for i in range(25)))], "line long, text string")
    body = m.select((F.col("id") + 1).cast("long").alias("line"), F.concat(F.lit("n"), F.col("id").cast("string"), F.lit("\t"), F.array_join(F.col("vec").cast("array<string>"), "\t")).alias("text"))
    rows, _ = readers.parse_matrix(head.union(body), reverse=False)
    return rows.select("id", "name", F.array_join(F.col("vec").cast("array<string>"), " ").alias("vec"))


# ---------------------------------------------------------------- files and reports

def _file(spark: SparkSession, lines: DataFrame) -> str:
    """A text file of (line, text), in a new folder beside the tables."""
    path = lineage.folder(spark)
    reports.write_lines(lines.repartition(1).sortWithinPartitions("line").select("text"), path)
    return path


def _matrix_file(spark: SparkSession, d: str, empty: bool = False) -> str:
    m = G.nations(spark, d)
    fields = F.transform("vec", lambda x, i: F.when(F.lit(empty) & (F.col("id") % 5 == 0) & (i == 3), F.lit("")).otherwise(x.cast("string")))
    body = m.select((F.col("id") + 1).alias("line"), F.concat(F.lit("n"), F.col("id").cast("string"), F.lit("\t"), F.array_join(fields, "\t")).alias("text"))
    head = m.limit(1).select(F.lit(0).alias("line"), F.concat(F.lit("name\t"), F.array_join(F.transform("vec", lambda _, i: F.concat(F.lit("c"), i.cast("string"))), "\t")).alias("text"))
    return _file(spark, head.union(body))


_ROWS = f"WITH {G.NATION_CELLS}, {G._CELLS}, cols AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS pos FROM (SELECT DISTINCT c FROM cells)), lines AS (SELECT r, row_number() OVER (ORDER BY r) AS line, count(*) OVER () AS many FROM (SELECT DISTINCT r FROM cells))"


def _read(rows: DataFrame) -> DataFrame:
    return rows.select("id", "name", F.array_join(F.col("vec").cast("array<string>"), " ").alias("vec"))


@query(f"{_ROWS} SELECT (many - line)::INTEGER AS id, 'n' || r AS name, string_agg(n::VARCHAR, ' ' ORDER BY c) AS vec FROM cells JOIN lines USING (r) GROUP BY ALL")
def matrix_file_reversed(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a file count from its last line."""
    return _read(readers.read_matrix(spark, _matrix_file(spark, d))[0])


@query(f"{_ROWS} SELECT (10 - line)::INTEGER AS id, 'n' || r AS name, string_agg(n::VARCHAR, ' ' ORDER BY c) AS vec FROM cells JOIN lines USING (r) WHERE line <= 10 GROUP BY ALL")
def matrix_file_first_lines(spark: SparkSession, d: str) -> DataFrame:
    """Eleven lines with the header, so ten rows: the limit is what the reader offers."""
    return _read(readers.read_matrix(spark, _matrix_file(spark, d), 11)[0])


@query(f"{_ROWS} SELECT (many - line)::INTEGER AS id, 'n' || r AS name, coalesce(string_agg(n::VARCHAR, ' ' ORDER BY c) FILTER (WHERE r % 5 <> 0 OR pos < 3), '') AS vec FROM cells JOIN lines USING (r) JOIN cols USING (c) GROUP BY ALL")
def matrix_file_empty_fields(spark: SparkSession, d: str) -> DataFrame:
    """An empty field ends its row."""
    return _read(readers.read_matrix(spark, _matrix_file(spark, d, empty=True), strict=False)[0])


@query(f"{_ROWS} SELECT (many - line)::INTEGER AS id, 'n' || r AS name FROM lines ORDER BY id LIMIT 10")
def matrix_sample_names(spark: SparkSession, d: str) -> DataFrame:
    """The first ten names, for a look at what was read."""
    return readers.first_names(readers.read_matrix(spark, _matrix_file(spark, d))[0])


def _link_file(spark: SparkSession, d: str, blank: bool = False) -> str:
    lines = reports.adjacency_lines(G.trade(spark, d)).select((F.col("id") * 2).alias("line"), F.col("line").alias("text"))
    return _file(spark, lines.union(lines.select(F.col("line") + 1, F.lit("  "))) if blank else lines)


_RANGE = f"""{G.SALES}, every AS (SELECT c_nationkey AS s, s_nationkey AS t FROM j), e AS (SELECT s::VARCHAR AS src, t::VARCHAR AS dst FROM every WHERE s >= 5 AND s < 20),
v AS (SELECT n_nationkey::VARCHAR AS id FROM nation WHERE n_nationkey >= 5 AND n_nationkey < 20 UNION SELECT dst FROM e)"""


@query(f"WITH {_RANGE} SELECT src, dst, count(*) AS n FROM e GROUP BY ALL")
def link_file_range(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the lines 5 to 19 of a link file: the range is what the reader offers."""
    return readers.read_adjacency(spark, _link_file(spark, d), 5, 15).edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {G.TRADE} SELECT src::VARCHAR AS src, dst::VARCHAR AS dst, count(*) AS n FROM e GROUP BY ALL")
def link_file_skip_blank_lines(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_adjacency(spark, _link_file(spark, d, blank=True), mode="skip").edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT (2 * n_nationkey + 1)::BIGINT AS line, 'blank line' AS reason, count(*) OVER () AS rejected FROM nation")
def link_file_rejected_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of a link file that are left out, and why."""
    _, rejected, many = readers.sorted_out(readers.numbered_lines(spark, _link_file(spark, d, blank=True)), colon=True)
    return rejected.select("line", "reason", F.lit(many).cast("long").alias("rejected"))


@query(f"WITH {_RANGE} SELECT src, dst, count(*) AS n FROM e GROUP BY ALL")
def link_file_indexed_range(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the lines 5 to 19 by an index of lines: the range is what the reader offers."""
    index = readers.LineIndex(spark, _link_file(spark, d), 4)
    return readers.read_adjacency(spark, index, 5, 15).edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def _title_file(spark: SparkSession, d: str) -> str:
    return _file(spark, G.table(spark, d, "nation").select(F.col("n_nationkey").alias("line"), F.col("n_name").alias("text")))


@query("SELECT n_nationkey::VARCHAR AS label, n_name AS title FROM nation WHERE n_nationkey < 18")
def title_file(spark: SparkSession, d: str) -> DataFrame:
    """The first lines of a title file: the limit is what the reader offers."""
    return readers.read_titles(spark, _title_file(spark, d), 18)


_REPORT = "SELECT coalesce(t.title, 'no_title[' || r.id || ']') || ' has rank ' || round(val, 8)::VARCHAR AS line FROM r LEFT JOIN (SELECT n_nationkey::VARCHAR AS id, n_name AS title FROM nation WHERE n_nationkey < 18) t ON t.id = r.id WHERE k = {u} ORDER BY round(val, 8) DESC, r.id LIMIT 10"


@query(rank_sql(_RANGE, 9, _REPORT))
def rank_report_from_files(spark: SparkSession, d: str) -> DataFrame:
    """From link file lines and title file lines to the report of the ten largest ranks."""
    graph = readers.read_adjacency(spark, _link_file(spark, d), 5, 15)
    best = top(pagerank(graph, 10), 10, 8)
    return reports.rank_lines(with_titles(best, readers.read_titles(spark, _title_file(spark, d), 18)))


@query("SELECT phase || n_nationkey || ': ' || v AS line FROM nation, (VALUES ('before ', '0.0'), ('after ', '3.0')) t(phase, v)")
def value_dump(spark: SparkSession, d: str) -> DataFrame:
    """All values before and after a run, written as text and read again."""
    start = _nations(spark, d)
    said = lambda phase, state: reports.value_lines(state).select(F.concat(F.lit(phase), "line").alias("line"))
    path = lineage.folder(spark)
    reports.write_lines(said("before ", start.vertices).union(said("after ", run(start, Program(_MORE), 3))), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("SELECT * FROM (VALUES (0, 'Timings for run'), (1, 'description:' || chr(9) || 'count' || chr(9) || 'time0' || chr(9) || 'all'), (2, 'times(ms):' || chr(9) || '#' || chr(9) || '#' || chr(9) || '#'), (3, 'times(ms):' || chr(9) || '#' || chr(9) || '#' || chr(9) || '#')) t(line, text)")
def timing_log(spark: SparkSession, d: str) -> DataFrame:
    """Nested timings, appended twice to a log of the driver's: its head comes once.  Times are shown as #."""
    t = reports.Timings()
    with tempfile.TemporaryDirectory() as at:
        t.tic()
        with t.timed("count"):
            G.table(spark, d, "nation").count()
        t.tic()
        t.toc()
        t.toc("all")
        for _ in range(2):
            t.append_to(f"{at}/log")
        with open(f"{at}/log", encoding="utf-8") as f:
            lines = [re.sub(r"\t[0-9]+", "\t#", x.rstrip("\n")) for x in f]
    return spark.createDataFrame(list(enumerate(lines)), "line int, text string")


# ---------------------------------------------------------------- leaders and bounds

@query("SELECT n_nationkey AS id, (min(n_nationkey) OVER () + 7)::DOUBLE AS value FROM nation")
def leader_message(spark: SparkSession, d: str) -> DataFrame:
    """The vertex of the least id alone writes, to all vertices: its id and 7."""
    g = _nations(spark, d)

    def send(state: DataFrame, _) -> DataFrame:
        return state.select(F.col("id").alias("dst")).join(F.broadcast(g.leader(state).select(F.col("id").alias("src"), (F.col("id") + 7.0).alias("value"))), how="cross").select("src", "dst", "value")  # one row

    return run(g, Program(ComputeStep(send=send)).then(ComputeStep(lambda v, inbox, _: F.coalesce(inbox, v))), 2)


@query("SELECT n_nationkey AS id, 4.0::DOUBLE AS value FROM nation")
def iterate_without_bound(spark: SparkSession, d: str) -> DataFrame:
    """0 iterations are no bound; the condition ends the run after four supersteps."""
    return run(_nations(spark, d), Program(_MORE), 0, lambda _, done: done == 4)
