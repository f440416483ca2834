"""Graphs and matrices on the test tables, as frames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.graph import PropertyGraph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line item with its customer and supplier.  Orders meet their customers first, so that line items, of which there are more, are moved once less."""
    t = lambda name: table(spark, sf_dir, name)
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    orders = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customers = t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    suppliers = t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return lines.join(orders.join(customers, "o_custkey"), "l_orderkey").join(suppliers, "l_suppkey")


SALES = "j AS (SELECT l_partkey, l_suppkey, o_custkey, c_nationkey, s_nationkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"


def trade(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    edges = sales(spark, sf_dir).select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst"))
    return PropertyGraph(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.lit(0.0).alias("value")), edges).kept()


TRADE = f"{SALES}, e AS (SELECT c_nationkey AS src, s_nationkey AS dst FROM j), v AS (SELECT n_nationkey AS id FROM nation)"


#: What the ids of a supply graph begin with, by their remainder modulo 3.
KINDS = ("P", "S", "C")


def _numbered(key: str, kind: str) -> Column:
    """A key and its kind as one number, since numbers are dealt, looked up and grouped for far less than texts; an error where 64 bits don't hold it."""
    k, most = F.col(key).cast("long"), (2**63 - 3) // 3
    return F.when(k.between(-most, most), k * 3 + KINDS.index(kind)).when(k.isNotNull(), F.raise_error(F.concat(F.lit(f"{key} is too large: "), k.cast("string"))).cast("long"))


def named(df: DataFrame) -> DataFrame:
    """df with the ids of a supply graph as the texts that they stand for."""
    kind = F.pmod("id", F.lit(3).cast("long"))
    key = F.call_function("div", F.col("id") - kind, F.lit(3).cast("long"))
    return df.withColumn("id", F.concat(F.element_at(F.array(*map(F.lit, KINDS)), (kind + 1).cast("int")), key.cast("string")))


def supply(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Parts to suppliers to customers to parts; ids are numbers, which named turns into texts."""
    j = sales(spark, sf_dir)
    p, s, c = (_numbered(x, k) for k, x in (("P", "l_partkey"), ("S", "l_suppkey"), ("C", "o_custkey")))
    made = F.array(F.when(F.col("l_partkey") % 10 != 0, F.struct(p.alias("src"), s.alias("dst"))), F.struct(s.alias("src"), c.alias("dst")), F.struct(c.alias("src"), p.alias("dst")))
    edges = j.select(F.explode(made).alias("e")).where("e is not null").select("e.src", "e.dst")
    return PropertyGraph.from_edges(edges)


SUPPLY = f"{SALES}, e AS (SELECT 'P' || l_partkey AS src, 'S' || l_suppkey AS dst FROM j WHERE l_partkey % 10 <> 0 UNION ALL SELECT 'S' || l_suppkey, 'C' || o_custkey FROM j UNION ALL SELECT 'C' || o_custkey, 'P' || l_partkey FROM j), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e)"
HREF = 'href="([^"]*)"'


def links(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    pages = table(spark, sf_dir, "pages").where("html is not null")
    edges = pages.select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("dst"))
    return PropertyGraph.from_edges(edges)


LINKS = f"e AS (SELECT 'page:' || page_id AS src, unnest(regexp_extract_all(html, '{HREF}', 1)) AS dst FROM pages), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e)"


def transitions(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst")).where("dst is not null")
    return PropertyGraph.from_edges(e)


TRANSITIONS = "e AS (SELECT * FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e)"


def matrix(cells: DataFrame) -> DataFrame:
    """(id, vec) of (row, col, n) counts; missing cells are 0, columns ascend."""
    columns = cells.select("col").distinct().agg(F.sort_array(F.collect_list("col")).alias("cols"))
    rows = cells.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", "n"))).alias("m"))
    return rows.crossJoin(F.broadcast(columns)).select(F.col("row").cast("int").alias("id"), F.transform("cols", lambda c: F.coalesce(F.col("m")[c], F.lit(0)).cast("int")).alias("vec"))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer nation by supplier nation."""
    return matrix(sales(spark, sf_dir).groupBy(F.col("c_nationkey").alias("row"), F.col("s_nationkey").alias("col")).agg(F.count(F.lit(1)).alias("n")))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User by event type."""
    return matrix(table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("row"), F.col("event_type").alias("col")).agg(F.count(F.lit(1)).alias("n")))


NATION_CELLS = f"{SALES}, got AS (SELECT c_nationkey AS r, s_nationkey AS c, count(*) AS n FROM j GROUP BY ALL)"
USER_CELLS = "got AS (SELECT user_id AS r, event_type AS c, count(*) AS n FROM events GROUP BY ALL)"
_CELLS = "cells AS (SELECT rs.r, cs.c, coalesce(got.n, 0)::BIGINT AS n FROM (SELECT DISTINCT r FROM got) rs CROSS JOIN (SELECT DISTINCT c FROM got) cs LEFT JOIN got ON got.r = rs.r AND got.c = cs.c)"


def pairs_sql(cells: str) -> str:
    """CTEs ending in p(i, j, d)."""
    return f"""{cells}, {_CELLS},
s AS (SELECT r, count(*)::BIGINT AS k, sum(n)::BIGINT AS sx, sum(n * n)::BIGINT AS sxx FROM cells GROUP BY r),
xy AS (SELECT a.r AS i, b.r AS j, sum(a.n * b.n)::BIGINT AS sxy FROM cells a JOIN cells b ON a.c = b.c AND a.r < b.r GROUP BY ALL),
q AS (SELECT i, j, (sxy - (a.sx * b.sx) // a.k)::DOUBLE AS num, sqrt(((a.sxx - (a.sx * a.sx) // a.k) * (b.sxx - (b.sx * b.sx) // a.k))::DOUBLE) AS den FROM xy JOIN s a ON a.r = i JOIN s b ON b.r = j),
p AS (SELECT i, j, CASE WHEN den = 0 THEN 0.0 ELSE 1 - num / den END AS d FROM q)"""


def queries_sql() -> str:
    """Distances of the rows of USER_CELLS whose id is divisible by 20 to all others."""
    return f"""WITH {pairs_sql(USER_CELLS)}, every AS (SELECT i, j, d FROM p UNION ALL SELECT j, i, d FROM p)
SELECT i::INTEGER AS i, j::INTEGER AS j, round(d, 10) AS d FROM every WHERE i % 20 = 0"""


def int32_sql(times: int) -> str:
    """Distances of NATION_CELLS, multiplied, in wrapping 32-bit arithmetic."""
    w = lambda x: f"((({x}) + 2147483648) & 4294967295) - 2147483648"
    return f"""WITH {NATION_CELLS}, {_CELLS.replace("coalesce(got.n, 0)::BIGINT", f"coalesce(got.n, 0)::BIGINT * {times}")},
s AS (SELECT r, count(*)::BIGINT AS k, {w("sum(n)::BIGINT")} AS sx, {w(f"sum({w('n * n')})::BIGINT")} AS sxx FROM cells GROUP BY r),
xy AS (SELECT a.r AS i, b.r AS j, sum({w("a.n * b.n")})::BIGINT AS sxy FROM cells a JOIN cells b ON a.c = b.c AND a.r < b.r GROUP BY ALL),
t AS (SELECT i, j, {w(f"sxy - trunc(({w('a.sx * b.sx')}) / a.k)::BIGINT")} AS num, {w(f"a.sxx - trunc(({w('a.sx * a.sx')}) / a.k)::BIGINT")} AS va, {w(f"b.sxx - trunc(({w('b.sx * b.sx')}) / a.k)::BIGINT")} AS vb FROM xy JOIN s a ON a.r = i JOIN s b ON b.r = j),
q AS (SELECT i, j, num, {w("va * vb")} AS under FROM t)
SELECT i, j, CASE WHEN under < 0 THEN -9.0 WHEN under = 0 THEN 0.0 ELSE round(1 - num::DOUBLE / sqrt(under::DOUBLE), 10) END AS d FROM q"""


def _merge_steps(mode: str) -> str:
    """CTEs ending in h: after k merges the live clusters, and what the last merge was."""
    sums = lambda x, y: f"list_sum(list_transform(list_zip({x}, {y}), lambda z: z[1]::BIGINT * z[2]))::BIGINT"
    left, right = ("CASE WHEN a.id < 0 THEN b.id ELSE a.id END", "CASE WHEN a.id < 0 THEN a.id ELSE b.id END") if mode == "bsp" else ("a.id", "b.id")
    return f"""{NATION_CELLS}, {_CELLS}, start AS (SELECT r AS id, list(n ORDER BY c) AS v FROM cells GROUP BY r),
h(k, live, left_id, right_id, distance, vec) AS (
SELECT 0, list({{'id': id::INTEGER, 'v': v}}), NULL::INTEGER, NULL::INTEGER, NULL::DOUBLE, NULL::BIGINT[] FROM start
UNION ALL
SELECT k + 1, list_append(list_filter(live, lambda x: x.id <> l AND x.id <> g), {{'id': (-k - 1)::INTEGER, 'v': m}}), l, g, d, m FROM (
SELECT k, live, best.l, best.g, best.d, list_transform(list_zip(best.lv, best.gv), lambda z: (z[1] + z[2]) // 2) AS m FROM (
SELECT k, live, arg_min({{'l': l, 'g': g, 'd': d, 'lv': lv, 'gv': gv}}, {{'d': d, 'l': l, 'g': g}}) AS best FROM (
SELECT k, live, l, g, lv, gv, CASE WHEN under = 0 THEN 0.0 ELSE 1 - num::DOUBLE / sqrt(under::DOUBLE) END AS d FROM (
SELECT k, live, l, g, lv, gv, {sums("lv", "gv")} - (list_sum(lv)::BIGINT * list_sum(gv)::BIGINT) // len(lv) AS num,
({sums("lv", "lv")} - (list_sum(lv)::BIGINT * list_sum(lv)::BIGINT) // len(lv)) * ({sums("gv", "gv")} - (list_sum(gv)::BIGINT * list_sum(gv)::BIGINT) // len(lv)) AS under FROM (
SELECT k, live, {left} AS l, {right} AS g, CASE WHEN {left} = a.id THEN a.v ELSE b.v END AS lv, CASE WHEN {left} = a.id THEN b.v ELSE a.v END AS gv FROM (
SELECT k, live, a, unnest(live) AS b FROM (SELECT k, live, unnest(live) AS a FROM h WHERE len(live) > 1)) WHERE a.id < b.id))) GROUP BY k, live)))"""


def hcluster_sql(mode: str) -> str:
    return f"WITH RECURSIVE {_merge_steps(mode)} SELECT (-k)::INTEGER AS merge_id, left_id, right_id, round(distance, 10) AS distance, array_to_string(vec, ' ') AS vec FROM h WHERE k > 0"


def dendrogram_sql(mode: str) -> str:
    return f"""WITH RECURSIVE {_merge_steps(mode)}, m AS (SELECT (-k)::INTEGER AS id, left_id, right_id FROM h WHERE k > 0),
tree(id, depth, path) AS (SELECT min(id), 0, '' FROM m UNION ALL
SELECT CASE WHEN side = 0 THEN left_id ELSE right_id END, depth + 1, path || side FROM tree JOIN m USING (id), (VALUES (0), (1)) s(side))
SELECT (row_number() OVER (ORDER BY path) - 1)::INTEGER AS line, depth::INTEGER AS depth, CASE WHEN id < 0 THEN '-' ELSE n_name END AS text FROM tree LEFT JOIN nation ON n_nationkey = id"""


def trace_sql() -> str:
    return f"""WITH RECURSIVE {_merge_steps("seq")} SELECT (k - 1)::INTEGER AS merge, line, CASE line WHEN 0 THEN printf('closest %d %d at %.6f', left_id, right_id, distance) WHEN 1 THEN 'new cluster ' || -k ELSE 'live ' || len(live) END AS text
FROM h, (VALUES (0), (1), (2)) t(line) WHERE k > 0"""


SCHEMA_TITLES = T.StructType([T.StructField("label", T.StringType()), T.StructField("title", T.StringType())])
