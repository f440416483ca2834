"""Readers of adjacency text, title lists, count matrices and prefixed lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import lineage
from ..operators.graph import PropertyGraph


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, text), lines from 0 in the order of one file; two passes, the first counts the lines of partitions."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("m"), F.col("value").alias("text")).select(F.shiftright("m", 33).alias("part"), F.col("m").bitwiseAND(F.lit((1 << 33) - 1)).alias("row"), "text")
    counts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each partition
    return rows.join(F.broadcast(before), "part").select((F.col("before") + F.col("row")).alias("line"), "text")


def line_range(lines: DataFrame, skip: int = 0, take: int | None = None) -> DataFrame:
    """Lines skip, skip + 1, ..., take of them."""
    kept = lines.where(F.col("line") >= skip)
    return kept if take is None else kept.where(F.col("line") < skip + take)


class LineIndex:
    """The lines of a text file with their numbers, kept as a table in line order, so that a range reads its own parts of it alone.

    The file is read twice, once to count the lines of its splits; nothing is
    shuffled.  The table's blocks have about `rows` lines and know their first
    and last one, by which a range's filter leaves the others out.  free() when
    it is not needed any more.
    """

    def __init__(self, spark: SparkSession, path: str, rows: int = 100_000):
        at = lineage.folder(spark)
        numbered_lines(spark, path).write.option("maxRecordsPerFile", rows).parquet(at)
        self.lines = spark.read.schema("line long, text string").parquet(at)
        self.lines._table = at

    def range(self, skip: int = 0, take: int | None = None) -> DataFrame:
        return line_range(self.lines, skip, take)

    def free(self) -> None:
        lineage.free(self.lines)


def tokens(text: Column) -> Column:
    """White-space separated tokens of a line."""
    return F.split(F.trim(F.regexp_replace(text, "\\s+", " ")), " ")


def parse_adjacency(lines: DataFrame, mode: str = "failfast") -> DataFrame:
    """Edges (src, dst) and lone sources (dst null) of lines `src: dst dst ...` in text.

    The first token loses its last character, whatever it is.  A blank line is
    an error, or with mode="skip" left out.
    """
    split = lines.select(tokens(F.col("text")).alias("t"), F.trim(F.regexp_replace("text", "\\s+", " ")).alias("s"))
    if mode == "skip":
        split = split.where("s <> ''")
    else:
        split = split.withColumn("t", F.when(F.col("s") == "", F.raise_error(F.lit("blank line in adjacency text")).cast("array<string>")).otherwise(F.col("t")))
    first = F.get("t", F.lit(0))
    return split.select(first.substr(F.lit(1), F.length(first) - 1).alias("src"), F.explode_outer(F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0)))).alias("dst"))


def sorted_out(lines: DataFrame, colon: bool = False) -> tuple[DataFrame, DataFrame, int]:
    """Lines (line, text) that are adjacency text, the rejected ones (line, reason, text), and how many these are.

    Rejected are blank lines, and with colon those whose first token doesn't end
    in one.  The lines are judged and counted in one pass, which writes them
    with their reason; both results read that table.
    """
    first = F.get(tokens(F.col("text")), F.lit(0))
    blank = F.coalesce(F.trim(F.regexp_replace("text", "\\s+", " ")) == "", F.lit(True))
    reason = F.when(blank, F.lit("blank line"))
    if colon:
        reason = reason.when(~first.endswith(":"), F.lit("no colon behind the source"))
    judged = lineage.cut(lines.select("line", "text", reason.alias("reason")), observed=F.count("reason"))
    return judged.where("reason IS NULL").select("line", "text"), judged.where("reason IS NOT NULL").select("line", "reason", "text"), judged.observed


def read_adjacency(spark: SparkSession, path: str | LineIndex, skip: int = 0, take: int | None = None, mode: str = "failfast") -> PropertyGraph:
    """The graph of an adjacency file, or of a range of its lines; all vertices start at 0.  path may be a LineIndex."""
    lines = path.range(skip, take) if isinstance(path, LineIndex) else spark.read.text(path).withColumnRenamed("value", "text") if not skip and take is None else line_range(numbered_lines(spark, path), skip, take)
    return graph_of(parse_adjacency(lines, mode))


def graph_of(parsed: DataFrame) -> PropertyGraph:
    """Vertices are sources and targets, each once."""
    ids = parsed.select(F.col("src").alias("id")).union(parsed.select("dst")).where("id is not null").distinct()
    return PropertyGraph(ids.withColumn("value", F.lit(0.0)), parsed.where("dst is not null"))


def read_titles(spark: SparkSession, path: str, limit: int = 400_000) -> DataFrame:
    """(label, title): a line's number as text, and the line; the first limit lines."""
    return line_range(numbered_lines(spark, path), 0, limit).select(F.col("line").cast("string").alias("label"), F.col("text").alias("title"))


def parse_matrix(lines: DataFrame, strict: bool = True, reverse: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, columns) of a tab separated count matrix in (line, text), line 0 its header.

    rows: id, name, vec; ids count from the last line if reverse.  columns:
    pos, name.  An empty field is an error if strict, else it ends its row.
    """
    clean = F.trim(F.regexp_replace("text", "^[\\t ]+|[\\t ]+$", ""))
    whole = lines.withColumn("text", clean)
    if strict:
        text = F.when(F.col("text").contains("\t\t"), F.raise_error(F.lit("empty field in matrix")).cast("string")).otherwise(F.col("text"))
    else:
        text = F.regexp_extract("text", "^[^\\t]+(\\t[^\\t]+)*", 0)
    split = whole.select("line", F.split(text, "\t").alias("t"))
    columns = split.where("line = 0").select(F.posexplode(F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0)))).alias("pos", "name"))
    body = split.where("line > 0")
    number = body.agg(F.max("line")).first()[0] or 0
    position = F.lit(number) - F.col("line") if reverse else F.col("line") - 1
    return body.select(position.cast("int").alias("id"), F.get("t", F.lit(0)).alias("name"), F.transform(F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))), lambda x: x.cast("int")).alias("vec")), columns


def read_matrix(spark: SparkSession, path: str, lines: int | None = None, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """parse_matrix of a file, or of its first lines, the header counted."""
    return parse_matrix(line_range(numbered_lines(spark, path), 0, lines), strict)


def first_names(rows: DataFrame, n: int = 10) -> DataFrame:
    """(id, name) of the n least ids, for a look at what was read."""
    return rows.orderBy("id").limit(n).select("id", "name")


def prefixed(lines: DataFrame, prefix: str, suffix_length: int) -> DataFrame:
    """The text between prefix and the last suffix_length characters of the lines that begin so."""
    text = F.col("text")
    return lines.where(text.startswith(prefix)).select(text.substr(F.lit(len(prefix) + 1), F.length(text) - len(prefix) - suffix_length).alias("text"))
