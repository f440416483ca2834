"""Keep the plans of iterative programs short: tables in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_made: set[str] = set()


def folder(spark: SparkSession) -> str:
    """A new path in the session's checkpoint folder; with a local master one is made where there is none, on a cluster it must be set."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        where = context.getConf().get("spark.checkpoint.dir")
        if not where and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="stepweave-"))
    path = f"{context._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
    _made.add(path)
    return path


def cut(df: DataFrame, by: str | None = None, observed: Column | None = None, buckets: int | None = None) -> DataFrame:
    """Write df as a table in the checkpoint folder and read it back.

    by: the table is in buckets of that column, as many as there are shuffle
    partitions or as buckets says, so that joins and groups on it take it where it lies.  Rows
    should already be dealt so, or every task writes to every bucket.
    observed: an aggregate that is worked out while the table is written; it is
    then the table's `observed`.
    """
    spark, path, watch = df.sparkSession, folder(df.sparkSession), Observation()
    kept = df if observed is None else df.observe(watch, observed.alias("observed"))
    if by is None:
        kept.write.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    else:
        name = f"stepweave_{uuid.uuid4().hex}"
        kept.write.bucketBy(buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), by).option("path", path).format("parquet").saveAsTable(name)
        out = spark.table(name)
        out.schema  # noqa: B018  resolved before its name goes; the files stay
        spark.sql(f"DROP TABLE {name}")
    out._table = path
    if observed is not None:
        out.observed = watch.get["observed"]
    return out


def dealt(df: DataFrame, by: str, buckets: int | None = None) -> DataFrame:
    """df dealt to the buckets that cut writes."""
    return df.repartition(buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    _made.discard(path)


def free(*tables: DataFrame | None) -> None:
    """Delete the files of tables that cut made and that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_table", None):
            _delete(df.sparkSession, path)


def terminate(spark: SparkSession) -> int:
    """Delete all that this process has put into the checkpoint folder; results that are still read from there end with it.  Returns how many."""
    paths = list(_made)
    for path in paths:
        _delete(spark, path)
    return len(paths)
