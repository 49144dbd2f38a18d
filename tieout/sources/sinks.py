"""Sinks: partitioned Parquet, JSON and text, and steps written to the folder that the cluster shares."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster shares, as the session names it.

    Where none is named, a session within one process (``local``) gets a folder of its
    own; on a cluster that is an error, as executors could not see it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="tieout-")
    return _LOCAL[context.applicationId]


#: Folder of each application that runs in one process and names none.
_LOCAL: dict[str, str] = {}


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_partitioned(df: DataFrame, path: str, by: list[str], rows_per_task: int = 1_000_000, kind: str = "parquet") -> None:
    """Files of ``kind`` (parquet or json) partitioned by low-cardinality columns.

    Each partition value is spread over as many tasks as its rows need, counted first, so
    that one value holding most rows still writes in parallel and a small one leaves one file.
    """
    sizes = cut_lineage(df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / rows_per_task).cast("int").alias("_tasks")), "partition-sizes")
    salted = df.join(sizes, by).withColumn("_salt", F.pmod(F.xxhash64(*[c for c in df.columns if c not in by]), F.col("_tasks")))
    salted.repartition(*by, "_salt").drop("_tasks", "_salt").write.mode("overwrite").partitionBy(*by).format(kind).save(path)


def write_lines(df: DataFrame, path: str, by: list[str], order: list[str], line: str = "line") -> None:
    """Text files, one folder per value of ``by``, lines by ``order`` (unique within ``by``).

    Rows are dealt by ranges of (by, order): a folder's files in name order hold its lines in
    order, and a long document lies in several files instead of one task. A task that is run
    again writes its file anew, and nothing is seen before the whole job commits.
    """
    ranged = df.select(*by, *order, line).repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    ranged.select(*by, line).write.mode("overwrite").partitionBy(*by).text(path)


def size_of(df: DataFrame) -> int:
    """Bytes of the files that ``df`` reads."""
    places = [_folder(df.sparkSession, p) for p in df.inputFiles()]
    return sum(system.getFileStatus(place).getLen() for system, place in places)


def is_committed(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` ran to its end."""
    return _folder(spark, f"{path}/_SUCCESS")[0].exists(_folder(spark, f"{path}/_SUCCESS")[1])


def remove(spark: SparkSession, path: str) -> bool:
    """Deletes a folder that a sink wrote; only below the shared folder. False where there is none."""
    if not path.startswith(f"{shared_folder(spark).rstrip('/')}/") or ".." in path:
        raise ValueError(f"not below the shared folder: {path}")
    system, place = _folder(spark, path)
    return system.delete(place, True)


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


_LANDED: dict[tuple[str, str, str], str] = {}


def landed(spark: SparkSession, scope: str, name: str, build, by: str | None = None, buckets: int = 1) -> DataFrame:
    """A table written once per application to the shared folder and read back from there.

    Steps that many jobs read are landed instead of cached: later plans start from a
    plain scan, filters and columns are pushed into it, and nothing is lost with an
    executor. ``scope`` tells apart the inputs the table was built from. A table landed
    ``by`` a column lies in ``buckets`` of it, so sums over keys that hold this column move
    no rows, nor do joins over such keys of tables with as many buckets where the result is
    landed ``by`` it as well.
    """
    key = (spark.sparkContext.applicationId, scope, name)
    if key not in _LANDED:
        path = new_path(spark, name.replace(" ", "-"))
        if by is None:
            build().write.mode("overwrite").parquet(path)
        else:
            with _joins_in_buckets(spark):
                build().write.bucketBy(buckets, by).option("path", path).saveAsTable(_table(path), format="parquet")
        _LANDED[key] = path
    return spark.read.parquet(_LANDED[key]) if by is None else spark.read.table(_table(_LANDED[key]))


@contextlib.contextmanager
def _joins_in_buckets(spark: SparkSession):
    """Joins over keys that hold the buckets' column stay in the buckets; else Spark deals both sides anew by all keys."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _table(path: str) -> str:
    return re.sub(r"\W", "_", path.rsplit("/", 1)[-1])


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: for loops, one table per round."""
    path = new_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
