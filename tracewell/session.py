"""Session factory and the shared scratch space that every executor can read."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import SparkConf, SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(app: str = "tracewell", cores: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators assume: UTC, AQE and Arrow; ANSI stays on.

    What spark-submit or a configuration file sets stays; ``cores``, the driver's memory (8 GB) and ``shuffle_partitions`` (8)
    are for local sessions that configure none.
    """
    os.environ.setdefault("SPARK_DRIVER_MEMORY", "8g")  # yields to files and options
    SparkContext._ensure_initialized()  # the JVM knows what was configured
    given = SparkConf()
    defaults = {"spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false"}
    if given.get("spark.master", "local[*]") == "local[*]":  # also where nothing is configured
        defaults |= {"spark.sql.shuffle.partitions": str(shuffle_partitions or 8)}
        builder = SparkSession.builder.master(f"local[{cores or '*'}]")
    else:
        builder = SparkSession.builder
    for key, value in defaults.items():
        if not given.contains(key):
            builder = builder.config(key, value)
    builder = builder.appName(app).config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where none is named, a local session gets a temporary folder, kept in the setting; on a cluster that is an error,
    as each machine would write to a disk of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        base = context.getCheckpointDir()
        if not base:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="tracewell-"))
            base = context.getCheckpointDir()
    return base.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it again.

    This cuts the lineage with files that outlive any executor, and keeps column pruning and size estimates,
    which an RDD checkpoint loses.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracewell/{uuid.uuid4().hex}/{tag}"
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What one broadcast may hold, by ``row_bytes``.
BROADCAST_BYTES = 64 << 20


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: its text form (strings, arrays and structs at their own length) and 16 a column."""
    sizes = [F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{c}`").alias("v")))), F.lit(0)) + 16 for c in df.columns]
    return sum(sizes, F.lit(16)).cast("bigint")


def broadcast_if_small(df: DataFrame, max_rows: int, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hints a broadcast when ``df`` (cheap to read: a table or a materialised result) has at most ``max_rows`` rows of
    ``max_bytes`` together. Beyond that a sort-merge join is asked for, whose skewed keys AQE can split."""
    head = df.limit(max_rows + 1).select(row_bytes(df).alias("b")).agg(F.count(F.lit(1)), F.sum("b")).first()
    return F.broadcast(df) if head[0] <= max_rows and (head[1] or 0) <= max_bytes else df.hint("shuffle_merge")


def ship_package(spark: SparkSession) -> None:
    """Gives executors this package, once a context, so that Python tasks can import it wherever they run."""
    import zipfile
    from pathlib import Path

    context = spark.sparkContext
    if getattr(context, "_tracewell_shipped", False):
        return
    package = Path(__file__).resolve().parent
    target = f"{tempfile.mkdtemp(prefix='tracewell-')}/tracewell.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(package.rglob("*.py")):
            archive.write(path, str(path.relative_to(package.parent)))
    context.addPyFile(target)  # the driver serves it to every executor
    context._tracewell_shipped = True
