"""Writers, and the manifest that lets jobs skip finished recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition: str | None = "recording_id") -> None:
    """Parquet, by recording where the table has one; a rerun replaces its own recordings only."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(partition) if partition and partition in df.columns else writer).parquet(path)


def write_runs(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_report(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)  # a report: a row a cohort


def write_markdown(df: DataFrame, path: str, title: str) -> None:
    """A report of a few rows as one Markdown table, written by Spark as text."""
    cells = lambda columns: F.concat(F.lit("| "), F.concat_ws(" | ", *columns), F.lit(" |"))
    head = df.sparkSession.createDataFrame([(f"# {title}\n\n| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}",)], "value string")
    rows = df.select(cells([F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]).alias("value"))
    both = head.withColumn("at", F.lit(0)).unionByName(rows.withColumn("at", F.lit(1)))
    both.repartition(1).sortWithinPartitions("at", "value").select("value").write.mode("overwrite").text(path)


def cohort_totals(files: DataFrame) -> DataFrame:
    """(cohort, recordings, bytes, incomplete) from (cohort, recording_id, bytes, present) rows."""
    per = files.groupBy("cohort", "recording_id").agg(F.sum("bytes").alias("bytes"), F.bool_and("present").alias("whole"))
    return per.groupBy("cohort").agg(F.count(F.lit(1)).alias("recordings"), F.sum("bytes").alias("bytes"), F.count_if(~F.col("whole")).alias("incomplete"))


def pending(spark: SparkSession, catalog: DataFrame, manifest: str, stage: str, force: bool = False) -> DataFrame:
    """The recordings that ``stage`` has not finished; all of them with ``force`` or before any manifest exists."""
    try:
        done = spark.read.schema("recording_id int, stage string").json(manifest)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return catalog
    return catalog if force else catalog.join(done.filter(F.col("stage") == stage), "recording_id", "left_anti")


def mark_done(recordings: DataFrame, manifest: str, stage: str) -> None:
    recordings.select("recording_id", F.lit(stage).alias("stage")).write.mode("append").json(manifest)
