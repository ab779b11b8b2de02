"""Import-job and task aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def job_totals(jobs: DataFrame) -> DataFrame:
    return jobs.agg(
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.sum("imported_count").alias("imported_total"),
        F.sum("duplicate_count").alias("duplicate_total"),
    )


def task_totals(tasks: DataFrame) -> DataFrame:
    return tasks.agg(
        F.count_if(F.col("status").isin("queued", "running")).alias("running"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.sum(F.col("completed_items") + F.col("failed_items")).alias("processed_total"),
    )


def task_outcome(results: DataFrame) -> DataFrame:
    """results: task_id, seq, error (null on success) -> one closed task per id."""
    g = results.groupBy("task_id").agg(
        F.count_if(F.col("error").isNull()).alias("completed_items"),
        F.count_if(F.col("error").isNotNull()).alias("failed_items"),
        F.max_by("error", F.when(F.col("error").isNotNull(), F.col("seq"))).alias("error_message"),
    )
    failed = (F.col("failed_items") > 0) & (F.col("completed_items") == 0)
    return g.withColumn("status", F.when(failed, "failed").otherwise("completed"))
