"""The log of known-bad curated edges, kept as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from curatrix.functions import text as T
from curatrix.sources.shared import stored

COLUMNS = ["pmid", "anomaly_type", "trrust_entry", "issue", "corrected", "curated_date"]


def validate_anomaly(df: DataFrame) -> DataFrame:
    """df with reject_reason, NULL for rows that can be accepted."""
    reason = F.when(~T.valid_pmid("pmid"), "pmid").when(~F.coalesce(F.col("anomaly_type").isin(T.ANOMALY_TYPES), F.lit(False)), "anomaly_type").when(~T.valid_anomaly_entry("trrust_entry"), "entry").when(T.strip(F.coalesce("issue", F.lit(""))) == "", "issue")
    return df.withColumn("reject_reason", reason)


def append_anomalies(existing: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The log with the accepted rows, and the rejected rows with their reason."""
    checked = validate_anomaly(new)
    return existing.select(*COLUMNS).unionByName(checked.where("reject_reason is null").select(*COLUMNS)), checked.where("reject_reason is not null")


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """df with `number` from 1 on in the given order, without gathering the rows in one task.

    Rows are sorted by range and stored with the number of their partition; what is counted before a partition is one
    number for each partition.
    """
    ordered = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    ordered = ordered.withColumn("_rank", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    sizes = ordered.groupBy("_part").agg(F.max("_rank").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return ordered.join(F.broadcast(before), "_part").withColumn("number", (F.col("_rank") + F.col("_before")).cast("long")).drop("_part", "_rank", "_before")


def list_anomalies(df: DataFrame, order: list[str]) -> DataFrame:
    """The log numbered in its order, with a preview of each issue."""
    return numbered(df, order).withColumn("preview", T.preview("issue"))


def remove_anomaly(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    return numbered(df, order).where(F.col("number") != n).drop("number")


def anomalies_by_doc(df: DataFrame) -> DataFrame:
    """pmid, entries: the anomalies of each document."""
    return df.groupBy("pmid").agg(F.array_sort(F.collect_list(F.struct("anomaly_type", "trrust_entry", "issue"))).alias("entries"))


def export_anomalies(df: DataFrame) -> DataFrame:
    grouped = anomalies_by_doc(df)
    return grouped.orderBy(F.col("pmid").try_cast("bigint"), "pmid")
