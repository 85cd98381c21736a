"""Tables that cut lineage: Parquet in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from curatrix.sources.shared import shared_dir


class Scratch:
    """Written intermediate tables of one query. They outlive lost executors, being read from shared storage."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        self._n = 0

    def save(self, df: DataFrame) -> DataFrame:
        """Write df and return the table read back."""
        self._n += 1
        path = f"{self.root}/t{self._n}"
        # What was shuffled for this table goes with the job; later plans read the table.
        flag = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(flag, "false")
        self.spark.conf.set(flag, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(flag, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    @contextlib.contextmanager
    def small_batches(self, rows: int):
        """Tables that are saved meanwhile go to Python in Arrow batches of so many rows at most."""
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = self.spark.conf.get(name)
        self.spark.conf.set(name, str(rows))
        try:
            yield
        finally:
            self.spark.conf.set(name, before)

    def numbered(self, df: DataFrame) -> tuple[DataFrame, str]:
        """df with a row number that stays with its row however scans are split among executors, and that column's name, which no other has.

        Rows of Parquet files go by file and place in it; the list of files, which the driver holds for any scan, is
        broadcast. Any other df is written with its numbers.
        """
        taken, name = {c.lower() for c in df.columns}, "_row"
        while any(t.startswith(name) for t in taken):
            name += "_"
        try:
            placed = df.withColumn(name, F.col("_metadata.row_index")).withColumn(name + "file", F.col("_metadata.file_path"))
        except AnalysisException:
            return self.save(df.withColumn(name, F.monotonically_increasing_id())), name
        files = sorted(r[0] for r in placed.select(name + "file").distinct().collect())
        order = self.spark.createDataFrame(list(enumerate(files)), f"{name}order long, {name}file string")
        joined = placed.join(F.broadcast(order), name + "file").withColumn(name, F.shiftleft(F.col(name + "order"), 40) + F.col(name))
        return joined.drop(name + "file", name + "order"), name

    def drop(self, df: DataFrame) -> None:
        """Delete a saved table that no later plan reads."""
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def with_uid(df: DataFrame, scratch: Scratch) -> DataFrame:
    """uid, doc_id, text of documents: every scan sees the same uid."""
    mine, name = scratch.numbered(df)
    return mine.select(F.col(name).alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def filtered(docs: DataFrame, scratch: Scratch, decide, *columns: str, anti: bool = False) -> DataFrame:
    """docs with all columns, as far as decide(uid, doc_id, *columns) returns (or, if anti, doesn't return) their uid."""
    mine, name = scratch.numbered(docs)
    found = decide(mine.select(F.col(name).alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), *columns)).select(F.col("uid").alias(name))
    return mine.join(found, name, "left_anti" if anti else "left_semi").drop(name)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
