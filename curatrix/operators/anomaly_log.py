"""The anomaly log as a folder with numbered versions: it can be appended to and rewritten while it is being read.

A version is a small file that names the data folders it consists of, in their order. An append writes one more folder, a rewrite
one new folder in place of all; then the next version's file is created, which fails if another writer has been faster. So a
version appears at once and whole, and never changes: who reads it stays on it. Folders that no version names are what failed
writers have left.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from curatrix.sources import readers as S

from .curation import COLUMNS, numbered, validate_anomaly


class ChangedMeanwhile(Exception):
    """Another writer has made the next version; read the log again and repeat the edit."""


class AnomalyLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _pointers(self) -> dict[int, str]:
        """Texts of the versions' files that are complete."""
        found = self._fs.globStatus(self._path("versions/*.json")) or []
        out = {}
        for status in found:
            stream = self._fs.open(status.getPath())
            try:
                text = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
            if text.endswith("\n"):
                out[int(status.getPath().getName().removesuffix(".json"))] = text
        return out

    def version(self) -> int:
        """The last version; 0 where there is none."""
        return max(self._pointers(), default=0)

    def folders(self, version: int | None = None) -> list[str]:
        pointers = self._pointers()
        version = max(pointers, default=0) if version is None else version
        return json.loads(pointers[version]) if version else []

    def read(self, version: int | None = None) -> DataFrame:
        """The log of a version, by default the last, with `ord`: the order in which its rows were written."""
        parts = [S.read_anomalies(self.spark, f"{self.path}/{f}", F.lit(i)) for i, f in enumerate(self.folders(version))]
        if not parts:
            return self.spark.createDataFrame([], f"{S.ANOMALIES}, ord struct<part:int,file:string,start:long,line:long>")
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def _put(self, df: DataFrame, before: list[str], version: int) -> int:
        folder = f"data/{uuid.uuid4().hex}"
        df.select(*COLUMNS).write.json(f"{self.path}/{folder}")
        try:
            stream = self._fs.create(self._path(f"versions/{version + 1:08d}.json"), False)
        except Exception as e:
            if "already exists" in str(e):
                raise ChangedMeanwhile(f"version {version + 1} of {self.path}") from None
            raise
        try:
            stream.write((json.dumps([*before, folder]) + "\n").encode())
        finally:
            stream.close()
        return version + 1

    def append(self, df: DataFrame, based_on: int | None = None) -> int:
        """A version with the rows of df after all others; based_on: the version that the caller has seen."""
        version = self.version() if based_on is None else based_on
        return self._put(df, self.folders(version), version)

    def add(self, new: DataFrame) -> DataFrame:
        """Append the rows that can be accepted, and return the others with their reason."""
        checked = validate_anomaly(new)
        self.append(checked.where("reject_reason is null"))
        return checked.where("reject_reason is not null")

    def rewrite(self, df: DataFrame, based_on: int | None = None) -> int:
        """A version with the rows of df alone, in its order; df may be read from the log itself."""
        version = self.version() if based_on is None else based_on
        return self._put(df, [], version)

    def listed(self, version: int | None = None) -> DataFrame:
        """The log with `number`, from 1 on, in the order in which it was written."""
        return numbered(self.read(version), ["ord"])

    def remove(self, number: int) -> int:
        """A version without the row of that number in the last one."""
        version = self.version()
        return self.rewrite(self.listed(version).where(F.col("number") != number).orderBy("number"), version)
