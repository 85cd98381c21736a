"""Folds of documents by the CRC-32 of their id as text."""

from pyspark.sql import Column, functions as F


def fold(doc_id: str, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string")) % n, F.lit(0)).cast("int")
