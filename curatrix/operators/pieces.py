"""What belongs to one document in pieces of bounded size, so that no buffer holds a large document's rows.

Rows are numbered within their document, where its rows lie. Documents with more rows than a task should sort are found by a count, and
dealt by ranges of (document, order), so each lies in several ranges; there a piece is a part of a document within a range. Pieces ascend
with the order of rows. They are packed on their own, and stand beside each other only where a file wants them to (`sources.lines`), or in `joined`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from curatrix.functions import text as T
from curatrix.sources.shared import stored

MOST = 100_000
#: Rows of a document that one task may sort. There are at most rows / LARGE larger ones, which are broadcast.
LARGE = 1_000_000


def in_pieces(df: DataFrame, order: list[str], most: int = MOST, key: str = "pmid") -> DataFrame:
    """df with `piece`: numbers that ascend within a document in the given order, `most` rows to each at most."""
    piece = lambda *by: F.floor((F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1) / most)
    large = stored(df.groupBy(F.col(key).alias("_large")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > LARGE).select("_large"))
    if large.isEmpty():
        return df.withColumn("piece", piece(key))
    same, known = F.col(key).eqNullSafe(F.col("_large")), F.broadcast(large)
    ranged = stored(df.join(known, same, "left_semi").repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id().cast("long")))
    ranged = ranged.withColumn("piece", F.shiftleft(F.col("_part"), 32) + piece("_part", key)).drop("_part")
    return df.join(known, same, "left_anti").withColumn("piece", piece(key)).unionByName(ranged)


def _packed(df: DataFrame, order: list[str], entry: Column, most: int) -> tuple[DataFrame, Column]:
    rows = in_pieces(df, order, most).select("pmid", "piece", F.struct(*order, entry.alias("_entry")).alias("e"))
    return rows.groupBy("pmid", "piece"), F.transform(F.array_sort(F.collect_list("e")), lambda x: x["_entry"])


def edge_pieces(df: DataFrame, most: int = MOST, pack=T.pack_edge, divider: str = "; ") -> DataFrame:
    """pmid, piece, n, relationships: the packed edges of a document (pmid, ord, tf, target, direction) in pieces."""
    grouped, entries = _packed(df, ["ord"], pack("tf", "target", "direction"), most)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.array_join(entries, divider).alias("relationships"))


def anomaly_pieces(df: DataFrame, most: int = MOST) -> DataFrame:
    """pmid, piece, entries: the anomalies of a document in pieces."""
    order = ["anomaly_type", "trrust_entry", "issue"]
    grouped, entries = _packed(df, order, F.struct(*order), most)
    return grouped.agg(entries.alias("entries"))


def review_pieces(pairs: DataFrame, most: int = MOST) -> DataFrame:
    """pmid, piece, pairs: the enriched pairs of a document in pieces, as review_dataset has them."""
    pair = F.struct("ord", "tf", F.col("target").alias("gene"), "ensg", "in_track", "tf_aliases", "gene_aliases", "reference_direction")
    grouped, entries = _packed(pairs, ["ord"], pair, most)
    return grouped.agg(entries.alias("pairs"))


def joined(pieces: DataFrame, divider: str = "; ") -> DataFrame:
    """pmid, n, relationships of edge pieces: a document's buffer holds its packed text and nothing else."""
    texts = F.array_sort(F.collect_list(F.struct("piece", "relationships")))
    return pieces.groupBy("pmid").agg(F.sum("n").alias("n"), F.array_join(F.transform(texts, lambda x: x["relationships"]), divider).alias("relationships"))
