"""Edge tables: preparation, grouping by document, sampling, rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from curatrix.functions import text as T
from curatrix.sources.shared import stored


def explode_doc_ids(df: DataFrame, column: str = "pmid") -> DataFrame:
    """One row for each numeric id of a `;` list."""
    return df.withColumn(column, F.explode(T.doc_ids(column)))


def with_first_doc_id(df: DataFrame, column: str = "pmid") -> DataFrame:
    """The first id of a `;` list in its place; rows without one are dropped."""
    return df.withColumn(column, T.first_doc_id(column)).where(F.col(column).isNotNull())


def clean_doc_ids(df: DataFrame, column: str = "pmid") -> DataFrame:
    """Distinct numeric ids of lists in which a number may have become a decimal."""
    return df.select(F.explode(T.doc_ids(F.regexp_replace(F.col(column).cast("string"), r"\.0", ""))).alias(column)).distinct()


def drop_unknown(df: DataFrame) -> DataFrame:
    return df.where(~T.is_unknown("direction"))


def distinct_docs(df: DataFrame) -> DataFrame:
    return df.select("pmid").distinct()


def edges_by_doc(df: DataFrame, pack=T.pack_edge, divider: str = "; ") -> DataFrame:
    """pmid, n, relationships: the packed edges of each document in the order of ord."""
    items = F.array_sort(F.collect_list(F.struct("ord", pack("tf", "target", "direction").alias("edge"))))
    return df.groupBy("pmid").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(items, lambda x: x.edge), divider).alias("relationships"))


def latest_direction(df: DataFrame) -> DataFrame:
    """The last direction of each (pmid, tf, target)."""
    return df.groupBy("pmid", "tf", "target").agg(F.max_by("direction", "ord").alias("direction"))


def exclude_anomalies(df: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Without the documents that have an anomaly. Spark broadcasts the log if it is small by its own measure."""
    return df.join(anomalies.select("pmid").distinct(), "pmid", "left_anti")


def resolve_ground_truth(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """primary, and of fallback the documents that have no edge there."""
    return primary.unionByName(fallback.join(distinct_docs(primary), "pmid", "left_anti"))


def sample_docs(df: DataFrame, n: int, seed: str = "") -> DataFrame:
    """All edges of n documents, chosen by a seeded hash of their ids: the same ones whatever the partitioning.

    Where n is large, nothing is sorted as a whole: the hash of the n-th document is narrowed down by counts of hash prefixes, and
    the documents below it are those that are wanted.
    """
    docs = distinct_docs(df).withColumn("_hash", F.md5(F.concat(F.lit(seed), "pmid")))
    if n <= FEW:
        return df.join(docs.orderBy("_hash", "pmid").limit(n).select("pmid"), "pmid", "left_semi")
    docs = stored(docs)
    below, rest, more = _cut(docs, n)
    picked = docs.where(below)
    if rest is not None:
        picked = picked.unionByName(docs.where(rest).orderBy("_hash", "pmid").limit(more))
    return df.join(picked.select("pmid"), "pmid", "left_semi")


#: Documents that one task may sort, and digits by which a prefix of a hash grows.
FEW, DIGITS = 10_000, 3


def _cut(docs: DataFrame, n: int) -> tuple[Column, Column | None, int]:
    """Which documents (_hash) are surely among the first n, which few of them may be, and how many of these are.

    Each round counts the documents by the next digits below the prefix found so far: 16 ** DIGITS rows at most, whatever n.
    """
    prefix, before = "", 0
    while True:
        own = F.substring("_hash", 1, len(prefix) + DIGITS)
        counts = docs.where(F.col("_hash").startswith(prefix)).groupBy(own.alias("p")).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(W.orderBy("p"))
        found = counts.select("p", "n", upto.alias("upto")).where(F.col("upto") >= n - before).orderBy("p").limit(1).collect()
        if not found:
            return F.lit(True), None, 0
        prefix, before = found[0].p, before + found[0].upto - found[0].n
        if found[0].n <= FEW or len(prefix) >= 32:
            return F.col("_hash") < prefix, F.col("_hash").startswith(prefix), n - before


def attach_abstract(sample: DataFrame, abstracts: DataFrame) -> DataFrame:
    """sample with the abstract of its document, or a note that there is none."""
    return sample.join(abstracts.select("pmid", "abstract"), "pmid", "left").withColumn("abstract", F.coalesce("abstract", F.lit("Abstract not found in PubMed")))


def order_by_doc(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("pmid").try_cast("bigint"), "pmid")


def dedupe_edges(df: DataFrame, with_direction: bool = False) -> DataFrame:
    """One edge for each (pmid, tf, target): the most confident one, of equals the first."""
    keys = ["pmid", "tf", "target"] + ["direction"] * with_direction
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("confidence"), "pos"))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def top_edges(df: DataFrame, k: int = 10, min_conf: int = 2) -> DataFrame:
    """The k most confident edges of each document, from min_conf on."""
    rank = F.row_number().over(W.partitionBy("pmid").orderBy(F.desc("confidence"), "pos"))
    return df.where(F.col("confidence") >= min_conf).withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def exclude_regulators(df: DataFrame, terms: list[str] = T.NON_REGULATORS) -> DataFrame:
    """Without the edges whose regulator is one of the terms, by clean key."""
    return df.where(~T.clean_key("tf").isin([t.upper() for t in terms]))


def valid_direction(df: DataFrame) -> DataFrame:
    return df.where(T.valid_direction("direction")).withColumn("direction", T.normalize_direction("direction"))


def guard_self_edges(df: DataFrame, text: str = "evidence") -> DataFrame:
    """A self-edge stays only if its text states self-regulation."""
    return df.where((F.col("tf") != F.col("target")) | T.self_regulation(text))


def split_fusions(df: DataFrame, mapping: DataFrame, column: str = "tf") -> DataFrame:
    """A fusion name becomes a row for each of its partners (mapping: fusion, partners)."""
    parts = F.coalesce("partners", F.array(column))
    return df.join(mapping.select(F.col("fusion").alias(column), "partners"), column, "left").withColumn(column, F.explode(parts)).drop("partners")
