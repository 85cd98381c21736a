"""Human review of gold pairs: enrichment, coverage, export, edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from curatrix.functions import text as T
from curatrix.sources.shared import stored

FIELDS = ["direction", "cellline", "assay", "notes"]


def resolve_ensg(df: DataFrame, ensg: DataFrame, normalized: DataFrame, column: str = "target") -> DataFrame:
    """df with ensg and ensg_status: by the symbol, else by its normalised name (normalized: name, normalized), else NOT_FOUND."""
    direct = ensg.select(F.col("symbol").alias("_s"), F.col("ensg").alias("_e1"))
    second = normalized.select(F.col("name").alias("_n"), F.upper("normalized").alias("_m")).join(ensg.select(F.col("symbol").alias("_m"), F.col("ensg").alias("_e2")), "_m").drop("_m")
    out = df.join(direct, F.upper(column) == F.col("_s"), "left").join(second, F.upper(column) == F.col("_n"), "left")
    status = F.when(F.col("_e1").isNotNull(), "ok").when(F.col("_e2").isNotNull(), "normalized").otherwise("missing")
    return out.withColumn("ensg", F.coalesce("_e1", "_e2", F.lit("NOT_FOUND"))).withColumn("ensg_status", status).drop("_s", "_e1", "_n", "_e2")


def flag_in_track(df: DataFrame, tfs: DataFrame) -> DataFrame:
    marked = tfs.select(F.col("tf").alias("_t")).distinct().withColumn("_in", F.lit(True))
    return df.join(marked, F.upper("tf") == F.col("_t"), "left").withColumn("in_track", F.coalesce("_in", F.lit(False))).drop("_t", "_in")


def lookup_direction(df: DataFrame, latest: DataFrame) -> DataFrame:
    """df with reference_direction, '' where there is none (latest: pmid, tf, target, direction)."""
    return df.join(latest.withColumnRenamed("direction", "reference_direction"), ["pmid", "tf", "target"], "left").withColumn("reference_direction", F.coalesce("reference_direction", F.lit("")))


def own_direction(df: DataFrame) -> DataFrame:
    """df with reference_direction as `lookup_direction` has it from df's own last directions (pmid, tf, target, direction, ord): found where a document's rows lie."""
    named = F.col("pmid").isNotNull() & F.col("tf").isNotNull() & F.col("target").isNotNull()
    last = F.max_by("direction", "ord").over(W.partitionBy("pmid", "tf", "target"))
    return df.withColumn("reference_direction", F.coalesce(F.when(named, last), F.lit("")))


def attach_aliases(df: DataFrame, reverse: DataFrame) -> DataFrame:
    """df with tf_aliases and gene_aliases (reverse: symbol, aliases), of those columns it has."""
    none = F.array().cast("array<string>")
    out = df
    for column, name in (("tf", "tf_aliases"), ("target", "gene_aliases")):
        if column not in df.columns:
            continue
        out = out.join(reverse.select(F.col("symbol").alias(column), F.col("aliases").alias(name)), column, "left").withColumn(name, F.coalesce(name, none))
    return out


def attach_names(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """df with what names (a row for each value of column) says of its column.

    names is stored, so that Spark joins it by its measured size. An estimate is that of the tables behind it, and would have all of df shuffled by name.
    """
    known = stored(names).withColumnRenamed(column, "_name")
    return df.join(known, F.col(column).eqNullSafe(F.col("_name")), "left").drop("_name")


def review_dataset(pairs: DataFrame, abstracts: DataFrame) -> DataFrame:
    """pmid, abstract, pairs: the enriched pairs of each document in the order of ord."""
    pair = F.struct("ord", "tf", F.col("target").alias("gene"), "ensg", "in_track", "tf_aliases", "gene_aliases", "reference_direction")
    nested = pairs.groupBy("pmid").agg(F.array_sort(F.collect_list(pair)).alias("pairs"))
    return nested.join(abstracts.select("pmid", "abstract"), "pmid", "left").select("pmid", F.coalesce("abstract", F.lit("")).alias("abstract"), "pairs")


def review_coverage(pairs: DataFrame) -> DataFrame:
    sums = pairs.groupBy("pmid").agg(F.count(F.lit(1)).alias("n"), F.count_if("in_track").alias("hit"), F.count_if(F.col("ensg_status") != "missing").alias("ok"))
    return sums.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("pairs"), F.sum("hit").alias("tf_in_track"), (F.sum("n") - F.sum("hit")).alias("tf_missing"), F.sum("ok").alias("ensg_resolved"), (F.sum("n") - F.sum("ok")).alias("ensg_missing"))


def review_progress(docs: DataFrame, state: DataFrame) -> DataFrame:
    joined = docs.select("pmid").distinct().join(state.select("pmid", "reviewed"), "pmid", "left")
    return joined.agg(F.count_if(F.coalesce("reviewed", F.lit(False))).alias("done"), F.count(F.lit(1)).alias("total"))


def review_export(dataset: DataFrame, state: DataFrame) -> DataFrame:
    """pmid, tf, ensg, direction, cellline, assay: a row for each pair with its document's answers."""
    rows = dataset.select("pmid", F.explode("pairs").alias("p")).select("pmid", "p.ord", "p.tf", "p.ensg")
    return rows.join(state.select("pmid", "direction", "cellline", "assay"), "pmid", "left").select("pmid", "ord", "tf", "ensg", *[F.coalesce(c, F.lit("")).alias(c) for c in ("direction", "cellline", "assay")])


def filter_review(docs: DataFrame, state: DataFrame, mode: str = "all") -> DataFrame:
    """The documents that are all, done or pending."""
    joined = docs.join(state.select("pmid", F.col("reviewed").alias("_r")), "pmid", "left").withColumn("_r", F.coalesce("_r", F.lit(False)))
    return {"all": joined, "done": joined.where("_r"), "pending": joined.where("not _r")}[mode].drop("_r")


def merge_review(state: DataFrame, edits: DataFrame) -> DataFrame:
    """State under edits (pmid and fields, null where unchanged); reviewed follows from the answers of an edited row."""
    joined = state.select("pmid", *[F.col(c).alias(f"_{c}") for c in FIELDS], F.col("reviewed").alias("_reviewed")).join(edits.select("pmid", *FIELDS, F.lit(True).alias("_edited")), "pmid", "full")
    merged = joined.select("pmid", *[F.coalesce(c, f"_{c}", F.lit("")).alias(c) for c in FIELDS], "_reviewed", "_edited")
    return merged.withColumn("reviewed", F.when(F.col("_edited"), T.is_reviewed("direction", "cellline", "assay")).otherwise(F.coalesce("_reviewed", F.lit(False)))).drop("_reviewed", "_edited")
