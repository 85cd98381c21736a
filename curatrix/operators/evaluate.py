"""Comparison of extracted edges with curated ones: classes, missed edges, metrics.

pred: pmid, pos, tf, target, direction (and confidence, evidence); truth: pmid, ord, tf, target, direction.
Names match up to an isoform letter, which is equality of keys: the match is an equi-join on
(pmid, tf key, target key), not a loop over a document's edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from curatrix.functions import text as T

KEYS = ["pmid", "_tf", "_target"]
METRICS = ["total_pmids", "total_gt", "total_matched_gt", "total_llm", "total_consistent", "total_conflict", "total_new_found", "total_new", "total_missed", "recall", "overall_precision", "evaluable_precision", "direction_accuracy"]


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("_tf", T.isoform_key("tf")).withColumn("_target", T.isoform_key("target"))


def first_truth(truth: DataFrame) -> DataFrame:
    """The first curated edge of each (pmid, tf key, target key): the only one that can be matched.

    An aggregate with a map-side part, so a hot key is not sorted in one task.
    """
    first = F.min_by(F.struct("ord", "tf", "target", "direction"), "ord")
    return _keyed(truth).groupBy(*KEYS).agg(first.alias("t"))


def match_edges(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """All pairs of extracted and curated edges of a document whose names match."""
    left = _keyed(pred).select(*KEYS, F.struct(*pred.columns).alias("p"))
    right = _keyed(truth).select(*KEYS, F.struct(*truth.columns).alias("t"))
    return left.join(right, KEYS).select("pmid", "p", "t")


def classify_edges(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """pred with status, truth_direction and truth_ord."""
    with_truth = truth.select("pmid", F.lit(True).alias("_has")).distinct()
    df = _keyed(pred).join(first_truth(truth), KEYS, "left").join(with_truth, "pmid", "left")
    same = T.normalize_direction("direction") == T.normalize_direction("t.direction")
    status = F.when(F.col("t").isNotNull(), F.when(same, "Consistent").otherwise("Conflict")).when(F.col("_has"), "New Found").otherwise("New")
    return df.select(*pred.columns, status.alias("status"), F.col("t.direction").alias("truth_direction"), F.col("t.ord").alias("truth_ord"))


def missed_edges(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """The curated edges that no extracted edge matched, among them repeated ones."""
    hit = _keyed(pred).select(*KEYS).distinct().join(first_truth(truth), KEYS).select("pmid", F.col("t.ord").alias("ord"))
    return truth.join(hit, ["pmid", "ord"], "left_anti")


def relation_counts(docs: DataFrame, pred: DataFrame) -> DataFrame:
    """pmid, n of every document, 0 where nothing was extracted."""
    return docs.select("pmid").join(pred.groupBy("pmid").agg(F.count(F.lit(1)).alias("n")), "pmid", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def evaluate(pred: DataFrame, truth: DataFrame, docs: DataFrame) -> DataFrame:
    """One row of the 13 metrics. docs (pmid, error, n_items): all extracted documents; those with an error count in total_pmids only."""
    good = docs.where("error is null or error = ''").select("pmid", "n_items")
    own = truth.join(good.select("pmid"), "pmid", "left_semi")
    edges = classify_edges(pred.join(good.select("pmid"), "pmid", "left_semi"), own)
    # Sums by document first, then one row: nothing but counts meets in one task.
    per_doc = edges.groupBy("pmid").agg(*[F.count_if(F.col("status") == s).alias(n) for s, n in (("Consistent", "consistent"), ("Conflict", "conflict"), ("New Found", "new_found"), ("New", "new"))], F.count_distinct("truth_ord").alias("matched"))
    gt = own.groupBy("pmid").agg(F.count(F.lit(1)).alias("gt"))
    rows = docs.select("pmid", F.when(F.coalesce("error", F.lit("")) == "", F.col("n_items")).otherwise(0).alias("items")).join(gt, "pmid", "left").join(per_doc, "pmid", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = rows.agg(F.count(F.lit(1)).alias("total_pmids"), total("gt").alias("total_gt"), total("matched").alias("total_matched_gt"), total("items").alias("total_llm"), *[total(c).alias(f"total_{c}") for c in ("consistent", "conflict", "new_found", "new")])
    share = lambda a, b: F.coalesce(100.0 * a / F.nullif(b, F.lit(0)), F.lit(0.0))
    c = F.col
    matched = c("total_consistent") + c("total_conflict")
    return sums.select(
        "*", (c("total_gt") - c("total_matched_gt")).alias("total_missed"), share(c("total_matched_gt"), c("total_gt")).alias("recall"), share(matched, c("total_llm")).alias("overall_precision"),
        share(matched, c("total_llm") - c("total_new_found") - c("total_new")).alias("evaluable_precision"), share(c("total_consistent"), matched).alias("direction_accuracy"),
    )
