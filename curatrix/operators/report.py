"""Report tables: summary, comparison, headers, debug, excluded documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from curatrix.functions import text as T

from .edges import edges_by_doc, order_by_doc
from .evaluate import classify_edges, missed_edges


def summary_table(metrics: DataFrame) -> DataFrame:
    """ord, metric, value, note: the lines of a summary of a row of metrics; shares as a/b = c%."""
    c = lambda n: F.col(f"total_{n}")
    share = lambda a, b, p: F.format_string("%d/%d = %.1f%%", a, b, F.col(p))
    matched = c("consistent") + c("conflict")
    lines = [
        ("Documents", c("pmids").cast("string"), ""),
        ("Curated edges", c("gt").cast("string"), "of the evaluated documents"),
        ("Extracted edges", c("llm").cast("string"), "all predictions"),
        ("Recall", share(c("matched_gt"), c("gt"), "recall"), "curated edges that were found, each once"),
        ("Overall precision", share(matched, c("llm"), "overall_precision"), "predictions that match a curated pair"),
        ("Evaluable precision", share(matched, c("llm") - c("new_found") - c("new"), "evaluable_precision"), "without new ones, of predictions that can be judged"),
        ("Direction accuracy", share(c("consistent"), matched, "direction_accuracy"), "of matched pairs, those with the curated direction"),
        ("Consistent", c("consistent").cast("string"), "names and direction match"),
        ("Conflict", c("conflict").cast("string"), "names match, the direction differs"),
        ("New found", c("new_found").cast("string"), "the document has curated edges, but not this one"),
        ("Missed", c("missed").cast("string"), "curated edges that were not extracted"),
        ("New", c("new").cast("string"), "the document has no curated edge"),
    ]
    rows = F.posexplode(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value"), F.lit(n).alias("note")) for m, v, n in lines]))
    return metrics.select(rows.alias("ord", "l")).select("ord", "l.*")


def comparison_table(pred: DataFrame, truth: DataFrame, docs: DataFrame) -> DataFrame:
    """pmid, tf, target, truth_direction, direction, confidence, evidence, status: classified edges, missed ones, and one row for an error.

    docs (pmid, error): the extracted documents; a document with an error has no other row.
    """
    good = docs.where("error is null or error = ''").select("pmid")
    own, edges = truth.join(good, "pmid", "left_semi"), pred.join(good, "pmid", "left_semi")
    band = T.confidence_band("confidence")
    found = classify_edges(edges, own).select("pmid", "tf", "target", F.coalesce("truth_direction", F.lit("-")).alias("truth_direction"), "direction", F.when(band > 0, band.cast("string")).otherwise("-").alias("confidence"), "evidence", "status")
    missed = missed_edges(edges, own).select("pmid", "tf", "target", F.col("direction").alias("truth_direction"), F.lit("N/A").alias("direction"), F.lit("-").alias("confidence"), F.lit("-").alias("evidence"), F.lit("Missed").alias("status"))
    none = F.lit(None).cast("string")
    errors = docs.where("error <> ''").select("pmid", *[none.alias(c) for c in ("tf", "target", "truth_direction", "direction", "confidence", "evidence")], T.format_error("error").alias("status"))
    return found.unionByName(missed).unionByName(errors)


def doc_headers(docs: DataFrame, truth: DataFrame, abstracts: DataFrame) -> DataFrame:
    """pmid, reference, abstract: the curated edges of each document in one line, or (none)."""
    packed = edges_by_doc(truth, T.display_edge).select("pmid", F.col("relationships").alias("reference"))
    out = docs.select("pmid").join(packed, "pmid", "left").join(abstracts.select("pmid", "abstract"), "pmid", "left")
    return out.select("pmid", F.coalesce("reference", F.lit("(none)")).alias("reference"), F.coalesce("abstract", F.lit("Not found")).alias("abstract"))


def debug_table(debug: DataFrame) -> DataFrame:
    """Answers and tokens of the documents that have a first answer."""
    n = lambda r, k: F.coalesce(F.col(f"round{r}_usage.{k}"), F.lit(0))
    tokens = lambda r: F.format_string("in:%d out:%d", n(r, "input_tokens"), n(r, "output_tokens"))
    return debug.where("round1_analysis is not null").select("pmid", "round1_analysis", tokens(1).alias("round1_tokens"), "round2_raw", T.clean_json("round2_raw").alias("round2_clean"), tokens(2).alias("round2_tokens"))


def excluded_table(anomalies: DataFrame) -> DataFrame:
    return order_by_doc(anomalies.select("pmid", "anomaly_type", "trrust_entry", "issue"))
