"""Queries on edge tables and their comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.functions import text as T
from curatrix.operators import edges as E, evaluate as V, pieces as P, report as R

from .views import ctes, iso, norm, view

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _docs(spark, d):
    counts = view(spark, d, "pred").groupBy("pmid").agg(F.count(F.lit(1)).alias("n_items"))
    return view(spark, d, "edge_docs").join(counts, "pmid", "left").withColumn("n_items", F.coalesce("n_items", F.lit(0)))


_CLASSIFIED = f"""t AS (SELECT *, {iso('tf')} AS ktf, {iso('target')} AS ktarget FROM truth),
f AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY pmid, ktf, ktarget ORDER BY ord) = 1),
c AS (SELECT p.*, f.direction AS truth_direction, f.ord AS truth_ord,
  CASE WHEN f.ord IS NOT NULL THEN CASE WHEN {norm('p.direction')} = {norm('f.direction')} THEN 'Consistent' ELSE 'Conflict' END
       WHEN p.pmid IN (SELECT pmid FROM truth) THEN 'New Found' ELSE 'New' END AS status
  FROM pred p LEFT JOIN f ON f.pmid = p.pmid AND f.ktf = {iso('p.tf')} AND f.ktarget = {iso('p.target')})"""

#: Truth without the unknown directions, so that some documents have none.
_KNOWN = ctes("truth", "pred", "edge_docs").replace("truth AS (", "truth_all AS (", 1).replace("FROM truth)", "FROM truth_all)") + ",\ntruth AS (SELECT * FROM truth_all WHERE direction <> 'Unknown')"


def _truth(spark, d):
    return E.drop_unknown(view(spark, d, "truth"))


@query("edge_classes", f"{_KNOWN},\n{_CLASSIFIED}\nSELECT pmid, pos, tf, target, direction, status, truth_direction, truth_ord FROM c")
def edge_classes(spark, d):
    return V.classify_edges(view(spark, d, "pred").drop("confidence", "evidence"), _truth(spark, d))


@query("edge_missed", f"{_KNOWN},\n{_CLASSIFIED}\nSELECT pmid, tf, target, direction, ord FROM truth t WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.pmid = t.pmid AND c.truth_ord = t.ord)")
def edge_missed(spark, d):
    return V.missed_edges(view(spark, d, "pred"), _truth(spark, d)).select("pmid", "tf", "target", "direction", "ord")


@query("edge_matches", f"{_KNOWN}\nSELECT p.pmid, p.pos, t.ord FROM pred p JOIN truth t ON p.pmid = t.pmid AND {iso('p.tf')} = {iso('t.tf')} AND {iso('p.target')} = {iso('t.target')}")
def edge_matches(spark, d):
    return V.match_edges(view(spark, d, "pred"), _truth(spark, d)).select("pmid", "p.pos", "t.ord")


_METRICS = f"""{_KNOWN}, good AS (SELECT pmid FROM edge_docs WHERE error IS NULL),
{_CLASSIFIED},
m AS (SELECT (SELECT count(*) FROM edge_docs) AS total_pmids, (SELECT count(*) FROM truth JOIN good USING (pmid)) AS total_gt,
  (SELECT count(DISTINCT (pmid, truth_ord)) FROM c JOIN good USING (pmid) WHERE truth_ord IS NOT NULL) AS total_matched_gt, (SELECT count(*) FROM pred JOIN good USING (pmid)) AS total_llm,
  (SELECT count(*) FROM c JOIN good USING (pmid) WHERE status = 'Consistent') AS total_consistent, (SELECT count(*) FROM c JOIN good USING (pmid) WHERE status = 'Conflict') AS total_conflict,
  (SELECT count(*) FROM c JOIN good USING (pmid) WHERE status = 'New Found') AS total_new_found, (SELECT count(*) FROM c JOIN good USING (pmid) WHERE status = 'New') AS total_new),
metrics AS (SELECT *, total_gt - total_matched_gt AS total_missed, coalesce(100.0::DOUBLE * total_matched_gt / nullif(total_gt, 0), 0.0::DOUBLE) AS recall, coalesce(100.0::DOUBLE * (total_consistent + total_conflict) / nullif(total_llm, 0), 0.0::DOUBLE) AS overall_precision,
  coalesce(100.0::DOUBLE * (total_consistent + total_conflict) / nullif(total_llm - total_new_found - total_new, 0), 0.0::DOUBLE) AS evaluable_precision, coalesce(100.0::DOUBLE * total_consistent / nullif(total_consistent + total_conflict, 0), 0.0::DOUBLE) AS direction_accuracy FROM m)"""


@query("edge_metrics", f"{_METRICS}\nSELECT * FROM metrics")
def edge_metrics(spark, d):
    return V.evaluate(view(spark, d, "pred"), _truth(spark, d), _docs(spark, d))


_LINES = [
    ("Documents", "total_pmids::VARCHAR", ""), ("Curated edges", "total_gt::VARCHAR", "of the evaluated documents"), ("Extracted edges", "total_llm::VARCHAR", "all predictions"),
    ("Recall", "printf('%d/%d = %.1f%%', total_matched_gt, total_gt, recall)", "curated edges that were found, each once"),
    ("Overall precision", "printf('%d/%d = %.1f%%', total_consistent + total_conflict, total_llm, overall_precision)", "predictions that match a curated pair"),
    ("Evaluable precision", "printf('%d/%d = %.1f%%', total_consistent + total_conflict, total_llm - total_new_found - total_new, evaluable_precision)", "without new ones, of predictions that can be judged"),
    ("Direction accuracy", "printf('%d/%d = %.1f%%', total_consistent, total_consistent + total_conflict, direction_accuracy)", "of matched pairs, those with the curated direction"),
    ("Consistent", "total_consistent::VARCHAR", "names and direction match"), ("Conflict", "total_conflict::VARCHAR", "names match, the direction differs"),
    ("New found", "total_new_found::VARCHAR", "the document has curated edges, but not this one"), ("Missed", "total_missed::VARCHAR", "curated edges that were not extracted"), ("New", "total_new::VARCHAR", "the document has no curated edge"),
]


@query("report_summary", f"{_METRICS}\n" + " UNION ALL ".join(f"SELECT {i}::INTEGER AS ord, '{m}' AS metric, {v} AS value, '{n}' AS note FROM metrics" for i, (m, v, n) in enumerate(_LINES)))
def report_summary(spark, d):
    return R.summary_table(edge_metrics(spark, d))


@query("report_comparison", f"""{_KNOWN}, good AS (SELECT pmid FROM edge_docs WHERE error IS NULL),
{_CLASSIFIED}
SELECT pmid, tf, target, coalesce(truth_direction, '-') AS truth_direction, direction, CASE WHEN confidence = '0' THEN '-' ELSE confidence END AS confidence, evidence, status FROM c JOIN good USING (pmid)
UNION ALL SELECT pmid, tf, target, direction, 'N/A', '-', '-', 'Missed' FROM truth t JOIN good USING (pmid) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.pmid = t.pmid AND c.truth_ord = t.ord)
UNION ALL SELECT pmid, NULL, NULL, NULL, NULL, NULL, NULL, 'ERROR: ' || error FROM edge_docs WHERE error IS NOT NULL""")
def report_comparison(spark, d):
    return R.comparison_table(view(spark, d, "pred"), _truth(spark, d), view(spark, d, "edge_docs"))


@query("report_headers", ctes("truth", "edge_docs", "abstracts") + """, r AS (SELECT pmid, string_agg(tf || '→' || target || ' (' || direction || ')', '; ' ORDER BY ord) AS reference FROM truth WHERE direction <> 'Unknown' GROUP BY pmid)
SELECT e.pmid, coalesce(reference, '(none)') AS reference, coalesce(abstract, 'Not found') AS abstract FROM edge_docs e LEFT JOIN r USING (pmid) LEFT JOIN abstracts a USING (pmid)""")
def report_headers(spark, d):
    return R.doc_headers(view(spark, d, "edge_docs"), _truth(spark, d), view(spark, d, "abstracts"))


@query("relation_counts", ctes("pred", "edge_docs") + "\nSELECT e.pmid, count(p.pos) AS n FROM edge_docs e LEFT JOIN pred p USING (pmid) GROUP BY e.pmid")
def relation_counts(spark, d):
    return V.relation_counts(view(spark, d, "edge_docs"), view(spark, d, "pred"))


_IDS = r"SELECT tf, target, direction, ord, unnest(list_filter(list_transform(string_split(pmid, ';'), lambda x: trim(x)), lambda x: regexp_matches(x, '^\d+$'))) AS pmid FROM edge_lists"


@query("explode_doc_ids", ctes("edge_lists") + "\n" + _IDS)
def explode_doc_ids(spark, d):
    return E.explode_doc_ids(view(spark, d, "edge_lists"))


@query("first_doc_id", ctes("edge_lists") + "\nSELECT tf, target, direction, ord, trim(string_split(pmid, ';')[1]) AS pmid FROM edge_lists WHERE trim(string_split(pmid, ';')[1]) <> ''")
def first_doc_id(spark, d):
    return E.with_first_doc_id(view(spark, d, "edge_lists"))


@query("clean_doc_ids", ctes("edge_lists") + f"\nSELECT DISTINCT pmid FROM ({_IDS})")
def clean_doc_ids(spark, d):
    return E.clean_doc_ids(view(spark, d, "edge_lists"))


@query("directions", ctes("pred", "truth") + f"\nSELECT pmid, {norm('direction')} AS direction, count(*) AS n FROM (SELECT pmid, direction FROM pred UNION ALL SELECT pmid, direction FROM truth WHERE lower(direction) <> 'unknown') GROUP BY ALL")
def directions(spark, d):
    both = view(spark, d, "pred").select("pmid", "direction").unionByName(E.drop_unknown(view(spark, d, "truth")).select("pmid", "direction"))
    return both.groupBy("pmid", T.normalize_direction("direction").alias("direction")).agg(F.count(F.lit(1)).alias("n"))


@query("pack_edges", ctes("truth") + "\nSELECT pmid, count(*) AS n, string_agg(tf || '->' || target || '(' || direction || ')', '; ' ORDER BY ord) AS relationships FROM truth GROUP BY pmid")
def pack_edges(spark, d):
    return E.edges_by_doc(view(spark, d, "truth"))


@query("pack_pieces", ORACLES["pack_edges"])
def pack_pieces(spark, d):
    """The same from pieces of two edges."""
    return P.joined(P.edge_pieces(view(spark, d, "truth"), 2))


@query("unpack_edges", ctes("truth") + ", k AS (SELECT *, row_number() OVER (PARTITION BY pmid ORDER BY ord) - 1 AS pos FROM truth WHERE direction <> 'Unknown')\nSELECT pmid, pos AS ord, tf, target, direction FROM k")
def unpack_edges(spark, d):
    from curatrix.sources.readers import unpack_by_doc

    return unpack_by_doc(E.edges_by_doc(view(spark, d, "truth")))


@query("latest_direction", ctes("truth") + "\nSELECT pmid, tf, target, arg_max(direction, ord) AS direction FROM truth GROUP BY pmid, tf, target")
def latest_direction(spark, d):
    return E.latest_direction(view(spark, d, "truth"))


@query("ground_truth", ctes("truth") + ", a AS (SELECT * FROM truth WHERE direction <> 'Unknown')\nSELECT * FROM a UNION ALL SELECT * FROM truth WHERE pmid NOT IN (SELECT pmid FROM a)")
def ground_truth(spark, d):
    return E.resolve_ground_truth(_truth(spark, d), view(spark, d, "truth"))


@query("sample_docs", ctes("truth", "abstracts") + ", s AS (SELECT DISTINCT pmid FROM truth ORDER BY md5('7' || pmid), pmid LIMIT 50)\nSELECT t.*, coalesce(a.abstract, 'Abstract not found in PubMed') AS abstract FROM truth t JOIN s USING (pmid) LEFT JOIN abstracts a USING (pmid)")
def sample_docs(spark, d):
    return E.attach_abstract(E.sample_docs(view(spark, d, "truth"), 50, "7"), view(spark, d, "abstracts"))


def _pred(spark, d):
    return view(spark, d, "pred").withColumn("confidence", T.confidence_band("confidence"))


@query("dedupe_edges", ctes("pred") + "\nSELECT pmid, pos, tf, target, direction, cast(confidence AS int) AS confidence, evidence FROM pred QUALIFY row_number() OVER (PARTITION BY pmid, tf, target ORDER BY cast(confidence AS int) DESC, pos) = 1")
def dedupe_edges(spark, d):
    return E.dedupe_edges(_pred(spark, d))


@query("top_edges", ctes("pred") + "\nSELECT pmid, pos, tf, target, direction, cast(confidence AS int) AS confidence, evidence FROM pred WHERE cast(confidence AS int) >= 2 QUALIFY row_number() OVER (PARTITION BY pmid ORDER BY cast(confidence AS int) DESC, pos) <= 3")
def top_edges(spark, d):
    return E.top_edges(_pred(spark, d), k=3)


@query("edge_rules", ctes("pred") + f""", p AS (SELECT pmid, pos, CASE WHEN tf = 'TF7' THEN 'akt' WHEN tf = 'TF8' THEN 'MLL-AF9' ELSE tf END AS tf, CASE WHEN pos % 4 = 0 THEN tf ELSE target END AS target, CASE WHEN pos % 5 = 0 THEN 'Regulation' ELSE direction END AS direction, evidence FROM pred),
g AS (SELECT * FROM p WHERE upper(tf) <> 'AKT' AND {norm('direction')} IN ('Activation', 'Repression') AND (tf <> target OR evidence = 'regulates its own expression'))
SELECT pmid, pos, unnest(CASE WHEN tf = 'MLL-AF9' THEN ['KMT2A', 'MLLT3'] ELSE [tf] END) AS tf, target, {norm('direction')} AS direction,
  CASE WHEN evidence LIKE 'ChIP%' THEN 5 WHEN evidence LIKE 'EMSA%' THEN 4 WHEN evidence LIKE 'functional%' THEN 3 WHEN evidence LIKE '%speculate%' THEN 1 ELSE 2 END AS confidence FROM g""")
def edge_rules(spark, d):
    p = view(spark, d, "pred").select("pmid", "pos", F.expr("CASE WHEN tf = 'TF7' THEN 'akt' WHEN tf = 'TF8' THEN 'MLL-AF9' ELSE tf END").alias("tf"), F.expr("CASE WHEN pos % 4 = 0 THEN tf ELSE target END").alias("target"), F.expr("CASE WHEN pos % 5 = 0 THEN 'Regulation' ELSE direction END").alias("direction"), "evidence")
    fusions = spark.createDataFrame([("MLL-AF9", ["KMT2A", "MLLT3"])], "fusion string, partners array<string>")
    out = E.split_fusions(E.guard_self_edges(E.valid_direction(E.exclude_regulators(p))), fusions)
    return out.select("pmid", "pos", "tf", "target", "direction", T.evidence_confidence("evidence").alias("confidence"))
