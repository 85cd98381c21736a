"""Queries that write a table through a sink to a fresh folder, and read it through the source."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.operators import aliases as A, curation as C, edges as E, extract as X, pieces as P, report as R
from curatrix.operators.anomaly_log import AnomalyLog
from curatrix.sources import json_object as J, readers as S, writers as K
from curatrix.sources.shared import fresh, stored

from .text_queries import _NAMED, _SECT_CTE, _labelled, _responses, _sectioned
from .edge_queries import _METRICS, _LINES, edge_metrics
from .gene_queries import _BAD, _CAND, ORACLES as _GENES
from .views import ctes, overrides, view

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def written(df, spark, **options) -> str:
    """df as a tab-separated table without header, as a user would have it."""
    path = fresh(spark)
    df.write.options(sep="\t", quote="", **options).csv(path)
    return path


@query("file_edges", ctes("edge_lists") + "\nSELECT tf, target, direction, trim(pmid) AS pmid FROM edge_lists")
def file_edges(spark, d):
    """Curated edges, with a ragged line after each, which the source drops."""
    edges = view(spark, d, "edge_lists").select(F.concat_ws("\t", "tf", "target", "direction", "pmid").alias("line"), F.concat("tf", F.lit("\tshort")).alias("short"))
    path = fresh(spark)
    edges.select(F.explode(F.array("line", "short")).alias("value")).write.text(path)
    return S.read_edges(spark, path).drop("ord")


@query("file_packed", ctes("truth") + ", k AS (SELECT *, row_number() OVER (PARTITION BY pmid ORDER BY ord) - 1 AS pos FROM truth WHERE direction <> 'Unknown')\nSELECT pmid, pos AS ord, tf, target, direction FROM k")
def file_packed(spark, d):
    path = fresh(spark)
    K.write_edges_by_doc(E.edges_by_doc(view(spark, d, "truth")), path)
    return S.read_edges_by_doc(spark, path)


@query("file_dictionary", ctes("genes") + "\nSELECT symbol, alias_symbol, prev_symbol, nullif(ensembl_gene_id, '') AS ensembl_gene_id FROM genes")
def file_dictionary(spark, d):
    return S.read_gene_dictionary(spark, written(view(spark, d, "genes").withColumn("other", F.lit("x")), spark, header=True, emptyValue="")).drop("ord")


@query("file_gold", ctes("truth") + "\nSELECT pmid, upper(tf) AS tf, upper(target) AS target FROM truth")
def file_gold(spark, d):
    return S.read_gold_pairs(spark, written(view(spark, d, "truth").select("pmid", F.lower("tf").alias("tf"), F.concat("target", F.lit(" ")).alias("target")), spark)).drop("ord")


@query("file_track", ctes("track_lines") + "\nSELECT DISTINCT upper(split_part(split_part(value, chr(9), 3), ':', 2)) AS tf FROM track_lines WHERE split_part(value, chr(9), 3) LIKE 'CHIP:%'")
def file_track(spark, d):
    path = fresh(spark)
    view(spark, d, "track_lines").write.text(path)
    return S.read_track_tfs(spark, path)


@query("file_anomalies", ctes("anomalies") + "\nSELECT pmid, anomaly_type, trrust_entry, issue FROM anomalies")
def file_anomalies(spark, d):
    """The log in two appends, with a row without pmid in each, which the source drops."""
    path, log = fresh(spark), view(spark, d, "anomalies")
    for part in (log.where("anomaly_type = 'other'"), log.where("anomaly_type <> 'other'")):
        K.write_anomalies(part.unionByName(part.limit(1).withColumn("pmid", F.lit(" "))), path)
    return S.read_anomalies(spark, path).drop("corrected", "curated_date")


@query("file_overrides", ctes("genes") + "\nSELECT ord::INTEGER AS ord, alias_symbol AS alias, symbol, CASE WHEN ensembl_gene_id = '' THEN 'all' ELSE 'tf,target' END AS roles, CASE WHEN ensembl_gene_id = '' THEN 'block' ELSE 'map' END AS action, prev_symbol AS reason FROM genes")
def file_overrides(spark, d):
    none = F.col("ensembl_gene_id") == ""
    rows = view(spark, d, "genes").select(F.col("ord").cast("int").alias("ord"), F.col("alias_symbol").alias("alias"), "symbol", F.when(none, F.array(F.lit(" All"))).otherwise(F.array(F.lit("TF"), F.lit("target"))).alias("roles"), F.when(none, "Block").alias("action"), F.col("prev_symbol").alias("reason"), F.lit(None).cast("array<struct<symbol:string>>").alias("candidates"))
    path = fresh(spark)
    K.write_overrides(rows, path)
    return S.read_overrides(spark, path, rows=True).withColumn("roles", F.array_join("roles", ",")).drop("candidates")


@query("file_alias_index", _CAND + ", o AS (SELECT DISTINCT symbol FROM (SELECT trim(upper(symbol)) AS symbol FROM genes) WHERE symbol <> '')\nSELECT key, symbol, array_to_string(sources, ',') AS sources, symbol IN (SELECT symbol FROM o) AS official FROM cand")
def file_alias_index(spark, d):
    genes, path = view(spark, d, "genes"), fresh(spark)
    K.write_alias_index({"candidates": A.build_alias_candidates(genes), "official": A.official_symbols(genes)}, path)
    candidates, official = S.read_alias_index(spark, path, rows=True)
    out = candidates.join(official.withColumn("official", F.lit(True)), "symbol", "left")
    return out.select("key", "symbol", F.array_join("sources", ",").alias("sources"), F.coalesce("official", F.lit(False)).alias("official"))


@query("file_ensg_map", ctes("genes") + "\nSELECT upper(trim(symbol)) AS symbol, arg_max(ensembl_gene_id, ord) AS ensg FROM genes WHERE ensembl_gene_id <> '' GROUP BY 1")
def file_ensg_map(spark, d):
    path = fresh(spark)
    K.write_ensg_map(A.build_ensg_map(view(spark, d, "genes")), path)
    return S.read_ensg_map(spark, path, rows=True)


@query("file_excluded", ctes("anomalies") + "\nSELECT DISTINCT pmid FROM anomalies")
def file_excluded(spark, d):
    path = fresh(spark)
    K.write_excluded(view(spark, d, "anomalies"), path)
    return spark.read.schema("pmid string").json(path)


@query("file_blocks", _SECT_CTE + "\nSELECT pmid, CASE kind WHEN 1 THEN '[BACKGROUND]' || chr(10) || a || chr(10) || chr(10) || '[Significance]' || chr(10) || b WHEN 2 THEN '[RESULTS]' || chr(10) || a || chr(10) || chr(10) || '[METHODS]' || chr(10) || a ELSE flat END AS abstract, 'TF' || pmid AS tf FROM d")
def file_blocks(spark, d):
    path = fresh(spark)
    K.write_document_blocks(_labelled(_sectioned(spark, d)), path)
    return S.read_document_blocks(spark, path, drop_rule=True).select("pmid", "abstract", F.col("edges")[0]["tf"].alias("tf"))


@query("file_articles", _SECT_CTE + "\nSELECT pmid, CASE kind WHEN 1 THEN NULL WHEN 0 THEN flat ELSE a || ' ' || b END AS abstract, CASE kind WHEN 1 THEN 'BACKGROUND=' || a || '|[Odd]=' || b ELSE '' END AS sections FROM d")
def file_articles(spark, d):
    """XML articles: labelled parts, one part, or two without a label."""
    part = lambda label, c: F.struct(F.lit(label).cast("string").alias("_Label"), F.col(c).alias("_VALUE"))
    parts = F.when(F.col("kind") == 1, F.array(part("Background", "a"), part("Odd", "b"))).when(F.col("kind") == 0, F.array(part(None, "flat"))).otherwise(F.array(part(None, "a"), part(None, "b")))
    article = F.struct(F.col("pmid").alias("PMID"), F.struct(F.struct(parts.alias("AbstractText")).alias("Abstract")).alias("Article"))
    path = fresh(spark)
    _sectioned(spark, d).select(article.alias("MedlineCitation")).write.format("xml").options(rowTag="PubmedArticle", rootTag="PubmedArticleSet").save(path)
    return S.read_articles_xml(spark, path).select("pmid", "abstract", F.array_join(F.transform("sections", lambda s: F.concat_ws("=", s.label, s.text)), "|").alias("sections"))


@query("file_extractions", _NAMED + ", x AS (SELECT pmid, pos - 1 AS pos, tf, target, direction, confidence, evidence FROM pred WHERE cast(pmid AS bigint) % 17 <> 0)\nSELECT x.*, c.n_items, NULL::VARCHAR AS error FROM x JOIN (SELECT pmid, count(*) AS n_items FROM x GROUP BY pmid) c USING (pmid) UNION ALL SELECT DISTINCT pmid, NULL, NULL, NULL, NULL, NULL, NULL, 0, 'parse_fail' FROM pred WHERE cast(pmid AS bigint) % 17 = 0")
def file_extractions(spark, d):
    path = fresh(spark)
    K.write_extractions(*X.parse_json_edges(_responses(spark, d)), path)
    edges, docs = S.read_extractions(spark, path, rows=True)
    return docs.join(edges, "pmid", "left")


@query("file_debug", ctes("turns") + "\nSELECT pmid, text AS round1_analysis, octet_length(encode(text))::INTEGER AS n, 'r-' || pmid AS request_id FROM turns")
def file_debug(spark, d):
    path = fresh(spark)
    K.write_debug(_debug(spark, d), path)
    return S.read_debug(spark, path, rows=True).select("pmid", "round1_analysis", F.col("round1_usage.input_tokens").alias("n"), "round1_usage.request_id")


def _debug(spark, d):
    usage = F.struct(F.concat(F.lit("r-"), "pmid").alias("request_id"), F.octet_length("text").cast("int").alias("input_tokens"), F.lit(1).alias("output_tokens"))
    none = lambda kind: F.lit(None).cast(kind)
    return view(spark, d, "turns").select("pmid", none("string").alias("error"), F.col("text").alias("round1_analysis"), usage.alias("round1_usage"), none("string").alias("round2_raw"), none("string").alias("round2_clean"), none(S.USAGE).alias("round2_usage"))


@query("file_review", ctes("state") + "\nSELECT pmid, direction, cellline, assay, '' AS notes, true AS reviewed FROM state")
def file_review(spark, d):
    path = fresh(spark)
    K.write_review(view(spark, d, "state").select("pmid", F.lit("TF").alias("tf"), F.lit("E").alias("ensg"), "direction", "cellline", "assay"), path)
    return S.read_review(spark, path)


@query("file_report", f"{_METRICS}\n" + " UNION ALL ".join(f"SELECT {i}::INTEGER AS ord, '{m}' AS metric, {v} AS value, '{n}' AS note FROM metrics" for i, (m, v, n) in enumerate(_LINES)))
def file_report(spark, d):
    path = fresh(spark)
    K.write_report({"summary": R.summary_table(edge_metrics(spark, d))}, path)
    return spark.read.parquet(f"{path}/summary")


# ---- the forms in which one object or array fills a file -----------------------------------------------


@query("object_overrides", ORACLES["file_overrides"].replace("ord::INTEGER AS ord", "row_number() OVER (ORDER BY ord)::INTEGER - 1 AS ord"))
def object_overrides(spark, d):
    """An array of objects, without ord, in its order."""
    none = F.col("ensembl_gene_id") == ""
    rows = view(spark, d, "genes").select("ord", F.col("alias_symbol").alias("alias"), "symbol", F.when(none, F.array(F.lit(" All"))).otherwise(F.array(F.lit("TF"), F.lit("target"))).alias("roles"), F.when(none, "Block").alias("action"), F.col("prev_symbol").alias("reason"))
    path = fresh(spark)
    K.write_overrides(rows, path, rows=False)
    return S.read_overrides(spark, path).withColumn("roles", F.array_join("roles", ",")).drop("candidates")


_UNIQUE = _GENES["unique_alias_map"].split("\nSELECT key, symbol FROM single")
_INDEX = _CAND + ", o AS (SELECT DISTINCT symbol FROM (SELECT trim(upper(symbol)) AS symbol FROM genes) WHERE symbol <> '')"


@query("object_alias_index", _INDEX + "\nSELECT key, symbol, array_to_string(sources, ',') AS sources, symbol IN (SELECT symbol FROM o) AS official FROM cand")
def object_alias_index(spark, d):
    """Metadata, official symbols and the candidates of each key, nested in one object."""
    genes, path = view(spark, d, "genes"), fresh(spark)
    candidates = stored(A.build_alias_candidates(genes))
    K.write_alias_index({"candidates": candidates, "official": A.official_symbols(genes), "metadata": A.alias_metadata(genes, candidates, S.normalize_overrides(overrides(spark, d)))}, path, rows=False)
    back, official = S.read_alias_index(spark, f"{path}/index.json")
    out = back.join(official.withColumn("official", F.lit(True)), "symbol", "left")
    return out.select("key", "symbol", F.array_join("sources", ",").alias("sources"), F.coalesce("official", F.lit(False)).alias("official"))


@query("object_legacy_map", f"{_UNIQUE[0]}, u AS (SELECT key, symbol FROM single{_UNIQUE[1]})\nSELECT key, symbol, 'legacy_alias_map' AS sources, 'legacy' AS reason FROM u")
def object_legacy_map(spark, d):
    """The unique map, a flat object, read as the index that is missing and as overrides."""
    genes, path = view(spark, d, "genes"), fresh(spark)
    candidates, over = stored(A.build_alias_candidates(genes)), S.normalize_overrides(overrides(spark, d))
    K.write_alias_index({"candidates": candidates, "official": A.official_symbols(genes), "unique": A.unique_alias_map(candidates, over)}, path, rows=False)
    back, official = S.read_alias_index(spark, f"{path}/missing.json", f"{path}/unique.json")
    flat = S.read_overrides(spark, f"{path}/unique.json").select(F.col("alias").alias("key"), "symbol", "reason")
    return back.join(official, "symbol", "left_semi").join(flat, ["key", "symbol"]).select("key", "symbol", F.array_join("sources", ",").alias("sources"), "reason")


@query("object_ensg_map", ORACLES["file_ensg_map"])
def object_ensg_map(spark, d):
    path = fresh(spark)
    K.write_ensg_map(A.build_ensg_map(view(spark, d, "genes")), path, rows=False)
    return S.read_ensg_map(spark, path)


@query("object_excluded", ctes("anomalies") + "\nSELECT pmid, row_number() OVER (ORDER BY pmid) - 1 AS ord FROM (SELECT DISTINCT pmid FROM anomalies)")
def object_excluded(spark, d):
    """A sorted array of strings, with their places in it."""
    path = fresh(spark)
    K.write_excluded(view(spark, d, "anomalies"), path, rows=False)
    return J.read_entries(spark, path).select(S.json_text("value").alias("pmid"), "ord")


@query("object_extractions", ORACLES["file_extractions"])
def object_extractions(spark, d):
    """An object of pmid to array of edges, or to an object with the error."""
    path = fresh(spark)
    K.write_extractions(*X.parse_json_edges(_responses(spark, d)), path, rows=False)
    edges, docs = S.read_extractions(spark, path)
    return docs.join(edges, "pmid", "left")


@query("object_debug", ORACLES["file_debug"])
def object_debug(spark, d):
    path = fresh(spark)
    K.write_debug(_debug(spark, d), path, rows=False)
    return S.read_debug(spark, path).select("pmid", "round1_analysis", F.col("round1_usage.input_tokens").alias("n"), "round1_usage.request_id")


# ---- documents in pieces -------------------------------------------------------------------------------


@query("file_packed_pieces", ORACLES["file_packed"])
def file_packed_pieces(spark, d):
    """Packed edges whose lines are written piece by piece, three edges to each at most."""
    path = fresh(spark)
    K.write_edge_pieces(P.edge_pieces(view(spark, d, "truth"), 3), path)
    return S.read_edges_by_doc(spark, path)


# ---- order: the rank of what was written, by file and place in it, against the rank that was asked for ---


def _ranked(df, *columns):
    """The columns and the number, from 1 on, of rows read with ord."""
    return C.numbered(df, ["ord"]).select(*columns, "number")


@query("order_packed", ctes("truth") + "\nSELECT pmid, row_number() OVER (ORDER BY cast(pmid AS bigint)) AS number FROM (SELECT DISTINCT pmid FROM truth)")
def order_packed(spark, d):
    """Packed edges by document stand in numeric order."""
    path = fresh(spark)
    K.write_edges_by_doc(E.edges_by_doc(view(spark, d, "truth")), path)
    return _ranked(S.read_tsv(spark, path, "pmid string, n int, edges string", header=True), "pmid")


@query("order_ensg_map", ORACLES["file_ensg_map"].replace("SELECT upper", "SELECT symbol, ensg, row_number() OVER (ORDER BY symbol) AS number FROM (SELECT upper", 1) + ")")
def order_ensg_map(spark, d):
    path = fresh(spark)
    K.write_ensg_map(A.build_ensg_map(view(spark, d, "genes")), path)
    return _ranked(spark.read.schema("symbol string, ensg string").json(path).select("*", S.file_order().alias("ord")), "symbol", "ensg")


@query("order_excluded", ctes("anomalies") + "\nSELECT pmid, row_number() OVER (ORDER BY pmid) AS number FROM (SELECT DISTINCT pmid FROM anomalies)")
def order_excluded(spark, d):
    """Excluded documents stand in the order of strings."""
    path = fresh(spark)
    K.write_excluded(view(spark, d, "anomalies"), path)
    return _ranked(spark.read.schema("pmid string").json(path).select("*", S.file_order().alias("ord")), "pmid")


@query("order_by_doc", ctes("abstracts") + ", n AS (SELECT CASE WHEN cast(pmid AS bigint) % 5 = 0 THEN 'PMC' || pmid ELSE pmid END AS pmid FROM abstracts)\nSELECT pmid, row_number() OVER (ORDER BY try_cast(pmid AS bigint) NULLS FIRST, pmid) AS number FROM n")
def order_by_doc(spark, d):
    """Ids that are numbers in their order, after those that are none."""
    ids = view(spark, d, "abstracts").select(F.when(F.col("pmid").cast("long") % 5 == 0, F.concat(F.lit("PMC"), "pmid")).otherwise(F.col("pmid")).alias("pmid"))
    path = fresh(spark)
    E.order_by_doc(ids).write.text(path)
    return _ranked(spark.read.text(path).select(F.col("value").alias("pmid"), S.file_order().alias("ord")), "pmid")


_LOGGED = ctes("anomalies") + ", n AS (SELECT *, row_number() OVER (ORDER BY anomaly_type <> 'other', pmid, trrust_entry, issue) AS k FROM anomalies)"


@query("rewrite_anomalies", _LOGGED + "\nSELECT pmid, trrust_entry, issue, row_number() OVER (ORDER BY k) AS number FROM n WHERE k <> 3")
def rewrite_anomalies(spark, d):
    """A log of two appends, from which the third row is removed; it then stands in its old order."""
    log, rows = AnomalyLog(spark, fresh(spark)), view(spark, d, "anomalies")
    for part in (rows.where("anomaly_type = 'other'"), rows.where("anomaly_type <> 'other'")):
        log.append(part.orderBy("pmid", "trrust_entry", "issue"))
    log.remove(3)
    return log.listed().select("pmid", "trrust_entry", "issue", "number")


@query("append_log", _LOGGED + rf""", c AS (SELECT *, {_BAD} AS reject_reason FROM n WHERE anomaly_type <> 'other')
SELECT pmid, trrust_entry, issue, reject_reason, CASE WHEN reject_reason IS NULL THEN row_number() OVER (PARTITION BY reject_reason IS NULL ORDER BY k) + (SELECT count(*) FROM n WHERE anomaly_type = 'other') END AS number FROM c
UNION ALL SELECT pmid, trrust_entry, issue, NULL, k FROM n WHERE anomaly_type = 'other'""")
def append_log(spark, d):
    """Rows that can be accepted follow the log; the others come with their reason. Who has read the first version keeps it."""
    log, rows = AnomalyLog(spark, fresh(spark)), view(spark, d, "anomalies").orderBy("pmid", "trrust_entry", "issue")
    log.append(rows.where("anomaly_type = 'other'"))
    rejected = log.add(rows.where("anomaly_type <> 'other'"))
    kept = log.listed().select("pmid", "trrust_entry", "issue", F.lit(None).cast("string").alias("reject_reason"), "number")
    return kept.unionByName(rejected.select("pmid", "trrust_entry", "issue", "reject_reason", F.lit(None).cast("long").alias("number")))


@query("sample_many", ctes("truth") + f", s AS (SELECT DISTINCT pmid FROM truth), k AS (SELECT pmid, row_number() OVER (ORDER BY md5('9' || pmid), pmid) AS k, count(*) OVER () AS n FROM s)\nSELECT t.* FROM truth t JOIN k USING (pmid) WHERE k * 3 <= n")
def sample_many(spark, d):
    """A third of all documents, by counts of hash prefixes."""
    truth = view(spark, d, "truth")
    return E.sample_docs(truth, E.distinct_docs(truth).count() // 3, "9")
