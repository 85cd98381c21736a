"""Stand-in tables over the driver's tables: the same SQL text in Spark and in the oracle, but that Spark numbers line items before it derives their columns.

truth and pred are edge tables from line items, genes a dictionary from parts, and so on. Each reads all rows of its table,
but for `ensg` and `edits`, whose gaps are what their queries are about: symbols without an id, documents without an edit.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from curatrix.sources.shared import dealt

_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
_ORD = f"cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS bigint)"
_EVIDENCE = "CASE cast(l_quantity AS int) % 6 WHEN 0 THEN 'ChIP, luciferase reporter and mutagenesis' WHEN 1 THEN 'EMSA with knockdown' WHEN 2 THEN 'functional assay' WHEN 3 THEN 'authors speculate' WHEN 4 THEN 'regulates its own expression' ELSE 'mentioned' END"

VIEWS = {
    "truth": f"""SELECT cast(l_orderkey AS string) AS pmid, 'TF' || cast(l_suppkey % 40 AS string) AS tf,
  'GN' || cast(l_partkey % 60 AS string) || CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN 'A' ELSE 'B' END AS target,
  CASE l_returnflag WHEN 'A' THEN 'Activation' WHEN 'R' THEN 'Repression' ELSE 'Unknown' END AS direction, {_ORD} AS ord FROM lineitem""",
    "pred": f"""SELECT cast(l_orderkey AS string) AS pmid, {_ORD} AS pos, 'TF' || cast(l_suppkey % 40 AS string) AS tf,
  'GN' || cast(l_partkey % 60 + CASE WHEN l_suppkey % 3 = 0 THEN 60 ELSE 0 END AS string) || CASE l_linenumber % 2 WHEN 0 THEN '' ELSE 'C' END AS target,
  CASE WHEN l_discount < 0.05 THEN 'Synergistic Activation' ELSE 'inhibition' END AS direction,
  cast(l_linenumber % 6 AS string) AS confidence, {_EVIDENCE} AS evidence FROM lineitem""",
    "edge_lists": """SELECT tf, target, direction, ord, CASE WHEN ord % 3 = 0 THEN pmid || ';' || pmid || '1; x ;' ELSE pmid || '; 7' || pmid END AS pmid FROM truth""",
    "edge_docs": """SELECT DISTINCT pmid, CASE WHEN cast(pmid AS bigint) % 17 = 0 THEN 'parse_fail' END AS error FROM truth""",
    "anomalies": """SELECT cast(o_orderkey - o_orderkey % 3 AS string) AS pmid, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'phantom_gene' WHEN '2' THEN 'indirect_chain' WHEN '3' THEN 'wrong_direction' WHEN '4' THEN 'other' ELSE 'odd' END AS anomaly_type,
  CASE WHEN o_custkey % 5 = 0 THEN 'TF1 GN1' ELSE 'TF' || cast(o_custkey % 40 AS string) || '->GN' || cast(o_orderkey % 60 AS string) || ' (Activation)' END AS trrust_entry,
  CASE WHEN o_custkey % 7 = 0 THEN ' ' ELSE 'issue of order ' || cast(o_orderkey AS string) || ' with status ' || o_orderstatus || ' and priority ' || o_orderpriority || ' that needs a look by a curator' END AS issue,
  cast(NULL AS string) AS corrected, cast(NULL AS date) AS curated_date FROM orders""",
    "genes": """SELECT 'SYM' || cast(p_partkey AS string) AS symbol, p_name || '|"al-' || cast(p_partkey AS string) || '"|SYM' || cast(p_partkey AS string) AS alias_symbol,
  p_brand AS prev_symbol, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'ENSG' || cast(p_partkey AS string) END AS ensembl_gene_id, cast(p_partkey AS bigint) AS ord FROM part""",
    "names": """SELECT DISTINCT CASE p_partkey % 8 WHEN 0 THEN 'Sym' || cast(p_partkey AS string) WHEN 1 THEN ' al' || cast(p_partkey AS string) || ' ' WHEN 2 THEN 'AL-' || cast(p_partkey AS string) || ' (x)' WHEN 3 THEN p_name
  WHEN 4 THEN 'nope' || cast(p_partkey AS string) WHEN 5 THEN p_brand WHEN 6 THEN '(x)' ELSE p_type END AS name, CASE p_partkey % 3 WHEN 0 THEN 'tf' WHEN 1 THEN 'target' ELSE 'gene' END AS role FROM part""",
    "override_rows": """SELECT cast(p_partkey AS int) AS ord, CASE p_partkey % 7 WHEN 5 THEN 'nope' || cast(p_partkey - 1 AS string) WHEN 6 THEN 'Al-' || cast(p_partkey - p_partkey % 10 AS string) ELSE 'al-' || cast(p_partkey + 1 AS string) END AS alias,
  CASE WHEN p_partkey % 7 = 0 OR p_partkey % 35 = 3 THEN '' ELSE ' sym' || cast(p_partkey % 50 AS string) END AS symbol,
  CASE p_partkey % 7 WHEN 0 THEN 'tf' WHEN 1 THEN ' Target' WHEN 2 THEN 'tf,target' WHEN 3 THEN 'all' WHEN 4 THEN '' WHEN 5 THEN 'target,tf' ELSE 'gene' END AS roles,
  CASE WHEN p_partkey % 7 = 0 OR p_partkey % 35 = 3 THEN 'Block' WHEN p_partkey % 2 = 0 THEN 'map' END AS action, p_type AS reason, CASE WHEN p_partkey % 14 = 0 THEN p_brand END AS candidate FROM part""",
    "lexicon": """SELECT 'GN' || cast(p_partkey % 60 AS string) AS symbol, 'TF' || CASE WHEN p_partkey % 60 < 20 THEN cast(p_partkey % 60 AS string) ELSE '3' || cast(p_partkey % 10 AS string) END AS alias_symbol,
  '' AS prev_symbol, '' AS ensembl_gene_id, cast(p_partkey AS bigint) AS ord FROM part""",
    "abstracts": """SELECT cast(doc_id AS string) AS pmid, text AS abstract FROM documents""",
    "ensg": """SELECT 'GN' || cast(s_suppkey AS string) AS symbol, 'ENSG' || cast(s_suppkey AS string) AS ensg FROM supplier WHERE s_suppkey % 3 <> 0""",
    "track_lines": """SELECT 'chr1' || chr(9) || '100' || chr(9) || CASE WHEN s_suppkey % 4 = 0 THEN 'DNASE' ELSE 'CHIP' END || ':tf' || cast(s_suppkey % 40 AS string) || ':K562' AS value FROM supplier""",
    "state": """SELECT cast(doc_id AS string) AS pmid, CASE quality WHEN 1 THEN 'Activation' ELSE '' END AS direction, 'K562' AS cellline, CASE toxic WHEN 1 THEN 'ChIP' ELSE '' END AS assay, '' AS notes,
  quality = 1 AND toxic = 1 AS reviewed FROM labels""",
    "edits": """SELECT cast(doc_id AS string) AS pmid, cast(NULL AS string) AS direction, cast(NULL AS string) AS cellline, 'EMSA' AS assay, cast(NULL AS string) AS notes FROM labels WHERE toxic = 0""",
    "review_rows": f"""SELECT cast(l_orderkey AS string) AS pmid, {_ORD} AS ord, CASE WHEN l_linenumber % 3 = 1 THEN '' WHEN l_returnflag = 'A' THEN 'Activation' WHEN l_returnflag = 'R' THEN 'Repression' ELSE '' END AS direction,
  'cell' || cast(l_suppkey % 9 AS string) AS cellline, 'assay' || cast(l_partkey % 5 AS string) AS assay FROM lineitem""",
    "turns": """SELECT cast(conv_id AS string) || '-' || cast(turn AS string) AS pmid, text FROM conversations""",
}
_USES = {k: [t for t in [*VIEWS, "lineitem", "orders", "part", "supplier", "documents", "labels", "conversations"] if re.search(rf"\b(FROM|JOIN) {t}\b", v)] for k, v in VIEWS.items()}


def view(spark: SparkSession, sf_dir: str, name: str, task_rows: int | None = None) -> DataFrame:
    """A stand-in table, or one of the driver's. With task_rows line items are dealt to that many a task, on average, where Spark would deal more."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text, tables = VIEWS[name], {t: view(spark, sf_dir, t) for t in _USES[name]}
    if _ORD in text:
        # Line items are dealt once, by pmid, for ord, with their own columns only: every view of them shares that exchange, and what goes by pmid needs no other.
        text = text.replace(_ORD, "_ord").replace("cast(l_orderkey AS string)", "pmid")
        ord_ = _ORD.replace("l_orderkey", "pmid")
        lines = tables["lineitem"].withColumn("pmid", F.col("l_orderkey").cast("string"))
        if task_rows:
            lines = dealt(lines, "pmid", task_rows)
        tables["lineitem"] = spark.sql(f"SELECT *, {ord_} AS _ord FROM {{lines}}", lines=lines)
    return spark.sql(re.sub(r"\b(FROM|JOIN) (" + "|".join(_USES[name]) + r")\b", r"\1 {\2}", text), **tables)


def ctes(*names: str) -> str:
    """A WITH clause that defines the stand-ins for the oracle."""
    order: list[str] = []

    def add(n: str) -> None:
        for t in _USES[n]:
            if t in VIEWS:
                add(t)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overrides of parts: mapped, blocked, for one role, for all, without roles, repeated."""
    named = F.when(F.col("candidate").isNotNull(), F.array(F.struct(F.col("candidate").alias("symbol"))))
    roles = F.filter(F.split("roles", ","), lambda r: r != "")
    return view(spark, sf_dir, "override_rows").select("ord", "alias", "symbol", roles.alias("roles"), "action", "reason", named.alias("candidates"))


def overrides_cte() -> str:
    return ctes("override_rows").removeprefix("WITH ") + """,
ovr AS (SELECT ord, alias, symbol, list_filter(string_split(roles, ','), lambda r: r <> '') AS roles, lower(coalesce(action, 'map')) AS action, reason, candidate FROM override_rows)"""


# ---- the oracle's own words for the text rules ---------------------------------------------------------


def iso(c: str) -> str:
    return rf"regexp_replace({c}, '^(.+\d)[A-Z]$', '\1')"


def norm(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR {c} = '' THEN '' WHEN lower({c}) LIKE '%activation%' THEN 'Activation' WHEN lower({c}) LIKE '%repression%' OR lower({c}) LIKE '%inhibition%' THEN 'Repression' ELSE trim({c}) END"


def clean(c: str) -> str:
    return rf"trim(regexp_replace(upper(trim(coalesce({c}, ''))), '\(.*?\)', '', 'g'))"


def compact(c: str) -> str:
    return rf"regexp_replace({clean(c)}, '[\s/\-]+', '', 'g')"
