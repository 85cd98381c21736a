"""Sources. Each has an explicit schema, but for the dictionary, of which the named columns are read; order within files becomes an `ord` column where it matters.

What is kept as one JSON object or array in a file is read by many tasks, each a range of its bytes (`json_object`). With rows=True
the other form is read, a JSON row for each entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from curatrix.functions import text as T
from curatrix.sources import json_object as J
from curatrix.sources.shared import stored

EDGES = "tf string, target string, direction string, pmid string"
OVERRIDES = "ord int, alias string, symbol string, roles array<string>, action string, reason string, candidates array<struct<symbol:string>>"
USAGE = "struct<request_id:string,input_tokens:int,output_tokens:int>"
DEBUG = f"struct<error:string,round1_analysis:string,round1_usage:{USAGE},round2_raw:string,round2_clean:string,round2_usage:{USAGE}>"
ANOMALIES = "pmid string, anomaly_type string, trrust_entry string, issue string, corrected string, curated_date date"


def file_order() -> Column:
    """A value that ascends with the lines of a source, file by file: however files are split and their parts dealt out."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))


def drop_ragged(df: DataFrame, n: int) -> DataFrame:
    """Without the rows that have fewer than n fields (the n-th column is NULL in them)."""
    return df.where(F.col(df.columns[n - 1]).isNotNull())


def read_tsv(spark: SparkSession, path: str, schema: str, header: bool = False) -> DataFrame:
    """The fields of a table, then ord."""
    return spark.read.schema(schema).options(sep="\t", header=header, quote="", encoding="UTF-8").csv(path).select("*", file_order().alias("ord"))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """The curated edge table (four columns without header), with ord."""
    df = drop_ragged(read_tsv(spark, path, EDGES), 4)
    return df.select(*[T.strip(c).alias(c) for c in df.columns if c != "ord"], "ord")


def read_edges_by_doc(spark: SparkSession, path: str) -> DataFrame:
    """pmid, ord, tf, target, direction of the packed table; unknown and malformed edges are dropped."""
    df = drop_ragged(read_tsv(spark, path, "PMID string, Relationship_Count int, Relationships string", header=True), 3)
    return unpack_by_doc(df.select(T.strip("PMID").alias("pmid"), F.col("Relationships").alias("relationships")))


def unpack_by_doc(df: DataFrame) -> DataFrame:
    return df.select("pmid", F.posexplode(T.unpack_edges("relationships")).alias("ord", "e")).select("pmid", "ord", "e.*")


def read_gene_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """symbol, alias_symbol, prev_symbol, ensembl_gene_id, ord of a dictionary with a header; its other columns are not read."""
    df = spark.read.options(sep="\t", header=True, quote="").csv(path)
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in ("symbol", "alias_symbol", "prev_symbol", "ensembl_gene_id")], file_order().alias("ord"))


def read_gold_pairs(spark: SparkSession, path: str) -> DataFrame:
    """pmid, tf, target, ord; names in capitals, short rows dropped."""
    df = drop_ragged(read_tsv(spark, path, "pmid string, tf string, target string"), 3)
    return df.select(T.strip("pmid").alias("pmid"), F.upper(T.strip("tf")).alias("tf"), F.upper(T.strip("target")).alias("target"), "ord")


def track_tfs(df: DataFrame) -> DataFrame:
    """Distinct tf of lines (value) whose last column is CHIP:tf:cell line."""
    parts = F.split(T.strip(F.element_at(F.split("value", "\t"), -1)), ":")
    return df.where((F.size(parts) >= 2) & (F.element_at(parts, 1) == "CHIP")).select(F.upper(T.strip(F.element_at(parts, 2))).alias("tf")).distinct()


def read_track_tfs(spark: SparkSession, path: str) -> DataFrame:
    return track_tfs(spark.read.text(path))


def read_anomalies(spark: SparkSession, path: str, part: Column | None = None) -> DataFrame:
    """The anomaly log: malformed lines and rows without pmid are dropped; a missing file is an empty table. With part, also ord, which begins with it."""
    try:
        df = spark.read.schema(ANOMALIES).option("mode", "DROPMALFORMED").json(path)
        df.schema  # noqa: B018  the path is checked on analysis
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], ANOMALIES)
    if part is not None:
        df = df.select("*", F.struct(part.alias("part"), *[file_order()[c].alias(c) for c in ("file", "start", "line")]).alias("ord"))
    return df.where(F.coalesce(T.strip("pmid"), F.lit("")) != "")


def overrides_of(entries: DataFrame) -> DataFrame:
    """Override rows of the entries of an array of objects, or of a flat map of alias to symbol."""
    item = "struct<alias:string,symbol:string,roles:array<string>,action:string,reason:string,candidates:array<struct<symbol:string>>>"
    flat = F.struct(F.col("key").alias("alias"), json_text("value").alias("symbol"), F.array(F.lit("tf"), F.lit("target")).alias("roles"), F.lit("map").alias("action"), F.lit("legacy").alias("reason"), F.lit(None).cast("array<struct<symbol:string>>").alias("candidates"))
    rows = entries.select(F.col("ord").cast("int").alias("ord"), F.when(F.col("key").isNull(), F.from_json("value", item)).otherwise(flat.cast(item)).alias("o"))
    return normalize_overrides(rows.where("o is not null").select("ord", "o.*"))


def json_text(c: str) -> Column:
    """The text of a JSON scalar."""
    return F.get(F.from_json(F.concat(F.lit("["), F.col(c), F.lit("]")), "array<string>"), F.lit(0))


def normalize_overrides(df: DataFrame) -> DataFrame:
    """Overrides with roles and action in lower case, map by default."""
    return df.select("ord", "alias", "symbol", F.transform(F.coalesce("roles", F.array().cast("array<string>")), lambda r: F.lower(T.strip(r))).alias("roles"), F.lower(T.strip(F.coalesce("action", F.lit("map")))).alias("action"), F.coalesce("reason", F.lit("")).alias("reason"), "candidates")


def read_overrides(spark: SparkSession, path: str, rows: bool = False) -> DataFrame:
    """Overrides of a JSON array or map that fills a file, or of rows (ord and the fields)."""
    if rows:
        return normalize_overrides(spark.read.schema(OVERRIDES).json(path))
    return overrides_of(J.read_entries(spark, path))


def read_alias_index(spark: SparkSession, path: str, legacy: str | None = None, rows: bool = False) -> tuple[DataFrame, DataFrame]:
    """Candidates (key, symbol, sources) and official symbols of the alias index; where it is missing, of the legacy map of alias to symbol. With rows, of the folders `candidates` and `official` in path."""
    if rows:
        return spark.read.schema("key string, symbol string, sources array<string>").json(f"{path}/candidates"), spark.read.schema("symbol string").json(f"{path}/official")
    if legacy is not None and not J.list_files(path):
        pairs = stored(J.read_entries(spark, legacy).select("key", json_text("value").alias("symbol")))  # the file is scanned once for both tables
        return pairs.withColumn("sources", F.array(F.lit("legacy_alias_map"))), pairs.select("symbol").distinct()
    listed = J.read_entries(spark, path, 2, "aliases").select("key", F.explode(F.from_json("value", "array<struct<symbol:string,sources:array<string>>>")).alias("c"))
    return listed.select("key", "c.symbol", "c.sources"), J.read_entries(spark, path, 2, "official_symbols").select(json_text("value").alias("symbol")).distinct()


def read_ensg_map(spark: SparkSession, path: str, rows: bool = False) -> DataFrame:
    if rows:
        return spark.read.schema("symbol string, ensg string").json(path)
    return J.read_entries(spark, path).select(F.col("key").alias("symbol"), json_text("value").alias("ensg"))


def parse_blocks(blocks: DataFrame, drop_rule: bool = False) -> DataFrame:
    """pmid, abstract (NULL if none), sections, edges of document blocks (value); blocks without a pmid are dropped.

    drop_rule also takes the dividing line off an abstract's end.
    """
    marker = r"(?s)Abstract:\s*-{3,}\s*(.*)"
    pmid = F.regexp_extract("value", r"PMID:\s*(\d+)", 1)
    raw = F.when(F.col("value").rlike(marker), T.strip(F.regexp_extract("value", marker, 1)))
    if drop_rule:
        # Not stripped yet: the line feed behind the label of a section without text is its mark.
        raw = F.regexp_replace(raw, r"\n?(?<!-)-{3,}+$", "")
    df = blocks.where(pmid != "").select(pmid.alias("pmid"), raw.alias("raw"), T.extract_reference_lines("value").alias("edges")).withColumn("sections", T.parse_sections(F.coalesce("raw", F.lit(""))))
    return df.select("pmid", T.render_sections("sections", T.strip("raw")).alias("abstract"), "sections", "edges")


def read_document_blocks(spark: SparkSession, path: str, drop_rule: bool = False) -> DataFrame:
    return parse_blocks(spark.read.text(path, lineSep="=" * 50), drop_rule)


def sections_of_xml(c: Column) -> Column:
    """array(struct(label, text)) of the raw inner XML of an abstract; the label is '' where there is none, inline tags are dropped."""
    element = r"(?s)<AbstractText([^>]*)>(.*?)</AbstractText>"
    heads, bodies = F.regexp_extract_all(c, F.lit(element), F.lit(1)), F.regexp_extract_all(c, F.lit(element), F.lit(2))
    text = lambda x: T.strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"<[^>]+>", ""), "&lt;", "<"), "&gt;", ">"), "&amp;", "&"))
    return F.transform(F.arrays_zip(heads.alias("h"), bodies.alias("b")), lambda p: F.struct(F.regexp_extract(p["h"], r'Label="([^"]*)"', 1).alias("label"), text(p["b"]).alias("text")))


def articles(df: DataFrame) -> DataFrame:
    """pmid, abstract, sections of articles (pmid, inner XML as `xml`): labelled parts as sections, else the joined text, else ''."""
    df = df.select("pmid", sections_of_xml(F.coalesce("xml", F.lit(""))).alias("parts"))
    labelled = F.transform(F.filter("parts", lambda p: p.label != ""), lambda p: F.struct(T.section_label(p.label).alias("label"), p.text.alias("text")))
    df = df.select("pmid", "parts", labelled.alias("raw"))
    sections = T.bind(F.col("raw"), T.last_of_labels)
    plain = F.array_join(F.transform("parts", lambda p: p.text), " ")
    return df.select("pmid", F.when(F.size("raw") > 0, F.lit(None).cast("string")).otherwise(plain).alias("abstract"), sections.alias("sections"))


def read_articles_xml(spark: SparkSession, path: str) -> DataFrame:
    schema = "MedlineCitation struct<PMID:string,Article:struct<Abstract:string>>"
    df = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(schema).load(path)
    return articles(df.select(F.col("MedlineCitation.PMID").alias("pmid"), F.col("MedlineCitation.Article.Abstract").alias("xml")))


EXTRACTION = "array<struct<pos:int,tf:string,target:string,direction:string,confidence:string,evidence:string>>"


def extraction_rows(df: DataFrame, error: Column | None = None) -> DataFrame:
    """pmid, error, n_items, edges: a row for each result (pmid, variant v), which is parsed where it stands. error, if not null, goes before the result's own.

    An array is cast to structs at once, for each of the three spellings of fields; what is no array, or no object in it, is null then.
    """
    fields = ["tf", "target", "direction", "confidence", "evidence"]
    own = F.try_variant_get("v", "$.error", "string")
    v = F.col("v") if error is None else F.when(error.isNull(), F.col("v"))
    spelled = [[f.lower() for f in fields], [f.upper() for f in fields], ["TF", *[f.title() for f in fields[1:]]]]
    casts = [F.try_variant_get(v, "$", f"array<struct<{','.join(f'{n}:string' for n in names)}>>").alias(f"_{i}") for i, names in enumerate(spelled)]
    df = df.select("pmid", (own if error is None else F.coalesce(error, own)).alias("error"), *casts)
    field = lambda e, k: F.coalesce(*[e[f"_{i}"][names[k]] for i, names in enumerate(spelled)], F.lit(""))
    placed = F.filter(F.transform(F.arrays_zip("_0", "_1", "_2"), lambda e, i: F.when(e["_0"].isNotNull(), F.struct(i.alias("pos"), *[field(e, k).alias(c) for k, c in enumerate(fields)]))), lambda e: e.isNotNull())
    return df.select("pmid", "error", F.coalesce(F.size("_0"), F.lit(0)).cast("long").alias("n_items"), F.coalesce(placed, F.array().cast(EXTRACTION)).cast(EXTRACTION).alias("edges"))


def extractions_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (pmid, pos, tf, target, direction, confidence, evidence) and documents (pmid, error, n_items) of extraction rows."""
    return rows.select("pmid", F.explode("edges").alias("e")).select("pmid", "e.*"), rows.select("pmid", "error", "n_items")


def read_extractions(spark: SparkSession, path: str, rows: bool = False) -> tuple[DataFrame, DataFrame]:
    """Edges and documents of results, as extractions_of; each result is parsed once and stored."""
    if rows:
        return extractions_of(spark.read.schema(f"pmid string, error string, n_items long, edges {EXTRACTION}").json(path))
    return extractions_of(stored(extraction_rows(J.read_entries(spark, path).select(F.col("key").alias("pmid"), F.try_parse_json("value").alias("v")))))


def read_debug(spark: SparkSession, path: str, rows: bool = False) -> DataFrame:
    if rows:
        return spark.read.schema(f"pmid string, d {DEBUG}").json(path).select("pmid", "d.*")
    return J.read_entries(spark, path).select(F.col("key").alias("pmid"), F.from_json("value", DEBUG).alias("d")).select("pmid", "d.*")


def resolve_review(df: DataFrame) -> DataFrame:
    """One row for each pmid of review rows (ord, pmid, direction, cellline, assay): the first with a direction, else the last."""
    empty = F.coalesce("direction", F.lit("")) == ""
    answers = F.struct("direction", "cellline", "assay")
    best = F.coalesce(F.min_by(answers, F.when(~empty, F.col("ord"))), F.max_by(answers, "ord"))
    return df.groupBy("pmid").agg(best.alias("s")).select("pmid", "s.*", F.lit("").alias("notes"), F.lit(True).alias("reviewed"))


def read_review(spark: SparkSession, path: str) -> DataFrame:
    return resolve_review(_review_rows(spark, path))


def _review_rows(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split("value", "\t", -1)
    names = ["pmid", "tf", "ensg", "direction", "cellline", "assay"]
    return spark.read.text(path).where(F.size(parts) >= 6).select(*[T.strip(F.get(parts, F.lit(i))).alias(n) for i, n in enumerate(names)], file_order().alias("ord"))
