"""Queries on documents, responses and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.functions import text as T
from curatrix.operators import aliases as A, documents as D, edges as E, extract as X, report as R
from curatrix.sources import readers as S, writers as K

from .views import ctes, view

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# ---- documents -----------------------------------------------------------------------------------------

#: Documents in two sections, a third of the text and the rest, or three; those of one language have none.
_SECT_CTE = f"WITH s AS (SELECT cast(doc_id AS string) AS pmid, CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 0 ELSE 2 END AS kind, source, text FROM documents), d AS (SELECT pmid, kind, source, text, trim(text, '{T.BLANKS}') AS flat, trim(substr(text, 1, length(text) // 3), '{T.BLANKS}') AS a, trim(substr(text, length(text) // 3 + 1), '{T.BLANKS}') AS b FROM s)"


def _sectioned(spark, d):
    s = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("pmid"), F.expr("CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 0 ELSE 2 END").alias("kind"), "source", "text")
    cut = lambda e: T.strip(F.expr(e))
    return s.select("pmid", "kind", "source", "text", T.strip("text").alias("flat"), cut("substring(text, 1, length(text) div 3)").alias("a"), cut("substring(text, cast(length(text) div 3 + 1 as int))").alias("b"))


def _labelled(df):
    """Documents as the block file has them, with a repeated label and a doubly bracketed one."""
    section = lambda label, text: F.struct(F.lit(label).alias("label"), text.alias("text"))
    two = F.array(section("BACKGROUND", F.col("a")), section("[Significance]", F.col("b")))
    three = F.array(section("RESULTS", F.col("b")), section("METHODS", F.col("a")), section("RESULTS", F.col("a")))
    sections = F.when(F.col("kind") == 1, two).when(F.col("kind") == 2, three).otherwise(F.filter(two, lambda _: F.lit(False)))
    edges = F.array(F.struct(F.concat(F.lit("TF"), "pmid").alias("tf"), F.lit("GN1").alias("target"), F.lit("Activation").alias("direction")))
    return df.select("pmid", sections.alias("sections"), F.col("flat").alias("abstract"), edges.alias("edges"))


@query("document_blocks", _SECT_CTE + """
SELECT pmid, CASE kind WHEN 1 THEN '[BACKGROUND]' || chr(10) || a || chr(10) || chr(10) || '[Significance]' || chr(10) || b WHEN 2 THEN '[RESULTS]' || chr(10) || a || chr(10) || chr(10) || '[METHODS]' || chr(10) || a ELSE flat END AS abstract,
  CASE WHEN kind = 0 THEN 0 ELSE 2 END AS n_sections, 'TF' || pmid || '->GN1(Activation)' AS edges FROM d""")
def document_blocks(spark, d):
    blocks = _labelled(_sectioned(spark, d)).select(K.block_text().alias("value"))
    docs = S.parse_blocks(blocks, drop_rule=True)
    return docs.select("pmid", "abstract", F.size("sections").alias("n_sections"), F.array_join(F.transform("edges", lambda e: T.pack_edge(e.tf, e.target, e.direction)), ";").alias("edges"))


_LABELS = ", ".join(f"'{x}'" for x in T.SECTION_LABELS)


@query("section_labels", _SECT_CTE + f", l AS (SELECT pmid, CASE kind WHEN 0 THEN 'Results' WHEN 1 THEN regexp_extract(text, '[A-Za-z]+', 0) ELSE source END AS label FROM d)\nSELECT pmid, CASE WHEN upper(label) IN ({_LABELS}) THEN upper(label) ELSE '[' || label || ']' END AS label FROM l")
def section_labels(spark, d):
    label = F.when(F.col("kind") == 0, "Results").when(F.col("kind") == 1, F.regexp_extract("text", "[A-Za-z]+", 0)).otherwise(F.col("source"))
    return _sectioned(spark, d).select("pmid", T.section_label(label).alias("label"))


@query("dedupe_sections", ctes("turns") + ", s AS (SELECT string_split(pmid, '-')[1] AS pmid, cast(string_split(pmid, '-')[2] AS bigint) AS ord, 'L' || cast(cast(string_split(pmid, '-')[2] AS bigint) % 2 AS string) AS label, text FROM turns)\nSELECT pmid, label, min(ord) AS ord, arg_max(text, ord) AS text FROM s GROUP BY ALL")
def dedupe_sections(spark, d):
    s = view(spark, d, "turns").select(F.split("pmid", "-")[0].alias("pmid"), F.split("pmid", "-")[1].cast("long").alias("ord"), "text").withColumn("label", F.concat(F.lit("L"), (F.col("ord") % 2).cast("string")))
    return D.dedupe_sections(s)


_CUES = ["by", "of the", "para"]


#: Every text, and a sentence after it that its language decides.
_TOLD = ctes("abstracts") + rf""", told AS (SELECT cast(doc_id AS string) AS pmid, text || chr(10) || CASE lang WHEN 'en' THEN 'Knockdown of A' || doc_id || ' blocks B-mediated growth. It acts through C.' WHEN 'de' THEN 'Here A' || doc_id || ' inhibits D/E-mediated repair, which in turn leads to overexpression!' ELSE 'No word of it.' END AS abstract FROM documents),
t AS (SELECT pmid, list_filter(list_transform(string_split_regex(regexp_replace(abstract, '([.!?])[{T.BLANK}]+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x, '{T.BLANKS}')), lambda x: x <> '') AS ss FROM told),
u AS (SELECT pmid, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS pos FROM t)"""


def _told(spark, d):
    said = F.when(F.col("lang") == "en", F.concat(F.lit("Knockdown of A"), "doc_id", F.lit(" blocks B-mediated growth. It acts through C."))).when(F.col("lang") == "de", F.concat(F.lit("Here A"), "doc_id", F.lit(" inhibits D/E-mediated repair, which in turn leads to overexpression!"))).otherwise("No word of it.")
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("pmid"), F.concat("text", F.lit("\n"), said).alias("abstract"))


def _cued(cues: list[str]) -> str:
    return _TOLD + f"\nSELECT pmid, pos, sentence FROM u WHERE regexp_matches(sentence, '(?i)(^|[^{T.WORD}])({'|'.join(cues)})($|[^{T.WORD}])')"


@query("cue_sentences", _cued(_CUES))
def cue_sentences(spark, d):
    return D.cue_sentences(_told(spark, d), "abstract", _CUES)


@query("mechanism_sentences", _cued(T.MECHANISM_CUES))
def mechanism_sentences(spark, d):
    return D.cue_sentences(_told(spark, d), "abstract")


@query("perturbation_sentences", _cued(T.PERTURBATION_CUES))
def perturbation_sentences(spark, d):
    return D.cue_sentences(_told(spark, d), "abstract", T.PERTURBATION_CUES)


_EDGE = r"([0-9A-Za-z_][0-9A-Za-z_/]*) (inhibits|blocks|suppresses) ([0-9A-Za-z_][0-9A-Za-z_/]*)-mediated ([0-9A-Za-z_]+)"


@query("mediated_edges", _TOLD + f"""
SELECT pmid, pos, regexp_extract(m, '{_EDGE}', 1) AS tf, regexp_extract(m, '{_EDGE}', 3) AS target, regexp_extract(m, '{_EDGE}', 4) AS outcome FROM (SELECT pmid, unnest(ms) AS m, generate_subscripts(ms, 1) - 1 AS pos FROM (SELECT pmid, regexp_extract_all(abstract, '{_EDGE}') AS ms FROM told))""")
def mediated_edges(spark, d):
    return D.mediated_edges(_told(spark, d), "abstract")


@query("build_prompts", ctes("abstracts") + """, m AS (SELECT pmid, pmid LIKE '%2' AS answered, 'user:' || abstract || chr(10) || chr(10) || 'List the edges.' AS ask FROM abstracts)
SELECT pmid, ask AS round1, CASE WHEN answered THEN ask || '|assistant:answer to ' || pmid || '|user:As JSON.' END AS round2 FROM m""")
def build_prompts(spark, d):
    df = view(spark, d, "abstracts").withColumn("round1_answer", F.when(F.col("pmid").endswith("2"), F.concat(F.lit("answer to "), "pmid")))
    said = lambda c: F.array_join(F.transform(c, lambda m: F.concat(m.role, F.lit(":"), m.content)), "|")
    return D.build_prompts(df, "List the edges.", "As JSON.", "abstract").select("pmid", said("round1").alias("round1"), said("round2").alias("round2"))


# ---- responses -----------------------------------------------------------------------------------------


def _responses(spark, d):
    """A response for each document of pred: JSON in a fence, with a comment, or a trailing comma; every 17th broken."""
    edge = F.struct(F.col("tf").alias("TF"), F.col("target").alias("Target"), "direction", "confidence", "evidence")
    packed = view(spark, d, "pred").groupBy("pmid").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("pos", edge.alias("e")))), lambda x: x.e)).alias("j"))
    k = F.col("pmid").cast("long")
    text = F.when(k % 17 == 0, F.concat(F.lit("["), F.col("j"))).when(k % 3 == 0, F.concat(F.lit("Here:\n```json\n"), "j", F.lit("\n```\nDone."))).when(k % 3 == 1, F.concat(F.lit("// edges\n"), F.regexp_replace("j", r"\]$", ",]"))).otherwise(F.col("j"))
    return packed.select("pmid", F.lit(None).cast("string").alias("error"), text.alias("round2_raw"))


@query("parse_responses", ctes("pred") + "\nSELECT pmid, pos - 1 AS pos, tf, target, direction, confidence, evidence FROM pred WHERE cast(pmid AS bigint) % 17 <> 0")
def parse_responses(spark, d):
    return X.parse_json_edges(_responses(spark, d))[0]


@query("parse_failures", ctes("pred") + "\nSELECT pmid, CASE WHEN cast(pmid AS bigint) % 17 = 0 THEN 'parse_fail' END AS error, CASE WHEN cast(pmid AS bigint) % 17 = 0 THEN 0 ELSE count(*) END AS n_items FROM pred GROUP BY pmid")
def parse_failures(spark, d):
    return X.parse_json_edges(_responses(spark, d))[1]


_NAMED = ctes("pred") + """, e AS (SELECT pmid, pos - 1 AS pos, tf, target, CASE WHEN tf = 'TF3' THEN 'override' WHEN cast(substr(tf, 3) AS int) < 20 THEN 'hgnc_alias' WHEN cast(substr(tf, 3) AS int) < 30 THEN 'unmapped' ELSE 'ambiguous' END AS how FROM pred WHERE cast(pmid AS bigint) % 17 <> 0),
n AS (SELECT *, CASE how WHEN 'override' THEN 'SYM3' WHEN 'hgnc_alias' THEN 'GN' || substr(tf, 3) ELSE tf END AS new_tf, CASE target WHEN 'GN5' THEN 'SYM5' ELSE target END AS new_target FROM e)"""


def _post(spark, d):
    """Responses against a dictionary in which names are official, aliases of one symbol or of several, or unknown."""
    over = S.normalize_overrides(spark.createDataFrame([(0, "tf3", "SYM3", ["tf"], None, None, None), (1, "gn5", "sym5", ["target"], None, None, None)], S.OVERRIDES))
    lexicon = view(spark, d, "lexicon")
    return X.postprocess(X.parse_json_edges(_responses(spark, d))[0], over, A.official_symbols(lexicon), A.build_alias_candidates(lexicon))


@query("postprocess", _NAMED + "\nSELECT pmid, pos, new_tf AS tf, new_target AS target FROM n")
def postprocess(spark, d):
    return _post(spark, d)[0].select("pmid", "pos", "tf", "target")


@query("postprocess_log", _NAMED + """
SELECT pmid, tf AS original, new_tf AS normalized, 'tf' AS type, how AS status, CASE how WHEN 'override' THEN 'curated_override' WHEN 'unmapped' THEN 'none' ELSE 'hgnc_alias_index' END AS source, CASE how WHEN 'override' THEN 'tf3' WHEN 'unmapped' THEN '' ELSE tf END AS matched_key FROM n
UNION ALL SELECT pmid, target, new_target, 'target', CASE target WHEN 'GN5' THEN 'override' ELSE 'unmapped' END, CASE target WHEN 'GN5' THEN 'curated_override' ELSE 'none' END, CASE target WHEN 'GN5' THEN 'gn5' ELSE '' END FROM n WHERE target = 'GN5' OR target LIKE '%C' OR length(target) > 3 AND cast(substr(target, 3) AS int) >= 60""")
def postprocess_log(spark, d):
    return _post(spark, d)[1]


# ---- extraction ----------------------------------------------------------------------------------------


def counting_client(messages: list[dict]) -> dict:
    """A client without a network: answers say how much was asked; some texts make it fail or ask for a pause."""
    asked = messages[0]["content"]
    if len(asked) % 97 == 0:
        raise ValueError("refused")
    if len(asked) % 89 == 0:
        raise X.RateLimited
    return {"text": "[]" if len(messages) > 1 else "seen", "request_id": None, "input_tokens": sum(len(m["content"].encode()) for m in messages), "output_tokens": len(messages)}


_EXTRACTED = ctes("turns") + """, e AS (SELECT pmid, coalesce(text, '') || chr(10) || chr(10) || 'Q' AS asked FROM turns),
x AS (SELECT pmid, length(asked) % 97 = 0 AS bad, length(asked) % 97 <> 0 AND length(asked) % 89 = 0 AS slow, octet_length(encode(asked)) AS n FROM e)"""


def _extracted(spark, d):
    return X.extract(view(spark, d, "turns"), counting_client, "Q", "J", workers=8, delays=(0, 0, 0))


@query("extract", _EXTRACTED + "\nSELECT pmid, CASE WHEN bad THEN 'refused' WHEN slow THEN 'Round1_API_Error: rate_limit_exhausted' END AS error, CASE WHEN bad OR slow THEN NULL ELSE 'seen' END AS round1_analysis, CASE WHEN bad OR slow THEN NULL ELSE '[]' END AS round2_raw FROM x")
def extract(spark, d):
    return _extracted(spark, d).select("pmid", "error", "round1_analysis", "round2_raw")


@query("token_usage", _EXTRACTED + ", u AS (SELECT pmid, CASE WHEN bad OR slow THEN 0 ELSE n END AS round1_in, CASE WHEN bad OR slow THEN 0 ELSE 1 END AS round1_out, CASE WHEN bad OR slow THEN 0 ELSE n + 5 END AS round2_in, CASE WHEN bad OR slow THEN 0 ELSE 3 END AS round2_out FROM x)\nSELECT *, round1_in + round2_in AS total_in, round1_out + round2_out AS total_out FROM u")
def token_usage(spark, d):
    return X.token_usage(_extracted(spark, d))


@query("debug_table", _EXTRACTED + "\nSELECT pmid, 'seen' AS round1_analysis, 'in:' || n || ' out:1' AS round1_tokens, '[]' AS round2_raw, '[]' AS round2_clean, 'in:' || (n + 5) || ' out:3' AS round2_tokens FROM x WHERE NOT bad AND NOT slow")
def debug_table(spark, d):
    return R.debug_table(_extracted(spark, d))


@query("attach_documents", ctes("truth", "abstracts") + ", r AS (SELECT DISTINCT pmid FROM truth)\nSELECT pmid, coalesce(abstract, 'Not found') AS abstract, length(abstract) AS n, substr(abstract, 1, 3) AS start FROM r LEFT JOIN abstracts USING (pmid)")
def attach_documents(spark, d):
    docs = view(spark, d, "abstracts")
    record = docs.select("pmid", F.length("abstract").cast("long").alias("n"), F.substring("abstract", 1, 3).alias("start"))
    return D.attach_documents(E.distinct_docs(view(spark, d, "truth")), docs, record).select("pmid", "abstract", "debug.n", "debug.start")
