"""Documents: sections, cue sentences, mediated edges, prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from curatrix.functions import text as T


def dedupe_sections(df: DataFrame) -> DataFrame:
    """One row for each (pmid, label): the last text, at the first place."""
    return df.groupBy("pmid", "label").agg(F.min("ord").alias("ord"), F.max_by("text", "ord").alias("text"))


def cue_sentences(df: DataFrame, column: str = "text", cues: list[str] = T.MECHANISM_CUES) -> DataFrame:
    """pmid, pos, sentence of the sentences that hold a cue."""
    return df.select("pmid", F.posexplode(T.sentences(column)).alias("pos", "sentence")).where(T.has_cue("sentence", cues))


def mediated_edges(df: DataFrame, column: str = "text") -> DataFrame:
    """pmid, pos, tf, target, outcome of every `A inhibits B-mediated C`."""
    return df.select("pmid", F.posexplode(T.mediated_edges(column)).alias("pos", "e")).select("pmid", "pos", "e.*")


def build_prompts(df: DataFrame, first: str, second: str, column: str = "text") -> DataFrame:
    """round1 and round2 messages: the text and the first template; then the first answer (round1_answer, maybe null) and the second one."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    ask = F.concat(F.coalesce(F.col(column), F.lit("")), F.lit("\n\n" + first))
    return df.withColumn("round1", F.array(message("user", ask))).withColumn("round2", F.when(F.col("round1_answer").isNotNull(), F.array(message("user", ask), message("assistant", F.col("round1_answer")), message("user", F.lit(second)))))


def attach_documents(results: DataFrame, docs: DataFrame, debug: DataFrame) -> DataFrame:
    """results with abstract (or a note) and the debug record of their document."""
    record = debug.select("pmid", F.struct(*[c for c in debug.columns if c != "pmid"]).alias("debug"))
    return results.join(docs.select("pmid", "abstract"), "pmid", "left").withColumn("abstract", F.coalesce("abstract", F.lit("Not found"))).join(record, "pmid", "left")
