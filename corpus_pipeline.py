"""A training-data pipeline over the documents table; each stage is written and read again.

Toxic documents go, then all but one of equal texts, then all but one of each near-duplicate group; the draw of mixing keeps an
expected share; packing gives the pieces of what is left. Each stage works on all rows that its predecessor kept, whole texts
and all columns of them, and all but the last return these columns.

Defined results: null and empty texts have no toxic passage, are equal to each other, have no near copy, are drawn as others of
their source, language and empty topic are, and make one piece of one id. A null doc_id is an id of its own, null source and lang are values of their own;
repeated rows are equal texts, of which one stays; of equal doc_ids in one group one row stays. Long texts are whole in every
stage. Columns of the table that have names of an operator's own stay as they are. An empty table gives an empty result; without
labels nothing is toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from curatrix.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from curatrix.llm.scratch import Scratch

STAGES = [
    ("toxicity", toxicity.stage),
    ("exact_dedup", exact_dedup.stage),
    ("near_dedup", near_dedup.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: Learned scores and packing have no SQL form; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = scratch.save(out) if k + 1 < len(STAGES) else out
    return docs
