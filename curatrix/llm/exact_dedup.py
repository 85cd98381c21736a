"""Exact dedup by deterministic block naming.

Each normalised text is cut into fixed-size blocks. The distinct blocks are sorted and numbered; then
adjacent numbers are paired, the distinct pairs numbered again, and so on, until one number is left of
each document. Equal numbers at the same depth mean equal texts, with no hash to collide: a 64-bit digest
only finds a block's name, and digests that two blocks share go by the blocks themselves.

Defined results: a null text counts as empty, and all empty texts are equal. Of equal texts the largest
doc_id stays (null is the smallest); of rows that repeat a doc_id with the same text, one stays. An empty
table gives an empty result; long texts are so many blocks. Other columns are never read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .kernels import LOWER, flat
from .scratch import Scratch, filtered, with_uid

BLOCK_BYTES = 4096


def _cut(batches, size: int):
    for batch in batches:
        buf, offsets = flat(batch.column("text"))
        buf = np.ascontiguousarray(LOWER[buf])
        lengths = np.diff(offsets)
        n = np.maximum(1, -(-lengths // size))
        row = np.repeat(np.arange(len(n)), n)
        pos = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        ends = np.append(offsets[:-1][row] + pos * size, offsets[-1])
        view = memoryview(buf)
        sha = np.full(len(row), None, object)
        sha[pos == 0] = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        blocks = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(buf)])
        yield pa.RecordBatch.from_arrays(
            [batch.column("uid").take(pa.array(row)), batch.column("doc_id").take(pa.array(row)), pa.array(pos, pa.int32()), pa.array(n[row], pa.int32()), pa.array(sha, pa.string()), blocks.cast(pa.binary())],
            ["uid", "doc_id", "pos", "n", "sha", "block"],
        )


def block_identity(docs: DataFrame, scratch: Scratch, block_bytes: int = BLOCK_BYTES, digest=None) -> DataFrame:
    """uid, doc_id, sha, depth, name of each row of docs (uid, doc_id, text): equal (depth, name) if and only if equal texts."""
    digest = digest or F.xxhash64
    blocks = docs.select("uid", "doc_id", "text").mapInArrow(lambda it: _cut(it, block_bytes), "uid long, doc_id long, pos int, n int, sha string, block binary")
    keyed = blocks.withColumn("digest", digest("block"))
    # Sorted within hash partitions: a name is the partition and the rank in it.
    named = scratch.save(keyed.select("digest", "block").distinct().sortWithinPartitions("digest", "block").select("digest", F.monotonically_increasing_id().alias("name"), F.sha2("block", 256).alias("strong")))
    shared = named.groupBy("digest").count().where("count > 1").select("digest")
    if shared.limit(1).count():
        # Blocks that share a digest: by their content, compared whole.
        spread = keyed.join(shared, "digest", "left_semi")
        contents = spread.select("digest", "block").distinct().withColumn("strong", F.sha2("block", 256)).join(named, ["digest", "strong"])
        rare = spread.join(contents.select("block", "name"), "block").select("uid", "doc_id", "pos", "n", "sha", "name")
        plain = keyed.join(shared, "digest", "left_anti").join(named, "digest").select("uid", "doc_id", "pos", "n", "sha", "name")
        level = scratch.save(plain.unionByName(rare))
    else:
        level = scratch.save(keyed.drop("block").join(named.drop("strong"), "digest").select("uid", "doc_id", "pos", "n", "sha", "name"))
    most = level.agg(F.max("n")).first()[0] or 1
    done, depth = [], 0
    while True:
        done.append(level.where("n = 1").select("uid", "doc_id", "sha", F.lit(depth).alias("depth"), "name"))
        if most <= 1:
            break
        half = F.expr("pos div 2").cast("int")
        pairs = (
            level.where("n > 1").groupBy("uid", half.alias("pos"))
            .agg(F.first("doc_id", True).alias("doc_id"), F.first("n").alias("n"), F.max("sha").alias("sha"), F.max(F.expr("if(pos % 2 = 0, name, -1)")).alias("left"), F.max(F.expr("if(pos % 2 = 1, name, -1)")).alias("right"))
        )
        pairs = scratch.save(pairs)
        ranks = scratch.save(pairs.select("left", "right").distinct().sortWithinPartitions("left", "right").select("left", "right", F.monotonically_increasing_id().alias("name")))
        level = scratch.save(pairs.join(ranks, ["left", "right"]).select("uid", "doc_id", "pos", F.expr("cast((n + 1) div 2 as int)").alias("n"), "sha", "name"))
        most = (most + 1) // 2
        depth += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def exact_groups(docs: DataFrame, scratch: Scratch, block_bytes: int = BLOCK_BYTES, digest=None) -> DataFrame:
    """uid, doc_id, keep_id, group_size, kept, text_sha256 for every row of docs (uid, doc_id, text)."""
    ids = block_identity(docs, scratch, block_bytes, digest)
    groups = ids.groupBy("depth", "name").agg(F.max(F.struct("doc_id", "uid")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return ids.join(groups, ["depth", "name"]).select(
        "uid", "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.uid")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def op4_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    return exact_groups(with_uid(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch), scratch).drop("uid")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each group of equal texts stays, with all its columns."""
    scratch = Scratch(spark)
    return filtered(docs, scratch, lambda mine: exact_groups(mine, scratch).where("kept"), "text")


_LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = {
    "op4_block_naming": f"""
WITH t AS (SELECT doc_id, sha256({_LOWER_SQL}) AS text_sha256, {_LOWER_SQL} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY norm)"""
}
