"""Hard negatives by exact integer scores, several candidates to a multiplication.

Kronecker packing: components are raised by a bias, so that none is negative, and those of several candidates stand in separate
fields of one wide integer, each field as wide as the largest possible sum of products. One multiplication for each component
of an anchor then gives all their products, sums stay within their fields, and the fields, less what the biases have added,
are the exact scores. The wide integers are doubles of 53 exact bits, 64-bit words, or Python's integers: the first of them that
holds two fields.

The anchors are a stated query set against all rows. They come in blocks of about ANCHORS, which is what a task or the driver
holds at once; a block takes two scans of the table, one for its positives and one for their negatives. Candidates are not
shuffled: a task keeps the best few of what it has read for each anchor, and these meet by grouping, so neither a hot label nor a
vector that many rows share gathers anywhere.

Rows without label or vector, or with a null or non-finite component, take no part; nor do components of 2**26 or more after
scaling, whose scores 64 bits would not hold. The shorter of two vectors counts as 0 beyond its end. A row is told from others by
its place in the table: equal rows are candidates of each other, each is an anchor, and of equal scores and ids either is the
first. Null ids come last, and are no anchors. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .scratch import Scratch
from .vectors import LIMIT, lengths, scaled

SCALE, EVERY, POSITIVES, NEGATIVES = 256, 100, 5, 5
#: A negative scores at least LOW and at most HIGH hundredths of its positive.
LOW, HIGH = 80, 100
#: Anchors of a block, in expectation; anchors and candidates that are multiplied at a time.
ANCHORS, ROWS, COLUMNS = 8192, 512, 4096
NO_ID = np.iinfo(np.int64).max
LEAST = np.iinfo(np.int64).min


def carrier(bits: int) -> tuple[type, int]:
    """The number type that holds fields of so many bits, and how many of them."""
    for kind, width in ((np.float64, 53), (np.uint64, 64)):
        if width >= 2 * bits:
            return kind, width // bits
    return object, 8


class Packed:
    """Candidates (n x width, integers) in the fields of wide integers, to be scored with anchors (m x width)."""

    def __init__(self, candidates: np.ndarray, anchors: np.ndarray):
        self.n, width = candidates.shape
        self.bias, self.raised = (int(-min(x.min(initial=0), 0)) for x in (candidates, anchors))
        most = max(1, width * (int(candidates.max(initial=0)) + self.bias) * (int(anchors.max(initial=0)) + self.raised))
        self.bits = most.bit_length()
        self.kind, self.fields = carrier(self.bits)
        self.columns = -(-self.n // self.fields)
        self.sums = candidates.sum(axis=1)
        self.width = width
        fields = np.zeros((self.fields * self.columns, width), np.int64)
        fields[: self.n] = candidates + self.bias
        fields = fields.reshape(self.fields, self.columns, width)
        wide = np.uint64 if self.kind is not object else object
        packed = sum(fields[j].astype(wide) << wide(self.bits * j) if wide is np.uint64 else fields[j].astype(object) * (1 << self.bits * j) for j in range(self.fields))
        self.packed = packed.astype(self.kind).T

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """The exact inner products, a row for each anchor."""
        total = (anchors + self.raised).astype(self.kind) @ self.packed
        out = np.empty((len(anchors), self.fields * self.columns), np.int64)
        if self.kind is np.float64:
            total = total.astype(np.uint64)
        for j in range(self.fields):
            part = out[:, j * self.columns : (j + 1) * self.columns]
            if self.kind is object:
                part[:] = (total // (1 << self.bits * j)) % (1 << self.bits)
            else:
                part[:] = ((total >> np.uint64(self.bits * j)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        return out[:, : self.n] - self.bias * anchors.sum(axis=1)[:, None] - self.raised * self.sums[None, :] - self.width * self.bias * self.raised


class Best:
    """The k entries of each key with the highest scores, of equal scores those with the least ids."""

    def __init__(self, keys: int, k: int):
        self.k, self.score, self.id = k, np.full(keys, LEAST), np.full(keys, NO_ID)  # the k-th of each key
        self.entries = [np.zeros(0, np.int64) for _ in range(4)]

    def better(self, key, score, id):
        """Whether an entry comes before the k-th of its key."""
        return (score > self.score[key]) | ((score == self.score[key]) & (id < self.id[key]))

    def add(self, key: np.ndarray, score: np.ndarray, id: np.ndarray, row: np.ndarray) -> None:
        if not len(key):
            return
        key, score, id, row = (np.concatenate(x) for x in zip(self.entries, (key, score, id, row)))
        order = np.lexsort((row, id, -score, key))
        key, score, id, row = (x[order] for x in (key, score, id, row))
        rank = np.arange(len(key)) - np.searchsorted(key, key)
        keep = rank < self.k
        self.entries = [x[keep] for x in (key, score, id, row)]
        last = rank == self.k - 1
        self.score[key[last]], self.id[key[last]] = score[last], id[last]


def _batch(batch: pa.RecordBatch, scale: int) -> tuple[np.ndarray, ...]:
    """Integers, id, label, row of those that take part."""
    x = scaled(batch.column("v"), scale, max(1, int(lengths(batch.column("v")).max(initial=0))))
    fine = np.isfinite(x).all(axis=1) & (np.abs(np.where(np.isfinite(x), x, 0)) < LIMIT).all(axis=1)
    ids = pc.fill_null(batch.column("id"), int(NO_ID)).to_numpy()
    return x[fine].astype(np.int64), ids[fine], batch.column("label").to_numpy()[fine], batch.column("row").to_numpy()[fine]


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x


def _blocks(batches: Iterator[pa.RecordBatch], anchors: np.ndarray, scale: int):
    """first, score, id, label, row: scores of a part of the anchors, from `first` on, with a part of the candidates."""
    for batch in batches:
        whole = _batch(batch, scale)
        for i in range(0, len(whole[0]), COLUMNS):
            x, ids, labels, rows = (a[i : i + COLUMNS] for a in whole)
            width = max(x.shape[1], anchors.shape[1])
            own = _wide(anchors, width)
            packed = Packed(_wide(x, width), own)
            for first in range(0, len(own), ROWS):
                yield first, packed.scores(own[first : first + ROWS]), ids, labels, rows


ENTRIES = "key long, score long, id long, row long"


def _emit(best: Best) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x) for x in best.entries], ["key", "score", "id", "row"])


def _first(df: DataFrame, k: int) -> DataFrame:
    """The first k entries of each key, with their rank from 1."""
    rank = F.row_number().over(W.partitionBy("key").orderBy(F.desc("score"), "id", "row"))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def positives(rows: DataFrame, x: np.ndarray, labels: np.ndarray, places: np.ndarray, k: int = POSITIVES, scale: int = SCALE) -> DataFrame:
    """key (the anchor's number), score, id, row, rank: the first k other rows of each anchor's label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(x), k)
        for first, score, ids, own, row in _blocks(batches, x, scale):
            key = np.arange(first, first + len(score))
            a, c = np.nonzero((labels[key][:, None] == own) & best.better(key[:, None], score, ids[None, :]) & (places[key][:, None] != row))
            best.add(key[a], score[a, c], ids[c], row[c])
        yield _emit(best)

    return _first(rows.mapInArrow(run, ENTRIES), k)


def negatives(rows: DataFrame, x: np.ndarray, labels: np.ndarray, limits: np.ndarray, k: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """key (anchor's number * positives + positive's), score, id, row, rank: the first k rows of another label within each positive's bounds.

    limits: the positives' scores, a row for each anchor, LEAST where there is none.
    """
    n = limits.shape[1]
    # 100 * score >= low * positive and <= high * positive, in whole scores.
    there = limits != LEAST
    floor, ceiling = np.where(there, -((-low * np.where(there, limits, 0)) // 100), NO_ID), np.where(there, (high * np.where(there, limits, 0)) // 100, LEAST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(limits.size, k)
        for first, score, ids, own, row in _blocks(batches, x, scale):
            key = np.arange(first, first + len(score))
            a, c = np.nonzero((labels[key][:, None] != own) & (score >= floor[key].min(axis=1)[:, None]) & (score <= ceiling[key].max(axis=1)[:, None]))
            value = score[a, c]
            for j in range(n):
                its = key[a] * n + j
                fits = (value >= floor[key[a], j]) & (value <= ceiling[key[a], j]) & best.better(its, value, ids[c])
                best.add(its[fits], value[fits], ids[c[fits]], row[c[fits]])
        yield _emit(best)

    return _first(rows.mapInArrow(run, ENTRIES), k)


def prepared(df: DataFrame, scratch: Scratch, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """row, id, label, v of the rows with a label and a vector."""
    mine, row = scratch.numbered(df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v")))
    return mine.select(F.col(row).alias("row"), "id", "label", "v").where("label is not null and v is not null")


def mine_negatives(rows: DataFrame, anchors, scratch: Scratch, positive: int = POSITIVES, negative: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, per_block: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; rows as `prepared` has them, of which the condition `anchors` picks the anchors."""
    spark = rows.sparkSession
    chosen = scratch.save(rows.where(anchors).where("id is not null"))
    blocks = -(-chosen.count() // per_block)
    path = f"{scratch.root}/negatives"
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for b in range(blocks):
        block = chosen.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).toArrow().combine_chunks()  # about per_block rows
        for batch in block.to_batches():
            x, ids, labels, places = _batch(batch, scale)
            found = positives(rows, x, labels, places, positive, scale).collect()  # `positive` rows for each anchor of the block
            limits, of = np.full((len(x), positive), LEAST), []
            for r in found:
                limits[r.key, r.rank - 1] = r.score
                of.append((r.key * positive + r.rank - 1, int(ids[r.key]), None if r.id == NO_ID else r.id, r.score))
            named = spark.createDataFrame(of, "key long, anchor_id long, positive_id long, positive_score long")
            if of:
                kept = negatives(rows, x, labels, limits, negative, low, high, scale).join(F.broadcast(named), "key")
                kept.select("anchor_id", "positive_id", "rank", F.nullif("id", F.lit(int(NO_ID))).alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def op13_kronecker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every EVERY-th vector of embeddings; where vec_id is divisible by 7, the label is the next one."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    df = df.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    scratch = Scratch(spark)
    return mine_negatives(prepared(df, scratch), F.col("id") % EVERY == 0, scratch)


SQL = {"op13_kronecker": f"""WITH e AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, e.vec_id, a.label = e.label AS same, list_dot_product(a.v, e.v)::BIGINT AS score FROM e a JOIN e ON a.vec_id % {EVERY} = 0 AND a.vec_id <> e.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
n AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score)
SELECT * FROM n WHERE rank <= {NEGATIVES}"""}
