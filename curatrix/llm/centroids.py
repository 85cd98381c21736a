"""Centroid clustering with exact integers: every vector finds its centroid by the threshold algorithm.

For each dimension the centroids stand in a list sorted by their value there. A vector walks each list outward from its own
value, the nearer side first, all lists one place at a time. A centroid that turns up gets its exact distance; one that has
not turned up lies, in every dimension, at least as far as that list's frontier, so the walk ends as soon as the sum of the
frontiers' squared distances strictly exceeds the best exact distance (an equal one may still belong to a smaller number).

Vectors stay where the scan has them: a round is one pass, in which each task returns sums and counts of its clusters, a
row for each cluster and dimension, that are added up by grouping. The driver holds the k centroids and nothing else, so
neither a hot cluster nor a vector that many rows share gathers anywhere.

Rows: a vector takes part if it has `width` components, none null or not finite; other rows are not returned. Repeated rows and
ids each count. A null id is returned and counts, but starts no centroid unless there are too few others. Fewer than k vectors
give fewer centroids; an empty table gives an empty result. A vector with a component of 2**26 or more (after scaling) has no
distance in 64 bits: it takes no part, and is returned with nulls. Columns other than id and vector are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .scratch import Scratch
from .vectors import LIMIT, lengths, scaled

K, ROUNDS, SCALE, WIDTH, SEED = 8, 10, 1024, 64, 3
#: Vectors walked at a time.
BLOCK = 4096


class Lists:
    """Centroids (k x width, integers) in a sorted list for each dimension."""

    def __init__(self, centres: np.ndarray):
        self.centres = centres
        self.order = np.argsort(centres, axis=0, kind="stable")
        self.values = np.take_along_axis(centres, self.order, 0)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each row's centroid, of equally near ones the smallest, and its squared distance."""
        (n, width), k = rows.shape, len(self.centres)
        owner, best = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
        far, dims = np.int64(2**40), np.arange(width)
        at = np.arange(n)  # the rows still walking
        right = np.column_stack([np.searchsorted(self.values[:, j], rows[:, j]) for j in range(width)]) if width else np.zeros((n, 0), np.int64)
        left, seen = right - 1, np.zeros((n, k), bool)
        for _ in range(k):
            x = rows[at]
            down = np.where(left >= 0, x - self.values[np.maximum(left, 0), dims], far)
            up = np.where(right < k, self.values[np.minimum(right, k - 1), dims] - x, far)
            rises = up < down
            met = self.order[np.where(rises, np.minimum(right, k - 1), np.maximum(left, 0)), dims]
            new = np.zeros((len(at), k), bool)
            new[np.arange(len(at))[:, None], met] = True
            new &= ~seen
            seen |= new
            for c in np.flatnonzero(new.any(axis=0)):
                which = at[new[:, c]]
                distance = ((rows[which] - self.centres[c]) ** 2).sum(axis=1)
                better = (distance < best[which]) | ((distance == best[which]) & (c < owner[which]))
                owner[which[better]], best[which[better]] = c, distance[better]
            frontier = (np.minimum(up, down) ** 2).sum(axis=1)
            walking = ~((frontier > best[at]) | seen.all(axis=1))
            if not walking.any():
                break
            at, seen = at[walking], seen[walking]
            left, right = (left - ~rises)[walking], (right + rises)[walking]
        return owner, best


def _quantised(batch: pa.RecordBatch, width: int, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the vectors that take part, their integers, and the places of those with too large components."""
    whole = np.flatnonzero(lengths(batch.column(1)) == width)
    x = scaled(batch.column(1).take(pa.array(whole)), scale, width)
    finite = np.isfinite(x).all(axis=1)
    fits = (np.abs(np.where(np.isfinite(x), x, 0)) < LIMIT).all(axis=1)
    return whole[finite & fits], x[finite & fits].astype(np.int64), whole[finite & ~fits]


def _vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where("v is not null")


def first_centroids(vectors: DataFrame, k: int = K, width: int = WIDTH, scale: int = SCALE, seed: int = SEED) -> np.ndarray:
    """The k vectors (id, v) whose ids have the least SHA-256 after the seed; equal ids go by their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, x, _ = _quantised(batch, width, scale)
            rank = np.array(batch.column(2).fill_null("~").take(pa.array(places)).to_pylist(), "U64")
            if len(rank) > k:  # the first k of a batch are enough
                few = np.flatnonzero(rank <= np.partition(rank, k - 1)[k - 1])
                few = few[np.lexsort((*x[few].T[::-1], rank[few]))[:k]]
                x, rank = x[few], rank[few]
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, width), pa.int32()), pa.array(x.ravel()))
            yield pa.record_batch([pa.array(rank.tolist(), pa.string()), vectors], ["rank", "v"])

    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.select("id", "v", rank.alias("rank")).mapInArrow(run, "rank string, v array<long>").orderBy("rank", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64).reshape(len(rows), width)


def next_centroids(vectors: DataFrame, centres: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Every centroid that has vectors moves to their mean, rounded down in each component; the others stay."""
    k, width = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, sums, counts = Lists(centres), np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = _quantised(batch, width, scale)[1]
            for i in range(0, len(x), BLOCK):
                part = x[i : i + BLOCK]
                owner = lists.nearest(part)[0]
                for c in np.unique(owner):
                    sums[c] += part[owner == c].sum(axis=0)
                counts += np.bincount(owner, minlength=k)
        has = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(np.repeat(has, width)), pa.array(np.tile(np.arange(width), len(has))), pa.array(sums[has].ravel()), pa.array(np.repeat(counts[has], width))], ["c", "d", "total", "n"])

    out = centres.copy()
    parts = vectors.mapInArrow(run, "c long, d long, total long, n long").groupBy("c", "d").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    for r in parts.collect():  # k rows for each dimension
        out[r.c, r.d] = int(r.total) // r.n
    return out


def assign(vectors: DataFrame, centres: np.ndarray, scale: int = SCALE) -> DataFrame:
    """id, cluster, distance (squared) of every vector."""
    width = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(centres)
        for batch in batches:
            places, x, large = _quantised(batch, width, scale)
            found = [lists.nearest(x[i : i + BLOCK]) for i in range(0, len(x), BLOCK)]
            owner, distance = (np.concatenate([np.zeros(0, np.int64), *(f[j] for f in found)]) for j in (0, 1))
            none = pa.nulls(len(large), pa.int64())
            ids = batch.column(0).take(pa.array(np.concatenate([places, large])))
            yield pa.record_batch([ids, pa.concat_arrays([pa.array(owner), none]).cast(pa.int32()), pa.concat_arrays([pa.array(distance), none])], ["id", "cluster", "distance"])

    return vectors.mapInArrow(run, "id long, cluster int, distance long")


def cluster(df: DataFrame, scratch: Scratch, key: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """id, cluster, distance of every vector after the given rounds, stored; and the centroids."""
    vectors = _vectors(df, key, vector)
    centres = first_centroids(vectors, k, width, scale, seed)
    for _ in range(rounds if len(centres) else 0):
        after = next_centroids(vectors, centres, scale)
        if (after == centres).all():
            break  # no later round changes anything
        centres = after
    if not len(centres):
        return vectors.where("false").select("id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")), centres
    return scratch.save(assign(vectors, centres, scale)), centres


def described(assigned: DataFrame, centres: np.ndarray) -> DataFrame:
    """assigned with cluster_inertia, inertia and centroid_sha256; sums that no long holds are null."""
    spark = assigned.sparkSession
    sums = {r.cluster: int(r.s) for r in assigned.where("cluster is not null").groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    fits = lambda x: x if x < 2**63 else None
    about = [(c, fits(s), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, centres[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    table = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster", "left")


def op11_threshold_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of embeddings."""
    found, centres = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(spark))
    return described(found, centres).select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(rounds: int = ROUNDS) -> str:
    """The same rounds, unrolled."""
    square = "list_sum(list_transform(list_zip(e.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    steps = [
        f"""e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {WIDTH})""",
        "d AS MATERIALIZED (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS c, v FROM e QUALIFY c < {K})",
    ]
    for t in range(rounds + 1):
        steps.append(f"a{t} AS MATERIALIZED (SELECT e.r, e.vec_id, c.c, {square} AS distance FROM e, c{t} c QUALIFY row_number() OVER (PARTITION BY e.r ORDER BY {square}, c.c) = 1)")
        if t < rounds:
            steps.append(f"""c{t + 1} AS MATERIALIZED (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM a{t} JOIN d USING (r) GROUP BY c, i) GROUP BY c
  UNION ALL SELECT c, v FROM c{t} WHERE c NOT IN (SELECT c FROM a{t}))""")
    last = rounds
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, a.c::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{last} a JOIN c{last} c ON a.c = c.c"""


SQL = {"op11_threshold_walk": _sql()}
