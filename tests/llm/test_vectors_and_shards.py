"""Centroids, hard negatives and shards against brute force, on rows with every awkward case."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.llm import centroids, hard_negatives, sharding
from curatrix.llm.registry import QUERIES
from curatrix.llm.scratch import Scratch

RNG = np.random.default_rng(5)


def vectors():
    """Rows with ties, repeats, wrong widths, missing and infinite components, large ones, and a vector that many share."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(6, 64)) * 0.2
    rows = [(i, (base[i % 6] + rng.normal(size=64) * 0.02).round(2).tolist(), int(i % 6 % 3)) for i in range(400)]
    rows += [(i, base[1].round(2).tolist(), 1) for i in range(400, 520)] + [rows[100], rows[100], rows[200]]
    bad = base[0].tolist()
    rows += [(600, None, 1), (700, bad[:-1] + [None], 1), (800, bad[:-1] + [math.nan], 2), (900, bad[:-1] + [math.inf], 2), (1000, bad[:10], 0), (1100, [], 0), (1200, bad, None), (None, bad, 0), (1300, [1e300] + bad[1:], 0), (-700, bad, 2), (-7, [0.0] * 64, 2)]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("vectors"))
    clash = [(*r, 1, "c", 2, 3) for r in vectors()]
    schema = "vec_id long, embedding array<double>, label int, cluster int, id string, row long, distance long"
    spark.createDataFrame(clash, schema).repartition(5).write.parquet(f"{out}/embeddings.parquet")
    return out


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("none"))
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{out}/embeddings.parquet")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{out}/documents.parquet")
    return out


@pytest.mark.parametrize("name", ["op11_threshold_walk", "op12_virtual_slots", "op13_kronecker"])
def test_empty_tables(spark, nothing, name):
    assert QUERIES[name](spark, nothing).collect() == []


# ---- centroids -----------------------------------------------------------------------------------------


def lloyd(rows, k=8, rounds=10):
    """id, cluster, distance and centroids, by trying every centroid."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    fit = [(i, v) for i, v in kept if max(map(abs, v)) < 2**26]
    rank = lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "~", r[1])
    centres = [v for _, v in sorted(fit, key=rank)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in fit:
            groups[near(v)[1]].append(v)
        centres = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if groups[j] else c for j, c in enumerate(centres)]
    out = [(i, *near(v)[::-1]) if max(map(abs, v)) < 2**26 else (i, None, None) for i, v in kept]
    return out, centres


def test_centroids(spark, folder):
    want, centres = lloyd(vectors())
    got = QUERIES["op11_threshold_walk"](spark, folder).collect()
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=str) == sorted(want, key=str)
    sums = Counter()
    for _, c, d in want:
        sums[c] += d or 0
    for r in got:
        if r.cluster is not None:
            assert (r.cluster_inertia, r.inertia, r.centroid_sha256) == (sums[r.cluster], sum(sums.values()), hashlib.sha256(",".join(map(str, centres[r.cluster])).encode()).hexdigest())


@pytest.mark.parametrize("seed", range(12))
def test_walks_find_the_nearest_and_of_equal_ones_the_smallest(seed):
    rng = np.random.default_rng(seed)
    width, k = int(rng.integers(1, 9)), int(rng.integers(1, 30))
    centres, rows = rng.integers(-4, 5, (k, width)), rng.integers(-6, 7, (500, width))
    distance = ((rows[:, None, :] - centres[None]) ** 2).sum(axis=2)
    owner, best = centroids.Lists(centres).nearest(rows)
    assert (best == distance.min(axis=1)).all() and (owner == distance.argmin(axis=1)).all()


def test_a_walk_ends_before_it_has_met_far_centroids():
    """Centroids 1..200 on a line in every dimension: a vector beside one of them must not be compared with all."""
    lists = centroids.Lists(np.repeat(np.arange(200)[:, None] * 100, 4, axis=1))
    compared = []

    class Spy(np.ndarray):
        def __getitem__(self, c):
            compared.append(c)
            return np.asarray(self)[c]

    lists.centres = lists.centres.view(Spy)
    owner, best = lists.nearest(np.full((1, 4), 5003))
    assert owner.tolist() == [50] and best.tolist() == [36] and len(compared) <= 3


def test_few_vectors_give_few_centroids(spark):
    df = spark.createDataFrame([(i, [float(i)] * 64) for i in range(3)], "vec_id long, embedding array<float>")
    found, centres = centroids.cluster(df, Scratch(spark))
    assert len(centres) == 3 and sorted(r.distance for r in found.collect()) == [0, 0, 0]


# ---- hard negatives ------------------------------------------------------------------------------------


def mined(rows):
    part = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        x = [math.floor(256 * y) for y in v]
        if max(map(abs, x), default=0) < 2**26:
            part.append((i, x, (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    key = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for a, (i, x, label) in enumerate(part):
        if i is None or i % 100:
            continue
        scored = sorted(((sum(p * q for p, q in zip(x, y)), j, other == label) for b, (j, y, other) in enumerate(part) if a != b), key=key)
        for score, j, _ in [s for s in scored if s[2]][:5]:
            fits = [s for s in scored if not s[2] and 80 * score <= 100 * s[0] <= 100 * score][:5]
            out += [(i, j, n + 1, s[1], score, s[0]) for n, s in enumerate(fits)]
    return out


def test_hard_negatives(spark, folder):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = [tuple(r) for r in QUERIES["op13_kronecker"](spark, folder).select(*names).collect()]
    want = mined(vectors())
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 100


def test_hard_negatives_in_several_blocks(spark, folder):
    scratch = Scratch(spark)
    df = spark.read.parquet(f"{folder}/embeddings.parquet").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    out = hard_negatives.mine_negatives(hard_negatives.prepared(df, scratch), F.col("id") % 100 == 0, scratch, per_block=2)
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted(mined(vectors()), key=str)


@pytest.mark.parametrize("most, kind", [(9, np.float64), (300, np.float64), (4000, np.uint64), (2**25, object)])
def test_packed_products_are_exact(most, kind):
    """Fields of all three kinds of wide integers, also with extreme components."""
    for n in (1, 2, 7, 50):
        a, c = RNG.integers(-most, most + 1, (5, 64)), RNG.integers(-most, most + 1, (n, 64))
        a[0], c[0], a[1] = most, -most, -most
        packed = hard_negatives.Packed(c, a)
        assert packed.kind is kind and packed.fields >= 2 and (packed.scores(a) == a @ c.T).all()


# ---- shards --------------------------------------------------------------------------------------------

TEXT = "word " * 200


def documents(spark, rows, parts=6):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, shard int, size long, file string").repartition(parts)


def test_shards_hold_like_bytes(spark, tmp_path):
    rows = [(i, f"{i} " + "é" * int(x)) for i, x in enumerate(RNG.pareto(1.5, 3000) * 300 + 1)]
    rows += [(None, "a null id")] * 2 + [(5000, None), (5001, ""), (-3, "x" * 200_000)] + [(7, "one id, a third of all rows " + TEXT)] * 1500
    spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, shard int, size long, file string").repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op12_virtual_slots"](spark, str(tmp_path)).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want
    loads, places = Counter(), defaultdict(list)
    for r in out:
        loads[r.shard] += r["size"]
        places[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert set(loads) == set(range(16)) and all(sorted(v) == list(range(len(v))) for v in places.values())
    assert max(loads.values()) < 1.02 * min(loads.values())
    once = {r.doc_id: r.virtual_slot for r in out}
    assert all(once[r.doc_id] == r.virtual_slot for r in out)  # an id has one slot, however many parts that has


def test_an_edit_moves_only_what_it_must(spark):
    rows = [(i, "x" * int(n)) for i, n in enumerate(RNG.integers(1, 900, 4000))]
    scratch = Scratch(spark)
    out, slot_map = sharding.shard(documents(spark, rows), scratch, shards=5, slots=512)
    assert slot_map.version() == 2
    before = {(r.slot, r.part): r.shard for r in slot_map.at(1).collect()}
    after = {(r.slot, r.part): r.shard for r in slot_map.at().collect()}
    assert before.keys() == after.keys() and len(before) == 512
    moved = sum(before[k] != after[k] for k in before)
    assert 0 < moved < 512 // 5
    # Once it is balanced, another edit leaves nearly all in place.
    measured = sharding.measured(documents(spark, rows), scratch, slots=512)
    weights = scratch.save(sharding.weigh_parts(measured, slot_map.at()))
    slot_map.edit(lambda last: sharding.rebalanced(last, weights, 5))
    again = {(r.slot, r.part): r.shard for r in slot_map.at().collect()}
    assert slot_map.version() == 3 and sum(after[k] != again[k] for k in after) < 25
    # One more shard takes rows, and no row moves anywhere else.
    slot_map.edit(lambda last: sharding.grown(last, weights, 5))
    grown = {(r.slot, r.part): r.shard for r in slot_map.at().collect()}
    assert all(grown[k] in (again[k], 5) for k in again)
    loads = Counter()
    for r in sharding.placed(measured, slot_map.at()).collect():
        loads[r.shard] += r["size"]
    assert set(loads) == set(range(6)) and max(loads.values()) < 1.1 * min(loads.values())
    assert {(r.slot, r.part): r.shard for r in slot_map.at(1).collect()} == before  # readers stay on their version


def test_shards_are_the_same_again(spark):
    rows = [(i, "x" * (i % 71)) for i in range(500)]
    first, second = ({r.key: r.shard for r in sharding.shard(documents(spark, rows, n), Scratch(spark))[0].collect()} for n in (1, 7))
    assert first == second


def test_a_text_of_two_megabytes(spark):
    rows = [(1, "é" * 1_000_000), (2, "a")]
    out = sharding.shard(documents(spark, rows), Scratch(spark))[0].collect()
    assert {r.key: r["size"] for r in out} == {1: 2_000_001, 2: 2} and {r.key: r.crc for r in out}[1] == zlib.crc32(rows[0][1].encode())
