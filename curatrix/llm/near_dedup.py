"""Near-duplicate grouping: SuperMinHash signatures, banding, verification on full shingle sets, union.

A document's set holds its distinct five-word shingles as 64-bit hashes. Element by element, SuperMinHash
deals a random permutation of the signature's places; a place keeps the least (rank, random number) that
any element gives it, and dealing stops once no later rank can win. The kernel deals rank by rank for all
documents of a block at once, and drops documents whose places are all below the next rank: the same stop.

Rows with equal sets form a class, and one row stands for it, so copies cost nothing further. In each
bucket of a band, members are checked against one of them, in a few rounds with another one each time.
Then, in buckets that still hold several components, every member outside the largest one is compared
with all others in blocks. A candidate is passed over only where its sets can't be similar enough: in a sketch
each element flips one bit, so two sketches differ in no more bits than their sets in elements. All others
are verified on full sets; nothing is capped.

Defined results: null or empty texts have an empty set and link with nothing, each its own component; a
text under five words is one shingle; a long text has all its shingles. component_id is the least doc_id reached, null doc_ids aside (null
if there is no other). Repeated rows link like any equal texts. An empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .components import components
from .kernels import LOWER, U, by_doc, flat, lean, mix, span_hashes, spans, words
from .scratch import Scratch, filtered, with_uid

PLACES, ROWS, WIDTH, PERCENT = 128, 4, 5, 75
#: Bits of a sketch; they decide how many dissimilar pairs are seen as such without their full sets.
BITS = 2048
BLOCK_ROWS = 1024
#: Rows of an Arrow batch: documents, or pairs with the sets of both.
ARROW_ROWS = 2000
#: Elements dealt at a time, at PLACES bytes each.
PART = 1 << 19
#: Rounds in which a bucket's members are checked against one of them.
TURNS = 4


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Each document's sorted distinct shingle hashes, one after another, and where each begins."""
    buf = LOWER[buf]
    starts, ends, first = words(buf, offsets)
    h = span_hashes(buf, starts, ends)
    n = len(h)
    size = np.diff(first)
    long = np.zeros(0, U)
    if n >= width:
        long = h[: n - width + 1].copy()
        for k in range(1, width):
            long = mix(long + U(k)) + h[k : n - width + 1 + k]
        long = mix(long)
    out, at = [], [0]
    for i, (a, m) in enumerate(zip(first[:-1].tolist(), size.tolist())):
        if m >= width:
            out.append(np.unique(long[a : a + m - width + 1]))
        elif m:
            whole = h[a : a + 1].copy()
            for k in range(1, m):
                whole = mix(whole + U(k)) + h[a + k : a + k + 1]
            out.append(mix(whole + U(0x5151 * m)))
        else:
            out.append(np.zeros(0, U))
        at.append(at[-1] + len(out[-1]))
    return (np.concatenate(out) if out else np.zeros(0, U)), np.array(at, np.int64)


def super_min_hash(elements: np.ndarray, at: np.ndarray, places: int = PLACES) -> np.ndarray:
    """Signatures, documents by places: rank and random number of the winning element of each place."""
    docs = len(at) - 1
    out = np.full((docs, places), np.iinfo(np.uint64).max, U)
    if len(elements) > PART:
        # A place's winner is the least over parts of a set, so that a long document needs no more memory than a part.
        for d in range(docs):
            for k in range(int(at[d]), int(at[d + 1]), PART):
                part = elements[k : min(k + PART, int(at[d + 1]))]
                out[d] = np.minimum(out[d], super_min_hash(part, np.array([0, len(part)]), places)[0])
        return out
    doc = by_doc(at, len(elements))
    e, perm = elements, None
    live = np.ones(docs, bool)
    for rank in range(places):
        if not len(e):
            break
        rnd = mix(e + U(0x9E3779B97F4A7C15 * (rank + 1) % 2**64))
        pick = (rank + (((rnd >> U(32)) * U(places - rank)) >> U(32)).astype(np.int64)).astype(np.int64)
        if rank == 0:
            place = pick
        else:
            rows = np.arange(len(e))
            place = perm[rows, pick].astype(np.int64)
            perm[rows, pick] = perm[:, rank]
        value = (U(rank) << U(32)) | (rnd & U(0xFFFFFFFF))
        np.minimum.at(out.reshape(-1), doc * places + place, value)
        on = np.flatnonzero(live)
        done = on[out[on].max(axis=1) < (U(rank + 1) << U(32))]
        if rank == 0:
            live[done] = False
            keep = live[doc]
            e, doc, pick = e[keep], doc[keep], pick[keep]
            perm = np.tile(np.arange(places, dtype=np.uint8 if places <= 256 else np.uint16), (len(e), 1))
            perm[np.arange(len(e)), pick] = 0
        elif len(done):
            live[done] = False
            keep = live[doc]
            if keep.sum() < 0.8 * len(e):
                e, doc, perm = e[keep], doc[keep], perm[keep]
    return out


def sketches(elements: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each document's parity sketch, documents by 64-bit words: every element flips the bit that its hash names."""
    docs = len(at) - 1
    bit = (mix(elements ^ U(0x0DD5)) >> U(32)).astype(np.int64) % BITS
    odd = np.bincount(by_doc(at, len(elements)) * BITS + bit, minlength=docs * BITS) & 1
    return np.packbits(odd.astype(bool)).view(U).reshape(docs, BITS // 64)


def _possible(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least number of elements in which sets of sizes n and m with sketches x and y differ, and whether they may be similar enough."""
    apart = np.maximum(np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64), np.abs(n - m))
    return apart, (100 + PERCENT) * apart <= (100 - PERCENT) * (n + m)


@lean
def _sign(batches):
    bands = PLACES // ROWS
    salt = mix(np.arange(1, bands + 1, dtype=U))
    for batch in batches:
        buf, offsets = flat(batch.column("text"))
        size, one, two, band, sketch = [], [], [], [], []
        for i, j in spans(offsets):
            elements, at = shingle_sets(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            size.append(np.diff(at))
            for out, x in ((one, mix(elements ^ U(0xA5A5A5A5))), (two, mix(elements + U(0x1234567)))):
                total = np.zeros(len(x) + 1, U)
                np.cumsum(x, out=total[1:])
                out.append(total[at[1:]] - total[at[:-1]])
            sig = super_min_hash(elements, at)
            b = sig.reshape(len(sig), bands, ROWS)
            key = b[:, :, 0]
            for r in range(1, ROWS):
                key = mix(key) + b[:, :, r]
            band.append(mix(key ^ salt))
            # A sketch takes BITS counters while it is made: some thousand documents at a time.
            for k in range(0, j - i, 1024):
                part = at[k : min(k + 1024, j - i) + 1]
                sketch.append(sketches(elements[part[0] : part[-1]], part - part[0]))
        n = len(offsets) - 1
        cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        band, sketch = cat(band, U).reshape(-1).view(np.int64), cat(sketch, U).reshape(-1)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("uid"), batch.column("doc_id"), pa.array(cat(size, np.int64), pa.int64()), pa.array(cat(one, U).view(np.int64)), pa.array(cat(two, U).view(np.int64)),
                pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(band)),
                pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * (BITS // 8)), pa.py_buffer(sketch)]),
            ],
            ["uid", "doc_id", "n_shingles", "key1", "key2", "bands", "sketch"],
        )


@lean
def _sets(batches):
    for batch in batches:
        buf, offsets = flat(batch.column("text"))
        sets = []
        for i, j in spans(offsets):
            elements, at = shingle_sets(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            sets += [elements[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(sets, pa.binary())], ["uid", "elements"])


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= PERCENT * (len(both) - shared)


@lean
def _verify(batches):
    for batch in batches:
        keep = [_similar(np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)) for x, y in zip(batch.column("x"), batch.column("y"))]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


@lean
def _alike(batches):
    for batch in batches:
        x, y = (np.frombuffer(flat(batch.column(c))[0].tobytes(), U).reshape(batch.num_rows, BITS // 64) for c in ("x", "y"))
        keep = _possible(x, y, np.asarray(batch.column("n")), np.asarray(batch.column("m")))[1]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verified(pairs: DataFrame, sigs: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of uids whose full sets are similar enough; written."""
    x, y = (sigs.select(F.col("uid").alias(u), F.col("sketch").alias(s), F.col("n_shingles").alias(n)) for u, s, n in (("a", "x", "n"), ("b", "y", "m")))
    pairs = scratch.save(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y", "n", "m").mapInArrow(_alike, "a long, b long"))
    sets = scratch.save(shingles_of(docs, pairs.select(F.col("a").alias("uid")).unionByName(pairs.select(F.col("b").alias("uid")))))
    left = sets.select(F.col("uid").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("uid").alias("b"), F.col("elements").alias("y"))
    out = scratch.save(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long"))
    scratch.drop(sets)
    scratch.drop(pairs)
    return out


def shingles_of(docs: DataFrame, uids: DataFrame) -> DataFrame:
    return docs.join(uids.distinct(), "uid", "left_semi").select("uid", "text").mapInArrow(_sets, "uid long, elements binary")


def _agreeing(frame):
    """For each row of side 0, the rows of side 1 in other components that may be similar enough, nearest first."""
    sketch = np.frombuffer(b"".join(frame["sketch"]), U).reshape(len(frame), BITS // 64)
    root, side, n = frame["root"].to_numpy(), frame["side"].to_numpy(), frame["n_shingles"].to_numpy()
    right = np.flatnonzero(side == 1)
    for i in np.flatnonzero(side == 0):
        other = right[root[right] != root[i]]
        apart, may = _possible(sketch[other], sketch[i], n[other], n[i])
        good = np.flatnonzero(may)
        yield i, other[good[np.argsort(apart[good], kind="stable")]]


def _involved(frame: pd.DataFrame) -> pd.DataFrame:
    """The rows of a block pair that may be similar to one of another component; two for each pair at most, each once."""
    uid = frame["uid"].to_numpy()
    found = [np.append(other, i) for i, other in _agreeing(frame) if len(other)]
    return pd.DataFrame({"uid": np.unique(uid[np.concatenate(found)]) if found else np.zeros(0, np.int64)})


def _links(frame: pd.DataFrame) -> pd.DataFrame:
    """Links of a block pair, verified on full sets, as far as they join components that are not yet joined here."""
    uid, root = frame["uid"].to_numpy(), frame["root"].to_numpy()
    sets = [np.frombuffer(x, U) for x in frame["elements"]]
    above = {r: r for r in root.tolist()}

    def find(r):
        while above[r] != r:
            above[r] = r = above[above[r]]
        return r

    a, b = [], []
    for i, other in _agreeing(frame):
        for j in other.tolist():
            p, q = find(root[i]), find(root[j])
            if p != q and _similar(sets[i], sets[j]):
                above[max(p, q)] = min(p, q)
                a.append(uid[i])
                b.append(uid[j])
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def _placed(member: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return member.withColumn("root", F.col("uid"))
    return member.join(roots, F.col("uid") == F.col("node"), "left").select(*member.columns, F.coalesce("root", "uid").alias("root"))


def _rest(member: DataFrame, roots: DataFrame, sigs: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Links between components that still share a bucket: every member outside a bucket's largest component against all others, in blocks."""
    placed = _placed(member, roots)
    per_root = placed.groupBy("band", "bucket", "root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("uid").cast("decimal(38,0)")).alias("print"))
    mixed = per_root.groupBy("band", "bucket").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"), F.sum("print").alias("print")).where("n > most")
    # Buckets with the same members: one of them will do.
    mixed = mixed.groupBy("n", "most", "print").agg(F.min(F.struct("band", "bucket", "main")).alias("one")).select("one.*")
    # Similar sets are of similar size: a row meets only those of its own step of sizes and of the two beside it.
    step = F.floor(F.log(F.col("n_shingles").cast("double")) / float(np.log(100 / PERCENT) * 1.0001)).cast("int")
    rows = scratch.save(placed.join(mixed, ["band", "bucket"]).join(sigs.select("uid", step.alias("step")), "uid"))
    cell = ["band", "bucket", "step"]
    outside = rows.where("root <> main").select("band", "bucket", F.explode(F.expr("array(step - 1, step, step + 1)")).alias("step"), F.lit(0).alias("side"), "uid", "root")
    both = outside.unionByName(rows.select(*cell, F.lit(1).alias("side"), "uid", "root"))
    sizes = both.groupBy(*cell).agg(F.ceil(F.count_if(F.col("side") == 0) / BLOCK_ROWS).cast("int").alias("out_blocks"), F.ceil(F.count_if(F.col("side") == 1) / BLOCK_ROWS).cast("int").alias("all_blocks"))
    both = both.join(sizes.where("out_blocks > 0 and all_blocks > 0"), cell)
    mine = lambda blocks: F.expr(f"cast(pmod(xxhash64(uid), {blocks}) as int)")
    every = lambda blocks: F.explode(F.expr(f"sequence(0, {blocks} - 1)"))
    outside = both.where("side = 0").select(*cell, mine("out_blocks").alias("i"), every("all_blocks").alias("j"), "side", "uid", "root")
    everyone = both.where("side = 1").select(*cell, every("out_blocks").alias("i"), mine("all_blocks").alias("j"), "side", "uid", "root")
    block = [*cell, "i", "j"]
    cells = outside.unionByName(everyone).join(sigs, "uid")
    involved = scratch.save(cells.groupBy(*block).applyInPandas(_involved, "uid long").distinct())
    sets = scratch.save(shingles_of(docs, involved))
    out = scratch.save(cells.join(sets, "uid").groupBy(*block).applyInPandas(_links, "a long, b long"))
    for table in (rows, involved, sets):
        scratch.drop(table)
    return out


def near_groups(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """uid, doc_id, n_shingles, component_id, first (whether the row stands for its component) of docs (uid, doc_id, text)."""
    with scratch.small_batches(ARROW_ROWS):
        return _near_groups(docs, scratch)


def _near_groups(docs: DataFrame, scratch: Scratch) -> DataFrame:
    signed = scratch.save(docs.select("uid", "doc_id", "text").mapInArrow(_sign, "uid long, doc_id long, n_shingles long, key1 long, key2 long, bands array<long>, sketch binary"))
    full = signed.where("n_shingles > 0")
    classes = scratch.save(full.groupBy("n_shingles", "key1", "key2").agg(F.min("uid").alias("cls"), F.min("doc_id").alias("least"), F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), "uid")).alias("head")))
    heads = full.join(classes.select(F.col("cls").alias("uid")), "uid", "left_semi")
    band = heads.select("uid", F.posexplode("bands").alias("band", "bucket"))
    shared = band.groupBy("band", "bucket").count().where("count > 1").drop("count")
    member = scratch.save(band.join(shared, ["band", "bucket"]))
    sigs = scratch.save(full.select("uid", "n_shingles", "sketch").join(member.select("uid").distinct(), "uid", "left_semi"))
    # Each bucket's members against one of them, another one each time; what is connected by then needs no more.
    roots = None
    for turn in range(TURNS):
        placed = _placed(member, roots)
        pivot = placed.groupBy("band", "bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min_by(F.struct("uid", "root"), F.xxhash64("uid", F.lit(turn))).alias("p")).where("low <> high")
        pairs = placed.join(pivot, ["band", "bucket"]).where("root <> p.root").select(F.greatest("uid", "p.uid").alias("a"), F.least("uid", "p.uid").alias("b")).distinct()
        links = verified(pairs, sigs, docs, scratch)
        if roots is not None:
            if not links.limit(1).count():
                break
            links = links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = scratch.save(components(links, scratch))
    more = _rest(member, roots, sigs, docs, scratch)
    roots = scratch.save(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), scratch))
    groups = classes.join(roots, F.col("cls") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cls"))
    best = groups.groupBy("root").agg(F.min("least").alias("component_id"), F.min("head").alias("head"))
    named = groups.join(best.select("root", "component_id", F.col("head.uid").alias("head_uid")), "root").select("n_shingles", "key1", "key2", "component_id", "head_uid")
    linked = full.select("uid", "doc_id", "n_shingles", "key1", "key2").join(named, ["n_shingles", "key1", "key2"]).select("uid", "doc_id", "n_shingles", "component_id", (F.col("uid") == F.col("head_uid")).alias("first"))
    alone = signed.where("n_shingles = 0").select("uid", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    return linked.unionByName(alone)


def op10_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = with_uid(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch)
    return near_groups(docs, scratch).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near-duplicates stays, with all its columns."""
    scratch = Scratch(spark)
    return filtered(docs, scratch, lambda mine: near_groups(mine, scratch).where("first"), "text")
