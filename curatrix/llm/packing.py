"""Best-fit packing by a grouping genetic algorithm on islands.

Documents are tokenised and cut to pieces of at most the capacity; full pieces are sequences of their own.
The others are dealt at random into blocks of bounded size. Several islands evolve each block: a
chromosome is a grouping of the block's pieces into sequences, the first ones from noisy best-fit
decreasing. Crossover injects whole well-filled sequences of one parent into the other, drops the
sequences there that hold one of their pieces, and best-fits what that displaced. After each epoch the
elites of every island move to the next one. Pieces of sequences that are left badly filled are dealt anew
and packed in a second round.

Defined results: a null or empty text is one piece with the end id alone; repeated rows are packed each;
an empty table gives an empty result; a long text is encoded whole and cut into pieces. Other columns are never read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .scratch import Scratch
from .tokens import encoder

CAPACITY, END = 2048, 0
VOCABULARY = "word_bpe_49k.json"
BLOCK_PIECES, ISLANDS, EPOCHS, POPULATION, CHILDREN = 2048, 2, 2, 4, 10
#: Sequences filled to this share stay as they are after the first round.
WELL_FILLED = 0.998


def _pieces(batches, name: str, capacity: int):
    coder = encoder(name, True)
    for batch in batches:
        for i, ids, at in coder.column(batch.column("text"), END):
            size = np.diff(at)
            n = -(-size // capacity)
            row = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(capacity, size[row] - start)
            raw = memoryview(ids.astype("<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * (a + b)]) for a, b in zip((at[row] + start).tolist(), length.tolist())]
            take = pa.array(row + i)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )


class _Room:
    """Sequences by free room, for best fit in constant time."""

    def __init__(self, capacity: int):
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def put(self, room: int, group: int) -> None:
        self.by_room[room].append(group)
        self.mask |= 1 << room

    def fit(self, size: int) -> tuple[int, int] | None:
        """The group with the least room of at least size, taken out."""
        high = self.mask >> size
        if not high:
            return None
        room = size + (high & -high).bit_length() - 1
        group = self.by_room[room].pop()
        if not self.by_room[room]:
            self.mask &= ~(1 << room)
        return room, group


def _best_fit(sizes: list[int], items, groups: np.ndarray, fill: np.ndarray, capacity: int) -> np.ndarray:
    """groups with the items placed, in their order, into the groups of positive fill or new ones; renumbered."""
    room = _Room(capacity)
    for g in np.flatnonzero((fill > 0) & (fill < capacity)).tolist():
        room.put(capacity - int(fill[g]), g)
    new = len(fill)
    for i in items:
        got = room.fit(sizes[i])
        if got is None:
            got = capacity, new
            new += 1
        groups[i] = got[1]
        if got[0] > sizes[i]:
            room.put(got[0] - sizes[i], got[1])
    return np.unique(groups, return_inverse=True)[1]


def _worth(groups: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer sequences first, then fuller ones: the mean square of fill."""
    fill = np.bincount(groups, sizes)
    return -len(fill), float(((fill / capacity) ** 2).mean())


def _cross(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, as_list: list[int], rng, capacity: int) -> np.ndarray:
    fill = np.bincount(b, sizes)
    good = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    chosen = np.zeros(len(fill), bool)
    chosen[rng.choice(good, max(1, len(good) // 5), replace=False)] = True
    inject = chosen[b]
    hit = np.zeros(a.max() + 1, bool)
    hit[a[inject]] = True
    own = np.bincount(a, sizes)
    hit[rng.choice(len(own), max(1, len(own) // 100))] = True  # a small mutation: some sequences dissolve
    hit[np.argmin(own)] = True
    child = a.copy()
    child[inject] = len(own) + b[inject]
    out = np.flatnonzero(hit[a] & ~inject)
    child[out] = 0
    total = np.zeros(len(own) + len(fill))
    rest = ~inject
    rest[out] = False
    total[: len(own)] = np.bincount(a[rest], sizes[rest], len(own))
    total[len(own) :] = np.where(chosen, fill, 0)
    return _best_fit(as_list, out[np.argsort(-sizes[out], kind="stable")].tolist(), child, total, capacity)


def evolve(sizes: np.ndarray, rng, capacity: int, population: int = POPULATION, children: int = CHILDREN, elites: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """The population after one epoch, best first: for each piece the number of its sequence."""
    as_list = sizes.tolist()
    pool = list(elites or [])
    while len(pool) < population:
        noise = 1 if not pool else rng.uniform(0.9, 1.1, len(sizes))
        pool.append(_best_fit(as_list, np.argsort(-sizes * noise, kind="stable").tolist(), np.zeros(len(sizes), np.int64), np.zeros(0), capacity))
    least = -(-int(sizes.sum()) // capacity)
    pool.sort(key=lambda g: _worth(g, sizes, capacity), reverse=True)
    for _ in range(children):
        if len(sizes) < 2 or (pool[0].max() + 1 <= least):
            break
        i, j = rng.choice(len(pool), 2, replace=False)
        pool.append(_cross(pool[i], pool[j], sizes, as_list, rng, capacity))
        pool.sort(key=lambda g: _worth(g, sizes, capacity), reverse=True)
        pool.pop()
    return pool


def _pack_round(items: DataFrame, scratch: Scratch, capacity: int, count: int, number: int) -> DataFrame:
    """pid, length, sequence, fill of items (pid, length): the best grouping of each block."""
    blocks = max(1, -(-count // BLOCK_PIECES))
    dealt = items.select(F.expr(f"pmod(xxhash64(pid, {number}), {blocks})").cast("int").alias("block"), F.struct("pid", "length").alias("item"))
    table = scratch.save(dealt.groupBy("block").agg(F.sort_array(F.collect_list("item")).alias("items")).withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1)))))

    def epoch(number: int):
        def run(key, left: pd.DataFrame, right: pd.DataFrame | None = None) -> pd.DataFrame:
            sizes = np.array([x["length"] for x in left["items"].iloc[0]], np.int64)
            rng = np.random.default_rng([int(key[0]), int(key[1]), number])
            guests = [np.frombuffer(x, np.int32).astype(np.int64) for x in right["groups"]] if right is not None else None
            pool = evolve(sizes, rng, capacity, elites=guests)[: POPULATION // 2]
            return pd.DataFrame({"block": int(key[0]), "island": int(key[1]), "groups": [g.astype(np.int32).tobytes() for g in pool], "worth": [sum(_worth(g, sizes, capacity)) for g in pool]})

        return run

    schema = "block int, island int, groups binary, worth double"
    elites = scratch.save(table.groupBy("block", "island").applyInPandas(lambda key, frame: epoch(0)(key, frame), schema))
    for e in range(1, EPOCHS):
        moved = elites.unionByName(elites.withColumn("island", (F.col("island") + 1) % ISLANDS))
        elites = scratch.save(table.groupBy("block", "island").cogroup(moved.groupBy("block", "island")).applyInPandas(epoch(e), schema))
    best = elites.groupBy("block").agg(F.max_by("groups", F.struct("worth", "island")).alias("groups"))

    def spread(frames):
        for frame in frames:
            for block, items, groups in zip(frame["block"], frame["items"], frame["groups"]):
                group = np.frombuffer(groups, np.int32).astype(np.int64)
                size = np.array([x["length"] for x in items], np.int64)
                order = np.argsort(group, kind="stable")
                run = np.cumsum(size[order]) - size[order]
                first = np.searchsorted(group[order], np.arange(group.max() + 1))
                offset = np.empty(len(size), np.int64)
                offset[order] = run - run[first][group[order]]
                yield pd.DataFrame({"pid": [x["pid"] for x in items], "length": size, "sequence_id": ((number * (1 << 32) + int(block)) << 16) + group, "offset": offset, "fill": np.bincount(group, size)[group].astype(np.int64)})

    return table.where("island = 0").join(best, "block").select("block", "items", "groups").mapInPandas(spread, "pid long, length long, sequence_id long, offset long, fill long")


def pack(docs: DataFrame, scratch: Scratch, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for docs (doc_id, text)."""
    pieces = docs.select("doc_id", "text").mapInArrow(lambda it: _pieces(it, vocabulary, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")
    pieces = scratch.save(pieces.withColumn("pid", F.monotonically_increasing_id()))
    small = pieces.where(F.col("length") < capacity).select("pid", "length")
    first = scratch.save(_pack_round(small, scratch, capacity, small.count(), 1))
    full = F.col("fill") >= WELL_FILLED * capacity
    rest = first.where(~full).select("pid", "length")
    second = _pack_round(rest, scratch, capacity, rest.count(), 2)
    placed = first.where(full).unionByName(second).select("pid", "sequence_id", "offset")
    alone = pieces.where(F.col("length") == capacity).select("pid", (-1 - F.col("pid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return pieces.join(placed.unionByName(alone), "pid").drop("pid")


def op1_group_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the pieces of all documents and their places in sequences."""
    return pack(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), Scratch(spark))
