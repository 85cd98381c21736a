"""Token shards compressed by Re-Pair grammars, with random access to documents.

Documents in ascending doc_id order are encoded, and each shard of about SHARD_IDS ids gets a grammar of its
own: pairs of adjacent ids are counted, the most frequent ones become nonterminals at once (where two of
them overlap the more frequent wins, and of equal ones the first), and this repeats until no pair pays for
its rule: PAYS replacements save more than a rule takes. Rounds take RULES pairs, then twice as many each
time, since what is rarer matters less in order. No pair takes in the end id, so that every document is a slice of the
compressed sequence.

A shard is one row of a Parquet table (part, shard, n_docs, n_tokens, payload). Payload, all little-endian:
the bytes RPR1; five uint32: vocabulary size, rules, documents, symbols, end id; then rules x 2 uint32 (left and
right symbol; rule k is the symbol vocabulary + k), rules uint32 (ids in its expansion), documents int64
(doc_id; the least integer means null), documents + 1 uint32 (first symbol of each), documents uint64 (ids in
each), symbols uint32.

Defined results: a null or empty text holds the end id alone; null doc_ids come first; repeated ids keep a
row each, in the order written; an empty table gives an empty result; a long text is encoded whole, and a shard holds whole
documents. Other columns are never read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .kernels import look_up
from .scratch import Scratch, partitions
from .tokens import encoder

VOCABULARY, SIZE, END = "byte_bpe_50k.json", 50257, 2
SHARD_IDS, RULES = 1 << 21, 4096
#: Replacements from which a rule of 12 bytes pays, at 4 bytes a symbol.
PAYS = 4
_NULL = np.iinfo(np.int64).min


def _pair_keys(left: np.ndarray, right: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray, int]:
    """A key for each pair, the symbol of each code in it, and its number of bits for a code.

    Codes number the symbols that occur; 16 bits hold them in most shards, which halves what is sorted.
    """
    there = np.zeros(symbols, bool)
    there[left] = there[right] = True
    known = np.flatnonzero(there).astype(np.uint32)
    code = np.zeros(symbols, np.uint32)
    code[known] = np.arange(len(known), dtype=np.uint32)
    kind, bits = (np.uint32, 16) if len(known) < 1 << 16 else (np.uint64, 32)
    return (code[left].astype(kind) << kind(bits)) | code[right].astype(kind), known, bits


def _places(key: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each key is in the ascending wanted ones, -1 elsewhere; by a table of hashes, and by search where two share a place there."""
    spot = lambda k: (k.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(12)
    table = np.full(1 << 20, -1, np.int32)
    table[spot(wanted)] = np.arange(len(wanted), dtype=np.int32)
    out = table[spot(key)]
    near = np.flatnonzero(out >= 0)
    near = near[wanted[out[near]] != key[near]]
    out[near] = look_up(wanted, key[near])
    return out


def compress(ids: np.ndarray, end: int = END, size: int = SIZE, most: int = RULES, least: int = PAYS):
    """Symbols, rules (k by 2), expansion lengths, and for each symbol the number of ids before it.

    The sequence is a linked list, and a round looks only at pairs that are frequent or new: a pair that
    was rare can't become frequent, since replacing makes only pairs with a new symbol.
    """
    n = len(ids)
    seq = np.append(ids, end).astype(np.uint32)
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    rules, length = np.zeros((0, 2), np.uint32), np.ones(size, np.uint32)
    at = np.flatnonzero((seq[:-1] != end) & (seq[1:] != end))
    rank, mark, gone = np.full(n + 2, 1 << 30, np.int32), np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    twins = True  # whether pairs of one symbol with itself take part; their count includes overlaps
    while len(at):
        key, known, bits = _pair_keys(seq[at], seq[after[at]], size + len(rules))
        ordered = np.sort(key)
        edge = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        count = np.diff(np.append(edge, len(ordered)))
        kinds, count = ordered[edge[count >= least]], count[count >= least]
        if not len(kinds):
            break
        # Frequent pairs by rank; those that wait for a later round have a rank beyond all others.
        left, right = (kinds >> kinds.dtype.type(bits)).astype(np.int64), (kinds & kinds.dtype.type((1 << bits) - 1)).astype(np.int64)
        good = np.flatnonzero(twins | (left != right))
        good = good[np.argsort(-count[good], kind="stable")][:most]
        by_kind = np.full(len(kinds) + 1, len(good), np.int32)
        by_kind[good] = np.arange(len(good), dtype=np.int32)
        place = _places(key, kinds)
        keep = np.flatnonzero(place >= 0)
        at, r = at[keep], by_kind[place[keep]]
        # Those that wait can't win: only the others are compared.
        now = np.flatnonzero(r < len(good))
        pair, r = at[now], r[now]
        rank[pair] = r
        here, there = rank[before[pair]], rank[after[pair]]
        hit = r < here
        # In a run of one symbol, whose pairs have the same rank, every other pair is taken.
        again = np.flatnonzero(here == r)
        if len(again):
            number = np.arange(len(again))
            run = np.maximum.accumulate(np.where(np.diff(again, prepend=-2) != 1, number, 0))
            hit[again[(number - run) % 2 == 1]] = True
        hit = np.flatnonzero(hit & (r <= there))
        # Rules that don't pay where they won are left out.
        won = np.bincount(r[hit], minlength=len(good)) >= least
        rank[pair] = 1 << 30
        if not won.any():
            if not twins:
                break
            twins = False
            continue
        twins, most = True, 2 * most
        hit = hit[won[r[hit]]]
        new = np.stack([known[left[good[won]]], known[right[good[won]]]], 1)
        first = pair[hit]
        second = after[first]
        seq[first] = size + len(rules) + (np.cumsum(won) - 1)[r[hit]]
        gone[second] = True
        after[first] = after[second]
        before[after[first]] = first
        rules, length = np.concatenate([rules, new]), np.concatenate([length, length[new[:, 0]] + length[new[:, 1]]])
        mark[at] = mark[first] = True
        mark[before[first][before[first] >= 0]] = True
        mark &= ~gone
        at = np.flatnonzero(mark)
        mark[at] = False
        at = at[(seq[at] != end) & (seq[after[at]] != end)]
    seq = seq[:-1][~gone[:-1]]
    each = length[seq].astype(np.int64)
    return seq, rules, length[size:], np.cumsum(each) - each


def expand(symbols: np.ndarray, rules: np.ndarray, size: int) -> np.ndarray:
    """The ids that symbols stand for."""
    out = symbols.astype(np.uint32)
    while len(out) and out.max() >= size:
        deep = out >= size
        at = np.cumsum(deep + 1) - (deep + 1)
        wide = np.empty(len(out) + int(deep.sum()), np.uint32)
        wide[at] = out
        wide[at[deep]] = rules[out[deep] - size, 0]
        wide[at[deep] + 1] = rules[out[deep] - size, 1]
        out = wide
    return out


def to_bytes(doc_ids: np.ndarray, ids: np.ndarray, offsets: np.ndarray, end: int = END, size: int = SIZE) -> bytes:
    seq, rules, length, place = compress(ids, end, size)
    first = np.searchsorted(place, offsets).astype("<u4")
    head = np.array([size, len(rules), len(doc_ids), len(seq), end], "<u4")
    return b"".join([b"RPR1", head.tobytes(), rules.astype("<u4").tobytes(), length.astype("<u4").tobytes(), doc_ids.astype("<i8").tobytes(), first.tobytes(), np.diff(offsets).astype("<u8").tobytes(), seq.astype("<u4").tobytes()])


class Shard:
    """A payload, read without copying; a document's ids, or any range of ids, are decoded on demand."""

    def __init__(self, payload: bytes):
        if payload[:4] != b"RPR1":
            raise ValueError("not a token shard")
        self.size, n, docs, m, self.end = (int(x) for x in np.frombuffer(payload, "<u4", 5, 4))
        at = 24
        self.rules = np.frombuffer(payload, "<u4", 2 * n, at).reshape(-1, 2)
        self.lengths = np.frombuffer(payload, "<u4", n, at := at + 8 * n)
        self.doc_ids = np.frombuffer(payload, "<i8", docs, at := at + 4 * n)
        self.first = np.frombuffer(payload, "<u4", docs + 1, at := at + 8 * docs)
        self.n_ids = np.frombuffer(payload, "<u8", docs, at := at + 4 * (docs + 1))
        self.symbols = np.frombuffer(payload, "<u4", m, at + 8 * docs)

    def document(self, k: int) -> np.ndarray:
        return expand(self.symbols[self.first[k] : self.first[k + 1]], self.rules, self.size)

    def ids(self, first: int, end: int) -> np.ndarray:
        """The ids from first to end of the shard; only the symbols whose expansion reaches into them are expanded."""
        if not hasattr(self, "ends"):
            wide = self.symbols >= self.size
            each = np.ones(len(self.symbols), np.int64)
            each[wide] = self.lengths[self.symbols[wide] - self.size]
            self.ends = np.cumsum(each)
        i, j = np.searchsorted(self.ends, first, "right"), np.searchsorted(self.ends, end)
        before = int(self.ends[i - 1]) if i else 0
        return expand(self.symbols[i : j + 1], self.rules, self.size)[first - before : end - before]

    def all(self) -> np.ndarray:
        """All ids. Each rule is expanded once and copied from there, unless these texts together are longer than what they stand for."""
        if int(self.lengths.sum(dtype=np.int64)) > int(self.n_ids.sum()):
            return expand(self.symbols, self.rules, self.size)
        pool = np.concatenate([np.arange(self.size, dtype=np.uint32), expand(np.arange(self.size, self.size + len(self.rules)), self.rules, self.size)])
        each = np.concatenate([np.ones(self.size, np.int64), self.lengths])
        begin, each = (np.cumsum(each) - each)[self.symbols], each[self.symbols]
        stop = np.cumsum(each)
        return pool[np.repeat(begin - stop + each, each) + np.arange(stop[-1] if len(stop) else 0)]


def _write(batches, name: str, end: int):
    coder, part, shard = encoder(name, False), TaskContext.get().partitionId(), 0
    keys, ids, sizes, total = [], [], [], 0

    def flush():
        nonlocal keys, ids, sizes, total, shard
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        doc_ids = np.concatenate(keys)
        payload = to_bytes(doc_ids, np.concatenate(ids), offsets, end, coder.tokenizer.get_vocab_size())
        row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(doc_ids)], pa.int64()), pa.array([int(offsets[-1])], pa.int64()), pa.array([payload], pa.binary())], ["part", "shard", "n_docs", "n_tokens", "payload"])
        keys, ids, sizes, total, shard = [], [], [], 0, shard + 1
        return row

    for batch in batches:
        doc_id = batch.column("doc_id").fill_null(int(_NULL)).to_numpy()
        for i, block, at in coder.column(batch.column("text"), end):
            keys.append(doc_id[i : i + len(at) - 1])
            ids.append(block)
            sizes.append(np.diff(at))
            total += len(block)
            if total >= SHARD_IDS:
                yield flush()
    if keys:
        yield flush()


def write_shards(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int = END) -> None:
    """Write docs (doc_id, text) as token shards in ascending doc_id order."""
    n = partitions(docs.sparkSession)
    ordered = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(lambda it: _write(it, vocabulary, end), "part int, shard int, n_docs long, n_tokens long, payload binary").write.parquet(path)


def _read(batches):
    for batch in batches:
        for before, payload in zip(batch.column("before").to_pylist(), batch.column("payload")):
            shard = Shard(payload.as_buffer().to_pybytes())
            raw = memoryview(shard.all().astype("<u4", copy=False)).cast("B")
            n = shard.n_ids.astype(np.int64)
            at = np.concatenate([[0], np.cumsum(n)])
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            null = shard.doc_ids == _NULL
            yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids.astype(np.int64), pa.int64(), mask=null), pa.array(at[:-1] + before, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the shards."""
    shards = spark.read.schema("part int, shard int, n_docs long, n_tokens long, payload binary").parquet(path)
    # One number for each part, of which there are as many as writing tasks.
    totals = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    starts, run = [], 0
    for part, n in totals:
        starts.append((part, run))
        run += n
    parts = spark.createDataFrame(starts, "part int, base long")
    sizes = shards.select("part", "shard", "n_tokens")
    within = sizes.withColumn("inside", F.expr("sum(n_tokens) OVER (PARTITION BY part ORDER BY shard) - n_tokens")).join(F.broadcast(parts), "part").select("part", "shard", (F.col("base") + F.col("inside")).alias("before"))
    return shards.join(within, ["part", "shard"]).select("before", "payload").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_repair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark).root + "/shards"
    write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), path)
    return read_shards(spark, path)
