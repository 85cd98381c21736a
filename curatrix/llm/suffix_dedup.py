"""Removal of long passages that occur in earlier documents, by a logarithmic family of sorted suffix levels.

Documents in ascending doc_id order are gathered into batches of a bounded number of bytes and rows. The
strings that start at a batch's positions, cut at LENGTH bytes, are its suffixes. To index all of them without an entry for
each, a window of LENGTH bytes goes by its seed, the least hash of the K-byte strings in it, so that equal
windows have equal seeds, and a stretch of windows with one seed is a run. Three kinds of entries follow:
a batch's distinct seeds, its distinct runs by content, and, where a seed has runs of different contents, the
windows of those runs. Each kind gives the batch a sorted array of fingerprints with their first rows.

Entries are dealt by fingerprint, so that no deal is hot: a fingerprint has one entry for each batch at most. In a
deal, batches come in their order; neighbours with few keys there go together. They are scanned against the levels as they
stand, which hold earlier documents only, and against each other; what is new becomes a level, and levels of like size
merge, so that there are few. A run or window that a level or the batch itself has for a smaller doc_id is removed.

What is sorted are fingerprints of runs and windows, not the suffixes' text: a suffix array of all positions would take many
times the input. Work in a deal follows its keys, whatever the number of batches. Rows between stages are one for each (batch,
deal) with keys in common, and one for each key at most.

Text moves by batch; what deals send back are arrays by batch. A document beyond PIECE bytes is indexed
piece by piece, with windows across their borders.

Defined results: null or empty texts have no bytes, and none removed; doc_ids that repeat don't count as
smaller than each other; a null doc_id is smaller than all others; an empty table gives an empty result; texts of
any length below 2 GB are handled whole. Other columns are never read. Fingerprints keep 96 bits within a deal, and
the number of deals grows with the text; only if two of different strings met by chance would too much be removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .kernels import U, flat, mix, span_hashes, words_of_eight
from .scratch import Scratch, partitions

LENGTH, K = 50, 20
BATCH_BYTES, BATCH_ROWS = 1 << 23, (1 << 16) - 1
PIECE = 1 << 20
#: Text bytes for each deal of seeds and runs; windows have WINDOW_DEALS times as many deals.
DEAL_BYTES, WINDOW_DEALS = 1 << 24, 2
#: Windows of a run at most; longer runs are cut, which costs only comparisons.
RUN_WINDOWS = 512
SEED, RUN, WINDOW = 0, 1, 2
_BATCH = "batch long, n_bytes long, doc_ids array<long>, heads array<long>, texts array<binary>"
_ROWS = "kind int, deal int, batch long, n long, data binary"


# ---- batches -------------------------------------------------------------------------------------------


def _gather(tables, batch_bytes: int):
    """Sorted documents to a row for each batch; a row's number is batch + its place, and its head the first number with its doc_id."""
    number, last, head, held, size, rows = TaskContext.get().partitionId() << 40, (False, None), 0, [], 0, 0

    def flush():
        ids, heads, texts = pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held]), pa.concat_arrays([h[2] for h in held])
        one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
        return pa.RecordBatch.from_arrays([pa.array([number - rows], pa.int64()), pa.array([size], pa.int64()), one(ids), one(pa.array(heads, pa.int64())), one(texts)], ["batch", "n_bytes", "doc_ids", "heads", "texts"])

    for table in tables:
        ids, texts = table.column("doc_id"), table.column("text")
        value, null = np.asarray(ids.fill_null(0), np.int64), np.asarray(ids.is_null())
        length = np.diff(flat(texts)[1])
        at = 0
        while at < len(ids):
            stop = at + max(int(np.searchsorted(np.cumsum(length[at : at + BATCH_ROWS - rows]), batch_bytes - size, "right")), 0 if held else 1)
            if stop > at:
                v, z = value[at:stop], null[at:stop]
                fresh = np.append((bool(z[0]), int(v[0])) != last, (v[1:] != v[:-1]) | (z[1:] != z[:-1]))
                heads = np.maximum.accumulate(np.where(fresh, number + np.arange(stop - at), head))
                held.append((ids.slice(at, stop - at), heads, texts.slice(at, stop - at)))
                last, head, number, size, rows = (bool(z[-1]), int(v[-1])), int(heads[-1]), number + stop - at, size + int(length[at:stop].sum()), rows + stop - at
                at = stop
            if at < len(ids) or rows == BATCH_ROWS:
                yield flush()
                held, size, rows = [], 0, 0
    if held:
        yield flush()


def batches_of(docs: DataFrame, scratch: Scratch, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """The batches of docs (doc_id, text), written."""
    ordered = docs.select("doc_id", F.col("text").cast("binary").alias("text")).repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id")
    return scratch.save(ordered.mapInArrow(lambda it: _gather(it, batch_bytes), _BATCH))


# ---- runs ----------------------------------------------------------------------------------------------


def _pieces(offsets: np.ndarray, piece: int):
    """Ranges (first byte, end byte, first bytes, ends, documents) of whole documents, or of a part of a long one with the LENGTH - 1 bytes after it."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + piece, "right")) - 1)
        if offsets[j] - offsets[i] <= piece:
            yield int(offsets[i]), int(offsets[j]), offsets[i:j] - offsets[i], offsets[i + 1 : j + 1] - offsets[i], np.arange(i, j)
        else:
            for a in range(int(offsets[i]), int(offsets[j]), piece):
                b = min(a + piece + LENGTH - 1, int(offsets[j]))
                yield a, b, np.array([0]), np.array([b - a]), np.array([i])
        i = j


def _runs(buf: np.ndarray, begin: np.ndarray, end: np.ndarray):
    """Document, first byte, number of windows, and seed of each run of a piece."""
    wide = words_of_eight(buf)
    m = len(buf) - K + 1
    least = mix(wide[:m] * U(0x9E3779B97F4A7C15) + wide[8 : 8 + m] * U(0xC2B2AE3D27D4EB4F) + wide[12 : 12 + m] * U(0x165667B19E3779F9))
    # The least over LENGTH - K + 1 neighbours, by doubling.
    across, have = LENGTH - K + 1, 1
    while have * 2 <= across:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < across:
        least = np.minimum(least[: len(least) - (across - have)], least[across - have :])
    long = np.flatnonzero(end - begin >= LENGTH)
    inside = np.zeros(len(buf) + 1, np.int8)
    np.add.at(inside, begin[long], 1)
    np.add.at(inside, end[long] - LENGTH + 1, -1)
    valid = np.cumsum(inside[: len(least)], dtype=np.int8) > 0
    fresh = valid.copy()
    fresh[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    fresh[begin[long]] = True
    start = np.flatnonzero(fresh)
    doc = np.searchsorted(begin, start, "right") - 1
    stop = np.minimum(np.append(start[1:], len(buf)), end[doc] - LENGTH + 1)
    parts = -(-(stop - start) // RUN_WINDOWS)
    if len(parts) and parts.max() > 1:
        row = np.repeat(np.arange(len(start)), parts)
        first = start[row] + RUN_WINDOWS * (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts))
        stop, start, doc = np.minimum(stop[row], first + RUN_WINDOWS), first, doc[row]
    return doc, start, stop - start, least[start]


def _prints(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return span_hashes(buf, starts, ends), span_hashes(buf, starts, ends, 1)


class Sorted:
    """Distinct 128-bit keys of a batch in ascending order, with the least row of each; `back` leads from what was given to them."""

    def __init__(self, one: np.ndarray, two: np.ndarray, row: np.ndarray):
        order = np.argsort(one)
        same = one[order][1:] == one[order][:-1]
        if (two[order][1:] != two[order][:-1])[same].any():
            order = np.lexsort((two, one))
        new = np.ones(len(one), bool)
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        first = np.flatnonzero(new)
        self.one, self.two = one[order][first], two[order][first]
        self.row = np.minimum.reduceat(row[order], first) if len(first) else row
        self.back = np.empty(len(one), np.int64)
        self.back[order] = np.cumsum(new) - 1

    def _place(self, deals: int) -> np.ndarray:
        """The keys' place among all, times deals: the deal, and 32 bits below it."""
        low = U(0xFFFFFFFF)
        return (self.one >> U(32)) * U(deals) + ((self.one & low) * U(deals) >> U(32))

    def edges(self, deals: int) -> np.ndarray:
        """Where each deal's keys begin: a deal is a range of keys."""
        return np.searchsorted((self._place(deals) >> U(32)).astype(np.int64), np.arange(deals + 1))

    def within(self, deals: int) -> np.ndarray:
        """The 32 bits by which keys ascend within a deal; with the deal they stand for the first half of a key."""
        return (self._place(deals) & U(0xFFFFFFFF)).astype(np.uint32)


class Batch:
    """The runs of a batch, its sorted seeds and run contents."""

    def __init__(self, heads: np.ndarray, buf: np.ndarray, offsets: np.ndarray, number: int, piece: int = PIECE):
        self.number, self.heads, self.buf, self.offsets = number, heads, buf, offsets
        parts = [[] for _ in range(6)]
        for lo, hi, begin, end, docs in _pieces(offsets, piece):
            if hi - lo < LENGTH:
                continue
            part = buf[lo:hi]
            doc, first, windows, seed = _runs(part, begin, end)
            one, two = _prints(part, first, first + windows + LENGTH - 1)
            for out, x in zip(parts, (docs[doc], first + lo, windows, seed, one, two)):
                out.append(x)
        kinds = (np.int64, np.int64, np.int64, U, U, U)
        self.doc, self.first, self.windows, seed, one, two = (np.concatenate(p) if p else np.zeros(0, k) for p, k in zip(parts, kinds))
        self.runs = Sorted(one, two, self.doc)
        self.seeds = Sorted(mix(seed), np.zeros(len(seed), U), self.doc)
        # A seed's run content, or 0 where it has several.
        low, high = np.full(len(self.seeds.one), np.iinfo(np.uint64).max, U), np.zeros(len(self.seeds.one), U)
        np.minimum.at(low, self.seeds.back, one)
        np.maximum.at(high, self.seeds.back, one)
        self.content = np.where(low == high, low, U(0))

    def judge(self, marks, deals: int) -> tuple[np.ndarray, np.ndarray]:
        """Runs that go whole, and runs whose windows have to be looked at."""
        holder = self.number + self.runs.row
        mixed = np.zeros(len(self.seeds.one), bool)
        edge = {SEED: self.seeds.edges(deals), RUN: self.runs.edges(deals)}
        for m in marks:
            if m["kind"] == SEED:
                mixed[edge[SEED][m["deal"]] + np.frombuffer(m["data"], np.uint32)] = True
            elif m["kind"] == RUN:
                at, number = _columns(m["data"], m["n"], np.uint32, np.int64)
                holder[edge[RUN][m["deal"]] + at] = number
        whole = holder[self.runs.back] < self.heads[self.doc]
        return whole, ~whole & mixed[self.seeds.back]

    def windows_of(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, Sorted]:
        """First bytes and rows of the windows of some runs, and their sorted keys."""
        at = np.flatnonzero(runs)
        size = self.windows[at]
        first = np.repeat(self.first[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
        row = np.repeat(self.doc[at], size)
        one, two = np.zeros(len(first), U), np.zeros(len(first), U)
        for k in range(0, len(first), 1 << 19):  # the bytes in memory are bounded
            s = first[k : k + (1 << 19)]
            lo, hi = int(s.min()), int(s.max()) + LENGTH
            one[k : k + len(s)], two[k : k + len(s)] = _prints(self.buf[lo:hi], s - lo, s - lo + LENGTH)
        return first, row, Sorted(one, two, row)


def _each(tables, piece: int):
    """(Batch, marks, doc_ids) of each row."""
    for table in tables:
        for i in range(table.num_rows):
            part = table.slice(i, 1)
            buf, offsets = flat(part.column("texts").flatten())
            marks = part.column("marks")[0].as_py() if "marks" in part.schema.names else None
            yield Batch(np.asarray(part.column("heads").flatten(), np.int64), buf, offsets, part.column("batch")[0].as_py(), piece), marks or [], part.column("doc_ids").flatten()


# ---- deals ---------------------------------------------------------------------------------------------


def _columns(data: bytes, n: int, *kinds) -> list[np.ndarray]:
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(data, k, n, at))
        at += np.dtype(k).itemsize * n
    return out


def _rows(rows) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[], [], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["kind", "deal", "batch", "n", "data"])


def _dealt(kind: int, keys: Sorted, deals: int, number: int, *columns: np.ndarray) -> pa.RecordBatch:
    edge = keys.edges(deals)
    return _rows([(kind, d, number, int(edge[d + 1] - edge[d]), b"".join(c[edge[d] : edge[d + 1]].tobytes() for c in columns)) for d in np.flatnonzero(np.diff(edge)).tolist()])


def _index(tables, deals: int, piece: int):
    for batch, _, _ in _each(tables, piece):
        yield _dealt(SEED, batch.seeds, deals, batch.number, batch.seeds.within(deals), batch.content)
        yield _dealt(RUN, batch.runs, deals, batch.number, batch.runs.within(deals), batch.runs.two, batch.runs.row.astype(np.uint16))


def _contents(tables, deals: int, piece: int):
    for batch, marks, _ in _each(tables, piece):
        keys = batch.windows_of(batch.judge(marks, deals)[1])[2]
        yield _dealt(WINDOW, keys, WINDOW_DEALS * deals, batch.number, keys.within(WINDOW_DEALS * deals), keys.two, keys.row.astype(np.uint16))


class Family:
    """Levels of sorted keys, each over twice as long as the next. A key is in one level at most."""

    def __init__(self):
        self.levels: list[list[np.ndarray]] = []

    def scan(self, one: np.ndarray, two: np.ndarray | None = None):
        """(level, which keys it holds, where there) for each level as it stands."""
        for level in self.levels:
            at = np.searchsorted(level[0], one)
            while True:
                place = np.minimum(at, len(level[0]) - 1)
                hit = (at < len(level[0])) & (level[0][place] == one)
                other = hit & (level[1][place] != two) if two is not None else np.zeros(1, bool)
                if not other.any():
                    break
                at = at + other
            found = np.flatnonzero(hit)
            yield level, found, at[found]

    def add(self, *columns: np.ndarray) -> None:
        """A new level of keys, ascending; levels that are not over twice as long as it merge with it."""
        new = list(columns)
        if not len(new[0]):
            return
        while self.levels and len(self.levels[-1][0]) < 2 * len(new[0]):
            both = [np.concatenate(x) for x in zip(self.levels.pop(), new)]
            order = np.argsort(both[0], kind="stable")
            new = [x[order] for x in both]
        self.levels.append(new)


#: Keys that are scanned at once: neighbouring batches that have few keys in a deal go together.
TOGETHER = 1 << 15


def _together(batches):
    """Runs of neighbouring batches with TOGETHER keys, or a batch of its own that has more."""
    group, n = [], 0
    for b in batches:
        group.append(b)
        n += b[3]
        if n >= TOGETHER:
            yield group
            group, n = [], 0
    if group:
        yield group


def _by_batch(group, places: np.ndarray):
    """For each batch of a group, which of the ascending places among all their keys are its own, and where these are in it."""
    edge = np.cumsum([0, *(b[3] for b in group)])
    cut = np.searchsorted(places, edge)
    for k, b in enumerate(group):
        if cut[k + 1] > cut[k]:
            mine = places[cut[k] : cut[k + 1]]
            yield b, mine, (mine - edge[k]).astype(np.uint32)


def _earlier(batches) -> list:
    """For each batch: its keys that an earlier one has, and the first row's number that has each."""
    family, out = Family(), []
    for group in _together(batches):
        columns = [_columns(data, n, np.uint32, U, np.uint16) for _, _, _, n, data in group]
        one, two = (np.concatenate([c[i] for c in columns]) for i in (0, 1))
        number = np.concatenate([b[2] + c[2].astype(np.int64) for b, c in zip(group, columns)])
        holder = np.full(len(one), -1, np.int64)
        for level, found, at in family.scan(one, two):
            holder[found] = level[2][at]
        # Among the group's own keys the first row's number counts.
        order = np.lexsort((number, two, one))
        fresh = np.ones(len(one), bool)
        fresh[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        first = order[fresh]
        least = np.empty(len(one), np.int64)
        least[order] = number[first][np.cumsum(fresh) - 1]
        new = first[holder[first] < 0]
        later = (holder < 0) & (least != number)
        holder[later] = least[later]
        family.add(one[new], two[new], number[new])
        for (kind, deal, batch, _, _), mine, at in _by_batch(group, np.flatnonzero(holder >= 0)):
            out.append((kind, deal, batch, len(at), at.tobytes() + holder[mine].tobytes()))
    return out


def _mixed(batches) -> list:
    """For each batch: its seeds that have runs of several contents, in all batches together."""
    family, out = Family(), []
    for group in _together(batches):
        one, content = (np.concatenate(x) for x in zip(*(_columns(data, n, np.uint32, U) for _, _, _, n, data in group)))
        order = np.argsort(one, kind="stable")
        one, content = one[order], content[order]
        start = np.flatnonzero(np.append(True, one[1:] != one[:-1])) if len(one) else np.zeros(0, np.int64)
        low, high = np.minimum.reduceat(content, start), np.maximum.reduceat(content, start)
        one, content = one[start], np.where(low == high, low, U(0))
        new = np.ones(len(one), bool)
        for level, found, at in family.scan(one):
            new[found] = False
            differ = level[1][at] != content[found]
            level[1][at[differ]] = 0
        family.add(one[new], content[new].copy())
    for group in _together(batches):
        one = np.concatenate([_columns(data, n, np.uint32)[0] for _, _, _, n, data in group])
        bad = [found[level[1][at] == 0] for level, found, at in family.scan(one)]
        for (kind, deal, number, _, _), _, at in _by_batch(group, np.sort(np.concatenate(bad)) if bad else np.zeros(0, np.int64)):
            out.append((kind, deal, number, len(at), at.tobytes()))
    return out


def _match(table: pa.Table) -> pa.Table:
    """Marks of a deal's batches, in their order."""
    batches = sorted(zip(*(table.column(c).to_pylist() for c in ("kind", "deal", "batch", "n", "data"))), key=lambda b: b[2])
    return pa.Table.from_batches([_rows(_mixed(batches) if batches[0][0] == SEED else _earlier(batches))])


# ---- removal -------------------------------------------------------------------------------------------


def _remove(tables, deals: int, piece: int, keep_text: bool):
    for batch, marks, ids in _each(tables, piece):
        buf, offsets, n = batch.buf, batch.offsets, len(batch.buf)
        whole, look = batch.judge(marks, deals)
        first, row, keys = batch.windows_of(look)
        holder, edge = batch.number + keys.row, keys.edges(WINDOW_DEALS * deals)
        for m in marks:
            if m["kind"] == WINDOW:
                at, number = _columns(m["data"], m["n"], np.uint32, np.int64)
                holder[edge[m["deal"]] + at] = number
        single = first[holder[keys.back] < batch.heads[row]]
        change = np.zeros(n + 1, np.int64)
        np.add.at(change, batch.first[whole], 1)
        np.add.at(change, (batch.first + batch.windows)[whole] + LENGTH - 1, -1)
        np.add.at(change, single, 1)
        np.add.at(change, single + LENGTH, -1)
        gone = np.cumsum(change[:n]) > 0
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        inner = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[inner] = gone[inner]
        removed, spans = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        np.cumsum(gone, out=removed[1:])
        np.cumsum(begins, out=spans[1:])
        kept = [buf[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(np.diff(offsets), pa.int64()), pa.array(removed[offsets[1:]] - removed[offsets[:-1]], pa.int64()), pa.array(spans[offsets[1:]] - spans[offsets[:-1]], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(kept if keep_text else [None] * len(kept), pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"],
        )


def _with(batches: DataFrame, marks: DataFrame) -> DataFrame:
    """batches with the marks that they got: fewer than a batch has entries."""
    return batches.join(marks.groupBy("batch").agg(F.collect_list(F.struct("kind", "deal", "n", "data")).alias("marks")), "batch", "left")


def remove_repeats(docs: DataFrame, scratch: Scratch, keep_text: bool = False, batch_bytes: int = BATCH_BYTES, piece: int = PIECE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept_text (bytes) of docs (doc_id, text)."""
    batches = batches_of(docs, scratch, batch_bytes)
    deals = 1 + (batches.agg(F.sum("n_bytes")).first()[0] or 0) // DEAL_BYTES
    matched = lambda entries: scratch.save(entries.groupBy("kind", "deal").applyInArrow(_match, _ROWS))
    marks = matched(batches.mapInArrow(lambda it: _index(it, deals, piece), _ROWS))
    more = matched(_with(batches, marks).mapInArrow(lambda it: _contents(it, deals, piece), _ROWS))
    return _with(batches, marks.unionByName(more)).mapInArrow(lambda it: _remove(it, deals, piece, keep_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text binary")


def op7_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return remove_repeats(docs, Scratch(spark)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
