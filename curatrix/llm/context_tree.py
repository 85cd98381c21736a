"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions, each in a tree node named by the bits of the byte so far and the last d
bytes before it, d = 0 to DEPTH (zero bytes before a text). Every node has a Krichevsky-Trofimov estimator;
its weighted probability is half its own estimate and half the product of its children's, which mixes the
predictions of all depths; a node without data predicts as the deepest one above it that has some. The counts of a node come from byte strings of length DEPTH + 1 counted over all
training texts, so the whole tree follows from one table of strings. Strings are dealt by their last
CUT context bytes; deeper levels are computed within a deal, the rest by grouping over all. A context of CUT bytes
with more than DEAL_ROWS strings is no deal of its own: its strings are dealt by one context byte more, of which each value
has 65,536 strings at most, and its level CUT comes by grouping, too.

Scoring looks each position's string up. Strings and words that make up LEAST_SHARE of their kind are
broadcast, which bounds that table at 1 / LEAST_SHARE entries; all others are joined by key, exactly.

bits_per_byte is the code length that the tree gives a text, by its bytes. The tree codes the bytes and not where they
end, so that `score` has no end token, while `base_score` has one.

Defined results: a null or empty text has the end token alone, and score and bits 0 (the tree codes no byte); rows
with a null doc_id count as fold 0; repeated rows count and are scored each; with no training text every
bit has probability 1/2; an empty table gives an empty result; long texts are scored whole. Other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .folds import fold
from .kernels import LOWER, U, add_up, by_doc, flat, lean, look_up, span_hashes, spans, words
from .scratch import Scratch

DEPTH, CUT = 5, 3
LEAST_SHARE = 2.0**-22
FOLDS, HELD_OUT = 7, 2
DEAL_ROWS = 200_000
_BLOCK = 1 << 21
#: Rows that a counter holds.
COUNTED = 1 << 21
_END_WORD = 0  # the end token's key; a word's hash is never taken as 0


def _strings(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte: the DEPTH bytes before it in its document and itself, itself lowest."""
    out = buf.astype(U)
    starts, size = offsets[:-1], np.diff(offsets)
    for k in range(1, DEPTH + 1):
        before = np.zeros(len(buf), np.uint8)
        before[k:] = buf[:-k]
        for j in range(k):
            before[starts[size > j] + j] = 0
        out |= before.astype(U) << U(8 * k)
    return out


def _look_up_strings(table: np.ndarray, strings: np.ndarray) -> np.ndarray:
    """look_up of strings, which leave 16 bits for a place: sorted with their places in blocks, so that a search runs through the table in order."""
    out = np.empty(len(strings), np.int64)
    for a in range(0, len(strings), 1 << 16):
        block = strings[a : a + (1 << 16)]
        packed = np.sort((block << U(16)) | np.arange(len(block), dtype=U))
        out[a + (packed & U(0xFFFF)).astype(np.int64)] = look_up(table, packed >> U(16))
    return out


def _tally(strings: np.ndarray, taught: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct strings, how often each occurs where taught is 1, and how often at all; sorted with taught as a bit, which needs no inverse."""
    if not len(strings):
        return strings, np.zeros(0, np.int64), np.zeros(0, np.int64)
    packed = np.sort((strings << U(1)) | taught.astype(U))
    start = np.flatnonzero(np.append(True, packed[1:] != packed[:-1]))
    n, packed = np.diff(np.append(start, len(packed))), packed[start]
    key = packed >> U(1)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.add.reduceat(n * (packed & U(1)).astype(np.int64), first), np.add.reduceat(n, first)


def _word_keys(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = LOWER[buf]
    starts, ends, first = words(low, offsets)
    return np.maximum(span_hashes(low, starts, ends), U(1)), first


class _Counter:
    """Sums by key, kept compact while they are gathered."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = 0

    def add(self, keys: np.ndarray, taught: np.ndarray, all_: np.ndarray | None = None) -> None:
        k, at = np.unique(keys, return_inverse=True)
        total = np.bincount(at, all_, len(k)).astype(np.int64)
        self.parts.append((k, np.bincount(at, taught, len(k)).astype(np.int64), total))
        self.rows += len(k)

    def add_strings(self, strings: np.ndarray, taught: np.ndarray) -> None:
        self.parts.append(_tally(strings, taught))
        self.rows += len(self.parts[-1][0])

    def over(self, most: int):
        """What is gathered, compacted and handed out, if it is more than `most` rows; grouping adds it up with what comes later."""
        if self.rows > most:
            self.compact()
            if self.rows > most // 2:
                parts, self.parts, self.rows = self.parts, [], 0
                yield from parts

    def compact(self) -> None:
        if len(self.parts) > 1:
            k, t, n = (np.concatenate([p[i] for p in self.parts]) for i in range(3))
            self.parts, self.rows = [], 0
            self.add(k, t, n)


@lean
def _count(batches):
    tables = {0: _Counter(), 1: _Counter()}

    def out(kind, parts):
        for keys, n, total in parts:
            for a in range(0, len(keys), 1 << 16):
                cut = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[cut]), kind), pa.int32()), pa.array(keys[cut].view(np.int64)), pa.array(n[cut]), pa.array(total[cut])], ["kind", "key", "n", "total"])

    for batch in batches:
        buf, offsets = flat(batch.column("text"))
        taught = np.asarray(batch.column("taught")).astype(np.float64)
        for i, j in spans(offsets, _BLOCK):
            b, o = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            tables[1].add_strings(_strings(b, o), np.repeat(taught[i:j], np.diff(o)))
            keys, first = _word_keys(b, o)
            tables[0].add(np.concatenate([keys, np.full(j - i, _END_WORD, U)]), np.concatenate([taught[i:j][by_doc(first, len(keys))], taught[i:j]]))
            for kind, table in tables.items():
                yield from out(kind, table.over(COUNTED))
    for kind, table in tables.items():
        yield from out(kind, table.over(-1))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma(x) for x > 0: Stirling's series at x + 8, carried back."""
    y = x + 8
    series = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    back = np.log(x)
    for k in range(1, 8):
        back += np.log(x + k)
    return series - back


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - 1.1447298858494002


def _level(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, log_w: np.ndarray | None):
    """Nodes by key: counts, log of the estimate, log of the weighted probability, and where each row went."""
    k, at = np.unique(keys, return_inverse=True)
    a, b = np.bincount(at, zeros, len(k)), np.bincount(at, ones, len(k))
    own = log_kt(a, b)
    weighted = own if log_w is None else np.logaddexp(own, np.bincount(at, log_w, len(k))) - np.log(2)
    return k, a, b, own, weighted, at


def _mask(depth: int) -> np.uint64:
    return U((1 << (8 * depth + 8)) - 1)


def _climb(strings: np.ndarray, n: np.ndarray, cut: int):
    """Levels from DEPTH up to cut; node keys are context bytes, then the bits of the byte so far after a 1."""
    sym, context = strings & U(0xFF), strings >> U(8)
    keys, ones = [], []
    for bit in range(8):
        keys.append((context << U(8)) | U(1 << bit) | (sym >> U(8 - bit)))
        ones.append((sym >> U(7 - bit)) & U(1))
    one = np.concatenate(ones).astype(np.float64)
    count = np.tile(n.astype(np.float64), 8)
    levels = [_level(np.concatenate(keys), count * (1 - one), count * one, None)]
    for depth in range(DEPTH - 1, cut - 1, -1):
        k, a, b, _, w, _ = levels[-1]
        levels.append(_level(k & _mask(depth), a, b, w))
    return levels, one


def _descend(k, a, b, own, weighted, at_parent, acc, rest, p, leaf: bool):
    """At nodes of one depth: the mixed probability of a one so far, the weight that is left, the estimate here."""
    stop = np.ones(len(k)) if leaf else np.exp(np.minimum(own - np.log(2) - weighted, 0))
    p = np.where(a + b > 0, (b + 0.5) / (a + b + 1), p[at_parent])
    return acc[at_parent] + rest[at_parent] * stop * p, rest[at_parent] * (1 - stop), p


def _cut(deal: int) -> int:
    """Context bytes that a deal goes by: negative deals hold parts of large contexts."""
    return CUT if deal >= 0 else CUT + 1


def _up(frame: pd.DataFrame) -> pd.DataFrame:
    levels, _ = _climb(frame["key"].to_numpy().view(U), frame["n"].to_numpy(), _cut(frame["deal"].iloc[0]))
    k, a, b, own, w, _ = levels[-1]
    return pd.DataFrame({"deal": frame["deal"].iloc[0], "key": k.view(np.int64), "a": a, "b": b, "own": own, "log_w": w})


def _down(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    strings, n = left["key"].to_numpy().view(U), left["n"].to_numpy()
    levels, one = _climb(strings, n, _cut(left["deal"].iloc[0]))
    order = np.argsort(right["key"].to_numpy().view(U))
    acc, rest, p = (right[c].to_numpy()[order] for c in ("acc", "rest", "p"))
    at = np.arange(len(acc))
    for i in range(len(levels) - 1, -1, -1):
        k, a, b, own, w, _ = levels[i]
        if i < len(levels) - 1:
            at = levels[i + 1][5]
        acc, rest, p = _descend(k, a, b, own, w, at, acc, rest, p, i == 0)
    p = np.clip(acc, 1e-12, 1 - 1e-12)[levels[0][5]]
    bits = np.log10(np.where(one > 0, p, 1 - p)).reshape(8, -1).sum(axis=0)
    return pd.DataFrame({"key": left["key"], "total": left["total"], "value": bits})


def _context(depth: int):
    return F.expr(f"shiftright(key, 8) & {(1 << (8 * depth)) - 1}L")


def dealt_strings(strings: DataFrame, scratch: Scratch) -> DataFrame:
    """deal, key, n, total of strings (key, n, total); parts of contexts with more than DEAL_ROWS strings have negative deals."""
    sizes = scratch.save(strings.groupBy(_context(CUT).alias("context")).agg(F.count(F.lit(1)).alias("strings")))
    deals = max(1, -(-(sizes.agg(F.sum("strings")).first()[0] or 0) // DEAL_ROWS))
    large = scratch.save(sizes.where(F.col("strings") > DEAL_ROWS).select("context", F.lit(True).alias("large")))
    scratch.drop(sizes)
    deal = lambda depth: F.pmod(F.xxhash64(_context(depth)), F.lit(deals)).cast("int")
    placed = strings.withColumn("context", _context(CUT)).join(large, "context", "left")
    return placed.select(F.when(F.col("large"), -1 - deal(CUT + 1)).otherwise(deal(CUT)).alias("deal"), "key", "n", "total")


def _above(below: DataFrame, depth: int) -> DataFrame:
    """The nodes of a depth from those one deeper."""
    sums = below.groupBy(F.col("key").bitwiseAND(F.lit(int(_mask(depth)))).alias("key")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("log_w").alias("children"))
    level = sums.withColumn("own", _sql_log_kt("a", "b"))
    high, low = F.greatest("own", "children"), F.least("own", "children")
    return level.withColumn("log_w", high + F.log1p(F.exp(low - high)) - float(np.log(2))).drop("children")


def _below(top: DataFrame, lower: DataFrame, depth: int) -> DataFrame:
    """lower, the nodes one deeper than those of top at a depth, with what came down to them: acc0, rest0, p0."""
    stop = F.exp(F.least(F.lit(0.0), F.col("own") - float(np.log(2)) - F.col("log_w")))
    here = F.when(F.col("a") + F.col("b") > 0, (F.col("b") + 0.5) / (F.col("a") + F.col("b") + 1)).otherwise(F.col("p0"))
    done = top.select(F.col("key").alias("parent"), (F.col("acc0") + F.col("rest0") * stop * here).alias("acc0"), (F.col("rest0") * (1 - stop)).alias("rest0"), here.alias("p0"))
    return lower.withColumn("parent", F.col("key").bitwiseAND(F.lit(int(_mask(depth))))).join(done, "parent").drop("parent")


def string_scores(strings: DataFrame, scratch: Scratch) -> DataFrame:
    """key, total, value (log10 of the last byte's probability) of strings (key, n, total)."""
    dealt = dealt_strings(strings, scratch)
    cut = scratch.save(dealt.select("deal", "key", "n").groupBy("deal").applyInPandas(_up, "deal int, key long, a double, b double, own double, log_w double"))
    parts = cut.where("deal < 0")
    joined = scratch.save(_above(parts, CUT)).withColumn("deal", F.lit(None).cast("int"))
    cut = cut.where("deal >= 0").unionByName(joined)
    # Levels above CUT, over all deals: each is a grouping of the one below.
    levels, below = [cut], cut
    for depth in range(CUT - 1, -1, -1):
        below = scratch.save(_above(below, depth))
        levels.append(below)
    top = below.select("key", "a", "b", "own", "log_w", F.lit(0.0).alias("acc0"), F.lit(1.0).alias("rest0"), F.lit(0.5).alias("p0"))
    for depth in range(CUT):
        top = scratch.save(_below(top, levels[CUT - 1 - depth], depth))
    seed = top.where("deal is not null").unionByName(_below(top.where("deal is null"), parts, CUT))
    seed = seed.select("deal", "key", F.col("acc0").alias("acc"), F.col("rest0").alias("rest"), F.col("p0").alias("p"))
    return dealt.groupBy("deal").cogroup(seed.groupBy("deal")).applyInPandas(_down, "key long, total long, value double")


def _sql_log_kt(a: str, b: str):
    """log_kt as a column."""

    def log_gamma(x):
        y = x + 8
        back = F.log(x)
        for k in range(1, 8):
            back = back + F.log(x + k)
        return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - back

    return log_gamma(F.col(a) + 0.5) + log_gamma(F.col(b) + 0.5) - log_gamma(F.col(a) + F.col(b) + 1.0) - 1.1447298858494002


def _score(batches, shared):
    """A row for each document with what the broadcast tables give, and rows of kind, key and times for the rest."""
    (word_keys, word_values, word_known), (string_keys, string_values) = shared.value

    def others(uid, kind, doc, keys):
        k, at = np.unique(keys, return_inverse=True)
        pair, times = np.unique(doc * len(k) + at, return_counts=True)
        m = len(pair)
        return [pa.array(uid[pair // max(1, len(k))]), pa.array(np.full(m, kind), pa.int32()), pa.array(k[pair % max(1, len(k))].view(np.int64)), pa.array(times.astype(np.int64))]

    for batch in batches:
        buf, offsets = flat(batch.column("text"))
        uid = np.asarray(batch.column("uid"))
        for i, j in spans(offsets, _BLOCK):
            b, o = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            strings = _strings(b, o)
            at = _look_up_strings(string_keys, strings)
            value = np.where(at >= 0, string_values[at] if len(string_values) else 0.0, 0.0)
            score = add_up(value, o)
            miss = np.flatnonzero(at < 0)
            rest = [others(uid[i:j], 1, np.searchsorted(o, miss, "right") - 1, strings[miss])]
            keys, first = _word_keys(b, o)
            doc = by_doc(first, len(keys))
            keys, doc = np.concatenate([keys, np.full(j - i, _END_WORD, U)]), np.concatenate([doc, np.arange(j - i)])
            at = look_up(word_keys, keys)
            hit, miss = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
            base = np.bincount(doc[hit], word_values[at[hit]] if len(word_values) else None, j - i)
            known = np.bincount(doc[hit], word_known[at[hit]] if len(word_known) else None, j - i).astype(np.int64)
            rest.append(others(uid[i:j], 0, doc[miss], keys[miss]))
            size, n_bytes = np.diff(first) + 1, np.diff(o)
            none = lambda n, kind: pa.nulls(n, kind)
            n = j - i
            yield pa.RecordBatch.from_arrays([pa.array(uid[i:j]), none(n, pa.int32()), none(n, pa.int64()), none(n, pa.int64()), batch.column("doc_id").slice(i, n), pa.array(size.astype(np.int64)), pa.array(known), pa.array(n_bytes, pa.int64()), pa.array(base.astype(np.float64)), pa.array(score)], _COLUMNS)
            for r in rest:
                m = len(r[0])
                if m:
                    yield pa.RecordBatch.from_arrays([*r, *(none(m, pa.int64()) for _ in range(4)), none(m, pa.float64()), none(m, pa.float64())], _COLUMNS)


_COLUMNS = ["uid", "kind", "key", "times", "doc_id", "n_tokens", "n_known", "n_bytes", "base_score", "score"]
_SCHEMA = "uid long, kind int, key long, times long, doc_id long, n_tokens long, n_known long, n_bytes long, base_score double, score double"


def _arrays(table, columns):
    rows = table.toArrow()
    keys = np.asarray(rows.column("key")).view(U)
    order = np.argsort(keys)
    return (keys[order], *(np.asarray(rows.column(c))[order] for c in columns))


def tree_scores(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of docs (uid, doc_id, text)."""
    held = fold("doc_id", FOLDS) == HELD_OUT
    counts = docs.select((~held).cast("int").alias("taught"), "text").mapInArrow(_count, "kind int, key long, n long, total long")
    counts = scratch.save(counts.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
    sums = {r["kind"]: r for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.count_if(F.col("n") > 0).alias("types")).collect()}
    words_, strings_ = sums.get(0), sums.get(1)
    train, types = (words_["n"], words_["types"]) if words_ else (0, 0)
    word = counts.where("kind = 0").select(F.lit(0).alias("kind"), "key", "total", F.log10((F.col("n") + 1) / float(train + types + 1)).alias("value"), (F.col("n") > 0).cast("int").alias("known"))
    string = string_scores(counts.where("kind = 1").select("key", "n", "total"), scratch).select(F.lit(1).alias("kind"), "key", "total", "value", F.lit(0).alias("known"))
    table = scratch.save(word.unionByName(string))
    often = lambda kind, row: (F.col("kind") == kind) & (F.col("total") >= LEAST_SHARE * (row["total"] if row else 0))
    model = _arrays(table.where(often(0, words_)), ["value", "known"]), _arrays(table.where(often(1, strings_)), ["value"])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = scratch.save(docs.select("uid", "doc_id", "text").mapInArrow(lambda it: _score(it, shared), _SCHEMA))
    rare = rows.where("kind is not null").select("uid", "kind", "key", "times").join(table.where(~(often(0, words_) | often(1, strings_))), ["kind", "key"])
    rare = rare.select("uid", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_tokens"), F.when(F.col("kind") == 0, F.col("known") * F.col("times")).alias("n_known"), F.lit(None).cast("long").alias("n_bytes"), F.when(F.col("kind") == 0, F.col("value") * F.col("times")).alias("base_score"), F.when(F.col("kind") == 1, F.col("value") * F.col("times")).alias("score"))
    both = rows.where("kind is null").select(*rare.columns).unionByName(rare)
    out = both.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.max("n_bytes").alias("n_bytes"), F.sum("base_score").alias("base_score"), F.sum("score").alias("score"))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(train).cast("long").alias("train_tokens"), "base_score", "score", F.coalesce(F.col("score") / F.nullif("n_bytes", F.lit(0)) * -float(np.log2(10)), F.lit(0.0)).alias("bits_per_byte"))


def op5_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return tree_scores(docs, Scratch(spark))
