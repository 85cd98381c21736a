"""Language identification, words first with backoff to character n-grams.

Tokens are runs of letters, A-Z lower-cased. A token that training knows adds its smoothed log frequency
in each language. Any other token falls back to its character 4-grams (with its borders), and where none
of them is known to 3-, 2- and 1-grams: it adds the mean over the known ones. The scores' posterior gives
the language.

Everything is worked out once for each distinct token of all documents: its counts by language, the n-grams of those
that training has, and the fallback of the others. N-grams that make up GRAM_SHARE of all of their length are broadcast; what
they leave open is joined with the other n-grams, exactly. Tokens that make up LEAST_SHARE of all
are broadcast with their scores, which bounds that table at 1 / LEAST_SHARE entries; the others' scores are
joined to the documents by key, exactly. One number for each language goes with a token; with over LANGUAGES languages both
shares rise, so that the broadcast's size has a bound. The driver holds the list of languages.

Defined results: und with score 0 where the text is null or has no letter, or nothing was learned; equal
scores go to the first language by name; rows without lang teach nothing; repeated rows count each; an empty table gives
an empty result; long texts are read whole. Other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .folds import fold
from .kernels import LOWER, NO_LETTER, U, add_up, by_doc, flat, look_up, mix, span_hashes, spans, words
from .scratch import Scratch

LEAST_SHARE = 2.0**-21
GRAM_SHARE = 2.0**-19
#: With more languages, shares grow with their number, so that what is broadcast holds LANGUAGES / share numbers at most.
LANGUAGES = 8
LONGEST = 4
FOLDS, HELD_OUT = 4, 2
_ASCII_LETTER = ~NO_LETTER
_ASCII_LETTER[128:] = False


def _tokens(buf, offsets):
    buf = LOWER[buf]
    starts, ends, first = words(buf, offsets, NO_LETTER)
    return buf, starts, ends, first, span_hashes(buf, starts, ends)


def _grams(text: list[bytes]):
    """For each length: n-gram hashes of the words, and the word of each."""
    chars = np.frombuffer(b"".join([b"\n", *(x + b"\n" for x in text)]).decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(U)
    border = chars == 10
    word = np.cumsum(border) - 1
    for n in range(1, LONGEST + 1):
        m = max(0, len(chars) - n + 1)
        h = np.full(m, n, U)
        for k in range(n):
            h = mix(h) + chars[k : m + k]
        # A border may open or close an n-gram, but not lie within it, nor be all of it.
        inside = np.zeros(m, bool)
        for k in range(1 if n > 1 else 0, n - 1 if n > 1 else 1):
            inside |= border[k : m + k]
        if n == 2:
            inside |= border[:m] & border[1 : m + 1]
        good = np.flatnonzero(~inside)
        yield n, mix(h[good]), word[good]


# ---- training ------------------------------------------------------------------------------------------


def _count(batches, langs: list[str]):
    """Distinct tokens with their bytes and counts by language; the last count is of texts that teach nothing."""
    index, n = {x: i for i, x in enumerate(langs)}, len(langs) + 1
    for batch in batches:
        buf, offsets = flat(batch.column("text"))
        lang = np.array([index.get(x, n - 1) for x in batch.column("lang").to_pylist()], np.int64)
        for i, j in spans(offsets, 1 << 22):
            low, starts, ends, first, h = _tokens(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            keys, one, at = np.unique(h, return_index=True, return_inverse=True)
            counts = np.bincount(at * n + lang[i:j][by_doc(first, len(h))], minlength=len(keys) * n).reshape(len(keys), n)
            raw = low.tobytes()
            words_ = [raw[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(words_, pa.binary()), *(pa.array(counts[:, k], pa.int64()) for k in range(n))], ["key", "word", *_names(n)])


def _names(n: int, letter: str = "n") -> list[str]:
    return [f"{letter}{k}" for k in range(n)]


def _learn_grams(batches, n: int):
    for batch in batches:
        counts = np.stack([np.asarray(batch.column(c)) for c in _names(n)], 1)
        for kind, grams, word in _grams(batch.column("word").to_pylist()):
            keys, at = np.unique(grams, return_inverse=True)
            sums = [np.bincount(at, counts[word, k], len(keys)).astype(np.int64) for k in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind), pa.int32()), pa.array(keys.view(np.int64)), *map(pa.array, sums)], ["kind", "gram", *_names(n)])


def _back_off(batches, n: int, shared):
    """For each token what broadcast n-grams of the longest length with any add, and its n-grams that only others could know."""
    for batch in batches:
        own, total = np.asarray(batch.column("key")), np.asarray(batch.column("total"))
        m, found, others = len(own), {}, []
        kinds, times, sums = np.zeros(m, np.int32), np.zeros(m, np.int64), np.zeros((m, n))
        for kind, grams, word in _grams(batch.column("word").to_pylist()):
            keys, values = shared.value[kind]
            at = look_up(keys, grams)
            of = word[at >= 0]
            count = np.bincount(of, minlength=m)
            hit = count > 0
            kinds[hit], times[hit] = kind, count[hit]
            for k in range(n):
                sums[hit, k] = np.bincount(of, values[at[at >= 0], k], m)[hit]
            found[kind] = word[at < 0], grams[at < 0]
        for kind, (word, grams) in found.items():
            open_ = kinds[word] <= kind
            others.append((word[open_], np.full(int(open_.sum()), kind, np.int32), grams[open_]))
        word, kind, grams = (np.concatenate(x) for x in zip(*others))
        names = ["key", "kind", "gram", "total", "times", *_names(n, "s")]
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(kinds), pa.nulls(m, pa.int64()), pa.array(total), pa.array(times), *(pa.array(np.ascontiguousarray(sums[:, k])) for k in range(n))], names)
        m = len(word)
        yield pa.RecordBatch.from_arrays([pa.array(own[word]), pa.array(kind), pa.array(grams.view(np.int64)), *(pa.nulls(m, pa.int64()) for _ in range(2)), *(pa.nulls(m, pa.float64()) for _ in range(n))], names)


def _share(least: float, n: int) -> float:
    """The share from which a key is broadcast with a number for each of n languages."""
    return least * max(1.0, n / LANGUAGES)


def _sorted(table: pa.Table, key: str, n: int):
    """Keys in order, and the values of each."""
    keys = np.asarray(table.column(key)).view(U)
    order = np.argsort(keys)
    return keys[order], np.stack([np.asarray(table.column(c)) for c in _names(n, "v")], 1).reshape(-1, n)[order]


def token_scores(docs: DataFrame, langs: list[str], scratch: Scratch) -> DataFrame:
    """key, total and v0, v1, ... of every distinct token of docs (lang, null where it teaches nothing; text): what it adds to each language."""
    n = len(langs)
    columns = _names(n)
    types = ", ".join(f"{c} long" for c in _names(n + 1))
    counted = docs.select("lang", "text").mapInArrow(lambda it: _count(it, langs), f"key long, word binary, {types}")
    tokens = scratch.save(counted.groupBy("key").agg(F.first("word").alias("word"), *[F.sum(c).alias(c) for c in _names(n + 1)]))
    known = sum((F.col(c) for c in columns), F.lit(0)) > 0
    total = sum((F.col(c) for c in _names(n + 1)), F.lit(0)).alias("total")
    logs = lambda sums, types: [F.log((F.col(c) + 0.5) / (float(sums[c] or 0) + 0.5 * types)).alias(f"v{k}") for k, c in enumerate(columns)]
    sums = tokens.where(known).agg(F.count(F.lit(1)).alias("types"), *[F.sum(c).alias(c) for c in columns]).first()
    seen = tokens.where(known).select("key", total, *logs(sums, sums["types"]))
    grams = tokens.where(known).select("word", *columns).mapInArrow(lambda it: _learn_grams(it, n), f"kind int, gram long, {', '.join(f'{c} long' for c in columns)}")
    grams = scratch.save(grams.groupBy("kind", "gram").agg(*[F.sum(c).alias(c) for c in columns]))
    by_kind = grams.groupBy("kind").agg(F.count(F.lit(1)).alias("types"), *[F.sum(c).alias(c) for c in columns]).collect()
    if not by_kind:
        return scratch.save(seen)
    model, rest = {}, None
    for row in by_kind:  # one row for each length
        often = sum((F.col(c) for c in columns), F.lit(0)) >= _share(GRAM_SHARE, n) * sum(row[c] or 0 for c in columns)
        part = grams.where(F.col("kind") == row["kind"])
        model[row["kind"]] = _sorted(part.where(often).select("gram", *logs(row, row["types"])).toArrow(), "gram", n)
        part = part.where(~often).select("kind", "gram", *logs(row, row["types"]))
        rest = part if rest is None else rest.unionByName(part)
    nothing = np.zeros(0, U), np.zeros((0, n))
    shared = docs.sparkSession.sparkContext.broadcast({k: model.get(k, nothing) for k in range(1, LONGEST + 1)})
    sums = _names(n, "s")
    listed = tokens.where(~known).select("key", "word", total).mapInArrow(lambda it: _back_off(it, n, shared), f"key long, kind int, gram long, total long, times long, {', '.join(f'{c} double' for c in sums)}")
    listed = scratch.save(listed)
    more = listed.where("gram is not null").join(rest, ["kind", "gram"])
    more = more.select("key", "kind", "total", F.lit(1).cast("long").alias("times"), *[F.col(f"v{k}").alias(c) for k, c in enumerate(sums)])
    both = listed.where("gram is null").select(*more.columns).unionByName(more)
    both = both.groupBy("key", "kind").agg(F.max("total").alias("total"), F.sum("times").alias("times"), *[F.sum(c).alias(c) for c in sums])
    best = both.groupBy("key").agg(F.max("total").alias("total"), F.max_by(F.struct("times", *sums), "kind").alias("s")).where("s.times > 0")
    fallback = best.select("key", "total", *[(F.col(f"s.{c}") / F.col("s.times")).alias(f"v{k}") for k, c in enumerate(sums)])
    out = scratch.save(seen.unionByName(fallback))
    for table in (tokens, grams, listed):
        scratch.drop(table)
    return out


# ---- prediction ----------------------------------------------------------------------------------------


def _score(batches, shared):
    """A row for each document with what broadcast tokens add, and rows of key and times for its other tokens."""
    table, values = shared.value
    n = values.shape[1]
    for batch in batches:
        buf, offsets = flat(batch.column("text"))
        uid = np.asarray(batch.column("uid"))
        for i, j in spans(offsets):
            b, o = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            letter = add_up(_ASCII_LETTER[b], o) > 0
            for d in np.flatnonzero(~letter & (np.diff(o) > 0)):
                letter[d] = any(c.isalpha() for c in b[o[d] : o[d + 1]].tobytes().decode("utf-8", "replace"))
            _, _, _, first, h = _tokens(b, o)
            at = look_up(table, h)
            value = np.zeros((len(h), n))
            value[at >= 0] = values[at[at >= 0]]
            m = j - i
            yield pa.RecordBatch.from_arrays([pa.array(uid[i:j]), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), batch.column("doc_id").slice(i, m), pa.array(letter), *(pa.array(add_up(np.ascontiguousarray(value[:, k]), first), pa.float64()) for k in range(n))], ["uid", "key", "times", "doc_id", "letter", *_names(n, "s")])
            miss = np.flatnonzero(at < 0)
            if len(miss):
                keys, of = np.unique(h[miss], return_inverse=True)
                pair, times = np.unique(by_doc(first, len(h))[miss] * len(keys) + of, return_counts=True)
                m = len(pair)
                yield pa.RecordBatch.from_arrays([pa.array(uid[i:j][pair // len(keys)]), pa.array(keys[pair % len(keys)].view(np.int64)), pa.array(times.astype(np.int64)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.bool_()), *(pa.nulls(m, pa.float64()) for _ in range(n))], ["uid", "key", "times", "doc_id", "letter", *_names(n, "s")])


def predict(docs: DataFrame, held, scratch: Scratch) -> DataFrame:
    """doc_id, lang_pred, score of docs (uid, doc_id, lang, text), taught by the rows that are not held and have a lang."""
    teaching = docs.select(F.when(~held, F.col("lang")).alias("lang"), "text")
    langs = sorted(r[0] for r in teaching.select("lang").where("lang is not null").distinct().collect())
    n = len(langs)
    if not n:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    tokens = token_scores(teaching, langs, scratch)
    often = F.col("total") >= _share(LEAST_SHARE, n) * (tokens.agg(F.sum("total")).first()[0] or 0)
    model = _sorted(tokens.where(often).toArrow(), "key", n)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    sums = _names(n, "s")
    rows = scratch.save(docs.select("uid", "doc_id", "text").mapInArrow(lambda it: _score(it, shared), f"uid long, key long, times long, doc_id long, letter boolean, {', '.join(f'{s} double' for s in sums)}"))
    rare = rows.where("key is not null").select("uid", "key", "times").join(tokens.where(~often), "key")
    none = lambda kind: F.lit(None).cast(kind)
    rare = rare.select("uid", none("long").alias("doc_id"), none("boolean").alias("letter"), *[(F.col(f"v{k}") * F.col("times")).alias(f"s{k}") for k in range(n)])
    both = rows.where("key is null").select(*rare.columns).unionByName(rare)
    out = both.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.max("letter").alias("letter"), *[F.sum(s).alias(s) for s in sums])
    top = F.greatest(*sums) if n > 1 else F.col("s0")
    name = F.coalesce(*[F.when(F.col(s) == F.col("top"), F.lit(x)) for s, x in zip(sums, langs)])
    sure = 1 / sum((F.exp(F.col(s) - F.col("top")) for s in sums), F.lit(0.0))
    return out.withColumn("top", top).select("doc_id", F.when(F.col("letter"), name).otherwise("und").alias("lang_pred"), F.when(F.col("letter"), sure).otherwise(0.0).alias("score"))


def op6_word_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    held = fold("doc_id", FOLDS) == HELD_OUT
    return predict(docs, held, Scratch(spark)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
