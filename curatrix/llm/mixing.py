"""Mixing documents to target weights by iterative proportional fitting.

Documents fall in cells of source, language and topic. Raking scales the tokens that each cell is expected to
give, no more than it has, to one marginal after the other, until all three fit their targets. A
document's probability is its cell's expected tokens by the tokens there; it is drawn by a hash of its id, so
that a run can be repeated and no order matters.

Targets are shares by value. By default they are the marginals of what the cells would give in proportion to a
power of their tokens, which lifts small sources, languages and topics at any size, where a cell that has fewer tokens than
that gives all of them and the others share what is left: so the default targets can be met together. Targets
that can't are fitted as far as they go, and `off` says how far: the largest relative distance of a marginal from its target.

Topics are learned from all documents: of the words of LETTERS letters or more that are in at most one of
RAREST documents, the TOPICS with the most information (documents with it, times the log of the inverse of
their share). A document's topic is the one whose word it has most often, weighed by that log, of equals the first by name; '' is the
topic of documents without such a word.

Defined results: a null source or lang is a value of its own (empty); null or empty texts have no tokens and
are drawn at their cell's probability, which is 1 where no text of the cell has any; rows that repeat a doc_id share its fate, if they are in one cell; an empty table gives an empty result; long texts are counted
whole. Other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .kernels import LOWER, NO_LETTER, U, by_doc, flat, look_up, span_hashes, spans, words
from .scratch import Scratch, filtered

TOPICS, LETTERS, RAREST = 64, 5, 8
MARGINALS, POWER = ("source", "lang", "topic"), 0.7
KEEP_SHARE = 0.8
TOLERANCE = 1e-4
#: Cells that are fitted in one task, and cells for each partition where there are more.
CELLS = 200_000


# ---- topics and cells ----------------------------------------------------------------------------------


def _long_words(buf: np.ndarray, offsets: np.ndarray):
    """Lower-cased bytes, first and end bytes of the long words, their documents and hashes."""
    low = LOWER[buf]
    starts, ends, first = words(low, offsets, NO_LETTER)
    long = ends - starts >= LETTERS
    doc = by_doc(first, len(starts))[long]
    starts, ends = starts[long], ends[long]
    return low, starts, ends, doc, span_hashes(low, starts, ends)


def _count(batches):
    for batch in batches:
        buf, offsets = flat(batch.column("text"))
        for i, j in spans(offsets, 1 << 22):
            low, starts, ends, doc, h = _long_words(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            _, one, at = np.unique(h, return_index=True, return_inverse=True)
            docs = np.bincount(np.unique(at * (j - i + 1) + doc) // (j - i + 1), minlength=len(one))
            yield pa.RecordBatch.from_arrays([pa.array([low[starts[k] : ends[k]].tobytes() for k in one], pa.binary()), pa.array(docs, pa.int64())], ["word", "docs"])


def learn_topics(docs: DataFrame) -> list[tuple[str, float]]:
    """(word, weight) of at most TOPICS topics of docs (text); the weight is the log of the inverse share of documents."""
    n = docs.count()
    counts = docs.select("text").mapInArrow(_count, "word binary, docs long").groupBy("word").agg(F.sum("docs").alias("docs")).where(F.col("docs") * RAREST <= n)
    weight = F.log(F.lit(float(max(n, 1))) / F.col("docs"))
    best = counts.select(F.decode("word", "utf-8").alias("word"), weight.alias("weight"), (F.col("docs") * weight).alias("worth")).orderBy(F.desc("worth"), "word").limit(TOPICS)
    return sorted((r["word"], r["weight"]) for r in best.collect())


def _describe(batches, topics: list[tuple[str, float]]):
    names = [t for t, _ in topics]
    raw = [t.encode() for t in names]
    at = np.cumsum([0, *map(len, raw)])
    keys = span_hashes(np.frombuffer(b"".join(raw), np.uint8), at[:-1], at[1:])
    order = np.argsort(keys)
    keys, weight = keys[order], np.array([w for _, w in topics])
    for batch in batches:
        buf, offsets = flat(batch.column("text"))
        topic, size = [], []
        for i, j in spans(offsets):
            b, o = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            size.append(np.diff(words(b, o)[2]))
            _, _, _, doc, h = _long_words(b, o)
            hit = look_up(keys, h)
            doc, hit = doc[hit >= 0], order[hit[hit >= 0]]
            if len(names):
                count = np.bincount(doc * len(names) + hit, minlength=(j - i) * len(names)).reshape(j - i, len(names)) * weight
                topic += [names[k] if some else "" for k, some in zip(count.argmax(axis=1).tolist(), count.any(axis=1).tolist())]
            else:
                topic += [""] * (j - i)
        yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("doc_id"), batch.column("source"), batch.column("lang"), pa.array(topic, pa.string()), pa.array(np.concatenate(size) if size else np.zeros(0), pa.int64())], ["uid", "doc_id", "source", "lang", "topic", "n_tokens"])


def described(docs: DataFrame) -> DataFrame:
    """uid, doc_id, source, lang, topic, n_tokens of docs (uid, doc_id, text, source, lang)."""
    topics = learn_topics(docs)
    rows = docs.select("uid", "doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), "text")
    return rows.mapInArrow(lambda it: _describe(it, topics), "uid long, doc_id long, source string, lang string, topic string, n_tokens long")


# ---- targets and fitting -------------------------------------------------------------------------------


def power_targets(cells: DataFrame, columns=MARGINALS, power: float = POWER, keep_share: float = KEEP_SHARE) -> dict[str, DataFrame]:
    """For each column a table (column, share): marginals of min(tokens, c * tokens ** power), with the c that keeps the share asked for."""
    cells = cells.where("tokens > 0").withColumn("part", F.pow(F.col("tokens").cast("double"), F.lit(power)))
    total = keep_share * (cells.agg(F.sum("tokens")).first()[0] or 1.0)
    # Cells are full in the order of tokens / part, so a few steps find c.
    full, has, c = F.lit(False), 0.0, 1.0
    while row := cells.where(~full).agg(F.sum("part")).first()[0]:
        c = (total - has) / row
        now = F.col("tokens") <= c * F.col("part")
        before, has = has, float(cells.where(now).agg(F.sum("tokens")).first()[0] or 0)
        full = now
        if has <= before:
            break
    share = F.sum(F.least(F.col("tokens").cast("double"), F.col("part") * c)) / total
    return {column: cells.groupBy(column).agg(share.alias("share")) for column in columns}


def _fit(frame: pd.DataFrame, columns: list[str], tolerance: float) -> pd.DataFrame:
    """rake's sweeps on all cells at once."""
    tokens, expected, offs = frame["tokens"].to_numpy(np.float64), frame["expected"].to_numpy(np.float64), []
    marginals = []
    for c in columns:
        values, code = np.unique(frame[c], return_inverse=True)
        want = np.zeros(len(values))
        want[code] = frame[f"_{c}"]
        marginals.append((code, want))
    while not _ended(offs, tolerance):
        for code, want in marginals:
            full = expected >= tokens * (1 - 1e-12)
            sums, held = np.bincount(code, expected, len(want)), np.bincount(code, np.where(full, expected, 0.0), len(want))
            more = want > sums
            free = np.where(more, sums - held, sums)
            factor = np.where(free > 0, np.where(more, want - held, want) / np.where(free > 0, free, 1), 1.0)
            expected = np.where(more[code] & full, expected, np.minimum(expected * factor[code], tokens))
        offs.append(max((np.abs(np.bincount(code, expected, len(want))[want > 0] / want[want > 0] - 1).max(initial=0.0) for code, want in marginals), default=0.0))
    return frame.assign(expected=expected, off=offs[-1])


def _ended(offs: list[float], tolerance: float) -> bool:
    """Whether sweeps with these distances are near enough, or get no nearer."""
    return bool(offs) and (offs[-1] < tolerance or len(offs) > 10 and offs[-1] > 0.95 * offs[-11])


def rake(cells: DataFrame, targets: dict[str, DataFrame], scratch: Scratch, keep_share: float = KEEP_SHARE, tolerance: float = TOLERANCE, at_once: int = CELLS) -> tuple[DataFrame, float]:
    """cells (marginal columns, tokens) with `expected`, at most tokens, whose sums over each marginal are the target shares of what is kept; and the largest relative distance from them.

    Values that a target leaves out get nothing. Up to at_once cells are fitted in one task, more by joins with their marginals, step by step alike.
    """
    first = cells.agg(F.count(F.lit(1)), F.sum("tokens")).first()
    kept, parts = keep_share * (first[1] or 0), 1 + first[0] // CELLS
    now = cells.withColumn("expected", keep_share * F.col("tokens"))
    for column, target in targets.items():
        now = now.join(target.select(column, (F.col("share") * kept).alias(f"_{column}")), column, "left")
    now = scratch.save(now.fillna(0.0, [f"_{c}" for c in targets])).coalesce(parts)
    if first[0] <= at_once:
        names = list(targets)
        fitted = scratch.save(now.groupBy().applyInPandas(lambda frame: _fit(frame, names, tolerance), StructType([*now.schema.fields, StructField("off", DoubleType())])))
        return fitted.select(*cells.columns, "expected"), fitted.agg(F.max("off")).first()[0] or 0.0
    offs: list[float] = []
    while not _ended(offs, tolerance):
        step = now
        for column in targets:
            want, full = F.first(f"_{column}"), F.col("expected") >= F.col("tokens") * (1 - 1e-12)
            sums = step.groupBy(column).agg(want.alias("_want"), F.sum("expected").alias("_sum"), F.sum(F.when(full, F.col("expected")).otherwise(0.0)).alias("_held"))
            # Cells that give all they have are held while more is wanted; what is too much is taken from all.
            more = F.col("_want") > F.col("_sum")
            factor = F.when(more, (F.col("_want") - F.col("_held")) / F.nullif(F.col("_sum") - F.col("_held"), F.lit(0.0))).otherwise(F.col("_want") / F.nullif("_sum", F.lit(0.0)))
            sums = sums.select(column, more.alias("_more"), F.coalesce(factor, F.lit(1.0)).alias("_factor"))
            moved = F.when(F.col("_more") & full, F.col("expected")).otherwise(F.least(F.col("expected") * F.col("_factor"), F.col("tokens").cast("double")))
            step = step.join(sums, column).withColumn("expected", moved).drop("_more", "_factor")
        done = scratch.save(step).coalesce(parts)
        offs.append(max([_off(done, c) for c in targets], default=0.0))
        now = done
    return now.select(*cells.columns, "expected"), offs[-1]


def _off(cells: DataFrame, column: str) -> float:
    by = cells.groupBy(column).agg(F.first(f"_{column}").alias("want"), F.sum("expected").alias("sum"))
    return by.where("want > 0").agg(F.max(F.abs(F.col("sum") / F.col("want") - 1))).first()[0] or 0.0


def mixed(docs: DataFrame, scratch: Scratch, power: float = POWER, targets: dict[str, DataFrame] | None = None, keep_share: float = KEEP_SHARE, seed: int = 0) -> DataFrame:
    """uid, doc_id, source, lang, topic, n_tokens, weight, probability, kept, off of docs (uid, doc_id, text, source, lang).

    weight: the probability by the share that is kept; off: the largest relative distance of a marginal from its target.
    """
    rows = scratch.save(described(docs))
    cells = scratch.save(rows.groupBy(*MARGINALS).agg(F.sum("n_tokens").alias("tokens")))
    targets = targets or power_targets(cells, power=power, keep_share=keep_share)
    fitted, off = rake(cells.where("tokens > 0"), targets, scratch, keep_share)
    factors = fitted.select("source", "lang", "topic", (F.col("expected") / F.col("tokens")).alias("probability"))
    drawn = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) / float(1 << 53)
    out = rows.join(factors, ["source", "lang", "topic"], "left").withColumn("probability", F.coalesce("probability", F.lit(1.0)))
    return out.select("uid", "doc_id", "source", "lang", "topic", "n_tokens", (F.col("probability") / keep_share).alias("weight"), "probability", (drawn < F.col("probability")).alias("kept"), F.lit(off).alias("off"))


def op3_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang")
    return mixed(docs, Scratch(spark)).select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "kept", "off")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents drawn at their calibrated probabilities stay, with all their columns."""
    scratch = Scratch(spark)
    return filtered(docs, scratch, lambda mine: mixed(mine, scratch).where("kept"), "text", "source", "lang")
