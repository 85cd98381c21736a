"""Quality rules of documents, and verdicts on the hosts they come from.

Base rules are counted for each document. The share of failing documents of a host is shrunk towards a
beta prior that is fitted to all hosts by moments, and a host whose shrunk rate reaches `max_rate` loses
its documents.

Defined results: a null text has no words and fails; documents without a source form a host of their
own; repeated rows count each; an empty table gives an empty result; long texts are counted whole. Other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .kernels import U, add_up, by_doc, char_counts, flat, mix, span_hashes, spans, words
from .scratch import Scratch

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_RATE = 0.5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether another equals it, and whether an equal one was sorted before it."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    any_, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    any_[order[1:]] = same
    later[order[1:]] = same
    any_[order[:-1]] |= same
    return any_, later


def _base(buf: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    starts, ends, first = words(buf, offsets)
    n, docs = len(starts), len(offsets) - 1
    chars = char_counts(buf)
    doc = by_doc(first, n)
    h = span_hashes(buf, starts, ends)
    repeat = np.zeros(n, bool)
    if n > 2:
        inside = np.flatnonzero(doc[:-2] == doc[2:])
        salt = mix(np.arange(docs, dtype=U) + U(1))
        key = mix(mix(mix(h[inside]) + h[inside + 1]) + h[inside + 2]) ^ salt[doc[inside]]
        at = inside[_repeats(key)[0]]
        for k in range(3):
            repeat[at + k] = True
    # Lines begin at a document or after a line feed, and end before the next of either.
    feeds = np.flatnonzero(buf == 10)
    begins = np.union1d(offsets[:-1], feeds + 1)
    begins = begins[begins < len(buf)]
    line_doc = np.searchsorted(offsets, begins, "right") - 1
    stops = np.minimum(np.append(feeds, len(buf))[np.searchsorted(feeds, begins)], offsets[line_doc + 1])
    full = np.searchsorted(starts, stops) > np.searchsorted(starts, begins)
    begins, stops, line_doc = begins[full], stops[full], line_doc[full]
    keys = span_hashes(buf, begins, stops) ^ mix(line_doc.astype(U) + U(7))
    dup = _repeats(keys)[1]
    return [
        np.diff(first),
        add_up(chars[ends] - chars[starts], first),
        add_up(_SYMBOL[buf], offsets),
        np.bincount(line_doc[dup], minlength=docs),
        add_up(repeat, first),
    ]


def _count(batches):
    for batch in batches:
        buf, offsets = flat(batch.column("text"))
        parts = [_base(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in spans(offsets)]
        columns = [pa.array(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0), pa.int64()) for k in range(len(_COUNTS))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), *columns], ["doc_id", "host", *_COUNTS])


def base_rules(docs: DataFrame, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """The base counts and base_failed of docs (doc_id, host, text)."""
    counts = docs.select("doc_id", "host", "text").mapInArrow(_count, "doc_id long, host string, " + ", ".join(f"{c} long" for c in _COUNTS))
    return counts.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """alpha and beta of the prior on failure rates, by moments over hosts (n, failed)."""
    row = hosts.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("squares")).first()
    if not row["k"]:
        return 1.0, 1.0
    mean = (row["failed"] + 1.0) / (row["n"] + 2.0)
    rate = row["failed"] / row["n"]
    noise = rate * (1 - rate) * (row["k"] - 1) / row["n"]
    between = max(row["squares"] / row["n"] - rate * rate - noise, 1e-6)
    strength = min(max(mean * (1 - mean) / between - 1, 1.0), 1e6)
    return mean * strength, (1 - mean) * strength


def host_rules(base: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """base with host_rejected and kept. base is read twice, so it is best a written table."""
    hosts = base.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if("base_failed").alias("failed"))
    alpha, beta = beta_prior(hosts)
    verdicts = hosts.select("host", ((F.col("failed") + alpha) / (F.col("n") + (alpha + beta)) >= max_rate).alias("host_rejected"))
    return base.join(verdicts, "host").withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def op2_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("host"), "text")
    return host_rules(Scratch(spark).save(base_rules(docs))).select("doc_id", *_COUNTS, "base_failed", "kept")


SQL = {
    "op2_host_rules": r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t)),
g AS (SELECT doc_id, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (
  SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, w2, w3) AS c FROM g WHERE w3 IS NOT NULL) WHERE c > 1) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars FROM w GROUP BY doc_id),
l AS (SELECT doc_id, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
b AS (SELECT t.doc_id, t.host, coalesce(n.n_words, 0) AS n_words, coalesce(n.word_chars, 0)::BIGINT AS word_chars, l.n_symbols, len(l.ls) - len(list_distinct(l.ls)) AS n_dup_lines, coalesce(r.n_repeat_words, 0) AS n_repeat_words
  FROM t JOIN l USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
h AS (SELECT host, count(*) AS n, count(*) FILTER (base_failed) AS failed FROM f GROUP BY host),
m AS (SELECT (sum(failed) + 1.0) / (sum(n) + 2.0) AS mean, sum(failed)::DOUBLE / sum(n) AS rate, sum(failed * failed / n::DOUBLE) / sum(n) AS sq, count(*) AS k, sum(n) AS nn FROM h),
p AS (SELECT mean, least(greatest(mean * (1 - mean) / greatest(sq - rate * rate - rate * (1 - rate) * (k - 1) / nn, 1e-6) - 1, 1.0), 1e6) AS s FROM m),
v AS (SELECT host, (failed + mean * s) / (n + s) >= 0.5 AS rejected FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM f JOIN v USING (host)"""
}
