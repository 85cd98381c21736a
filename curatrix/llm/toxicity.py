"""Toxic passages by maximum-scoring segments, with extreme-value calibration.

Tokens are runs of letters, A-Z lower-cased. A token's score is its log-odds between toxic and other
labelled documents that hold it, under a Dirichlet prior in proportion to its pooled frequency (0 where the
likelihood ratio is under `EVIDENCE`), less a drift that makes ordinary text lose score. A linear-time scan finds all maximal
segments of a document. A segment's score, times the lambda at which the background's mean of
exp(lambda * score) is 1, less the log of the document's length, follows a Gumbel law in clean documents;
its location and scale are fitted to labelled documents that the token scores have not seen, and a
logistic curve over the reduced maximum and the summed excess of all segments gives the score from 0 to 1.

Bounds: the labelled rows are at most MAX_LABELLED in expectation, by hash, and so are the tokens with enough
evidence, whose scores alone are broadcast: all others score as unknown ones do. Everything else covers all
rows and whole texts.

Defined results: a null or empty text has no segment and gets the score of that; documents without a
label teach nothing, and of several labels of one document the highest counts; repeated rows are scored each;
with no label of one kind all scores are next to 0; an empty table gives an empty result; long texts are scanned whole.
Other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .folds import fold
from .kernels import LOWER, NO_LETTER, U, by_doc, flat, lean, look_up, span_hashes, spans, words
from .scratch import Scratch, filtered

MAX_LABELLED = 1 << 18
PRIOR, EVIDENCE, DRIFT = 0.01, 20.0, 0.05
THRESHOLD = 0.3
FOLDS, HELD_OUT, CALIBRATE = 4, 2, 3


def _tokens(buf: np.ndarray, offsets: np.ndarray):
    buf = LOWER[buf]
    starts, ends, first = words(buf, offsets, NO_LETTER)
    return starts, ends, first, span_hashes(buf, starts, ends)


@lean
def _count(batches):
    for batch in batches:
        buf, offsets = flat(batch.column("text"))
        label = np.asarray(batch.column("toxic")).astype(np.int64)
        for i, j in spans(offsets, 1 << 24):
            _, _, first, h = _tokens(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            doc = by_doc(first, len(h))
            keys, at = np.unique(h, return_inverse=True)
            once = np.unique(at * (j - i + 1) + doc)
            kind, label_of = once // (j - i + 1), label[i:j][once % (j - i + 1)]
            sums = [np.bincount(kind, minlength=len(keys)), np.bincount(kind, label_of, len(keys)), np.bincount(at, 1 - label[i:j][doc], len(keys))]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(pa.array(x.astype(np.int64)) for x in sums)], ["token", "docs", "toxic", "clean_tokens"])


def token_scores(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> tuple[np.ndarray, np.ndarray, float]:
    """Ascending token hashes, their scores, and lambda; labels (doc_id, toxic) is small enough to broadcast."""
    taught = docs.join(F.broadcast(labels), "doc_id").select("text", "toxic")
    counts = scratch.save(taught.mapInArrow(_count, "token long, docs long, toxic long, clean_tokens long").groupBy("token").agg(*[F.sum(c).alias(c) for c in ("docs", "toxic", "clean_tokens")]))
    pairs, toxic, tokens = (int(x or 0) for x in counts.agg(F.sum("docs"), F.sum("toxic"), F.sum("clean_tokens")).first())
    clean = pairs - toxic
    if not toxic or not clean:
        return np.zeros(0, U), np.zeros(0), 1.0
    # Twice the log-likelihood ratio against one common rate. A token without enough of it scores as an unknown one.
    want = F.col("docs") * (toxic / pairs)
    good = F.col("docs") - F.col("toxic")
    ratio = 2 * (F.col("toxic") * F.log(F.greatest("toxic", F.lit(1e-9)) / want) + good * F.log(F.greatest(good, F.lit(1e-9)) / (F.col("docs") - want)))
    table = counts.where(ratio >= EVIDENCE).toArrow()
    h, total, bad, often = (np.asarray(table.column(k)).astype(np.int64) for k in ("token", "docs", "toxic", "clean_tokens"))
    mass = PRIOR * pairs
    prior = mass * total / pairs
    score = np.log((bad + prior) / (toxic + mass)) - np.log((total - bad + prior) / (clean + mass)) - DRIFT
    share = often / max(1, tokens)
    rest = max(0.0, 1 - share.sum())
    low, high = 1e-3, 50.0
    for _ in range(60):  # the mean of exp(x * score) falls below 1 and then rises through it once
        x = (low + high) / 2
        mean = float((share * np.exp(np.minimum(x * score, 500))).sum() + rest * np.exp(-DRIFT * x))
        low, high = (x, high) if mean < 1 else (low, x)
    order = np.argsort(h.view(U))
    # With no positive score in clean text lambda has no bound; log-odds have 1 by themselves.
    return h.view(U)[order], score[order], min(1.0, (low + high) / 2)


def maximal_segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, end, score) of a sequence, in time linear in its positives.

    Each segment is linked to the last one before it with a smaller sum to its left. What a search passes over by a link is never
    looked at again: the segment that is put down there is linked past it, and one that is joined to another takes over its link.
    """
    total = np.concatenate([[0.0], np.cumsum(score)])
    plus = np.flatnonzero(score > 0)
    first: list[int] = []
    end, before, upto, link = [], [], [], []  # of each segment; sums before it and with it
    for i, left, right in zip(plus.tolist(), total[plus].tolist(), total[plus + 1].tolist()):
        begin, j = i, len(first) - 1
        while j >= 0 and before[j] >= left:
            j = link[j]
        while j >= 0 and upto[j] < right:
            begin, left, k = first[j], before[j], link[j]
            for x in (first, end, before, upto, link):
                del x[j:]
            j = k
        for x, v in ((first, begin), (end, i + 1), (before, left), (upto, right), (link, j)):
            x.append(v)
    return [(a, b, r - l) for a, b, l, r in zip(first, end, before, upto)]


@lean
def _segment(batches, model):
    table, score, scale = model.value
    for batch in batches:
        buf, offsets = flat(batch.column("text"))
        best, excess, size, passages = [], [], [], []
        for i, j in spans(offsets):
            base = offsets[i : j + 1] - offsets[i]
            starts, ends, first, h = _tokens(buf[offsets[i] : offsets[j]], base)
            at = look_up(table, h)
            s = np.where(at >= 0, score[at] if len(score) else 0.0, -DRIFT)
            hot = np.zeros(len(s) + 1, np.int64)
            np.cumsum(s > 0, out=hot[1:])
            for d in range(j - i):
                a, b = int(first[d]), int(first[d + 1])
                n = max(1, b - a)
                # Significant: more score than clean text of this length gives once.
                found = [(int(starts[a + x] - base[d]), int(ends[a + y - 1] - base[d]), v * scale) for x, y, v in maximal_segments(s[a:b])] if hot[b] > hot[a] else []
                good = [x for x in found if x[2] > np.log(n)]
                best.append(max((x[2] for x in found), default=0.0) - np.log(n))
                excess.append(sum(x[2] - np.log(n) for x in good))
                size.append(b - a)
                passages.append([{"first": x, "end": y, "score": v} for x, y, v in good])
        yield pa.RecordBatch.from_arrays(
            [batch.column("uid"), batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(best, pa.float64()), pa.array(excess, pa.float64()), pa.array(passages, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))],
            ["uid", "doc_id", "n_tokens", "best", "excess", "passages"],
        )


def _calibration(scored: DataFrame, labels: DataFrame) -> tuple[float, float, np.ndarray]:
    """Gumbel location and scale in clean documents, and the logistic weights, from a histogram of bounded size."""
    x = F.floor(F.greatest(F.lit(-40.0), F.least(F.lit(200.0), "best")) * 4)
    y = F.floor(F.log1p(F.least(F.lit(1e6), "excess")) * 8)
    rows = scored.join(F.broadcast(labels), "doc_id").groupBy(x.alias("x"), y.alias("y")).agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).collect()
    h = np.array([[float(v) for v in r] for r in rows]).reshape(-1, 4)
    best, excess, clean, toxic = (h[:, 0] + 0.5) / 4, (h[:, 1] + 0.5) / 8, h[:, 2], h[:, 3]
    if not clean.sum() or not toxic.sum():
        return 0.0, 1.0, np.array([-30.0, 0, 0])
    mean = (clean * best).sum() / clean.sum()
    spread = max(0.1, float(np.sqrt((clean * (best - mean) ** 2).sum() / clean.sum()) * np.sqrt(6) / np.pi))
    place = mean - 0.5772156649 * spread
    z = np.stack([np.ones(len(h)), np.clip((best - place) / spread, -4, 40), excess], 1)
    w = np.zeros(3)
    for _ in range(50):  # Newton's steps, with a small ridge
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (toxic - (clean + toxic) * p) - 0.1 * w
        hess = (z * ((clean + toxic) * p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(3)
        step = np.linalg.solve(hess, grad)
        w = w + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
    return float(place), spread, w


def toxic_scores(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """uid, doc_id, held_out, score, predicted, passages (byte spans) for docs (uid, doc_id, text) and labels (doc_id, toxic)."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    share = min(1.0, MAX_LABELLED / max(1, known.count()))
    known = known.where(F.xxhash64("doc_id") / 2.0**63 <= 2 * share - 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    part = fold("doc_id", FOLDS)
    model = docs.sparkSession.sparkContext.broadcast(token_scores(docs, known.where(~part.isin(HELD_OUT, CALIBRATE)), scratch))
    scored = scratch.save(docs.select("uid", "doc_id", "text").mapInArrow(lambda it: _segment(it, model), "uid long, doc_id long, n_tokens long, best double, excess double, passages array<struct<first long, end long, score double>>"))
    place, spread, w = _calibration(scored, known.where(part == CALIBRATE))
    reduced = F.greatest(F.lit(-4.0), F.least(F.lit(40.0), (F.col("best") - place) / spread))
    logit = float(w[0]) + float(w[1]) * reduced + float(w[2]) * F.log1p(F.least(F.lit(1e6), "excess"))
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit))))
    return scored.select("uid", "doc_id", (part == HELD_OUT).alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"), "passages")


def op9_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = toxic_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), scratch)
    return out.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"), "passages")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that are predicted toxic go; labels come from sf_dir."""
    scratch, labels = Scratch(spark), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return filtered(docs, scratch, lambda mine: toxic_scores(mine, labels, scratch).where("predicted = 1"), "text", anti=True)
