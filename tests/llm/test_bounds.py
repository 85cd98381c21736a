"""Bounds of time and memory, and whole scores against plain versions."""

import collections
import math
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from curatrix.llm import context_tree, toxicity
from curatrix.llm.scratch import Scratch


def plain_segments(score):
    """The segments by a search through the whole list for each positive."""
    total = np.concatenate([[0.0], np.cumsum(score)])
    found = []
    for i in np.flatnonzero(score > 0).tolist():
        begin, left, right = i, total[i], total[i + 1]
        while True:
            j = max((j for j in range(len(found)) if found[j][2] < left), default=-1)
            if j < 0 or found[j][3] >= right:
                found.append((begin, i + 1, left, right))
                break
            begin, left = found[j][0], found[j][2]
            del found[j:]
    return [(a, b) for a, b, _, _ in found]


@pytest.mark.parametrize("seed", range(30))
def test_linked_search_equals_the_plain_one(seed):
    rng = np.random.default_rng(seed)
    for score in (rng.normal(-0.1, 1, 300), rng.integers(-3, 4, 300).astype(float), np.tile([1.0, -2.0], 100), np.tile([2.0, -1.0], 100), rng.choice([1.0, -1.0], 300)):
        assert [x[:2] for x in toxicity.maximal_segments(score)] == plain_segments(score)


@pytest.mark.parametrize("pattern", [[1.0, -2.0], [2.0, -1.0], [1.0, -1.0], [3.0, -1.0, -5.0]])
def test_a_million_positives_take_seconds(pattern):
    score = np.tile(pattern, 1_000_000)
    began = time.perf_counter()
    toxicity.maximal_segments(score)
    assert time.perf_counter() - began < 20


def test_counters_hand_out_what_is_over_their_bound(monkeypatch):
    """Sums are the same however often a counter hands out, and it never holds much more than its bound."""
    rng = np.random.default_rng(1)
    texts = ["".join(map(chr, rng.integers(33, 127, 3000))) for _ in range(60)]
    batches = lambda: (pa.record_batch([pa.array([i % 2 for i in range(20)]), pa.array(texts[k : k + 20])], ["taught", "text"]) for k in (0, 20, 40))

    def sums():
        out, rows = collections.Counter(), 0
        for b in context_tree._count(batches()):
            rows += b.num_rows
            for kind, key, n, total in zip(*(b.column(c).to_pylist() for c in ("kind", "key", "n", "total"))):
                out[kind, key, "n"] += n
                out[kind, key, "total"] += total
        return out, rows

    whole, once = sums()
    monkeypatch.setattr(context_tree, "COUNTED", 5000)
    monkeypatch.setattr(context_tree, "_BLOCK", 4000)
    parts, more = sums()
    assert parts == whole and more >= once


def plain_toxicity(docs, labels):
    """The whole score, token by token in dictionaries and by the recursive definition of segments."""
    fold = lambda i: zlib.crc32(str(i).encode()) % 4 if i is not None else 0
    tokens = lambda t: re.findall("[a-z\u0080-\U0010ffff]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    known = {}
    for i, toxic in labels:
        if i is not None and toxic in (0, 1):
            known[i] = max(toxic, known.get(i, 0))
    count, bad, often = collections.Counter(), collections.Counter(), collections.Counter()
    for i, t in docs:
        if i in known and fold(i) in (0, 1):
            for w in set(tokens(t)):
                count[w] += 1
                bad[w] += known[i]
            if not known[i]:
                often.update(tokens(t))
    pairs, toxic = sum(count.values()), sum(bad.values())
    clean, score = pairs - toxic, {}
    for w, n in count.items():
        want, good = n * toxic / pairs, n - bad[w]
        ratio = 2 * (sum(x * math.log(x / y) for x, y in ((bad[w], want), (good, n - want)) if x))
        if ratio >= toxicity.EVIDENCE:
            mass = toxicity.PRIOR * pairs
            prior = mass * n / pairs
            score[w] = math.log((bad[w] + prior) / (toxic + mass)) - math.log((good + prior) / (clean + mass)) - toxicity.DRIFT
    low, high, all_ = 1e-3, 50.0, max(1, sum(often.values()))
    mean = lambda x: sum(often[w] / all_ * math.exp(min(x * s, 500)) for w, s in score.items()) + max(0.0, 1 - sum(often[w] for w in score) / all_) * math.exp(-toxicity.DRIFT * x)
    for _ in range(60):
        x = (low + high) / 2
        low, high = (x, high) if mean(x) < 1 else (low, x)
    scale = min(1.0, (low + high) / 2)
    seen = []
    for i, t in docs:
        words = tokens(t)
        s = np.array([score.get(w, -toxicity.DRIFT) for w in words])
        n = math.log(max(1, len(words)))
        total = np.concatenate([[0.0], np.cumsum(s)])
        found = [(total[b] - total[a]) * scale for a, b in plain_segments(s)]
        seen.append((i, max(found, default=0.0) - n, sum(v - n for v in found if v > n)))
    cells = collections.Counter()
    for i, best, excess in seen:
        if i in known and fold(i) == 3:
            cells[math.floor(max(-40.0, min(200.0, best)) * 4), math.floor(math.log1p(min(1e6, excess)) * 8), known[i]] += 1
    keys = sorted({k[:2] for k in cells})
    h = np.array([[x, y, cells[x, y, 0], cells[x, y, 1]] for x, y in keys], float).reshape(-1, 4)
    best, excess, ok, no = (h[:, 0] + 0.5) / 4, (h[:, 1] + 0.5) / 8, h[:, 2], h[:, 3]
    middle = (ok * best).sum() / ok.sum()
    spread = max(0.1, math.sqrt((ok * (best - middle) ** 2).sum() / ok.sum()) * math.sqrt(6) / math.pi)
    place = middle - 0.5772156649 * spread
    z = np.stack([np.ones(len(h)), np.clip((best - place) / spread, -4, 40), excess], 1)
    loss = lambda w: -(no * -np.logaddexp(0, -z @ w) + ok * -np.logaddexp(0, z @ w)).sum() + 0.05 * w @ w
    return seen, place, spread, loss


def test_whole_scores_equal_a_plain_version(spark):
    rng = np.random.default_rng(3)
    vocabulary = [chr(97 + i // 26) + chr(97 + i % 26) + "x" for i in range(120)]
    docs, labels = [], []
    for i in range(900):
        words = rng.choice(vocabulary, rng.integers(1, 60)).tolist()
        if rng.random() < 0.15:
            k = rng.integers(0, len(words) + 1)
            words[k:k] = rng.choice(["Vile", "NASTY", "awful", "groß"], rng.integers(1, 6)).tolist()
        docs.append((i, " ".join(words)))
        if i % 10:
            labels.append((i, int(any(w in ("Vile", "NASTY", "awful", "groß") for w in words))))
    docs += [(None, "vile nasty"), (5000, None), (5001, ""), (5002, "123 ."), (3, docs[3][1])]
    labels += [(3, 1), (3, 0), (None, 1), (7, None), (8, 5)]
    seen, place, spread, loss = plain_toxicity(docs, labels)
    table = spark.createDataFrame([(k, *d) for k, d in enumerate(docs)], "uid long, doc_id long, text string")
    out = toxicity.toxic_scores(table, spark.createDataFrame(labels, "doc_id long, toxic int"), Scratch(spark)).orderBy("uid").collect()
    assert len(out) == len(docs)
    # The score is a logistic curve of what the plain version gives; its weights are those of the least loss.
    x = np.array([[1.0, max(-4.0, min(40.0, (best - place) / spread)), math.log1p(min(1e6, excess))] for _, best, excess in seen])
    score = np.array([r.score for r in out])
    fit = (score > 1e-9) & (score < 1 - 1e-9)
    w, *_ = np.linalg.lstsq(x[fit], np.log(score[fit] / (1 - score[fit])), rcond=None)
    assert np.allclose(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), score, atol=1e-6)
    assert all(loss(w) <= loss(w + d) + 1e-6 for d in np.eye(3) * 0.05) and all(loss(w) <= loss(w - d) + 1e-6 for d in np.eye(3) * 0.05)
    assert [r.predicted for r in out] == [int(s >= 0.3) for s in score]
    toxic = [i for i, (_, t) in enumerate(docs) if t and re.search("vile|nasty|awful|groß", t.lower())]
    assert np.mean([out[i].predicted for i in toxic]) > 0.85 and np.mean([r.predicted for k, r in enumerate(out) if k not in set(toxic)]) < 0.03


def test_deals_give_the_same_however_batches_go_together(monkeypatch):
    """Random keys that many batches share: marks by batch are those of one batch at a time, and of a plain dictionary."""
    from curatrix.llm import suffix_dedup

    rng = np.random.default_rng(4)
    runs, seeds, plain, holders = [], [], {}, {}
    for b in range(60):
        one = np.unique(rng.integers(0, 900, rng.integers(1, 40)).astype(np.uint32))
        two, row = (one * 7 % 5).astype(np.uint64), rng.integers(0, 1000, len(one)).astype(np.uint16)
        content = rng.integers(1, 3, len(one)).astype(np.uint64) * np.uint64(b % 3 > 0)
        runs.append((1, 0, b << 20, len(one), one.tobytes() + two.tobytes() + row.tobytes()))
        seeds.append((0, 0, b << 20, len(one), one.tobytes() + content.tobytes()))
        want = [(i, holders[k]) for i, k in enumerate(one.tolist()) if k in holders]
        plain[b << 20] = want
        for k, r in zip(one.tolist(), row.tolist()):
            holders.setdefault(k, (b << 20) + r)
    whole = suffix_dedup._earlier(runs), suffix_dedup._mixed(seeds)
    for most in (1, 50, 300):
        monkeypatch.setattr(suffix_dedup, "TOGETHER", most)
        assert (suffix_dedup._earlier(runs), suffix_dedup._mixed(seeds)) == whole
    got = {b: list(zip(*(x.tolist() for x in suffix_dedup._columns(data, n, np.uint32, np.int64)))) for _, _, b, n, data in whole[0]}
    assert got == {b: w for b, w in plain.items() if w}


def test_many_small_batches_of_a_deal_take_no_longer():
    from curatrix.llm import suffix_dedup

    rng = np.random.default_rng(0)
    took = []
    for n in (100, 10_000):
        k = 200_000 // n
        batches = [(1, 0, i << 20, k, np.sort(rng.integers(0, 1 << 31, k).astype(np.uint32)).tobytes() + rng.integers(0, 1 << 60, k).tobytes() + bytes(2 * k)) for i in range(n)]
        began = time.perf_counter()
        suffix_dedup._earlier(batches)
        took.append(time.perf_counter() - began)
    assert took[1] < 5 * took[0] + 0.3


def drawn(doc_id, seed=0):
    """The number from 0 to 1 that decides about a document, by another library's hash."""
    import struct

    import xxhash

    h = 42 if doc_id is None else xxhash.xxh64_intdigest(struct.pack("<q", doc_id), seed=42)
    return (xxhash.xxh64_intdigest(struct.pack("<i", seed), seed=h) >> 11) / 2**53


def test_the_draw_of_the_mixing_stage(spark, sf):
    """Kept documents are those whose number is under their cell's probability."""
    import brute
    from curatrix.llm import mixing
    from curatrix.llm.scratch import with_uid

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    described = mixing.described(with_uid(docs, Scratch(spark)).join(docs.select("doc_id", "source", "lang"), "doc_id")).collect()
    cells = collections.Counter()
    for r in described:
        cells[r.source, r.lang, r.topic] += r.n_tokens
    # Raking in dictionaries: each marginal in turn is brought to what the default targets ask for, full cells are held while more is wanted.
    total, want = sum(cells.values()), brute.power_shares(dict(cells), mixing.POWER, mixing.KEEP_SHARE)
    expected = {c: mixing.KEEP_SHARE * n for c, n in cells.items() if n}
    for _ in range(400):
        for k in range(3):
            asked, has, held = collections.Counter(), collections.Counter(), collections.Counter()
            for c, x in expected.items():
                asked[c[k]] += want[c] * mixing.KEEP_SHARE * total
                has[c[k]] += x
                held[c[k]] += x if x >= cells[c] * (1 - 1e-12) else 0
            for c, x in expected.items():
                more, full = asked[c[k]] > has[c[k]], x >= cells[c] * (1 - 1e-12)
                if not (more and full):
                    free = has[c[k]] - held[c[k]] if more else has[c[k]]
                    expected[c] = min(cells[c], x * ((asked[c[k]] - held[c[k]] if more else asked[c[k]]) / free if free else 1.0))
    kept = {r.doc_id for r in mixing.stage(spark, docs, sf).select("doc_id").collect()}
    sure = 0
    for r in described:
        tokens = cells[r.source, r.lang, r.topic]
        p = expected[r.source, r.lang, r.topic] / tokens if tokens else 1.0
        if abs(drawn(r.doc_id) - p) > 0.005:
            sure += 1
            assert (r.doc_id in kept) == (drawn(r.doc_id) < p)
    assert sure > 0.9 * len(described) and len(kept) < len(described)


def test_the_toxicity_stage_drops_what_is_predicted_toxic_and_nothing_else(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = toxicity.toxic_scores(docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text"), labels, Scratch(spark)).select("doc_id", "predicted").collect()
    out = toxicity.stage(spark, docs, sf)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(r.doc_id for r in scored if not r.predicted)


def test_outside_targets_for_source_language_and_topic(spark):
    """Weights that are given for all three marginals are met, and the draw follows them."""
    from curatrix.llm import mixing

    rng = np.random.default_rng(2)
    rows = [(f"s{i}", f"l{j}", f"t{k}", int(rng.integers(2_000, 9_000))) for i in range(3) for j in range(2) for k in range(4)]
    cells = Scratch(spark).save(spark.createDataFrame(rows, "source string, lang string, topic string, tokens long"))
    given = {"source": {"s0": 0.5, "s1": 0.3, "s2": 0.2}, "lang": {"l0": 0.7, "l1": 0.3}, "topic": {"t0": 0.4, "t1": 0.3, "t2": 0.2, "t3": 0.1}}
    targets = {c: spark.createDataFrame(list(g.items()), f"{c} string, share double") for c, g in given.items()}
    fitted, off = mixing.rake(cells, targets, Scratch(spark), keep_share=0.2)
    out = fitted.toPandas()
    assert off < 1e-4
    for c, g in given.items():
        assert all(abs(out[out[c] == v]["expected"].sum() / out["expected"].sum() - x) < 2e-4 for v, x in g.items())


def test_the_genetic_search_saves_sequences_where_best_fit_leaves_some():
    """Pieces of a fifth to half of a sequence: no more sequences than best fit gives, fewer in the end, never under the bound."""
    from curatrix.llm import packing

    saved = []
    for seed in range(3):
        sizes = np.random.default_rng(seed).integers(400, 1100, 1024)
        first = packing.evolve(sizes, np.random.default_rng(seed), 2048, population=1, children=0)[0].max() + 1
        pool = packing.evolve(sizes, np.random.default_rng(seed), 2048, children=40)
        best = pool[0].max() + 1
        assert np.bincount(pool[0], sizes).max() <= 2048 and -(-sizes.sum() // 2048) <= best <= first
        saved.append(first - best)
    assert sum(saved) > 0


@pytest.fixture(scope="module")
def huge(spark, tmp_path_factory):
    """A text of 1.5 MB of words, its copy with one word more, one of a single word of 1 MB, and small ones."""
    rng = np.random.default_rng(9)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in rng.integers(2, 9, 4000)]
    long = " ".join(rng.choice(words, 250_000))
    rows = [(1, long), (2, long + " more"), (3, "x" * 1_000_000), (4, "a few words " * 20), (5, None)]
    folder = str(tmp_path_factory.mktemp("huge"))
    spark.createDataFrame([(i, t, "en" if i % 2 else "de", f"s{i % 2}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(1, 6)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, dict(rows)


@pytest.mark.parametrize("name", ["op1_group_packing", "op2_host_rules", "op3_raking", "op4_block_naming", "op5_context_tree", "op6_word_backoff", "op7_suffix_levels", "op8_repair_shards", "op9_segments", "op10_super_minhash", "op12_virtual_slots"])
def test_texts_of_more_than_a_megabyte(spark, huge, name):
    import hashlib

    from curatrix.llm.registry import QUERIES

    folder, texts = huge
    out = collections.defaultdict(list)
    for r in QUERIES[name](spark, folder).collect():
        out[r.doc_id].append(r)
    assert sorted(out) == [1, 2, 3, 4, 5] and (name == "op1_group_packing" or all(len(v) == 1 for v in out.values()))
    one = {k: v[0] for k, v in out.items()}
    words = {i: (t or "").split() for i, t in texts.items()}
    if name == "op1_group_packing":
        assert all(sorted(r.piece for r in v) == list(range(len(v))) and sum(r.length for r in v) > len(words[i]) for i, v in out.items())
    elif name == "op2_host_rules":
        assert all(one[i].n_words == len(words[i]) and one[i].word_chars == sum(map(len, words[i])) for i in texts)
    elif name == "op3_raking":
        assert one[1].n_tokens == 250_000 and one[2].n_tokens == 250_001
    elif name == "op4_block_naming":
        assert all(one[i].text_sha256 == hashlib.sha256((t or "").lower().encode()).hexdigest() and one[i].keep_id == i for i, t in texts.items())
    elif name == "op5_context_tree":
        assert all(one[i].n_tokens == len(words[i]) + 1 for i in texts) and one[3].bits_per_byte < one[1].bits_per_byte
    elif name == "op7_suffix_levels":
        assert one[1].n_removed == 0 and one[2].n_removed == len(texts[1]) and one[2].n_bytes == len(texts[2]) and one[2].kept_sha256 == hashlib.sha256(b" more").hexdigest()
    elif name == "op8_repair_shards":
        starts = sorted((r.start, r.n_tokens) for r in one.values())
        assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:])) and one[1].n_tokens > 250_000
    elif name == "op10_super_minhash":
        assert one[2].component_id == 1 and not one[2].kept and one[3].n_shingles == 1 and one[1].n_shingles == len({tuple(words[1][k : k + 5]) for k in range(249_996)})
    elif name == "op12_virtual_slots":
        assert all(one[i].text_crc32 == zlib.crc32((t or "").encode()) and one[i]["size"] == len((t or "").encode()) + 1 for i, t in texts.items())
    else:
        assert all(0 <= r.score <= 1 for r in one.values())


@pytest.mark.parametrize("n", [0, 1, 7, 65_536, 200_001])
def test_strings_tallied_and_looked_up_like_plain_ones(n):
    rng = np.random.default_rng(n)
    # Few and many repeats, the least and the largest string among them.
    strings = np.where(rng.random(n) < 0.5, rng.integers(0, 50, n), rng.integers(0, 1 << 48, n)).astype(np.uint64)
    strings[:2] = [0, (1 << 48) - 1][: len(strings[:2])]
    taught = rng.integers(0, 2, n).astype(np.float64)
    want = {}
    for k, t in zip(strings.tolist(), taught.tolist()):
        a, b = want.get(k, (0, 0))
        want[k] = a + int(t), b + 1
    keys, some, every = context_tree._tally(strings, taught)
    assert keys.tolist() == sorted(want) and list(zip(some.tolist(), every.tolist())) == [want[k] for k in sorted(want)]
    table = keys[::2]
    place = {k: i for i, k in enumerate(table.tolist())}
    assert context_tree._look_up_strings(table, strings).tolist() == [place.get(k, -1) for k in strings.tolist()]
