"""Plain Python forms of the operators' results, for small tables."""

import collections
import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def exact(rows):
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[(t or "").translate(LOW)].append(d)
    key = lambda d: -math.inf if d is None else d
    return sorted(((d, max(ids, key=key), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for d in ids), key=str)


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    tri = collections.Counter(zip(w, w[1:], w[2:]))
    rep = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(rep)


def near(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    pick = lambda ids: min([x for x in ids if x is not None], default=None)
    return sorted(((d, len(sets[i]), pick(least[find(i)])) for i, (d, _) in enumerate(rows)), key=str)


def repeats(rows, n=50):
    key = lambda d: -math.inf if d is None else d
    first = {}
    texts = [(d, (t or "").encode()) for d, t in rows]
    for d, b in sorted(texts, key=lambda x: key(x[0])):
        for p in range(len(b) - n + 1):
            first.setdefault(b[p : p + n], key(d))
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if first[b[p : p + n]] < key(d):
                gone[p : p + n] = b"\1" * n
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def fold(d, n):
    return 0 if d is None else zlib.crc32(str(d).encode()) % n


def tree(rows, depth=5):
    """log10 probability of each text under the weighted tree of the training texts, by recursion over nodes."""
    counts = collections.defaultdict(lambda: [0, 0])
    nodes = set()

    def walk(t):
        b = bytes(depth) + (t or "").encode()
        for i in range(depth, len(b)):
            for bit in range(8):
                prefix = (1 << bit) | (b[i] >> (8 - bit))
                yield b[i - depth : i], prefix, (b[i] >> (7 - bit)) & 1

    for d, t in rows:
        for context, prefix, one in walk(t):
            for k in range(depth + 1):
                node = (context[depth - k :], prefix)
                nodes.add(node)
                if fold(d, 7) != 2:
                    counts[node][one] += 1
    children = collections.defaultdict(set)
    for c, p in nodes:
        if c:
            children[(c[1:], p)].add((c, p))

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    weighted = {}
    for c, p in sorted(nodes, key=lambda x: -len(x[0])):
        own = kt(*counts[(c, p)])
        if len(c) == depth:
            weighted[(c, p)] = own
        else:
            low = sum(weighted[x] for x in children[(c, p)])
            top = max(own, low)
            weighted[(c, p)] = top + math.log(math.exp(own - top) + math.exp(low - top)) - math.log(2)
    out = []
    for d, t in rows:
        score = 0.0
        for context, prefix, one in walk(t):
            mixed, rest, here = 0.0, 1.0, 0.5
            for k in range(depth + 1):
                node = (context[depth - k :], prefix)
                a, b = counts[node]
                if a + b:
                    here = (b + 0.5) / (a + b + 1)
                stop = 1.0 if k == depth else math.exp(kt(a, b) - math.log(2) - weighted[node])
                mixed, rest = mixed + rest * stop * here, rest * (1 - stop)
            score += math.log10(mixed if one else 1 - mixed)
        out.append(score)
    return out


def language(rows, longest=4):
    """doc_id to (language, score) of rows (doc_id, text, lang or None where it teaches nothing), word by word."""
    letters = re.compile(r"[a-z\x80-\U0010ffff]+")
    cut = lambda t: letters.findall((t or "").translate(LOW))
    langs = sorted({x for _, _, x in rows if x is not None})

    def grams(w, n):
        b = w if n == 1 else f"\n{w}\n"
        return [g for g in (b[i : i + n] for i in range(len(b) - n + 1)) if g != "\n\n"]

    tables = [collections.defaultdict(lambda: [0] * len(langs)) for _ in range(longest + 1)]
    for _, t, x in rows:
        if x is not None:
            for w in cut(t):
                for n in range(longest + 1):
                    for g in [w] if n == 0 else grams(w, n):
                        tables[n][g][langs.index(x)] += 1
    sums = [[sum(v[k] for v in table.values()) for k in range(len(langs))] for table in tables]
    log = lambda n, g, k: math.log((tables[n][g][k] + 0.5) / (sums[n][k] + 0.5 * len(tables[n])))
    out = {}
    for d, t, _ in rows:
        s = [0.0] * len(langs)
        for w in cut(t):
            if w in tables[0]:
                s = [x + log(0, w, k) for k, x in enumerate(s)]
                continue
            for n in range(longest, 0, -1):
                known = [g for g in grams(w, n) if g in tables[n]]
                if known:
                    s = [x + sum(log(n, g, k) for g in known) / len(known) for k, x in enumerate(s)]
                    break
        if any(c.isalpha() for c in t or ""):
            out[d] = langs[s.index(max(s))], 1 / sum(math.exp(x - max(s)) for x in s)
        else:
            out[d] = "und", 0.0
    return out


def power_shares(tokens, power, keep):
    """Shares in proportion to tokens ** power, none above what the value has of what is kept."""
    total, full = keep * sum(tokens.values()), set()
    tokens = {k: v for k, v in tokens.items() if v}
    while True:
        rest = {k: v**power for k, v in tokens.items() if k not in full}
        c = (total - sum(tokens[k] for k in full)) / sum(rest.values())
        more = {k for k in rest if tokens[k] < c * rest[k]}
        if not more:
            return {k: (tokens[k] if k in full else c * rest[k]) / total for k in tokens}
        full |= more
