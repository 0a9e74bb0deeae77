"""Plain versions of the text operators, written from their contracts."""

import hashlib
import math
import re
from collections import Counter

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def suffix(rows, length):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i:i + length] for _, b in texts for i in range(len(b) - length + 1))
    out = []
    for d, b in texts:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, bits):
    """Least value reachable over at most ``bits`` differing bits."""
    values, low = sorted(set(values)), {}
    for start in values:
        if start in low:
            continue
        queue = [start]
        low[start] = start
        while queue:
            x = queue.pop()
            for y in values:
                if y not in low and (x ^ y).bit_count() <= bits:
                    low[y] = start
                    queue.append(y)
    return low


def simhash(rows):
    prints = [(d, fingerprint(t)) for d, t in rows]
    root = groups([f for _, f in prints], 4)
    least = {}
    for d, f in prints:
        if d is not None:
            least[root[f]] = min(least.get(root[f], d), d)
    return [(d, f"{f:016x}", least.get(root[f])) for d, f in prints]


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def decontamination(rows, items, window=10):
    windows = {}
    for item, text in items:
        words = alnum_words(text)
        if item is None or not words:
            continue
        for i in range(max(1, len(words) - window + 1)):
            windows.setdefault(tuple(words[i:i + window]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for d, text in rows:
        words, hit, found = alnum_words(text), set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if tuple(words[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(words[i:i + n])]
        out.append((d, len(words), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    return out


def substring(rows, window):
    docs = [(math.inf if d is None else d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    least = {}
    for d, words in docs:
        for i in range(len(words) - window + 1):
            key = tuple(words[i:i + window])
            least[key] = min(least.get(key, d), d)
    out = []
    for (d0, _), (d, words) in zip(rows, docs):
        gone = set()
        for i in range(len(words) - window + 1):
            if least[tuple(words[i:i + window])] < d:
                gone |= set(range(i, i + window))
        out.append((d0, len(words), len(gone), sha(" ".join(w for i, w in enumerate(words) if i not in gone))))
    return out


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def top_k(rows, k=20):
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
             if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in whole:
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in whole if j != i and len(w) == len(v))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return out


def kneser_ney(texts, trusted, discounts, order=5):
    """Perplexities of texts under the model of the trusted ones, and the model's p(last byte | bytes before)."""
    def grams(t):
        padded = b"\n" * (order - 1) + t
        return [padded[i:i + order] for i in range(len(t))]

    level = {order: Counter(g for t in trusted for g in grams(t))}
    for n in range(order - 1, 0, -1):
        level[n] = Counter(g[1:] for g in level[n + 1])
    cut = {n: discounts(Counter(c.values())) for n, c in level.items()}
    whole, taken = {n: Counter() for n in level}, {n: Counter() for n in level}
    for n, counts in level.items():
        for g, c in counts.items():
            whole[n][g[:-1]] += c
            taken[n][g[:-1]] += cut[n][min(c, 3)]

    def p(g, n=order):
        if n == 0:
            return 1 / 256
        g = g[-n:]
        low, before = p(g, n - 1), g[:-1]
        if not whole[n][before]:
            return low
        c = level[n].get(g, 0)
        return (c - (cut[n][min(c, 3)] if c else 0) + taken[n][before] * low) / whole[n][before]

    return [math.exp(-sum(math.log(p(g)) for g in grams(t)) / len(t)) if t else None for t in texts], p
