"""Plain versions of the operators, for small inputs."""

import collections
import hashlib
import math
import re
import zlib

import xxhash


def lower(text):
    return (text or "").encode().lower().decode()


def exact_groups(docs):
    groups = collections.defaultdict(list)
    for doc_id, text in docs:
        groups[lower(text)].append(doc_id)
    return {(d, max(ids, key=lambda x: (x is not None, x)), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for d in ids}


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(items, linked):
    """The least index reachable from each."""
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(items))]


def near_groups(docs):
    fps = [simhash(t) for _, t in docs]
    roots = components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for (doc_id, _), r in zip(docs, roots, strict=True):
        least[r] = min((x for x in (least.get(r), doc_id) if x is not None), default=None)
    return [(d, f"{fp:016x}", least[r]) for (d, _), fp, r in zip(docs, fps, roots, strict=True)]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def alike(a, b):
    return 10 * len(a & b) >= 8 * len(a | b)


def least_similar(docs):
    """The least id of each group of texts of similarity 0.8 or more."""
    roots = components([shingles(t) for _, t in docs], alike)
    least = {}
    for (d, _), r in zip(docs, roots, strict=True):
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted(least.values(), key=str)


def contamination(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for item_id, text in items:
        words = word.findall(lower(text))
        for k in range(max(1, len(words) - 9)) if words else ():
            windows.setdefault(tuple(words[k : k + 10]), set()).add(str(item_id))
    for doc_id, text in docs:
        words, hit, found = word.findall(lower(text)), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                if ids := windows.get(tuple(words[k : k + n])):
                    found |= ids
                    hit.update(range(k, k + n))
        yield doc_id, len(words), len(hit), tuple(sorted(found))


def repeats(docs, n=35):
    texts = [(d, (t or "").split() if t is None else re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t in docs]
    seen = collections.Counter(tuple(w[i : i + n]) for _, w in texts for i in range(len(w) - n + 1))
    for doc_id, words in texts:
        gone = {p for i in range(len(words) - n + 1) if seen[tuple(words[i : i + n])] > 1 for p in range(i, i + n)}
        yield doc_id, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)


def discounts(n1, n2, n3, n4):
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    out = []
    for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)):
        out.append(min(max(k - (k + 1) * y * (b / a if a else 0), 0.1 * k), 0.95 * k))
    return out


def kneser_ney(docs, order=3):
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None]
    train = [tokens(t) for d, t in docs if d is None or zlib.crc32(str(d).encode()) % 10]
    count = collections.Counter(w for t in train for w in t)
    total, distinct = sum(count.values()), len(count)
    raw = {n: collections.Counter(tuple(["<s>", *t][k : k + n]) for t in train for k in range(len(t) + 2 - n)) for n in range(2, order + 1)}
    adjusted = {order: raw.get(order, {})}
    for n in range(order - 1, 0, -1):
        adjusted[n] = collections.Counter(g[1:] for g in raw[n + 1])
        adjusted[n].update({g: c for g, c in raw.get(n, {}).items() if g[0] == "<s>"})
    ones = lambda c: [sum(1 for x in c.values() if x == k) for k in (1, 2, 3, 4)]
    discount = {n: discounts(*ones(c)) for n, c in adjusted.items()}
    sums, spare = collections.Counter(), collections.Counter()
    for n, grams in adjusted.items():
        for g, c in grams.items():
            sums[g[:-1]] += c
            spare[g[:-1]] += discount[n][min(c, 3) - 1]
    for doc_id, text in docs:
        t = tokens(text)
        base = score = 0.0
        for k, w in enumerate(t):
            base += math.log10((count[w] + 0.1) / (total + 0.1 * (distinct + 1)))
            p = 1 / (distinct + 1)
            for n in range(1, order + 1):
                context = tuple(["<s>", *t][k + 2 - n : k + 1]) if k + 2 - n >= 0 else None
                if context is not None and sums[context]:
                    c = adjusted[n][*context, w]
                    p = (max(c - discount[n][min(c, 3) - 1], 0) if c else 0) / sums[context] + spare[context] / sums[context] * p
            score += math.log10(p)
        yield doc_id, len(t), sum(count[w] > 0 for w in t), total, base, score
