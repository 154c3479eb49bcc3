"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def suffix_dedup(docs, length=100):
    """{doc_id: (bytes, removed, runs, sha256 of the rest)}"""
    seen, out = set(), {}
    for doc_id, text in sorted(docs.items()):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            window = data[p : p + length]
            if window in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(window)
        kept = bytes(c for c, g in zip(data, gone) if not g)
        out[doc_id] = (len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def substring_dedup(docs, length=13):
    """{doc_id: (words, removed, sha256 of the rest)}"""
    words, first, out = {d: WORD.findall(t or "") for d, t in docs.items()}, {}, {}
    for d, w in sorted(words.items()):
        for p in range(len(w) - length + 1):
            first.setdefault(tuple(w[p : p + length]), d)
    for d, w in words.items():
        gone = [False] * len(w)
        for p in range(len(w) - length + 1):
            if first[tuple(w[p : p + length])] < d:
                gone[p : p + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def components(ids, links):
    parent = {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[p : p + 5]) for p in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def ngram_join(docs):
    """{doc_id: (shingles, component)}"""
    sets = {d: shingles(t) for d, t in docs.items()}
    holders, links = {}, []
    for d, own in sets.items():
        shared = Counter(other for s in own for other in holders.get(s, ()))
        links += [(d, e) for e, n in shared.items() if 100 * n >= 80 * (len(own) + len(sets[e]) - n)]
        for s in own:
            holders.setdefault(s, []).append(d)
    found = components(sets, links)
    return {d: (len(sets[d]), found[d]) for d in sets}


def near_vectors(ids, x, threshold=0.9):
    """{id: (links, component)}; rows of x that are NaN or zero link with nothing."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    ok = np.isfinite(norm[:, 0]) & (norm[:, 0] > 0)
    unit = np.where(ok[:, None], x / np.where(norm > 0, norm, 1), 0)
    near = unit @ unit.T >= threshold
    np.fill_diagonal(near, False)
    found = components(ids, [(ids[i], ids[j]) for i, j in np.argwhere(near)])
    return {d: (int(near[i].sum()), found[d]) for i, d in enumerate(ids)}


def top_k(ids, x, queries, k, scale=64):
    whole = np.floor(scale * x.astype(float)).astype(int)
    out = []
    for q in queries:
        score = whole @ whole[ids.index(q)]
        best = sorted((-int(s), i) for s, i in zip(score, ids) if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return out


def mixture(rows):
    """Targets by dealing the excess again and again. rows: (source, size)."""
    sizes = Counter()
    for s, n in rows:
        sizes[s] += n
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, target = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        level = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if level[s] > 2 * sizes[s]}
        if not over:
            return target | level
        for s in over:
            target[s] = 2 * sizes[s]
        left -= sum(target[s] for s in over)
        free -= over
