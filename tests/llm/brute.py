"""Plain single-process versions of the contracts, for tests only."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def near_components(rows, percent=85, size=5):
    """{doc_id: (n_shingles, component_id)} by comparing all pairs that share a shingle."""
    sets = {}
    for doc_id, text in rows:
        w = [re.sub("[A-Z]+", lambda m: m[0].lower(), x) for x in words(text)]
        sets[doc_id] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    holders = defaultdict(list)
    for doc_id, s in sets.items():
        for x in s:
            holders[x].append(doc_id)
    common = defaultdict(int)
    for ids in holders.values():
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                common[min(a, b), max(a, b)] += 1
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {d: (len(sets[d]), find(d)) for d in sets}


def substring_removal(rows, size=13):
    """{doc_id: (n_words, n_removed, kept_sha256)}."""
    first = {}
    docs = {d: words(t) for d, t in rows}
    for d in sorted(docs):
        for i in range(len(docs[d]) - size + 1):
            first.setdefault(tuple(docs[d][i : i + size]), d)
    out = {}
    for d, w in docs.items():
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < d:
                gone[i : i + size] = [True] * size
        out[d] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))
    return out
