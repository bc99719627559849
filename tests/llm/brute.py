"""Plain Python versions of the operators' contracts."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, text or "")


def shingles(text, size=5):
    w = words((text or "").translate(LOWER))
    if len(w) >= size:
        return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def components(rows, percent):
    """rows: (doc_id, text), ids distinct; to (n_shingles, component_id, kept)."""
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), top(i), top(i) == i) for i, s in sets.items()}


def statistics(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit))


BENCH = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def contamination(docs, items):
    phrases = {}
    for item, text in items:
        w = words((text or "").translate(LOWER), BENCH)
        for i in range(max(1, len(w) - 9) if w else 0):
            phrases.setdefault(tuple(w[i : i + 10]), set()).add(item)
    out = []
    for doc, text in docs:
        w = words((text or "").translate(LOWER), BENCH)
        hit, found = set(), set()
        for k in {len(p) for p in phrases}:
            for i in range(len(w) - k + 1):
                if (p := tuple(w[i : i + k])) in phrases:
                    hit.update(range(i, i + k))
                    found |= phrases[p]
        ids = sorted(str(x) for x in found)
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)
