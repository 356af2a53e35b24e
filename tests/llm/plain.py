"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = WORDS.findall((text or "").translate(FOLD))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def classes(rows):
    """{id: component} of (id, text) rows; every text of an id counts."""
    sets = defaultdict(set)
    for key, text in rows:
        sets[key].add(shingle_set(text))
    parent = {k: k for k in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if any(x and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {k: find(k) for k in keys}


def removed(sequences, window):
    """[(removed flags)] of (id, sequence) rows: windows that also start in a row with a smaller id."""
    least = {}
    for key, s in sequences:
        if key is not None:
            for i in range(len(s) - window + 1):
                w = tuple(s[i : i + window])
                least[w] = min(least.get(w, key), key)
    out = []
    for key, s in sequences:
        flags = [False] * len(s)
        for i in range(len(s) - window + 1):
            if key is not None and least[tuple(s[i : i + window])] < key:
                flags[i : i + window] = [True] * window
        out.append(flags)
    return out


def sha(data):
    return hashlib.sha256(data).hexdigest()


def containments(docs, items, least=0.75):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    held, out = defaultdict(list), set()
    for key, text in docs:
        if key is not None:
            held[key].append(words(text))
    shingles, length = defaultdict(set), {}
    for key, text in items:
        w = words(text)
        if key is not None and w:
            m = min(5, len(w))
            shingles[key] |= {tuple(w[i : i + m]) for i in range(len(w) - m + 1)}
    for key, texts in held.items():
        own = {tuple(w[i : i + m]) for w in texts for m in range(1, 6) for i in range(len(w) - m + 1)}
        for item, s in shingles.items():
            if len(own & s) >= least * len(s):
                out.add((key, item, len(s), len(own & s)))
    return out
