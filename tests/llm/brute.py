"""Plain versions of the corpus operators, for small tables."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def dedup(rows, width=50):
    """(doc_id, n_words, n_removed, sha) of (doc_id, text) rows."""
    large = float("inf")
    least = {}
    for doc, text in rows:
        own = words(text)
        for i in range(len(own) - width + 1):
            key = tuple(own[i : i + width])
            least[key] = min(least.get(key, large), large if doc is None else doc)
    out = []
    for doc, text in rows:
        own = words(text)
        gone = set()
        for i in range(len(own) - width + 1):
            if least[tuple(own[i : i + width])] < (large if doc is None else doc):
                gone.update(range(i, i + width))
        kept = " ".join(w for i, w in enumerate(own) if i not in gone)
        out.append((doc, len(own), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingles(text):
    own = words(lower(text))
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def components(rows):
    """(doc_id, n_shingles, component_id) of (doc_id, text) rows, every pair compared."""
    sets = [(doc, shingles(text)) for doc, text in rows]
    root = {doc: doc for doc, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    having = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            having[x].append(k)
    pairs = {(a, b) for own in having.values() for i, a in enumerate(own) for b in own[i + 1 :]}
    for a, b in pairs:
        (x, s), (y, t) = sets[a], sets[b]
        if x is not None and y is not None and 100 * len(s & t) >= 75 * len(s | t):
            low, high = sorted((find(x), find(y)))
            root[high] = low
    return [(doc, len(s), None if doc is None else find(doc)) for doc, s in sets]
