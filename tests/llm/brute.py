"""Plain versions of the corpus operators, for small inputs."""

import collections
import hashlib
import itertools
import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def repeats(rows, length, unit):
    """doc_id -> (units, removed, spans, digest); ids are distinct."""
    first, seqs, out = {}, [], {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        u = WORD.findall(b) if unit == "word" else b
        seqs.append((d, u))
        for i in range(len(u) - length + 1):
            first.setdefault(tuple(u[i : i + length]), (d, i))
    for d, u in seqs:
        gone = [False] * len(u)
        for i in range(len(u) - length + 1):
            if first[tuple(u[i : i + length])] != (d, i):
                gone[i : i + length] = [True] * length
        kept = [x for x, g in zip(u, gone, strict=True) if not g]
        data = b" ".join(kept) if unit == "word" else bytes(kept)
        out[d] = (len(u), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(data).hexdigest())
    return out


def _shingles(rows, words):
    sets = {}
    for d, t in rows:
        w = [x.lower() for x in WORD.findall((t or "").encode())]
        sets[d] = frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else None
    return sets


def links(rows, words=5, alike=0.8):
    """doc_id -> how many other shingle sets its own is linked to."""
    sets = _shingles(rows, words)
    kinds = set(sets.values()) - {None}
    return {d: sum(len(s & k) >= alike * len(s | k) - 1e-12 for k in kinds if k != s) if s else 0 for d, s in sets.items()}


def classes(rows, words=5, alike=0.8):
    """doc_id -> (smallest id, size) of its class of near-duplicates."""
    sets = _shingles(rows, words)
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= alike * len(sets[a] | sets[b]) - 1e-12:
            up[max(top(a), top(b))] = min(top(a), top(b))
    groups = collections.defaultdict(list)
    for d in sets:
        groups[top(d)].append(d)
    return {d: (min(g), len(g)) for g in groups.values() for d in g}
