"""Plain versions of the operators, one step at a time, for small inputs."""

from __future__ import annotations

import hashlib
import re

import xxhash

WHITE = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WHITE.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def substring_dedup(rows, window=50):
    """doc_id -> (n_words, n_removed, kept_sha256)."""
    first = {}
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(t)
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), d)
    out = {}
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[d] = (len(w), len(gone), sha(" ".join(kept)))
    return out


def simhash(text, shingle=3):
    w = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = words(w)
    if not w:
        return 0
    grams = [" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(values, linked):
    """value -> smallest value reachable."""
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def simhash_groups(rows, max_bits=2):
    """doc_id -> (fingerprint, component_id)."""
    prints = {d: simhash(t) for d, t in rows}
    group = components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= max_bits)
    return {d: (f"{prints[d]:016x}", group[d]) for d in prints}


def line_dedup(rows, window=3, alone=50):
    """doc_id -> text left, of rows (doc_id, text)."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        lines = (t or "").split("\n")
        full = [i for i, x in enumerate(lines) if words(x)]
        gone = set()
        for k in range(len(full)):
            for n in range(1, window + 1):
                part = full[k : k + n]
                g = tuple(lines[i] for i in part)
                if len(part) == n and (n == window or sum(len(words(x)) for x in g) >= alone):
                    if g in seen:
                        gone |= set(part)
                    seen.add(g)
        out[d] = t if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def repeat_words(w, size=8):
    count = {}
    for i in range(len(w) - size + 1):
        count.setdefault(tuple(w[i : i + size]), []).append(i)
    return len({j for at in count.values() if len(at) > 1 for i in at for j in range(i, i + size)})


def targets(sizes, weights, share=1.5, most=2):
    """source -> target: what is over the limit is shared again until nothing is."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, going, out = share * sum(sizes.values()), set(order), {}
    while going:
        total = sum(weight[s] for s in going)
        over = {s for s in going if left * weight[s] / total > most * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in going}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        going -= over
    return out
