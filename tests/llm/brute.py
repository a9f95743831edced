"""Plain Python versions of the operators, for small inputs."""

import re
import zlib

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
BENCH = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def bench_words(text):
    return BENCH.findall((text or "").translate(LOWER))


def shingles(text, size):
    w = words(text)
    size = min(size, len(w))
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if w else set()


def near_duplicates(docs, size, percent):
    """{doc_id: (n_shingles, component_id)} of {doc_id: text}."""
    sets = {d: shingles(t, size) for d, t in docs.items()}
    parent = {d: d for d in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def smallest_capacity(weights, shards):
    def need(cap):
        n, room = 1, cap
        for w in weights:
            if w > room:
                n, room = n + 1, cap
            room -= w
        return n
    cap = max(weights)
    while need(cap) > shards:
        cap += 1
    return cap


def remainder(doc_id, m):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % m
