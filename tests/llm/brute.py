"""Plain versions to test against, for small inputs."""

import re
from itertools import combinations


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingle_set(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(lowered)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(ids, links):
    top = {i: i for i in ids}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        top[y] = x
    return {i: root(i) for i in ids}


def near(rows, percent=85):
    """rows: (doc_id, text). {doc_id: (n_shingles, component_id)}, by all pairs that share a shingle."""
    sets = {i: shingle_set(t) for i, t in rows}
    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {p for v in by.values() for p in combinations(sorted(v), 2)}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    top = components(sets, links)
    return {i: (len(s), top[i]) for i, s in sets.items()}
