"""Plain versions of the operators, on lists."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, size):
    w = words(lower(text))
    if not w:
        return set()
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)}


def near_groups(rows, size=5, percent=80):
    """doc_id -> (n_shingles, component)."""
    sets = [(i, shingles(t, size)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets}


def repeats(rows, window=13):
    """(doc_id, n_words, n_removed, kept text) of each row."""
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(i, first.get(g, i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def repeated_words(text):
    w = words(text)
    g = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    return len({k + d for k, x in enumerate(g) if g.count(x) > 1 for d in range(3)})


def paths(codes, options):
    """All readings of a lattice with their channel's logarithm, by enumeration."""
    found = [(b"", 0.0)]
    for c in codes:
        found = [(text + (bytes([byte]) if byte else b""), cost + more) for text, cost in found for byte, more in options[c]]
    return found


def path_score(text, cost, table, classes):
    """The channel's logarithm plus that of the reading under byte-class trigrams."""
    a = b = 0
    for byte in [*text, 0]:
        z = int(classes[byte]) if byte else 0
        cost += table[a][b][z]
        a, b = b, z
    return cost
