"""Plain versions of the operators' contracts, for small inputs."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeats(docs, window, units, join):
    """{doc_id: (units, removed, spans, digest)} of (id, text) rows with different ids."""
    first, sequences = {}, {d: units(t or "") for d, t in docs}
    for d in sorted(sequences):
        u = sequences[d]
        for i in range(len(u) - window + 1):
            first.setdefault(tuple(u[i : i + window]) if isinstance(u, list) else u[i : i + window], (d, i))
    out = {}
    for d, u in sequences.items():
        covered = [False] * len(u)
        for i in range(len(u) - window + 1):
            if first[tuple(u[i : i + window]) if isinstance(u, list) else u[i : i + window]] != (d, i):
                covered[i : i + window] = [True] * window
        spans = sum(c and not (i and covered[i - 1]) for i, c in enumerate(covered))
        kept = join([x for x, c in zip(u, covered) if not c])
        out[d] = (len(u), sum(covered), spans, hashlib.sha256(kept).hexdigest())
    return out


def word_repeats(docs):
    return repeats(docs, 20, lambda t: WORD.findall(t), lambda k: " ".join(k).encode())


def byte_repeats(docs):
    return repeats(docs, 100, lambda t: t.encode(), lambda k: bytes(k))


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def components(docs, percent=85):
    """{doc_id: (n_shingles, component)} of (id, text) rows with different ids."""
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    p, q = sorted((find(a), find(b)))
                    root[q] = p
    return {d: (len(sets[d]), find(d)) for d in ids}
