"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def letter_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def shingle_set(text):
    w = space_words(text)
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def near_duplicates(docs):
    """``{doc_id: (n_shingles, component)}`` of ``(doc_id, text)`` with ids that are all different."""
    sets = {i: shingle_set(t) for i, t in docs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            both = len(a & b)
            if both and 100 * both >= 75 * (len(a) + len(b) - both):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def contamination(docs, benchmark, size=10):
    windows = defaultdict(set)
    for item, text in benchmark:
        w = letter_words(text)
        if item is not None:
            for k in range(max(len(w) - size, 0) + 1 if w else 0):
                windows[tuple(w[k:k + size])].add(str(item))
    rows = []
    for doc_id, text in docs:
        w, hit, items = letter_words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[k:k + n]))) is not None:
                    hit.update(range(k, k + n))
                    items |= found
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        rows.append((doc_id, len(w), len(hit), len(items), digest, bool(hit)))
    return rows


def targets(sizes, weights, budget, most):
    """Shares by weight; what is above the cap is shared again."""
    open_, out = set(sizes), {}
    while open_:
        left = budget - sum(out.values())
        price = left / sum(weights[s] for s in open_)
        above = {s for s in open_ if price * weights[s] > most * sizes[s]}
        if not above:
            return out | {s: price * weights[s] for s in open_}
        out |= {s: float(most * sizes[s]) for s in above}
        open_ -= above
    return out


def mix(docs, weights=(3, 1, 2), share=1.5, most=2, seed="mix"):
    """Sorted rows ``(doc_id, size, source_size, target, taken)`` of ``(doc_id, text, source)``."""
    rows = [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for i, t, s in docs]
    sizes = defaultdict(int)
    for _, n, s in rows:
        sizes[s] += n
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    goal = targets(dict(sizes), {s: weights[k % len(weights)] for k, s in enumerate(order)}, share * sum(sizes.values()), most)
    out = []
    for s in order:
        own = [r for r in rows if r[2] == s]
        own.sort(key=lambda r: (hashlib.md5(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, r[1]))
        epochs, rest = divmod(int(goal[s] + 0.5), sizes[s]) if sizes[s] else (0, 0)
        before = 0
        for i, n, _ in own:
            out.append((i, n, sizes[s], goal[s], epochs * n + max(0, min(n, rest - before))))
            before += n
    return out
