"""Plain-Python models that the operators are compared with."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from hashlib import md5, sha256

from linewright.llm.shingles import shingle_set


def repeats(texts: dict, length: int) -> dict:
    """``id -> (n_bytes, n_removed, n_spans, sha256)`` by looking at every string."""
    bodies = {k: (t or "").encode() for k, t in texts.items()}
    seen = Counter(b[p : p + length] for b in bodies.values() for p in range(len(b) - length + 1))
    out = {}
    for key, b in bodies.items():
        spans: list[list[int]] = []
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                if spans and p <= spans[-1][1]:
                    spans[-1][1] = p + length
                else:
                    spans.append([p, p + length])
        edges = [0, *[x for s in spans for x in s], len(b)]
        kept = b"".join(b[x:y] for x, y in zip(edges[::2], edges[1::2]))
        out[key] = (len(b), len(b) - len(kept), len(spans), sha256(kept).hexdigest())
    return out


def similar_classes(texts: dict, threshold: float = 0.8):
    """``id -> (class, links)`` from all pairs that share a shingle."""
    sets = {k: shingle_set(t) for k, t in texts.items()}
    where = defaultdict(list)
    for k, s in sets.items():
        for x in s.tolist():
            where[x].append(k)
    common: Counter = Counter()
    for keys in where.values():
        for i, a in enumerate(keys):
            for b in keys[:i]:
                common[a, b] += 1
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links: Counter = Counter()
    for (a, b), c in common.items():
        if c >= threshold * (len(sets[a]) + len(sets[b]) - c) - 1e-9:
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: (find(k), links[k]) for k in texts}


def words(text) -> list[str]:
    return re.findall(r"\w+", (text or "").lower())


def _runs(w: list[str], k: int) -> list[tuple]:
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]


def leaks(texts: dict, items: dict, threshold: float = 0.8) -> dict:
    """``id -> {item: best similarity}`` over every item-sized window."""
    bags = {}
    for item, text in items.items():
        w = words(text)
        if w:
            k = min(5, len(w))
            bags[item] = (k, len(w) - k + 1, Counter(_runs(w, k)))
    out = {}
    for key, text in texts.items():
        w = words(text)
        best: dict = {}
        for item, (k, n, bag) in bags.items():
            s = _runs(w, k)
            if not bag.keys() & set(s):
                continue
            for p in range(len(s)):
                window = Counter(s[p : p + n])
                common = sum((window & bag).values())
                sim = common / (sum(window.values()) + n - common)
                if sim >= threshold - 1e-9:
                    best[item] = max(best.get(item, 0.0), sim)
        out[key] = best
    return out


def mix(rows: list[tuple], weights=(1, 2, 3), most=3.0, seed=17) -> list[int]:
    """Copies of each ``(doc_id, source, size)`` row; larger documents are drawn more readily."""
    sizes: dict = defaultdict(int)
    for _, source, size in rows:
        sizes[source] += size
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    open_, total, target = set(order), float(sum(sizes.values())), {}
    while open_:
        left = total - sum(target.values())
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] >= most * sizes[s] - 1e-9 * max(1, most * sizes[s])}
        if not over:
            target |= {s: unit * weight[s] for s in open_}
            break
        target |= {s: most * sizes[s] for s in over}
        open_ -= over
    copies = [0] * len(rows)
    for source in order:
        mine = [i for i, r in enumerate(rows) if r[1] == source]
        rate = target[source] / sizes[source] if sizes[source] else 0.0
        whole = int(rate + 1e-12)
        gap = int(target[source] - whole * sizes[source] + 1e-6)
        p = rate - whole
        mean = sum(rows[i][2] * len(f"{rows[i][2]:b}") for i in mine) / max(1, sizes[source])

        def q(i):
            doc_id, _, size = rows[i]
            digest = md5(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
            u = (int(digest[:13], 16) + 0.5) / (1 << 52)
            chance = min(0.95, p * len(f"{size:b}") / mean)
            return (u / (1 - u)) / (chance / (1 - chance)), doc_id is None, doc_id or 0, size

        for i in mine:
            copies[i] = whole
        if p <= 1e-12:
            continue
        left, stopped = [], False
        for i in sorted(mine, key=q):
            size = rows[i][2]
            # Up to the first document that overshoots, those without words count as taken too.
            stopped = stopped or size > gap
            if size <= gap and (size or not stopped):
                copies[i] += 1
                gap -= size
            elif size:
                left.append(i)
        last = min(left, key=lambda i: (rows[i][2], q(i)), default=None)
        if last is not None and rows[last][2] < 2 * gap:
            copies[last] += 1
    return copies
