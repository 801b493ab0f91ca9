"""Plain versions of the dedup operators."""

import collections
import hashlib

import numpy as np


def shingles(text, width):
    w = [x.decode() for x in (text or "").encode().lower().split()]
    if len(w) >= width:
        return frozenset(zip(*[w[k:] for k in range(width)]))
    return frozenset([tuple(w)]) if w else frozenset()


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_duplicates(texts, width, percent):
    """doc_id → (set size, component) of {doc_id: text}."""
    sets = {i: shingles(t, width) for i, t in texts.items()}
    post, links = collections.defaultdict(list), []
    for i, s in sets.items():
        common = collections.Counter(j for g in s for j in post[g])
        links += [(i, j) for j, n in common.items() if 100 * n >= percent * (len(s) + len(sets[j]) - n)]
        for g in s:
            post[g].append(i)
    comp = components(sets, links)
    return {i: (len(sets[i]), comp[i]) for i in sets}


def cut_repeats(rows, length=200):
    """[(doc_id, text)] → [(doc_id, n_bytes, n_removed, n_spans, sha256, bytes left)]."""
    seen, multi, out = set(), set(), []
    for _, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            x = b[p:p + length]
            (multi if x in seen else seen).add(x)
    for i, t in rows:
        b = (t or "").encode()
        covered = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if b[p:p + length] in multi:
                covered[p:p + length] = True
        left = bytes(c for c, gone in zip(b, covered) if not gone)
        spans = int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum())
        out.append((i, len(b), int(covered.sum()), spans, hashlib.sha256(left).hexdigest(), left))
    return out


def near_vectors(rows, min_cosine=0.93):
    """vec_id → (links, component) of [(vec_id, embedding, label)]."""
    good = [(i, np.asarray(e, float), lab) for i, e, lab in rows
            if i is not None and lab is not None and e is not None and len(e) and None not in e
            and np.isfinite(np.asarray(e, float)).all() and np.asarray(e, float).any()]
    count, links = collections.Counter(), []
    groups = collections.defaultdict(list)
    for i, e, lab in good:
        groups[(lab, len(e))].append((i, e / np.linalg.norm(e)))
    for g in groups.values():
        m = np.stack([u for _, u in g])
        hit = m @ m.T >= min_cosine
        np.fill_diagonal(hit, False)
        for a in range(len(g)):
            count[g[a][0]] += int(hit[a].sum())
            links += [(g[a][0], g[b][0]) for b in np.flatnonzero(hit[a])]
    comp = components([i for i, _, _ in rows], links)
    return {i: (count[i], comp[i]) for i, _, _ in rows}
