"""Plain, slow versions of the operators' contracts, on Python objects."""

from __future__ import annotations

import hashlib
import re
import zlib

_LOWER = {c: c + 32 for c in range(65, 91)}


def lower(text: str | None) -> str:
    return (text or "").translate(_LOWER)


def words(text: str | None) -> list[str]:
    return re.findall("[^\x20\x09-\x0d]+", lower(text))


def repeats(texts: list[str | None], width: int) -> list[tuple]:
    """(n_bytes, n_removed, n_spans, sha256 of the rest) of each text."""
    data = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for d in data:
        for i in range(len(d) - width + 1):
            seen[d[i : i + width]] = seen.get(d[i : i + width], 0) + 1
    out = []
    for d in data:
        hit = bytearray(len(d))
        for i in range(len(d) - width + 1):
            if seen[d[i : i + width]] > 1:
                hit[i : i + width] = b"\x01" * width
        spans = sum(1 for i in range(len(d)) if hit[i] and (i == 0 or not hit[i - 1]))
        kept = bytes(b for b, h in zip(d, hit, strict=True) if not h)
        out.append((len(d), sum(hit), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text: str | None, size: int) -> set[tuple]:
    w = words(text)
    if not w:
        return set()
    return {tuple(w)} if len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def near_groups(docs: list[tuple[int, str | None]], size: int, percent: int) -> dict[int, tuple[int, int]]:
    """doc_id -> (n_shingles, component_id)."""
    sets = {d: shingles(t, size) for d, t in docs}
    group = {d: d for d in sets}

    def top(d):
        while group[d] != d:
            d = group[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                group[y] = x
    return {d: (len(sets[d]), top(d)) for d in ids}


def hits(docs: list[str | None], items: list[tuple[int, str | None]], window: int) -> list[tuple]:
    """(n_words, n_hit, n_items, items_sha256, longest match, its start) of each document."""
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
    wanted: dict[tuple, set] = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            wanted.setdefault(tuple(w[k : k + window]), set()).add(None if i is None else str(i))
    sizes = {len(x) for x in wanted}
    out = []
    for t in docs:
        w, found = split(t), set()
        hit = [False] * len(w)
        for n in sizes:
            for k in range(len(w) - n + 1):
                if own := wanted.get(tuple(w[k : k + n])):
                    found |= own
                    hit[k : k + n] = [True] * n
        found.discard(None)
        best = (0, None)
        for _, item in items:
            v = split(item)
            for p in range(len(w)):
                for q in range(len(v)):
                    n = 0
                    while p + n < len(w) and q + n < len(v) and w[p + n] == v[q + n]:
                        n += 1
                    if n >= min(window, len(v)) and (n, -p) > (best[0], -(best[1] or 0)):
                        best = (n, p)
        out.append((len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), *best))
    return out


def base_scores(docs: list[tuple[int, str | None]], learn) -> dict[int, tuple]:
    """doc_id -> (n_tokens, n_known, base_score), and under None the number of training tokens."""
    import math

    count: dict[str, int] = {}
    for d, t in docs:
        if learn(d):
            for w in [*words(t), "\n"]:
                count[w] = count.get(w, 0) + 1
    total, distinct = sum(count.values()), len(count)
    out = {None: total}
    for d, t in docs:
        own = [count.get(w, 0) for w in [*words(t), "\n"]]
        out[d] = (len(own), sum(n > 0 for n in own), sum(math.log10((n + 1) / (total + distinct + 1)) for n in own))
    return out


def crc(value) -> int:
    return zlib.crc32(str(value).encode())


def followed(tokens: dict[int, list], learn, is_anchor, width: int, most: int) -> dict[int, list[tuple[set, int]]]:
    """For every token of every document: what the training documents' passages predict (each of the longest continuations), and
    how many predictions in a row came before it (-1: the last one did not come, -2: there was no prediction)."""
    known: dict[tuple, list[tuple]] = {}
    anchors = {d: [i for i in range(width, len(t)) if is_anchor(t[i - width : i])] for d, t in tokens.items()}
    for d, t in tokens.items():
        for i, end in zip(anchors[d], [*anchors[d][1:], len(t)], strict=False):
            if learn(d):
                known.setdefault(tuple(t[i - width : i]), []).append(tuple(t[i : min(end, i + most)]))
    out: dict[int, list[tuple[set, int]]] = {}
    for d, t in tokens.items():
        source, run, out[d] = None, -2, []
        for i, token in enumerate(t):
            if i in anchors[d]:
                found = known.get(tuple(t[i - width : i]), [])
                if len(found) > learn(d):
                    longest = max(map(len, found))
                    source = (i, [x for x in found if len(x) == longest], longest)
            at = i - source[0] if source else 0
            options = {x[at] for x in source[1]} if source and at < source[2] else set()
            out[d].append((options, run))
            run = -2 if not options else max(run, 0) + 1 if token in options else -1
    return out
