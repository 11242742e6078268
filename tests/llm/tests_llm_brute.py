"""Brute-force versions that the tests share."""

import hashlib
import re
from collections import defaultdict

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def lines(text):
    return [x for x in re.split(r"(?<=\n)|(?<=[.!?,;:] )", text or "") if x]


def bare(line):
    return line.strip(" ")


def cut(text):
    """Lines of a text, without white space at the ends, and its chunks of two lines or more, as (start, end)."""
    b = [bare(x) for x in lines(text)]
    m = [hashlib.md5(x.encode()).hexdigest() for x in b]
    ends = [i + 1 for i in range(len(m)) if i + 1 == len(m) or m[i] < m[i + 1]]
    return b, [(s, e) for s, e in zip([0, *ends], ends, strict=False) if e - s > 1]


def dedup_brute(docs, min_words=25, reach=3, own=None):
    """doc (id, text) -> cleaned text. own: gets the documents that repeat a chunk of their own."""
    distinct = sorted(set((d[0], d[1]) for d in docs), key=lambda d: (d[0] is None, d[0] or 0))
    first, made, out = {}, {d: cut(d[1]) for d in distinct}, {}
    for d in distinct:
        b, chunks = made[d]
        for s, e in chunks:
            first.setdefault(tuple(b[s:e]), (d, s))
    for d in distinct:
        b, chunks = made[d]
        later = [(s, e, *first[tuple(b[s:e])]) for s, e in chunks if first[tuple(b[s:e])] != (d, s)]
        if own is not None and any(fd == d for *_, fd, _ in later):
            own.add(d)
        gone = set()
        for k, (s, e, fd, fs) in enumerate(later):
            fb, fe = made[fd][0], fs + e - s
            low, high = later[k - 1][1] if k else 0, later[k + 1][0] if k + 1 < len(later) else len(b)
            gone |= set(range(s, e))
            for j in range(1, reach + 1):
                if s - j < low or fs - j < 0 or b[s - j] != fb[fs - j]:
                    break
                gone.add(s - j)
            for j in range(reach):
                if e + j >= high or fe + j >= len(fb) or b[e + j] != fb[fe + j]:
                    break
                gone.add(e + j)
        text, kept, i = lines(d[1]), [], 0
        while i < len(text):
            j = i
            while j in gone:
                j += 1
            if j == i or len(words("".join(text[i:j]))) < min_words:
                j = max(j, i + 1)
                kept += text[i:j]
            i = j
        out[d] = None if d[1] is None else "".join(kept)
    return out


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def groups_brute(docs):
    """(id, text) -> component id."""
    distinct = list(dict.fromkeys((d[0], d[1]) for d in docs))
    sets = [shingle_set(t) for _, t in distinct]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for k, d in enumerate(distinct):
        least[find(k)].append(d[0])
    return {d: min((x for x in least[find(k)] if x is not None), default=None) for k, d in enumerate(distinct)}, {d: len(sets[k]) for k, d in enumerate(distinct)}


def fill(sizes, weights, budget):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = {}, budget * sum(sizes.values()), set(order)
    while open_:
        over = {s for s in open_ if left * w[s] / sum(w[x] for x in open_) >= 2 * sizes[s]}
        if not over:
            return target | {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target
