"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
from collections import Counter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def alnum(text):
    return ALNUM.findall((text or "").translate(LOWER))


def drop_lines(texts, least=10):
    split = [(t or "").split("\n") for t in texts]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    found = Counter(k for lines in split for k in {key(x) for x in lines} if k)
    gone = {k for k, n in found.items() if n >= least}
    kept = [[x for x in lines if key(x) not in gone] for lines in split]
    return [("\n".join(k), len(lines), len(lines) - len(k)) for k, lines in zip(kept, split)]


def shingles(text, n):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def components(rows, n, num, den):
    """rows: (doc_id, text); doc_id -> smallest reachable."""
    sets = [(i, shingles(t, n)) for i, t in rows if i is not None]
    label = {i: i for i, _ in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and den * len(s & t) >= num * len(s | t):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return {i: root(i) for i in label}


def windows(text, size=8):
    w = alnum(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def leaks(text, items):
    """(words, hit words, ids found) of a document."""
    w = alnum(text)
    hit, found = set(), set()
    for i, t in items:
        for x in windows(t):
            for p in range(len(w) - len(x) + 1):
                if tuple(w[p : p + len(x)]) == x:
                    hit |= set(range(p, p + len(x)))
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


def remove_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(r), sum(gone), spans, bytes(b for b, g in zip(r, gone) if not g)))
    return out


def entropy(s):
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()
