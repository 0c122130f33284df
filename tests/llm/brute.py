"""Brute-force forms of the operators' results, which the tests compare with."""

import base64
import hashlib
import re
from collections import defaultdict

import numpy as np
import xxhash

from kestrel.llm import linededup, repeats


def table(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def brute_edits(passage, text):
    """Fewest edits from the passage to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(passage, 1):
        last, row = row, [i] + [0] * len(text)
        for j, d in enumerate(text, 1):
            row[j] = min(last[j - 1] + (c != d), last[j] + 1, row[j - 1] + 1)
    return min(row)


def brute_warc(rows):
    first = {}
    for i, page in rows:
        if i is not None:
            first[page or ""] = min(i, first.get(page or "", i))
    out = []
    for i, page in rows:
        data = (page or "").encode()
        refers = first.get(page or "")
        later = i is not None and i > refers
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if later else "response", refers if later else None))
    return out


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row = row, [i] + [0] * len(b)
        for j, d in enumerate(b, 1):
            row[j] = min(last[j - 1] + (c != d), last[j] + 1, row[j - 1] + 1)
    return row[-1]


def brute_lines(rows):
    """The numbers of the lines that go, by row."""
    seen = []
    place = lambda i, n: (linededup.LAST if i is None else i, n, i is None)
    first: dict = {}
    for i, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            if line.strip(" "):
                first[line] = min(first.get(line, place(i, n)), place(i, n))
    seen = sorted(first, key=lambda x: (first[x], x))
    near = set()
    for k, x in enumerate(seen):
        for y in seen[:k]:
            most = min(linededup.K, min(len(x), len(y)) // linededup.EVERY)
            if most and abs(len(x) - len(y)) <= most and edits(x, y) <= most:
                near.add(x)
                break
    out = []
    for i, t in rows:
        exact, close = [], []
        lines = (t or "").split("\n")
        for n, line in enumerate(lines):
            if line.strip(" "):
                if first[line] != place(i, n):
                    exact.append(n)
                elif line in near:
                    close.append(n)
        out.append((i, sum(bool(x.strip(" ")) for x in lines), exact, close, len(exact) + len(close)))
    return out


def brute_fingerprint(text, words):
    tokens = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]
    if not tokens:
        return 0
    shingles = [" ".join(tokens[k : k + words]) for k in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, words):
    prints = [brute_fingerprint(t or "", words) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, f"{p:016x}", least.get(find(k))) for k, ((i, _), p) in enumerate(zip(rows, prints))]


def shingles(text, words=5):
    tokens = text.lower().split()
    return {" ".join(tokens[k : k + words]) for k in range(max(1, len(tokens) - words + 1))} if tokens else set()


def exact_similar(rows):
    """The exact components (least id) of the pairs at a similarity of 0.8, of the texts that share
    a shingle which at most 500 have."""
    sets, holders = {i: shingles(t) for i, t in rows}, defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, s in sets.items():
        for j in {j for x in s if len(holders[x]) <= 500 for j in holders[x] if j < i}:
            if 9 * len(s & sets[j]) >= 4 * (len(s) + len(sets[j])):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {i: find(i) for i in sets}


def brute_repeats(rows):
    docs = [(repeats.LAST if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, data in docs:
        for k in range(len(data) - 49):
            first[data[k : k + 50]] = min(i, first.get(data[k : k + 50], i))
    out = []
    for (i, _), (key, data) in zip(rows, docs):
        gone = [False] * len(data)
        for k in range(len(data) - 49):
            if first[data[k : k + 50]] < key:
                gone[k : k + 50] = [True] * 50
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def plain_edits(passage, text):
    """brute_edits() with a row of the table at a time."""
    letters, places = np.array([ord(c) for c in text]), np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, int)
    for i, c in enumerate(passage, 1):
        new = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (letters != ord(c)))])
        row = np.minimum.accumulate(new - places) + places
    return int(row.min())
