"""Plain Python versions of the operators' definitions."""

import hashlib
import re
from collections import defaultdict

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\n\x0b\x0c\r"


def exact(docs):
    groups = defaultdict(list)
    for i, text in docs:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), i))
    out = {}
    for norm, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            out[i] = (keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest())
    return out


def line_dedup(docs):
    first = {}
    keyed = {}
    for i, text in sorted(docs):
        lines = (text or "").split("\n")
        keyed[i] = [(line, line.strip(SPACE).translate(ASCII)) for line in lines]
        for _, key in keyed[i]:
            first.setdefault(key, i)
    return {i: "\n".join(line for line, key in lines if len(key) < 10 or first[key] == i) for i, lines in keyed.items()}


def near(docs, percent=75):
    sets = {}
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def decontaminate(docs, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").translate(ASCII))
    grams = defaultdict(set)
    for i, text in items:
        w = split(text)
        t = min(len(w), window)
        for k in range(len(w) - t + 1 if t else 0):
            grams[tuple(w[k : k + t])].add(str(i))
    out = {}
    for i, text in docs:
        w = split(text)
        hit, found = set(), set()
        for t in {len(g) for g in grams}:
            for k in range(len(w) - t + 1):
                of = grams.get(tuple(w[k : k + t]))
                if of:
                    hit |= set(range(k, k + t))
                    found |= of
        out[i] = (len(w), len(hit), sorted(found))
    return out
