"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


def shingles(text, k):
    w = words(text, lower=True)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def components(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_components(docs, k, percent):
    sets = {i: shingles(t, k) for i, t in docs}
    ids = sorted(sets)
    linked = []
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                linked.append((a, b))
    return {i: (len(sets[i]), c) for i, c in components(ids, linked).items()}


def dedup_substrings(docs, window):
    first = {}
    for i, t in sorted(docs):
        w = words(t)
        for j in range(len(w) - window + 1):
            first.setdefault(tuple(w[j : j + window]), i)
    out = {}
    for i, t in docs:
        w = words(t)
        gone = set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone.update(range(j, j + window))
        out[i] = (" ".join(x for j, x in enumerate(w) if j not in gone), len(w), len(gone))
    return out


def dedup_lines(docs, min_chars, min_docs):
    blanks = " \t\n\x0b\x0c\r"
    key = lambda line: line.strip(blanks).translate(LOWER)
    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    common = {k: max(h) for k, h in holders.items() if len(h) >= min_docs}
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if common.get(key(x), i) == i]
        out[i] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def kneser_ney(tokens, order, alphabet):
    """p(context, symbol) of an interpolated Kneser-Ney model of padded words; also its grams (context, symbol) by order."""
    seen, before = [defaultdict(Counter) for _ in range(order)], [defaultdict(set) for _ in range(order)]
    for w in tokens:
        s = f"\n{w}\n"
        for i in range(1, len(s)):
            for k in range(min(order, i + 1)):
                seen[k][s[i - k : i]][s[i]] += 1
                if i > k:
                    before[k][s[i - k : i + 1]].add(s[i - k - 1])
    for k in range(order - 1):
        for context, symbols in seen[k].items():
            for x in symbols:
                if not (k and context[0] == "\n"):
                    symbols[x] = len(before[k][context + x])
    discount = []
    for k in range(order):
        counts = [c for symbols in seen[k].values() for c in symbols.values()]
        once, twice = counts.count(1), counts.count(2)
        discount.append(once / (once + 2 * twice) if once and twice else 0.5)

    def p(context, symbol):
        k = len(context)
        lower = p(context[1:], symbol) if k else 1 / alphabet
        symbols = seen[k].get(context)
        if not symbols:
            return lower
        total = sum(symbols.values())
        return (max(symbols[symbol] - discount[k], 0) + discount[k] * len(symbols) * lower) / total

    return p, [[(c, x) for c, symbols in by.items() for x in symbols] for by in seen]


def sha256(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()
