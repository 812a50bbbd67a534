"""Plain versions of the text operators, for small inputs."""

import collections
import hashlib
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Null ids and texts, empty and blank texts, ties, repeats, periodic texts.
EDGE = [
    (1, None), (2, ""), (3, " \t\n\x0b"), (4, "a" * 1000), (5, "ab" * 400), (6, "x y z\t" * 300),
    (7, "x y z\t" * 300), (7, "x y z\t" * 300), (8, "é" * 150 + "b" * 20), (9, "q" + "é" * 150),
    (None, "ab" * 150), (None, " ".join(f"w{i}" for i in range(60))),
    (10, " ".join(f"w{i}" for i in range(2, 40))), (11, " ".join("k" for _ in range(30))),
    (12, "one"), (13, "One two"), (14, "one TWO"), (None, None), (15, "ab" * 150),
]


def key(row):
    return tuple((x is None, x) if x is not None else (True, 0) for x in row)


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def repeated_bytes(rows, length=200):
    where = collections.Counter()
    raws = [(i, (t or "").encode()) for i, t in rows]
    for _, r in raws:
        for p in range(len(r) - length + 1):
            where[r[p:p + length]] += 1
    out = []
    for i, r in raws:
        gone, end = bytearray(len(r)), 0
        for p in range(len(r) - length + 1):
            if where[r[p:p + length]] > 1:
                for q in range(max(p, end), p + length):
                    gone[q] = 1
                end = p + length
        spans = sum(1 for k in range(len(r)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(b for b, m in zip(r, gone) if not m)
        out.append((i, len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeated_words(rows, width=13):
    first, last = {}, float("inf")
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in texts:
        k = last if i is None else i
        for p in range(len(w) - width + 1):
            x = tuple(w[p:p + width])
            first[x] = min(first.get(x, last), k)
    out = []
    for i, w in texts:
        k = last if i is None else i
        gone = [0] * len(w)
        for p in range(len(w) - width + 1):
            if first[tuple(w[p:p + width])] < k:
                gone[p:p + width] = [1] * width
        kept = b" ".join(x for x, m in zip(w, gone) if not m)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def fingerprint(text, size=3):
    w = (text or "").translate(LOWER).encode().split()
    grams = [b" ".join(w[k:k + size]) for k in range(len(w) - size + 1)] if len(w) >= size else \
        ([b" ".join(w)] if w else [])
    count = [0] * 64
    for s in grams:
        h = xxhash.xxh64_intdigest(s, seed=42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * count[b] > len(grams))


def near_groups(rows, distance=3):
    prints = [fingerprint(t) for _, t in rows]
    distinct = sorted(set(prints))
    parent = {f: f for f in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(distinct)):
        for b in range(a + 1, len(distinct)):
            if (distinct[a] ^ distinct[b]).bit_count() <= distance:
                parent[find(distinct[a])] = find(distinct[b])
    least = {}
    for (i, _), f in zip(rows, prints):
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return [(i, f"{f:016x}", least.get(find(f))) for (i, _), f in zip(rows, prints)]


def base_counts(rows):
    out = []
    for i, t in rows:
        t = t or ""
        w = WORD.findall(t)
        n = len(w)
        seen = collections.Counter(tuple(w[k:k + 3]) for k in range(n - 2))
        marked = [0] * n
        for k in range(n - 2):
            if seen[tuple(w[k:k + 3])] > 1:
                marked[k:k + 3] = [1] * 3
        lines = [x for x in t.split("\n") if WORD.search(x)]
        out.append((i, n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)),
                    sum(marked), n < 50 or 100 * sum(marked) > 50 * n))
    return out


_ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    found = [(m.start(), 0, m.end(), m.group(2)) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    found += [(m.start(), 1, m.end(), m.group()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    found += [(m.start(), 2, m.end(), m.group()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(found)


def base_secrets(rows):
    out = []
    for i, t in rows:
        found = base_spans(t or "")
        s = ",".join(f"{['assign', 'access', 'hex'][k]}:{a}:{e}" for a, k, e, _ in found)
        out.append((i, *[sum(x[1] == k for x in found) for k in range(3)], hashlib.sha256(s.encode()).hexdigest()))
    return out


def substring_distance(item, text):
    prev = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        cur = [i] + [0] * len(text)
        for j, b in enumerate(text, 1):
            cur[j] = min(prev[j - 1] + (a != b), prev[j] + 1, cur[j - 1] + 1)
        prev = cur
    return min(prev)


def levenshtein(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j - 1] + (x != y), prev[j] + 1, cur[-1] + 1))
        prev = cur
    return prev[-1]
