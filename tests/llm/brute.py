"""Plain, slow versions of the operators for small inputs."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text: str | None, lower: bool = False) -> list[bytes]:
    raw = (text or "").encode()
    if lower:
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    return WORD.findall(raw)


def discount(n: dict[int, int]):
    def d(r):
        if r > 5:
            return 0.999
        x = -1.0
        if n.get(1) and n.get(r):
            tail = 6 * n.get(6, 0) / n[1]
            if tail < 1:
                x = ((r + 1) * n.get(r + 1, 0) / (r * n[r]) - tail) / (1 - tail)
        return x if 0 < x < 1 else (r - 0.5) / r
    return d


def katz(rows: list[tuple[int, str | None]], held=lambda i: zlib.crc32(str(i).encode()) % 7 == 2):
    """Scores per id and the conditional distribution."""
    sent = {i: [*words(t, True), "</s>"] for i, t in rows}
    uni, bi, start = Counter(), Counter(), 0
    for i, s in sent.items():
        if not held(i):
            start += 1
            uni.update(s)
            bi.update(zip(["<s>", *s[:-1]], s, strict=True))
    total, d1, d2 = sum(uni.values()), discount(Counter(uni.values())), discount(Counter(bi.values()))
    known = {w: d1(c) * c / total for w, c in uni.items()}
    unknown = 1 - sum(known.values())
    follow = defaultdict(dict)
    for (a, b), r in bi.items():
        follow[a][b] = r
    sums = {a: sum(f.values()) for a, f in follow.items()}
    alpha = {a: (1 - sum(d2(r) * r / sums[a] for r in f.values())) / (1 - sum(known[b] for b in f)) for a, f in follow.items()}

    def p(b, a):
        if b in follow.get(a, ()):
            r = follow[a][b]
            return d2(r) * r / sums[a]
        return alpha.get(a, 1.0) * known.get(b, unknown)

    out = {}
    for i, s in sent.items():
        out[i] = (held(i), len(s), sum(w in uni for w in s), total, sum(math.log10((uni[w] + 1) / (total + len(uni) + 1)) for w in s),
                  sum(math.log10(p(b, a)) for a, b in zip(["<s>", *s[:-1]], s, strict=True)))
    return out, p, uni, follow


def repeated_words(rows, window):
    """Per id: words, removed flags; later places of a window are removed."""
    sent, first = {i: words(t) for i, t in rows}, {}
    order = sorted(sent, key=lambda i: -(1 << 63) if i is None else i)
    gone = {i: [False] * len(s) for i, s in sent.items()}
    for i in order:
        s = sent[i]
        for j in range(len(s) - window + 1):
            key = tuple(s[j : j + window])
            if key in first:
                gone[i][j : j + window] = [True] * window
            else:
                first[key] = (i, j)
    return sent, gone


def repeated_bytes(rows, length):
    raw = {i: (t or "").encode() for i, t in rows}
    seen = Counter(r[j : j + length] for r in raw.values() for j in range(len(r) - length + 1))
    gone = {}
    for i, r in raw.items():
        flags = [False] * len(r)
        for j in range(len(r) - length + 1):
            if seen[r[j : j + length]] > 1:
                flags[j : j + length] = [True] * length
        gone[i] = flags
    return raw, gone


def components(ids, links):
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def shingles(text, size):
    s = words(text, True)
    return {tuple(s[j : j + size]) for j in range(len(s) - size + 1)} if len(s) >= size else ({tuple(s)} if s else set())


def near(rows, size, percent):
    sets = {i: shingles(t, size) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :]
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, components(ids, links)
