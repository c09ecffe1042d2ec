"""Plain versions of the operators, straight from their contracts."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = "\x20\t\n\x0b\x0c\r"
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def low(text):
    return (text or "").translate(_LOW)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def exact_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    return {(i, max(groups[low(t)]), len(groups[low(t)]), i == max(groups[low(t)]), sha(low(t))) for i, t in rows}


def shingles(text, n):
    words = WORD.findall(low(text))
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def near_components(rows, n, num, den):
    sets = {i: shingles(t, n) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {(i, len(sets[i]), find(i)) for i in ids}


def line_key(line):
    return low(line.strip(SPACE))


def without_lines(rows, min_chars=20, min_docs=3, row=False):
    """By doc_id, or by row; rows without an id are one document that ranks below all others."""
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(line_key(line)) >= min_chars:
                holders[line_key(line)].add(i)
    largest = {k: max((x for x in v if x is not None), default=None) for k, v in holders.items()}
    out = {}
    for n, (i, t) in enumerate(rows):
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(line_key(x), ())) >= min_docs and i != largest[line_key(x)])]
        out[n if row else i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def without_repeats(rows, length=35):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    seen = Counter(tuple(w[p : p + length]) for _, w in words for p in range(len(w) - length + 1))
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - length + 1):
            if seen[tuple(w[p : p + length])] > 1:
                gone.update(range(p, p + length))
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def statistics(text):
    """The classifier's 13 statistics of a text, one after another."""
    raw, ws = text.encode(), [w.encode() for w in WORD.findall(low(text))]
    n, size = len(ws), max(len(raw), 1)
    count = lambda chars: sum(b in chars for b in raw)
    mean = sum(map(len, ws)) / max(n, 1)
    spread = math.sqrt(max(sum(len(w) ** 2 for w in ws) / max(n, 1) - mean * mean, 0))
    upper, lower = bytes(range(65, 91)), bytes(range(97, 123))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    runs = [tuple(ws[i : i + 4]) for i in range(n - 3)]
    return [
        math.log1p(n), math.log1p(mean), math.log1p(spread), math.sqrt(count(upper) / max(count(upper + lower), 1)), math.sqrt(count(b"0123456789") / size),
        math.sqrt(count(b"#*$%&|<>@^~_=+{}[]\\") / max(n, 1)), math.sqrt(count(b"!?") / max(n, 1)), math.sqrt(count(b".,;:") / max(n, 1)),
        math.sqrt(count(bytes(range(128, 256))) / size), math.log1p(len(set(ws))) / math.log1p(n) if n else 0.0,
        math.sqrt(1 - len(set(runs)) / len(runs)) if runs else 0.0, math.sqrt(1 - len(set(lines)) / len(lines)) if lines else 0.0, math.sqrt(count(b"\n") / max(n, 1)),
    ]


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    seen = Counter(tuple(words[p : p + 8]) for p in range(len(words) - 7))
    repeated = set()
    for p in range(len(words) - 7):
        if seen[tuple(words[p : p + 8])] > 1:
            repeated.update(range(p, p + 8))
    before, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in before
            before.add(line)
    failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(repeated), failed


def base_spans(text):
    text = text or ""
    found = []
    letters = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    kinds = "|".join(letters(w) for w in ("password", "passwd", "secret", "token")) + "|" + letters("api") + "_?" + letters("key")
    for m in re.finditer(rf"""({kinds})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end(), "assign"))
    for rank, (kind, pattern, least) in enumerate((("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24)), 1):
        found += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]


def targets(sizes: dict, share=1.5, ceiling=2):
    """sizes: words by source, None the last; fills sources by weight in rounds."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, total, out = set(order), share * sum(sizes.values()), {}
    while True:
        level = (total - sum(out.values())) / sum(weight[s] for s in left) if left else 0
        over = {s for s in left if weight[s] * level > ceiling * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in left}
        out |= {s: float(ceiling * sizes[s]) for s in over}
        left -= over
