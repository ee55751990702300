"""Plain Python versions of the operators, straight from their contracts."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def shingles(text, n):
    w = BLANK_WORDS.findall((text or "").translate(LOW))
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}


def ngram_classes(rows, n, percent):
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if i is not None and j is not None and both and 100 * both >= percent * (len(a) + len(b) - both):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return Counter((i, len(s), None if i is None else find(i)) for i, s in sets)


def decontaminate(rows, items):
    split = lambda t: ALNUM_WORDS.findall((t or "").translate(LOW))
    windows = defaultdict(set)
    for item, text in items:
        w = split(text)
        size = min(13, len(w))
        for k in range(len(w) - size + 1) if w else ():
            windows[tuple(w[k : k + size])].add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for i, text in rows:
        w = split(text)
        hit, names = set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if found := windows.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    names |= found
        out.append((i, len(w), len(hit), len(names), sha(",".join(sorted(names))), bool(hit) and 20 * len(hit) >= len(w)))
    return Counter(out)


def suffix_dedup(rows, size=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - size + 1):
            s = b[k : k + size]
            if s not in first or first[s] > i:
                first[s] = i
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if first[b[k : k + size]] < i:
                gone[k : k + size] = b"\1" * size
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, sha(kept)))
    return Counter(out)


def quality(rows):
    out = []
    for i, t in rows:
        t = t or ""
        w = BLANK_WORDS.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if BLANK_WORDS.search(line):
                dup += line in seen
                seen.add(line)
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        repeated = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(repeated), failed))
    return Counter(out)


def pii(rows):
    kinds = ("email", "ip", "card", "phone")
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")

    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(d))) % 10 == 0

    def fine(kind, s):
        d = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            return 14 <= len(d) <= 19 and luhn(d)
        return kind != "phone" or 10 <= len(d) <= 15

    out = {}
    for i, t in rows:
        spans = [(m.start(), k, m.end()) for k, (kind, p) in enumerate(zip(kinds, patterns, strict=True)) for m in re.finditer(p, t or "") if fine(kind, m[0])]
        spans.sort()
        counts = Counter(k for _, k, _ in spans)
        said = [f"{kinds[k]}:{s}:{e}" for s, k, e in spans]
        out[i] = (*(counts[k] for k in range(4)), sha(",".join(said)), set(said))
    return out


def crc(text):
    return zlib.crc32((text or "").encode())
