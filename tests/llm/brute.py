"""Plain versions of the query contracts, row by row, for small tables."""

import collections
import hashlib
import itertools
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = WORD.findall((text or "").translate(ASCII_LOWER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def ngram_join(rows):
    sets = {d: shingles(t) for d, t in rows}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = collections.defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    for a, b in {p for ds in holders.values() for p in itertools.combinations(ds, 2)}:
        shared = len(sets[a] & sets[b])
        if 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {(d, len(s), find(d)) for d, s in sets.items()}


def quality(rows):
    out = set()
    for d, t in rows:
        t = t or ""
        words = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        grams = list(zip(words, words[1:], words[2:]))
        times = collections.Counter(grams)
        again = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)}
        failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
        out.add((d, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), failed))
    return out


def dedup(rows, window, units):
    """Per document its units and which of them go."""
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        u = units((t or "").encode())
        gone = [False] * len(u)
        for s in range(len(u) - window + 1):
            key = tuple(u[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        out[d] = (u, gone)
    return out


def suffix_dedup(rows, window=100):
    out = set()
    for d, (u, gone) in dedup(rows, window, bytes).items():
        kept = bytes(c for c, g in zip(u, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.add((d, len(u), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def phrase_dedup(rows, window=20):
    out = set()
    for d, (u, gone) in dedup(rows, window, bytes.split).items():
        kept = b" ".join(w for w, g in zip(u, gone) if not g)
        out.add((d, len(u), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def licenses(rows):
    out = set()
    for d, t in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII_LOWER))
        found = []
        for phrase, label in PHRASES.items():
            p = phrase.split()
            found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
        at = [i for i, _ in found]
        out.add((d, len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def personal(rows):
    out = {}
    for d, t in rows:
        spans, counts = [], []
        for kind, pattern in KINDS.items():
            found = []
            for m in re.finditer(pattern, t or ""):
                digits = re.sub("[^0-9]", "", m[0])
                good = {
                    "email": True,
                    "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                    "card": 16 <= len(digits) <= 19 and luhn(digits),
                    "phone": 8 <= len(digits) <= 15,
                }[kind]
                if good:
                    found.append(f"{kind}:{m.start()}:{m.end()}")
            spans += found
            counts.append(len(found))
        out[d] = (*counts, spans)
    return out
