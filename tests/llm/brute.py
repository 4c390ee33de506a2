"""Plain versions of the operators, one document at a time."""

import hashlib
import re
import zlib

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LETTERED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def jump(key, shards):
    key, b, j = key % (1 << 64), -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def contamination(docs, items, window=13):
    """doc row -> (n_words, n_hit, sorted item ids)."""
    grams = {}
    for item, text in items:
        words = LETTERED.findall((text or "").translate(LOWER))
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            grams.setdefault(n, {}).setdefault(tuple(words[i:i + n]), set()).add(item)
    out = []
    for text in docs:
        words = LETTERED.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n, known in grams.items():
            for i in range(len(words) - n + 1):
                if (own := known.get(tuple(words[i:i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= own
        out.append((len(words), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


def shingles(text, size=5):
    words = SPACED.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1)))


def components(docs, share=80, size=5):
    """doc_id -> (set size, smallest linked doc_id); rows are (doc_id, text)."""
    sets = [(d, shingles(t, size)) for d, t in docs]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= share * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i))) for i, (d, s) in enumerate(sets)]


def repeats(docs, window=50):
    """(doc_id, text) -> (doc_id, n_words, n_removed, kept text)."""
    first, split = {}, [(d, SPACED.findall(t or "")) for d, t in docs]
    for d, words in split:
        if d is not None:
            for i in range(len(words) - window + 1):
                k = tuple(words[i:i + window])
                first[k] = min(d, first.get(k, d))
    out = []
    for d, words in split:
        gone = set()
        for i in range(len(words) - window + 1):
            if d is not None and first[tuple(words[i:i + window])] < d:
                gone.update(range(i, i + window))
        out.append((d, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


def crc(text):
    return zlib.crc32(text.encode())
