"""Plain versions of the operators, for small fixtures."""

import hashlib
import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


def repeats(rows, length=20):
    """{doc_id: (n_words, n_removed, kept)}"""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        w = words(text)
        gone = [False] * len(w)
        for a in range(len(w) - length + 1):
            key = tuple(w[a : a + length])
            if key in seen:
                gone[a : a + length] = [True] * length
            seen.add(key)
        out[doc] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


def shingles(text, size):
    w = [x.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))) for x in words(text)]
    n = min(size, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def groups(rows, size=2, percent=80):
    """{doc_id: smallest doc_id reachable}"""
    sets = {d: shingles(t, size) for d, t in rows}
    ids, root = sorted(sets), {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and find(a) != find(b) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {d: find(d) for d in ids}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def overlaps(text, item, window=13, least=11):
    """Whether a window of words of the text agrees with the item in enough places, word runs lower-cased in A-Z."""
    split = lambda t: [x.lower() for x in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").encode())]
    a, b = split(text), split(item)
    if not b:
        return False
    if len(b) < window:
        return any(a[i : i + len(b)] == b for i in range(len(a) - len(b) + 1))
    for shift in range(window - len(b), len(a) - window + 1):
        same = [x == y for x, y in zip(a[max(0, shift) :], b[max(0, -shift) :])]
        total = sum(same[:window])
        if len(same) >= window and total >= least:
            return True
        for i in range(window, len(same)):
            total += same[i] - same[i - window]
            if total >= least:
                return True
    return False


def auc(scores, labels):
    pairs = sorted(zip(scores, labels))
    rank, total, i = 0.0, 0, 0
    while i < len(pairs):
        j = i
        while j < len(pairs) and pairs[j][0] == pairs[i][0]:
            j += 1
        hits = sum(p[1] for p in pairs[i:j])
        rank += hits * (i + j + 1) / 2
        total += hits
        i = j
    return (rank - total * (total + 1) / 2) / max(1, total * (len(pairs) - total))
