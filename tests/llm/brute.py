"""Plain-Python versions of the operators, for small inputs."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def measures(text):
    text = text or ""
    ws = words(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    letters = re.compile("[A-Za-z\x80-\U0010ffff]")
    return {"n_words": len(ws), "word_chars": sum(map(len, ws)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
            "n_wordy": sum(bool(letters.search(w)) for w in ws)}


def quality_kept(text):
    m = measures(text)
    return not (m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"] or 10 * m["n_symbols"] > m["n_words"]
                or m["word_chars"] < 2 * m["n_words"] or m["word_chars"] > 15 * m["n_words"]
                or m["n_lines"] >= 4 and 2 * m["n_dup_lines"] > m["n_lines"] or 10 * m["n_wordy"] < 7 * m["n_words"])


def line_dedup(docs, min_sites=10, spare=False):
    """docs: (id, text, site); returns {id: (lines with a word, removed, text)}."""
    sites = {}
    for _, text, site in docs:
        for line in (text or "").split("\n"):
            if WORD.search(line) and site is not None and text is not None:
                sites.setdefault(line, set()).add(site)
    out = {}
    for i, text, _ in docs:
        lines = (text or "").split("\n")
        n = sum(bool(WORD.search(x)) for x in lines)
        gone = [len(sites.get(x, ())) >= min_sites and bool(WORD.search(x)) for x in lines]
        if text is None or not any(gone) or spare and 2 * sum(gone) > n:
            out[i] = (n, 0, text)
        else:
            out[i] = (n, sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g))
    return out


def shingles(text, k=5):
    w = words((text or "").translate(FOLD))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def near_components(docs):
    """{id: text} to {id: component}."""
    sets = {i: shingles(t) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in docs}


def repeats(docs, length=50):
    """{id: bytes} to {id: (spans, kept)}."""
    first, out = {}, {}
    for i in sorted(docs):
        raw = docs[i]
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if first.setdefault(raw[p:p + length], i) < i:
                gone[p:p + length] = b"\1" * length
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out[i] = (spans, bytes(c for c, g in zip(raw, gone, strict=True) if not g))
    return out


def plain_words(text):
    return re.findall("[a-z0-9\x80-\U0010ffff]+", (text or "").translate(FOLD))


def holds(text, item):
    """Does the text hold the item's words, one after the other?"""
    return f" {' '.join(plain_words(item))} " in f" {' '.join(plain_words(text))} "


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def longest_run(a, b):
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(b)]
        best = max(best, *row)
    return best


def leaked(text, item, step=16, window=48):
    """Does an item stand around any passage of the text: 80 % of it as a common subsequence, or 60 % with either a run
    of 60 % (8 words at least) or 60 % of its last sentence?  Every passage is tried, without any search."""
    own, words = plain_words(text), plain_words(item)
    sentences = [w for w in map(plain_words, re.split("[.!?]", item)) if len(w) >= 3]
    answer = sentences[-1] if sentences else words
    if len(words) < 3:
        return False
    for at in range(0, len(own), step):
        near = own[max(0, at - len(words)):at + window + len(words)]
        n = lcs(words, near)
        if 100 * n < 60 * len(words):
            continue
        run = longest_run(words, near)
        if (100 * n >= 80 * len(words) or run >= 8 and 100 * run >= 60 * len(words)
                or 100 * lcs(answer, near) >= 60 * len(answer)):
            return True
    return False
