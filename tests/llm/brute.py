"""Plain versions of the operators, over lists of (doc_id, text)."""

from __future__ import annotations

import re
from collections import Counter

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None, lower: bool = True) -> list[bytes]:
    return WORD.findall(((text or "").translate(UPPER) if lower else text or "").encode())


def shingles(text: str | None, n: int = 5) -> set:
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def near_duplicates(docs) -> dict:
    """doc_id: (n_shingles, component)"""
    sets = {d: shingles(t) for d, t in docs if d is not None}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def covered(docs, n: int = 50) -> dict:
    """doc_id: positions of words that lie in n words that another document has too."""
    w = {d: words(t) for d, t in docs if d is not None}
    held: dict = {}
    for d, x in w.items():
        for i in range(len(x) - n + 1):
            held.setdefault(tuple(x[i : i + n]), set()).add(d)
    out = {}
    for d, x in w.items():
        at = {k for i in range(len(x) - n + 1) if len(held[tuple(x[i : i + n])]) > 1 for k in range(i, i + n)}
        if at:
            out[d] = at
    return out


def base_columns(text: str | None) -> dict:
    text = text or ""
    w = words(text, lower=False)
    lines = [x for x in text.split("\n") if words(x)]
    three = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {k for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)}
    return {
        "n_words": len(w), "word_chars": sum(len(x.decode()) for x in w), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(again),
    }
