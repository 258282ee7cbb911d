"""Plain Python versions of the contracts."""

from __future__ import annotations

import re
from collections import defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def shingles(text: str | None) -> frozenset:
    words = SPACED.findall((text or "").translate(LOWER))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def near_components(texts: dict[int, str | None]) -> dict[int, int]:
    sets = {d: shingles(t) for d, t in texts.items()}
    holders = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for one, s in sets.items():
        for two in {d for g in s for d in holders[g] if d < one}:
            common = len(s & sets[two])
            if 100 * common >= 75 * (len(s) + len(sets[two]) - common):
                a, b = find(one), find(two)
                parent[max(a, b)] = min(a, b)
    return {d: find(d) for d in sets}


def without_repeats(texts: dict[int, str | None], size: int = 13) -> dict[int, tuple[int, int, str]]:
    first: dict[tuple, int] = {}
    words = {d: SPACED.findall(t or "") for d, t in texts.items()}
    for d in sorted(words):
        for i in range(len(words[d]) - size + 1):
            first.setdefault(tuple(words[d][i : i + size]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < d:
                gone.update(range(i, i + size))
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def contaminated(text: str | None, items: list[str | None]) -> bool:
    words = PLAIN.findall((text or "").translate(LOWER))
    for item in items:
        w = PLAIN.findall((item or "").translate(LOWER))
        n = min(10, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        if any(tuple(words[i : i + n]) in windows for i in range(len(words) - n + 1)):
            return True
    return False
