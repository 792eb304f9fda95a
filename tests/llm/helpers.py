"""Plain forms of the operators' rules, for small inputs."""

from __future__ import annotations

import re
from itertools import combinations

WORD = re.compile(r"[^\x20\t-\r]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingle_set(text: str | None, k: int) -> set:
    own = words(lower(text or ""))
    if not own:
        return set()
    return {tuple(own)} if len(own) < k else {tuple(own[i : i + k]) for i in range(len(own) - k + 1)}


def near_components(docs: list[tuple], k: int, percent: int) -> dict:
    """Smallest reachable id of each id, from (id, text) rows."""
    sets = [(i, shingle_set(t, k)) for i, t in docs]
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in combinations(sets, 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            low, high = sorted((find(i), find(j)))
            root[high] = low
    return {i: find(i) for i, _ in docs}


def trimmed_lines(docs: list[tuple]) -> dict:
    """Text without later windows of three lines, by id, from (id, text) rows with different ids."""
    seen, cover = set(), {}
    for i, text in sorted(docs):
        lines = (text or "").split("\n")
        for p in range(len(lines) - 2):
            window = tuple(lines[p : p + 3])
            if window in seen:
                cover.setdefault(i, set()).update((p, p + 1, p + 2))
            seen.add(window)
    return {i: t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in cover.get(i, ())) for i, t in docs}


def greedy_pieces(word: bytes, vocabulary: set[bytes], longest: int) -> int:
    n = at = 0
    while at < len(word):
        for end in range(min(len(word), at + longest), at, -1):
            if word[at:end] in vocabulary:
                break
        else:
            return 1
        n, at = n + 1, end
    return n
