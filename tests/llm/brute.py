"""Plain re-statements of what the operators return, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text: str | None, size: int) -> set:
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def near_duplicates(texts: dict[int, str | None], size: int, percent: int = 80) -> dict:
    """identifier -> (set size, component, kept)."""
    sets = {i: shingle_set(t, size) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    having = defaultdict(list)
    for i in sorted(sets):
        for j, shared in Counter(j for s in sets[i] for j in having[s]).items():
            if 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            having[s].append(i)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def without_repeats(texts: dict[int, str | None], threshold: int = 50, whole: bool = False) -> dict:
    """identifier -> (bytes, removed, runs, kept bytes); with ``whole`` by whole characters."""
    seen: set[bytes] = set()
    found = {}
    for i in sorted(texts):
        raw = (texts[i] or "").encode()
        gone = bytearray(len(raw))
        windows = [raw[k : k + threshold] for k in range(len(raw) - threshold + 1)]
        for k, window in enumerate(windows):
            if window in seen:
                gone[k : k + threshold] = b"\1" * threshold
        seen.update(windows)
        if whole:
            at = 0
            for character in texts[i] or "":
                size = len(character.encode())
                gone[at : at + size] = bytes([max(gone[at : at + size])]) * size
                at += size
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        runs = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        found[i] = (len(raw), len(raw) - len(kept), runs, kept)
    return found


def base_counts(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORD.findall(text)
    triples = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for i, triple in enumerate(zip(words, words[1:], words[2:])):
        if triples[triple] > 1:
            covered |= {i, i + 1, i + 2}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, repeated, len(covered)


def is_held_out(identifier: int) -> bool:
    return zlib.crc32(str(identifier).encode()) % 5 == 0


def sha256(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()
