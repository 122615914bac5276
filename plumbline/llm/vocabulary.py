"""Byte-level BPE vocabularies as arrays, read from files whose path is a parameter.

The driver reads a file once and broadcasts its bytes (one or two megabytes, the size of
the file); tasks parse them once per Python worker. Executors need no access to the path.
"""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass
from pathlib import Path

import numpy as np
from pyspark import Broadcast
from pyspark.sql import SparkSession

#: The rank of a pair that no merge joins.
NO_RANK = np.int64(2**31)


def broadcast_file(spark: SparkSession, path: str) -> Broadcast:
    return spark.sparkContext.broadcast(Path(path).read_bytes())


class PairTable:
    """(left id, right id) -> (rank, merged id), by an open-addressing hash table."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        size = 1 << max(10, int(len(left) * 4).bit_length())
        self._shift = np.uint64(64 - (size.bit_length() - 1))
        self._mask = size - 1
        self._keys = np.full(size, -1, dtype=np.int64)
        self._values = np.full(size, -1, dtype=np.int64)
        self.rank, self.merged = rank, merged
        keys = (left.astype(np.int64) << 32) | right
        slots = self._slot(keys)
        waiting = np.arange(len(keys))
        while len(waiting):
            free = self._keys[slots[waiting]] < 0
            _, first = np.unique(slots[waiting[free]], return_index=True)
            placed = waiting[free][first]
            self._keys[slots[placed]] = keys[placed]
            self._values[slots[placed]] = placed
            waiting = np.setdiff1d(waiting, placed, assume_unique=True)
            slots[waiting] = (slots[waiting] + 1) & self._mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> self._shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge's number for each pair, or -1."""
        keys = (left.astype(np.int64) << 32) | right
        slots = self._slot(keys)
        seen = self._keys[slots]
        found = np.where(seen == keys, self._values[slots], -1)
        waiting = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(waiting):
            slots[waiting] = (slots[waiting] + 1) & self._mask
            seen = self._keys[slots[waiting]]
            hit = seen == keys[waiting]
            found[waiting[hit]] = self._values[slots[waiting[hit]]]
            waiting = waiting[~hit & (seen >= 0)]
        return found

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        found = self.find(left, right)
        return np.where(found >= 0, self.rank[found], NO_RANK)


@dataclass
class Vocabulary:
    """Ids of the single bytes, merges by pair, and the bytes of every id."""

    byte_ids: np.ndarray
    pairs: PairTable
    token_bytes: np.ndarray
    token_offsets: np.ndarray
    special: str | None = None
    special_id: int | None = None


def _ragged(tokens: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    ordered = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in ordered])])
    return np.frombuffer(b"".join(ordered), dtype=np.uint8), offsets


def _byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in the .json vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    letters = {chr(b): b for b in shown}
    letters.update({chr(256 + i): b for i, b in enumerate(hidden)})
    return letters


def from_json(raw: bytes) -> Vocabulary:
    """A byte-level BPE file of the tokenizers library: ids, and merges in rank order."""
    described = json.loads(raw)
    letters = _byte_letters()
    ids = described["model"]["vocab"]
    tokens = {
        i: bytes(letters[c] for c in token)
        for token, i in ids.items()
        if all(c in letters for c in token)
    }
    merges = [m.split(" ") if isinstance(m, str) else m for m in described["model"]["merges"]]
    left = np.array([ids[a] for a, _ in merges])
    right = np.array([ids[b] for _, b in merges])
    merged = np.array([ids[a + b] for a, b in merges])
    byte_ids = np.zeros(256, dtype=np.int64)
    for letter, byte in letters.items():
        byte_ids[byte] = ids[letter]
    special = [t for t in described["added_tokens"] if t["special"]]
    name, number = (special[0]["content"], special[0]["id"]) if special else (None, None)
    if name is not None:
        tokens[number] = name.encode()
    pairs = PairTable(left, right, np.arange(len(merges)), merged)
    return Vocabulary(byte_ids, pairs, *_ragged(tokens), name, number)


def from_ranks(raw: bytes) -> Vocabulary:
    """A file of (base64 token, rank) lines: any pair that spells a token may merge.

    Every way to cut a token into two tokens is a pair of that token's rank.
    """
    lines = [line.split() for line in raw.splitlines() if line.strip()]
    ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
    left, right, rank = [], [], []
    for token, number in ranks.items():
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                left.append(a)
                right.append(b)
                rank.append(number)
    byte_ids = np.array([ranks[bytes([b])] for b in range(256)])
    tokens = {number: token for token, number in ranks.items()}
    rank = np.array(rank)
    return Vocabulary(byte_ids, PairTable(np.array(left), np.array(right), rank, rank), *_ragged(tokens))
