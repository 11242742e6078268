"""64-bit hashes of words, remembered."""

from __future__ import annotations

import xxhash

from planweave.llm.common import remembered


class WordHashes(dict):
    """xxh3 of a word's bytes; bounded, cleared when full."""

    def __init__(self, entries: int = 100_000):
        super().__init__()
        self.entries = entries

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.entries:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


HASHES = WordHashes()
remembered("shingles", HASHES.clear)
