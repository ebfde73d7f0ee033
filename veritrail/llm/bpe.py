"""Byte-pair merging shared by the tokenizer operators: vocabulary files, and two ways to merge one word.

Both ways merge the adjacent pair of lowest rank, the leftmost first, until no
pair has a rank, so they give the same parts. ``merge_short`` keeps boundaries
and ranks in contiguous lists and suits words of a few dozen symbols;
``count_merges`` and ``merge_long`` use a heap over a linked list, which stays
near linear for words of any length.
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import regex

NO_RANK = 1 << 60
SHORT = 64
CACHE_WORDS = 1 << 18


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, spare = {b: chr(b) for b in printable}, 256
    for b in range(256):
        if b not in table:
            table[b] = chr(spare)
            spare += 1
    return [table[b] for b in range(256)]


class Vocabulary:
    """A byte-level BPE vocabulary: symbol ids, ranks of pairs and what each pair becomes."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special: dict[str, int] = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[self.ids[left] << 20 | self.ids[right]] = rank
            self.merged.append(self.ids[left + right])
        symbols = byte_symbols()
        self.first = [self.ids[s] for s in symbols]
        self.last = [self.ids[s + self.suffix] for s in symbols]
        named = self.ids | self.special
        self.names = [""] * (max(named.values()) + 1)
        for name, i in named.items():
            self.names[i] = name
        longest = sorted(self.special, key=len, reverse=True)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None

    def symbols(self, word: str) -> list[int]:
        raw = word.encode("utf-8")
        ids = [self.first[b] for b in raw]
        if ids:
            ids[-1] = self.last[raw[-1]]
        return ids

    def segments(self, text: str) -> list[str]:
        """The text cut around special strings; the odd places hold these."""
        if self.special_split is None or not any(s in text for s in self.special):
            return [text]
        return self.special_split.split(text)


def merge_short(ids: list[int], vocabulary: Vocabulary) -> list[int]:
    """Contiguous rank array: scan for the minimum, delete that boundary, refresh the neighbouring ranks."""
    get, merged = vocabulary.ranks.get, vocabulary.merged
    bounds = list(ids)  # the part that begins at each boundary that is left
    ranks = [get(a << 20 | b, NO_RANK) for a, b in zip(bounds, bounds[1:])]
    while ranks:
        least = min(ranks)
        if least == NO_RANK:
            break
        i = ranks.index(least)
        bounds[i] = part = merged[least]
        del bounds[i + 1], ranks[i]
        if i:
            ranks[i - 1] = get(bounds[i - 1] << 20 | part, NO_RANK)
        if i < len(ranks):
            ranks[i] = get(part << 20 | bounds[i + 1], NO_RANK)
    return bounds


def _heap_merge(ids: list[int], vocabulary: Vocabulary) -> int:
    """Merges ``ids`` in place over a linked list, -1 where a symbol was absorbed; returns the number of merges."""
    get, merged, n = vocabulary.ranks.get, vocabulary.merged, len(ids)
    heap = [r << 32 | i for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := get(a << 20 | b)) is not None]
    if not heap:
        return 0
    pop, push = heapq.heappop, heapq.heappush
    heapq.heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    merges = 0
    while heap:
        top = pop(heap)
        rank, i = top >> 32, top & 0xFFFFFFFF
        j = after[i]
        if j == n or get(ids[i] << 20 | ids[j]) != rank:
            continue  # one side has changed since
        ids[i], ids[j] = part, _ = merged[rank], -1
        merges += 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := get(part << 20 | ids[k])) is not None:
                push(heap, r << 32 | i)
        h = before[i]
        if h >= 0 and (r := get(ids[h] << 20 | part)) is not None:
            push(heap, r << 32 | h)
    return merges


def count_merges(ids: list[int], vocabulary: Vocabulary) -> int:
    return _heap_merge(list(ids), vocabulary)


def merge_long(ids: list[int], vocabulary: Vocabulary) -> list[int]:
    ids = list(ids)
    _heap_merge(ids, vocabulary)
    return [i for i in ids if i >= 0]


def lower_each(text: str) -> str:
    """Lower case character by character: a sigma is never treated as final."""
    return "".join([c.lower() for c in text]) if "Σ" in text else text.lower()


def composed(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFC", text)


class Memo(dict):
    """Word to result, filled by ``make``; emptied when it holds ``limit`` words, so its memory is bounded."""

    def __init__(self, make, limit: int = CACHE_WORDS, longest: int = 64) -> None:
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, word: str):
        made = self.make(word)
        if len(word) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[word] = made
        return made
