"""Words, character n-grams and their hashes for many texts at once, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_BLOCK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mixed(value: np.ndarray) -> np.ndarray:
    """Spreads 64-bit hashes over all their bits."""
    value = (value ^ (value >> np.uint64(32))) * _MIX
    return value ^ (value >> np.uint64(29))


def bucket(value: np.ndarray, buckets: int) -> np.ndarray:
    """Numbers below ``buckets``, a power of two."""
    return (mixed(value) & np.uint64(buckets - 1)).astype(np.int32)


@dataclass
class Words:
    """All words of some texts, in order.

    ``raw`` holds the texts with a blank before and after each; ``start`` and ``end`` bound each word in
    it, ``text`` is the number of the text that a word belongs to, ``place`` its position there.
    """

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    place: np.ndarray
    n_texts: int

    @classmethod
    def of(cls, texts: list[bytes | None]) -> Words:
        parts = [t or b"" for t in texts]
        raw = np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8)
        blank = _SPACE[raw]
        edge = np.diff(blank.view(np.int8))
        start, end = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
        first = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
        text = np.searchsorted(first, start, side="left") - 1 if len(start) else np.zeros(0, np.int64)
        opening = np.searchsorted(text, np.arange(len(parts)))
        return cls(raw, start, end, text, np.arange(len(start)) - opening[text], len(parts))

    def hashes(self) -> np.ndarray:
        """One 64-bit hash per word, lower-cased in A-Z."""
        return _span_hashes(_LOWER[self.raw], self.start, self.end)

    def shapes(self) -> np.ndarray:
        """A hash of the kinds of characters that a word runs through: Ab-12! is like Xyz-4!!."""
        kind = self.raw.copy()
        kind[(kind >= 0x61) & (kind <= 0x7A) | (kind >= 0x80)] = 0x61
        kind[(kind >= 0x41) & (kind <= 0x5A)] = 0x41
        kind[(kind >= 0x30) & (kind <= 0x39)] = 0x30
        kind[_SPACE[kind]] = 0x20
        kept = np.concatenate([[True], kind[1:] != kind[:-1]])
        at = np.cumsum(kept) - 1
        return _span_hashes(kind[kept], at[self.start], at[self.end - 1] + 1)


def _span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of spans in order, by differences of prefix sums modulo 2**64.

    A hash depends on the bytes of its span alone, so spans are taken a block at a time: what is held
    besides follows the block, not the text.
    """
    found = np.empty(len(start), np.uint64)
    edges = np.searchsorted(start, np.arange(0, len(raw) + _BLOCK, _BLOCK))
    with np.errstate(over="ignore"):
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            low = start[a]
            part = raw[low : end[b - 1]].astype(np.uint64) + np.uint64(1)
            power = np.cumprod(np.full(len(part), _BASE, np.uint64))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * power)])
            back = np.cumprod(np.full(len(part), np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64))
            found[a:b] = mixed((sums[end[a:b] - low] - sums[start[a:b] - low]) * back[start[a:b] - low])
    return found


def subwords(words: Words, shortest: int, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, bucket) of every word itself and its n-grams of bytes, a blank marking its ends."""
    raw = _LOWER[words.raw]
    found = [(np.arange(len(words.start)), bucket(words.hashes(), buckets))]
    blank = _SPACE[raw]
    raw = np.where(blank, np.uint8(0x20), raw)
    owner = np.cumsum(np.concatenate([[0], ((~blank[1:]) & blank[:-1]).astype(np.int32)])) - 1
    blanks = np.concatenate([[0], np.cumsum(blank)])
    value = np.zeros(len(raw), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, longest + 1):
            many = len(raw) - n + 1
            if many <= 0:
                break
            value = value[:many] * _BASE + raw[n - 1 :].astype(np.uint64) + np.uint64(1)
            if n < shortest:
                continue
            # No blank strictly inside; of two bytes, one at most.
            inside = blanks[n - 1 : n - 1 + many] - blanks[1 : 1 + many] == 0 if n > 2 else ~(blank[:many] & blank[n - 1 :])
            at = np.flatnonzero(inside & (blanks[n : n + many] - blanks[:many] < n))
            found.append((owner[np.where(blank[at], at + 1, at)], bucket(value[at] + np.uint64(n), buckets)))
    own, cells = (np.concatenate(c) for c in zip(*found, strict=True))
    return own, cells


def cut_at_words(text: bytes, words: int, most: int) -> list[bytes]:
    """The text in parts of some ``most`` bytes, all but the last with a multiple of ``words`` words."""
    if len(text) <= most:
        return [text]
    blank = _SPACE[np.frombuffer(text, np.uint8)]
    start = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))[::words]
    at = np.unique(np.searchsorted(start, np.arange(most, len(text), most)))
    cuts = [0, *start[at[at < len(start)]].tolist(), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def slices(sizes: list[int], most: int) -> list[slice]:
    """Consecutive rows of some ``most`` bytes together; a longer row stands alone."""
    cuts, held = [0], 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            cuts.append(i)
            held = 0
        held += size
    return [slice(a, b) for a, b in zip(cuts, [*cuts[1:], len(sizes)], strict=True) if b > a]
