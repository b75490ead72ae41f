"""A length-limited canonical Huffman code of small whole numbers, with numpy.

Code lengths come from package-merge, which is optimal below the limit. The codes are canonical (by length, then
number), so lengths alone describe a code. A bit stream is a sequence of 64-bit words, highest bit
first. Decoding looks the next `bits` bits up in one table; it starts at checkpoints, the bit offset of every `every`-th
symbol, and so decodes all stretches of a stream, and of many streams, side by side.
"""

from __future__ import annotations

import numpy as np

#: Symbols between two checkpoints.
EVERY = 256


def code_lengths(counts: np.ndarray, limit: int = 20) -> np.ndarray:
    """The length of each symbol's code, 0 where its count is 0; longer than `limit` only if so many symbols need it."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n < 2:
        lengths[used] = 1
        return lengths
    used = used[np.argsort(counts[used], kind="stable")]
    own = counts[used].astype(np.int64)
    limit = max(limit, (n - 1).bit_length())
    # Each level holds the symbols and the pairs of the level before, by weight; kept: which of them are symbols.
    weights, kept = own, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate([own, pairs])
        order = merged.argsort(kind="stable")
        weights = merged[order]
        kept.append(order < n)
    take, depth = 2 * (n - 1), np.zeros(n, np.int64)
    for level in reversed(kept):
        symbols = int(level[:take].sum())
        depth[:symbols] += 1
        take = 2 * (take - symbols)
    lengths[used] = depth
    return lengths


class Code:
    """A canonical code, from its lengths by symbol."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.uint8)
        self.bits = int(lengths.max(initial=0)) or 1
        symbols = np.flatnonzero(lengths)
        symbols = symbols[np.argsort(lengths[symbols], kind="stable")]
        own = lengths[symbols].astype(np.int64)
        # A code of n bits fills 2^(bits - n) places of the table; its own place is where it begins.
        room = np.left_shift(np.int64(1), self.bits - own)
        begin = np.cumsum(room) - room
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[symbols] = begin >> (self.bits - own)
        self.symbols = np.zeros(1 << self.bits, np.uint32)
        self.steps = np.ones(1 << self.bits, np.uint8)
        total = int(room.sum())
        self.symbols[:total] = np.repeat(symbols, room)
        self.steps[:total] = np.repeat(own, room)

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The stream, and the bits between its checkpoints."""
        length = self.lengths[ids].astype(np.int64)
        if len(ids) and not length.min():
            raise ValueError("a symbol without a code")
        end = np.cumsum(length)
        begin = end - length
        words = np.zeros((int(end[-1]) + 63 >> 6) + 1 if len(ids) else 1, np.uint64)
        if len(ids):
            code, word, left = self.codes[ids], begin >> 6, 64 - (begin & 63) - length
            head = np.where(left >= 0, code << np.maximum(left, 0).astype(np.uint64), code >> np.maximum(-left, 0).astype(np.uint64))
            first, start = np.unique(word, return_index=True)
            words[first] = np.add.reduceat(head, start)  # bits of different codes don't meet, so a sum joins them
            over = left < 0
            words[word[over] + 1] += code[over] << (64 + left[over]).astype(np.uint64)
        return words[:-1], np.diff(begin[::EVERY])

    def decode(self, words: np.ndarray, begin: np.ndarray, rows: int) -> np.ndarray:
        """`rows` symbols from each bit offset: (len(begin), rows). Those behind a stretch's end are of no use."""
        padded = np.concatenate([words, np.zeros(2 + rows * self.bits // 64, np.uint64)])
        at, out = begin.astype(np.int64), np.empty((rows, len(begin)), np.uint32)
        low, shift = np.uint64(1), np.uint64(64 - self.bits)
        for row in range(rows):
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            window = (padded[word] << bit) | (padded[word + 1] >> low >> (np.uint64(63) - bit))
            index = window >> shift
            out[row] = self.symbols[index]
            at += self.steps[index]
        return out.T
