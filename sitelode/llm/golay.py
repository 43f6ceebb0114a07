"""The perfect binary Golay code of length 23 as a fuzzy hash.

Every 23-bit word lies within 3 bits of exactly one codeword. Two words that differ in at most 2 bits have a word between them
that is at most 1 bit from each, and whose codeword is at most 4 bits from both; so if each word is given the indices
of all codewords within 4 bits (one if its nearest is within 2, else six), such words always share an index.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

# Fixed value: generator polynomial of the code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
LENGTH, CHECK = 23, 11


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of each word by the generator: 0 for codewords."""
    rest = np.array(words, dtype=np.int64)
    for bit in range(LENGTH - 1, CHECK - 1, -1):
        rest ^= ((rest >> bit) & 1) * (GENERATOR << (bit - CHECK))
    return rest


def error_table() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the error patterns of weight 4 or less that cause it (one, or one and five), and their number."""
    patterns = np.array([sum(1 << b for b in bits) for w in range(5) for bits in combinations(range(LENGTH), w)], np.int64)
    weights = np.array([bin(p).count("1") for p in patterns])
    of = syndrome(patterns)
    order = np.lexsort((patterns, weights, of))
    patterns, of = patterns[order], of[order]
    place = np.arange(len(of)) - np.searchsorted(of, of)
    table = np.zeros((1 << CHECK, place.max() + 1), np.int64)
    table[of, place] = patterns
    return table, np.bincount(of, minlength=1 << CHECK)


ERRORS, COUNTS = error_table()


def indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the codewords within 4 bits of each word, as a matrix, and how many of its columns count."""
    words = np.asarray(words, np.int64)
    of = syndrome(words)
    return (words[:, None] ^ ERRORS[of]) >> CHECK, COUNTS[of]
