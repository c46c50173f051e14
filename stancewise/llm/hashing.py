"""Keys and hashes of all pieces of a byte buffer at once."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

#: Words of 8 bytes in the exact key of a short piece.
WORDS_OF = 3
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def packed_pieces(buf: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> list[np.ndarray]:
    """The first 24 bytes of each piece as WORDS_OF arrays of words, zero-filled. With its length that is all of a piece of up to 24."""
    padded = np.concatenate([buf, np.zeros(8 * (WORDS_OF + 1), np.uint8)])
    words = np.ndarray(len(buf) + 8 * WORDS_OF, "<u8", padded, strides=(1,))
    size = stops - starts
    out = [words[starts] & _MASKS[np.minimum(size, 8)]]
    for k in range(1, WORDS_OF):
        more = np.flatnonzero(size > 8 * k)
        word = np.zeros(len(starts), np.uint64)
        word[more] = words[starts[more] + 8 * k] & _MASKS[np.minimum(size[more] - 8 * k, 8)]
        out.append(word)
    return out


def mixed_pieces(words: list[np.ndarray], size: np.ndarray) -> np.ndarray:
    """64-bit hashes of the exact keys of packed_pieces."""
    h = mixed(words[0] + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for k in range(1, len(words)):
        more = np.flatnonzero(size > 8 * k)
        h[more] = mixed(h[more] * np.uint64(0xD6E8FEB86659FD93) + words[k][more])
    return h


def piece_hashes(buf: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes: of pieces of up to 24 bytes by mixing their exact key, of longer ones (few) by BLAKE2."""
    size = stops - starts
    h = mixed_pieces(packed_pieces(buf, starts, stops), size)
    for i in np.flatnonzero(size > 8 * WORDS_OF).tolist():
        h[i] = int.from_bytes(blake2b(buf[starts[i] : stops[i]].tobytes(), digest_size=8).digest(), "little")
    return h
