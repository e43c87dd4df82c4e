"""Hashes of many words at once, read from the bytes of their texts."""

from __future__ import annotations

import numpy as np
import xxhash

M1, M2, M3 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes from which on a word is hashed by itself.
LONG_WORD = 256
#: Bytes that must follow the last word in a buffer.
PADDING = 8
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def mixed(x: np.ndarray, salt: np.uint64) -> np.ndarray:
    x = x + salt
    x *= M1
    x ^= x >> np.uint64(32)
    x *= M3
    x ^= x >> np.uint64(29)
    return x


def word_hashes(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray, salt: np.uint64 = M2) -> np.ndarray:
    """64-bit hashes of words, eight bytes of all of them at a time. buf goes on for PADDING bytes after the last word."""
    eight = np.ndarray((len(buf) - PADDING + 1,), dtype="<u8", buffer=buf, strides=(1,))
    # the first eight bytes of all words, then of those that go on
    out = mixed(sizes.astype(np.uint64), salt)
    out ^= eight[starts] & _LOW[np.minimum(sizes, 8)]
    out = mixed(out, salt)
    live, done = np.flatnonzero(sizes > 8), 8
    while len(live):
        left = np.minimum(sizes[live] - done, 8).astype(np.uint64)
        own = eight[starts[live] + done] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left))
        out[live] = mixed(out[live] ^ own, salt)
        done += 8
        live = live[sizes[live] > done]
        if done >= LONG_WORD:
            for k in live.tolist():
                out[k] = xxhash.xxh3_64_intdigest(buf[starts[k]:starts[k] + sizes[k]].tobytes(), seed=int(salt))
            break
    return out


def spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each of sizes, one after another."""
    return np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
