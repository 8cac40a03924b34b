"""Five-word shingles as 64-bit hashes, MinHash signatures and exact set likeness, in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

WORDS = 5
HASHES = 120
_RNG = np.random.Generator(np.random.PCG64(20240229))
_SPREAD = _RNG.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (MurmurHash3's)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (split at ASCII white space, A-Z lower-cased) and each text's first place."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = pc.dictionary_encode(parts.flatten())
    words = np.array(coded.dictionary.to_pylist() or [""], object)
    known = mixed(pd.util.hash_array(words, categorize=False))
    rows = coded.indices.to_numpy(zero_copy_only=False)
    full = np.array([w != "" for w in words])[rows] if len(rows) else np.zeros(0, bool)
    edge = parts.offsets.to_numpy() - parts.offsets[0].as_py()
    return known[rows[full]], np.concatenate([[0], np.cumsum(full)])[edge]


def sets(texts: pa.Array) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted; a text of 1 to 4 words has one, of none an empty set."""
    hashes, edge = word_hashes(texts)
    n = len(hashes) - WORDS + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for k in range(WORDS if n > 0 else 0):
        rolled += hashes[k : k + n] * _SPREAD[k]
    rolled = mixed(rolled)
    out = []
    for low, high in zip(edge[:-1], edge[1:]):
        if high - low >= WORDS:
            out.append(np.unique(rolled[low : high - WORDS + 1]))
        elif high > low:
            out.append(mixed((hashes[low:high] * _SPREAD[: high - low]).sum(keepdims=True, dtype=np.uint64) + np.uint64(high - low)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(found: list[np.ndarray]) -> np.ndarray:
    """MinHash signatures (sets x HASHES, u32) of sets that are not empty."""
    out = np.empty((len(found), HASHES), np.uint32)
    if not found:
        return out
    flat = np.concatenate(found)
    starts = np.cumsum([0] + [len(s) for s in found[:-1]])
    held = np.empty_like(flat)
    for k in range(HASHES):
        np.multiply(flat, _MUL[k], out=held)
        held += _ADD[k]
        out[:, k] = np.minimum.reduceat(held, starts) >> np.uint64(32)
    return out


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, exactly, over full sorted sets."""
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)
